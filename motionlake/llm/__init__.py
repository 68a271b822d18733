"""Training-data operators over large document tables.

Every operator takes a DataFrame, names its columns by parameter and returns a
narrow DataFrame keyed by the document id; nothing outside this package uses it.
"""
