"""Named end-to-end queries."""
