"""Models that are grown by Spark jobs, the stages that make them pipelines, and their evaluation."""
