"""Map tiles and training-data preparation as Spark jobs."""
