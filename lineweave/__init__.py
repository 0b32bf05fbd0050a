"""lineweave: Spark jobs that say who wrote which line, and operators for training-data corpora."""
