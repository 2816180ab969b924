"""hustings: Spark jobs for public election records, and for training text."""
