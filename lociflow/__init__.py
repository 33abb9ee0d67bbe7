"""Genome-wide association on intensity data, and corpus preparation, as Spark jobs."""
