"""Investment research and corpus preparation as Spark jobs."""
