"""Release catalog linkage as Spark jobs."""
