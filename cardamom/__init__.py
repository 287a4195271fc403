"""Tagged-record search, audit and corpus preparation as Spark jobs."""
