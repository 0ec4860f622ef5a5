"""quarry: catalog analytics and ranked catalog search as Spark jobs."""
