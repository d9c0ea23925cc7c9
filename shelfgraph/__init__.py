"""Product-catalogue graph analytics as Spark jobs."""
