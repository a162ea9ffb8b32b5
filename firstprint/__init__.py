"""firstprint: post-listing risk analytics as Spark DataFrame jobs."""
