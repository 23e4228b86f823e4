"""Named queries: each pairs a Spark job with the SQL text that must agree with it."""
