"""Column builders; nothing here starts a Spark job."""
