"""Entity transition analytics on Spark."""
