"""Secret-scanning analytics on Spark."""
