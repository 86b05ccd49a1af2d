"""Token-uncertainty analytics on Spark."""
