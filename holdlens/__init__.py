"""Point-in-time holdings analytics on Spark."""
