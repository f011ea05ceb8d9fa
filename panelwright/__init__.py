"""Point-in-time factor analytics on Spark."""
