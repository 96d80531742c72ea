"""Calendar and contact data on Spark."""
