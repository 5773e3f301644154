"""Program-facts analytics on Spark."""
