"""Point-in-time analytics over two-sided contests and the evidence about them, on Spark."""
