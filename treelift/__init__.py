"""treelift: set-at-a-time analysis of source trees, and corpus preparation, on Spark."""
