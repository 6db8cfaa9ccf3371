"""Split search and decision-tree training over wide numeric features, on Spark."""
