"""Document-page analytics and record linkage on Spark."""
