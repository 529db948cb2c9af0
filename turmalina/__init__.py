"""Course-demand analytics on Spark: panel building, scoring and recommendation."""
