"""Column-level functions: no function here triggers a Spark job."""
