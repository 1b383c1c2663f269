"""Log-anomaly analytics as Spark table operators."""
