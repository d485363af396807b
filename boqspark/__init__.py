"""boqspark: bill-of-quantities price analytics as Spark DataFrame jobs."""
