"""Sports-tracking analytics expressed as Spark DataFrame jobs."""
