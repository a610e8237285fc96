"""Log analytics as Spark DataFrame jobs, for batch tables and streams alike."""
