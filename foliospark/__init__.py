"""Document-analytics engine on PySpark."""
