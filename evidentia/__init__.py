"""Document-evidence analytics on PySpark."""
