"""Session-knowledge analytics on PySpark."""
