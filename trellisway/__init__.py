"""Transport-network analytics as ordinary PySpark DataFrame operations."""
