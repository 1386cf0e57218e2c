"""Entity state engine and analytics on PySpark."""
