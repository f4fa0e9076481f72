"""Web-corpus analytics on PySpark."""
