"""Closed-syncmer sketching and corpus analytics on PySpark."""
