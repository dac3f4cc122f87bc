"""relgraph: relationship-based permission analytics on PySpark."""
