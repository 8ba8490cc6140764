"""fernwork: relational and property-graph analytics on PySpark."""
