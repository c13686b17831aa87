"""tidemark: ordered-series strategy analytics and corpus preparation on PySpark."""
