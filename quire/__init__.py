"""quire: page-structured document analytics on PySpark."""
