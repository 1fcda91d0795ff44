"""Query-by-example analytics over schema-less tables, expressed in PySpark."""
