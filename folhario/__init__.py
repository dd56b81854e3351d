"""folhario: analytics over collections of paged documents, on PySpark."""
