"""Media-library operations analytics on PySpark."""
