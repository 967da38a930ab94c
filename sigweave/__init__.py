"""Set sketching and similarity on PySpark."""
