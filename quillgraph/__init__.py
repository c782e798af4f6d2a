"""Graph and ordered-sequence analytics on PySpark DataFrames."""
