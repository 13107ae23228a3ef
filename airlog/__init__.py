"""Schedule, catalog and media-library analytics on PySpark DataFrames."""
