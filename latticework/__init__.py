"""Property-graph analytics and training-data operators built on PySpark DataFrames."""
