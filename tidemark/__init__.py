"""Spark-native signal analytics and tabular machine learning on DataFrames."""
