"""Spark-native toolkit for tables of priced listings.

Every operator takes and returns a DataFrame; what reaches the driver is a
bounded number of scalars (quantiles, top-k values, model metrics).
"""
