"""Spark-native analytics over business tables.

Every operator is a function from DataFrames to a DataFrame.  Nothing here
schedules, plans or stores data on its own: Catalyst and AQE choose the
physical strategy, Parquet and the Spark catalog hold the layers.
"""

__version__ = "0.1.0"
