"""tramsu: a Spark-first engine for building, checking and using large question banks.

Every operator takes DataFrames and returns a DataFrame; planning, shuffling and
execution are left to Spark.
"""
