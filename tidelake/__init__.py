"""Bring relational tables into a Parquet lake with Spark and keep them current.

``sources``    JDBC, Parquet, CSV and text scans; Parquet, text and table sinks
``functions``  column expressions: typed comparisons, sizes, scores
``operators``  DataFrame operators: joins, sets, aggregates, ordered work, profiles
``plans``      import styles, slices, incremental loads, the typed gold layer
``streaming``  the scheduled poll as an available-now file stream

Functions take and return DataFrames and keep no state of their own.
"""
