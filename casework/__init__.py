"""Support-triage analytics as Spark DataFrame operations.

The package never builds a SparkSession and never runs an action unless its
documentation says so: every function takes DataFrames or Columns and returns
DataFrames or Columns, so Catalyst plans the whole query.
"""
