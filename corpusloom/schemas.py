"""Explicit schemas of the tables that the operators pass along."""

from pyspark.sql import types as T

FILES = T.StructType([
    T.StructField("project", T.StringType(), False),
    T.StructField("path", T.StringType(), False),
    T.StructField("content", T.BinaryType(), True),
    T.StructField("size", T.LongType(), False),
])

LISTING = T.StructType([
    T.StructField("project", T.StringType(), False),
    T.StructField("path", T.StringType(), False),
    T.StructField("is_dir", T.BooleanType(), False),
    T.StructField("size", T.LongType(), False),
])

IGNORE_RUNS = T.ArrayType(T.StructType([
    T.StructField("regex", T.StringType(), False),
    T.StructField("negate", T.BooleanType(), False),
]))
