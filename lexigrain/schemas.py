"""Declared schemas, enforced on read and in tests."""

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("id", T.LongType()), T.StructField("title", T.StringType())])
PHONE = T.StructType([T.StructField("number", T.StringType()), T.StructField("phone_type", T.StringType())])
CONTACTS = T.StructType([T.StructField("name", T.StringType()), T.StructField("phones", T.ArrayType(PHONE, True))])
POSTINGS = T.StructType([T.StructField("term", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("pos", T.IntegerType())])
TERMS = T.StructType([T.StructField("term", T.StringType()), T.StructField("df", T.LongType())])
