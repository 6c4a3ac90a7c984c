"""Schemas of the tables the operators exchange."""

from pyspark.sql import types as T

FILES = "bundle_id string, path string, size bigint, content binary, read_error string"
LISTING = "bundle_id string, path string, size bigint, uri string"
RULE_FILES = "bundle_id string, rule_dir string, source string, text string"
TRANSCODED = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("encoding", T.StringType()),
        T.StructField("had_replacements", T.BooleanType()),
    ]
)
