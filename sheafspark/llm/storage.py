"""Files in the folder that all executors share, and tables staged there."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from sheafspark.session import shared_dir, stage  # noqa: F401  used by the operators
from sheafspark.sources.corpus import open_uri


def make_folder(spark: SparkSession) -> str:
    """A new folder in the shared folder, as a URI or path that executors can open."""
    folder = shared_dir(spark)
    files, path = open_uri(folder)
    files.create_dir(path, recursive=True)
    return folder


@contextmanager
def writing(uri: str) -> Iterator:
    files, path = open_uri(uri)
    with files.open_output_stream(path, compression=None) as stream:
        yield stream


@contextmanager
def reading(uri: str) -> Iterator:
    """A seekable file."""
    files, path = open_uri(uri)
    with files.open_input_file(path) as stream:
        yield stream


def schema_with(df: DataFrame, *columns: tuple[str, str]):
    """The schema of ``df`` with further columns; clashing names are refused by the caller."""
    from pyspark.sql import types as T

    schema = T.StructType(list(df.schema.fields))
    for name, kind in columns:
        schema = schema.add(name, kind)
    return schema


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def as_json(**values) -> str:
    return json.dumps(values, sort_keys=True)
