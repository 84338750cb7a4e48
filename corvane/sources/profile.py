"""Profiles of Python code in queries, as files."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


@contextmanager
def profiled(spark: SparkSession, path: str | None = None, kind: str = "perf") -> Iterator[None]:
    """Profile the UDFs of the queries that run inside, by time ("perf") or "memory"; dump the profiles to a folder or show them."""
    key = "spark.sql.pyspark.udf.profiler"
    before = spark.conf.get(key, None)
    spark.conf.set(key, kind)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
        if path is None:
            spark.profile.show(type=kind)
        else:
            spark.profile.dump(path, type=kind)
        spark.profile.clear(type=kind)
