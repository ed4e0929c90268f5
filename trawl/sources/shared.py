"""Tables in the folder that all executors share: a lost executor costs no recomputation of what lies there."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: contextvars.ContextVar[list | None] = contextvars.ContextVar("trawl_made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset a local master gets one of its own, as in tests; a cluster gets an error,
    since a machine-local folder would be another one on each executor."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="trawl-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append((spark, path))
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, which ends its lineage there."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def scratch():
    """Removes, at its end, every table that cut() or fresh() made inside it. Results that are lazily read from them must be written before."""
    made: list = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for spark, path in made:
            remove(spark, path)
