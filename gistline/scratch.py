"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, one of our own, in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    own = getattr(sc, "_gistline_shared", None)
    if own is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="gistline-shared-")
        atexit.register(shutil.rmtree, own[len("file://") :], True)
        sc._gistline_shared = own
    return own


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's URI under the shared root."""
    return f"{shared_root(spark)}/gistline/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, *uris: str) -> None:
    """Delete folders of intermediate results, once nothing reads them any more."""
    jvm, left = spark.sparkContext._jvm, _left(spark)
    for uri in uris:
        if uri in left:
            left.remove(uri)
        path = jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(df: DataFrame, name: str, uri: str | None = None, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and survives lost executors.

    drop() removes it once nothing reads it any more; release() removes what results still to be computed had to leave.
    """
    spark = df.sparkSession
    uri = uri or scratch(spark, name)
    df.write.option("compression", codec).parquet(uri)
    out = spark.read.schema(df.schema).parquet(uri)
    out._gistline_uri = uri
    _left(spark).append(uri)
    return out


def _left(spark: SparkSession) -> list[str]:
    """The URIs of the tables that are still there."""
    sc = spark.sparkContext
    if not hasattr(sc, "_gistline_tables"):
        sc._gistline_tables = []
    return sc._gistline_tables


def drop(*tables: DataFrame) -> None:
    """Remove tables that table() made."""
    for t in tables:
        remove(t.sparkSession, t._gistline_uri)


def mark(spark: SparkSession) -> int:
    """A point in time, for release()."""
    return len(_left(spark))


def release(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Remove the tables made since then, but for those in keep. Whatever reads them must have been computed or written."""
    left = _left(spark)
    remove(spark, *[u for u in left[since:] if u not in keep])
