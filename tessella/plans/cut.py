"""Cutting lineage with tables written to the folder that all executors share.

The folder is ``spark.checkpoint.dir`` of the session. Only where that is unset
and the master is local, as in tests, a temporary folder takes its place; on a
cluster that would be a folder other machines can't read, so it is an error.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_FALLBACK: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _FALLBACK:
        _FALLBACK.append("file://" + tempfile.mkdtemp(prefix="tessella-"))
    return _FALLBACK[0]


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may be gone; leftovers are only files
        pass


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _width(df: DataFrame) -> Column:
    """About the bytes of a row in memory."""
    width = F.lit(16 * len(df.columns)).cast("bigint")
    for c, kind in df.dtypes:
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{c}`")))), F.lit(0))
    return width


def measure(df: DataFrame) -> tuple[int, int]:
    """Rows and about the bytes of a written frame, or of any other by one aggregation."""
    got = getattr(df, "_tessella_measure", None)
    if not got or "rows" not in got:
        got = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(_width(df)).alias("size")).first().asDict()
    return got["rows"], got["size"] or 0


def has_rows(df: DataFrame) -> bool:
    return measure(df)[0] > 0


def _written(df: DataFrame, path: str) -> DataFrame:
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(_width(df)).alias("size")).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tessella_path, out._tessella_measure = path, seen.get
    return out


class Scratch:
    """Written tables of one operator run.

    ``keep`` writes a frame and returns it read back, with no lineage; ``drop``
    deletes a table that no later step reads. What is left is deleted at exit,
    because a lazy result may still read it until then.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(_delete, spark, self.root)

    def path(self) -> str:
        """A new folder, for a table written by the caller."""
        self.count += 1
        return f"{self.root}/{self.count}"

    def keep(self, df: DataFrame) -> DataFrame:
        """The frame written and read back; its rows and bytes are measured while it is written."""
        return _written(df, self.path())

    def delete(self, path: str) -> None:
        _delete(self.spark, path)

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_tessella_path", None)
        if path:
            _delete(self.spark, path)


def kept(df: DataFrame, name: str) -> DataFrame:
    """A frame written once and read back, for a side that several jobs read."""
    return Scratch(df.sparkSession, name).keep(df)


class Lasting:
    """Written tables that outlive the session, in a folder named by the caller; the folder is emptied first."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.count = spark, root.rstrip("/"), 0
        _delete(spark, self.root)

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        return _written(df, f"{self.root}/round={self.count}")
