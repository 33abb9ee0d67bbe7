"""Working tables in the folder that all executors share.

Every operator that needs a result twice, or that must cut a long lineage,
writes it as Parquet below ``spark.checkpoint.dir`` and reads it back.  A lost
executor then costs at most the tasks that it was running.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import importable, working_folder

BATCH_ROWS, SPARKS_OWN = 1000, "10000"
HOT_PARTS, HOT_LEAST = 1000, 10_000
_own = threading.local()


def made() -> list[str]:
    """The working folders that this thread has named and not deleted; queries in other threads have lists of their own."""
    if not hasattr(_own, "folders"):
        _own.folders = []
    return _own.folders


def _ready(spark: SparkSession) -> None:
    """Workers can import the package, and get texts and sets in batches of a few MB, unless the session sets a size of its own."""
    importable(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == SPARKS_OWN:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below the session's checkpoint folder; see working_folder."""
    _ready(spark)
    made().append(working_folder(spark))
    return made()[-1]


def saved(df: DataFrame, path: str) -> DataFrame:
    """Write df as Parquet at path and read it back, so that nothing before it is computed again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a working table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _ready(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(doc_id: str, parts: int) -> F.Column:
    """crc32 of the id as text, modulo parts."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(parts)


def released(spark: SparkSession, since: int) -> None:
    """Delete the working folders that this thread named after its first ``since`` ones, when nothing reads them any more."""
    for folder in made()[since:]:
        dropped(spark, folder)
    del made()[since:]


def keyed_join(big: DataFrame, small: DataFrame, key: str | list[str], rows: str, counts: DataFrame | None = None, how: str = "inner", total: int | None = None) -> DataFrame:
    """big joined with small, which has at most one row a key and in column rows how many rows of big have it.

    Keys that over a thousandth of big's rows share (so at most a thousand) are
    handed to their rows by a broadcast join, so that no task gets all rows of one;
    the others meet by a shuffle.  counts is a table with key and rows, where that
    is cheaper to read than small or where small lacks keys; total is the number of
    big's rows, if it is known.  Tables are read more than once.
    """
    keys = [key] if isinstance(key, str) else key
    if total is not None and total < HOT_LEAST:  # no key can have so many rows
        return big.join(small.drop(rows), keys, how)
    counts = small if counts is None else counts
    figures = counts.agg(F.coalesce(F.sum(rows), F.lit(0)).alias("total"), F.coalesce(F.max(rows), F.lit(0)).alias("most")).first()
    least = max(HOT_LEAST, figures["total"] // HOT_PARTS + 1)
    small = small.drop(rows)
    if figures["most"] < least:
        return big.join(small, keys, how)
    hot = F.broadcast(saved(counts.where(F.col(rows) >= least).select(*keys), shared_dir(big.sparkSession)))
    apart = lambda df, kind: df.join(hot, keys, kind)
    return apart(big, "left_anti").join(apart(small, "left_anti"), keys, how).unionByName(apart(big, "left_semi").join(F.broadcast(apart(small, "left_semi")), keys, how))


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that an operator is about to add: its own column takes the place of one of the same name."""
    mine = {n.lower() for n in names}
    return df.select(*[c for c in df.columns if c.lower() not in mine])


def spread(spark: SparkSession, least: int = 1) -> int:
    """Partitions for a stage whose work grows with the input."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
