"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and measured bytes up to which a reduced table may be broadcast.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 48 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints; only where the cluster names none is a local one set."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lorewright-checkpoints-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder and cut the lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _weight(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes, as text, of a table that holds few rows."""
    row = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    n, size = df.agg(F.count(F.lit(1)), F.sum(F.coalesce(row, F.lit(0)))).first()
    return int(n), int(size or 0)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> bool:
    """Whether a table, of which no more than the bound is looked at, is small enough for every task to hold."""
    n, size = _weight(df.limit(rows + 1))
    return n <= rows and size <= most


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint for a table whose measured rows and bytes stay within the bounds, else the table as it is. Cheap for checkpointed and read tables."""
    return F.broadcast(df) if fits(df, rows, most) else df


def bounded(df: DataFrame, what: str, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES):
    """A reference table as pandas rows in the driver; raises where it is larger than such a table may be."""
    if not fits(df, rows, most):
        raise ValueError(f"{what}: more than {rows} rows or {most} bytes")
    return df.toPandas()


def join_hot(rows: DataFrame, keyed: DataFrame, keys: list[str], weight: str, how: str = "inner", hot: int = 10_000) -> DataFrame:
    """An equi-join of rows with one row per key, where few keys may hold most rows.

    weight: the column of keyed that says how many rows hold the key; it is dropped. A small keyed table is broadcast. Else the
    keys that hold at least a ``hot``-th of all rows, of which there are no more than ``hot``, are broadcast, and only the other
    rows are shuffled. keyed is best checkpointed.
    """
    if fits(keyed):
        return rows.join(F.broadcast(keyed.drop(weight)), keys, how)
    total = keyed.agg(F.sum(weight)).first()[0] or 0
    heavy = keyed.where(F.col(weight) * hot >= total).drop(weight)
    marked = rows.join(F.broadcast(heavy.select(*keys, F.lit(True).alias("_hot"))), keys, "left")
    a = marked.where("_hot").drop("_hot").join(F.broadcast(heavy), keys, how)
    b = marked.where("_hot IS NULL").drop("_hot").join(keyed.where(F.col(weight) * hot < total).drop(weight), keys, how)
    return a.unionByName(b)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def exploded(df: DataFrame, keys: list, array, pos: str, item: str) -> DataFrame:
    """keys, place and item of every element.

    An inner explode makes Spark filter on the array's size first, which computes the array
    twice; for arrays that are costly to make, the outer form with a filter behind it computes it once.
    """
    return df.select(*keys, F.posexplode_outer(array).alias(pos, item)).where(F.col(pos).isNotNull())


def once(df: DataFrame, keys: list, value, name: str) -> DataFrame:
    """keys and a costly value that later steps use more than once.

    Spark may copy an expression into each of its uses; nothing is copied through a generator, here of one element.
    """
    return df.select(*keys, F.explode(F.array(value)).alias(name))


def apart(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffled by keys for groups that are heavy on the processor but light in bytes: all shuffle partitions are kept, where Spark would join the small ones."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def spread(df: DataFrame) -> DataFrame:
    """For work that is heavy per row: on a master within one process, whose input is often one file of one row group, a partition per core.

    On a cluster the input stays where it is: the scan splits it by bytes (spark.sql.files.maxPartitionBytes), and a text is never shuffled to fill cores.
    """
    sc = df.sparkSession.sparkContext
    if not sc.master.startswith("local["):
        return df
    return df.repartition(sc.defaultParallelism) if df.rdd.getNumPartitions() < sc.defaultParallelism else df
