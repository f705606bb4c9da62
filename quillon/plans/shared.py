"""Tables in the folder that driver and executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading it
back, so a lost executor costs a retry of its tasks and nothing more.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local one only where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def write_shared(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return the table read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of values that a broadcast side may hold; in memory it takes a small multiple of them.
BROADCAST_BYTES = 1 << 27


def value_bytes(df: DataFrame) -> Column:
    """About the bytes of a row's values."""
    sizes = []
    for f in df.schema:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        nested = kind in ("array", "map", "struct", "variant")
        sizes.append(F.octet_length(F.to_json(F.struct(c))) if nested else F.octet_length(c) if kind in ("string", "binary") else F.lit(8))
    return sum((F.coalesce(x, F.lit(0)).cast("long") for x in sizes), F.lit(0))


#: Keys of a node table that may be broadcast.
BROADCAST_KEYS = 1 << 18


def small_enough(df: DataFrame, max_rows: int, max_bytes: int | None = None) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows and, where asked, about ``max_bytes`` of values; reads no more rows than that."""
    if max_bytes is None:
        return df.limit(max_rows + 1).count() <= max_rows
    rows, size = df.limit(max_rows + 1).agg(F.count("*"), F.sum(value_bytes(df))).first()
    return rows <= max_rows and (size or 0) <= max_bytes


def broadcast_if(df: DataFrame, max_rows: int, max_bytes: int | None = None) -> DataFrame:
    """Hint a broadcast only for a side whose rows, and bytes where asked, have been checked.

    Larger sides take the shuffled join, with the same result. They are hinted too: the
    planner goes by the size of files, of which one narrow column that packs well is
    taken to be a small share, and would send millions of keys through the driver.
    """
    return F.broadcast(df) if small_enough(df, max_rows, max_bytes) else df.hint("merge")


#: Rows that a task of ``dealt`` is meant to hold.
DEALT_ROWS = 1 << 18


def parts_for(rows: int) -> int:
    """Partitions for that many rows: more rows make more tasks, not larger ones."""
    return rows // DEALT_ROWS + 1


#: Partitions up to which a shuffle without aggregation is written as it comes, and times ``DEALT_ROWS`` that a task may hold to stay there.
UNSORTED_PARTS, MOST_DEALT = 200, 8


def parts_unsorted(rows: int) -> int:
    """As ``parts_for``, but no more than UNSORTED_PARTS while a task's share stays below MOST_DEALT times DEALT_ROWS.

    A task that writes for more partitions (``spark.shuffle.sort.bypassMergeThreshold``)
    keeps all its rows in memory to sort them by partition, so what it holds follows the
    size of the input's splits and row groups.
    """
    return max(min(parts_for(rows), UNSORTED_PARTS), rows // (MOST_DEALT * DEALT_ROWS) + 1)


#: Rows that one key may bring into a task of a shuffled join, and keys with more that may be broadcast.
HOT_ROWS, HOT_KEYS = 4096, 1 << 18


def join_hot(left: DataFrame, right: DataFrame, on: list[str], count: str = "n") -> DataFrame:
    """Inner join with ``right(on.., count, ..)``, whose keys are unique and counted in ``left``.

    Keys of more than HOT_ROWS rows, of which there are at most rows / HOT_ROWS, are
    broadcast after their number is checked, so their rows stay where they are; all
    others are shuffled. ``left`` is read twice and should be a written table.
    """
    many = right.where(F.col(count) > HOT_ROWS)
    if not small_enough(many, HOT_KEYS):
        return left.join(right, on)
    cold = left.join(F.broadcast(many.select(*on)), on, "left_anti").join(right.where(F.col(count) <= HOT_ROWS), on)
    return left.join(F.broadcast(many), on).unionByName(cold)
