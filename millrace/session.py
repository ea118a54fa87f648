"""Session helpers: shared folders, lineage cuts and joins that survive hot keys."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A group with more than 1 / HEAVY of all rows is heavy, so at most HEAVY groups are.
HEAVY = 1000
#: Bytes that a broadcast may have where no other bound is known; beyond it a shuffled join is used.
BROADCAST_BYTES = 32 << 20


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session with the settings that the queries assume."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Only where that setting is absent, on a single machine (tests), is a folder chosen here.
    """
    context = spark.sparkContext._jsc.sc()
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        if context.getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(named)
        return named
    if context.getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", context.master()):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix=f"millrace-{os.getpid()}-"))
    return context.getCheckpointDir().get()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the cluster's file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder; its lineage ends there."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def attach(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, how: str = "left") -> DataFrame:
    """rows joined to groups (one row a key, of groups with more than one member) without a hot key in any task.

    Groups of more than total / HEAVY rows are at most HEAVY, so they are broadcast; the
    rows of all others meet their group in a shuffled join, in which no key is large.
    Both frames are read twice and should be checkpointed. how: left or inner.
    """
    least = max(64, total // HEAVY)
    heavy = groups.filter(F.col(size) > least)
    light = groups.filter(F.col(size) <= least)
    few = heavy.select(*keys)
    return rows.join(F.broadcast(heavy), keys).unionByName(rows.join(F.broadcast(few), keys, "left_anti").join(light, keys, how))


def held_bytes(df: DataFrame) -> int:
    """About what df's rows take in a broadcast relation: eight bytes a column and forty a row, and the sizes of strings, binaries and arrays."""
    sizes = [F.lit(40 + 8 * len(df.columns)).cast("bigint")]
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            sizes.append(F.octet_length(c))
        elif kind.startswith(("array", "map")):
            sizes.append(F.octet_length(F.to_json(c)) if "string" in kind or "struct" in kind else F.greatest(F.size(c), F.lit(0)) * 8)
        elif kind.startswith("struct"):
            sizes.append(F.octet_length(F.to_json(c)))
    each = sum((F.coalesce(x, F.lit(0)) for x in sizes[1:]), sizes[0])
    return int(df.agg(F.sum(each)).first()[0] or 0)


def small_enough(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether df, which should be checkpointed, takes at most so many bytes. Summed without a shuffle of rows."""
    return held_bytes(df) <= most


def dimension(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, computed once, to be broadcast in a join if it takes at most so many bytes; a larger one is joined as Spark sees fit."""
    held = cut(df)
    return F.broadcast(held) if small_enough(held, most) else held


def shuffled(df: DataFrame) -> DataFrame:
    """df, to be joined by a shuffle whatever Spark takes it for: exploded rows are estimated by the bytes of the file that they come from, and a broadcast of them fills the driver."""
    return df.hint("merge")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
