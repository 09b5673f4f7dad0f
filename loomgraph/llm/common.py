"""What the operators share: scratch tables in the shared folder, id folds and size-checked broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructField, StructType

#: A side is broadcast only when the measured size of its rows stays below this; otherwise it is shuffled.
BROADCAST_BYTES = 64 << 20


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder all machines share (``spark.checkpoint.dir``).

    Only a local session, where driver and executors are one machine, may do without that setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "loomgraph")
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: lineage is cut, and lost executors cost nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        for f in {p.rsplit("/", 1)[0] for p in t.inputFiles()}:
            path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def _bytes(f: StructField) -> Column:
    """Bytes that a row's value takes, measured where its width varies."""
    c, t = F.col(f"`{f.name}`"), f.dataType
    if isinstance(t, StringType | BinaryType):
        return 16 + F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    if isinstance(t, ArrayType) and not isinstance(t.elementType, StringType | BinaryType | ArrayType | StructType):
        return 24 + 8 * F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    if isinstance(t, ArrayType | StructType | MapType):
        return 24 + 2 * F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)).cast("long")
    return F.lit(8).cast("long")


def fits(df: DataFrame) -> bool:
    """Whether a written table is small enough to broadcast, by the measured size of its rows."""
    row = sum((_bytes(f) for f in df.schema.fields), F.lit(16))
    return (df.agg(F.sum(row)).first()[0] or 0) <= BROADCAST_BYTES


def small(df: DataFrame) -> DataFrame:
    """A written table marked for broadcast if its measured size allows it, else as it is, for a shuffled join."""
    return F.broadcast(df) if fits(df) else df


def dealt(left: DataFrame, right: DataFrame, keys: DataFrame, on: str, by: str = "a", most: int = 1000) -> DataFrame:
    """``left`` joined to ``right`` by ``on``; a key of over ``most`` rows is dealt out in parts, each with a copy of right's row.

    ``keys`` is a written table with the keys of ``left``; ``by`` tells its rows apart.
    """
    hot = written(keys.groupBy(on).count().where(F.col("count") > most).select(on, F.ceil(F.col("count") / most).cast("int").alias("parts")), "hot")
    if hot.isEmpty():
        return left.join(right, on)
    hot = small(hot)
    left = left.join(hot, on, "left").withColumn("part", F.pmod(F.xxhash64(by), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    right = right.join(hot, on, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return left.join(right, [on, "part"]).drop("part")


def trim() -> None:
    """Give the memory that a task has freed back to the machine, as its Python worker stays; only glibc has that call."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def fold(key: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
