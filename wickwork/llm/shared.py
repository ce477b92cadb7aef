"""What several operators of this subpackage need: the shared folder, bounded batches and size-checked joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes up to which the small side of a join may be broadcast; larger sides are joined by a shuffle.
BROADCAST_BYTES = 24 << 20
#: Bytes that a row of a broadcast table takes besides its strings.
ROW_BYTES = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one where it is unset and there is one machine only.

    What the operators write there stays until the session's owner clears the folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="wickwork-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df``: write it to the shared folder and read it again.

    Lost executors then cost only the stages after this table.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession, rows: int = 400, size: int = 4 << 20) -> None:
    """Keep the Arrow batches that Python workers receive small: at most ``rows`` rows and ``size`` bytes, or one longer row.

    Both are settings of the session, so they hold for what else runs in it; smaller settings of its own are left alone.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = int(spark.conf.get(key).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _bytes_of(value: Column, kind: T.DataType) -> Column | None:
    """What a value takes besides its fixed part: strings, and all that is in structs, arrays and maps; None for plain values."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long")
    if isinstance(kind, T.StructType):
        parts = [p for f in kind.fields if (p := _bytes_of(value[f.name], f.dataType)) is not None]
        return sum(parts, F.lit(16 * len(kind.fields)).cast("long"))
    if isinstance(kind, T.MapType):
        each = _bytes_of(F.map_entries(value), T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])))
        return F.coalesce(each, F.lit(0).cast("long"))
    if isinstance(kind, T.ArrayType):
        within = lambda x: _bytes_of(x, kind.elementType)
        plain = F.lit(16).cast("long") * F.greatest(F.size(value), F.lit(0))
        if within(F.lit(None).cast(kind.elementType)) is None:
            return plain
        return plain + F.coalesce(F.aggregate(value, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(within(x), F.lit(0).cast("long"))), F.lit(0).cast("long"))
    return None


def size_of(df: DataFrame) -> int:
    """About how many bytes ``df`` takes in memory: every row's fixed part, its strings, and what its structs, arrays and maps hold."""
    size = F.lit(ROW_BYTES).cast("long")
    for f in df.schema.fields:
        part = _bytes_of(F.col(f"`{f.name}`"), f.dataType)
        if part is not None:
            size = size + F.coalesce(part, F.lit(0).cast("long"))
    return df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]


def small_side(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, which is already written, to be broadcast if it takes at most ``limit`` bytes."""
    return F.broadcast(df) if size_of(df) <= limit else df


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join ``big`` with ``small``, which is already written; broadcast ``small`` only if it takes at most ``limit`` bytes."""
    return big.join(small_side(small, limit), on, how)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores after it as it takes to differ from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(df: DataFrame, text_col: str = "text"):
    """The text column as a string, null counting as empty."""
    return F.coalesce(df[text_col].cast("string"), F.lit(""))
