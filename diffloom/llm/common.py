"""What the corpus operators share: the shared scratch folder, columns and small helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, as the contracts of this package split words.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the cluster names it.

    A local session without that setting gets a temporary folder; on a cluster
    the setting is required, because a machine's own folder isn't shared.
    """
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="diffloom-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, below a folder of this application's own."""
    return f"{scratch_dir(spark)}/diffloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that this application left in the shared folder; results that weren't written elsewhere are lost."""
    discard(spark, f"{scratch_dir(spark)}/diffloom-{spark.sparkContext.applicationId}")


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows.

    Spark bounds what it sends at once by bytes (64 MB unless the session says
    otherwise); a worker's own copies of it, as Python objects, are bounded by
    rows here, so that no setting of the caller's session has to change.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage ends there.

    A lost executor costs only a re-read, and the size is known to the planner,
    which can then broadcast small tables by their measured size.
    """
    return _written(df, scratch_path(df.sparkSession, name))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables in the shared folder that are deleted at the end of a with block, or before.

    What the block returns must not read them: it is written by materialise(),
    or by another Scratch that lives longer.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        self.tables.append((None, path))  # so that a write that fails leaves nothing behind either
        made = _written(df, path)
        self.tables[-1] = (made, path)
        return made

    def drop(self, table: DataFrame) -> None:
        """Delete a table that this made."""
        for i, (made, path) in enumerate(self.tables):
            if made is table:
                discard(self.spark, path)
                del self.tables[i]
                return

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        while self.tables:
            discard(self.spark, self.tables.pop()[1])


def fresh(taken: Sequence[str], name: str) -> str:
    """name, or with as many underscores as make it differ from the names taken, whatever their case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    return isinstance(kind, (T.MapType, T.VariantType))


def hashable(name: str, kind: T.DataType) -> Column:
    """The column, or its JSON text where Spark can neither hash nor order its type."""
    column = F.col("`" + name.replace("`", "``") + "`")
    return F.to_json(F.struct(column)) if _has_map(kind) else column


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


BITS = 1 << 15  # of Spark's bitmaps


def sieved(rows: DataFrame, by: str, keys: DataFrame, key: str, most: int = 4096) -> DataFrame:
    """rows without most of those whose whole number `by` is no `key` of the table keys, before a join shuffles them.

    The keys' hashes become a table of at most `most` bitmaps of 4 KB, 16 bits
    a key, which is broadcast: 16 MB at most, however many keys there are. No
    row that has a key is lost. Beyond the bound more of the others stay, and
    where the bitmaps would hold nearly every bit, all rows do; so a join must
    follow. Nulls go. keys should be a written table, it is read twice.
    """
    n = keys.count()
    if not n:
        return rows.where(F.lit(False))
    maps = min(most, -(-16 * n // BITS))
    if n > 2 * maps * BITS:
        return rows
    slot = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(maps * BITS))
    part, bits = fresh(rows.columns, "part_"), fresh(rows.columns, "bits_")
    table = keys.groupBy(F.floor(slot(key) / BITS).alias(part)).agg(F.bitmap_construct_agg(slot(key) % BITS).alias(bits))
    at = slot(by) % BITS
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.where(F.col(by).isNotNull()).join(F.broadcast(table), F.floor(slot(by) / BITS) == F.col(part))
    return met.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*rows.columns)


def n_words(text: Column) -> Column:
    """Number of words between ASCII white space; null counts as empty.

    Each word becomes one letter and the spaces go: what is left is as long as
    there are words, and no array of words is built.
    """
    letters = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return F.length(F.translate(letters, " \t\n\x0b\x0c\r", "")).cast("long")
