"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null integer id inside the operators, so that ids sort and join plainly.
NULL_ID = -(2**63)
#: Rows whose results by_row() holds at once.
ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(col: str) -> Column:
    """The column's text as UTF-8 bytes, empty where it is null."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b""))


def long_id(col: str) -> Column:
    return F.coalesce(F.col(col).cast("long"), F.lit(NULL_ID))


def null_id(col: Column) -> Column:
    """Undoes long_id()."""
    return F.when(col != F.lit(NULL_ID), col)


def id_bucket(col: str, n: int) -> Column:
    """crc32 of the id's decimal text modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that all executors share, under spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='shared')}"
    return f"{base.rstrip('/')}/terraframe/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """The frame as a Parquet table in the shared folder: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table that written() made."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def tidy() -> None:
    """Gives freed memory back to the system: workers outlive their tasks, and what one stage held would add to the next one's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_row(df: DataFrame, row: Callable, ins: list[str], outs: str) -> DataFrame:
    """Arrow batches through ``row``, called with the values of ``ins``; its tuples fill the added columns ``outs``.

    The columns not in ``outs`` pass unchanged; ``row`` comes from ``row()``, made once for each task.
    """
    added = pa_schema(df.sparkSession, outs)
    kept = [c for c in df.columns if c not in added.names]
    spec = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept] + [outs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = row()
        for whole in batches:
            # results outweigh their rows at times; few are held at once
            for at in range(0, max(1, whole.num_rows), ROWS):
                b = whole.slice(at, ROWS)
                got = [call(*v) for v in zip(*(b.column(c).to_pylist() for c in ins), strict=True)]
                cols = list(zip(*got, strict=True)) or [()] * len(added)
                yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [pa.array(v, f.type) for v, f in zip(cols, added, strict=True)], names=kept + added.names)
        tidy()

    return df.mapInArrow(run, spec)


def nested(columns: tuple[str, ...] | list[str]) -> Column:
    """The columns as one struct, so that whatever they are called no name clashes with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in columns]) if columns else F.struct(F.lit(None).cast("int").alias("none"))


def unnested(columns: tuple[str, ...] | list[str], own: tuple[str, ...] = (), row: str = "row") -> list[Column]:
    """The columns that nested() packed, but for those with a name that the result has of its ``own``."""
    taken = {c.lower() for c in own}
    return [F.col(row)[c].alias(c) for c in columns if c.lower() not in taken]


def free(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, th, body, row``: the id, a hash of the text that tells rows apart that share an id, the text's bytes, and all columns nested."""
    return docs.select(long_id(id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), utf8(text).alias("body"), nested(docs.columns).alias("row"))


def by_key(rows: DataFrame, decisions: DataFrame, key: tuple[str, ...] = ("id", "th")) -> DataFrame:
    """The columns of the keyed() rows that ``decisions`` (``key`` and ``n``, unique) names, each n times.

    Repeated rows are one before they are dealt out again.
    """
    d = decisions.select(*key, F.col("n").cast("int").alias("n")).where("n > 0")
    one = rows.select(*key, "row").join(d, list(key)).dropDuplicates(list(key))
    return one.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")


def pa_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))
