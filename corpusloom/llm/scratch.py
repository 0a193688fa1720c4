"""Tables that cut lineage: written to the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import mix

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, a temporary one if driver and tasks are one process (tests); a cluster has to name one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialise(df: DataFrame, *partition_by: str) -> DataFrame:
    """Writes df to the shared folder and returns a DataFrame that reads it back.

    A lost executor then costs a reread, not a recomputation, and what is written is readable by every executor.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/corpusloom-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _written.append((spark, path))
    schema = df.schema
    for field in schema.fields:
        field.nullable = True
    out = spark.read.schema(schema).parquet(path)
    out.scratch_path = path
    return out


def shielded(docs: DataFrame, run: Callable[[DataFrame], DataFrame], own: tuple[str, ...] = ("doc_id", "text", "lang", "source", "n_chars")) -> DataFrame:
    """run(docs) while docs' columns outside `own` have neutral names, so that none clashes with a name that run uses inside; their names return afterwards."""
    names = {c: f"extra{i}" for i, c in enumerate(docs.columns) if c not in own}
    got = run(docs.select(*(F.col(f"`{c}`").alias(names.get(c, c)) for c in docs.columns)))
    back = {v: k for k, v in names.items()}
    return got.select(*(F.col(f"`{c}`").alias(back.get(c, c)) for c in got.columns))


#: A key with more than one HOT-th of the rows is hot; there are fewer than HOT such keys, whatever the size.
HOT = 1000


def skew_join(left: DataFrame, right: DataFrame, on: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """left joined (inner or left) to right on its columns `on`, when right's column n says how many of left's `total` rows have its key.

    Rows of hot keys (at most HOT keys) meet right's rows by broadcast where they are; all others are shuffled, so that no task gets a hot key.
    With how = left, rows with a null key stay where they are too. Both sides are read twice: materialise them first.
    """
    hot = right.filter(F.col(n) * HOT > total)
    some = F.lit(True)
    for c in on:
        some = some & F.col(c).isNotNull()
    keys = F.broadcast(hot.select(*on).distinct())
    by_hot = left.join(F.broadcast(hot), on)
    cold = left.filter(some).join(keys, on, "left_anti").join(right.filter(F.col(n) * HOT <= total), on, how)
    out = by_hot.unionByName(cold)
    if how == "left":
        bare = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields if f.name not in on]
        out = out.unionByName(left.filter(~some).select("*", *bare))
    return out


#: Bits of the filter that sifted() broadcasts, in words of 64.
SIFT = 1 << 23


def sifted(rows: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """rows with a column _maybe, false only for those whose columns `on` no row of wanted has: what needn't meet wanted in a join, so that whole texts aren't shuffled for nothing.

    The filter is a table of SIFT / 64 rows at most (a few megabytes), whatever wanted's size; where wanted has far more rows than bits, it lets everything through.
    """
    h = F.pmod(F.xxhash64(*on), F.lit(SIFT))
    bits = wanted.select(h.alias("_h")).groupBy(F.expr("_h div 64").alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_h % 64 as int)))").alias("_bits"))
    met = rows.withColumn("_h", h).join(F.broadcast(bits), F.expr("_h div 64") == F.col("_word"), "left")
    return met.withColumn("_maybe", F.expr("coalesce(getbit(_bits, cast(_h % 64 as int)) = 1, false)")).drop("_h", "_word", "_bits")


def bit_filter(keys: DataFrame, size: int) -> np.ndarray:
    """Packed bits (size of them, little endian in a byte) in which (mix(key) mod size) is set for the one long column of keys; built in the tasks, size / 8 bytes reach the driver."""

    def places(batches):
        for b in batches:
            yield pa.record_batch([pa.array((mix(b.column(0).to_numpy().view(np.uint64)) % np.uint64(size)).astype(np.int64) + 1)], names=["at"])

    pages = keys.mapInArrow(places, "at long").groupBy(F.bitmap_bucket_number("at").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros(size // 8, np.uint8)
    for r in pages.coalesce(8).toLocalIterator():  # a job for each part
        got = np.frombuffer(bytes(r.bits), np.uint8)
        at = (r.page - 1) * len(got)
        out[at : at + len(got)] = got[: len(out) - at]
    return out


def in_filter(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which uint64 keys may be in a bit_filter(); false positives occur, false negatives don't."""
    at = mix(keys) % np.uint64(8 * len(bits))
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


BATCH_ROWS = 2000


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS rows at most: rows carry whole texts, and Python workers hold a batch several times over."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def drop(*tables: DataFrame) -> None:
    """Deletes tables of materialise() that no later step reads."""
    for t in tables:
        path = getattr(t, "scratch_path", None)
        if path:
            _delete(t.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone
            return


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps that are over: it does so once the driver's garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()
