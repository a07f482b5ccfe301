"""Shared pieces: reading tables, cutting lineage, keyed checksums."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


#: Rows of texts in one Arrow batch: a batch lies in the JVM's and the worker's memory at once.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows; a lower setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it.

    Only a local session without the setting (a test) gets a folder of its own.
    """
    small_batches(spark)
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        found = sc.getConf().get("spark.checkpoint.dir")
        if found is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="footfall-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bits of a sieve: a bound that holds whatever the rows (8 MB).
SIEVE_BITS = 26


class Sieve:
    """A bitmap of 64-bit hashes: what it lets through may be in the set, what it stops is not."""

    def __init__(self, keys: DataFrame, column: str):
        place = F.pmod(F.col(column), F.lit(1 << SIEVE_BITS))
        words = keys.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(`{column}`, 64L) AS int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
        bits = np.zeros(1 << (SIEVE_BITS - 6), np.uint64)
        bits[np.asarray(words.column("w"))] = np.asarray(words.column("b")).view(np.uint64)
        self.bits = keys.sparkSession.sparkContext.broadcast(bits)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        h = hashes.view(np.uint64) & np.uint64((1 << SIEVE_BITS) - 1)
        return (self.bits.value[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) > 0

    def keep(self, batch: pa.RecordBatch, column: str, through: bool = True) -> pa.RecordBatch:
        """The rows of a batch that the sieve lets through, or those that it stops."""
        ok = self.passes(np.asarray(batch.column(batch.schema.get_field_index(column))).astype(np.int64))
        return batch.filter(pa.array(ok if through else ~ok))

    def sift(self, rows: DataFrame, column: str) -> DataFrame:
        """The rows that the sieve lets through."""
        return rows.mapInArrow(lambda batches: (self.keep(b, column) for b in batches), rows.schema)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and read on from there."""
    spark = df.sparkSession
    place = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(place)
    return spark.read.schema(df.schema).parquet(place)


def doc_crc(column: str = "doc_id"):
    """CRC-32 of the id's decimal text, the key of the fixed folds."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
