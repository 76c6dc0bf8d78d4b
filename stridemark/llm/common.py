"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs without the six ASCII white-space characters. bytes.split() and this pattern agree.
WORD = r"[^\x20\x09-\x0D]+"
#: Key for rows without an id, where an id has to be hashed.
NO_ID = ""
#: Keys that more than one row in so many has are joined by broadcast: there are at most as many of them.
HOT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch: texts are long, and the JVM and Python both hold a batch for each task.
BATCH = 2 << 20


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver found it by sys.path alone, and keep the session's Arrow batches small."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not (m := re.fullmatch(r"(\d+)b?", spark.conf.get(size))) or not 0 < int(m[1]) <= BATCH:
        spark.conf.set(size, str(BATCH))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once, in the shared checkpoint folder, and cut its lineage.

    The folder is the session's spark.checkpoint.dir. Only on a single machine may that be unset:
    a temporary folder is made there, while on a cluster, whose machines don't share one, it's an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def split_hot(counted: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """(hot, cold) keys of a table with a row count ``n`` each: of ``total`` rows, at most HOT keys can hold one in HOT."""
    return counted.where(F.col("n") * HOT >= total), counted.where(F.col("n") * HOT < total)


def join_hot(big: DataFrame, on: Callable[[], Column], hot: DataFrame, cold: DataFrame) -> DataFrame:
    """An inner join in which rows of hot keys stay where they are."""
    return big.join(F.broadcast(hot), on()).unionByName(big.join(F.broadcast(hot), on(), "left_anti").join(cold, on()))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, which gives what it freed back to the system at its end: Python workers outlive their tasks."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return tidied


def map_rows(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]],
    schema: str,
    rows: int = 256,
    mb: int = 8,
) -> DataFrame:
    """``mapInArrow`` over slices of at most ``rows`` rows and about ``mb`` MB.

    ``make`` runs once per task and returns the function for a slice, so that models and
    memos live as long as the task.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            n = batch.num_rows
            per = max(1, min(rows, int(n * mb * 1e6 / max(1, batch.nbytes))) if n else 1)
            for at in range(0, n, per):
                out = step(batch.slice(at, per))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(tidy(run), schema)


def crc_mod(col: str, n: int):
    """crc32 of the id's decimal text, mod n; ids that are null count as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(NO_ID)).cast("binary")) % n
