"""Sketch operators on DataFrames, by Arrow batches through the numpy kernel.

Each takes a DataFrame with a column of sequences and columns that name them. Rows are
independent: the operators are narrow, run at the scan's parallelism and shuffle nothing. A null
or short sequence has no s-mers and no syncmers; it is never an error.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridemark.functions import dna
from stridemark.operators import kernel
from stridemark.params import Params

#: Bases that go to the kernel at a time (more only for one longer sequence).
CHUNK = 1 << 18


def ship(df: DataFrame) -> None:
    """Let Python workers import this package when the driver found it by sys.path alone."""
    root = str(Path(__file__).resolve().parents[2])
    env = df.sparkSession.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def over_sequences(df: DataFrame, keys: list[str], seq: str, make: Callable[[list[bytes]], tuple[np.ndarray, dict[str, pa.Array]]], schema: str) -> DataFrame:
    """Rows of the keys and of what ``make`` returns for batches of sequences: (row numbers, columns)."""
    ship(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(batch.num_columns - 1)
            ends = np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in sizes]) if batch.num_rows else np.zeros(0, int)
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
                part = batch.slice(at, to - at)
                rows, columns = make([x or b"" for x in part.column(part.num_columns - 1).to_pylist()])
                if len(rows):
                    named = {k: part.column(i).take(pa.array(rows)) for i, k in enumerate(keys)} | columns
                    yield pa.record_batch(list(named.values()), list(named))
                at = to

    kinds = dict(df.dtypes)
    fields = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return df.select(*keys, F.col(seq).cast("binary").alias("sequence bytes")).mapInArrow(run, f"{fields}, {schema}")


def hash_array(p: Params, h: np.ndarray, high: np.ndarray | None) -> pa.Array:
    """32-bit hashes as they are, 64-bit ones as longs of the same bits, 128-bit ones as 16 bytes, highest first."""
    if p.bits == 128:
        wide = np.stack([high, h], 1).astype(">u8").tobytes()
        return pa.array([wide[i : i + 16] for i in range(0, len(wide), 16)], pa.binary())
    return pa.array(h.astype(np.uint64).view(np.int64) if len(h) else np.zeros(0, np.int64))


def hash_type(p: Params) -> str:
    return "binary" if p.bits == 128 else "long"


def smers(df: DataFrame, p: Params, keys: list[str] | None = None, seq: str = "seq") -> DataFrame:
    """Every s-mer: keys, pos, hash, strand. Those with ambiguous letters are dropped if these are skipped."""
    keys = keys or ["seq_id"]

    def make(seqs: list[bytes]) -> tuple[np.ndarray, dict[str, pa.Array]]:
        a = kernel.smers(seqs, p)
        if a is None:
            return np.zeros(0, np.int64), {}
        at, number, pos = a.within(np.arange(len(a.hash)), p.s)
        return number, {"pos": pa.array(pos), "hash": hash_array(p, a.hash[at], None if a.high is None else a.high[at]), "strand": pa.array(a.strand(at).astype(np.int32))}

    return over_sequences(df, keys, seq, make, f"pos long, hash {hash_type(p)}, strand int")


def syncmers(df: DataFrame, p: Params, keys: list[str] | None = None, seq: str = "seq") -> DataFrame:
    """Every closed syncmer: keys, pos, strand, hash, smer_pos, at_start, in order of position."""
    keys = keys or ["seq_id"]

    def make(seqs: list[bytes]) -> tuple[np.ndarray, dict[str, pa.Array]]:
        f = kernel.syncmers(seqs, p)
        return f.seq, {
            "pos": pa.array(f.pos), "strand": pa.array(f.strand.astype(np.int32)), "hash": hash_array(p, f.hash, f.high),
            "smer_pos": pa.array(f.smer), "at_start": pa.array(f.at_start.astype(bool)),
        }

    return over_sequences(df, keys, seq, make, f"pos long, strand int, hash {hash_type(p)}, smer_pos long, at_start boolean")


def counts(df: DataFrame, p: Params, keys: list[str] | None = None, seq: str = "seq") -> DataFrame:
    """One row for each sequence: keys, n_syncmers, n_kmers, n_fw, n_rc; zeros for null and short ones."""
    keys = keys or ["seq_id"]

    def make(seqs: list[bytes]) -> tuple[np.ndarray, dict[str, pa.Array]]:
        n, rc = kernel.counts(seqs, p)
        kmers = np.maximum(np.array([len(s) for s in seqs]) - p.k + 1, 0)
        return np.arange(len(seqs)), {"n_syncmers": pa.array(n), "n_kmers": pa.array(kmers), "n_fw": pa.array(n - rc), "n_rc": pa.array(rc)}

    return over_sequences(df, keys, seq, make, "n_syncmers long, n_kmers long, n_fw long, n_rc long")


def positions(df: DataFrame, p: Params, keys: list[str] | None = None, seq: str = "seq") -> DataFrame:
    """One row for each sequence: keys, positions array<struct<pos, strand>>; empty for null and short ones."""
    keys = keys or ["seq_id"]

    def make(seqs: list[bytes]) -> tuple[np.ndarray, dict[str, pa.Array]]:
        f = kernel.syncmers(seqs, p)
        offsets = np.searchsorted(f.seq, np.arange(len(seqs) + 1))
        both = pa.StructArray.from_arrays([pa.array(f.pos), pa.array(f.strand.astype(np.int32))], ["pos", "strand"])
        return np.arange(len(seqs)), {"positions": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), both)}

    return over_sequences(df, keys, seq, make, "positions array<struct<pos: long, strand: int>>")


def window_minima(df: DataFrame, p: Params, keys: list[str] | None = None, seq: str = "seq") -> DataFrame:
    """Of every k-mer the smallest s-mer hash: keys, pos, min_hash (32 or 64 bits)."""
    keys = keys or ["seq_id"]
    if p.bits == 128:
        raise ValueError("window minima are for 32 and 64 bits")

    def make(seqs: list[bytes]) -> tuple[np.ndarray, dict[str, pa.Array]]:
        a = kernel.smers(seqs, p)
        if a is None or len(a.hash) < p.w:
            return np.zeros(0, np.int64), {}
        low = kernel.sliding_min(a.hash, p.w)
        at, number, pos = a.within(np.arange(len(low)), p.k)
        return number, {"pos": pa.array(pos), "min_hash": hash_array(p, low[at], None)}

    return over_sequences(df, keys, seq, make, "pos long, min_hash long")


def syncmers_from_smers(df: DataFrame, w: int, keys: list[str] | None = None, bits: int = 32) -> DataFrame:
    """Closed syncmers (keys, pos) from a table of s-mers (keys, pos, hash): the window pass on its own.

    Hashes are of 32, 64 or 128 bits as ``smers`` gives them. A window counts if it has all its w
    s-mers: where some were dropped, as with ambiguous letters, there is none.
    """
    from pyspark.sql.window import Window

    keys = keys or ["seq_id"]
    if w < 2:
        raise ValueError("w >= 2 is needed")
    order = Window.partitionBy(*keys).orderBy("pos")
    ahead, behind = order.rowsBetween(1, w - 1), order.rowsBetween(0, w - 2)
    rank = dna.ordered(F.col("hash")) if bits == 64 else F.col("hash")
    found = df.select(*keys, "pos", rank.alias("rank")).select(
        *keys, "pos", "rank", F.lead("rank", w - 1).over(order).alias("end"), F.lead("pos", w - 1).over(order).alias("end_pos"),
        F.min("rank").over(ahead).alias("rest"), F.min("rank").over(behind).alias("front"),
    )
    return found.where(f"end_pos = pos + {w - 1} and (rank <= rest or end < front)").select(*keys, "pos")
