"""SQL functions: scalar and array functions over columns, and table functions for LATERAL.

A k-mer with another letter than acgt is never a syncmer, for any of them. A null sequence has none, a
null k or s gives null, or no row; an invalid pair counts 0 and fails for positions. Table functions run
row by row; over many short reads the array functions, exploded, are faster.

    register(spark)
    SELECT syncmer_count(seq, 31, 15) FROM reads
    SELECT r.seq_id, t.pos FROM reads r, LATERAL syncmers(r.seq, 31, 15) t
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from stridemark.operators import kernel
from stridemark.params import Params


def _by_parameters(seq: pd.Series, k: pd.Series, s: pd.Series) -> Iterator[tuple[np.ndarray, list[bytes], int, int]]:
    """Rows that share k and s, mostly all of a batch; those with a null k or s are left out."""
    known = k.notna() & s.notna()
    for kk, ss in pd.MultiIndex.from_arrays([k[known], s[known]]).unique():
        rows = np.flatnonzero(known & (k == kk) & (s == ss))
        yield rows, [x.encode() if isinstance(x, str) else b"" for x in seq.iloc[rows]], int(kk), int(ss)


def _count(canonical: bool):
    def count(seq: pd.Series, k: pd.Series, s: pd.Series) -> pd.Series:
        out = pd.Series(pd.NA, index=range(len(seq)), dtype="Int64")
        for rows, seqs, kk, ss in _by_parameters(seq, k, s):
            # an invalid pair counts 0
            out.iloc[rows] = kernel.counts(seqs, Params(kk, ss, canonical=canonical, approx16=True, track_strand=False))[0] if 1 <= ss < kk else 0
        return out

    return F.pandas_udf(count, LongType())


def _positions(seq: pd.Series, k: pd.Series, s: pd.Series) -> pd.Series:
    out: list = [None] * len(seq)
    for rows, seqs, kk, ss in _by_parameters(seq, k, s):
        found = kernel.syncmers(seqs, Params(kk, ss, bits=64))
        cuts = np.searchsorted(found.seq, np.arange(len(seqs) + 1))
        for i, r in enumerate(rows.tolist()):
            out[r] = found.pos[cuts[i] : cuts[i + 1]]
    return pd.Series(out, dtype=object)


def _canonical_positions(seq: pd.Series, k: pd.Series, s: pd.Series) -> pd.Series:
    out: list = [None] * len(seq)
    for rows, seqs, kk, ss in _by_parameters(seq, k, s):
        found = kernel.syncmers(seqs, Params(kk, ss, canonical=True, bits=64))
        cuts = np.searchsorted(found.seq, np.arange(len(seqs) + 1))
        for i, r in enumerate(rows.tolist()):
            part = slice(cuts[i], cuts[i + 1])
            out[r] = [{"pos": a, "strand": b} for a, b in zip(found.pos[part].tolist(), found.strand[part].tolist(), strict=True)]
    return pd.Series(out, dtype=object)


class Syncmers:
    """Table function: a row (pos, smer_pos, at_start) for each closed syncmer, by exact 64-bit hashes."""

    def eval(self, seq: str, k: int, s: int):
        if seq is not None and k is not None and s is not None:
            p = Params(k, s, bits=64)
            f = kernel.syncmers([seq.encode()], p)
            yield from zip(f.pos.tolist(), f.smer.tolist(), f.at_start.tolist(), strict=True)


class CanonicalSyncmers:
    """Table function: a row (pos, strand, smer_pos, at_start), the same on either strand but for ties."""

    def eval(self, seq: str, k: int, s: int):
        if seq is not None and k is not None and s is not None:
            p = Params(k, s, bits=64, canonical=True)
            f = kernel.syncmers([seq.encode()], p)
            yield from zip(f.pos.tolist(), f.strand.tolist(), f.smer.tolist(), f.at_start.tolist(), strict=True)


def register(spark: SparkSession) -> None:
    """Registers syncmer_count, syncmer_count_canonical, syncmer_positions, syncmer_positions_canonical, and
    the table functions syncmers and syncmers_canonical."""
    spark.udf.register("syncmer_count", _count(False))
    spark.udf.register("syncmer_count_canonical", _count(True))
    spark.udf.register("syncmer_positions", F.pandas_udf(_positions, ArrayType(LongType())))
    spark.udf.register("syncmer_positions_canonical", F.pandas_udf(_canonical_positions, "array<struct<pos: long, strand: int>>"))
    spark.udtf.register("syncmers", F.udtf(Syncmers, returnType="pos long, smer_pos long, at_start boolean"))
    spark.udtf.register("syncmers_canonical", F.udtf(CanonicalSyncmers, returnType="pos long, strand int, smer_pos long, at_start boolean"))
