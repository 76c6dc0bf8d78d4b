"""Long sequences in chunks that overlap by k - 1 bases, so that their syncmers add up exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridemark.operators import sketch
from stridemark.params import Params


def chunks(df: DataFrame, k: int, size: int = 1 << 20, seq: str = "seq") -> DataFrame:
    """A row for each chunk: ``offset`` of its first base and the chunk in ``seq``.

    Each k-mer lies in just one chunk. Sequences shorter than k, and null ones, give no row.
    """
    if size < 1:
        raise ValueError("size >= 1 is needed")
    n = F.length(seq)
    at = F.explode(F.sequence(F.lit(0), (n - F.lit(k)).cast("long"), F.lit(size).cast("long")))
    out = df.where(n >= k).withColumn("offset", at)
    return out.withColumn(seq, F.expr(f"substring(`{seq}`, cast(offset as int) + 1, {size + k - 1})"))


def chunked_syncmers(df: DataFrame, p: Params, keys: list[str] | None = None, size: int = 1 << 20, seq: str = "seq", spread: int | None = None) -> DataFrame:
    """As ``sketch.syncmers``, with the chunks of a sequence dealt out to ``spread`` tasks.

    For modes whose result doesn't depend on bases outside of the k-mer: not compat_rolling, and
    not approx16, which depends on the sequence's length.
    """
    keys = keys or ["seq_id"]
    cut = chunks(df.select(*keys, seq), p.k, size, seq)
    if spread:
        cut = cut.repartition(spread, *keys, "offset")
    return syncmers_of_chunks(cut, p, keys, seq)


def syncmers_of_chunks(cut: DataFrame, p: Params, keys: list[str] | None = None, seq: str = "seq") -> DataFrame:
    """As ``sketch.syncmers``, from chunks (keys, offset, seq) that overlap by k - 1 bases, of a table or of a file."""
    keys = keys or ["seq_id"]
    if p.ambiguous == "compat_rolling" or p.approx16 or p.skip_last:
        raise ValueError("compat_rolling, approx16 and skip_last depend on the whole sequence")
    found = sketch.syncmers(cut.select(*keys, "offset", seq), p, [*keys, "offset"], seq)
    return found.select(*keys, (F.col("pos") + F.col("offset")).alias("pos"), "strand", "hash", (F.col("smer_pos") + F.col("offset")).alias("smer_pos"), "at_start")
