"""The same sketches as plans of Catalyst expressions alone.

One row for each base, one exchange by the sequence's key, then running windows: a prefix
``bit_xor`` gives every s-mer's hash, a sliding ``min`` the closed condition. For rotation hashes
of 32 and 64 bits. It is the plan to compare with and to run where Python workers are unwanted;
``operators.sketch`` is several times faster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stridemark.functions.constants import ROTATE_ORDER, ROTATION, SEEDS
from stridemark.functions.dna import ordered, rotl
from stridemark.params import Params


def _seed(code: Column, bits: int, complement: bool) -> Column:
    out = F.lit(0).cast("long")
    for i in range(4):
        seed = SEEDS[i ^ 2 if complement else i]
        value = seed & 0xFFFFFFFF if bits == 32 else seed - (1 << 64) * (seed >> 63)
        out = F.when(code == i, F.lit(value).cast("long")).otherwise(out)
    return out


def smers(df: DataFrame, p: Params, keys: list[str] | None = None, seq: str = "seq") -> DataFrame:
    """Every s-mer of the sequences: keys, pos, hash, strand, and ``rank``, the hash as it is compared."""
    keys = keys or ["seq_id"]
    if p.hash != "rotate" or p.bits == 128 or p.ambiguous != "skip" or p.tie != "left":
        raise ValueError("the native plan has rotation hashes of 32 or 64 bits, left ties and skipped ambiguity")
    b, s = p.bits, p.s
    n = F.length(seq)
    bases = df.where(n >= p.k).select(*keys, n.alias("n"), F.posexplode(F.split(F.lower(seq), "")).alias("p", "c"))
    bases = bases.withColumn("p", F.col("p").cast("long")).withColumn("code", F.instr(F.lit(ROTATE_ORDER), F.col("c")) - 1)
    order = Window.partitionBy(*keys).orderBy("p")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    place = lambda x: F.pmod(x, F.lit(b)).cast("int")
    turned = bases.withColumn("f", rotl(_seed(F.col("code"), b, False), place(-ROTATION * F.col("p")), b))
    if p.canonical:
        turned = turned.withColumn("r", rotl(_seed(F.col("code"), b, True), place(ROTATION * F.col("p")), b))
    names = ["f", "r"] if p.canonical else ["f"]
    for x in names:
        turned = turned.withColumn("P" + x, F.bit_xor(x).over(run))
    turned = turned.withColumn("bad", F.sum(F.when(F.col("code") < 0, 1).otherwise(0)).over(run))
    for x in names:
        turned = turned.withColumn("L" + x, F.coalesce(F.lag("P" + x, s).over(order), F.lit(0).cast("long")))
    turned = turned.where(F.col("p") >= s - 1).withColumn("pos", F.col("p") - (s - 1))
    fw = rotl(F.col("Pf").bitwiseXOR(F.col("Lf")), place(ROTATION * F.col("p")), b)
    sort = ordered if b == 64 else lambda x: x
    out = turned.withColumn("fw", fw)
    if p.canonical:
        out = out.withColumn("rc", rotl(F.col("Pr").bitwiseXOR(F.col("Lr")), place(-ROTATION * F.col("pos")), b))
        out = out.withColumn("strand", F.when(sort(F.col("fw")) <= sort(F.col("rc")), 0).otherwise(1))
        if p.combine == "sum":
            out = out.withColumn("hash", (F.col("fw") + F.col("rc")).bitwiseAND(F.lit(0xFFFFFFFF)))
        else:
            out = out.withColumn("hash", F.when(F.col("strand") == 0, F.col("fw")).otherwise(F.col("rc")))
    else:
        out = out.withColumn("hash", F.col("fw")).withColumn("strand", F.lit(0))
    rank = sort(F.col("hash"))
    if p.approx16:
        rank = F.when(F.col("n") - p.k + 1 >= 64, F.shiftright("hash", 16)).otherwise(F.col("hash"))
    elif p.low32:
        rank = F.col("hash").bitwiseAND(F.lit(0xFFFFFFFF))
    return out.withColumn("rank", rank).select(*keys, "pos", "hash", "strand", "rank", "bad")


def syncmers(df: DataFrame, p: Params, keys: list[str] | None = None, seq: str = "seq") -> DataFrame:
    """Closed syncmers: keys, pos, strand, hash, smer_pos, at_start."""
    keys = keys or ["seq_id"]
    a = smers(df, p, keys, seq)
    order, w = Window.partitionBy(*keys).orderBy("pos"), p.w
    a = (
        a.withColumn("end", F.lead("rank", w - 1).over(order))
        .withColumn("rest", F.min("rank").over(order.rowsBetween(1, w - 1)))
        .withColumn("front", F.min("rank").over(order.rowsBetween(0, w - 2)))
        .withColumn("end_hash", F.lead("hash", w - 1).over(order))
        .withColumn("end_strand", F.lead("strand", w - 1).over(order))
        .withColumn("bad_end", F.lead("bad", w - 1).over(order))
        .withColumn("bad_start", F.coalesce(F.lag("bad", p.s).over(order), F.lit(0)))
        .withColumn("at_start", F.col("rank") <= F.col("rest"))
    )
    whole = F.col("end").isNotNull() & (F.col("at_start") | (F.col("end") < F.col("front")))
    a = a.where(whole & (F.col("bad_end") == F.col("bad_start")))
    pick = lambda x, y: F.when(F.col("at_start"), x).otherwise(y)
    return a.select(
        *keys, "pos", pick(F.col("strand"), F.col("end_strand")).cast("int").alias("strand"), pick(F.col("hash"), F.col("end_hash")).alias("hash"),
        pick(F.col("pos"), F.col("pos") + (w - 1)).alias("smer_pos"), "at_start",
    )


def counts(df: DataFrame, p: Params, keys: list[str] | None = None, seq: str = "seq") -> DataFrame:
    """Syncmers of each sequence that has any: keys, n_syncmers, n_fw, n_rc."""
    keys = keys or ["seq_id"]
    found = syncmers(df, p, keys, seq).groupBy(*keys)
    return found.agg(F.count(F.lit(1)).alias("n_syncmers"), F.count_if(F.col("strand") == 0).alias("n_fw"), F.count_if(F.col("strand") == 1).alias("n_rc"))
