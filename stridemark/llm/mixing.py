"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import NO_ID, WORD, cut

BUCKETS = 1024
#: A per-source plan of at most this many rows (about 10 MB) is broadcast; a longer one is joined by shuffle.
BROADCAST_SOURCES = 100_000
ADDED = ("mix_size", "mix_source_size", "mix_target", "mix_copies")


def word_count(text: str = "text") -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: str = "doc_id", seed: int = 17) -> Column:
    """The seeded place of a document in its source's order: 32 hex digits, the same in every run."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(NO_ID))).cast("binary"))


def plan_mix(
    sized: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2
) -> DataFrame:
    """One row per source from rows (source, size, draw): source_size, target, whole, upto.

    Water-filling: a source whose share would pass ``max_epochs`` times its size is clamped there
    and the excess goes to the others by weight. In order of cap/weight the clamped sources are a
    prefix, so one running sum finds the fixed point that repeated resharing reaches.

    ``whole`` is the number of full repetitions; documents with draw <= ``upto`` are taken once
    more. ``upto`` is found in two steps, so that no task sees a whole source: sums per hash bucket
    first, then the running sum inside the one bucket in which the target falls.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    ws = F.array(*[F.lit(w) for w in weights])
    filled = (
        by_source.withColumn("n", F.row_number().over(order))
        .withColumn("w", ws[(F.col("n") - 1) % len(weights)])
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    )
    rising = Window.orderBy(F.col("cap") / F.col("w"), "n").rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        filled.withColumn("cap_before", F.coalesce(F.sum("cap").over(rising), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(rising), F.lit(0)))
        .withColumn("clamped", F.col("cap") * F.col("w_left") <= (F.col("total") - F.col("cap_before")) * F.col("w"))
        .withColumn("cap_sum", F.sum(F.when(F.col("clamped"), F.col("cap")).otherwise(0)).over(everything))
        .withColumn("w_sum", F.sum(F.when(F.col("clamped"), 0).otherwise(F.col("w"))).over(everything))
        .withColumn(
            "target",
            F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(
                (F.col("total") - F.col("cap_sum")) / F.when(F.col("w_sum") > 0, F.col("w_sum")) * F.col("w")
            ),
        )
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))
        .select("source", "source_size", "target", "whole", "extra")
    )
    filled = cut(filled)
    # the bucket is a prefix of the draw, so that buckets follow the order of draws
    bucket = F.floor(F.conv(F.substring("draw", 1, 4), 16, 10).cast("int") * BUCKETS / 65536).cast("int").alias("bucket")
    sums = sized.groupBy("source", bucket).agg(F.sum("size").alias("size"))
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    f = filled.alias("f")
    crossing = (
        sums.withColumn("before", F.coalesce(F.sum("size").over(run), F.lit(0)))
        .alias("s")
        .join(f, F.col("s.source").eqNullSafe(F.col("f.source")))
        .where((F.col("before") < F.col("extra")) & (F.col("before") + F.col("size") >= F.col("extra")))
        .select(F.col("s.source").alias("source"), "bucket", "before", "extra")
    )
    crossing = cut(crossing)
    inside = Window.partitionBy("source").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)
    c, d = crossing.alias("c"), sized.withColumn("bucket", bucket).alias("d")
    near = (
        d.join(
            F.broadcast(c) if crossing.count() <= BROADCAST_SOURCES else c,
            F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.bucket") == F.col("c.bucket")),
        )
        .groupBy("d.source", "draw", "before", "extra")
        .agg(F.sum("size").alias("size"))
        .withColumn("mid", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / 2)
    )
    last = near.where(F.col("mid") <= F.col("extra")).groupBy("source").agg(F.max("draw").alias("upto"))
    floor = F.lpad(F.lower(F.conv((F.col("bucket") * (65536 // BUCKETS)).cast("string"), 10, 16)), 4, "0")
    ends = crossing.select("source", floor.alias("floor")).alias("c")
    last = last.alias("l")
    ends = ends.join(last, F.col("c.source").eqNullSafe(F.col("l.source")), "left").select(
        F.col("c.source").alias("source"), F.coalesce("upto", "floor").alias("upto")
    ).alias("e")
    return cut(
        f.join(ends, F.col("f.source").eqNullSafe(F.col("e.source")), "left").select(
            F.col("f.source").alias("source"), "source_size", "target", "whole", F.coalesce("upto", F.lit("")).alias("upto")
        )
    )


def mix(
    df: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2, seed: int = 17
) -> DataFrame:
    """Every document with the number of times that the mix takes it.

    Adds mix_size (words), mix_source_size, mix_target and mix_copies to the columns of ``df``,
    which needs doc_id, text and source; other columns may have any names, and those named like
    the four are replaced. A null text has size 0; a null source is one source of its own, last in
    order; rows that repeat a doc_id are drawn together. An empty table gives an empty table. Runs
    with one seed agree.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in ADDED])
    keyed = df.select(kept.alias("row"), F.col("source"), word_count().alias("size"), draw(seed=seed).alias("draw"))
    plan = plan_mix(cut(keyed.select("source", "size", "draw")), weights, share, max_epochs)
    plan = (F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan).alias("p")
    copies = F.col("whole") + F.when(F.col("draw") <= F.col("upto"), 1).otherwise(0)
    out = keyed.alias("d").join(plan, F.col("d.source").eqNullSafe(F.col("p.source")), "left")
    added = [F.col("size"), F.col("source_size"), F.col("target"), copies.cast("int")]
    return out.select("row.*", *[c.alias(n) for c, n in zip(added, ADDED, strict=True)])


def repeat(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each document as many times as it was taken, with ``columns``."""
    taken = mixed.where("mix_copies > 0").select(F.struct(*columns).alias("row"), F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    return taken.select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").cast("long").alias("source_size"),
        F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).cast("long").alias("taken"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS n FROM s),
w AS (SELECT *, CASE (n - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, source_size * 2 AS cap,
    CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS total FROM n),
r AS (SELECT *, CAST(coalesce(sum(cap) OVER up, 0) AS BIGINT) AS cap_before,
    CAST(sum(w) OVER () - coalesce(sum(w) OVER up, 0) AS BIGINT) AS w_left FROM w
  WINDOW up AS (ORDER BY CAST(cap AS DOUBLE) / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap * w_left <= (total - cap_before) * w AS clamped FROM r),
t AS (SELECT *, CAST(sum(CASE WHEN clamped THEN cap ELSE 0 END) OVER () AS BIGINT) AS cap_sum,
    CAST(sum(CASE WHEN clamped THEN 0 ELSE w END) OVER () AS BIGINT) AS w_sum FROM c),
g AS (SELECT source, source_size,
    CASE WHEN clamped THEN CAST(cap AS DOUBLE) ELSE (total - cap_sum) / CAST(nullif(w_sum, 0) AS DOUBLE) * w END AS target FROM t),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM g),
k AS (SELECT source, draw, sum(size) AS size FROM d GROUP BY source, draw),
m AS (SELECT source, draw,
    CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY draw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    + CAST(size AS DOUBLE) / 2 AS mid FROM k)
SELECT d.doc_id, d.size, p.source_size, p.target,
  CAST(d.size * (p.whole + CASE WHEN m.mid <= p.target - p.whole * p.source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
JOIN m ON d.source IS NOT DISTINCT FROM m.source AND d.draw = m.draw
"""
