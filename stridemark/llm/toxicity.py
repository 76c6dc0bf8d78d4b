"""Toxicity by maximum-scoring segments over token log-odds."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut, map_rows, table, tidy

#: Labelled documents of either label that the model is fitted on at most, about, and rows of one id.
TRAIN_PER_LABEL, ROWS_PER_ID = 2500, 8
#: Features with log-odds of their own at most: those of the highest z, and as many that correct them.
LEXICON = 20_000
#: Besides whole words, their beginnings of so many letters are features: inflected words share them.
BEGINNINGS = range(3, 9)
#: Strength of the Dirichlet prior, as a share of each label's counts, and the standard errors that log-odds shrink by.
PRIOR, ERRORS = 0.1, 3.0
#: The pooled log-odds of all tokens without evidence of their own are this at most, so that segments end.
DRIFT = -0.01
#: Word scores that a task remembers; the memo starts anew beyond this.
MEMO = 150_000
#: Tasks that the bounded sample is counted in: each holds the features of about a hundred documents.
TASKS = 48
TOKEN = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> list[str]:
    """Lower-case runs of letters of the whole text."""
    return TOKEN.findall(text.lower()) if text else []


def segments(places: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, as (first place, last place, score), in linear time: those of which every
    part scores less, and that lie in no longer one of that kind.

    ``places`` and ``scores`` are the tokens that have a score of their own; each other token
    adds ``drift``. The candidates are kept on a stack with the running totals before and after
    them. A new candidate joins the nearest one that starts lower, if that one also ends lower.
    """
    stack: list[tuple[int, int, float, float, int]] = []  # first, last, total before, total after, index of the nearest that starts lower
    total, then = 0.0, -1
    for place, score in zip(places, scores, strict=True):
        total += drift * (place - then - 1)
        then = place
        if score <= 0:
            total += score
            continue
        first, before = place, total
        total += score
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= before:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= total:
                break
            first, before = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((first, place, before, total, j))
    return [(a, b, after - before) for a, b, before, after, _ in stack]


def features(word: str) -> list[str]:
    """Features of a word, the most specific first: itself, then its beginnings, longest first, marked by a star."""
    return [word, *(f"{word[:n]}*" for n in reversed(BEGINNINGS) if n < len(word))]


class Scores(dict):
    """Log-odds of words, 0 for those without evidence of their own, with a bounded memo.

    The strongest of a word's features speaks for it, but for no more than the log-odds, whatever
    their error, of a more specific one.
    """

    def __init__(self, lexicon: dict[str, tuple[float, float]]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        score = 0.0
        for f in reversed(features(word)):
            if (known := self.lexicon.get(f)) is not None:
                shrunk, odds = known
                if abs(shrunk) > abs(score):
                    score = shrunk
                if score > odds:
                    score = max(odds, 0.0)
        if len(self) >= MEMO:
            self.clear()
        if len(word) <= 64:
            self[word] = score
        return score


@dataclass
class Model:
    """Log-odds of features (shrunk, and as they are), the extreme-value law of chance segments, and the final calibration."""

    lexicon: dict[str, tuple[float, float]]
    drift: float = DRIFT
    rate: float = 1.0  # lambda
    log_k: float = 0.0
    offset: float = -2.0
    slope: float = 1.0

    def floor(self, n: int) -> float:
        """What rate * score of a segment among n words must pass.

        By chance the best segment of n words reaches x with probability 1 - exp(-K n exp(-lambda x)).
        """
        return self.log_k + math.log(max(n, 1))

    def segments(self, text: str | None, scores: Scores) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of words, and the maximal segments of all words' log-odds."""
        got = list(map(scores.__getitem__, tokens(text)))
        places = [i for i, s in enumerate(got) if s]
        return len(got), segments(places, [got[i] for i in places], self.drift)

    def passages(self, text: str | None, scores: Scores) -> list[dict]:
        """Every significant segment: first and last word, and its evidence beyond chance, in nats."""
        n, found = self.segments(text, scores)
        floor = self.floor(n)
        return [{"first": a, "last": b, "evidence": e} for a, b, s in found if (e := self.rate * s - floor) > 0]

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.offset + self.slope * evidence))))


def cluster(text: str) -> int:
    """The smallest hash of the text's five-word shingles: near copies mostly share it."""
    words = text.encode().split()
    return min((xxhash.xxh64_intdigest(b" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))), default=0) - (1 << 63)


def fit(sample: DataFrame) -> Model:
    """A model from rows (text, toxic 0 or 1), a bounded sample as ``sampled`` draws it.

    A feature counts once for each cluster of near copies. Without both labels the model knows no
    feature and every score is low.
    """

    def mark() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.record_batch([pa.array([cluster(t) for t in batch.column(0).to_pylist()], pa.int64()), *batch.columns], ["cluster", "text", "toxic"])

        return step

    sample = sample.select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("long"))
    marked = cut(map_rows(sample, mark, "cluster long, text string, toxic long").repartition(TASKS, "cluster").sortWithinPartitions("cluster", "toxic", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = (Counter(), Counter())
        key, held = None, set()
        for batch in batches:
            for c, text, toxic in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (c, toxic) != key:
                    if key is not None:
                        totals[key[1]].update(held)
                    key, held = (c, toxic), set()
                for w in set(tokens(text)):
                    held.update(features(w))
        if key is not None:
            totals[key[1]].update(held)
            names = list(totals[0].keys() | totals[1].keys())
            for at in range(0, len(names), 100_000):
                some = names[at : at + 100_000]
                yield pa.record_batch([pa.array(some), pa.array([totals[1][f] for f in some], pa.int64()), pa.array([totals[0][f] for f in some], pa.int64())], ["feature", "y1", "y0"])

    counted = cut(marked.mapInArrow(tidy(count), "feature string, y1 long, y0 long").groupBy("feature").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0")))
    n1, n0 = (float(x or 0) for x in counted.agg(F.sum("y1"), F.sum("y0")).first())
    if not n1 or not n0:
        return Model({})
    model = Model(lexicon(counted, n1, n0))

    # two passes over the bounded sample: how often each score occurs, then the segments
    def weigh() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        scores = Scores(model.lexicon)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = Counter((y, s) for t, y in zip(*(c.to_pylist() for c in batch.columns), strict=True) for s in map(scores.__getitem__, tokens(t)))
            return pa.record_batch([pa.array([y for y, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64()), pa.array(found.values(), pa.int64())], ["toxic", "score", "n"])

        return step

    # a row for each score that the lexicon can give
    weighed = map_rows(marked.select("text", "toxic"), weigh, "toxic long, score double, n long").groupBy("toxic", "score").agg(F.sum("n").alias("n")).collect()
    law(model, [(r["toxic"], r["score"], r["n"]) for r in weighed])

    def judge() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        scores = Scores(model.lexicon)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = [model.segments(t, scores) for t in batch.column(0).to_pylist()]
            best = [model.rate * max(s for _, _, s in f) - math.log(max(n, 1)) if f else None for n, f in got]
            segments_ = pa.array([[model.rate * s for _, _, s in f if model.rate * s > 1] for _, f in got], pa.list_(pa.float64()))
            return pa.record_batch([batch.column(1), pa.array([n for n, _ in got], pa.int64()), pa.array(best, pa.float64()), segments_], ["toxic", "n", "best", "found"])

        return step

    rows = map_rows(marked.select("text", "toxic"), judge, "toxic long, n long, best double, found array<double>").collect()
    calibrate(model, [(r["toxic"], r["n"], r["best"], r["found"]) for r in rows])
    return model


def lexicon(counted: DataFrame, n1: float, n0: float) -> dict[str, tuple[float, float]]:
    """(shrunk log-odds, log-odds) of features, from rows (feature, y1, y0) of n1 and n0 counts in all.

    Each label's counts get a Dirichlet prior in the pooled proportions, and log-odds shrink towards 0
    by so many standard errors, so that those of features with little evidence vanish. A feature
    without any left counts if its log-odds are below those of one of its beginnings.
    """
    share = (F.col("y1") + F.col("y0")) / (n1 + n0)
    a1, a0 = F.col("y1") + share * (PRIOR * n1) + 0.05, F.col("y0") + share * (PRIOR * n0) + 0.05
    odds = F.log(a1 / (n1 * (1 + PRIOR) - a1)) - F.log(a0 / (n0 * (1 + PRIOR) - a0))
    rated = counted.select("feature", odds.alias("odds"), F.sqrt(1 / a1 + 1 / a0).alias("error"), (F.col("y1") + F.col("y0")).alias("y"))
    shrunk = F.signum("odds") * F.greatest(F.lit(0.0), F.abs("odds") - F.col("error") * ERRORS)
    rated = rated.withColumn("shrunk", shrunk)
    own = rated.where("shrunk <> 0").orderBy((F.abs("odds") / F.col("error")).desc(), "feature").limit(LEXICON).select("feature", "shrunk", "odds")
    out = {r["feature"]: (r["shrunk"], r["odds"]) for r in own.collect()}
    above = [(f, x) for f, (x, _) in out.items() if x > 0 and f.endswith("*")]
    if not above:
        return out
    # at most LEXICON beginnings; as an Arrow table, since tuples would start Python workers of another kind that stay
    bounds = pa.table({"beginning": pa.array([f for f, _ in above], pa.string()), "bound": pa.array([x for _, x in above], pa.float64())})
    beginnings = F.broadcast(counted.sparkSession.createDataFrame(bounds))
    word = F.rtrim(F.col("feature"), F.lit("*"))
    starts = F.array(*[F.concat(F.substring(word, 1, n), F.lit("*")) for n in BEGINNINGS])
    lower = rated.where("shrunk = 0").select("feature", "odds", "y", F.explode(starts).alias("beginning")).where("feature <> beginning")
    lower = lower.join(beginnings, "beginning").where("odds < bound").groupBy("feature").agg(F.min("odds").alias("odds"), F.max("y").alias("y"))
    return out | {r["feature"]: (0.0, r["odds"]) for r in lower.orderBy(F.col("y").desc(), "feature").limit(LEXICON).collect()}


def law(model: Model, weighed: list[tuple[int, float, int]]) -> None:
    """Sets the drift and lambda from rows (label, score, words that have it)."""
    total, rest = ({y: sum(n for x, s, n in weighed if x == y and (not none or not s)) for y in (0, 1)} for none in (False, True))
    pooled = math.log(max(rest[1], 1) / max(total[1], 1)) - math.log(max(rest[0], 1) / max(total[0], 1))
    model.drift = min(DRIFT, pooled)
    # lambda solves: the mean of exp(lambda * score) over clean words is 1; one word of the highest score is added
    top = max((x for x, _ in model.lexicon.values()), default=1.0)
    scores = np.array([s or model.drift for y, s, _ in weighed if not y] + [top or 1.0])
    counts = np.array([n for y, _, n in weighed if not y] + [1], float)
    lo, hi = 1e-6, 50.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if (counts * np.exp(np.minimum(mid * scores, 700))).sum() > counts.sum() else (mid, hi)
    model.rate = lo


def calibrate(model: Model, rows: list[tuple[int, int, float | None, list[float]]]) -> None:
    """Sets K from the clean rows (label, words, best segment beyond log words, segments), in units of lambda, and the logistic law from all."""
    best = [b for y, _, b, _ in rows if not y and b is not None]
    # the mean of a Gumbel law is its place plus Euler's constant; without enough chance segments a usual K is taken
    model.log_k = float(np.mean(best)) - 0.5772156649 if len(best) >= 30 else math.log(0.1)
    x = np.array([sum(e for s in f if (e := s - model.floor(n)) > 0) for _, n, _, f in rows])
    y = np.array([r[0] for r in rows], float)
    if len(set(y)) == 2 and x.any():
        model.offset, model.slope = logistic(x, y)
        model.offset = min(model.offset, -0.5)  # without a significant passage no text is called toxic


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 0.01) -> tuple[float, float]:
    """Offset and slope of a logistic law, by Newton's steps on balanced classes."""
    m = np.stack([np.ones_like(x), x], 1)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    b = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(m @ b, -30, 30)))
        grad = m.T @ (weight * (y - p)) - ridge * b
        step = np.linalg.solve((m * (weight * p * (1 - p) + 1e-9)[:, None]).T @ m + ridge * np.eye(2), grad)
        b = b + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(max(b[1], 1e-3))


def score(df: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of each row, score, predicted and passages, from the whole text.

    passages holds every significant segment as (first word, last word, evidence). A null or
    empty text has none and the lowest score. Repeated rows are judged each; an empty table gives
    an empty table. A column to keep can't have the name of one of the three.
    """
    made = ["score", "predicted", "passages"]
    if clash := set(keep) & set(made):
        raise ValueError(f"columns named like results can't be kept: {', '.join(sorted(clash))}")
    sent = [*keep] if "text" in keep else [*keep, "text"]  # the text goes to Python once
    at = sent.index("text")

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        scores = Scores(model.lexicon)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [model.passages(t, scores) for t in batch.column(at).to_pylist()]
            total = [model.score(sum(r["evidence"] for r in f)) for f in found]
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("evidence", pa.float64())]))
            new = [pa.array(total, pa.float64()), pa.array([int(s >= 0.5) for s in total], pa.int32()), pa.array(found, kind)]
            return pa.record_batch([*batch.columns[: len(keep)], *new], [*keep, *made])

        return step

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    return map_rows(df.select(*sent), make, f"{fields}, score double, predicted int, passages array<struct<first: int, last: int, evidence: double>>")


def sampled(docs: DataFrame, labels: DataFrame, per_label: int = TRAIN_PER_LABEL) -> DataFrame:
    """(text, toxic) of about ``per_label`` documents of either label, drawn by a hash of the id.

    Only documents whose crc32 of the id mod 5 is not 0 may be learned from. An id that many rows
    have gives about ROWS_PER_ID of its different texts.
    """
    known = labels.where((crc_mod("doc_id", 5) != 0) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    place = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1_000_000)) / 1_000_000
    share = F.when(F.col("toxic") == 1, per_label / max(1, sizes.get(1, 0))).otherwise(per_label / max(1, sizes.get(0, 0)))
    few = F.broadcast(cut(known.where(place("doc_id") < share)))  # bounded by the parameter, so it may be broadcast
    rows = F.broadcast(docs.join(few, "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")))
    found = docs.select("doc_id", "text").join(few, "doc_id").join(rows, "doc_id").where(place("doc_id", "text") * F.col("rows") < ROWS_PER_ID)
    return found.groupBy("doc_id", "toxic", F.xxhash64("text")).agg(F.first("text").alias("text")).select("text", "toxic")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(sampled(docs, table(spark, sf_dir, "labels")))
    return score(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))
