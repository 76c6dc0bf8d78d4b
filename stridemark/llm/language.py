"""Language ID by hyperdimensional profiles of letter trigrams."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut, map_rows, ship, table

DIM = 512
#: Profiles are learned from about this many labelled documents of each language at most (all, if there are fewer).
TRAIN_PER_LANG = 1500
SEED = 9
#: Languages up to this number are broadcast with their sizes.
BROADCAST_LANGS = 10_000


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point its lower-case letter's; 0, the word edge, for what is no letter."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] == "L":
            out[c] = ord(chr(c).lower()[0])
    return out


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """A random vector of +1 and -1 for each letter, whatever its script: bits of a hash of letter and place."""
    words = np.arange(DIM // 64, dtype=np.uint64)
    x = (points.astype(np.uint64)[:, None] << np.uint64(8) | words) + np.uint64(SEED << 40)
    for _ in range(2):
        x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    bits = np.unpackbits(x.astype("<u8").view(np.uint8).reshape(len(points), DIM // 8), axis=1)
    return bits.astype(np.int8) * 2 - 1


def bind(v: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Vectors of trigrams: the letters' vectors, permuted by place (twice, once, not), multiplied."""
    return (np.roll(v, 2, axis=1)[a] * np.roll(v, 1, axis=1)[b] * v[c]).astype(np.float32)


def bundles(texts: list[str | None]) -> np.ndarray:
    """The sum of the trigram vectors of each whole text, as rows; zero rows for texts without letters.

    Runs of what is no letter count as one word edge, also before and after the text.
    """
    table_ = letters()
    out = np.zeros((len(texts), DIM), np.float32)
    codes = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    edge = np.zeros(1, np.uint32)
    joined = np.concatenate([x for c in codes for x in (c, edge)] or [edge])
    doc = np.repeat(np.arange(len(texts)), [len(c) + 1 for c in codes])
    x = table_[joined].astype(np.int64)
    keep = np.ones(len(x), bool)  # one edge for each run of non-letters, none across documents lost
    keep[1:] = (x[1:] != 0) | (x[:-1] != 0) | (doc[1:] != doc[:-1])
    x, doc = x[keep], doc[keep]
    if len(x) < 2 or not x.any():
        return out
    present, small = np.unique(x, return_inverse=True)
    m = len(present)
    v = letter_vectors(present)
    before = np.concatenate([[0], small[:-1]])  # number 0 is the edge, which always is present
    after = np.concatenate([small[1:], [0]])
    before[1:][doc[1:] != doc[:-1]] = 0
    tri = (before * m + small) * m + after
    tri, doc = tri[small > 0], doc[small > 0]
    if m < 128:
        seen = np.flatnonzero(np.bincount(tri, minlength=m**3))
        at = np.zeros(m**3, np.int64)
        at[seen] = np.arange(len(seen))
        column = at[tri]
    else:
        seen, column = np.unique(tri, return_inverse=True)
    for lo in range(0, len(seen), 16_384):
        some = seen[lo : lo + 16_384]
        here = (column >= lo) & (column < lo + len(some)) if len(seen) > 16_384 else slice(None)
        counts = np.bincount(doc[here] * len(some) + column[here] - lo, minlength=len(texts) * len(some)).reshape(len(texts), -1)
        out += counts.astype(np.float32) @ bind(v, some // (m * m), some // m % m, some % m)
    return out


def fit(labelled: DataFrame, per_lang: int = TRAIN_PER_LANG) -> tuple[list[str], np.ndarray]:
    """Language names and unit prototypes, from rows (doc_id, text, lang).

    Learns from a sample of about ``per_lang`` documents of each language, drawn by a hash of id
    and text: the bundle of a language is the sum of its documents' unit vectors. The prototypes have
    their common part, the mean over the languages, taken off. One row a language comes to the driver.
    """
    rows = labelled.where("lang is not null and text is not null")
    sizes = cut(rows.groupBy("lang").count())
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_LANGS else sizes
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(SEED)), F.lit(1_000_000)) / 1_000_000
    few = rows.join(sizes, "lang").where(place * F.col("count") < per_lang).select("lang", "text")
    ship(labelled.sparkSession)

    def summed(parts: Iterator[tuple[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for name, v in parts:
            sums[name] = sums.get(name, 0) + v
        for at in range(0, len(names := sorted(sums)), 1000):
            some = names[at : at + 1000]
            yield pa.record_batch([pa.array(some), pa.array([sums[n].astype("<f8").tobytes() for n in some], pa.binary())], ["lang", "part"])

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[str, np.ndarray]]:
            for batch in batches:
                for at in range(0, batch.num_rows, 128):
                    langs, texts = (c.to_pylist() for c in batch.slice(at, 128).columns)
                    v = bundles(texts).astype(np.float64)
                    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                    held = np.array(langs, dtype=object)
                    yield from ((n, v[held == n].sum(0)) for n in set(langs))

        return summed(parts())

    def of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return summed((n, np.frombuffer(p, "<f8")) for b in batches for n, p in zip(*(c.to_pylist() for c in b.columns), strict=True))

    n = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shape = "lang string, part binary"
    partial = few.repartition(n).mapInArrow(of_texts, shape)
    sums = {r["lang"]: np.frombuffer(bytes(r["part"]), "<f8") for r in partial.repartition(n, "lang").mapInArrow(of_parts, shape).collect()}
    names = sorted(sums)
    proto = np.array([sums[n] / max(np.linalg.norm(sums[n]), 1e-9) for n in names]).reshape(len(names), DIM)
    if len(names) > 1:
        proto = proto - proto.mean(0)
    return names, proto / np.maximum(np.linalg.norm(proto, axis=1, keepdims=True), 1e-9)


def predict(df: DataFrame, names: list[str], prototypes: np.ndarray, key: str = "doc_id") -> DataFrame:
    """Per row: ``key``, lang_pred, score, from the whole text alone.

    lang_pred is the language whose prototype has the largest cosine with the text's bundle, the
    first by name on ties; score is that cosine, from 0 to 1. A null text, or one without a
    letter, is ``und`` with score 0, and so is every text if nothing could be learned. Repeated
    rows are judged each; other columns are dropped.
    """
    named = np.array([*names, "und"], dtype=object)
    flat = np.ascontiguousarray(prototypes.T.astype(np.float32))

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            v = bundles(batch.column(1).to_pylist())
            norm = np.linalg.norm(v, axis=1)
            best, score = np.full(len(v), len(names)), np.zeros(len(v))
            if names:
                cos = (v @ flat) / np.maximum(norm, 1e-9)[:, None]
                some = norm > 0
                best[some] = cos.argmax(1)[some]
                score[some] = np.clip(cos.max(1)[some], 0, 1)
            return pa.record_batch([batch.column(0), pa.array(named[best].tolist(), pa.string()), pa.array(score, pa.float64())], [key, "lang_pred", "score"])

        return step

    kind = dict(df.dtypes)[key]
    return map_rows(df.select(key, "text"), make, f"{key} {kind}, lang_pred string, score double", rows=256, mb=4)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    names, proto = fit(docs.where(crc_mod("doc_id", 3) != 1).select("doc_id", "text", "lang"))
    return predict(docs, names, proto).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
