"""Document fingerprints from closed syncmers, and their positional likeness."""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, table

#: Code points of a k-mer and of its inner substrings; a k-mer has K - S + 1 of these.
K, S = 16, 6
#: Anchors that a short sketch keeps; op2 keeps all.
ANCHORS = 64
#: Code points that the kernel takes at a time (more only for one longer text).
CHUNK = 400_000
#: Ids sampled for each bucket to find its bounds, rows of a bucket, about, and buckets at most unless the session asks for more.
SAMPLES, ROWS, MOST = 50, 4000, 20_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 32-bit values."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def rolled(c: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of each run of n code points, or of those that start at ``at``."""
    length = len(c) - n + 1
    h = np.zeros(length if at is None else len(at), np.uint32)
    for j in range(n):
        h *= np.uint32(0x9E3779B1)
        h += c[j : j + length] if at is None else c[at + j]
    return mixed(h)


def closed(h: np.ndarray, w: int) -> np.ndarray:
    """Whether the leftmost minimum of each window of w >= 2 values is its first or its last."""
    low, width = h, 1
    while 2 * width <= w - 1:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < w - 1:
        low = np.minimum(low[: len(low) - (w - 1 - width)], low[w - 1 - width :])
    n = len(h) - w + 1
    return (h[:n] <= low[1 : n + 1]) | (h[w - 1 :] < low[:n])


def anchors(texts: list[str], most: int | None = ANCHORS) -> list[np.ndarray]:
    """For each whole text the hashes of its closed syncmers, in order of position.

    With ``most`` None that is every one of them, repeats too. Whether a k-mer is a closed syncmer
    depends on its own code points only, so an edit moves no anchor outside of the k-mers that it
    touches. With a number only so many smallest distinct hashes stay, which depend on the whole text.
    A text without one has the hash of all of it as its only anchor; an empty text has none.
    """
    out: list[np.ndarray] = []
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK or i == len(texts) - 1:
            out += _anchors(texts[lo : i + 1], most)
            lo, size = i + 1, 0
    return out


def _anchors(texts: list[str], most: int | None) -> list[np.ndarray]:
    lengths = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(lengths)
    out = [np.zeros(0, np.uint32)] * len(texts)
    if len(codes) >= K:
        at = np.flatnonzero(closed(rolled(codes, S), K - S + 1))
        doc = np.searchsorted(ends, at, "right")
        inside = at + K <= ends[doc]  # k-mers across two texts are none
        at, doc = at[inside], doc[inside]
        h = rolled(codes, K, at)
        if most is not None:
            keys = (doc.astype(np.uint64) << np.uint64(32)) | h
            ranked = np.sort(keys)
            ranked = ranked[np.append(True, ranked[1:] != ranked[:-1])] if len(ranked) else ranked
            first = np.searchsorted(ranked, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(32))
            some = np.flatnonzero(first[1:] > first[:-1])
            last = np.zeros(len(texts), np.uint64)
            last[some] = ranked[np.minimum(first[some] + most, first[some + 1]) - 1]
            keep = keys <= last[doc]
            _, one = np.unique(keys[keep], return_index=True)  # the first place of each hash in its text
            one.sort()
            doc, h = doc[keep][one], h[keep][one]
        cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
        for d in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            out[d] = h[cuts[d] : cuts[d + 1]]
    for d, t in enumerate(texts):
        if t and not len(out[d]):
            out[d] = np.frombuffer(hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest()[:4], np.uint32)
    return out


def numbered(a: np.ndarray) -> np.ndarray:
    """Each hash with the number of times that it came before, so that repeats differ."""
    order = np.argsort(a, kind="stable")
    ranked = a[order]
    starts = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    nth = np.zeros(len(a), np.uint64)
    nth[order] = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a))))
    return a.astype(np.uint64) << np.uint64(32) | nth


def likeness(a: list[int] | np.ndarray, b: list[int] | np.ndarray) -> float:
    """Share, among all the hashes of both, of those that match in the same order.

    0 to 1; 1 for two equal fingerprints, also empty ones. The matches that count are the longest
    chain whose positions rise in both; the n-th place of a hash matches its n-th place.
    """
    a, b = np.asarray(a, np.uint32), np.asarray(b, np.uint32)
    if np.array_equal(a, b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    _, at, other = np.intersect1d(numbered(a), numbered(b), assume_unique=True, return_indices=True)
    rising = other[np.argsort(at)]
    # a match with none out of order to it is in every longest chain
    n = len(rising)
    low, high = np.maximum.accumulate(rising), np.minimum.accumulate(rising[::-1])[::-1] if n else rising
    fixed = (rising == low) & (rising == high)
    tails: list[int] = []
    for i in rising[~fixed].tolist():
        p = bisect.bisect_left(tails, i)
        tails[p : p + 1] = [i]
    return (int(fixed.sum()) + len(tails)) / (len(a) + len(b) - n)


def text_of(a: np.ndarray) -> str:
    """A fingerprint as text: 8 hex digits for each anchor, in order of position."""
    return a.astype(">u4").tobytes().hex()


def compare_with_next(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likenesses.

    The edited text has the last half (rounded down) of the code points replaced by as many from
    the start of the next row's text, in order of ``key``, the first row following the last.
    Returns key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A null text is empty; a null key comes before the others; rows that repeat a key follow each
    other in the order of their packed texts; a single row is its own next; an empty table gives
    an empty table; other columns are ignored.

    Texts are shuffled once, compressed, in buckets of the key's range; the first row of each
    bucket is sent to the bucket before as well, so that no global order is needed.
    """
    spark = df.sparkSession
    ship(spark)
    ids = df.agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("least"), F.count(key).alias("known")).first()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST, ids["n"] // ROWS))
    share = buckets * SAMPLES / max(1, ids["n"])
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / (1 << 30)
    # a bounded sample of ids, whatever the size of the table
    sample = sorted(r[0] for r in df.where(F.col(key).isNotNull() & (place < share)).select(key).distinct().collect())
    starts = sample[SAMPLES::SAMPLES]
    first = None if ids["known"] < ids["n"] else ids["least"]
    bounds = np.array(starts, dtype=np.int64)
    top = len(starts)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        own = set(starts)
        for batch in batches:
            rows = []
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    z = press.compress(t or b"")
                    b = 0 if i is None else int(np.searchsorted(bounds, i, "right"))
                    rows.append((b, 0, i, z))
                    if i in own:
                        rows.append((b - 1, 1, i, z))
                    if i == first:
                        rows.append((top, 2, i, z))
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["bucket", "halo", key, "z"])
                rows = []

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, str]]:
        """(key, text, next text)."""
        unpack = zstandard.ZstdDecompressor().decompress
        held: tuple[int | None, str] | None = None
        bucket = None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for b, halo, i, z in zip(*(part.column(c).to_pylist() for c in range(4)), strict=True):
                    if b != bucket:
                        bucket, held = b, None
                    if halo and held is None:
                        continue
                    t = unpack(z).decode("utf-8", "replace")
                    if held is not None:
                        yield (*held, t)
                    held = None if halo else (i, t)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int | None, str, str]] = []
        size = 0
        for row in pairs(batches):
            rows.append(row)
            size += len(row[1])
            if size >= CHUNK:
                yield result(rows)
                rows, size = [], 0
        if rows:
            yield result(rows)

    def result(rows: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
        texts = [t for _, t, _ in rows]
        edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for _, t, n in rows]
        own = anchors(texts, None)
        # a text's next is the text after it, unless a bucket ends
        odd = {i for i, (_, _, n) in enumerate(rows) if i + 1 == len(rows) or n is not rows[i + 1][1]}
        other = dict(zip(sorted(odd), anchors([rows[i][2] for i in sorted(odd)], None), strict=True))
        new = anchors(edited, None)
        near = [likeness(a, b) for a, b in zip(own, new, strict=True)]
        following = [likeness(a, other[i] if i in odd else own[i + 1]) for i, a in enumerate(own)]
        columns = {
            key: pa.array([i for i, _, _ in rows], pa.int64()), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in edited]),
            "fingerprint": pa.array([text_of(a) for a in own]), "edited_fingerprint": pa.array([text_of(a) for a in new]),
            "near_edited": pa.array(near, pa.float64()), "near_next": pa.array(following, pa.float64()),
        }
        return pa.record_batch(list(columns.values()), list(columns))

    packed = df.selectExpr(f"cast({key} as long) as {key}", "cast(text as binary) as text").mapInArrow(pack, f"bucket int, halo int, {key} long, z binary")
    dealt = packed.repartitionById(top + 1, F.col("bucket")).sortWithinPartitions("bucket", "halo", F.col(key).asc_nulls_first(), "z")
    return dealt.mapInArrow(compare, f"{key} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def query(spark, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))
