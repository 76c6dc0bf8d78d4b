"""Substring dedup: recurring passages, found by repeated-phrase automata."""

from __future__ import annotations

import hashlib
import marshal
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_rows, ship, table

#: Words of a window, and of the phrases of which each window's smallest is its anchor.
WINDOW, PHRASE = 13, 5
#: Anchors that a window is chosen among.
SPAN = WINDOW - PHRASE + 1
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK = 1 << 20
#: Blocks whose words fall on average to one bucket, which one task holds.
BLOCKS_A_BUCKET = 8
#: An anchor in so many blocks is hot: its windows are dealt out one by one.
HOT = 64
#: Lines that one automaton is compiled from, whatever their anchors.
SHARD = 20_000
#: Bytes of a word that are hashed in numpy; longer words are hashed one by one.
SHORT = 48
#: Stands for a null id, which is larger than any other.
NULL_ID = (1 << 63) - 1
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def pack_block(ids: list[int | None], texts: list[bytes]) -> bytes:
    """Ids and the words of each text, joined by one space, texts by a line break."""
    lines = b"\n".join([b" ".join(t.split()) for t in texts])
    return zstandard.ZstdCompressor(level=3).compress(marshal.dumps((ids, lines)))


def unpack_block(z: bytes) -> tuple[list[int | None], bytes]:
    return marshal.loads(zstandard.ZstdDecompressor().decompress(z))


class Words:
    """Where the words of lines are, in bytes and in lines, and 64-bit hashes of them."""

    def __init__(self, lines: bytes):
        text = np.frombuffer(lines, np.uint8)
        line_end = text == 0x0A
        inside = ~(line_end | (text == 0x20))
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        self.start, self.end = edge[::2], edge[1::2]
        breaks = np.flatnonzero(line_end)
        self.line = np.searchsorted(breaks, self.start)
        #: the first word of each line, and of the line after the last
        self.first = np.searchsorted(self.line, np.arange(len(breaks) + 2))
        self.hash = self._hashes(text, lines)

    def _hashes(self, text: np.ndarray, lines: bytes) -> np.ndarray:
        size = self.end - self.start
        order = np.argsort(-np.minimum(size, SHORT + 1).astype(np.int16), kind="stable")
        at, ranked = self.start[order], size[order]
        h = ranked.astype(np.uint64)
        longer = len(ranked) - np.cumsum(np.bincount(np.minimum(ranked, SHORT + 1), minlength=SHORT + 2))  # than 0, 1, ...
        for j, k in enumerate(longer[:SHORT].tolist()):
            if not k:
                break
            h[:k] *= FACTOR
            h[:k] += text[at[:k] + j]
        out = np.empty(len(h), np.uint64)
        out[order] = mixed(h)
        for i in order[: int(np.count_nonzero(size > SHORT))].tolist():
            out[i] = xxhash.xxh3_64_intdigest(lines[self.start[i] : self.end[i]])
        return out

    def runs(self, n: int) -> np.ndarray:
        """Hash of each run of n words, also of those that span lines."""
        g = np.zeros(max(0, len(self.hash) - n + 1), np.uint64)
        for j in range(n):
            g *= FACTOR
            g += self.hash[j : j + len(g)]
        return mixed(g)

    def windows(self) -> np.ndarray:
        """First words of the windows that lie in one line."""
        n = max(0, len(self.hash) - WINDOW + 1)
        return np.flatnonzero(np.arange(n) + WINDOW <= self.first[self.line[:n] + 1])


def blocks_of(df: DataFrame) -> DataFrame:
    """(block, z): the documents (doc_id, text) in compressed blocks of about BLOCK bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, size = TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        texts: list[bytes] = []

        def row() -> pa.RecordBatch:
            return pa.record_batch([pa.array([(task << 32) + n], pa.int64()), pa.array([pack_block(ids, texts)], pa.binary())], ["block", "z"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids.append(i)
                    texts.append(t or b"")
                    size += len(texts[-1]) + 16
                    if size >= BLOCK:
                        yield row()
                        ids, texts, n, size = [], [], n + 1, 0
        if ids:
            yield row()

    return df.selectExpr("cast(doc_id as long) as doc_id", "cast(text as binary) as text").mapInArrow(pack, "block long, z binary")


class Anchors:
    """The anchors of a block: of each window the leftmost smallest of its phrases, by hash.

    Two equal windows have the same anchor at the same place, so equal windows can only be found
    where their anchors meet. ``hash``, ``first`` and ``last`` describe runs of neighbouring windows
    of one anchor: its hash, and the first and last start of the windows, in words from the
    block's start. ``distinct`` are the hashes once, in order, ``low`` is an id of each and
    ``twice`` whether documents of two ids hold it already here.
    """

    def __init__(self, ids: list[int | None], words: Words):
        self.ids = np.array([NULL_ID if i is None else i for i in ids], np.int64)
        self.hash = np.zeros(0, np.uint64)
        self.first = self.last = np.zeros(0, np.int64)
        inside = words.windows()
        if len(inside):
            g = words.runs(PHRASE)
            n = len(words.hash) - WINDOW + 1
            # the lowest bits are replaced by the place, so that the minimum is the leftmost one
            low = g[:n] & ~np.uint64(15)
            for j in range(1, SPAN):
                np.minimum(low, g[j : j + n] & ~np.uint64(15) | np.uint64(j), out=low)
            at = inside + (low[inside] & np.uint64(15)).astype(np.int64)
            line = words.line[inside]
            new = np.append(True, (at[1:] != at[:-1]) | (line[1:] != line[:-1]))
            starts = np.flatnonzero(new)
            self.first, self.last = inside[starts], inside[np.append(starts[1:], len(inside)) - 1]
            self.hash = g[at[starts]]
        order = np.argsort(self.hash, kind="stable")
        ranked = self.hash[order]
        new = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, np.int64)
        self.distinct = ranked[new]
        owner = self.ids[words.line[self.first[order]]]
        self.low = np.minimum.reduceat(owner, new) if len(new) else owner
        self.twice = self.low < np.maximum.reduceat(owner, new) if len(new) else owner > 0

    def buckets(self, n: int) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket, places of its hashes among the distinct ones)."""
        yield from split(bucket_of(self.distinct, n))


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)).astype(np.int64) % n


def split(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, places that have it)."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    at = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(keys) else np.zeros(0, np.int64)
    for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(keys)], strict=False):
        yield int(ranked[lo]), order[lo:hi]


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Groups of neighbouring rows with one first column, whatever the batches."""
    key, rows = None, []
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            for row in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                if row[0] != key:
                    if rows:
                        yield key, rows
                    key, rows = row[0], []
                rows.append(row)
    if rows:
        yield key, rows


def few_bytes(x: np.ndarray) -> bytes:
    """Numbers in 4 bytes each if they fit, else in 8."""
    return x.astype("<i4" if len(x) and 0 <= x.min() and x.max() < 1 << 31 else "<i8").tobytes()


def from_few(b: bytes, n: int) -> np.ndarray:
    return np.frombuffer(b, "<i4" if len(b) == 4 * n else "<i8").astype(np.int64)


class Bucket:
    """The lines of a bucket, and for each occurrence: its line, id, block and first word in the block."""

    def __init__(self, rows: Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray, np.ndarray]]):
        known: dict[bytes, int] = {}
        parts: list[list[np.ndarray]] = [[], [], [], []]
        for block, lines, line, ids, first in rows:
            numbers = np.array([known.setdefault(x, len(known)) for x in lines], np.int64)
            for held, x in zip(parts, (numbers[line], ids, np.full(len(ids), block), first), strict=True):
                held.append(x)
        self.lines = list(known)
        self.line, self.id, self.block, self.first = (np.concatenate(x) for x in parts)


def confirmed(words: Words, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of lines that occur in documents of two ids or more: (first word, hash, smallest id, whether no other line has it).

    ``low`` and ``high`` are the smallest and largest id of the documents that hold each line.
    """
    at = words.windows()
    g = words.runs(WINDOW)[at]
    order = np.argsort(g, kind="stable")
    starts = np.flatnonzero(np.append(True, g[order][1:] != g[order][:-1])) if len(g) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(g)))
    line = words.line[at][order]
    each = lambda f, x: np.repeat(f.reduceat(x, starts), sizes) if len(x) else x
    least = np.empty(len(g), np.int64)
    take, sole = np.zeros(len(g), bool), np.zeros(len(g), bool)
    least[order] = each(np.minimum, low[line])
    take[order] = each(np.minimum, low[line]) < each(np.maximum, high[line])
    sole[order] = each(np.minimum, line) == each(np.maximum, line)
    return at[take], g[take], least[take], sole[take]


def locate_all(bucket: Bucket, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, from, to): words to remove, wherever a window occurs that a smaller id holds.

    Confirms the recurring windows of all lines. Then, for so many lines at a time, compiles the
    passages into an automaton whose letters are words: neighbouring windows that no other line
    has are one passage, the others are one each; with it goes the smallest id that holds it. Every
    line is streamed through, and what is found goes to all documents that hold the line.
    """
    words = Words(b"\n".join(bucket.lines))
    n = len(bucket.lines)
    low, high = np.full(n, NULL_ID), np.full(n, -NULL_ID)
    np.minimum.at(low, bucket.line, bucket.id)
    np.maximum.at(high, bucket.line, bucket.id)
    at, g, least, sole = confirmed(words, low, high)
    line_of = words.line[at]
    found: list[tuple[int, int, int, int]] = []
    for lo in range(0, n, shard):
        a, b = np.searchsorted(line_of, [lo, min(lo + shard, n)])
        if a == b:
            continue
        w0, w1 = int(words.first[lo]), int(words.first[min(lo + shard, n)])
        _, letter = np.unique(words.hash[w0:w1], return_inverse=True)
        letter = letter + 1 + 0x800 * (letter + 1 >= 0xD800)  # surrogates are no letters
        text = letter.astype("<u4").tobytes().decode("utf-32-le")
        automaton = ahocorasick.Automaton()
        here, own, ids, alone = at[a:b] - w0, line_of[a:b], least[a:b], sole[a:b]
        joins = alone[1:] & alone[:-1] & (here[1:] == here[:-1] + 1) & (own[1:] == own[:-1]) & (ids[1:] == ids[:-1])
        starts = np.flatnonzero(np.append(True, ~joins))
        stops = np.append(starts[1:], b - a) - 1
        once = np.zeros(b - a, bool)
        once[np.unique(g[a:b], return_index=True)[1]] = True
        once |= alone
        for s, e, i in zip(here[starts][once[starts]].tolist(), here[stops][once[starts]].tolist(), ids[starts][once[starts]].tolist(), strict=True):
            automaton.add_word(text[s : e + WINDOW], (e + WINDOW - s, i))
        automaton.make_automaton()
        firsts = (words.first[lo : lo + shard + 1] - w0).tolist()
        for k in np.unique(own).tolist():
            s, e = firsts[k - lo], firsts[k - lo + 1]
            stop, since, i = -1, 0, -1
            for end, (size, least_id) in automaton.iter(text[s:e]):
                j = end + 1 - size
                if least_id == i and since <= j <= stop:
                    stop = end + 1
                    continue
                if stop >= 0:
                    found.append((k, since, stop, i))
                since, stop, i = j, end + 1, least_id
            if stop >= 0:
                found.append((k, since, stop, i))
    hit = np.array(found, np.int64).reshape(-1, 4)
    # each hit for each document that holds its line
    order = np.argsort(bucket.line, kind="stable")
    held = np.searchsorted(bucket.line[order], np.arange(n + 1))
    count = (held[1:] - held[:-1])[hit[:, 0]]
    of = np.repeat(np.arange(len(hit)), count)
    place = order[np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(held[hit[:, 0]], count)]
    later = bucket.id[place] > hit[of, 3]
    of, place = of[later], place[later]
    return bucket.block[place], bucket.first[place] + hit[of, 1], bucket.first[place] + hit[of, 2]


def dedup(df: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each row's text without the passages that smaller ids hold.

    Words are runs without ASCII white space, unchanged; the kept ones are joined by one space.
    Windows are judged on the input. A null or empty text has no words. A null id counts as
    larger than every other id; rows that repeat an id are one document for the comparison of
    ids and get a row each. An empty table gives an empty table; other columns are ignored.

    Documents travel in compressed blocks. What is gathered by hash is combined within each
    block first, so a passage that a third of all documents hold counts once for each block; the
    windows around a phrase that many blocks hold are dealt out one by one.
    """
    return _run(df, _kept, "n_words long, n_removed long, kept string")


def _kept(n: int, kept: bytes, n_kept: int) -> tuple[int, int, str]:
    return n, n - n_kept, kept.decode("utf-8", "replace")


def _digest(n: int, kept: bytes, n_kept: int) -> tuple[int, int, str]:
    return n, n - n_kept, hashlib.sha256(kept).hexdigest()


def _run(df: DataFrame, finish: Callable, columns: str) -> DataFrame:
    spark = df.sparkSession
    ship(spark)
    blocks = cut(blocks_of(df))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks.count() // BLOCKS_A_BUCKET)

    def send() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            rows = []
            for block, z in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, lines = unpack_block(z)
                a = Anchors(ids, Words(lines))
                rows += [(b, block, a.distinct[p].tobytes(), few_bytes(a.low[p]), np.packbits(a.twice[p]).tobytes()) for b, p in a.buckets(n)]
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), *[pa.binary()] * 3), strict=True)], ["bucket", "block", "hashes", "low", "twice"]) if rows else None

        return step

    sent = map_rows(blocks, send, "bucket int, block long, hashes binary, low binary, twice binary", rows=1)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Which hashes of each block occur in documents of two ids or more, and which are hot."""
        for bucket, rows in by_key(batches):
            sizes = [len(r[2]) // 8 for r in rows]
            h = np.concatenate([np.frombuffer(r[2], np.uint64) for r in rows])
            low = np.concatenate([from_few(r[3], k) for r, k in zip(rows, sizes, strict=True)])
            here = np.concatenate([np.unpackbits(np.frombuffer(r[4], np.uint8), count=k) for r, k in zip(rows, sizes, strict=True)]).astype(bool)
            order = np.argsort(h, kind="stable")
            starts = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
            count = np.diff(np.append(starts, len(h)))
            low, here = low[order], here[order]
            twice = (np.minimum.reduceat(low, starts) < np.maximum.reduceat(low, starts)) | np.logical_or.reduceat(here, starts)
            flags = np.zeros((2, len(h)), bool)
            flags[:, order] = np.repeat(np.stack([twice, count >= HOT]), count, axis=1)
            ends = np.cumsum(sizes).tolist()
            bits = [np.packbits(flags[:, e - k : e]).tobytes() for k, e in zip(sizes, ends, strict=True)]
            yield pa.record_batch([pa.array([r[1] for r in rows], pa.int64()), pa.array([0] * len(rows), pa.int32()), pa.array([bucket] * len(rows), pa.int32()), pa.array(bits, pa.binary())], ["block", "kind", "bucket", "z"])

    shape = "block long, kind int, bucket int, z binary"
    flags = sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(confirm, shape)
    texts = blocks.select("block", F.lit(1).alias("kind"), F.lit(-1).alias("bucket"), "z")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """To each bucket the lines, the words under the windows of an anchor that recurs, and where they are."""
        press = zstandard.ZstdCompressor(level=3).compress
        for block, rows in by_key(batches):
            bits = {r[2]: r[3] for r in rows if r[1] == 0}
            ids, lines = unpack_block(next(r[3] for r in rows if r[1] == 1))
            words = Words(lines)
            a = Anchors(ids, words)
            flags = np.zeros((2, len(a.distinct)), bool)
            for b, places in a.buckets(n):
                flags[:, places] = np.unpackbits(np.frombuffer(bits[b], np.uint8), count=2 * len(places)).reshape(2, -1)
            twice, hot = flags[:, np.searchsorted(a.distinct, a.hash)]
            calm = twice & ~hot
            first, last, to = a.first[calm], a.last[calm], bucket_of(a.hash[calm], n)
            if (both := twice & hot).any():
                size = (a.last - a.first)[both] + 1
                alone = np.repeat(a.first[both] - np.cumsum(size) + size, size) + np.arange(size.sum())
                first, last = np.append(first, alone), np.append(last, alone)
                to = np.append(to, bucket_of(words.runs(WINDOW)[alone], n))
            out = []
            for b, p in split(to):
                known: dict[bytes, int] = {}
                at = zip(words.start[first[p]].tolist(), words.end[last[p] + WINDOW - 1].tolist(), strict=True)
                line = np.array([known.setdefault(lines[s:e], len(known)) for s, e in at], "<i4")
                held = (b"\n".join(known), line.tobytes(), a.ids[words.line[first[p]]].astype("<i8").tobytes(), first[p].astype("<i4").tobytes())
                out.append((b, block, press(marshal.dumps(held))))
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["bucket", "block", "z"])

    dealt = texts.unionByName(flags).repartition(n, "block").sortWithinPartitions("block", "kind")
    segments = dealt.mapInArrow(gather, "bucket int, block long, z binary")

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress

        def parts(rows: list[tuple]) -> Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
            for _, block, z in rows:
                lines, *numbers = marshal.loads(unpack(z))
                yield block, lines.split(b"\n"), *(np.frombuffer(x, k).astype(np.int64) for x, k in zip(numbers, ("<i4", "<i8", "<i4"), strict=True))

        for _, rows in by_key(batches):
            block, first, last = locate_all(Bucket(parts(rows)))
            spans = [(b, np.stack([first[p], last[p]], 1).astype("<i4").tobytes()) for b, p in split(block)]
            if spans:
                zero = pa.array([0] * len(spans), pa.int32())
                yield pa.record_batch([pa.array([b for b, _ in spans], pa.int64()), zero, zero, pa.array([s for _, s in spans], pa.binary())], ["block", "kind", "bucket", "z"])

    spans = segments.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(locate, shape)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        for _, rows in by_key(batches):
            ids, lines = unpack_block(next(r[3] for r in rows if r[1] == 1))
            texts_ = lines.split(b"\n")
            counts = [t.count(b" ") + 1 if t else 0 for t in texts_]
            covered = np.zeros(sum(counts) + 1, np.int64)
            for r in rows:
                if r[1] == 0:
                    first, last = np.frombuffer(r[3], "<i4").reshape(-1, 2).T
                    np.add.at(covered, first, 1)
                    np.add.at(covered, last, -1)
            keep = np.cumsum(covered)[:-1] == 0
            out, at = [], 0
            for i, t, k in zip(ids, texts_, counts, strict=True):
                mine = keep[at : at + k]
                at += k
                if not mine.all():
                    words = t.split(b" ")
                    t = b" ".join([words[j] for j in np.flatnonzero(mine).tolist()])
                out.append((i, *finish(k, t, int(mine.sum()))))
            for lo in range(0, len(out), 2000):
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out[lo : lo + 2000], strict=True), kinds, strict=True)], ["doc_id", *fields])

    fields = [c.split()[0] for c in columns.split(", ")]
    dealt = texts.unionByName(spans).repartition(n, "block").sortWithinPartitions("block", "kind")
    return dealt.mapInArrow(remove, f"doc_id long, {columns}")


def query(spark, sf_dir: str) -> DataFrame:
    return _run(table(spark, sf_dir, "documents").select("doc_id", "text"), _digest, "n_words long, n_removed long, kept_sha256 string")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS id,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT r, id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
s AS (SELECT r, id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13),
k AS (SELECT r, id, p, array_to_string(w[p:p + 12], ' ') AS k FROM s),
a AS (SELECT k, min(id) AS least FROM k GROUP BY k),
c AS (SELECT DISTINCT r, p + j AS p FROM k JOIN a USING (k) CROSS JOIN (SELECT unnest(range(0, 13)) AS j) WHERE least < id),
t AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM x ANTI JOIN c USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t USING (r)
"""
