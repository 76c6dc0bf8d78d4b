"""SimHash near-dedup with pigeonring filtering."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot, map_rows, ship, split_hot, table, tidy
from .components import components

SEED = 42
#: Groups of one signature up to this size compare their pairs at once; larger ones walk from text to text.
SMALL_GROUP = 48
#: Rows of one signature that a task holds. Larger groups are cut into parts, of which every two meet.
LARGE_GROUP = 200_000
#: Rows of such a part, about.
PART = 50_000
#: Rows whose bits are counted at once.
SLICE = 8192


@dataclass(frozen=True)
class Ring:
    """How fingerprints of ``bits`` bits are cut into boxes around a ring, and what links two of them.

    Two link at ``distance`` differing bits. By the pigeonring principle there is then a box from
    which on every chain of l boxes differs in at most l * distance / boxes bits. ``budget`` takes
    the place of distance in the chains; above it, pairs pass from more boxes than one.
    ``starts`` are the boxes from which chains begin and ``chain`` the boxes that a signature covers.
    With ``probes`` None the chain's first box has to agree and one bit of the others may differ,
    so no pair is missed; else that many of a chain's least certain bits may differ.
    """

    bits: int
    shingle: int
    distance: int
    budget: int
    sizes: tuple[int, ...]
    starts: tuple[int, ...]
    chain: int
    probes: int | None = None

    @property
    def words(self) -> int:
        return self.bits // 64

    def at(self, start: int) -> int:
        return sum(self.sizes[:start])

    def ends(self, start: int) -> list[int]:
        """Ends of the chains of 1, 2, ... boxes from a start."""
        return list(accumulate(self.sizes[start:] + self.sizes[:start]))

    def first(self, start: int) -> tuple[np.uint64, int]:
        """Mask of one chain's bits in the first word, and how many may differ: that of 64 bits, or of three boxes of one word."""
        ends = self.ends(start)
        i = max(i for i, e in enumerate(ends) if e <= (64 if self.words > 1 else ends[2]))
        return np.uint64((1 << ends[i]) - 1), (i + 1) * self.budget // len(ends)

    def passes(self, diff: np.ndarray, start: int) -> np.ndarray:
        """Whether differences, turned so that the ring begins at ``start``, keep to the budget of every chain, then to the distance."""
        if len(diff) > SLICE:
            return np.concatenate([self.passes(diff[at : at + SLICE], start) for at in range(0, len(diff), SLICE)])
        ends = self.ends(start)
        allowed = [(i + 1) * self.budget // len(ends) for i in range(len(ends))]
        mask, most = self.first(start)  # one chain for all first
        some = np.flatnonzero(np.bitwise_count(diff[:, 0] & mask) <= most)
        sums = np.cumsum(np.unpackbits(np.ascontiguousarray(diff[some]).astype("<u8").view(np.uint8).reshape(len(some), self.bits // 8), axis=1, bitorder="little"), axis=1, dtype=np.int16)
        ok = (sums[:, np.array(ends) - 1] <= np.array(allowed)).all(1) & (sums[:, -1] <= self.distance)
        out = np.zeros(len(diff), bool)
        out[some[ok]] = True
        return out


#: op3's: four-word shingles, 4 of 64 bits, every link.
EXACT = Ring(64, 4, 4, 4, (13, 13, 13, 13, 12), (0, 1, 2, 3, 4), 2)
#: For texts that share 0.8 of their five-word shingles: at that likeness 38.7 of 256 bits differ on average, with a
#: standard deviation of 5.7. Signatures of 20 bits, from every fourth box on.
NEAR = Ring(256, 5, 46, 52, (4,) * 64, tuple(range(0, 64, 4)), 5, 2)


def shingle_hashes(text: bytes | None, n: int = EXACT.shingle) -> np.ndarray:
    """XXH64 (seed 42) of each n-word shingle of the whole text, A-Z lowered; fewer words are one shingle."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: max(0, len(words) - n)]]
    last = ends[min(n, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, last, strict=True)], np.uint64)


def widened(h: np.ndarray, words: int) -> np.ndarray:
    """The hashes and, for each further word, another hash made of them."""
    out = [h]
    for k in range(1, words):
        x = h + np.uint64(0x9E3779B97F4A7C15 * k & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(x ^ (x >> np.uint64(31)))
    return np.stack(out, 1)


def votes(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """For each bit how many more hashes set it than don't."""
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), 4096):
        part = np.ascontiguousarray(widened(hashes[at : at + 4096], words)).astype("<u8").view(np.uint8).reshape(-1, 8 * words)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return 2 * ones - len(hashes)


def simhash(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """Words of the fingerprint: each bit is 1 if it is set in over half the hashes; 0 for none."""
    return np.packbits(votes(hashes, words) > 0, bitorder="little").view("<u8")


def unsure(v: np.ndarray, ring: Ring) -> np.ndarray:
    """For texts' votes and each start, the places in the signature of the bits that are least certain: (texts, starts, probes)."""
    width = ring.ends(0)[ring.chain - 1]
    at = (np.array([ring.at(s) for s in ring.starts])[:, None] + np.arange(width)) % ring.bits
    return np.argsort(np.abs(v[:, at]), axis=2, kind="stable")[:, :, : ring.probes].astype(np.uint8)


def fingerprints(df: DataFrame, ring: Ring, key: str = "doc_id") -> DataFrame:
    """(key, fp, unsure) of each row: the fingerprint's words as bytes, highest first, all 0 for no words, and its least certain bits."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            v = np.array([votes(shingle_hashes(t, ring.shingle), ring.words) for t in batch.column(1).to_pylist()])
            fp = np.packbits(v > 0, axis=1, bitorder="little").reshape(len(v), -1).view("<u8").astype(">u8")
            low = [u.tobytes() for u in unsure(v, ring)] if ring.probes else [None] * len(v)
            return pa.record_batch([batch.column(0), pa.array([x.tobytes() for x in fp], pa.binary()), pa.array(low, pa.binary())], [key, "fp", "unsure"])

        return step

    kind = dict(df.dtypes)[key]
    return map_rows(df.selectExpr(key, "cast(text as binary) as text"), make, f"{key} {kind}, fp binary, unsure binary")


def turned(fp: np.ndarray, by: int) -> np.ndarray:
    """Fingerprints as rows of words, turned so that bit ``by`` comes first."""
    word, bit = divmod(by, 64)
    x = np.roll(fp, -word, axis=1)
    return (x >> np.uint64(bit)) | (np.roll(x, -1, axis=1) << np.uint64(64 - bit)) if bit else x


def signatures(ring: Ring, fp: np.ndarray, low: np.ndarray | None = None, extra: int = 0, only: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, turned fingerprints): pairs that link share a key from some start.

    ``extra`` boxes more make finer signatures, which miss no pair either if there are no probes.
    """
    for n, start in enumerate(ring.starts):
        if only is not None and n != only:
            continue
        ends = ring.ends(start)
        width = ends[ring.chain - 1 + extra]
        x = turned(fp, ring.at(start))
        own = x[:, 0] & np.uint64((1 << width) - 1)
        tag = np.uint64(n << 56)
        yield own | tag, x
        if ring.probes is None:
            if not extra:  # one bit of the boxes after the first may differ
                for bit in range(ends[0], width):
                    free = own >> np.uint64(bit) & np.uint64(1) == 0
                    yield own[free] | np.uint64(1 << bit) | tag, x[free]
            else:  # two bits may differ, one on either side
                for bit in range(ends[0], width):
                    yield own ^ np.uint64(1 << bit) | tag, x
            continue
        flips = np.uint64(1) << low[:, n, :].astype(np.uint64)
        for some in range(1, 1 << ring.probes):
            mask = np.bitwise_or.reduce([flips[:, j] for j in range(ring.probes) if some >> j & 1])
            yield own ^ mask | tag, x


def links_of(ring: Ring, keys: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of rows that link, among rows of one start sorted by key: every link in small groups, a forest of them in large ones.

    In groups of either size a pair has to keep to its chains' budgets before its bits are counted.
    """
    start = ring.starts[int(keys[0] >> np.uint64(56))]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(starts, len(keys)))
    small = np.repeat(sizes <= SMALL_GROUP, sizes)
    a, b = [], []
    for d in range(1, min(SMALL_GROUP, int(sizes.max()))):
        j = np.flatnonzero((keys[d:] == keys[:-d]) & small[d:])
        j = j[ring.passes(fp[j] ^ fp[j + d], start)]
        a.append(j)
        b.append(j + d)
    for s, n in zip(starts[sizes > SMALL_GROUP].tolist(), sizes[sizes > SMALL_GROUP].tolist(), strict=True):
        for at, new in walked(ring, fp, s + np.unique(fp[s : s + n], axis=0, return_index=True)[1], start):
            a.append(np.full(len(new), at))
            b.append(new)
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def walked(ring: Ring, fp: np.ndarray, rest: np.ndarray, start: int, side: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(place, places it links to): a forest of the links among the places ``rest``; with sides, of those between unlike sides."""
    mask, most = ring.first(start)
    heads = fp[rest, 0] & mask
    while len(rest) > 1:
        walk, rest, heads = [rest[0]], rest[1:], heads[1:]
        while walk and len(rest):
            at = walk.pop()
            near = np.flatnonzero(np.bitwise_count(heads ^ (fp[at, 0] & mask)) <= most)
            if side is not None:
                near = near[side[rest[near]] != side[at]]
            near = near[ring.passes(fp[rest[near]] ^ fp[at], start)]
            if len(near):
                new = rest[near]
                yield at, new
                walk += new.tolist()
                rest, heads = np.delete(rest, near), np.delete(heads, near)


def links(classes: DataFrame, ring: Ring) -> DataFrame:
    """(u, v): links between distinct fingerprints of (fp, unsure), enough of them to connect what is linked.

    A signature that more than LARGE_GROUP rows share links what it would link in one task: without
    probes it is dealt out again by finer ones, which miss no pair, and what is too large still, or
    has probes, is compared part by part. The work in such a group grows with the square of its
    rows unless they link to each other.
    """
    ship(classes.sparkSession)
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = LARGE_GROUP
    if ring.probes:  # no words at all are like nothing else, but texts of two shingles leave most bits 0 as well
        classes = classes.where(F.col("fp") != F.lit(bytes(ring.bits // 8)))

    def rows_of(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        fp = np.concatenate([f for _, f in parts]).astype(">u8")
        flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(ring.bits // 8), len(fp), [None, pa.py_buffer(np.ascontiguousarray(fp).tobytes())])
        return pa.record_batch([pa.array(np.concatenate([k for k, _ in parts]).view(np.int64)), flat.cast(pa.binary())], ["key", "fp"])

    def words(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, ring.words)

    def sign() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            low = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, len(ring.starts), ring.probes) if ring.probes else None
            return rows_of(list(signatures(ring, words(batch.column(0)), low)))

        return step

    def finer() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        """From rows (start, fp) of a large group."""

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            start, fp = batch.column(0).to_numpy(), words(batch.column(1))
            return rows_of([x for s in np.unique(start).tolist() for x in signatures(ring, fp[start == s], extra=1, only=s)])

        return step

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        overflowing = None
        for batch in batches:
            now = [batch.column(0).to_numpy().view(np.uint64), words(batch.column(1))]
            if overflowing is not None:
                more = int(np.searchsorted(now[0].view(np.int64), overflowing.view(np.int64), "right"))
                if more:
                    yield again(now[0][:more], now[1][:more])
                now = [x[more:] for x in now]
                if not len(now[0]):
                    continue
                overflowing = None
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            done = int(np.searchsorted(held[0].view(np.int64), held[0][-1:].view(np.int64)[0], "left"))
            if done >= 50_000:
                yield from edges(held[0][:done], held[1][:done])
                held = [x[done:] for x in held]
            if len(held[0]) - (done if done < 50_000 else 0) > most:
                if done < 50_000:
                    yield from edges(held[0][:done], held[1][:done])
                    held = [x[done:] for x in held]
                overflowing = held[0][0]
                yield again(*held)
                held = None
        if held is not None:
            yield from edges(*held)

    def again(keys: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        """Rows of a large group: the fingerprint and what they share."""
        u = [x.tobytes() for x in turned(fp, -ring.at(ring.starts[int(keys[0] >> np.uint64(56))]) % ring.bits).astype(">u8")]
        return pa.record_batch([pa.array(u, pa.binary()), pa.array([None] * len(u), pa.binary()), pa.array(keys.view(np.int64))], ["u", "v", "key"])

    def pairs(fp: np.ndarray, a: np.ndarray, b: np.ndarray, s: int) -> pa.RecordBatch:
        back = -ring.at(ring.starts[s]) % ring.bits
        both = np.unique(np.concatenate([turned(fp[x], back) for x in (a, b)], 1), axis=0).astype(">u8")
        u, v = ([x.tobytes() for x in np.ascontiguousarray(both[:, i * ring.words : (i + 1) * ring.words])] for i in (0, 1))
        return pa.record_batch([pa.array(u, pa.binary()), pa.array(v, pa.binary()), pa.array([None] * len(u), pa.int64())], ["u", "v", "key"])

    def edges(keys: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        which = keys >> np.uint64(56)
        for s in np.unique(which).tolist():
            mine = np.flatnonzero(which == s)
            if len(mine) < 2:
                continue
            a, b = links_of(ring, keys[mine], fp[mine])
            if len(a):
                yield pairs(fp[mine], a, b, s)

    def dealt(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Links (u, v), and rows (key, fp) of groups that are too large."""
        met = cut(keys.repartition(n, "key").sortWithinPartitions("key").mapInArrow(tidy(meeting), "u binary, v binary, key long"))
        return met.where("v is not null").select("u", "v"), met.where("v is null").select("key", F.col("u").alias("fp"))

    def meet_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From rows (key, one part, other part, whether of the other, fp) in order, a pair of parts at a time."""

        def forest(cell: pa.Table) -> Iterator[pa.RecordBatch]:
            s = int(cell.column(0)[0].as_py() >> 56)
            fp = turned(words(cell.column(4).combine_chunks()), ring.at(ring.starts[s]))
            side = cell.column(3).to_numpy() if cell.column(1)[0] != cell.column(2)[0] else None
            found = list(walked(ring, fp, np.arange(len(fp)), ring.starts[s], side))
            if found:
                yield pairs(fp, np.concatenate([np.full(len(new), at) for at, new in found]), np.concatenate([new for _, new in found]), s)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            cells = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            ends = [*(np.flatnonzero((cells[1:] != cells[:-1]).any(1)) + 1).tolist(), len(cells)]
            for at, end in zip([0, *ends], ends):
                if end > at:
                    some = batch.slice(at, end - at)
                    if held and any(held[-1].column(i)[0] != some.column(i)[0] for i in range(3)):
                        yield from forest(pa.Table.from_batches(held))
                        held = []
                    held.append(some)
        if held:
            yield from forest(pa.Table.from_batches(held))

    def by_parts(large: DataFrame) -> DataFrame:
        """Links in large groups, the same as if one task held them: each part meets itself and each other part of its group."""
        counted = large.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))  # a row for LARGE_GROUP rows at most
        mine = large.join(F.broadcast(counted), "key").withColumn("mine", F.pmod(F.xxhash64("fp"), "parts"))
        cells = mine.select("key", "mine", "fp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("met"))
        cells = cells.select("key", F.least("mine", "met").alias("one"), F.greatest("mine", "met").alias("other"), (F.col("mine") > F.col("met")).cast("int").alias("side"), "fp")
        return cells.repartition(n, "key", "one", "other").sortWithinPartitions("key", "one", "other").mapInArrow(tidy(meet_parts), "u binary, v binary, key long").select("u", "v")

    found, large = dealt(map_rows(classes.select("fp", "unsure"), sign, "key long, fp binary", rows=2048))
    if not large.isEmpty() and ring.probes is None:  # finer signatures miss no pair here; with probes they would
        starts = large.select(F.shiftright("key", 56).cast("int").alias("start"), "fp").distinct()
        more, large = dealt(map_rows(starts, finer, "key long, fp binary", rows=2048))
        found = found.unionByName(more)
    if not large.isEmpty():
        found = found.unionByName(by_parts(large))
    return found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def groups(df: DataFrame, ring: Ring = EXACT) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``df`` (doc_id, text; other columns are ignored).

    Fingerprints, here as their words' bytes, link at ``ring.distance`` or fewer differing bits;
    component_id is the smallest doc_id reachable, null only where every id reached is null. Texts
    without words have fingerprint 0 and link like any other. Rows that repeat an id get a row each;
    an empty table gives an empty table.

    Equal fingerprints are one class before anything is compared, so copies cost nothing. Where a
    class or a component holds much of the table, its rows aren't gathered for a join.
    """
    fps = cut(fingerprints(df.select("doc_id", "text"), ring))
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("unsure").alias("unsure"), F.count(F.lit(1)).alias("n")))
    roots = components(links(classes, ring))
    rooted = cut(classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    total = rooted.agg(F.count(F.lit(1)).alias("classes"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")).withColumnRenamed("root", "r")
    named = join_hot(rooted.withColumnRenamed("n", "rows"), lambda: F.col("root") == F.col("r"), *split_hot(ids, total["classes"]))
    named = named.select(F.col("fp").alias("k"), "component_id", F.col("rows").alias("n"))
    return join_hot(fps.drop("unsure"), lambda: F.col("fp") == F.col("k"), *split_hot(named, total["rows"])).select("doc_id", "fp", "component_id")


def one_of_each(df: DataFrame, columns: list[str], ring: Ring = NEAR) -> DataFrame:
    """One row of ``df`` for each group: that of the smallest doc_id, null ids last, then of the smallest hash.

    Rows are told apart by 128 bits of hashes of all ``columns``, so different texts that repeat an
    id, or have none, are chosen by their own groups. Equal rows become one before the shuffle;
    texts are shuffled once. Texts without words are one group.
    """
    nulls = [F.col(c).isNull() for c in columns]
    marked = df.select(*columns, F.xxhash64(*columns, *nulls).alias("row hash"), F.xxhash64(F.lit(1), *columns, *nulls).alias("second hash"))
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("doc_id"), F.col("row hash").alias("h"), F.col("second hash").alias("g"))
    fps = cut(fingerprints(marked.select(row.alias("least"), "text"), ring, "least").groupBy("fp").agg(F.min("least").alias("least"), F.min("unsure").alias("unsure")))
    roots = components(links(fps, ring))
    rooted = fps.join(roots, F.col("fp") == F.col("node"), "left")
    kept = rooted.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("least").alias("least")).select(F.col("least.h").alias("kept h"), F.col("least.g").alias("kept g"))
    held = marked.groupBy("row hash", "second hash").agg(F.first(F.struct(*columns)).alias("kept row"))
    return held.join(kept, (F.col("row hash") == F.col("kept h")) & (F.col("second hash") == F.col("kept g")), "left_semi").select("kept row.*")


def query(spark, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
