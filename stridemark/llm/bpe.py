"""BPE encoding by content-defined chunk reuse, and decoding."""

from __future__ import annotations

import hashlib
import json
import marshal
import os
import re
import struct
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, cut, join_hot, map_rows, ship, split_hot, table, tidy

#: Bytes of the rolling hash's window; a cut is made where its low bits are zero, about every 1 KB.
WINDOW, MASK = 16, np.uint32(1023)
#: Chunks are no shorter; one without a cut ends after LONGEST bytes.
SHORTEST, LONGEST = 256, 8192
#: Characters beside a join that are encoded anew at first, and what that grows by until both sides agree.
NEAR, FURTHER = 64, 4
#: Bytes of texts that are packed together for one task, and that a task holds for all of them.
PACKED, HELD = 1 << 18, 1 << 25
#: Restarts at either end of a shared chunk that travel with its ids.
ENDS = 48
RUN = re.compile(r"[^\x20\x09-\x0D]+")


def cuts(text: bytes) -> list[int]:
    """Ends of the content-defined chunks of a text."""
    n = len(text)
    if n <= SHORTEST:
        return [n] if n else []
    x = np.frombuffer(text, np.uint8).astype(np.uint32)
    h = np.zeros(n - WINDOW + 1, np.uint32)
    for j in range(WINDOW):
        h *= np.uint32(0x01000193)
        h += x[j : j + len(h)]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x9E3779B1)
    marks = np.flatnonzero((h >> np.uint32(8)) & MASK == 0) + WINDOW
    out, at = [], 0
    for m in [*marks.tolist(), n]:
        while m - at > LONGEST:
            at += LONGEST
            while at < n and text[at] & 0xC0 == 0x80:  # not inside a character
                at += 1
            out.append(at)
        while m < n and text[m] & 0xC0 == 0x80:
            m += 1
        if m - at >= SHORTEST or m == n and m > at:
            out.append(m)
            at = m
    return out


def chunks(text: bytes) -> list[bytes]:
    ends = cuts(text)
    return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def chunk_id(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


@dataclass
class Marked:
    """Ids of a text, and its restarts: the places (in characters) where the tokenizer starts a piece, with the ids before each."""

    ids: list[int]
    starts: list[int]
    counts: list[int]

    def piece(self, i: int) -> list[int]:
        return self.ids[self.counts[i] : self.counts[i + 1] if i + 1 < len(self.counts) else None]


class Encoder:
    """Ids by the tokenizers library, with a bounded memo.

    Where the library itself splits at white space and drops it, which ``at_white_space`` tries out
    on each file, the memo holds runs between white space; else whole texts go to the library. New
    runs of letters go to the library's model at once, past its slow splitting, see ``Letters``.
    """

    MEMO = 130_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokens = token_texts(path)
        self.runs = at_white_space(self.tokenizer)
        self.letters = Letters(self.tokenizer) if self.runs else None
        # two generations: what is used while the younger one fills stays
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.long: list[bytes] = []

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def looked_up(self, runs: set[bytes]) -> dict[bytes, bytes]:
        """Ids of each run; holds these runs at least."""
        if len(self.young) > self.MEMO:
            self.old, self.young = self.young, {}
        young = self.young
        new = []
        for r in runs:
            if r in young:
                continue
            if (known := self.old.get(r)) is not None:
                young[r] = known
            else:
                new.append(r)
        self.long += [r for r in new if len(r) > 64]
        rest = []
        for r in new:
            if (ids := self.letters(r.decode("utf-8", "replace"))) is None:
                rest.append(r)
            else:
                young[r] = ids
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            for r, ids in zip(some, self.library([r.decode("utf-8", "replace") for r in some]), strict=True):
                young[r] = np.array(ids, "<u4").tobytes()
        return young

    def forget(self) -> None:
        """Long runs are not worth remembering."""
        for r in self.long:
            self.young.pop(r, None)
        self.long = []

    def whole(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.runs:
            return [np.array(ids, "<u4").tobytes() for ids in self.library([t.decode("utf-8", "replace") for t in texts])]
        out = []
        at = 0
        while at < len(texts):
            split, size = [], 0
            while at < len(texts) and (not split or size < 1 << 20):
                split.append(texts[at].split())
                size += len(texts[at])
                at += 1
            memo = self.looked_up(set().union(*split))
            out += [b"".join([memo[r] for r in runs]) for runs in split]
            self.forget()
        return out

    def marked(self, text: str) -> Marked:
        if self.runs:
            found = [(m.start(), m[0].encode()) for m in RUN.finditer(text)]
            memo = self.looked_up({r for _, r in found})
            ids: list[int] = []
            starts, counts = [], []
            for at, r in found:
                if own := memo[r]:
                    starts.append(at)
                    counts.append(len(ids))
                    ids += np.frombuffer(own, "<u4").tolist()
            self.forget()
            return Marked(ids, starts, counts)
        e = self.tokenizer.encode(text, add_special_tokens=False)
        words, offsets = e.word_ids, e.offsets
        new = [i for i in range(len(words)) if i == 0 or words[i] is None or words[i] != words[i - 1]]
        return Marked(e.ids, [offsets[i][0] for i in new], new)

    def decoded(self, ids: list[int]) -> str:
        if self.tokens is None:
            return self.tokenizer.decode(ids, skip_special_tokens=False)
        return " ".join([self.tokens[i] for i in ids])


class Letters:
    """Ids of a run of letters, with punctuation after it or not, without the library's splitting.

    The library's normalizer and splitter are tried on each letter and each pair of neighbours that
    turn up: where pairs come out as their letters do, one by one and unsplit, so does the run, and
    the model gets it as one piece. Every 64th run is encoded by the library too; if one ever
    differs, the job fails rather than go on. None for other runs.
    """

    SHAPE = re.compile(r"([^\W\d_]+)([.,;:!?)]*)\Z")
    #: Letters of which all pairs are tried beforehand.
    COMMON = [chr(c) for c in (*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100))]

    def __init__(self, tokenizer):
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.one: dict[str, str] = {}
        self.table: dict[int, str] = {}
        self.fits: dict[str, bool] = {}
        self.tails: dict[str, bytes] = {"": b""}
        self.seen = 0
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.open = tokenizer.normalizer is not None and not any(self.SHAPE.match(t) for t in special)
        common = [a for a in self.COMMON if self.open and self.fit(a + a) and self.fit("a" + a)]
        common = [a for a in common if all(self.fits[a + b] if a + b in self.fits else self.fit(a + b) for b in common)]
        self.common = re.compile(rf"([{''.join(common)}]+)([.,;:!?)]*)\Z") if common else self.SHAPE

    def pieces(self, text: str) -> list[str]:
        return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))]

    def fit(self, pair: str) -> bool:
        """Whether two letters become one piece of what each becomes alone."""
        for c in pair:
            if c not in self.one:
                alone = self.pieces(c)
                self.one[c] = self.table[ord(c)] = alone[0] if len(alone) == 1 else ""
        a, b = (self.one[c] for c in pair)
        self.fits[pair] = bool(a and b) and self.pieces(pair) == [a + b]
        return self.fits[pair]

    def splits(self, pair: str) -> bool:
        """Whether punctuation after a letter is a piece of its own."""
        self.fits[pair] = self.pieces(pair) == [p for c in pair for p in self.pieces(c)] and len(self.pieces(pair)) == 2
        return self.fits[pair]

    def __call__(self, run: str) -> bytes | None:
        if not self.open:
            return None
        fits = self.fits
        if (m := self.common.match(run)) is not None:
            word, tail = m.groups()
        elif (m := self.SHAPE.match(run)) is not None:
            word, tail = m.groups()
            for pair in map(str.__add__, word, word[1:] or word):
                if not (fits[pair] if pair in fits else self.fit(pair)):
                    return None
        else:
            return None
        ids = [t.id for t in self.model.tokenize(word.translate(self.table))]
        out = struct.pack(f"<{len(ids)}I", *ids)
        if tail:
            pair = word[-1] + tail[0]
            if not (fits[pair] if pair in fits else self.splits(pair)):
                return None
            if (end := self.tails.get(tail)) is None:
                if len(self.tails) > 10_000:
                    self.tails = {"": b""}
                end = self.tails[tail] = self.by_library(tail)
            out += end
        self.seen += 1
        if self.seen % 64 == 0 and out != self.by_library(run):
            raise ValueError(f"the tokenizer does not split {run!r} as its pairs of letters")
        return out

    def by_library(self, run: str) -> bytes:
        return np.array(self.tokenizer.encode(run, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for a Python worker, whatever tasks it runs."""
    return Encoder(path)


def at_white_space(tokenizer) -> bool:
    """Whether the tokenizer drops ASCII white space and starts anew after it, by trying all pairs of printable characters."""
    letters = [chr(c) for c in range(33, 127)] + ["é", "中", "́", "'s", "'"]
    spaces = [" ", "\t", "\n", "\r", "\x0b", "\x0c", "  ", " \n"]
    if tokenizer.pre_tokenizer is None or any(t.lstrip or t.rstrip or t.single_word for t in tokenizer.get_added_tokens_decoder().values()):
        return False
    alone = [e.ids for e in tokenizer.encode_batch_fast(letters, add_special_tokens=False)]
    for i, s in enumerate(spaces):
        firsts = letters if i == 0 else letters[i::7]
        pairs = [(a, b) for a in range(len(letters)) if letters[a] in firsts for b in range(len(letters))]
        got = tokenizer.encode_batch_fast([f"{s}{letters[a]}{s}{letters[b]}{s}" for a, b in pairs], add_special_tokens=False)
        if any(e.ids != alone[a] + alone[b] for (a, b), e in zip(pairs, got, strict=True)):
            return False
    return True


@lru_cache(maxsize=2)
def token_texts(path: str) -> list[str] | None:
    """Each id's token, for a tokenizer file without a decoder: its decode() joins them by a space. None with a decoder."""
    with open(path, encoding="utf-8") as f:
        read = json.load(f)
    if read.get("decoder"):
        return None
    names = {i: t for t, i in read["model"]["vocab"].items()} | {t["id"]: t["content"] for t in read.get("added_tokens", ())}
    return [names.get(i, "") for i in range(max(names) + 1)]


def agreed(inside: Marked, whole: Marked, shift: int, all_of_it: bool) -> int | None:
    """The first place in a chunk's start at which both encodings restart and go on with the same piece.

    ``whole`` encodes what is before the chunk and its start, ``shift`` characters further on. From a
    shared restart on both go on alike, as a tokenizer reads from left to right; the last two
    pieces of a start that is cut off may still change and don't count.
    """
    for i in range(len(inside.starts) - (0 if all_of_it else 2)):
        at = inside.starts[i] + shift
        j = bisect_left(whole.starts, at)
        if j < len(whole.starts) and whole.starts[j] == at and whole.piece(j) == inside.piece(i):
            return inside.starts[i]
    return None


def repaired(segments: list[tuple[str, bytes | None]], enc: Encoder) -> list[tuple[bytes | None, list[int], int, int]] | None:
    """Parts of a text's ids: (chunk, (), from, to) for a shared chunk's, (None, ids, 0, 0) for what is between.

    ``segments`` are the text's parts in order, with the id of those that are shared chunks. A
    chunk's own encoding is wrong at its ends, as the rolling hash cuts anywhere. What is between
    two chunks is encoded together with the end of the one and the start of the next, more and
    more of it, until the encodings agree at a restart inside of the chunk; from there on its own
    ids hold. A chunk that never agrees is encoded with what is around it. From and to are
    characters of the chunk; None if a chunk's end doesn't agree.
    """
    out: list[tuple[bytes | None, list[int], int, int]] = []
    lead, skip, gap = "", 0, ""
    for text, chunk in segments:
        if chunk is None:
            gap += text
            continue
        size, start, joined = NEAR, None, None
        while start is None:
            joined = enc.marked(lead + gap + text[:size])
            start = agreed(enc.marked(text[:size]), joined, len(lead) + len(gap), size >= len(text))
            if size >= len(text):
                break
            size *= FURTHER
        size, end = NEAR, None
        while start is not None and end is None:
            last = enc.marked(text[-size:]).starts
            # neither the first, which the cut may have made, nor the last ones, which the text after may change
            if len(last) >= 6:
                end = len(text) - min(size, len(text)) + last[-4]
                last = last[1] + max(0, len(text) - size)
            elif size >= len(text):
                break
            else:
                size *= FURTHER
        if start is None or end is None or last <= start or end <= start:
            gap += text
            continue
        if (ids := between(joined, skip, len(lead) + len(gap) + start)) is None:
            return None
        out += [(None, ids, 0, 0), (chunk, [], start, end)]
        lead, gap = text[last:], ""
        skip = end - last
    ids = between(enc.marked(lead + gap), skip, None)
    return None if ids is None else [*out, (None, ids, 0, 0)]


def between(m: Marked, a: int, b: int | None) -> list[int] | None:
    """Ids from one restart to another (0 and None: from the start, to the end); None where there is none."""
    places = dict(zip(m.starts, m.counts, strict=True))
    lo = 0 if a == 0 else places.get(a)
    hi = len(m.ids) if b is None else places.get(b)
    return None if lo is None or hi is None or hi < lo else m.ids[lo:hi]


class Output:
    """The columns of a row from ids that come in parts: digests, or the ids and the text that they decode to."""

    def __init__(self, enc: Encoder, real: bool):
        self.enc, self.real, self.parts = enc, real, []

    def add(self, ids: bytes) -> None:
        self.parts.append(ids)

    def row(self) -> tuple:
        return finished(b"".join(self.parts), self.enc, self.real)


def finished(ids: bytes, enc: Encoder, real: bool) -> tuple:
    text = enc.decoded(np.frombuffer(ids, "<u4").tolist())
    if real:
        return len(ids) // 4, ids, text
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def columns_of(real: bool) -> tuple[list[str], str, list[pa.DataType]]:
    names = ["n_tokens", "ids", "decoded"] if real else ["n_tokens", "ids_sha256", "decoded_sha256"]
    kinds = ["long", "binary" if real else "string", "string"]
    return names, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)), [pa.int64(), pa.binary() if real else pa.string(), pa.string()]


def encode(df: DataFrame, path: str, real: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of ``df`` (doc_id, text); with ``real``
    (doc_id, n_tokens, ids, decoded): little-endian unsigned 32-bit ids, and the text that they decode to.

    Ids are those of the tokenizers library for the whole text without special tokens added, the
    decoded text that of its decode() with special tokens kept, for any tokenizer file that reads
    from left to right. A null text is empty; rows that repeat an id get a row each; an empty table
    gives an empty table; other columns are ignored.

    Each distinct text is encoded once, and so is each chunk that several texts share, by the text
    of the smallest key that holds it. The others take the ids from there and repair the joins. A
    text whose joins can't be made to agree is encoded whole.
    """
    spark = df.sparkSession
    ship(spark)
    rows = df.selectExpr("doc_id", "cast(coalesce(text, '') as binary) as text")
    kind = dict(df.dtypes)["doc_id"]
    rid = F.coalesce(F.col("doc_id").cast("string"), F.lit(NO_ID))
    names, shape, kinds = columns_of(real)

    def look() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            # a text that is one chunk shares it only as a whole
            held = [list({chunk_id(c) for c in cs if len(c) >= SHORTEST}) if len(cs := chunks(t)) > 1 else [] for t in texts]
            return pa.record_batch([batch.column(0), pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary()), pa.array(held, pa.list_(pa.binary()))], ["doc_id", "key", "chunks"])

        return step

    seen = cut(map_rows(rows, look, f"doc_id {kind}, key binary, chunks array<binary>"))
    # one row of each distinct text stands for it
    texts = cut(seen.groupBy("key").agg(F.min(rid).alias("owner_id"), F.count(F.lit(1)).alias("n"), F.first("chunks").alias("chunks")))
    sizes = texts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.size("chunks")), F.lit(0)).alias("held")).first()
    held = texts.select("key", F.explode("chunks").alias("chunk"))
    shared = cut(held.groupBy("chunk").agg(F.min("key").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    hot, cold = split_hot(shared.withColumnRenamed("chunk", "c"), sizes["held"])
    known = join_hot(held, lambda: F.col("chunk") == F.col("c"), hot, cold).groupBy("key").agg(F.collect_list(F.struct("chunk", "owner")).alias("shared"))
    known = texts.select("key", "owner_id").join(known, "key", "left").select(F.col("key").alias("k"), "owner_id", "shared")

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # by key and id, so that the copies of one text don't meet in one task
    known = known.withColumn("task", (F.xxhash64(F.concat("k", F.col("owner_id").cast("binary"))).bitwiseAND(F.lit(0x7FFFFFFF)) % n).cast("int"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (task, z) of many texts, with their keys and ids, for each task that they are dealt to."""
        press = zstandard.ZstdCompressor(level=3).compress
        held: dict[int, list[tuple[bytes, bytes, bytes]]] = {}
        sizes: dict[int, int] = {}

        def packed(tasks: list[int]) -> pa.RecordBatch:
            z = [press(marshal.dumps(held.pop(t))) for t in tasks]
            for t in tasks:
                del sizes[t]
            return pa.record_batch([pa.array(tasks, pa.int32()), pa.array(z, pa.binary())], ["task", "z"])

        total = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for i, t in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    key = xxhash.xxh3_128_digest(t)
                    to = (xxhash.xxh64_intdigest(key + i, 42) & 0x7FFFFFFF) % n
                    held.setdefault(to, []).append((key, i, t))
                    sizes[to] = sizes.get(to, 0) + len(t) + 64
                    total += len(t) + 64
                    if sizes[to] >= PACKED:
                        total -= sizes[to]
                        yield packed([to])
                    elif total >= HELD:
                        total = 0
                        yield packed(list(held))
        if held:
            yield packed(list(held))

    packed = rows.select(rid.cast("binary").alias("rid"), "text").mapInArrow(tidy(pack), "task int, z binary")

    def of_owners(wanted: DataFrame, make: Callable[[], Callable[[list[tuple]], pa.RecordBatch | None]], shape: str) -> DataFrame:
        """What ``make`` returns for lists of (key, text, shared) of the rows of ``wanted``, once each."""
        asked = wanted.select("task", F.lit(0).alias("kind"), "k", F.col("owner_id").cast("binary").alias("rid"), "shared", F.lit(None).cast("binary").alias("z"))
        texts_ = packed.select("task", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("k"), F.lit(None).cast("binary").alias("rid"), F.lit(None).cast(dict(wanted.dtypes)["shared"]).alias("shared"), "z")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step, unpack = make(), zstandard.ZstdDecompressor().decompress
            asked: dict[tuple[bytes, bytes], list | None] = {}
            for batch in batches:
                kinds = batch.column(1).to_pylist()
                k, i, shared_, z = (batch.column(c) for c in (2, 3, 4, 5))
                for at in range(batch.num_rows):
                    if kinds[at] == 0:
                        asked[k[at].as_py(), i[at].as_py()] = shared_[at].as_py()
                        continue
                    todo = [(key, t, asked.pop((key, own))) for key, own, t in marshal.loads(unpack(z[at].as_py())) if (key, own) in asked]
                    if todo and (out := step(todo)) is not None:
                        yield out

        return asked.unionByName(texts_).repartitionById(n, F.col("task")).sortWithinPartitions("task", "kind").mapInArrow(tidy(run), shape)

    part = "array<struct<chunk: binary, ids: binary, from: int, to: int>>"
    fields = f"kind int, key binary, {shape}, ids_of binary, starts binary, counts binary, parts {part}"
    part_type = pa.list_(pa.struct([("chunk", pa.binary()), ("ids", pa.binary()), ("from", pa.int32()), ("to", pa.int32())]))
    made_type = pa.schema([("kind", pa.int32()), ("key", pa.binary()), *zip(names, kinds, strict=True), ("ids_of", pa.binary()), ("starts", pa.binary()), ("counts", pa.binary()), ("parts", part_type)])
    pressed = lambda x: np.array(x, "<u4").tobytes()

    def work() -> Callable[[list[tuple]], pa.RecordBatch | None]:
        enc = encoder(path)

        def step(todo: list[tuple]) -> pa.RecordBatch | None:
            out: list[tuple] = []
            plain: list[tuple[bytes, bytes]] = []
            for key, text, shared_ in todo:
                owners = {r["chunk"]: r["owner"] for r in shared_ or ()}
                plan = None
                if owners:
                    segments = [(c.decode("utf-8", "replace"), i if (i := chunk_id(c)) in owners else None) for c in chunks(text)]
                    for own in {i: t for t, i in segments if i is not None and owners[i] == key}.items():
                        m = enc.marked(own[1])
                        if len(m.starts) > 2 * ENDS:
                            m = Marked(m.ids, m.starts[:ENDS] + m.starts[-ENDS:], m.counts[:ENDS] + m.counts[-ENDS:])
                        out.append((1, own[0], None, None, None, pressed(m.ids), pressed(m.starts), pressed(m.counts), None))
                    plan = repaired(segments, enc) if any(owners.get(i, key) != key for _, i in segments) else None
                if plan is None:
                    plain.append((key, text))
                else:
                    parts = [{"chunk": c, "ids": pressed(ids), "from": a, "to": b} for c, ids, a, b in plan if c is not None or ids]
                    out.append((2, key, *[None] * 6, parts))
            out += [(0, key, *finished(got, enc, real), *[None] * 4) for (key, _), got in zip(plain, enc.whole([t for _, t in plain]), strict=True)]
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), made_type, strict=True)], schema=made_type) if out else None

        return step

    made = cut(of_owners(known, work, fields))
    published = made.where("kind = 1").select(F.col("key").alias("chunk"), F.col("ids_of").alias("ids"), "starts", "counts")
    published = published.join(shared.select("chunk", "n"), "chunk").withColumnRenamed("chunk", "c")
    waiting = made.where("kind = 2").select("key", F.posexplode("parts").alias("place", "part")).select("key", "place", "part.*")
    hot, cold = split_hot(published, sizes["held"])
    wanted = waiting.where("chunk is not null").drop("ids")
    filled = join_hot(wanted, lambda: F.col("chunk") == F.col("c"), hot, cold).select("key", "place", "from", "to", "ids", "starts", "counts")
    own = waiting.where("chunk is null").select("key", "place", "from", "to", "ids", F.lit(None).cast("binary").alias("starts"), F.lit(None).cast("binary").alias("counts"))
    filled = filled.unionByName(own).repartition(n, "key").sortWithinPartitions("key", "place")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        at, output, right, out = None, None, True, []

        def rows_out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.binary(), *kinds), strict=True)], ["key", *names])

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                for key, _, a, b, ids, starts, counts in zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns), strict=True):
                    if key != at:
                        if output is not None:
                            out.append((at, *(output.row() if right else [None] * 3)))
                        at, output, right = key, Output(enc, real), True
                    if starts is not None:
                        places = dict(zip(np.frombuffer(starts, "<u4").tolist(), np.frombuffer(counts, "<u4").tolist(), strict=True))
                        if a not in places or b not in places:
                            right = False  # the owner's encoding doesn't restart there
                            continue
                        ids = ids[4 * places[a] : 4 * places[b]]
                    output.add(ids)
                if len(out) >= 500:
                    yield rows_out()
                    out = []
        if output is not None:
            out.append((at, *(output.row() if right else [None] * 3)))
            yield rows_out()

    late = cut(filled.mapInArrow(tidy(finish), f"key binary, {shape}"))
    done = made.where("kind = 0").select("key", *names).unionByName(late.where("n_tokens is not null"))
    failed = late.where("n_tokens is null").select("key")
    if not failed.isEmpty():

        def again() -> Callable[[list[tuple]], pa.RecordBatch]:
            enc = encoder(path)

            def step(todo: list[tuple]) -> pa.RecordBatch:
                out = zip(*[finished(x, enc, real) for x in enc.whole([t for _, t, _ in todo])], strict=True)
                return pa.record_batch([pa.array([k for k, _, _ in todo], pa.binary()), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], ["key", *names])

            return step

        wanted = known.join(failed.withColumnRenamed("key", "k"), "k", "left_semi")
        done = done.unionByName(of_owners(wanted, again, f"key binary, {shape}"))
    done = done.join(texts.select("key", "n"), "key").withColumnRenamed("key", "k")
    hot, cold = split_hot(done, sizes["rows"])
    return join_hot(seen.select("doc_id", "key"), lambda: F.col("key") == F.col("k"), hot, cold).select("doc_id", *names)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
