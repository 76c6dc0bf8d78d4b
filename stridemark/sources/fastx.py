"""FASTA and FASTQ readers, and the sinks for benchmark tables.

All reading goes through Spark's own text source, so any file system, glob and codec that Spark
reads will do, and plain files are split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stridemark.operators.sketch import ship


FASTA = "ordinal struct<file: string, block: long, record: int>, seq_id string, description string, seq string"
ORDINAL = pa.struct([("file", pa.string()), ("block", pa.int64()), ("record", pa.int32())])


def _blocks(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Lines of files, as bytes, with the file and the start of the split that they are read in; rows of a split come in order."""
    text = spark.read.text(path, **options)
    return text.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _kept(letters: str) -> tuple[bytes, bytes]:
    """Tables for bytes.translate: lower case, and what is dropped."""
    low = bytes(range(256)).lower()
    return low, bytes(c for c in range(256) if bytes([c]).lower() not in [x.encode() for x in letters.lower()])


def _header(line: bytes) -> tuple[str, str]:
    seq_id, *rest = line.decode("utf-8", "replace").split(None, 1) or [""]
    return seq_id, rest[0].strip() if rest else ""


def read_fasta(spark: SparkSession, path: str, letters: str = "acgtn", compat_fasta: bool = False) -> DataFrame:
    """(ordinal, seq_id, description, seq): a row for each record, lower-case, with other letters dropped.

    seq_id is the header's first word, description what follows it; ordinal sorts records by file and
    place. ``compat_fasta`` drops the first letter of each line of a record after its first, as one
    older reader does. A record is one row and must fit in one; ``read_fasta_chunks`` is for
    chromosomes. Text before the first ``>`` of a file is ignored. Any codec that Spark reads will do.
    """
    low, drop = _kept(letters)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh, n = None, 0
        for batch in batches:
            out = []
            for value, file, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, block) != fresh:
                    fresh, n = (file, block), 0
                    if block == 0:  # only there may a record's mark be left, or missing
                        if not value.startswith(b">"):
                            continue
                        value = value[1:]
                header, _, body = value.replace(b"\r", b"").partition(b"\n")
                if compat_fasta:
                    first, *rest = body.rstrip().split(b"\n")
                    body = first + b"".join([x[1:] for x in rest])
                out.append(({"file": file, "block": block, "record": n}, *_header(header), body.translate(low, drop).decode()))
                n += 1
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (ORDINAL, *[pa.string()] * 3), strict=True)], ["ordinal", "seq_id", "description", "seq"])

    text = _blocks(spark, path, lineSep="\n>")
    ship(text)
    return text.mapInArrow(parse, FASTA)


def read_fasta_chunks(spark: SparkSession, path: str, k: int, size: int = 1 << 20, letters: str = "acgtn") -> DataFrame:
    """(ordinal, seq_id, description, offset, seq): records of any length in chunks of ``size`` bases that overlap by k - 1.

    Each k-mer of a record lies in just one chunk; records shorter than k give none. Files are read
    line by line, so that a chromosome is dealt out to as many tasks as its file has splits and no
    row holds more than a chunk (or a line). What a split has to know of the others, how many bases of
    a record went before and the k - 1 that follow, goes through the driver: one small row a split.
    """
    low, drop = _kept(letters)
    if k < 2 or size < 1:
        raise ValueError("k >= 2 and size >= 1 are needed")
    lines = _blocks(spark, path)
    ship(lines)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes | None, bytes]]:
        """(file, block, record in the block, header or None, bases): record 0 is what goes on from the block before."""
        fresh, n = None, 0
        for batch in batches:
            for value, file, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, block) != fresh:
                    fresh, n = (file, block), 0
                    yield file, block, 0, None, b""
                if value.startswith(b">"):
                    n += 1
                    yield file, block, n, value[1:], b""
                else:
                    yield file, block, n, None, value.translate(low, drop)

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each split: its first k - 1 bases before a header, how many there are, its last header and the bases after it."""
        rows: dict[tuple[str, int], list] = {}
        for file, block, n, header, bases in walk(batches):
            row = rows.setdefault((file, block), [b"", 0, None, 0, 0])
            if header is not None:
                row[2:] = [header, 0, n]
            elif n:
                row[3] += len(bases)
            else:
                row[0], row[1] = (row[0] + bases)[: k - 1], row[1] + len(bases)
        if rows:
            columns = zip(*((*key, *row) for key, row in rows.items()), strict=True)
            kinds = (pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int32())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["file", "block", "lead", "n_lead", "header", "n_last", "n_headers"])

    blocks = lines.mapInArrow(outline, "file string, block long, lead binary, n_lead long, header binary, n_last long, n_headers int").collect()
    blocks.sort(key=lambda r: (r["file"], r["block"]))  # one small row a split
    before: dict[tuple[str, int], tuple] = {}  # what record a split goes on with: ordinal, header, bases before
    after: dict[tuple[str, int], bytes] = {}
    open_ = None
    for i, r in enumerate(blocks):
        if open_ is not None and open_[0][0] != r["file"]:
            open_ = None
        before[r["file"], r["block"]] = open_
        if r["header"] is not None:
            open_ = ((r["file"], r["block"], r["n_headers"]), bytes(r["header"]), r["n_last"])
        elif open_ is not None:
            open_ = (open_[0], open_[1], open_[2] + r["n_lead"])
        tail = b""
        for other in blocks[i + 1 :]:
            if other["file"] != r["file"] or len(tail) >= k - 1:
                break
            tail += bytes(other["lead"])
            if other["header"] is not None:
                break
        after[r["file"], r["block"]] = tail[: k - 1]
    known = spark.sparkContext.broadcast((before, after))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, after = known.value
        kinds = (ORDINAL, pa.string(), pa.string(), pa.int64(), pa.string())
        at, header, offset, held, out, place = None, None, 0, bytearray(), [], None

        def chunks(end: bool) -> Iterator[tuple]:
            nonlocal offset
            least = k if end else size + k - 1
            while header is not None and len(held) >= least:
                yield {"file": at[0], "block": at[1], "record": at[2]}, *_header(header), offset, bytes(held[: size + k - 1]).decode()
                del held[:size]
                offset += size

        def flushed() -> pa.RecordBatch:
            batch = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["ordinal", "seq_id", "description", "offset", "seq"])
            out.clear()
            return batch

        for file, block, n, head, bases in walk(batches):
            if (file, block) != place:
                if place is not None:  # the block's last record may go on in the next one
                    held += after[place]
                    out += chunks(True)
                place, held[:] = (file, block), b""
                at, header, offset = before[place] or (None, None, 0)
                continue
            if head is not None:
                out += chunks(True)
                at, header, offset, held[:] = (file, block, n), head, 0, b""
            elif header is not None:
                held += bases
                out += chunks(False)
            if len(out) >= 64 or sum(len(x[4]) for x in out) > 1 << 23:
                yield flushed()
        if place is not None:
            held += after[place]
            out += chunks(True)
        if out:
            yield flushed()

    return lines.mapInArrow(cut, "ordinal struct<file: string, block: long, record: int>, seq_id string, description string, offset long, seq string")


def concatenated(df: DataFrame, order: str = "ordinal", seq: str = "seq") -> DataFrame:
    """All sequences in one row, in the order of a column: k-mers then also span two of them.

    For small inputs only: one row holds everything. Not used by any reader.
    """
    return df.groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, seq))), lambda x: x[seq]), "").alias(seq))


RECORD = pa.schema([("read_id", pa.string()), ("seq", pa.string()), ("qual", pa.string()), ("file", pa.string()), ("block", pa.int64()), ("kind", pa.int32()), ("piece", pa.string())])
RECORD_SQL = "read_id string, seq string, qual string, file string, block long, kind int, piece string"


def _record(piece: str) -> tuple[str, str, str] | None:
    """(read_id, seq, qual) of a whole record, None for anything else."""
    lines = piece.split("\n")
    if len(lines) < 4 or not lines[2].startswith("+") or len(lines[3]) != len(lines[1]) or any(lines[4:]):
        return None
    return lines[0], lines[1], lines[3]


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, seq, qual) from four-line records; CRLF is read as LF.

    Files are split at ``\\n@``. That also cuts before a quality that starts with ``@``; such a
    record comes in two pieces, which are joined within a split, and across two splits by the
    file's order of blocks. Pieces that make no record (broken files, other layouts) are left out
    here and listed by ``rejected_fastq``.
    """
    whole, halves = _fastq(spark, path)
    halves = halves.where("fits").select(F.split(F.col("both"), "\n").alias("l"))
    return whole.unionByName(halves.select(F.col("l")[0].alias("read_id"), F.col("l")[1].alias("seq"), F.col("l")[3].alias("qual")))


def rejected_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, piece): what of FASTQ files makes no record, with the start of the split that it is in."""
    whole, halves = _fastq(spark, path, rejected=True)
    alone = halves.where("not fits and not taken").select("file", "block", "piece")
    return whole.unionByName(alone).where(F.length(F.trim("piece")) > 0)


def _fastq(spark: SparkSession, path: str, rejected: bool = False) -> tuple[DataFrame, DataFrame]:
    """The records, or the pieces that make none, and what is left over at the ends of splits, at most two pieces of each."""
    text = spark.read.text(path, lineSep="\n@")
    text = text.select(F.regexp_replace("value", r"\r", "").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    ship(text)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str, str, int] | None = None
        fresh: tuple[str, int] | None = None
        for batch in batches:
            out: list[tuple] = []
            first = False
            for value, file, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                piece = value
                if first := (file, block) != fresh:
                    if held is not None:
                        out.append((None, None, None, held[1], held[2], 1, held[0]))  # waits for the next block
                    held, fresh = None, (file, block)
                    if block == 0:
                        piece = piece.removeprefix("@")
                if held is not None:
                    joined = f"{held[0]}\n@{piece}"
                    if _record(joined) is None:
                        out.append((None, None, None, held[1], held[2], 3, held[0]))
                    else:
                        piece = joined
                    held = None
                if (r := _record(piece)) is not None:
                    out.append((*r, file, block, 0, None))
                elif piece.count("\n") == 2 and piece.rsplit("\n", 1)[1].startswith("+"):
                    held = (piece, file, block)
                elif first and block and "\n" not in piece.rstrip("\n"):
                    out.append((None, None, None, file, block, 2, piece))  # may end what the block before began
                else:
                    out.append((None, None, None, file, block, 3, piece))
            if out:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), RECORD, strict=True)], schema=RECORD)
        if held is not None:
            yield pa.record_batch([pa.array([x], f.type) for x, f in zip((None, None, None, held[1], held[2], 1, held[0]), RECORD, strict=True)], schema=RECORD)

    rows = text.mapInArrow(parse, RECORD_SQL)
    whole = rows.where("kind = 3").select("file", "block", "piece") if rejected else rows.where("kind = 0").select("read_id", "seq", "qual")
    order = Window.partitionBy("file").orderBy("block", F.col("kind").desc())
    halves = rows.where("kind in (1, 2)").select("file", "block", "kind", "piece", F.lead("kind").over(order).alias("next_kind"), F.lead("piece").over(order).alias("next_piece"))
    both = F.concat("piece", F.lit("\n@"), F.regexp_replace("next_piece", r"\n+$", ""))
    lines = F.split(both, "\n")
    fits = (F.col("kind") == 1) & (F.col("next_kind") == 2) & (F.size(lines) == 4) & (F.length(F.get(lines, F.lit(1))) == F.length(F.get(lines, F.lit(3))))
    halves = halves.withColumn("both", both).withColumn("fits", F.coalesce(fits, F.lit(False)))
    return whole, halves.withColumn("taken", F.coalesce(F.lag("fits").over(order), F.lit(False)))


def from_text(df: DataFrame, key: str, text: str = "text", letters: str = "acgt") -> DataFrame:
    """(seq_id, seq) from any text column: lower-case, other letters dropped."""
    return df.select(F.col(key).alias("seq_id"), F.regexp_replace(F.lower(text), f"[^{letters}]", "").alias("seq"))


def summary(df: DataFrame, k: int = 1, seq: str = "seq") -> DataFrame:
    """One row: n_seqs, total_bp, avg_bp (rounded down), min_bp, max_bp of the sequences of k bases or more."""
    n = F.length(seq).cast("long")
    out = df.where(n >= k).agg(F.count(F.lit(1)).alias("n_seqs"), F.coalesce(F.sum(n), F.lit(0)).alias("total_bp"), F.min(n).alias("min_bp"), F.max(n).alias("max_bp"))
    return out.select("n_seqs", "total_bp", F.when(F.col("n_seqs") > 0, F.floor(F.col("total_bp") / F.col("n_seqs"))).cast("long").alias("avg_bp"), "min_bp", "max_bp")


def length_buckets(df: DataFrame, k: int, shift: int = 11, most: int = 256, seq: str = "seq") -> DataFrame:
    """Reads and bases for each bucket of length (length - k) >> shift, the last bucket open: bucket, n_reads, bp."""
    n = F.length(seq).cast("long")
    bucket = F.least(F.shiftright(n - k, shift), F.lit(most - 1)).cast("long")
    return df.where(n >= k).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n_reads"), F.sum(n).alias("bp"))


def by_length(df: DataFrame, k: int, shift: int = 11, most: int = 256, seq: str = "seq", partitions: int | None = None) -> DataFrame:
    """The reads, those of one length bucket together: tasks of like reads, for work that is batched by length."""
    n = F.length(seq).cast("long")
    bucket = F.least(F.greatest(F.shiftright(n - k, shift), F.lit(0)), F.lit(most - 1))
    return df.repartition(partitions, bucket) if partitions else df.repartition(bucket)


def write_tsv(df: DataFrame, path: str, mode: str = "append") -> None:
    """A tab-separated table with a header in each file, such as benchmark results."""
    df.write.mode(mode).option("sep", "\t").option("header", True).csv(path)
