"""Queries for the sketching operators over ``documents``, each with its DuckDB SQL.

A document's sequence is its text in lower case without other letters than acgt.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemark import oracle
from stridemark.functions import dna, sql
from stridemark.operators import chunks, sketch
from stridemark.params import Params
from stridemark.plans import native
from stridemark.sources import fastx
from stridemark.streaming import reads

K, S = 31, 15
FW32, CANON32 = Params(K, S), Params(K, S, canonical=True)
FW64, CANON64 = Params(K, S, bits=64), Params(K, S, bits=64, canonical=True)
FW16, CANON16 = Params(K, S, approx16=True), Params(K, S, canonical=True, approx16=True)
KEY = ["doc_id"]


def sequences(spark: SparkSession, sf_dir: str, letters: str = "acgt") -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", dna.clean("text", letters).alias("seq"))


def long_enough(df: DataFrame, k: int = K) -> DataFrame:
    """Drops what can't have a k-mer before it goes to Python."""
    return df.where(F.length("seq") >= k)


def _smers(p: Params, *columns: str):
    return lambda spark, d: sketch.smers(long_enough(sequences(spark, d), p.s), p, KEY).select("doc_id", *columns)


def _syncmers(p: Params, *columns: str, letters: str = "acgt"):
    return lambda spark, d: sketch.syncmers(long_enough(sequences(spark, d, letters), p.k), p, KEY).select("doc_id", *columns)


def _native(p: Params, *columns: str):
    return lambda spark, d: native.syncmers(long_enough(sequences(spark, d), p.k), p, KEY).select("doc_id", *columns)


def _count(p: Params):
    return lambda spark, d: sketch.counts(sequences(spark, d), p, KEY).select("doc_id", F.col("n_syncmers").alias("n"))


def _codes(order: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        seqs = sequences(spark, d).where("length(seq) > 0")
        return seqs.select("doc_id", F.posexplode(dna.codes("seq", order)).alias("pos", "code")).select("doc_id", F.col("pos").cast("long").alias("pos"), "code")

    return run


def _revcomp(spark: SparkSession, d: str) -> DataFrame:
    return sequences(spark, d).select("doc_id", dna.reverse_complement("seq").alias("seq_rc"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return sequences(spark, d).where("length(seq) > 0").select("doc_id", F.hex(dna.pack_2bit("seq")).alias("packed"))


def _strands(spark: SparkSession, d: str) -> DataFrame:
    return sketch.counts(sequences(spark, d), CANON64, KEY).select("doc_id", F.col("n_fw").alias("fw"), F.col("n_rc").alias("rc"))


def _difference(spark: SparkSession, d: str) -> DataFrame:
    seqs = sequences(spark, d)
    exact = sketch.counts(seqs, FW32, KEY).select("doc_id", F.col("n_syncmers").alias("exact_n"))
    near = sketch.counts(seqs, FW16, KEY).select("doc_id", F.col("n_syncmers").alias("approx_n"))
    return exact.join(near, "doc_id").withColumn("diff", F.col("approx_n") - F.col("exact_n"))


def _chunked(spark: SparkSession, d: str) -> DataFrame:
    return chunks.chunked_syncmers(sequences(spark, d), FW32, KEY, size=500).select("doc_id", "pos")


def _window_pass(p: Params, letters: str = "acgt"):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return sketch.syncmers_from_smers(sketch.smers(long_enough(sequences(spark, d, letters), p.s), p, KEY), p.w, KEY, p.bits)

    return run


def _array(spark: SparkSession, d: str) -> DataFrame:
    found = sketch.positions(sequences(spark, d), FW64, KEY)
    at = F.col("positions.pos")
    return found.select("doc_id", F.size(at).cast("long").alias("n"), F.get(at, F.lit(0)).alias("first"), F.try_element_at(at, F.lit(-1)).alias("last"))


def _sql_count(spark: SparkSession, d: str) -> DataFrame:
    sql.register(spark)
    return sequences(spark, d).select("doc_id", F.expr(f"syncmer_count(seq, {K}, {S})").alias("n"), F.expr(f"syncmer_count_canonical(seq, {K}, {S})").alias("n_canonical"))


def _sql(select: str):
    """A query over the sequences, as ``r``, with the SQL functions."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        sql.register(spark)
        name = f"sequences_{uuid.uuid4().hex}"
        long_enough(sequences(spark, d)).createOrReplaceTempView(name)
        return spark.sql(select.replace("FROM r", f"FROM {name} r"))

    return run


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the session's spark.checkpoint.dir; on a single machine that may be unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None and not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{at or tempfile.mkdtemp(prefix='tables-')}/{uuid.uuid4().hex}"


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """All that there is now, as a stream into a table in the shared folder."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stream = spark.readStream.schema(docs.schema).parquet(f"{d}/documents.parquet*")
    found = reads.read_syncmers(stream.select("doc_id", dna.clean("text").alias("seq")), CANON64, KEY)
    return _streamed(found.select("doc_id", "pos", "strand"), shared_folder(spark))


def _streamed(found: DataFrame, to: str) -> DataFrame:
    found.writeStream.format("parquet").option("checkpointLocation", f"{to}/state").trigger(availableNow=True).start(f"{to}/rows").awaitTermination()
    return found.sparkSession.read.schema(found.schema).parquet(f"{to}/rows")


def _fragments(spark: SparkSession, d: str) -> DataFrame:
    """Sequences as a stream of fragments, in no order, with the state of the open ones kept."""
    to = shared_folder(spark)
    at = F.posexplode(F.expr("transform(sequence(0, length(seq) - 1, 97), i -> substring(seq, i + 1, 97))")).alias("fragment", "part")
    parts = sequences(spark, d).where("length(seq) > 0 and doc_id is not null").select("doc_id", at)
    parts.selectExpr("doc_id as seq_id", "cast(fragment as long) as fragment", "part as seq").write.parquet(f"{to}/fragments")
    stream = spark.readStream.schema("seq_id long, fragment long, seq string").parquet(f"{to}/fragments")
    return _streamed(reads.fragment_syncmers(stream, CANON64), to).withColumnRenamed("seq_id", "doc_id")


def _files(spark: SparkSession, d: str, line: str, compression: str = "none") -> str:
    """The sequences written as text files, ``line`` from doc_id and seq for each."""
    to = f"{shared_folder(spark)}/text"
    sequences(spark, d).where("seq is not null and doc_id is not null").selectExpr(f"{line} AS value").write.option("compression", compression).text(to)
    return to


WRAPPED = r"concat('>', doc_id, ' a document\n', regexp_replace(seq, '(.{60})', '$1\n'))"
FOUR_LINES = r"concat('@', doc_id, '\n', upper(seq), '\n+\n', repeat('@', length(seq)))"
ID = "cast(seq_id as long) as doc_id"


def _fasta(compression: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return fastx.read_fasta(spark, _files(spark, d, WRAPPED, compression)).selectExpr(ID, "description", "seq")

    return run


def _fasta_concatenated(spark: SparkSession, d: str) -> DataFrame:
    """Records of one file in one row, in order; sequences of up to 200 bases, as one row holds them all."""
    short = sequences(spark, d).where("length(seq) between 1 and 200 and doc_id is not null").orderBy("doc_id").selectExpr(f"{WRAPPED} AS value")
    to = f"{shared_folder(spark)}/text"
    short.coalesce(1).write.text(to)
    return fastx.concatenated(fastx.read_fasta(spark, to))


def _fasta_chunks(spark: SparkSession, d: str) -> DataFrame:
    cut = fastx.read_fasta_chunks(spark, _files(spark, d, WRAPPED), K, 500)
    return chunks.syncmers_of_chunks(cut, CANON64, ["seq_id"]).selectExpr(ID, "pos", "strand")


def _fastq(spark: SparkSession, d: str) -> DataFrame:
    read = fastx.read_fastq(spark, _files(spark, d, FOUR_LINES))
    return read.select(F.col("read_id").cast("long").alias("doc_id"), F.lower("seq").alias("seq"), F.length("qual").alias("n_qual"))


def _xor(p: Params):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return sketch.smers(long_enough(sequences(spark, d), p.s), p, KEY).groupBy("doc_id").agg(F.bit_xor("hash").alias("hashes"))

    return run


MULTIPLY = Params(K, S, canonical=True, hash="multiply")
ENTRIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "encode_2bit_actg": (_codes("actg"), oracle.codes("actg")),
    "encode_2bit_acgt": (_codes("acgt"), oracle.codes("acgt")),
    "pack_2bit": (_packed, oracle.packed("actg")),
    "revcomp": (_revcomp, oracle.REVCOMP),
    "alphabet_filter_summary": (lambda spark, d: fastx.summary(sequences(spark, d)), oracle.SUMMARY),
    "length_buckets": (lambda spark, d: fastx.length_buckets(sequences(spark, d), K, 9), oracle.length_buckets(K, 9)),
    "smers_nt32_fw": (_smers(FW32, "pos", "hash"), oracle.smers(FW32, "pos, hash")),
    "smers_nt64_fw": (_smers(FW64, "pos", "hash"), oracle.smers(FW64, "pos, hash")),
    "smers_nt32_canonical": (_smers(CANON32, "pos", "hash", "strand"), oracle.smers(CANON32, "pos, hash, strand")),
    "smers_nt32_sum_canonical": (_smers(Params(K, S, canonical=True, combine="sum"), "pos", "hash"), oracle.smers(Params(K, S, canonical=True, combine="sum"), "pos, hash")),
    "window_min_nt32": (lambda spark, d: sketch.window_minima(long_enough(sequences(spark, d)), FW32, KEY), oracle.window_min(FW32)),
    "syncmer_count_nt32_fw": (_count(FW32), oracle.count(FW32)),
    "syncmer_count_nt32_canonical": (_count(CANON32), oracle.count(CANON32)),
    "syncmer_count_approx16_fw": (_count(FW16), oracle.count(FW16)),
    "syncmer_count_approx16_canonical": (_count(CANON16), oracle.count(CANON16)),
    "syncmer_low32_of_64": (_count(Params(K, S, bits=64, low32=True)), oracle.count(Params(K, S, bits=64, low32=True))),
    "syncmer_positions_nt32_fw": (_syncmers(FW32, "pos"), oracle.syncmers(FW32, "pos")),
    "syncmer_positions_nt32_canonical": (_syncmers(CANON32, "pos", "strand"), oracle.syncmers(CANON32, "pos, strand")),
    "syncmer_positions_untracked_strand": (_syncmers(Params(K, S, canonical=True, track_strand=False), "pos", "strand"), oracle.syncmers(CANON32, "pos, 0 AS strand")),
    "syncmer_positions_approx16_fw": (_syncmers(FW16, "pos"), oracle.syncmers(FW16, "pos")),
    "syncmer_positions_approx16_canonical": (_syncmers(CANON16, "pos", "strand"), oracle.syncmers(CANON16, "pos, strand")),
    "syncmer_positions_nt64_fw": (_syncmers(FW64, "pos"), oracle.syncmers(FW64, "pos")),
    "syncmer_positions_nt64_canonical": (_syncmers(CANON64, "pos", "strand"), oracle.syncmers(CANON64, "pos, strand")),
    "syncmer_positions_wide_window": (_syncmers(Params(200, 31, bits=64, canonical=True), "pos", "strand"), oracle.syncmers(Params(200, 31, bits=64, canonical=True), "pos, strand")),
    "syncmer_strand_split": (_strands, oracle.strands(CANON64)),
    "syncmer_detail_nt64": (_syncmers(CANON64, "pos", "smer_pos", "at_start", "hash"), oracle.syncmers(CANON64, "pos, smer_pos, at_start, hash")),
    "syncmer_right_tie": (_syncmers(Params(K, S, tie="right"), "pos"), oracle.syncmers(Params(K, S, tie="right"), "pos")),
    "syncmer_multiply_hash": (_syncmers(MULTIPLY, "pos", "strand"), oracle.syncmers(MULTIPLY, "pos, strand")),
    "syncmer_nt128": (_syncmers(Params(K, S, bits=128, canonical=True), "pos", "strand"), oracle.syncmers(Params(K, S, bits=128, canonical=True), "pos, strand")),
    "approx_vs_exact_diff": (_difference, oracle.difference(FW32, FW16)),
    **{
        f"syncmers_ambiguous_{mode}": (
            _syncmers(Params(K, S, ambiguous=mode), "pos", letters="acgtn"), oracle.syncmers(Params(K, S, ambiguous=mode), "pos", letters="acgtn"),
        )
        for mode in ("skip", "as_a", "as_g", "zero", "compat_rolling")
    },
    "syncmers_chunked": (_chunked, oracle.syncmers(FW32, "pos")),
    "syncmers_window_pass": (_window_pass(CANON32), oracle.syncmers(CANON32, "pos")),
    "syncmers_window_pass_n": (_window_pass(CANON32, "acgtn"), oracle.syncmers(CANON32, "pos", letters="acgtn")),
    "syncmers_window_pass_nt64": (_window_pass(CANON64, "acgtn"), oracle.syncmers(CANON64, "pos", letters="acgtn")),
    "syncmers_native_nt32_fw": (_native(FW32, "pos"), oracle.syncmers(FW32, "pos")),
    "syncmers_native_nt64_canonical": (_native(CANON64, "pos", "strand"), oracle.syncmers(CANON64, "pos, strand")),
    "syncmer_positions_array": (_array, oracle.array(FW64)),
    "syncmer_count_sql": (_sql_count, oracle.counts_of_both(FW16, CANON16)),
    "syncmers_sql_table": (_sql(f"SELECT r.doc_id, t.pos, t.smer_pos, t.at_start FROM r, LATERAL syncmers(r.seq, {K}, {S}) t"), oracle.syncmers(FW64, "pos, smer_pos, at_start")),
    "syncmers_sql_lateral": (_sql(f"SELECT r.doc_id, t.pos, t.strand FROM r, LATERAL syncmers_canonical(r.seq, {K}, {S}) t"), oracle.syncmers(CANON64, "pos, strand")),
    "syncmer_positions_sql": (_sql(f"SELECT doc_id, explode(syncmer_positions(seq, {K}, {S})) AS pos FROM r"), oracle.syncmers(FW64, "pos")),
    "syncmer_positions_canonical_sql": (_sql(f"SELECT doc_id, inline(syncmer_positions_canonical(seq, {K}, {S})) FROM r"), oracle.syncmers(CANON64, "pos, strand")),
    "smers_multiply_hash": (_smers(MULTIPLY, "pos", "hash", "strand"), oracle.smers(MULTIPLY, "pos, hash, strand")),
    "smers_xor_nt32": (_xor(FW32), oracle.xor(FW32)),
    "smers_xor_nt64_canonical": (_xor(CANON64), oracle.xor(CANON64)),
    "syncmer_multiply_hash_record": (_syncmers(MULTIPLY, "pos", "smer_pos", "hash"), oracle.syncmers(MULTIPLY, "pos, smer_pos, hash")),
    "syncmer_nt128_record": (
        lambda spark, d: _syncmers(Params(K, S, bits=128, canonical=True), "pos", "smer_pos", "hash")(spark, d).withColumn("hash", F.hex("hash")),
        oracle.syncmers(Params(K, S, bits=128, canonical=True), "pos, smer_pos, hash"),
    ),
    "syncmer_right_tie_skip_last": (_syncmers(Params(K, S, tie="right", skip_last=True), "pos"), oracle.skip_last(Params(K, S, tie="right"))),
    "fasta_records": (_fasta("none"), oracle.FASTA),
    "fasta_gzip": (_fasta("gzip"), oracle.FASTA),
    "fasta_concatenated": (_fasta_concatenated, oracle.CONCATENATED),
    "fasta_chunks": (_fasta_chunks, oracle.syncmers(CANON64, "pos, strand")),
    "fastq_records": (_fastq, oracle.FASTQ),
    "syncmers_fragment_stream": (_fragments, oracle.syncmers(CANON64, "pos, strand")),
    "syncmers_stream": (_stream, oracle.syncmers(CANON64, "pos, strand")),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in ENTRIES.items()}
