import random

import pytest
from naive import syncmers as naive
from pyspark.sql import functions as F

from stridemark.functions import dna, sql
from stridemark.operators import chunks, sketch
from stridemark.params import Params
from stridemark.plans import native
from stridemark.sources import fastx
from stridemark.streaming import reads

R = random.Random(1)
SEQS = [None, "", "acgt", "ACGT" * 12, "a" * 40, "".join(R.choice("acgt") for _ in range(700)), "".join(R.choice("ACGTN") for _ in range(300)), "".join(R.choice("acgt") for _ in range(31))]
SEQS.append("".join(R.choice("n" + "acgt" * 12) for _ in range(600)))
P = Params(31, 15, canonical=True, bits=64)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, s, "x") for i, s in enumerate(SEQS)], "seq_id long, seq string, hash string").repartition(3)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def expected(p):
    return sorted((i, a, b) for i, s in enumerate(SEQS) for a, b in naive(s or "", p.k, p.s, p.bits, p.canonical))


@pytest.mark.parametrize("p", [P, Params(31, 15), Params(21, 11, canonical=True)])
def test_arrow_and_native_plans_equal_the_definition(table, p):
    assert rows(sketch.syncmers(table, p), "seq_id", "pos", "strand") == expected(p)
    assert rows(native.syncmers(table, p), "seq_id", "pos", "strand") == expected(p)
    both = ["seq_id", "pos", "strand", "hash", "smer_pos", "at_start"]
    assert rows(native.syncmers(table, p), *both) == rows(sketch.syncmers(table, p), *both)


def test_native_plan_shuffles_once(table):
    plan = native.syncmers(table, P)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_counts_positions_and_minima(table):
    n = {i: len([1 for j, _, _ in expected(P) if j == i]) for i in range(len(SEQS))}
    got = {r["seq_id"]: r for r in sketch.counts(table, P).collect()}
    assert {i: r["n_syncmers"] for i, r in got.items()} == n
    assert all(r["n_fw"] + r["n_rc"] == r["n_syncmers"] and r["n_kmers"] == max(0, len(SEQS[i] or "") - 30) for i, r in got.items())
    lists = {r["seq_id"]: [tuple(x) for x in r["positions"]] for r in sketch.positions(table, P).collect()}
    assert lists == {i: [(a, b) for j, a, b in expected(P) if j == i] for i in range(len(SEQS))}
    assert sketch.window_minima(table, Params(31, 15)).where("seq_id = 5").count() == 670


@pytest.mark.parametrize("bits", [32, 64, 128])
def test_window_pass_over_smers(table, bits):
    """Also where s-mers with ambiguous letters are missing."""
    p = Params(31, 15, canonical=True, bits=bits)
    want = rows(sketch.syncmers(table, p), "seq_id", "pos")
    assert rows(sketch.syncmers_from_smers(sketch.smers(table, p), p.w, bits=bits), "seq_id", "pos") == want
    assert any(i == 8 for i, _ in want) and (bits == 128 or want == [(i, a) for i, a, _ in expected(p)])


def test_untracked_strand_and_the_last_kmer(table):
    both = rows(sketch.syncmers(table, Params(31, 15, canonical=True, bits=64, track_strand=False, skip_last=True)), "seq_id", "pos", "strand")
    assert both == [(i, a, 0) for i, a, _ in expected(P) if a + 31 < len(SEQS[i])]
    for p in (Params(31, 15, skip_last=True), Params(31, 15, canonical=True, skip_last=True)):
        n = {r["seq_id"]: r["n_syncmers"] for r in sketch.counts(table, p).collect()}
        assert n == {i: sum(a + 31 < len(s or "") for a, _ in naive(s or "", 31, 15, 32, p.canonical)) for i, s in enumerate(SEQS)}


@pytest.mark.parametrize("size", [1, 7, 100, 10_000])
def test_chunks_add_up(table, size):
    assert rows(chunks.chunked_syncmers(table, P, size=size, spread=3), "seq_id", "pos", "strand") == expected(P)


def test_empty_table(table):
    none = table.where("false")
    assert sketch.syncmers(none, P).count() == sketch.counts(none, P).count() == native.syncmers(none, P).count() == 0


def test_dna_functions(spark):
    df = spark.createDataFrame([("acgtNU",), ("",), (None,)], "seq string")
    got = df.select(dna.reverse_complement("seq").alias("rc"), F.hex(dna.pack_2bit("seq")).alias("packed"), dna.clean("seq").alias("clean")).collect()
    assert [(r["rc"], r["clean"]) for r in got] == [("Anacgt", "acgt"), ("", ""), (None, None)]
    assert got[1]["packed"] == "" and got[2]["packed"] is None
    assert got[0]["packed"] == format(0 | 1 << 2 | 3 << 4 | 2 << 6, "02X") + format(0 | 2 << 2, "02X")
    assert df.select(dna.codes("seq", "acgt")).first()[0] == [0, 1, 2, 3, 0, 3]


def test_sql_functions(spark, table):
    sql.register(spark)
    table.createOrReplaceTempView("some_reads")
    assert rows(spark.sql("SELECT r.seq_id, t.pos, t.strand FROM some_reads r, LATERAL syncmers_canonical(r.seq, 31, 15) t"), "*") == expected(P)
    got = spark.sql("SELECT seq_id, syncmer_positions(seq, 31, 15) AS p, syncmer_count(seq, 15, 31) AS wrong FROM some_reads WHERE seq_id = 5").first()
    assert got["p"] == [a for a, _ in naive(SEQS[5], 31, 15, 64)] and got["wrong"] == 0
    found = spark.sql("SELECT r.seq_id, t.pos, t.smer_pos, t.at_start FROM some_reads r, LATERAL syncmers(r.seq, 31, 15) t")
    assert rows(found, "*") == rows(sketch.syncmers(table, Params(31, 15, bits=64)), "seq_id", "pos", "smer_pos", "at_start")
    both = spark.sql("SELECT seq_id, inline(syncmer_positions_canonical(seq, 31, 15)) FROM some_reads")
    assert rows(both, "*") == expected(P)
    # one rule for ambiguous letters: counts are those of positions
    counted = spark.sql("SELECT syncmer_count(seq, 31, 15) AS n, syncmer_count_canonical(seq, 31, 15) AS c FROM some_reads WHERE seq_id = 8").first()
    assert tuple(counted) == (len(naive(SEQS[8], 31, 15, 32, approx16=True)), len(naive(SEQS[8], 31, 15, 32, True, approx16=True)))


def test_sql_functions_of_nulls(spark, table):
    sql.register(spark)
    table.createOrReplaceTempView("some_reads")
    for f in ("syncmer_count", "syncmer_count_canonical", "syncmer_positions", "syncmer_positions_canonical"):
        got = spark.sql(f"SELECT {f}(seq, CAST(NULL AS INT), 15) AS a, {f}(seq, 31, CAST(NULL AS INT)) AS b, {f}(CAST(NULL AS STRING), 31, 15) AS c FROM some_reads").collect()
        empty = 0 if "count" in f else []
        assert all(r["a"] is None and r["b"] is None and r["c"] == empty for r in got)
    assert spark.sql("SELECT * FROM some_reads r, LATERAL syncmers(r.seq, CAST(NULL AS INT), 15) t").count() == 0


def small_splits(spark, most):
    spark.conf.set("spark.sql.files.maxPartitionBytes", most)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")


@pytest.fixture()
def splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda most: small_splits(spark, most)
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text("junk before\n>one first record\nACGT\nNNac\ngt\n>two\r\nAC-GT\r\n\r\n>three\n")
    read = fastx.read_fasta(spark, str(tmp_path / "a.fa"))
    got = {r["seq_id"]: (r["description"], r["seq"]) for r in read.collect()}
    assert got == {"one": ("first record", "acgtnnacgt"), "two": ("", "acgt"), "three": ("", "")}
    old = {r["seq_id"]: r["seq"] for r in fastx.read_fasta(spark, str(tmp_path / "a.fa"), compat_fasta=True).collect()}
    assert old["one"] == "acgtnact"
    assert fastx.concatenated(read).first()["seq"] == "acgtnnacgtacgt"
    assert [r["seq_id"] for r in read.orderBy("ordinal").collect()] == ["one", "two", "three"]


def test_fasta_of_gzip_and_of_several_files(spark, tmp_path):
    import gzip

    for name in ("b.fa.gz", "a.fa.gz"):
        with gzip.open(tmp_path / name, "wt") as f:
            f.write(f">{name}1\nACG\n>{name}2\nTT\n")
    read = fastx.read_fasta(spark, f"{tmp_path}/*.gz")
    assert [r["seq_id"] for r in read.orderBy("ordinal").collect()] == ["a.fa.gz1", "a.fa.gz2", "b.fa.gz1", "b.fa.gz2"]
    with gzip.open(tmp_path / "r.fastq.gz", "wt") as f:
        f.write("@r1\nACGT\n+\nIIII\n")
    assert [tuple(r) for r in fastx.read_fastq(spark, str(tmp_path / "r.fastq.gz")).collect()] == [("r1", "ACGT", "IIII")]


@pytest.mark.parametrize("most", ["128m", "700b"])
@pytest.mark.parametrize("size", [50, 1000])
def test_fasta_in_chunks(spark, splits, tmp_path, most, size):
    """Chunks of records that span splits give the syncmers of the whole records, once each."""
    r = random.Random(5)
    records = [(f"c{i}", "".join(r.choice("ACGTN" if i == 2 else "ACGT") for _ in range(n))) for i, n in enumerate([3000, 20, 900, 0, 4000, 31])]
    lines = [f">{i} some text\n" + "\n".join(s[j : j + 60] for j in range(0, len(s), 60)) for i, s in records]
    (tmp_path / "g.fa").write_text("\n".join(lines) + "\n")
    splits(most)
    chunks_ = fastx.read_fasta_chunks(spark, str(tmp_path / "g.fa"), P.k, size)
    got = chunks.syncmers_of_chunks(chunks_, P, ["seq_id"])
    assert rows(got, "seq_id", "pos", "strand") == sorted((i, a, b) for i, s in records for a, b in naive(s, P.k, P.s, P.bits, P.canonical))
    assert chunks_.agg(F.max(F.length("seq"))).first()[0] <= size + P.k - 1


@pytest.mark.parametrize("most", ["128m", "200b"])
def test_fastq_with_qualities_that_look_like_headers(spark, splits, tmp_path, most):
    r = random.Random(3)
    reads_ = []
    for i in range(60):
        seq = "".join(r.choice("ACGT") for _ in range(r.randint(1, 60)))
        reads_.append((f"read{i} x", seq, "".join(r.choice("@+I#") for _ in seq)))
    (tmp_path / "a.fastq").write_text("".join(f"@{a}\n{b}\n+\n{c}\n" for a, b, c in reads_))
    splits(most)
    got = sorted(tuple(x) for x in fastx.read_fastq(spark, str(tmp_path / "a.fastq")).collect())
    assert fastx.rejected_fastq(spark, str(tmp_path / "a.fastq")).count() == 0
    assert got == sorted(reads_)
    df = spark.createDataFrame([(x[1],) for x in reads_], "seq string")
    total = sum(len(x[1]) for x in reads_)
    assert tuple(fastx.summary(df).first())[:3] == (60, total, total // 60)
    assert fastx.length_buckets(df, 5, 3).agg(F.sum("n_reads")).first()[0] == sum(len(x[1]) >= 5 for x in reads_)


def test_what_makes_no_record_is_listed(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("@good\nAC\n+\nII\n@short quality\nACGT\n+\nII\n@two lines\nAC\nGT\n+\nIIII\n@last\nA\n+\nI\n")
    assert sorted(r["read_id"] for r in fastx.read_fastq(spark, str(tmp_path / "a.fastq")).collect()) == ["good", "last"]
    bad = [r["piece"] for r in fastx.rejected_fastq(spark, str(tmp_path / "a.fastq")).collect()]
    assert sorted(x.split("\n")[0] for x in bad) == ["short quality", "two lines"]


def test_reads_dealt_out_by_length(spark):
    df = spark.createDataFrame([("a" * n,) for n in (3, 40, 45, 200, 206, 900)], "seq string")
    dealt = fastx.by_length(df, 31, 4, partitions=3)
    assert dealt.count() == 6 and dealt.rdd.getNumPartitions() == 3
    where = {len(r["seq"]): i for i, part in enumerate(dealt.rdd.glom().collect()) for r in part}
    assert where[40] == where[45] and where[200] == where[206]


def test_tsv_sink_and_concatenation(spark, tmp_path):
    df = spark.createDataFrame([(2, "gt"), (1, "ac")], "ordinal long, seq string")
    fastx.write_tsv(df, str(tmp_path / "t"))
    assert sorted(tuple(r) for r in spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).collect()) == [("1", "ac"), ("2", "gt")]
    assert fastx.concatenated(df).first()["seq"] == "acgt"


def test_streams_equal_the_table(spark, table, tmp_path):
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    reads.read_syncmers(stream, P).writeStream.format("memory").queryName("whole_reads").trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.table("whole_reads"), "seq_id", "pos", "strand") == expected(P)


def test_fragments_in_any_order(spark, tmp_path):
    r = random.Random(4)
    parts = []
    for i, s in enumerate(SEQS):
        at, n = 0, 0
        while at < len(s or ""):
            size = r.choice([1, 10, 64])
            parts.append((i, n, s[at : at + size]))
            at, n = at + size, n + 1
    r.shuffle(parts)
    parts += parts[:5]
    for j in range(3):
        spark.createDataFrame(parts[j::3], "seq_id long, fragment long, seq string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq_id long, fragment long, seq string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = reads.fragment_syncmers(stream, P).writeStream.format("memory").queryName("fragments").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert rows(spark.table("fragments"), "seq_id", "pos", "strand") == expected(P)
