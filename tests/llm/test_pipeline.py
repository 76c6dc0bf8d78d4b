"""Each stage of the pipeline, written and reread, on its own input."""

import random
import re

import corpus_pipeline
import pytest
from cases import BAD


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    at = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, folder).write.parquet(f"{at}/{i}")
        docs = spark.read.parquet(f"{at}/{i}")
        out.append(docs)
    return out


def ids(df):
    return sorted((r["doc_id"] is None, r["doc_id"]) for r in df.select("doc_id").collect())


def test_columns(stages):
    assert all(df.columns == corpus_pipeline.COLUMNS for df in stages[1:-1])


def test_toxic_documents_go_and_others_stay(stages):
    bad = lambda t: any(b in (t or "") for b in BAD)
    before, after = ([r["text"] for r in df.collect()] for df in stages[:2])
    assert not any(map(bad, after)) and len(after) == sum(not bad(t) for t in before)


def test_one_of_each_group_stays(spark, stages):
    """Of each group the row of the smallest id; an id that repeats with unlike texts stays with both."""
    from stridemark.llm import simhash

    rows = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    numbered = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    group = {r["doc_id"]: r["component_id"] for r in simhash.groups(numbered, simhash.NEAR).collect()}
    best = {}
    for i, (doc_id, _) in enumerate(rows):
        best.setdefault(group[i], []).append((doc_id is None, doc_id))
    assert ids(stages[2]) == sorted(min(x) for x in best.values())
    kept = {r["text"] for r in stages[2].collect()}
    lone = {i for i, g in group.items() if list(group.values()).count(g) == 1}
    assert all(rows[i][1] in kept for i in lone) and len(lone) > 50


def test_secrets_are_hidden_and_all_documents_stay(stages):
    assert ids(stages[2]) == ids(stages[3])
    for r in stages[3].collect():
        assert not re.search(r'token = "[0-9a-f]{40}', r["text"] or "") and r["n_chars"] == len(r["text"] or "")


def test_mix_repeats_rows(stages):
    size = lambda df: sum(len((r["text"] or "").split()) for r in df.collect())
    assert abs(size(stages[4]) - 1.5 * size(stages[3])) <= 6 * 5000


def test_run_gives_the_last_stage(spark, folder, stages):
    assert sorted(map(str, corpus_pipeline.run(spark, folder).collect())) == sorted(map(str, stages[-1].collect()))
    assert ids(stages[-1]) == ids(stages[4])


def test_rows_without_an_id_or_that_repeat_one_stay_by_their_groups(spark):
    from cases import prose

    from stridemark.llm import simhash

    r = random.Random(8)
    texts = [prose(r, 80) for _ in range(40)]
    rows = [(0, texts[0]), *((None, t) for t in texts[:20]), *((7, t) for t in texts[20:]), (None, texts[5]), (7, texts[30])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(r["text"] for r in simhash.one_of_each(df, ["doc_id", "text"]).collect())
    assert got == sorted(texts)


def test_stages_stand_empty_tables_and_other_columns(spark, nothing, folder):
    docs = spark.read.parquet(f"{nothing}/documents.parquet")
    assert len(docs.columns) > len(corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, nothing)
        assert docs.count() == 0
    assert corpus_pipeline.run(spark, nothing).count() == 0
    # rows, but no label that may be learned from
    few = spark.createDataFrame([(1, None, None, None, None), (None, "", "x", None, 0), (1, "a b", None, "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.drop_toxic(spark, few, nothing).count() == 3
    assert sorted(str(r["text"]) for r in corpus_pipeline.drop_near_copies(spark, few, nothing).collect()) in (["", "a b"], ["None", "a b"])
    assert {r["text"] for r in corpus_pipeline.hide_secrets(spark, few, nothing).collect()} == {None, "", "a b"}
    assert corpus_pipeline.encode(spark, few, nothing).count() == 3
