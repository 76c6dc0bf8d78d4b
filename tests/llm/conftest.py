import random

import pytest
from cases import BAD, corpus


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory, rows):
    """A data folder with the corpus, under columns whose names clash with those that operators use."""
    at = tmp_path_factory.mktemp("data")
    extra = "key long, block long, bucket int, size long, fp long, z string, v string, id long, score double, `secret_scan` string, target double, mix_size long"
    wide = [(*x, len(x[1] or ""), *[None] * 12) for x in rows]
    spark.createDataFrame(wide, f"doc_id long, text string, lang string, source string, n_chars long, {extra}").repartition(5).write.parquet(f"{at}/documents.parquet")
    labels = [(i, 1, int(any(b in (t or "") for b in BAD))) for i, t, _, _ in rows if i is not None and i % 2 == 0]
    spark.createDataFrame([*labels, (None, 1, 1), (77777, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    r = random.Random(2)
    vectors = [(i, [r.gauss(0, 1) for _ in range(8)], "x") for i in range(150)]
    vectors += [(200 + i, vectors[3][1], "x") for i in range(60)]
    vectors += [(300, None, "x"), (320, [0.0] * 8, "x"), (340, [float("nan")] * 8, "x"), (360, [1.0, None] * 4, "x"), (380, [float("inf")] * 8, "x"), (400, [1.0, 2.0], "x"), (401, [2.0, 2.0], "x"), (None, [1.0] * 8, "x"), (420, [], "x"), vectors[20]]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, score string").write.parquet(f"{at}/embeddings.parquet")
    return str(at)


@pytest.fixture(scope="session")
def nothing(spark, tmp_path_factory, folder):
    """The same tables without rows."""
    at = tmp_path_factory.mktemp("nothing")
    for t in ("documents", "labels", "embeddings"):
        spark.read.parquet(f"{folder}/{t}.parquet").where("false").coalesce(1).write.parquet(f"{at}/{t}.parquet")
    return str(at)
