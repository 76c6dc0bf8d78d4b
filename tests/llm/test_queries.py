"""Each query against brute force, over a corpus with nulls, odd texts, copies and repeated rows."""

import hashlib
import json
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from cases import BAD

from stridemark.llm import registry

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def result(spark, folder, name, *columns):
    return Counter(tuple(r) for r in registry.queries()[name](spark, folder).select(*columns).collect())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_empty_tables(spark, nothing, name):
    assert registry.queries()[name](spark, nothing).count() == 0


def test_op1_substring_dedup(spark, folder, rows):
    big = float("inf")
    words = [(big if i is None else i, SPACE.findall(t or "")) for i, t, _, _ in rows]
    least = {}
    for i, w in words:
        for j in range(len(w) - 12):
            k = tuple(w[j : j + 13])
            least[k] = min(i, least.get(k, big))
    expected = Counter()
    for (i, w), (doc_id, *_) in zip(words, rows, strict=True):
        keep = [True] * len(w)
        for j in range(len(w) - 12):
            if least[tuple(w[j : j + 13])] < i:
                keep[j : j + 13] = [False] * 13
        expected[doc_id, len(w), keep.count(False), sha(" ".join(x for x, k in zip(w, keep, strict=True) if k))] += 1
    got = result(spark, folder, "op1_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == expected
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    assert got == Counter(con.sql(registry.oracle_sql()["op1_substring_dedup"].strip()).fetchall())


def _mixed(x):
    x ^= x >> 16
    x = x * 0x7FEB352D & 0xFFFFFFFF
    x ^= x >> 15
    x = x * 0x846CA68B & 0xFFFFFFFF
    return x ^ x >> 16


def _anchors(t, k=16, s=6):
    """Hashes of the closed syncmers of a text, k-mer by k-mer."""
    hashed = lambda x: _mixed(sum(ord(c) * pow(0x9E3779B1, len(x) - 1 - i, 1 << 32) for i, c in enumerate(x)) & 0xFFFFFFFF)
    low = [hashed(t[i : i + s]) for i in range(len(t) - s + 1)]
    out = []
    for i in range(len(t) - k + 1):
        window = low[i : i + k - s + 1]
        if window.index(min(window)) in (0, k - s):
            out.append(hashed(t[i : i + k]))
    return out or ([int.from_bytes(hashlib.sha256(t.encode()).digest()[:4], "little")] if t else [])


def _likeness(a, b):
    """The longest common subsequence of hashes, each with its number, among all of them."""
    if a == b:
        return 1.0
    a, b = ([(h, x[:i].count(h)) for i, h in enumerate(x)] for x in (a, b))
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1] / len({*a, *b})


def test_op2_fingerprints(spark, folder, rows):
    got = registry.queries()["op2_fingerprints"](spark, folder).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(x[0] for x in rows)
    # null ids first, rows that repeat an id in any order among themselves
    order = sorted(((i is not None, i or 0), t or "") for i, t, _, _ in rows)
    nexts = {}
    for n, (key, t) in enumerate(order):
        same = [u for k, u in order if k == key]
        after = next((k for k, _ in order[n + 1 :] if k > key), order[0][0])
        nexts[key] = (same, {u for k, u in order if k == after} | (set(same) if len(same) > 1 else set()))
    hexed = lambda a: "".join(f"{h:08x}" for h in a)
    prints, checked = {}, 0
    for r in got:
        same, after = nexts[r["doc_id"] is not None, r["doc_id"] or 0]
        own = [t for t in same if len(t) == r["n_chars"]]
        assert own and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        fits = [(t, n, e) for t in own for n in after for e in [t[: len(t) - len(t) // 2] + n[: len(t) // 2]] if sha(e) == r["edited_sha256"]]
        assert fits
        if len(fits) == 1 and len(fits[0][0]) < 1500:
            t, n, e = fits[0]
            a, b, c = (prints.setdefault(x, _anchors(x)) for x in (t, e, n[:4000]))
            assert r["fingerprint"] == hexed(a) and r["edited_fingerprint"] == hexed(b)
            assert abs(r["near_edited"] - _likeness(a, b)) < 1e-12
            if len(n) < 1500:
                assert abs(r["near_next"] - _likeness(a, c)) < 1e-12
            checked += 1
    assert checked > 120
    by_text = {}
    for r in got:
        texts = {t for t in nexts[r["doc_id"] is not None, r["doc_id"] or 0][0]}
        if len(texts) == 1:
            by_text.setdefault(texts.pop(), set()).add(r["fingerprint"])
    assert all(len(p) == 1 for p in by_text.values())


def test_op3_simhash(spark, folder, rows):
    prints = []
    for _, t, _, _ in rows:
        w = SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[j : j + 4]), 42) for j in range(max(1, len(w) - 3))] if w else []
        prints.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                parent[find(a)] = find(b)
    least = {}
    for a, r in enumerate(rows):
        if r[0] is not None:
            least[find(a)] = min(r[0], least.get(find(a), r[0]))
    expected = Counter((r[0], f"{prints[a]:016x}", least.get(find(a))) for a, r in enumerate(rows))
    assert result(spark, folder, "op3_simhash", "doc_id", "fingerprint", "component_id") == expected


def test_op4_toxicity(spark, folder, rows):
    got = registry.queries()["op4_toxicity"](spark, folder).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(x[0] for x in rows)
    texts = {}
    for i, t, _, _ in rows:
        texts.setdefault(i, set()).add(any(b in (t or "") for b in BAD))
    sure = [(r, *texts[r["doc_id"]]) for r in got if len(texts[r["doc_id"]]) == 1]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert sum(r["predicted"] != y for r, y in sure) <= 2


def test_op5_bpe(spark, folder, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    expected = Counter()
    for i, text, _, _ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        expected[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(t.decode(ids, skip_special_tokens=False))] += 1
    assert result(spark, folder, "op5_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == expected


def test_op6_token_counts(spark, folder, rows):
    from tokenizers import Tokenizer, models

    from stridemark.llm.pieces import byte_letters

    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        vocabulary = json.load(f)["model"]["vocab"]
    t = Tokenizer(models.WordPiece(vocabulary, unk_token="!", continuing_subword_prefix="", max_input_chars_per_word=10**7))
    letters = byte_letters()
    count = lambda w: len(t.encode("Ġ" + "".join(letters[b] for b in w.encode())).ids)
    expected = Counter((i, len(w), sum(map(count, w))) for i, text, _, _ in rows for w in [SPACE.findall(text or "")])
    assert result(spark, folder, "op6_token_counts", "doc_id", "n_words", "n_tokens") == expected


def test_op7_mixing(spark, folder, rows):
    got = result(spark, folder, "op7_mixing", "doc_id", "size", "source_size", "target", "taken")
    assert got == result(spark, folder, "op7_mixing", "doc_id", "size", "source_size", "target", "taken")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    distinct = lambda rows_: {r for r in rows_}
    assert distinct(got) == distinct(con.sql(registry.oracle_sql()["op7_mixing"].strip()).fetchall())
    # by hand: clamp and reshare until no source is above
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(SPACE.findall(t or ""))
    names = sorted([s for s in sizes if s is not None]) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_ -= over
    assert {round(t, 6) for _, _, _, t, _ in got} == {round(x, 6) for x in target.values()}
    most = max(len(SPACE.findall(t or "")) for _, t, _, _ in rows)
    taken = Counter()
    for (_, size, source_size, t, k), n in got.items():
        assert 0 <= k <= 2 * size
        taken[source_size, round(t, 6)] += k * n
    assert all(abs(taken[sizes[s], round(target[s], 6)] - target[s]) <= most for s in names)


def _nearest(rows, k=20):
    """(query_id, rank, vec_id, score) by brute force; rows that repeat an id are rows of their own."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = Counter()
    for n, (q, x) in enumerate(good):
        if q % 20 == 0:
            near = sorted((-float(sum(a * b for a, b in zip(x, v, strict=True))), i) for m, (i, v) in enumerate(good) if m != n and len(v) == len(x))[:k]
            out += Counter((q, rank, i, -s) for rank, (s, i) in enumerate(near, 1))
    return out


def test_op8_nearest_neighbours(spark, folder):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert len(rows) > len(dict(rows))
    got = result(spark, folder, "op8_nearest_neighbours", "query_id", "rank", "vec_id", "score")
    assert got == _nearest(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet/*.parquet')")
    assert got == Counter(con.sql(registry.oracle_sql()["op8_nearest_neighbours"].strip()).fetchall())


def test_op8_across_groups_tiles_and_query_blocks(spark, monkeypatch):
    from pyspark.sql import functions as F

    from stridemark.llm import neighbours

    for name, n in (("GROUP", 8 * 8 * 100), ("TILE", 16), ("QUERIES", 7)):
        monkeypatch.setattr(neighbours, name, n)
    r = np.random.default_rng(5)
    # few values: many ties; lengths differ, so that tiles are skipped
    rows = [(int(r.integers(0, 900)), (r.integers(-2, 3, 8) * float(r.choice([0.25, 1, 4]))).tolist()) for _ in range(1500)]
    rows += [rows[3]] * 40 + [(20, rows[0][1])] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = neighbours.search(df, F.col("vec_id") % 20 == 0).select("query_id", "rank", "vec_id", "score").collect()
    assert Counter(map(tuple, got)) == _nearest(rows)


def test_op9_language_id(spark, folder, rows):
    got = registry.queries()["op9_language_id"](spark, folder).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(x[0] for x in rows)
    letters = {i: any(c.isalpha() for c in t or "") for i, t, _, _ in rows}
    for r in got:
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "fr", "und")
        if r["doc_id"] is not None and r["doc_id"] >= 1000:
            assert (r["lang_pred"] == "und") != letters[r["doc_id"]]


def test_op9_against_plain_vectors_and_held_out_texts(spark):
    """Prototypes and cosines trigram by trigram, and accuracy, on invented languages in four scripts."""
    import random

    from stridemark.llm import language

    r = random.Random(3)
    alphabets = {"x-latin": "abcdefgh", "x-latin-2": "efghijkl", "x-greek": "αβγδεζηθ", "x-han": "日本語文字漢書", "x-hangul": "가나다라마바사"}
    roots = {n: ["".join(r.choice(a) for _ in range(r.randint(2, 5))) for _ in range(60)] for n, a in alphabets.items()}
    text = lambda n, k: " ".join(r.choice(roots[n]) for _ in range(k))
    rows = [(i, text(n, r.choice([3, 20, 80])), n) for i in range(300) for n in [r.choice(list(alphabets))]]
    train, held = rows[:200], rows[200:]
    names, proto = language.fit(spark.createDataFrame(train, "doc_id long, text string, lang string").repartition(5))
    assert names == sorted(alphabets)

    def plain(t):
        points = np.array(sorted({0, *map(ord, t.lower().replace(" ", ""))}), np.uint32)
        v = dict(zip(points.tolist(), language.letter_vectors(points).astype(float), strict=True))
        codes = [0, *[0 if c == " " else ord(c) for c in t.lower()], 0]
        return sum(np.roll(v[a], 2) * np.roll(v[b], 1) * v[c] for a, b, c in zip(codes, codes[1:], codes[2:], strict=False) if b)

    unit = lambda x: x / np.linalg.norm(x)
    own = np.array([unit(sum(unit(plain(t)) for _, t, n in train if n == name)) for name in names])
    own = np.array([unit(x) for x in own - own.mean(0)])
    assert np.allclose(own, proto, atol=1e-4)
    got = {x["doc_id"]: x for x in language.predict(spark.createDataFrame(held, "doc_id long, text string, lang string"), names, proto).collect()}
    for i, t, _ in held:
        cos = own @ unit(plain(t))
        assert got[i]["lang_pred"] == names[cos.argmax()] and abs(got[i]["score"] - max(0, cos.max())) < 1e-3
    assert np.mean([got[i]["lang_pred"] == n for i, _, n in held]) > 0.97


def test_op10_secrets(spark, folder, rows):
    from stridemark.llm import forest, secrets

    model, pattern = secrets.trained(), re.compile(secrets.CANDIDATE)
    expected = Counter()
    for i, t, _, _ in rows:
        t = t or ""
        kept, at, n, found = "", 0, 0, []
        held = list(pattern.finditer(t))
        for m, then in zip(held, [*held[1:], None], strict=False):
            n += 1
            row = secrets.feature_row(m[0], t[at : m.start()], t[m.end() : then and then.start()])
            secret = forest.probability(model, np.array(row)) >= 0.5
            kept += t[at : m.start()] + (secrets.MARK if secret else m[0])
            found += [sha(m[0])] * secret
            at = m.end()
        expected[i, n, len(found), tuple(found), sha(kept + t[at:])] += 1
    got = registry.queries()["op10_secrets"](spark, folder).collect()
    assert Counter((r["doc_id"], r["n_candidates"], r["n_secrets"], tuple(r["secret_sha256s"]), r["redacted_sha256"]) for r in got) == expected
    planted = sum('token = "' in (t or "") for _, t, _, _ in rows)
    assert sum(len(k[3]) * n for k, n in expected.items()) == planted > 5
