"""A small corpus with what operators have to stand."""

import random

WORDS = ["alpha", "bravo", "Charlie", "delta,", "echo", "foxtrot", "golf.", "hôtel", "india", "juliett", "kilo", "líma", "mike", "NOVEMBER", "oscar", "papa", "quebec", "romeo"]
BAD = ["grumblewort", "snarkface", "vilemonger"]


def prose(r, n):
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ed", "ing"]) + str(r.choice(["", "", r.randrange(50)])) for _ in range(n))


def corpus(seed=1, n=240):
    """Rows (doc_id, text, lang, source) with copies, near copies, shared passages, secrets, toxic words and odd texts."""
    r = random.Random(seed)
    shared = [prose(r, 40) for _ in range(3)]
    base = prose(r, 300)
    rows = []
    for i in range(n):
        kind = r.randrange(10)
        if kind == 0:
            text = base
        elif kind == 1:
            w = base.split()
            w[r.randrange(len(w))] = "changed"
            text = " ".join(w)
        elif kind == 2:
            text = prose(r, 30) + "\n" + r.choice(shared) + "\t" + prose(r, 30)
        elif kind == 3:
            text = prose(r, 20) + f' token = "{r.randbytes(20).hex()}" ' + prose(r, 10)
        elif kind in (4, 9):
            w = prose(r, 60).split()
            for _ in range(6):
                w.insert(r.randrange(len(w)), r.choice(BAD))
            text = " ".join(w)
        else:
            text = prose(r, r.choice([1, 5, 12, 13, 14, 80, 200]))
        rows.append([i * 3, text, r.choice(["en", "fr", None]), r.choice(["a", "b", "b", "b", None, "é"])])
    odd = [None, "", " \n\t ", "x" * 5000, "a b c <|endoftext|> d", "é ́ ﬁ ΑΣ Σ\x0b\x0c\r\n", "日本語のテキスト " * 30, "😀" * 300, prose(r, 5000), "don't we'll I'M they'RE 123 4567 ...!!!", "\x00\x01 nul"]
    rows += [[1000 + i, t, "en", "odd"] for i, t in enumerate(odd)]
    rows += [[None, base, "en", "a"], [None, prose(r, 20), None, None], rows[5][:], rows[5][:], [rows[7][0], prose(r, 50), "en", "a"]]
    return [tuple(x) for x in rows]
