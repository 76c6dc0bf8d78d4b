"""DuckDB SQL for the sketches, written from their definition: prefix xors and sliding minima."""

from __future__ import annotations

from stridemark.functions.constants import MULTI_SEED, MULTI_SHIFT, MULTIPLY_ORDER, ROTATE_ORDER, ROTATION, SEEDS
from stridemark.params import Params


def _seqs(letters: str = "acgt") -> str:
    return f"s AS (SELECT doc_id, regexp_replace(lower(text), '[^{letters}]', '', 'g') AS seq FROM documents)"


def _bases(least: int) -> str:
    return (
        "b AS (SELECT doc_id, length(seq) AS n, unnest(string_split(seq, '')) AS c, unnest(range(0, length(seq))) AS p "
        f"FROM s WHERE length(seq) >= {least})"
    )


def codes(order: str) -> str:
    return f"WITH {_seqs()}, {_bases(1)} SELECT doc_id, CAST(p AS BIGINT) AS pos, CAST(strpos('{order}', c) - 1 AS INTEGER) AS code FROM b"


def packed(order: str) -> str:
    return (
        f"WITH {_seqs()}, {_bases(1)}, y AS (SELECT doc_id, p // 4 AS j, CAST(sum((strpos('{order}', c) - 1) << (2 * (p % 4))) AS INTEGER) AS v FROM b GROUP BY ALL) "
        "SELECT doc_id, string_agg(printf('%02X', v), '' ORDER BY j) AS packed FROM y GROUP BY doc_id"
    )


REVCOMP = f"WITH {_seqs()} SELECT doc_id, reverse(translate(seq, 'acgt', 'tgca')) AS seq_rc FROM s"

SUMMARY = (
    f"WITH {_seqs()}, l AS (SELECT CAST(length(seq) AS BIGINT) AS n FROM s WHERE length(seq) >= 1) SELECT count(*) AS n_seqs, CAST(sum(n) AS BIGINT) AS total_bp, "
    "CAST(sum(n) // count(*) AS BIGINT) AS avg_bp, min(n) AS min_bp, max(n) AS max_bp FROM l"
)


def length_buckets(k: int, shift: int) -> str:
    return (
        f"WITH {_seqs()}, l AS (SELECT CAST(length(seq) AS BIGINT) AS n FROM s WHERE length(seq) >= {k}) "
        f"SELECT least((n - {k}) >> {shift}, 255) AS bucket, count(*) AS n_reads, CAST(sum(n) AS BIGINT) AS bp FROM l GROUP BY 1"
    )


def _seed(column: str, kind: str, bits: int, complement: bool, other: int = 0) -> str:
    value = lambda i: SEEDS[i ^ 2 if complement else i] & ((1 << bits) - 1)
    cases = " ".join(f"WHEN '{c}' THEN {value(i)}::{kind}" for i, c in enumerate(ROTATE_ORDER))
    return f"CASE {column} {cases} ELSE {other}::{kind} END"


def _rotl(x: str, r: str, kind: str, bits: int) -> str:
    """r is any whole number."""
    r = f"CAST((({r}) % {bits} + {bits}) % {bits} AS {kind})"
    if bits == 32:
        turned = f"(((({x}) << {r}) | (({x}) >> ({bits} - {r}))) & 4294967295)"
    else:
        turned = f"(((({x}) & ((1::UBIGINT << (64::UBIGINT - {r})) - 1::UBIGINT)) << {r}) | (({x}) >> (64::UBIGINT - {r})))"
    return f"(CASE WHEN {r} = 0 THEN ({x}) ELSE {turned} END)"


def _hashes(p: Params, letters: str) -> str:
    """CTEs up to h(doc_id, n, pos, hash, strand, rank, bad, bad_before); rank is compared."""
    bits = 64 if p.bits == 128 else p.bits
    kind = "BIGINT" if bits == 32 else "UBIGINT"
    run = "OVER (PARTITION BY doc_id ORDER BY p)"
    # as_a and as_g read what is no base as that base
    c = {"as_a": "CASE WHEN c IN ('a','c','g','t') THEN c ELSE 'a' END", "as_g": "CASE WHEN c IN ('a','c','g','t') THEN c ELSE 'g' END"}.get(p.ambiguous, "c")
    start = f"{_seqs(letters)}, {_bases(p.s)}, z AS (SELECT doc_id, n, p, {c} AS c, CASE WHEN c IN ('a','c','g','t') THEN 0 ELSE 1 END AS bad FROM b)"
    bads = f"CAST(sum(bad) {run} AS BIGINT) AS bad"
    before = f"coalesce(lag(bad, {p.s}) {run}, 0) AS bad_before"
    if p.hash == "multiply":
        # values of up to 2s bits by differences of weighted running sums would overflow; s-mers are read digit by digit
        own = " + ".join(f"lag(d, {p.s - 1 - j}) {run} * {4 ** (p.s - 1 - j)}" for j in range(p.s))
        other = " + ".join(f"(3 - lag(d, {p.s - 1 - j}) {run}) * {4**j}" for j in range(p.s))
        product = lambda v: f"(((({v})::HUGEINT * {p.factor}::HUGEINT) % 18446744073709551616::HUGEINT) >> {64 - 2 * p.s})"
        return (
            f"{start}, d AS (SELECT doc_id, n, p, {bads}, CAST(greatest(strpos('{MULTIPLY_ORDER}', c) - 1, 0) AS BIGINT) AS d FROM z), "
            f"v AS (SELECT doc_id, n, p, bad, {before}, {own} AS own, {other} AS other FROM d), "
            f"x AS (SELECT doc_id, n, p, bad, bad_before, {product('own')} AS fw, {product('other')} AS rc FROM v WHERE p >= {p.s - 1}), "
            f"h AS (SELECT doc_id, n, p - {p.s - 1} AS pos, bad, bad_before, {'least(fw, rc)' if p.canonical else 'fw'} AS hash, "
            f"{'CASE WHEN fw < rc THEN 0 ELSE 1 END' if p.canonical else '0'} AS strand, {'least(fw, rc)' if p.canonical else 'fw'} AS rank FROM x)"
        )
    late = SEEDS[0] & ((1 << bits) - 1) if p.ambiguous == "compat_rolling" else 0
    cols = [f"{_rotl(_seed('c', kind, bits, False), f'-{ROTATION} * p', kind, bits)} AS f", f"{_rotl(_seed('c', kind, bits, False, late), f'-{ROTATION} * p', kind, bits)} AS g"]
    xors = [f"bit_xor(f) {run} AS pf", f"bit_xor(g) {run} AS pg"]
    names = "xor(pf, coalesce(lag(pg, {s}) {run}, 0::{kind})) AS df".format(s=p.s, run=run, kind=kind)
    if p.canonical:
        cols.append(f"{_rotl(_seed('c', kind, bits, True), f'{ROTATION} * p', kind, bits)} AS r")
        xors.append(f"bit_xor(r) {run} AS pr")
        names += f", xor(pr, coalesce(lag(pr, {p.s}) {run}, 0::{kind})) AS dr"
    fw = _rotl("df", f"{ROTATION} * p", kind, bits)
    rc = _rotl("dr", f"-{ROTATION} * (p - {p.s - 1})", kind, bits)
    if not p.canonical:
        found = "fw AS hash, 0 AS strand"
    elif p.combine == "sum":
        found = "(fw + rc) & 4294967295 AS hash, CASE WHEN fw <= rc THEN 0 ELSE 1 END AS strand"
    else:
        found = "least(fw, rc) AS hash, CASE WHEN fw <= rc THEN 0 ELSE 1 END AS strand"
    rank = "hash"
    if p.approx16:
        rank = f"CASE WHEN n - {p.k} + 1 >= 64 THEN hash >> 16 ELSE hash END"
    elif p.low32:
        rank = "hash & 4294967295::UBIGINT"
    elif p.bits == 128:
        m = f"((hash::UHUGEINT * {1 ^ (p.s * MULTI_SEED & (1 << 64) - 1)}::UHUGEINT) % 18446744073709551616::UHUGEINT)"
        rank = f"xor({m}, {m} >> {MULTI_SHIFT}) * 18446744073709551616::UHUGEINT + hash::UHUGEINT"
    return (
        f"{start}, t AS (SELECT doc_id, n, p, bad, {', '.join(cols)} FROM z), "
        f"u AS (SELECT doc_id, n, p, {bads}, {', '.join(xors)} FROM t), "
        f"v AS (SELECT doc_id, n, p, bad, {before}, {names} FROM u), "
        f"x AS (SELECT doc_id, n, p, bad, bad_before, {fw} AS fw{', ' + rc + ' AS rc' if p.canonical else ''} FROM v WHERE p >= {p.s - 1}), "
        f"y AS (SELECT doc_id, n, p - {p.s - 1} AS pos, bad, bad_before, {found} FROM x), "
        f"h AS (SELECT *, {rank} AS rank FROM y)"
    )


def _signed(p: Params, name: str = "hash") -> str:
    if p.bits == 64 and p.hash == "rotate":
        return f"CASE WHEN {name} > 9223372036854775807 THEN CAST({name}::HUGEINT - 18446744073709551616::HUGEINT AS BIGINT) ELSE CAST({name} AS BIGINT) END"
    return f"CAST({name} AS BIGINT)"


def smers(p: Params, columns: str, letters: str = "acgt") -> str:
    skip = "WHERE bad = bad_before" if p.ambiguous == "skip" else ""
    return f"WITH {_hashes(p, letters)}, o AS (SELECT doc_id, CAST(pos AS BIGINT) AS pos, {_signed(p)} AS hash, CAST(strand AS INTEGER) AS strand FROM h {skip}) SELECT doc_id, {columns} FROM o"


def _closed(p: Params, letters: str) -> str:
    """CTEs up to o(doc_id, pos, strand, hash, smer_pos, at_start)."""
    w = p.w
    run = "PARTITION BY doc_id ORDER BY pos"
    first, last = ("rank <= rest", "tail < front") if p.tie == "left" else ("rank < rest", "tail <= front")
    skip = "AND end_bad = bad_before" if p.ambiguous == "skip" else ""
    # 128 bits are what is compared, as 32 hex digits
    hashed = f"lpad(hex(CASE WHEN {first} THEN rank ELSE tail END), 32, '0')" if p.bits == 128 else _signed(p, f"CASE WHEN {first} THEN hash ELSE end_hash END")
    return (
        f"{_hashes(p, letters)}, w AS (SELECT *, lead(rank, {w - 1}) OVER ({run}) AS tail, lead(hash, {w - 1}) OVER ({run}) AS end_hash, "
        f"lead(strand, {w - 1}) OVER ({run}) AS end_strand, lead(bad, {w - 1}) OVER ({run}) AS end_bad, "
        f"min(rank) OVER ({run} ROWS BETWEEN 1 FOLLOWING AND {w - 1} FOLLOWING) AS rest, "
        f"min(rank) OVER ({run} ROWS BETWEEN CURRENT ROW AND {w - 2} FOLLOWING) AS front FROM h), "
        f"o AS (SELECT doc_id, CAST(pos AS BIGINT) AS pos, CAST(CASE WHEN {first} THEN strand ELSE end_strand END AS INTEGER) AS strand, "
        f"{hashed} AS hash, CAST(CASE WHEN {first} THEN pos ELSE pos + {w - 1} END AS BIGINT) AS smer_pos, {first} AS at_start "
        f"FROM w WHERE tail IS NOT NULL AND ({first} OR {last}) {skip})"
    )


def syncmers(p: Params, columns: str, letters: str = "acgt") -> str:
    return f"WITH {_closed(p, letters)} SELECT doc_id, {columns} FROM o"


def skip_last(p: Params) -> str:
    return f"WITH {_closed(p, 'acgt')} SELECT o.doc_id, pos FROM o JOIN s ON o.doc_id = s.doc_id WHERE pos + {p.k} < length(seq)"


def xor(p: Params) -> str:
    return f"WITH {_hashes(p, 'acgt')}, o AS (SELECT doc_id, {_signed(p)} AS hash FROM h) SELECT doc_id, bit_xor(hash) AS hashes FROM o GROUP BY doc_id"


FASTA = f"WITH {_seqs()} SELECT doc_id, 'a document' AS description, seq FROM s WHERE seq IS NOT NULL AND doc_id IS NOT NULL"

CONCATENATED = f"WITH {_seqs()} SELECT string_agg(seq, '' ORDER BY doc_id) AS seq FROM s WHERE length(seq) BETWEEN 1 AND 200 AND doc_id IS NOT NULL"

FASTQ = f"WITH {_seqs()} SELECT doc_id, seq, CAST(length(seq) AS INTEGER) AS n_qual FROM s WHERE seq IS NOT NULL AND doc_id IS NOT NULL"


def count(p: Params) -> str:
    return f"WITH {_closed(p, 'acgt')} SELECT d.doc_id, count(o.pos) AS n FROM documents d LEFT JOIN o ON o.doc_id = d.doc_id GROUP BY d.doc_id"


def strands(p: Params) -> str:
    return (
        f"WITH {_closed(p, 'acgt')} SELECT d.doc_id, count(*) FILTER (WHERE strand = 0) AS fw, count(*) FILTER (WHERE strand = 1) AS rc "
        "FROM documents d LEFT JOIN o ON o.doc_id = d.doc_id GROUP BY d.doc_id"
    )


def window_min(p: Params) -> str:
    run = "PARTITION BY doc_id ORDER BY pos"
    return (
        f"WITH {_hashes(p, 'acgt')}, w AS (SELECT doc_id, pos, n, min(hash) OVER ({run} ROWS BETWEEN CURRENT ROW AND {p.w - 1} FOLLOWING) AS low FROM h) "
        f"SELECT doc_id, CAST(pos AS BIGINT) AS pos, {_signed(p, 'low')} AS min_hash FROM w WHERE pos + {p.k} <= n"
    )


def array(p: Params) -> str:
    return f"WITH {_closed(p, 'acgt')} SELECT d.doc_id, count(o.pos) AS n, min(o.pos) AS first, max(o.pos) AS last FROM documents d LEFT JOIN o ON o.doc_id = d.doc_id GROUP BY d.doc_id"


def difference(exact: Params, near: Params) -> str:
    return f"SELECT a.doc_id, a.n AS exact_n, b.n AS approx_n, b.n - a.n AS diff FROM ({count(exact)}) a JOIN ({count(near)}) b ON a.doc_id = b.doc_id"


def counts_of_both(fw: Params, canonical: Params) -> str:
    return f"SELECT a.doc_id, a.n, b.n AS n_canonical FROM ({count(fw)}) a JOIN ({count(canonical)}) b ON a.doc_id = b.doc_id"
