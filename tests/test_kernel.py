import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from naive import hashes, rolling, syncmers, wide

from stridemark.operators import kernel
from stridemark.params import Params

DNA = st.text("acgtACGT", max_size=160)


def found(seq, p):
    f = kernel.syncmers([seq.encode()], p)
    return list(zip(f.pos.tolist(), f.strand.tolist(), strict=True))


@settings(max_examples=150, deadline=None)
@given(DNA, st.integers(2, 40), st.integers(1, 39), st.booleans(), st.sampled_from([32, 64]), st.sampled_from(["left", "right"]))
def test_equals_the_definition(seq, k, s, canonical, bits, tie):
    if s >= k:
        return
    assert found(seq, Params(k, s, canonical=canonical, bits=bits, tie=tie)) == syncmers(seq, k, s, bits, canonical, tie=tie)


@settings(max_examples=60, deadline=None)
@given(st.text("acgtn", max_size=120), st.booleans())
def test_skips_kmers_with_other_letters(seq, canonical):
    assert found(seq, Params(11, 5, canonical=canonical)) == syncmers(seq, 11, 5, 32, canonical)


@pytest.mark.parametrize("s", [1, 32, 33, 65])
def test_rotations_by_whole_words(s):
    seq = "".join(random.Random(s).choices("acgt", k=200))
    for bits in (32, 64):
        a = kernel.smers([seq.encode()], Params(s + 5, s, bits=bits, canonical=True))
        assert list(zip(a.hash.tolist(), a.strand(np.arange(len(a.hash))).tolist(), strict=True)) == hashes(seq, s, bits, True)


def test_top_16_bits_from_64_kmers_on():
    r = random.Random(2)
    for n in (92, 93, 94, 95, 400):
        seq = "".join(r.choice("ac") for _ in range(n))
        assert found(seq, Params(31, 15, approx16=True)) == syncmers(seq, 31, 15, approx16=True)


def test_known_counts_of_repeats():
    # strings of repeats and their counts, in 32 and 64 bits, forward and canonical
    pal, py32 = "ACGT" * 12, "ACGT" * 8
    count = lambda s, k, m, **x: len(found(s, Params(k, m, **x)))
    assert [count(pal, 31, 15), count(pal, 31, 15, canonical=True), count(pal, 31, 15, bits=64), count(pal, 31, 15, bits=64, canonical=True)] == [5, 10, 5, 10]
    assert [count(py32, 15, 8), count(py32, 15, 8, canonical=True), count(py32, 15, 8, bits=64), count(py32, 15, 8, bits=64, canonical=True)] == [5, 5, 5, 9]


def test_homopolymers_and_two_smers_are_all_closed():
    assert found("a" * 50, Params(31, 15)) == [(i, 0) for i in range(20)]
    assert len(found("acgtacgattagc", Params(5, 4))) == 9


def test_short_null_and_empty():
    for seq in ("", "acg", "a" * 30):
        assert found(seq, Params(31, 15)) == []
    assert len(kernel.syncmers([b"", b"", b""], Params(31, 15)).pos) == 0


def test_batches_equal_single_sequences():
    r = random.Random(5)
    seqs = ["".join(r.choice("acgtn") for _ in range(r.choice([0, 3, 31, 100, 300]))) for _ in range(60)]
    for p in (Params(31, 15), Params(21, 11, canonical=True, bits=64), Params(21, 11, canonical=True, bits=64, ambiguous="compat_rolling"), Params(31, 15, ambiguous="compat_rolling", canonical=True)):
        f = kernel.syncmers([s.encode() for s in seqs], p)
        got = [[] for _ in seqs]
        for i, pos, strand in zip(f.seq.tolist(), f.pos.tolist(), f.strand.tolist(), strict=True):
            got[i].append((pos, strand))
        assert got == [found(s, p) for s in seqs]


def test_rolling_compatibility_mode_follows_a_rolling_hash():
    from naive import SEED, rotl

    r = random.Random(6)
    for _ in range(50):
        seq, s = "".join(r.choice("acgtnacgt") for _ in range(60)), 7
        h, out = 0, []
        for i, c in enumerate(seq):
            if i >= s:
                left = seq[i - s] if seq[i - s] != "n" else "a"
                h ^= rotl(SEED[left] & 0xFFFFFFFF, 7 * (s - 1), 32)
            h = rotl(h, 7, 32) ^ (SEED.get(c, 0) & 0xFFFFFFFF)
            if i >= s - 1:
                out.append(h)
        a = kernel.smers([seq.encode()], Params(11, s, ambiguous="compat_rolling"))
        assert a.hash.tolist() == out


def test_mirror_without_ties():
    r = random.Random(7)
    swap = str.maketrans("acgt", "tgca")
    for _ in range(20):
        seq = "".join(r.choice("acgt") for _ in range(300))
        p = Params(31, 15, canonical=True, bits=64)
        there, back = found(seq, p), found(seq.translate(swap)[::-1], p)
        assert sorted(len(seq) - 31 - x for x, _ in back) == [x for x, _ in there]


def test_multiplied_hash():
    r = random.Random(8)
    seq, s, factor = "".join(r.choice("acgt") for _ in range(200)), 9, 0x9E3779B97F4A7C15
    value = lambda x: int("".join(str("acgt".index(c)) for c in x), 4)
    one = lambda v: (v * factor & (1 << 64) - 1) >> (64 - 2 * s)
    swap = str.maketrans("acgt", "tgca")
    expected = []
    for i in range(len(seq) - s + 1):
        fw, rc = one(value(seq[i : i + s])), one(value(seq[i : i + s].translate(swap)[::-1]))
        expected.append((min(fw, rc), int(fw >= rc)))
    a = kernel.smers([seq.encode()], Params(15, s, canonical=True, hash="multiply"))
    assert list(zip(a.hash.tolist(), a.strand(np.arange(len(a.hash))).tolist(), strict=True)) == expected
    assert kernel.smers([b"ACGU" * 9], Params(15, s, hash="multiply")).hash.tolist() == kernel.smers([b"acgt" * 9], Params(15, s, hash="multiply")).hash.tolist()


@pytest.mark.parametrize("bits", [32, 64])
@pytest.mark.parametrize("canonical", [False, True])
def test_rolling_compatibility_on_both_strands(bits, canonical):
    r = random.Random(16)
    for _ in range(60):
        seq, s = "".join(r.choice("acgtnacgt") for _ in range(r.randint(9, 90))), r.choice([3, 7, 9])
        want = rolling(seq, s, bits)
        a = kernel.smers([b"ac", seq.encode()], Params(s + 4, s, bits=bits, canonical=canonical, ambiguous="compat_rolling"))
        assert a.hash[2:].tolist() == [min(x) if canonical else x[0] for x in want]
        assert a.strand(np.arange(len(a.hash)))[2:].tolist() == [int(canonical and x[0] > x[1]) for x in want]


def test_wide_hashes_sort_by_their_upper_half():
    seq = "".join(random.Random(9).choices("acgt", k=500))
    a = kernel.smers([seq.encode()], Params(31, 15, bits=128, canonical=True))
    got = [(int(x) << 64) | int(y) for x, y in zip(a.high, a.hash, strict=True)]
    assert got == wide(seq, 15)
    assert np.argsort(a.rank, kind="stable").tolist() == sorted(range(len(got)), key=lambda i: (got[i], i))


@pytest.mark.parametrize("p", [Params(31, 15), Params(21, 11, canonical=True, bits=64), Params(31, 15, approx16=True), Params(31, 15, skip_last=True), Params(31, 15, bits=128)])
def test_pieces_of_long_sequences_add_up(monkeypatch, p):
    r = random.Random(11)
    seqs = ["".join(r.choice("acgt" * 20 + "n") for _ in range(n)).encode() for n in (10, 3000, 90, 5000, 0, 1024, 2048 + 30)]
    whole, n = kernel.syncmers(seqs, p), kernel.counts(seqs, p)
    monkeypatch.setattr(kernel, "PIECE", 512)
    cut = kernel.syncmers(seqs, p)
    for x in ("seq", "pos", "strand", "hash", "smer", "at_start"):
        assert (getattr(cut, x) == getattr(whole, x)).all() and len(cut.pos) > 300
    assert all((x == y).all() for x, y in zip(kernel.counts(seqs, p), n, strict=True)) and n[0].sum() == len(whole.pos) and n[1].sum() == whole.strand.sum()


def test_density_is_about_two_of_a_window():
    seq = "".join(random.Random(10).choices("acgt", k=100_000))
    assert abs(len(found(seq, Params(31, 15))) / 100_000 - 2 / 17) < 0.004


@pytest.mark.parametrize("bad", [{"k": 5, "s": 5}, {"k": 5, "s": 0}, {"k": 5, "s": 3, "bits": 16}, {"k": 40, "s": 33, "hash": "multiply"}, {"k": 5, "s": 3, "tie": "none"}])
def test_wrong_parameters_fail_on_the_driver(bad):
    with pytest.raises(ValueError):
        Params(**bad)
