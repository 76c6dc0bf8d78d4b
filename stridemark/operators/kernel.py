"""Closed syncmers of many sequences at once, in numpy.

Sequences are concatenated. A rotation hash is a difference of prefix xors, each base rotated by
its place, so neither sequence ends nor rolling state matter: all hashes are a few passes over
arrays, and windows that span two sequences are masked at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from stridemark.functions.constants import MULTI_SEED, MULTI_SHIFT, MULTIPLY_ORDER, ROTATE_ORDER, ROTATION, SEEDS
from stridemark.params import Params

OTHER = 4


@lru_cache(maxsize=4)
def letter_codes(order: str, u_is_t: bool) -> np.ndarray:
    """Code of each byte, OTHER for what is no base."""
    out = np.full(256, OTHER, np.uint8)
    for i, c in enumerate(order):
        out[[ord(c), ord(c.upper())]] = i
    if u_is_t:
        out[[ord("u"), ord("U")]] = order.index("t")
    return out


@lru_cache(maxsize=8)
def periodic(step: int, first: int, bits: int, n: int) -> np.ndarray:
    """(first + step * m) mod bits for m below n: a pattern that repeats every ``bits`` places."""
    pattern = (first + step * np.arange(bits)) % bits
    return np.tile(pattern, n // bits + 1)[:n].astype(np.uint32 if bits == 32 else np.uint64)


def places(step: int, first: int, bits: int, n: int) -> np.ndarray:
    """As ``periodic``, from a longer pattern that later calls share."""
    return periodic(step, first % bits, bits, max(1 << 12, 1 << (n - 1).bit_length()))[:n]


def turn(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Each value rotated left."""
    kind = x.dtype.type
    bits = x.dtype.itemsize * 8
    back = np.bitwise_and(kind(bits) - r, kind(bits - 1))
    np.right_shift(x, back, out=back)
    back |= x << r
    return back


def prefix(codes: np.ndarray, table: np.ndarray, step: int, bits: int) -> np.ndarray:
    """Xor of the bases' seeds before each place, each rotated by step times its place."""
    out = np.zeros(len(codes) + 1, table.dtype)
    # a row of rotated seeds for each place of the period
    turned = turn(np.tile(table, bits), np.repeat((step * np.arange(bits)) % bits, len(table)).astype(table.dtype))
    which = np.resize(np.arange(bits, dtype=np.int16) * len(table), len(codes)) if len(codes) <= 4 * bits else tiled(bits, len(table), len(codes))
    np.bitwise_xor.accumulate(turned.take(which + codes), out=out[1:])
    return out


@lru_cache(maxsize=8)
def _tiled(bits: int, width: int, n: int) -> np.ndarray:
    return np.tile(np.arange(bits, dtype=np.int16) * width, n // bits + 1)[:n]


def tiled(bits: int, width: int, n: int) -> np.ndarray:
    return _tiled(bits, width, max(1 << 12, 1 << (n - 1).bit_length()))[:n]


def rotate_hashes(codes: np.ndarray, lengths: np.ndarray, p: Params, bits: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Forward and, if canonical, reverse hash of the s-mer at each place of sequences of these lengths."""
    kind = np.uint32 if bits == 32 else np.uint64
    fw_in = np.array([*SEEDS, 0], np.uint64).astype(kind)
    rc_in = np.array([*(SEEDS[i ^ 2] for i in range(4)), 0], np.uint64).astype(kind)
    n, s = len(codes), p.s
    size = n - s + 1
    if p.ambiguous == "compat_rolling" and (codes == OTHER).any():
        return _compat_hashes(codes, lengths, p, bits, fw_in, rc_in)
    x = prefix(codes, fw_in, -ROTATION, bits)
    fw = turn(x[s:] ^ x[:size], places(ROTATION, ROTATION * (s - 1), bits, size))
    if not p.canonical:
        return fw, None
    x = prefix(codes, rc_in, ROTATION, bits)
    return fw, turn(x[s:] ^ x[:size], places(-ROTATION, 0, bits, size))


def _compat_hashes(codes: np.ndarray, lengths: np.ndarray, p: Params, bits: int, fw_in: np.ndarray, rc_in: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """What a rolling hash becomes that ambiguous letters enter as nothing and leave as an a: in and out have prefixes of their own."""
    n, s = len(codes), p.s
    size = n - s + 1
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    base = starts[:size]
    fw_out, rc_out = fw_in.copy(), rc_in.copy()
    fw_out[OTHER] = fw_in[0]
    late = None
    if bits == 32:
        rc_in, rc_out = rc_in.copy(), rc_out
        rc_in[OTHER] = rc_out[OTHER] = rc_in[0]
    else:
        late = rc_in.copy()
        late[OTHER] = rc_in[0]
    at = lambda enters, leaves: enters[s:] ^ enters[base] ^ leaves[:size] ^ leaves[base]
    fw = turn(at(prefix(codes, fw_in, -ROTATION, bits), prefix(codes, fw_out, -ROTATION, bits)), places(ROTATION, ROTATION * (s - 1), bits, size))
    if not p.canonical:
        return fw, None
    enter, leave = prefix(codes, rc_in, ROTATION, bits), prefix(codes, rc_out, ROTATION, bits)
    if late is not None:
        seeds = np.where(np.arange(n) - starts >= s, late[codes], rc_in[codes])
        np.bitwise_xor.accumulate(turn(seeds, places(ROTATION, 0, bits, n)), out=enter[1:])
    return fw, turn(at(enter, leave), places(-ROTATION, 0, bits, size))


def multiply_hashes(codes: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """The 2-bit value of each s-mer and of its reverse complement, multiplied; the upper 2s bits."""
    n = len(codes) - p.s + 1
    c = codes.astype(np.uint64)
    own, other = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for j in range(p.s):
        own = (own << np.uint64(2)) | c[j : j + n]
        other |= (np.uint64(3) - c[j : j + n]) << np.uint64(2 * j)
    down = np.uint64(64 - 2 * p.s)
    return (own * np.uint64(p.factor)) >> down, (other * np.uint64(p.factor)) >> down


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, in log2(width) passes."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return x if done == width else np.minimum(x[: len(x) - (width - done)], x[width - done :])


@dataclass
class Found:
    """Rows of equal length: the sequence's number, k-mer place, strand, hash, s-mer place, whether it is the first."""

    seq: np.ndarray
    pos: np.ndarray
    strand: np.ndarray
    hash: np.ndarray
    smer: np.ndarray
    at_start: np.ndarray
    high: np.ndarray | None = None  # upper half of 128-bit hashes


@dataclass
class Smers:
    """Hashes of all places of the concatenated sequences, also of those that span two; what only hits need is looked up for them."""

    fw: np.ndarray
    rc: np.ndarray | None
    hash: np.ndarray
    rank: np.ndarray  # what is compared
    ends: np.ndarray  # of the sequences
    lengths: np.ndarray
    other: np.ndarray | None  # ambiguous letters before each place, if there are any
    params: Params
    high: np.ndarray | None = None

    def strand(self, at: np.ndarray) -> np.ndarray:
        if self.rc is None or not self.params.canonical or not self.params.track_strand:
            return np.zeros(len(at), np.int8)
        late = self.fw[at] >= self.rc[at] if self.params.hash == "multiply" else self.fw[at] > self.rc[at]
        return late.astype(np.int8)

    def within(self, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of rising places those whose ``size`` letters lie in one sequence and, if so asked, are bases: (place, sequence, place in it)."""
        if len(self.ends) == 1:
            at = at[: np.searchsorted(at, self.ends[0] - size, "right")]
            seq = np.zeros(len(at), np.int64)
        else:
            seq = np.searchsorted(self.ends, at, "right")
            keep = at + size <= self.ends[seq]
            at, seq = at[keep], seq[keep]
        if self.other is not None and self.params.ambiguous == "skip":
            keep = self.other[at + size] == self.other[at]
            at, seq = at[keep], seq[keep]
        return at, seq, at - (self.ends - self.lengths)[seq]


def smers(seqs: list[bytes], p: Params, long: np.ndarray | None = None) -> Smers | None:
    """None if there is no s-mer at all. ``long`` says which have 64 k-mers or more, if these are parts of longer ones."""
    lengths = np.array([len(x) for x in seqs], np.int64)
    joined = seqs[0] if len(seqs) == 1 else b"".join(seqs)
    if len(joined) < p.s:
        return None
    table = letter_codes(MULTIPLY_ORDER if p.hash == "multiply" else ROTATE_ORDER, p.hash == "multiply")
    codes = np.frombuffer(joined.translate(table.tobytes()), np.uint8)
    other = None
    if (odd := codes == OTHER).any():
        if p.ambiguous == "skip":
            other = np.zeros(len(codes) + 1, np.int64)
            np.cumsum(odd, out=other[1:])
        if p.ambiguous in ("as_a", "as_g") or p.hash == "multiply":
            codes = np.where(odd, 3 if p.ambiguous == "as_g" and p.hash == "rotate" else 2 if p.ambiguous == "as_g" else 0, codes).astype(np.uint8)
    high = None
    if p.hash == "multiply":
        fw, rc = multiply_hashes(codes, p)
        h = np.minimum(fw, rc) if p.canonical else fw
    else:
        fw, rc = rotate_hashes(codes, lengths, p, 64 if p.bits == 128 else p.bits)
        h = fw if rc is None else fw + rc if p.combine == "sum" else np.minimum(fw, rc)
    rank = h
    if p.bits == 128:
        high = h * np.uint64(1 ^ (p.s * MULTI_SEED & (1 << 64) - 1))
        high ^= high >> np.uint64(MULTI_SHIFT)
        order = np.lexsort((h, high))
        new = np.append(False, (h[order][1:] != h[order][:-1]) | (high[order][1:] != high[order][:-1]))
        rank = np.empty(len(h), np.int64)
        rank[order] = np.cumsum(new)
    elif p.low32:
        rank = h.astype(np.uint32)
    elif p.approx16:
        long = lengths - p.k + 1 >= 64 if long is None else long
        rank = (h >> np.uint32(16)).astype(np.uint16) if long.all() else np.where(np.repeat(long, lengths)[: len(h)], h >> np.uint32(16), h)
    return Smers(fw, rc, h, rank, np.cumsum(lengths), lengths, other, p, high)


def closed(a: Smers) -> tuple[np.ndarray, np.ndarray]:
    """Whether each window's smallest s-mer is its first, and whether it is its first or last, also for windows that span sequences."""
    p = a.params
    n = len(a.rank) - p.w + 1
    low = sliding_min(a.rank, p.w - 1)
    if p.tie == "left":
        first, last = a.rank[:n] <= low[1 : n + 1], a.rank[p.w - 1 :] < low[:n]
    else:
        first, last = a.rank[:n] < low[1 : n + 1], a.rank[p.w - 1 :] <= low[:n]
    return first, first | last


#: Bases that the kernel works on at a time: its arrays then stay in the cache.
PIECE = 1 << 16


def pieces(seqs: list[bytes], p: Params) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Sequences in groups of about PIECE bases: (parts, number of each one's sequence, its offset, whether the
    sequence is long and whether the part ends it). Longer ones are cut into parts that overlap by k - 1 bases."""
    rows: list[tuple[bytes, int, int, bool, bool]] = []
    size = 0
    for i, x in enumerate(seqs):
        long = len(x) - p.k + 1 >= 64
        if len(x) < 2 * PIECE or p.ambiguous == "compat_rolling":
            rows.append((x, i, 0, long, True))
            size += len(x)
        else:
            for at in range(0, len(x) - p.k + 1, PIECE):
                rows.append((x[at : at + PIECE + p.k - 1], i, at, long, at + PIECE + p.k - 1 >= len(x)))
                size += PIECE
                if size >= PIECE:
                    yield _columns(rows)
                    rows, size = [], 0
        if size >= PIECE:
            yield _columns(rows)
            rows, size = [], 0
    if rows:
        yield _columns(rows)


def _columns(rows: list[tuple]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    parts, *rest = zip(*rows, strict=True)
    return list(parts), *(np.array(x) for x in rest)


def _hits(a: Smers, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, part, place in it, whether the first) of each closed syncmer."""
    first, either = closed(a)
    at, part, pos = a.within(np.flatnonzero(either), a.params.k)
    if a.params.skip_last:
        keep = ~ends[part] | (pos + a.params.k < a.lengths[part])
        at, part, pos = at[keep], part[keep], pos[keep]
    return at, part, pos, first[at]


def syncmers(seqs: list[bytes], p: Params) -> Found:
    """Closed syncmers of all sequences, in order. Sequences shorter than k have none."""
    found: list[tuple[np.ndarray, ...]] = []
    for parts, number, offset, long, ends in pieces(seqs, p):
        a = smers(parts, p, long)
        if a is None or len(a.rank) < p.w:
            continue
        at, part, pos, first = _hits(a, ends)
        step = np.where(first, 0, p.w - 1)
        smallest, pos = at + step, pos + offset[part]
        found.append((number[part], pos, a.strand(smallest), a.hash[smallest], pos + step, first, a.hash[:0] if a.high is None else a.high[smallest]))
    if not found:
        return Found(*[np.zeros(0, np.int64)] * 6, high=np.zeros(0, np.uint64))
    *columns, high = (np.concatenate(x) for x in zip(*found, strict=True))
    return Found(*columns, high if p.bits == 128 else None)


def counts(seqs: list[bytes], p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Of each sequence the number of its syncmers, and of those on the reverse strand; positions are not made for them."""
    n, late = np.zeros(len(seqs), np.int64), np.zeros(len(seqs), np.int64)
    for parts, number, _, long, ends in pieces(seqs, p):
        a = smers(parts, p, long)
        if a is None or len(a.rank) < p.w:
            continue
        if p.canonical and p.track_strand:
            at, part, _, first = _hits(a, ends)
            np.add.at(n, number, np.bincount(part, minlength=len(parts)))
            reverse = a.strand(at + np.where(first, 0, p.w - 1)).astype(bool)
            np.add.at(late, number, np.bincount(part[reverse], minlength=len(parts)))
            continue
        _, either = closed(a)
        if a.other is not None and p.ambiguous == "skip":
            either &= a.other[p.k : p.k + len(either)] == a.other[: len(either)]
        last = a.ends - p.k + 1 - (p.skip_last * ends)
        for i, lo, hi in zip(number.tolist(), (a.ends - a.lengths).tolist(), last.tolist(), strict=True):
            if hi > lo:
                n[i] += np.count_nonzero(either[lo:hi])
    return n, late
