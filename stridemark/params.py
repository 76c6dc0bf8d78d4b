"""Parameters of a closed-syncmer sketch."""

from __future__ import annotations

from dataclasses import dataclass

AMBIGUOUS = ("skip", "as_a", "as_g", "zero", "compat_rolling")


@dataclass(frozen=True)
class Params:
    """Which k-mers are closed syncmers: those whose smallest s-mer, by hash, is their first or last.

    k, s: length of k-mers and s-mers, 1 <= s < k.
    canonical: an s-mer's hash is the smaller of its own and its reverse complement's.
    combine: "min", or "sum" for the wrapped sum of the two hashes (32 bits only).
    bits: 32, 64 or 128 for rotation hashes; 128 extends the 64-bit hash by the published second hash.
    approx16: compare the upper 16 of 32 bits only, in sequences with 64 k-mers or more.
    low32: compare the lower 32 of 64 bits only.
    tie: which of equal s-mers is the smallest, "left" or "right".
    hash: "rotate" or "multiply" (2-bit value times ``factor``, s <= 31; u counts as t).
    ambiguous: what other letters than acgt (any case) are: "skip" drops every k-mer with one,
        "as_a" and "as_g" read them as that base, "zero" lets them add nothing, and
        "compat_rolling" lets them enter a rolling hash as nothing and leave it as an a.
    track_strand: False gives strand 0 for all.
    skip_last: the k-mer that ends a sequence is not tested, so a sequence of k bases has none.
    """

    k: int
    s: int
    canonical: bool = False
    bits: int = 32
    approx16: bool = False
    low32: bool = False
    combine: str = "min"
    tie: str = "left"
    hash: str = "rotate"
    factor: int = 0x9E3779B97F4A7C15
    ambiguous: str = "skip"
    track_strand: bool = True
    skip_last: bool = False

    def __post_init__(self):
        if not 1 <= self.s < self.k:
            raise ValueError(f"1 <= s < k is needed, not s={self.s}, k={self.k}")
        if self.bits not in (32, 64, 128):
            raise ValueError("bits is 32, 64 or 128")
        if self.hash not in ("rotate", "multiply") or self.tie not in ("left", "right") or self.combine not in ("min", "sum"):
            raise ValueError("hash is rotate or multiply, tie is left or right, combine is min or sum")
        if self.ambiguous not in AMBIGUOUS:
            raise ValueError(f"ambiguous is one of {', '.join(AMBIGUOUS)}")
        if self.hash == "multiply" and (self.s > 31 or not self.factor & 1):
            raise ValueError("a multiplied hash needs s <= 31 and an odd factor")
        if self.hash == "multiply" and self.ambiguous in ("zero", "compat_rolling"):
            raise ValueError("a multiplied hash has no rolling ambiguity modes")
        if self.approx16 and (self.bits != 32 or self.hash != "rotate"):
            raise ValueError("approx16 is for 32-bit rotation hashes")
        if self.low32 and self.bits != 64:
            raise ValueError("low32 is for 64-bit hashes")
        if self.combine == "sum" and not (self.canonical and self.bits == 32):
            raise ValueError("sum is for canonical 32-bit hashes")

    @property
    def w(self) -> int:
        """s-mers of a k-mer."""
        return self.k - self.s + 1
