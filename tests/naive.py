"""The definition of closed syncmers, base by base, to hold the engine against."""

SEED = {"a": 0x3C8BFBB395C60474, "c": 0x3193C18562A02B4C, "t": 0x20323ED082572324, "g": 0x295549F54BE24456}
OTHER = {"a": "t", "c": "g", "g": "c", "t": "a"}


def rotl(x, r, b):
    r %= b
    return ((x << r) | (x >> (b - r))) & ((1 << b) - 1) if r else x


def hashes(seq, s, bits, canonical=False, combine="min"):
    """(hash, strand) of each s-mer; letters that are no base add nothing."""
    seq, mask, out = seq.lower(), (1 << bits) - 1, []
    for i in range(len(seq) - s + 1):
        fw = rc = 0
        for j in range(s):
            c = seq[i + j]
            fw ^= rotl(SEED.get(c, 0) & mask, 7 * (s - 1 - j), bits)
            rc ^= rotl(SEED.get(OTHER.get(c), 0) & mask, 7 * j, bits)
        strand = int(canonical and fw > rc)
        out.append(((fw + rc & mask) if canonical and combine == "sum" else min(fw, rc) if canonical else fw, strand))
    return out


def syncmers(seq, k, s, bits=32, canonical=False, approx16=False, tie="left"):
    """(pos, strand) of each closed syncmer; k-mers with letters that are no base are skipped."""
    h = hashes(seq, s, bits, canonical)
    rank = [x >> 16 if approx16 and len(seq) - k + 1 >= 64 else x for x, _ in h]
    w, out = k - s + 1, []
    for i in range(len(seq) - k + 1):
        if set(seq[i : i + k].lower()) - set("acgt"):
            continue
        window = rank[i : i + w]
        low = min(window)
        at = window.index(low) if tie == "left" else w - 1 - window[::-1].index(low)
        if at in (0, w - 1):
            out.append((i, h[i + at][1]))
    return out


def rolling(seq, s, bits):
    """(forward, reverse) hashes of a rolling hash that ambiguous letters enter as nothing and leave as an a.

    Of the reverse hashes, that of 32 bits reads them as an a at both ends; that of 64 bits lets them
    enter as nothing in the first window, later as an a, and leave as nothing.
    """
    mask, out = (1 << bits) - 1, []
    fwd = lambda c: SEED.get(c, 0) & mask
    rev = lambda c: SEED[OTHER[c]] & mask if c in OTHER else 0
    as_a = lambda c: c if c in SEED else "a"
    fw = rc = 0
    for i, c in enumerate(seq):
        left = seq[i - s] if i >= s else None
        if left is not None:
            fw ^= rotl(fwd(as_a(left)), 7 * (s - 1), bits)
        fw = rotl(fw, 7, bits) ^ fwd(c)
        enters = rev(as_a(c)) if bits == 32 or i >= s else rev(c)
        leaves = 0 if left is None else rev(as_a(left)) if bits == 32 else rev(left)
        if i < s:
            rc ^= rotl(enters, 7 * i, bits)
        else:
            rc = rotl(rc ^ leaves, bits - 7, bits) ^ rotl(enters, 7 * (s - 1), bits)
        if i >= s - 1:
            out.append((fw, rc))
    return out


def wide(seq, s):
    """128-bit hashes: the 64-bit canonical hash, below the second of the published multi-hash."""
    out = []
    for h, _ in hashes(seq, s, 64, True):
        second = h * (1 ^ s * 0x90B45D39FB6DA1FA) & (1 << 64) - 1
        out.append((second ^ second >> 27) << 64 | h)
    return out
