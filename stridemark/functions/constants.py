"""Values that results depend on."""

# The published 64-bit ntHash seeds of a, c, t and g, in the order of their 2-bit codes.
# The 32-bit hash takes their lower halves; a base's complement has its code xor 2.
SEEDS = (0x3C8BFBB395C60474, 0x3193C18562A02B4C, 0x20323ED082572324, 0x295549F54BE24456)
ROTATION = 7
# The published multi-hash constants, for the second of two hashes.
MULTI_SEED, MULTI_SHIFT = 0x90B45D39FB6DA1FA, 27
#: Letters in the order of their codes, for rotated and for multiplied hashes.
ROTATE_ORDER, MULTIPLY_ORDER = "actg", "acgt"
