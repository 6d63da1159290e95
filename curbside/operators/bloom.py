"""A Bloom filter as a Spark expression, which every scan evaluates where it reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

#: Bits for each key and positions that a key sets: one key in some four thousand passes by chance.
BITS_PER_KEY, POSITIONS = 32, 4
#: Bytes of the largest filter, which is a literal of the plan. It serves some 115,000 keys in full
#: and lets more pass beyond; with more than four times as many there is none, and everything passes.
MOST_BYTES = 1 << 19


def _places(key: Column, size: int) -> list[tuple[Column, Column]]:
    """(byte, bit) of each position of a key: seven bits of a byte are used, so that it is an ASCII character."""
    out = []
    for mixed in (key, F.xxhash64(key), F.xxhash64(F.lit(2), key), F.xxhash64(F.lit(3), key))[:POSITIONS]:
        out.append((mixed.bitwiseAND(F.lit(size - 1).cast("bigint")).cast("int"), F.pmod(F.shiftright(mixed, 40), F.lit(7)).cast("int")))
    return out


def might_contain(keys: DataFrame, column: str, n: int) -> Callable[[Column], Column]:
    """A test of 64-bit hashes: true for each of the ``n`` keys in ``column``, and seldom for others."""
    size = 512
    while size * 7 < n * BITS_PER_KEY and size < MOST_BYTES:
        size *= 2
    if size * 7 * 4 < n * BITS_PER_KEY:
        return lambda key: key.isNotNull()
    places = F.explode(F.array(*[F.struct(byte.alias("byte"), bit.alias("bit")) for byte, bit in _places(F.col(column), size)])).alias("p")
    one = F.call_function("shiftleft", F.lit(1), F.col("p.bit"))
    bits = bytearray(size)
    for r in keys.select(places).groupBy("p.byte").agg(F.bit_or(one).alias("bits")).collect():  # MOST_BYTES rows at most
        bits[r["byte"]] = r["bits"]
    held = F.lit(bytes(bits))

    def might(key: Column) -> Column:
        tests = [F.getbit(F.ascii(F.substring(held, byte + 1, F.lit(1)).cast("string")), bit) == 1 for byte, bit in _places(key, size)]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out

    return might
