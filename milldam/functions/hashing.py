"""Integer hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def linear(x: Column, a: int, b: int, modulus: int) -> Column:
    """(a * x + b) mod modulus, never negative."""
    return F.pmod(F.lit(a).cast("long") * x + F.lit(b).cast("long"), F.lit(modulus).cast("long"))


def bytes_residue(text: Column, modulus: int) -> Column:
    """The UTF-8 bytes of ``text`` as one big-endian integer, modulo ``modulus`` (< 2**55); 0 for the empty text.

    Works through the bytes once: no integer ever exceeds 256 * modulus.
    """
    code = F.hex(F.encode(text, "utf-8"))
    octets = F.sequence(F.lit(1), F.greatest(F.octet_length(text), F.lit(1)))
    digits = F.transform(octets, lambda i: F.coalesce(F.conv(F.nullif(F.substr(code, 2 * i - 1, F.lit(2)), F.lit("")), 16, 10).cast("long"), F.lit(0).cast("long")))
    return F.aggregate(digits, F.lit(0).cast("long"), lambda s, d: F.pmod(s * 256 + d, F.lit(modulus).cast("long")))


def digest_number(text: Column) -> Column:
    """The first 32 bits of the MD5 of ``text``; cheap, and the same in other engines."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def chars_residue(text: Column) -> Column:
    """The 32-bit string hash with base 31 over characters of the basic plane, signed."""
    n = F.char_length(text)
    codes = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.when(n > 0, F.ascii(F.substr(text, i, F.lit(1))).cast("long")).otherwise(F.lit(0).cast("long")))
    wide = F.aggregate(codes, F.lit(0).cast("long"), lambda s, c: F.pmod(s * 31 + c, F.lit(1 << 32).cast("long")))
    return F.when(wide >= 1 << 31, wide - (1 << 32)).otherwise(wide)


def lowest_bit(x: Column) -> Column:
    """2 to the number of trailing zero bits; 0 for 0."""
    return x.bitwiseAND(-x)
