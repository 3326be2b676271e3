"""Whole numbers and signatures in bytes and hex texts, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The order of the curve secp256k1, and half of it.
ORDER = "fffffffffffffffffffffffffffffffebaaedce6af48a03bbfd25e8cd0364141"
HALF = "7fffffffffffffffffffffffffffffff5d576e7357a4501ddfe92f46681b20a0"


def little_endian(data: Column, offset: int, width: int) -> Column:
    """An unsigned whole number of `width` bytes (8 at most) at an offset, least byte first, as decimal(20,0); null if the
    bytes end before it."""
    word = F.lower(F.hex(F.substring(data, offset + 1, width)))
    turned = F.concat(*[F.substring(word, 2 * i + 1, 2) for i in reversed(range(width))])
    return F.when(F.octet_length(data) >= offset + width, F.conv(turned, 16, 10).cast("decimal(20,0)"))


def normal_signature(text: Column) -> Column:
    """A signature of 65 bytes (r, s, v) or 64 (v in the top bit of s) in hex behind 0x as 65 bytes in lower case with v 27 or
    28; null for other texts, r or s out of range, the upper one of two equivalent s, and other v."""
    t = F.lower(F.when(text.rlike("^0[xX]([0-9a-fA-F]{2}){64,65}$"), F.substring(text, 3, 130)))
    compact = F.length(t) == 128
    r, word = F.substring(t, 1, 64), F.substring(t, 65, 64)
    top = F.conv(F.substring(word, 1, 1), 16, 10).cast("int")
    s = F.when(compact, F.concat(F.lower(F.hex((top % 8).cast("long"))), F.substring(word, 2, 63))).otherwise(word)
    last = F.conv(F.substring(t, 129, 2), 16, 10).cast("int")
    v = F.when(compact, F.when(top >= 8, 28).otherwise(27)).otherwise(F.when(last < 2, last + 27).otherwise(last))
    zero = "0" * 64
    good = v.isin(27, 28) & (r > zero) & (r < ORDER) & (s > zero) & (s <= HALF)
    return F.when(good, F.concat(F.lit("0x"), r, s, F.lower(F.hex(v.cast("long")))))
