"""Texts out of the bytes that transactions carry, and texts made harmless before they are scanned."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrel import lexicon as L

#: Fewest characters, and bytes, of carried data that may be a message.
LEAST = 24
WHITE = " \t\n\r\x0b\x0c"
# Fixed value: the alphabet of base 58, in which 0, I, O and l do not occur.
ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def calldata(data: Column) -> Column:
    """The message in hex digits (0x may stand before them), or null: an odd number of digits, fewer than LEAST bytes or
    characters, and bytes that are not UTF-8, with or without zeros at their end, are none."""
    digits = F.when(F.startswith(data, F.lit("0x")), F.substring(data, 3, F.length(data))).otherwise(data)
    raw = F.when(digits.rlike("^[0-9A-Fa-f]+$") & (F.length(digits) % 2 == 0), F.unhex(digits)).cast("binary")
    whole = raw.cast("string")
    text = F.when(F.is_valid_utf8(whole), whole)
    # zeros at the end are valid UTF-8 themselves, so cutting them off never makes other bytes valid
    plain = F.trim(F.replace(text, F.lit("\0"), F.lit("")), F.lit(WHITE))
    return F.when((F.octet_length(raw) >= LEAST) & (F.length(plain) >= LEAST), plain)


@F.pandas_udf(T.BinaryType())
def base58(texts: pd.Series) -> pd.Series:
    """Bytes of base-58 digits, each leading 1 a zero byte; null for null and for other characters. Numbers of this size
    need whole-number arithmetic that columns lack."""
    worth = {c: i for i, c in enumerate(ALPHABET)}

    def one(text: str | None) -> bytes | None:
        if text is None or not all(c in worth for c in text):
            return None
        number = 0
        for c in text:
            number = number * 58 + worth[c]
        return b"\0" * (len(text) - len(text.lstrip("1"))) + number.to_bytes((number.bit_length() + 7) // 8, "big")

    return texts.map(one)


def instruction_text(data: Column, longest: int = 4096) -> Column:
    """The memo in an instruction's raw data: base 58, else base 64; bytes that are not UTF-8 are replaced. Texts of more
    than `longest` digits, which no transaction can hold, are read as base 64 only, as base 58 takes time by their square."""
    digits = F.when(F.length(data) <= longest, data)
    raw = F.coalesce(base58(digits), F.try_to_binary(data, F.lit("base64")))
    text = F.trim(F.make_valid_utf8(raw.cast("string")), F.lit(WHITE))
    return F.when(text != "", text)


def disarmed(text: Column) -> Column:
    """(text, armed): directives that would suppress findings lose their meaning, and whether there was any."""
    word = "(?i)scan-allow(?=:)"
    return F.struct(F.regexp_replace(text, word, "scan․allow").alias("text"), F.coalesce(F.lower(text).rlike(L.SUPPRESS), F.lit(False)).alias("armed"))
