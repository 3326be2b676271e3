"""Folds that undo disguises of text, as column expressions; each is applied on its own or in the order of normalized()."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Look-alikes of Latin letters, Cyrillic first, then Greek and full-width signs, and the letters they stand for.
ALIKE = "аеорсухіјѕԁһԛԝАВЕКМНОРСТХІЈЅ" + "αοριυνκτΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" + "＜＞：／．"
LATIN = "aeopcyxijsdhqwABEKMHOPCTXIJS" + "aopiuvktABEZHIKMNOPTYX" + "<>:/."
LEET, PLAIN = "013457@$!", "oieastasi"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&ndash;": "-", "&mdash;": "-", "&lsquo;": "'", "&rsquo;": "'", "&ldquo;": '"', "&rdquo;": '"', "&hellip;": "...", "&colon;": ":", "&sol;": "/", "&lpar;": "(", "&rpar;": ")", "&period;": ".", "&amp;": "&"}
#: Words that are put together again when their letters stand apart.
TOGETHER = ["ignore", "disregard", "forget", "previous", "instructions", "system", "transfer", "send", "password", "secret", "credentials", "wallet"]
INVISIBLE = "[\\x{00AD}\\x{180E}\\x{200B}-\\x{200F}\\x{2060}-\\x{2064}\\x{FEFF}\\x{FFF9}-\\x{FFFB}]"
SELECTORS = "[\\x{FE00}-\\x{FE0F}\\x{E0100}-\\x{E01EF}]"
TAGS = "[\\x{E0000}-\\x{E007F}]"
_TAG_SIGNS = "".join(chr(0xE0000 + i) for i in range(0x20, 0x7F))
_ASCII = "".join(map(chr, range(0x20, 0x7F)))


def held(value: Column, made: Callable[[Column], Column]) -> Column:
    """made(value) with the value computed once, however often made() uses it."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def wide(text: Column) -> Column:
    """Whether a text holds more than ASCII."""
    return F.octet_length(text) > F.length(text)


def replaced(text: Column, pattern: str, made: Callable[[Column], Column], group: int = 0) -> Column:
    """Text with each match put through made(); linear in the text, as matches and what lies between are joined once. The
    text is held, so that folds laid over each other are computed once each."""

    def whole(t: Column) -> Column:
        found = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(group)), made)
        zipped = F.arrays_zip(F.split(t, pattern, -1).alias("gap"), found.alias("found"))
        return F.when(t.rlike(pattern), F.array_join(F.transform(zipped, lambda p: F.concat(p["gap"], F.coalesce(p["found"], F.lit("")))), "")).otherwise(t)

    return held(text, whole)


def strip_wide(text: Column) -> Column:
    """Without characters that take no room: soft hyphens, joiners, marks of direction, annotation marks, selectors."""
    return held(text, lambda t: F.when(wide(t), F.regexp_replace(F.regexp_replace(t, INVISIBLE, ""), SELECTORS, "")).otherwise(t))


def hidden_tags(text: Column) -> Column:
    """What the tag characters of a text spell; empty without any."""
    return held(text, lambda t: F.when(wide(t), F.translate(F.regexp_replace(t, "[^\\x{E0020}-\\x{E007E}]", ""), _TAG_SIGNS, _ASCII)).when(t.isNotNull(), ""))


def character(code: Column) -> Column:
    """The character of a code point; empty where there is none."""
    fits = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(fits, F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")).otherwise(F.lit(""))


def entities(text: Column) -> Column:
    """Named and numeric references as characters; the ampersand last, so that nothing is decoded twice."""
    code = lambda x: F.when(F.lower(F.substring(x, 1, 1)) == "x", F.conv(F.substring(x, 2, 8), 16, 10)).otherwise(x).cast("long")
    numeric = lambda t: replaced(t, "&#([xX][0-9a-fA-F]{1,6}|[0-9]{1,7});", lambda x: character(code(x)), 1)
    named = lambda t: reduce(lambda a, e: F.replace(a, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), numeric(t))
    return held(text, lambda t: F.when(F.contains(t, F.lit("&")), named(t)).otherwise(t))


def look_alikes(text: Column) -> Column:
    return held(text, lambda t: F.when(wide(t), F.translate(t, ALIKE, LATIN)).otherwise(t))


def mixed_alikes(text: Column) -> Column:
    """look_alikes() where a text holds some, but no more than Latin letters; whole texts in another script stay."""
    n = F.regexp_count(text, F.lit(f"[{ALIKE[:50]}]"))
    return F.when((n > 0) & (n <= F.regexp_count(text, F.lit("[A-Za-z]"))), look_alikes(text)).otherwise(text)


def leet(text: Column) -> Column:
    """Digits and signs that stand for letters, in tokens of at least three signs that hold both; numbers and 0x stay."""
    token = "(?<![A-Za-z0-9@$!])(?=[A-Za-z]*[0-9@$!])(?=[0-9@$!]*[A-Za-z])[A-Za-z0-9@$!]{3,}+"
    return replaced(text, token, lambda x: F.when(x.rlike("^0[xX]"), x).otherwise(F.translate(x, LEET, PLAIN)))


def without_emphasis(text: Column) -> Column:
    """Without marks of emphasis around or inside words."""
    plain = lambda t: F.regexp_replace(F.regexp_replace(t, "\\*{1,3}|~~|`+", ""), "(?<![A-Za-z0-9])_{1,3}(?=\\S)|(?<=\\S)_{1,3}(?![A-Za-z0-9])", "")
    some = lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(m)) for m in ("*", "~~", "`", "_")])
    return held(text, lambda t: F.when(some(t), plain(t)).otherwise(t))


def together(text: Column) -> Column:
    """Telling words whose letters stand apart by up to two spaces, put together; no other words are joined."""
    return reduce(lambda t, w: F.regexp_replace(t, "(?i)\\b" + "[\\s\\x{A0}]{0,2}".join(w) + "\\b", w), TOGETHER, text)


def percent(text: Column) -> Column:
    """Percent codes as characters, a plus sign as it is; texts with a broken code stay as they are."""
    return F.when(F.contains(text, F.lit("%")), F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)).otherwise(text)


def normalized(text: Column) -> Column:
    """All folds that keep words where they are, in the order in which disguises are laid over each other."""
    return reduce(lambda t, fold: fold(t), [strip_wide, lambda t: held(t, lambda x: F.when(wide(x), F.regexp_replace(x, TAGS, "")).otherwise(x)), entities, look_alikes, leet, without_emphasis], text)


def host_of(destination: Column) -> Column:
    """The last two labels of an address's host, or of a mail address's domain; lower-case, empty without one."""
    host = F.lower(F.regexp_extract(destination, "(?://|@)([A-Za-z0-9.-]+)", 1))
    return F.array_join(F.slice(F.split(host, "\\."), F.greatest(F.size(F.split(host, "\\.")) - 1, F.lit(1)), 2), ".")


def whole_number(text: Column) -> Column:
    """Decimal digits without leading zeros, of a decimal or 0x number of any size that is whole; else null. Texts of
    up to 78 digits compare by number when padded."""
    t = F.trim(text.cast("string"))
    return F.when(t.rlike("^[0-9]{1,78}$"), F.regexp_replace(t, "^0+(?=[0-9])", "")).when(t.rlike("^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substring(t, 3, 15), 16, 10))


def padded(number: Column) -> Column:
    return F.lpad(number, 78, "0")


def address(text: Column) -> Column:
    """An account's address in lower case; null where it is none."""
    return F.when(F.trim(text).rlike("^0[xX][0-9a-fA-F]{40}$"), F.lower(F.trim(text)))


def chain_id(network: Column) -> Column:
    """The number of a network given as eip155:N or by name; null where it is unknown."""
    names = {"base": 8453, "base-sepolia": 84532, "polygon": 137, "avalanche": 43114, "ethereum": 1}
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.when(network.rlike("^eip155:[0-9]{1,12}$"), F.substring(network, 8, 12).cast("long")).otherwise(F.try_element_at(known, F.lower(network)).cast("long"))


def lane(network: Column) -> Column:
    """svm for networks named solana, evm for those with a chain number; null for others."""
    return F.when(network.rlike("(?i)^solana"), "svm").when(chain_id(network).isNotNull(), "evm")
