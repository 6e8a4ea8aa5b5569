"""HTML-entity and percent decoding, Unicode clean-up; all JVM-side expressions."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

_TOKEN = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)|[^&]+|&"


def _quote_all(names: list[str]) -> str:
    return "|".join(sorted(names, key=len, reverse=True))


# Names that HTML also accepts without a closing semicolon.
_BARE_NAMES = _quote_all([n for n in html5 if not n.endswith(";")])


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _code_point(token: Column) -> Column:
    """Number in a numeric reference; anything past Unicode becomes U+FFFD."""
    hex_digits = F.regexp_extract(token, "^&#[xX]0*([0-9a-fA-F]*)", 1)
    decimal = F.regexp_extract(token, "^&#0*([0-9]*)", 1)
    is_hex = F.lower(F.substring(token, 3, 1)) == "x"

    def number(digits: Column) -> Column:
        value = F.when(is_hex, F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint")
        return F.when(F.length(digits) > 8, F.lit(0x110000)).otherwise(F.coalesce(value, F.lit(0)))

    def legal(value: Column) -> Column:
        bad = (value == 0) | (value > 0x10FFFF) | value.between(0xD800, 0xDFFF)
        return F.when(bad, F.lit(0xFFFD)).otherwise(value)

    return _let(_let(F.when(is_hex, hex_digits).otherwise(decimal), number), legal)


# What the numbers 128-159 stand for on the web.
_WINDOWS = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0))


def _numeric_reference(token: Column) -> Column:
    def char(cp: Column) -> Column:
        dropped = (
            cp.between(0x1, 0x8) | cp.between(0xE, 0x1F) | cp.isin(0xB, 0x7F)
            | cp.between(0xFDD0, 0xFDEF) | (cp.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
        )
        return (
            F.when(cp.between(0x80, 0x9F), F.substring(F.lit(_WINDOWS), (cp - 0x7F).cast("int"), F.lit(1)))
            .when(dropped, F.lit(""))
            .otherwise(F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32"))
        )

    return _let(_code_point(token), char)


_ENTRY, _VALUE = "\u0001", "\u0002"
# Named references as one text of (entry mark, name, value mark, characters). A text
# constant keeps the plan small; a constant map of this size slows every planning step.
_ENTITIES = "".join(f"{_ENTRY}{name}{_VALUE}{chars}" for name, chars in html5.items())


def _entity(name: Column) -> Column:
    """Characters of a reference name, NULL when unknown."""
    after = F.call_function("substring_index", F.lit(_ENTITIES), F.concat(F.lit(_ENTRY), name, F.lit(_VALUE)), F.lit(-1))
    return F.nullif(F.substring_index(after, _ENTRY, 1), F.lit(""))


def _named_reference(token: Column) -> Column:
    """Character of a named reference, or the token as it stands.

    Plain query text such as ``&page=1`` must stay cheap: the table is searched only for
    a token with a semicolon at its end or a name that needs none at its start (the
    longest such name counts, and text may follow it).
    """
    open_name = F.regexp_extract(token, f"^&({_BARE_NAMES})", 1)
    whole = F.when(token.rlike("^&[A-Za-z0-9]+;$"), _entity(F.substring(token, 2, 64)))
    rest = F.substring(token, F.length(open_name) + 2, F.lit(64))
    return F.coalesce(whole, F.when(open_name != "", F.concat(_entity(open_name), rest)), token)


def html_unescape(text: Column) -> Column:
    def one(token: Column) -> Column:
        return (
            F.when(token.rlike("^&#(?:[0-9]|[xX][0-9a-fA-F])"), _numeric_reference(token))
            .when(token.rlike("^&[^\\t\\n\\f <&#;]"), _named_reference(token))
            .otherwise(token)
        )

    decoded = F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"(?s){_TOKEN}"), F.lit(0)), one), "")
    return F.when(text.contains("&"), decoded).otherwise(text)


def percent_decode(text: Column) -> Column:
    """Lenient percent decoding; ``+`` stays as it is."""
    kept = F.replace(text, F.lit("+"), F.lit("%2B"))
    escaped = F.regexp_replace(kept, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(text.contains("%"), F.coalesce(F.try_url_decode(escaped), text)).otherwise(text)


def decode_rounds(text: Column, rounds: int = 5, plus_first: bool = False) -> Column:
    """Repeated entity + percent decoding until the text stops changing.

    Returns ``struct(text, depth, limit_reached)``. With ``plus_first`` a ``+`` means a
    space in round one. All rounds are one ``aggregate`` expression, and rows that hold
    nothing to decode skip it. One round more than allowed tells whether the limit cut
    decoding short.
    """
    def step(acc: Column, i: Column) -> Column:
        opened = html_unescape(acc["text"])
        if plus_first:
            opened = F.when(i == 1, F.replace(opened, F.lit("+"), F.lit(" "))).otherwise(opened)

        def judge(new: Column) -> Column:
            changed = new != acc["text"]
            return F.struct(
                F.when(i <= rounds, new).otherwise(acc["text"]).alias("text"),
                (acc["depth"] + F.when(changed & (i <= rounds), 1).otherwise(0)).alias("depth"),
                (changed & (i > rounds)).alias("limit_reached"), (~changed).alias("done"))

        return F.when(acc["done"], acc).otherwise(_let(_let(opened, percent_decode), judge))

    value = F.coalesce(text, F.lit(""))
    no = F.lit(False)
    start = F.struct(value.alias("text"), F.lit(0).alias("depth"), no.alias("limit_reached"), no.alias("done"))
    loop = F.aggregate(F.sequence(F.lit(1), F.lit(rounds + 1)), start, step)
    return F.when(value.rlike("[%&+]" if plus_first else "[%&]"), loop).otherwise(start)


@lru_cache(maxsize=1)
def _compat_pairs() -> tuple[str, str]:
    """Characters whose compatibility form is one other character, from Unicode data."""
    src, dst = [], []
    for cp in range(0xA0, sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        c = chr(cp)
        n = unicodedata.normalize("NFKC", c)
        if n != c and len(n) == 1:
            src.append(c)
            dst.append(n)
    return "".join(src), "".join(dst)


def compat_fold(text: Column) -> Column:
    """One-to-one part of NFKC (full-width forms, styled letters, no-break space)."""
    src, dst = _compat_pairs()
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, src, dst)).otherwise(text)


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Whole NFKC through Arrow, for callers that need ligatures and composition."""
    return text.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


# Control and format characters that get removed, and the spaces left to collapse.
CONTROL = r"[\p{Cc}\p{Cf}]"
SPACES = r"[ \u1680\u2028\u2029]+"


def clean_unicode(text: Column, full_nfkc: bool = False) -> Column:
    """Folded, lower-cased text; controls still inside."""
    return F.lower(nfkc(text) if full_nfkc else compat_fold(text))


def drop_controls(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, CONTROL, ""), SPACES, " "))
