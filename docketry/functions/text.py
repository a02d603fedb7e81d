"""Text rules as column expressions.

Everything here is built from JVM-side functions, so it stays inside whole-stage code generation.
The only Python function is ``fold_exact``, the full Unicode variant of the folding key.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed value: the characters a browser strips in ``trim`` and matches with ``\s``.
BLANKS = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# The same set for use inside a regex character class.
WS = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"

TITLE_MAX = 96


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body`` of a value that it uses more than once, with the value computed once.

    An expression is a tree, so naming a long one twice doubles it; this keeps it a single node.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c) -> Column:
    """Trim every Unicode blank at both ends (plain ``trim`` only drops spaces)."""
    return F.trim(col(c), F.lit(BLANKS))


def rstrip(c) -> Column:
    return F.rtrim(col(c), F.lit(BLANKS))


def text(c) -> Column:
    """NULL becomes the empty string, then both ends are stripped."""
    return strip(F.coalesce(col(c).cast("string"), F.lit("")))


def filled(c) -> Column:
    """Stripped text, NULL when nothing is left: ``filled(x)`` is the "has content" value."""
    return F.nullif(text(c), F.lit(""))


def or_default(c, *fallbacks) -> Column:
    """First value with content; a string fallback is a literal."""
    return F.coalesce(filled(c), *[F.lit(f) if isinstance(f, str) else f for f in fallbacks])


def squeeze(c) -> Column:
    """Runs of blanks become one space, ends are stripped."""
    return strip(F.regexp_replace(col(c), f"[{WS}]+", " "))


# --------------------------------------------------------------------------------------------
# Folding keys


def _single_char_map(form: str) -> tuple[str, str]:
    """(from, to) for ``translate``: characters that lose only their accents under ``form``.

    Combining marks have no counterpart in ``to`` and are therefore deleted.
    """
    source, target = [], []
    for code in range(0x00A0, 0x10000):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF or 0x0300 <= code <= 0x036F:
            continue
        ch = chr(code)
        base = "".join(
            x for x in unicodedata.normalize(form, ch) if not "\u0300" <= x <= "\u036f"
        )
        if len(base) == 1 and base != ch:
            source.append(ch)
            target.append(base)
    marks = [chr(code) for code in range(0x0300, 0x0370)]
    return "".join(source + marks), "".join(target)


_CANONICAL = _single_char_map("NFD")
_COMPAT = _single_char_map("NFKD")

# Latin, punctuation and letter-like characters whose compatibility form is several characters
# (ligatures, fractions, the ellipsis, ...). Derived from the Unicode data, not listed by hand.
_MULTI = {
    chr(code): "".join(
        x
        for x in unicodedata.normalize("NFKD", chr(code))
        if not "\u0300" <= x <= "\u036f"
    )
    for low, high in ((0x00A0, 0x0250), (0x2000, 0x2190), (0xFB00, 0xFB07))
    for code in range(low, high)
}
_MULTI = {k: v for k, v in _MULTI.items() if len(v) > 1}


def _compat(c: Column) -> Column:
    plain = F.translate(c, *_COMPAT)
    # rare rows that hold a character with a longer form go character by character
    table = F.expr("map(" + ", ".join(f"'{x}'" for pair in _MULTI.items() for x in pair) + ")")
    long_form = F.array_join(
        F.transform(F.split(plain, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), ""
    )
    return F.when(F.rlike(c, F.lit("[" + "".join(_MULTI) + "]")), long_form).otherwise(plain)


def fold_catalog(c) -> Column:
    """Variant A: canonical accents off, lower case, every other character run is one space."""
    plain = F.lower(F.translate(F.coalesce(col(c), F.lit("")), *_CANONICAL))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def fold_prompt(c) -> Column:
    """Variant C: compatibility accents off, lower case."""
    return F.lower(_compat(F.coalesce(col(c), F.lit(""))))


def fold_label(c) -> Column:
    """Variant B: variant C with both ends stripped."""
    return strip(fold_prompt(c))


def strip_accents(c) -> Column:
    """Compatibility folding that keeps the case."""
    return _compat(F.coalesce(col(c), F.lit("")))


def _fold_series(values: pd.Series, form: str) -> pd.Series:
    marks = dict.fromkeys(range(0x0300, 0x0370))
    return values.fillna("").map(lambda s: unicodedata.normalize(form, s).translate(marks))


@F.pandas_udf(StringType())
def fold_exact(values: pd.Series) -> pd.Series:
    """Variant B over all of Unicode, for corpora with scripts outside the built-in tables."""
    blanks = BLANKS
    return _fold_series(values, "NFKD").map(lambda s: s.lower().strip(blanks))


# --------------------------------------------------------------------------------------------
# Keys and names


def slug(c, sep: str = "-", default: str | Column = "modele-personnalise") -> Column:
    """Lower, fold, join the remaining alphanumeric runs with ``sep``."""
    base = _compat(F.lower(F.coalesce(col(c), F.lit(""))))
    joined = F.trim(F.regexp_replace(base, "[^a-z0-9]+", sep), F.lit(sep))
    fallback = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.nullif(joined, F.lit("")), fallback)


def field_key(c) -> Column:
    """Catalog field key: the slug with underscores."""
    return F.replace(slug(c), F.lit("-"), F.lit("_"))


def safe_file_name(c, default: str = "document_juridique") -> Column:
    """Export file name."""
    folded = F.regexp_replace(strip_accents(c), f"[^a-zA-Z0-9_{WS}-]", "")
    name = F.lower(F.regexp_replace(strip(folded), f"[{WS}]+", "_"))
    return F.left(F.coalesce(F.nullif(name, F.lit("")), F.lit(default)), F.lit(80))


def user_key(c) -> Column:
    """Identity key (P5): NULL when nothing usable is left."""
    cleaned = F.regexp_replace(text(c), "[^a-zA-Z0-9_.:@-]+", "_")
    return F.left(F.nullif(F.trim(cleaned, F.lit("_:.@-")), F.lit("")), F.lit(96))


def header_text(c) -> Column:
    return F.left(filled(c), F.lit(320))


def scope_of(c) -> Column:
    """Storage scope; everybody without a usable id shares ``anon``."""
    return F.coalesce(user_key(c), F.lit("anon"))


def truncate_title(c) -> Column:
    """One line of at most 96 characters; longer ones end in three dots."""
    line = squeeze(F.coalesce(col(c), F.lit("")))
    short = F.concat(rstrip(F.left(line, F.lit(TITLE_MAX - 3))), F.lit("..."))
    return F.when(line == "", "Discussion").when(F.length(line) <= TITLE_MAX, line).otherwise(short)


def encode_component(c) -> Column:
    """Percent-encoding of one URL component: a space is ``%20``, ``!'()*`` stay as they are."""
    out = F.url_encode(col(c))
    for code, ch in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(ch))
    return out


def decode_component(c) -> Column:
    """Percent-decoding; malformed input is returned unchanged, ``+`` stays ``+``."""
    return F.coalesce(F.try_url_decode(F.replace(col(c), F.lit("+"), F.lit("%2B"))), col(c))


def half_up(c) -> Column:
    """Nearest integer, halves up."""
    return F.floor(c + F.lit(0.5)).cast("bigint")


def contains_any(c: Column, words) -> Column:
    """True when at least one of the fixed words occurs in the text."""
    test = F.lit(False)
    for word in words:
        test = test | F.contains(c, F.lit(word))
    return test
