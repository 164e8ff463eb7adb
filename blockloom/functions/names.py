"""Names of cities: repairs, tokens for folders, and keys for matching.

Accents are stripped by ``translate`` over Latin letters, so that keys stay in generated code; names with other
characters that decompose go through the vectorised exact form.
"""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

EMPTY = ("", "nan", "none")


def _plain_letters() -> tuple[str, str]:
    """Letters up to U+024F, and the combining marks, with what is left of each without marks."""
    pairs = []
    for p in range(0xC0, 0x250):
        bare = "".join(c for c in unicodedata.normalize("NFKD", chr(p)) if not unicodedata.combining(c))
        if len(bare) == 1 and bare != chr(p):
            pairs.append((chr(p), bare))
    return "".join(a for a, _ in pairs) + "".join(map(chr, range(0x300, 0x370))), "".join(b for _, b in pairs)


ACCENTED, BARE = _plain_letters()


def without_accents(c: Column) -> Column:
    """Latin letters without their marks."""
    return F.translate(c, ACCENTED, BARE)


# Quotes and dashes that typewriters lack, and those that wrong decoding leaves as control characters.
DOUBLE_QUOTES = "“”„‟\u0093\u0094"
SINGLE_QUOTES = "’‘‚‛´`\u0091\u0092"
DASHES = "\u0096\u0097"


def plain_quotes(c: Column) -> Column:
    marks = DOUBLE_QUOTES + SINGLE_QUOTES + DASHES
    return F.translate(c, marks, '"' * len(DOUBLE_QUOTES) + "'" * len(SINGLE_QUOTES) + "-" * len(DASHES))


def redecoded(text: str | None) -> str | None:
    """A text that was UTF-8 but read as a Western code page, read anew; any other as it is."""
    if text is None or text.isascii():
        return text
    for page in ("cp1252", "latin-1"):
        try:
            out = text.encode(page).decode("utf-8")
        except UnicodeError:
            continue
        if "�" not in out:
            return out
    return text


@F.pandas_udf(StringType())
def _redecoded(s: pd.Series) -> pd.Series:
    return s.map(redecoded, na_action="ignore")


def repaired(c: Column) -> Column:
    """Plain quotes, then ``redecoded`` where a text has letters beyond ASCII."""
    quoted = plain_quotes(c)
    return F.when(quoted.rlike("[^\\x00-\\x7f]"), _redecoded(quoted)).otherwise(quoted)


def _cleared(c: Column) -> Column:
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(F.lower(t).isin(*EMPTY), F.lit("")).otherwise(t)


def folder_token(c: Column) -> Column:
    """Letters, digits and single underscores; empty for nothing, ``nan`` and ``none``."""
    s = F.regexp_replace(without_accents(repaired(_cleared(c))), "[^A-Za-z0-9]+", "_")
    return F.regexp_replace(s, "^_+|_+$", "")


def name_key(c: Column) -> Column:
    """Lower-case letters and digits alone, after repair; empty for nothing, ``nan`` and ``none``."""
    return F.regexp_replace(F.lower(without_accents(repaired(_cleared(c)))), "[^a-z0-9]+", "")


def join_key(c: Column) -> Column:
    """Lower-case letters and digits alone, as they are written."""
    return F.regexp_replace(without_accents(F.lower(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", "")


def city_of(c: Column) -> Column:
    """What comes before the first comma, repaired."""
    return repaired(F.trim(F.split(c, ",")[0]))


def city_folder(city: Column, country: Column) -> Column:
    """``city__country``, or the city's token alone."""
    a, b = folder_token(city), folder_token(country)
    return F.when(b == "", a).otherwise(F.concat_ws("__", a, b))


def like_pattern(c: Column) -> Column:
    """``%a%b%`` from the words of a name; NULL without a word."""
    words = F.filter(F.split(F.lower(F.trim(c)), r"[\s\-_/]+"), lambda w: w != "")
    return F.when(F.size(words) > 0, F.concat(F.lit("%"), F.array_join(words, "%"), F.lit("%")))


def hyphen_title(c: Column) -> Column:
    """Each part between hyphens with a capital."""
    return F.array_join(F.transform(F.split(c, "-"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), "-")


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching characters of the longest common blocks, twice, over both lengths (Ratcliff and Obershelp)."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def joined_list(c: Column) -> Column:
    """A list of tags as one text."""
    return F.array_join(c, ", ")


SPACES = re.compile(r"[\s_]+")
