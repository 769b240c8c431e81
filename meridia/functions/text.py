"""Name normalisation and matching."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MARKS = re.compile("[̀-ͯ]")

# Fixed: scripts in the order in which they are tried.
SCRIPTS = ("Han", "Hiragana", "Katakana", "Hangul", "Arabic", "Hebrew", "Cyrillic", "Greek", "Devanagari", "Thai", "Latin")


def normalize_text(text: str | None) -> str | None:
    """Lower case, decomposed, without combining marks; anything but letters and numbers parts words."""
    if text is None:
        return None
    plain = _MARKS.sub("", unicodedata.normalize("NFKD", text.strip().lower()))
    return " ".join("".join(c if unicodedata.category(c)[0] in "LN" else " " for c in plain).split())


@F.pandas_udf(T.StringType())
def _normalize(texts: pd.Series) -> pd.Series:
    return texts.map(normalize_text, na_action="ignore")


def normalize(text: Column) -> Column:
    """ASCII stays in the JVM; only other texts go through Unicode decomposition, which has no built-in."""
    ascii_ = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    return F.when(F.length(text) == F.octet_length(text), ascii_).otherwise(_normalize(text))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _normalize_all(lists: pd.Series) -> pd.Series:
    return lists.map(lambda xs: [x if x is None else normalize_text(x) for x in xs], na_action="ignore")


def normalize_all(texts: Column) -> Column:
    """Each text of an array; arrays of ASCII texts stay in the JVM."""
    ascii_ = F.transform(texts, lambda x: F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " ")))
    return F.when(F.forall(texts, lambda x: x.isNull() | (F.length(x) == F.octet_length(x))), ascii_).otherwise(_normalize_all(texts))


def token_starts_with(text: Column, query: Column) -> Column:
    return F.startswith(text, query) | F.contains(text, F.concat(F.lit(" "), query))


def script_of(text: Column) -> Column:
    out = F.when(text.isNull(), None)
    for s in SCRIPTS:
        out = out.when(F.regexp_like(text, F.lit(f"\\p{{Is{s}}}")), s)
    return out.otherwise("Other")


def sort_key(name: Column) -> Column:
    """The name without punctuation and symbols at its start."""
    return F.regexp_replace(name, "^[\\p{P}\\p{S}ʻʿ]+", "")


def primary_local(name: Column) -> Column:
    return F.trim(F.split_part(name, F.lit(" / "), F.lit(1)))


def literal_label(literal: Column, confidence: Column) -> Column:
    """No label where the meaning is unknown; a question mark where it is disputed."""
    return F.when(confidence == "unknown", None).when(confidence == "disputed", F.concat(literal, F.lit("?"))).otherwise(literal)
