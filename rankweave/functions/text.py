"""Tokens, identifiers and phrases as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankweave.vocabulary import TECHNICAL_PHRASES

# What an identifier is, and where it comes apart.
IDENTIFIER = r"[A-Za-z_$][A-Za-z0-9_$]*(?:[._:/-][A-Za-z0-9_$]+)*"
SEPARATORS = r"[_\-./:$]+|(?<=[a-z0-9])(?=[A-Z])"
WHITE = r"(?U)[\s\x1c-\x1f]+"


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def split_identifier(item: Column) -> Column:
    """Lower-cased parts of an identifier, between separators and before inner capitals."""
    return F.filter(F.transform(F.split(item, SEPARATORS), lambda x: F.lower(x)), lambda x: x != "")


def items(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))


def tokenize(text: Column) -> Column:
    """Each identifier in lower case, then its parts: a word without parts comes twice."""
    return F.flatten(F.transform(items(text), lambda x: F.concat(F.array(F.lower(x)), split_identifier(x))))


def squeeze(text: Column) -> Column:
    """Lower case, single spaces, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), WHITE, " "), "^ | $", "")


def extract_identifiers(text: Column) -> Column:
    """Distinct items with a separator, an inner or a leading capital, in their order."""
    coded = lambda x: x.rlike(r"[_$./:$-]") | x.rlike("[a-z][A-Z]") | ((F.length(x) > 1) & x.rlike("^[A-Z]"))
    return F.array_distinct(F.filter(items(text), coded))


def phrase_in(text: Column, phrase: str, word: str = "a-z0-9_") -> Column:
    return text.rlike(rf"(?<![{word}])\Q{phrase}\E(?![{word}])")


def found_phrases(text: Column, phrases, word: str = "a-z0-9_") -> Column:
    return F.array_compact(F.array(*[F.when(phrase_in(text, p, word), F.lit(p)) for p in phrases]))


def technical_phrases(query: Column) -> Column:
    """Anchor phrases in a query, the longest first."""
    return found_phrases(squeeze(query), sorted(TECHNICAL_PHRASES, key=len, reverse=True))


def phrase_text(text: Column) -> Column:
    """Lower case with separators as spaces, for finding phrases in code."""
    return squeeze(F.regexp_replace(text, r"[_./:$-]+", " "))


def phrase_text_of(phrase: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[_./:$-]+", " ", phrase.lower())).strip()


def version_key(version: Column) -> Column:
    """Whole numbers of a dotted version label, with or without v; null for any other label."""
    label = F.regexp_replace(F.regexp_replace(version, "^" + WHITE, ""), WHITE + "$", "")
    parts = F.split(F.regexp_replace(label, "^[vV]", ""), r"\.")
    return F.when(label.rlike(r"^[vV]?\d+(\.\d+)*$"), F.transform(parts, lambda x: x.cast("bigint")))


def version_intent(query: Column) -> Column:
    """(version_intent, version) of a query: latest, specific with a label, or none."""
    latest = squeeze(query).rlike(r"\b(latest|newest|most recent|current)\b")
    pattern = r"(?i)\bv\s*(\d+(?:\.\d+)*)\b|\bversion\s+(\d+(?:\.\d+)*)\b"
    first, second = (F.regexp_extract(query, pattern, i) for i in (1, 2))
    number = F.coalesce(F.nullif(first, F.lit("")), F.nullif(second, F.lit("")))
    return F.struct(
        F.when(latest, "latest").when(number.isNotNull(), "specific").otherwise("none").alias("version_intent"),
        F.when(~latest & number.isNotNull(), F.concat(F.lit("v"), number)).alias("version"))


def snippet_id(repository: Column, path: Column, version: Column, start: Column, end: Column, code: Column) -> Column:
    parts = [F.coalesce(x.cast("string"), F.lit("")) for x in (repository, path, version, start, end, code)]
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)
