"""Tokenisers and text clean-up as native column expressions."""
from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def squash(c: Column) -> Column:
    """Runs of whitespace become one blank, ends trimmed; null reads as empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(squash(c), " "), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def first_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(words(c), 1, n), " ")


def matches(c: Column, pattern: str) -> Column:
    """Case-insensitive search; null reads as no match."""
    return F.coalesce(c, F.lit("")).rlike("(?i)" + pattern)


def any_literal(c: Column, needles) -> Column:
    """True when the text holds any of a fixed list of substrings (one regex pass, not one per word)."""
    return F.coalesce(c, F.lit("")).rlike("|".join(re.escape(n) for n in needles))


def has_any(c: Column, needles) -> Column:
    """As ``any_literal`` for long texts: plain substring tests that stay in generated code."""
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(c, F.lit(n))
    return F.coalesce(out, F.lit(False))


def once(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for each row, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), 0)


def found_literals(c: Column, needles) -> Column:
    """The needles that occur in the text. No lambda, so the text expression is evaluated once."""
    return F.array_compact(F.array(*[F.when(F.contains(c, F.lit(n)), F.lit(n)) for n in needles]))


def find_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(group))


def literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def lookup(c: Column, table: dict, default=None) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    hit = F.try_element_at(F.create_map(*pairs), F.coalesce(c, F.lit("")))
    return hit if default is None else F.coalesce(hit, F.lit(default))


def tok(c: Column) -> Column:
    """Lower-case letter/digit runs, repeats kept."""
    return find_all(F.lower(c), "[a-z0-9]+")


def words4(c: Column) -> Column:
    """Distinct lower-case words of four letters or more."""
    return F.array_distinct(find_all(F.lower(c), "[a-z]{4,}"))


def sig_tokens(c: Column, stop) -> Column:
    """Distinct topic-bearing tokens: four characters or more and not scaffolding."""
    found = F.transform(find_all(c, "[A-Za-z0-9']+"), F.lower)
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) >= 4) & ~w.isin(*stop)))
