"""Scalar rules of the evidence model as native column expressions (no Python per row)."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from corrobora.functions import vocab as V
from corrobora.functions.text import (
    any_literal, find_all, first_words, found_literals, has_any, literals, lookup, matches, once, squash, word_count, words)


# --- evidence weight -------------------------------------------------------------------------------
def tier_for_count(c: Column) -> Column:
    return (F.when(c >= 3, "Accepted").when(c == 2, "Moderately Accepted").otherwise("Speculative"))


def tier_rank(c: Column) -> Column:
    return lookup(c, V.TIER_RANK, 0)


def standard_label(c: Column) -> Column:
    return lookup(c, V.STANDARD_LABEL, "unverified")


def tier_meaning(c: Column) -> Column:
    return lookup(c, V.TIER_MEANING)


def independent_evidence(types: Column) -> Column:
    """Every non-model source counts; all model voices together count once."""
    t = F.coalesce(types, F.array().cast("array<string>"))
    return F.size(F.filter(t, lambda x: x != "llm")) + F.array_contains(t, "llm").cast("int")


def family(c: Column) -> Column:
    return lookup(c, V.TYPE_FAMILY, "web")


def families(types: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(
        F.coalesce(types, F.array().cast("array<string>")), family)))


def is_triangulated(types: Column, minimum: int = 2) -> Column:
    return types.isNull() | (F.size(families(types)) >= minimum)


def gated_tier(weight: Column, n_families: Column) -> Column:
    """Tier from weight; the top tier needs two families (null = unknown = not held back)."""
    return F.when((weight >= 3) & (n_families < 2), "Moderately Accepted").otherwise(tier_for_count(weight))


def moved_tier(current: Column, target: Column, contest: Column) -> Column:
    """The one transition rule: contest overrides and sticks, otherwise tiers only rise."""
    return (F.when(contest | (current == V.CONTESTED), V.CONTESTED)
            .when(tier_rank(target) > tier_rank(current), target).otherwise(current))


# --- bands -----------------------------------------------------------------------------------------
def novelty_tier(score: Column) -> Column:
    return (F.when(score >= V.REDUNDANT_AT, "redundant").when(score >= V.INCREMENTAL_AT, "incremental")
            .otherwise("novel"))


def frontier(score: Column) -> Column:
    return (F.when(score >= V.COVERED_AT, 0.15).when(score >= V.FRONTIER_LO, 1.0)
            .when(score >= V.EDGE_LO, 0.60).otherwise(0.35))


def sim_band(score: Column) -> Column:
    return F.when(score >= 0.6, "STRONG").when(score >= 0.5, "real").otherwise("weak")


def relation_band(score: Column) -> Column:
    return (F.when(score >= V.VERBATIM, "verbatim").when(score >= V.MERGE, "merge")
            .when(score >= V.NEST_FLOOR, "nest").otherwise("separate"))


# --- verdict normalisation -------------------------------------------------------------------------
def within(c: Column, allowed, default: str) -> Column:
    """Trimmed lower-case label if it belongs to the closed set, else the default (null included)."""
    v = F.lower(F.trim(c))
    return F.when(v.isin(*allowed), v).otherwise(default)


def _has(c: Column, *parts: str) -> Column:
    return any_literal(c, parts)


def norm_verdict(c: Column) -> Column:
    v = F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "_", "-")
    return (F.when(v.isin(*V.PATTERN_VERDICTS), v)
            .when(_has(v, "support", "confirm"), "supported")
            .when(_has(v, "debunk", "false", "disprov", "refut"), "debunked")
            .when(_has(v, "notable", "unresolved", "open"), "unresolved-notable")
            .otherwise("unverified"))


def norm_status(c: Column) -> Column:
    s = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    named = F.coalesce(*[F.when(s.contains(k), k) for k in V.STATUSES])
    return (F.when(named.isNotNull(), named).when(_has(s, "dead", "death", "died"), "deceased")
            .when(_has(s, "disappear", "vanish"), "missing").otherwise("unknown"))


# --- urls ------------------------------------------------------------------------------------------
def domain_of(url: Column) -> Column:
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def is_primary_source(url: Column) -> Column:
    return any_literal(F.lower(url), V.PRIMARY_HINTS)


def doi_from(c: Column) -> Column:
    return F.lower(F.rtrim(F.regexp_extract(F.coalesce(c, F.lit("")), "(?i)" + V.DOI, 0), F.lit(".")))


def video_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), V.VIDEO_ID, 1), F.lit(""))


# --- questions -------------------------------------------------------------------------------------
def norm_question(c: Column) -> Column:
    return F.rtrim(squash(F.lower(c)), F.lit("?. "))


def strip_instructions(c: Column) -> Column:
    s = squash(c)
    for p in V.INSTRUCTION_PATTERNS:
        s = F.regexp_replace(s, "(?i)" + p, "")
    return F.trim(s, F.lit(" :;-—"))


def bad_question(c: Column) -> Column:
    """Why the question is unusable; empty string when it is fine."""
    s = squash(c)
    n = word_count(c)
    return (F.when(s == "", V.REASON_EMPTY)
            .when(n > V.MAX_QUESTION_WORDS, F.concat(F.lit(V.REASON_LONG[0]), n.cast("string"), F.lit(V.REASON_LONG[1])))
            .when(matches(s, V.DOC_EXISTENCE), V.REASON_DOCUMENT)
            .when((F.length(s) - F.length(F.regexp_replace(s, r"\?", "")) > 1)
                  | F.lower(s).contains(" and what ") | s.contains("—"), V.REASON_COMPOUND)
            .otherwise(""))


def target_domains(c: Column) -> Column:
    """Sorted union of the curated domains of every topic whose keywords occur in the text."""
    none = F.array().cast("array<string>")
    picked = lambda q: F.concat(*[F.when(has_any(q, keys), literals(doms)).otherwise(none) for keys, doms in V.REGISTRY.values()])
    return F.array_sort(F.array_distinct(once(F.lower(c), picked)))


def sensitive_topic(c: Column) -> Column:
    return once(F.lower(c), lambda q: has_any(q, V.SENSITIVE_KEYS))


def looks_scientific(c: Column) -> Column:
    return once(F.lower(c), lambda q: has_any(q, V.SCIENCE_KEYS))


def is_meta(c: Column) -> Column:
    return matches(c, V.META)


def distinct_angles(angles) -> list[str]:
    return list({" ".join(a.lower().split()): " ".join(a.split()) for a in reversed(angles) if a.strip()}.values())[::-1]


def person_queries(name: Column, context: Column, angles=V.PERSON_ANGLES, cap: int | None = None) -> Column:
    """Array of name × angle searches: the bare name first, then each angle with the context."""
    # one base with distinct angles gives distinct queries, so repeats are removed from the angles; angles beyond the cap
    # aren't put together, and name and base are computed once for each row
    angles = distinct_angles(angles)[:None if cap is None else max(cap - 1, 0)]
    asked = lambda b: F.array(b, *[F.concat(b, F.lit(f" {a}")) for a in angles])
    base = lambda p: F.trim(F.when(p["ctx"] == "", p["n"]).otherwise(F.concat(p["n"], F.lit(" "), p["ctx"])))
    queries = lambda p: F.when(p["n"] == "", F.array().cast("array<string>")).otherwise(once(base(p), asked))
    out = once(F.struct(squash(name).alias("n"), F.substring(squash(context), 1, 40).alias("ctx")), queries)
    return out if cap is None or cap > 0 else F.slice(out, 1, cap)


def qualify(query: Column, place: Column, when: Column) -> Column:
    blank = lambda c: F.nullif(c.cast("string"), F.lit(""))
    return F.trim(F.concat_ws(" ", blank(query), blank(place), blank(when)))


def for_engine(query: Column, engine: Column, max_words: int = 12) -> Column:
    """Search text for one engine; null when nothing is left after the scaffolding is removed."""
    s = strip_instructions(query)
    trimmed = F.when(engine.isin("youtube", "podcast"), first_words(s, max_words)).otherwise(s)
    return F.when(s != "", trimmed)


# --- dates -----------------------------------------------------------------------------------------
def years_for_freshness(c: Column) -> Column:
    return lookup(F.lower(F.trim(c)), V.FRESHNESS_YEARS)


def start_date(years: Column, as_of: Column) -> Column:
    return F.when(years > 0, F.date_sub(as_of, (years * 365).cast("int")))


def parsed_time(c: Column) -> Column:
    return F.try_to_timestamp(c)


def age_days(c: Column, as_of: Column) -> Column:
    """Age in days, null when the text is not a date."""
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(parsed_time(c))) / 86_400_000_000.0


def within_recency(c: Column, years: int | None, as_of: Column, days_per_year: int = 366) -> Column:
    """Undated rows pass: a missing date is no evidence of age."""
    if not years:
        return F.lit(True)
    return F.coalesce(F.floor(age_days(c, as_of)) <= years * days_per_year, F.lit(True))


# --- people ----------------------------------------------------------------------------------------
def disambiguator(role: Column, employer: Column, place: Column, max_words: int = 6) -> Column:
    """Employer, role, place; a part already contained in what precedes it is left out."""
    phrase = F.lit("")
    for part in (employer, role, place):
        v = squash(part)
        phrase = (F.when((v == "") | F.lower(phrase).contains(F.lower(v)), phrase)
                  .otherwise(F.trim(F.concat_ws(" ", phrase, v))))
    return first_words(phrase, max_words)


def retry_queries(name: Column, phrase: Column, born: Column, died: Column, angles=V.RETRY_ANGLES,
                  cap: int | None = None) -> Column:
    part = lambda c: F.nullif(c, F.lit(""))
    n = F.trim(F.coalesce(name, F.lit("")))
    base = F.concat_ws(" ", part(n), part(phrase), F.coalesce(died, born).cast("string"))
    base = squash(base)
    out = F.array(base, *[F.concat(base, F.lit(f" {a}")) for a in distinct_angles(angles)])
    return F.when(n == "", F.array().cast("array<string>")).otherwise(out if cap is None else F.slice(out, 1, cap))


def proper_names(c: Column) -> Column:
    """Distinct multi-word proper names (two to four capitalised tokens)."""
    return F.array_distinct(find_all(c, V.PROPER_NAME, 1))


def plausible_person(name: Column) -> Column:
    n = squash(name)
    toks = F.split(n, " ")
    low = F.transform(toks, lambda t: F.trim(F.lower(t), F.lit(".,")))
    return ((n != "") & ~n.contains("'") & F.size(toks).between(2, 4)
            & ~F.element_at(low, 1).isin(*V.LEAD_STOP)
            & ~F.exists(low, lambda t: t.isin(*V.ORG_TOKENS))
            & (F.size(F.array_distinct(low)) == F.size(low))
            & F.forall(toks, lambda t: t.rlike("^[A-Z]")))


def orgs(c: Column) -> Column:
    return found_literals(F.lower(F.coalesce(c, F.lit(""))), V.ORG_CUES)


def entity_keys(name: Column) -> Column:
    n = F.trim(name)
    parts = F.filter(words(n), lambda t: F.length(t) > 3)
    return F.array_distinct(F.concat(F.array(F.lower(n)), F.transform(parts, F.lower)))


def collapse_repeats(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)\b(\w+(?:\s+\w+){0,3})\s+\1\b", "$1")


def finding_id(branch: Column, claim: Column, url: Column) -> Column:
    """Content address, so recomputing a lost partition yields the same id."""
    joined = F.concat_ws("‖", F.coalesce(branch, F.lit("")), F.coalesce(claim, F.lit("")), F.coalesce(url, F.lit("")))
    return F.concat(F.lit("find_"), F.left(F.sha2(joined, 256), F.lit(12)))


def slug(c: Column, ident: Column) -> Column:
    """Readable file name: first eight plain words, then the id's tail."""
    # a word is a run without blanks that holds a letter or digit (two signs outside ASCII become one in lower case)
    head = F.regexp_extract(F.coalesce(c, F.lit("")), "^(?:[^A-Za-z0-9\u0130\u212a]*+[A-Za-z0-9\u0130\u212a]\\S*+){1,8}+", 0)
    plain = F.regexp_replace(F.lower(head), r"[^a-z0-9\s]", "")
    short = F.trim(F.substring(F.regexp_replace(first_words(plain, 8), " ", "-"), 1, 60), F.lit("-"))
    return F.concat(once(short, lambda s: F.when(s == "", "finding").otherwise(s)), F.lit("--"), F.right(ident, F.lit(6)))


def rebuild_abstract(index: Column) -> Column:
    """Text from an inverted index ``map<word, positions>``."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(
        e["value"], lambda p: F.struct(p.alias("pos"), e["key"].alias("word")))))
    return F.array_join(F.transform(F.sort_array(placed), lambda x: x["word"]), " ")
