"""Names, identities and the findings filed under them."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corrobora.functions import exprs as X, vocab as V
from corrobora.functions.text import find_all, literals, matches, squash, words
from corrobora.operators.graph import components
from corrobora.operators.matching import contains_join
from corrobora.session import cut, one_row


# --- mentions --------------------------------------------------------------------------------------
def with_disambiguator(cards: DataFrame) -> DataFrame:
    return cards.withColumn("phrase", X.disambiguator(F.col("role"), F.col("employer"), F.col("place")))


def is_authoritative(types: Column) -> Column:
    """No recorded type counts as authoritative (fail open)."""
    t = F.coalesce(types, F.array().cast("array<string>"))
    return (F.size(t) == 0) | F.arrays_overlap(t, literals(V.AUTHORITATIVE_TYPES))


def mentions(findings: DataFrame) -> DataFrame:
    return findings.select(
        "finding_id", is_authoritative(F.col("source_types")).alias("authoritative"),
        F.explode(X.proper_names(F.col("claim"))).alias("name")).withColumn("name", squash(F.col("name")))


def org_mentions(findings: DataFrame) -> DataFrame:
    return findings.select("finding_id", F.explode(X.orgs(F.col("claim"))).alias("org"))


def mention_stats(m: DataFrame) -> DataFrame:
    return m.groupBy("name").agg(F.bool_or("authoritative").alias("authoritative"), F.count("*").alias("n"))


def keyed(entities: DataFrame) -> DataFrame:
    return entities.select("*", F.explode(X.entity_keys(F.col("name"))).alias("k")).filter("k <> ''")


def case_anchors(topics: DataFrame, roster: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Distinct topic words in order, without stop words, roster words or bracketed personal detail; cut on request."""
    low = F.lower("topic")
    inside = find_all(F.array_join(find_all(low, r"\(([^)]*)\)", 1), " "), "[a-z]{4,}")
    own = F.array_except(find_all(low, "[a-z]{4,}"), F.concat(literals(V.CASE_STOP), inside))
    roster_words = roster.select(F.explode(words(F.lower("name"))).alias("w")).filter(F.length("w") > 3).distinct()
    kept = (topics.select("finding_id", F.posexplode(own).alias("pos", "w"))
            .join(roster_words, "w", "left_anti")
            .groupBy("finding_id").agg(F.array_sort(F.collect_list(F.struct("pos", "w"))).alias("ws")))
    joined = F.array_join(F.transform("ws", lambda x: x["w"]), " ")
    return (topics.select("finding_id").join(kept, "finding_id", "left")
            .select("finding_id", (F.coalesce(joined, F.lit("")) if max_chars is None else F.substring(F.coalesce(joined, F.lit("")), 1, max_chars)).alias("anchor")))


# --- case files ------------------------------------------------------------------------------------
def entity_hits(findings: DataFrame, entities: DataFrame) -> DataFrame:
    """(finding_id, name): every entity one of whose keys occurs in the claim."""
    ks = keyed(entities.select("name")).select("name", "k").distinct()
    found = contains_join(findings, "finding_id", F.lower("claim"), ks, "k")
    return found.join(ks, "k").select("finding_id", "name").distinct()


def case_files(findings: DataFrame, entities: DataFrame) -> DataFrame:
    """Each finding under every matching entity; the rest under ``_unassigned``. Nothing is lost."""
    hits = entity_hits(findings, entities)
    return findings.select("finding_id").join(hits, "finding_id", "left").select(
        "finding_id", F.coalesce("name", F.lit("_unassigned")).alias("file"))


# --- identity screens ------------------------------------------------------------------------------
def _years_near(text: Column, cue: str) -> Column:
    """Years lying within the window on either side of a cue word."""
    gap = V.YEAR_WINDOW - 4
    before = find_all(text, f"(?is){V.YEAR}(?=.{{0,{gap}}}{cue})")
    after = find_all(text, rf"(?is){V.YEAR}(?<={cue}.{{0,{gap}}}\d{{4}})")
    return F.array_sort(F.array_distinct(F.transform(F.concat(before, after), lambda y: y.cast("int"))))


def with_facts(findings: DataFrame) -> DataFrame:
    """What a claim says about its person: read once per claim, before it meets any card."""
    c = F.coalesce("claim", F.lit(""))
    return findings.withColumn("_died", _years_near(c, V.DEATH_CUE)).withColumn(
        "_born", _years_near(c, V.BIRTH_CUE)).withColumn("_jobs", find_all(c, "(?i)" + V.APPOSITIVE, 1))


def _year_conflict(years: Column, known: Column, label: str) -> Column:
    off = (F.size(years) > 0) & F.forall(years, lambda y: F.abs(y - known) > V.YEAR_SLACK)
    return F.when(known.isNotNull() & off, F.concat(
        F.lit(f"{label} year ["), F.array_join(years, ", "), F.lit("] conflicts with known "), known.cast("string")))


def with_conflict(pairs: DataFrame) -> DataFrame:
    """Adds ``verdict`` (hard / weak / ok) and ``reason``. Needs ``with_facts`` and the card columns."""
    hard = F.coalesce(
        _year_conflict(F.col("_died"), F.col("died"), "death/disappearance"),
        _year_conflict(F.col("_born"), F.col("born"), "birth"))
    role, employer = F.coalesce("role", F.lit("")), F.coalesce("employer", F.lit(""))
    known = find_all(F.lower(F.concat_ws(" ", role, employer)), "[a-z]{4,}")
    alien = F.get(F.filter("_jobs", lambda s: (F.size(find_all(F.lower(s), "[a-z]{4,}")) > 0)
                           & ~F.arrays_overlap(find_all(F.lower(s), "[a-z]{4,}"), known)), 0)
    weak = F.when(F.size(known) > 0, F.concat(
        F.lit("claim calls them '"), F.trim(alien), F.lit("'; known as '"),
        F.when(role != "", role).otherwise(employer), F.lit("'")))
    return (pairs.withColumn("_h", hard).withColumn("_w", weak)
            .withColumn("verdict", F.when(F.col("_h").isNotNull(), "hard").when(F.col("_w").isNotNull(), "weak")
                        .otherwise("ok"))
            .withColumn("reason", F.coalesce("_h", "_w", F.lit(""))).drop("_h", "_w", "_died", "_born", "_jobs"))


def screen(findings: DataFrame, cards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined) for every finding filed under a carded person. Counts always add up."""
    judged = with_conflict(entity_hits(findings, cards).join(with_facts(findings), "finding_id").join(cards, "name"))
    hard = F.col("verdict") == "hard"
    kept = judged.filter(~hard).withColumn("identity_note", F.when(F.col("verdict") == "weak", F.col("reason")))
    return kept, judged.filter(hard).withColumnRenamed("reason", "quarantine_reason")


def wrong_person(claim: Column, name: Column) -> Column:
    """Reason why the claim is about someone else with the same surname; empty string otherwise."""
    parts = words(name)
    surname = F.element_at(parts, -1)
    given = F.transform(F.slice(parts, 1, F.size(parts) - 1), F.lower)
    text = F.coalesce(claim, F.lit(""))
    low = F.lower(text)
    own = F.exists(given, lambda g: F.contains(low, g))
    quoted = F.concat(F.lit(r"\Q"), surname, F.lit(r"\E"))
    person = F.concat(F.lit(r"\b([A-Z][a-z]{2,})\s+(?:[A-Z][a-z]*\.?\s+)?"), quoted, F.lit(r"\b"))
    spans = F.arrays_zip(F.regexp_extract_all(text, person, F.lit(0)).alias("span"),
                         F.regexp_extract_all(text, person, F.lit(1)).alias("first"))
    other = F.get(F.filter(spans, lambda m: ~F.array_contains(given, F.lower(m["first"]))
                           & ~F.lower(m["first"]).isin(*V.NOT_A_GIVEN_NAME)), 0)["span"]
    place = F.regexp_substr(text, F.concat(quoted, F.lit(rf"\s+(?i:{V.NOT_A_PERSON})\b")))
    return (F.when((F.size(parts) == 0) | own | matches(text, V.FAMILY), "")
            .when((F.size(given) > 0) & other.isNotNull(),
                  F.concat(F.lit("'"), other, F.lit("' — different given name (this is "), squash(name), F.lit(")")))
            .when(place.isNotNull(), F.concat(F.lit("'"), place, F.lit("' — a place/institution, not "), squash(name)))
            .otherwise(""))


def namesakes(findings: DataFrame, entities: DataFrame) -> DataFrame:
    hits = entity_hits(findings, entities).join(findings.select("finding_id", "claim"), "finding_id")
    return hits.select("finding_id", "name", wrong_person(F.col("claim"), F.col("name")).alias("reason"))


def findings_per_entity(findings: DataFrame, entities: DataFrame) -> DataFrame:
    own = namesakes(findings, entities).filter("reason = ''").groupBy("name").agg(F.count("*").alias("n"))
    return (entities.select("name").distinct().join(own, "name", "left")
            .select("name", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def thin_entities(counts: DataFrame) -> DataFrame:
    """Entities below max(3, half the upper median). The median is one row, so it is safe to attach."""
    floor = counts.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n DESC)").alias("median")).select(
        "median", F.greatest(F.lit(3), F.floor(F.col("median") * 0.5)).cast("long").alias("floor"))
    return counts.withColumn("s", one_row(floor)).filter(F.col("n") < F.col("s.floor")).select("name", "n", "s.median", "s.floor")


# --- links between people --------------------------------------------------------------------------
def name_orgs(m: DataFrame, o: DataFrame) -> DataFrame:
    """Distinct (org, name) pairs that share a finding."""
    return o.join(m.select("finding_id", "name"), "finding_id").select("org", "name").distinct()


def shared_org(m: DataFrame, o: DataFrame) -> DataFrame:
    """Names tied to an organisation at least two names share: one row per name, never a list per org."""
    pairs = name_orgs(m, o)
    size = pairs.groupBy("org").agg(F.count("*").alias("n_names")).filter("n_names >= 2")
    return pairs.join(size, "org").select("org", "name", "n_names")


def non_connections(proposed: DataFrame, m: DataFrame, o: DataFrame) -> DataFrame:
    """Proposed pairs of people who share no organisation."""
    no = name_orgs(m, o)
    shared = (proposed.join(no.withColumnRenamed("name", "entity_a"), "entity_a")
              .join(no.withColumnRenamed("name", "entity_b"), ["entity_b", "org"])
              .select("entity_a", "entity_b").distinct())
    return (proposed.filter("entity_a <> entity_b").join(shared, ["entity_a", "entity_b"], "left_anti")
            .select(F.least("entity_a", "entity_b").alias("entity_a"), F.greatest("entity_a", "entity_b").alias("entity_b"))
            .distinct())


def _contained_either_way(names: DataFrame, known: DataFrame) -> DataFrame:
    """Names that contain, or are contained in, a known name (both lower-case columns ``name``)."""
    k = known.select(F.col("name").alias("known"))
    inside = contains_join(names, "name", F.col("name"), k, "known").select("name")
    outside = contains_join(k, "known", F.col("known"), names, "name").select("name")
    return inside.union(outside).distinct()


def missing_entities(canonical: DataFrame, roster: DataFrame, cap: int | None = None) -> DataFrame:
    """Canonical names no roster name matches; ``n_total`` tells how many there are before the cap."""
    c = canonical.select(F.lower(squash(F.col("name"))).alias("name")).distinct()
    r = roster.select(F.lower(squash(F.col("name"))).alias("name")).distinct()
    gone = cut(c.join(_contained_either_way(c, r), "name", "left_anti"))
    total = gone.agg(F.count("*").alias("n_total"))
    top = gone.orderBy("name") if cap is None else gone.orderBy("name").limit(cap)
    return top.select(F.initcap("name").alias("name"), one_row(total)["n_total"].alias("n_total"))


def omitted_names(texts: DataFrame, roster: DataFrame, on: str = "report_id") -> DataFrame:
    """Roster members of a text whose surname the text never mentions."""
    surname = F.lower(F.element_at(words(F.col("name")), -1))
    return (roster.select(on, "name").distinct().join(texts.select(on, F.lower("text").alias("_t")), on)
            .filter(~F.contains("_t", surname)).select(on, "name"))


# --- resolution ------------------------------------------------------------------------------------
def _tokens(c: Column) -> Column:
    return words(F.lower(c))


def same_entity(a: Column, b: Column) -> Column:
    """Same first and last token, or one token set inside the other with the same first token."""
    ta, tb = _tokens(a), _tokens(b)
    first = F.get(ta, 0) == F.get(tb, 0)
    last = F.element_at(ta, -1) == F.element_at(tb, -1)
    inside = (F.size(F.array_except(ta, tb)) == 0) | (F.size(F.array_except(tb, ta)) == 0)
    return (F.size(ta) > 0) & (F.size(tb) > 0) & first & (last | inside)


def same_entity_edges(names: DataFrame) -> DataFrame:
    """Edges whose components equal those of the full relation, linear in the number of names.

    Sharing (first, last) ties a name to the smallest such name. A token set is filed under its rarest token
    beside its first one; a longer name looks up each of its tokens there, so names of any length cost as
    many lookups as they have tokens, and pairs in a block of common names are never compared.
    """
    n = names.select("name", _tokens(F.col("name")).alias("t")).filter(F.size("t") > 0)
    n = n.select("name", F.get("t", 0).alias("f"), F.element_at("t", -1).alias("l"), F.array_sort(F.array_distinct("t")).alias("t"))
    ends = n.groupBy("f", "l").agg(F.min("name").alias("rep"))
    star = n.join(ends, ["f", "l"]).select("name", F.col("rep").alias("other"))
    sets = n.groupBy("f", "t").agg(F.min("name").alias("rep"))
    twins = n.join(sets, ["f", "t"]).select("name", F.col("rep").alias("other"))
    # a set of the first token alone is filed under that token, any other under a further one
    own = sets.select("f", "t", "rep", F.explode(F.when(F.size("t") == 1, F.col("t")).otherwise(
        F.array_except("t", F.array("f")))).alias("w"))
    rarity = own.groupBy("f", "w").agg(F.count("*").alias("n"))
    filed = own.join(rarity, ["f", "w"]).groupBy("rep").agg(
        F.min_by(F.struct("f", "w", "t"), F.struct("n", "w")).alias("h")).select(F.col("rep").alias("other"), "h.f", "h.w", F.col("h.t").alias("sub"))
    asking = sets.filter(F.size("t") > 1).select("f", "t", F.col("rep").alias("name"), F.explode("t").alias("w"))
    inner = asking.join(filed, ["f", "w"]).filter(F.size(F.array_except("sub", "t")) == 0).select("name", "other")
    return star.union(twins).union(inner).filter("name <> other").distinct()


def resolve_entities(m: DataFrame) -> DataFrame:
    """(variant, canonical, authoritative, suspect): the fullest spelling, trusted spellings first."""
    stats = mention_stats(m)
    comp = components(same_entity_edges(stats), stats, "name", "other", "name")
    v = stats.join(comp, "name")
    rank = F.struct(~F.col("authoritative"), -F.size(_tokens(F.col("name"))), -F.length("name"), F.col("name"))
    heads = v.groupBy("component").agg(F.min_by("name", rank).alias("canonical"),
                                       F.bool_or("authoritative").alias("authoritative"),
                                       F.count("*").alias("n_variants"))
    return v.select("component", F.col("name").alias("variant")).join(heads, "component").select(
        "variant", "canonical", "authoritative", (~F.col("authoritative")).alias("suspect"), "n_variants")


def safe_pair(variant: Column, canonical: Column) -> Column:
    """A rewrite may add a given name in front, never qualifiers behind, and never shorten."""
    v, c = F.lower(squash(variant)), F.lower(squash(canonical))
    return (v != c) & F.when(F.contains(c, v), F.endswith(c, v)).otherwise(~F.contains(v, c))


def normalize_names(findings: DataFrame, resolved: DataFrame) -> DataFrame:
    """Claims rewritten to canonical names, longest variant first, adjacent repeats collapsed."""
    pairs = resolved.filter(safe_pair(F.col("variant"), F.col("canonical"))).select("variant", "canonical")
    hits = (contains_join(findings, "finding_id", F.col("claim"), pairs, "variant").join(pairs, "variant")
            .groupBy("finding_id").agg(F.array_sort(F.collect_list(F.struct(
                (-F.length("variant")).alias("o"), "variant", "canonical"))).alias("_pairs")))
    rewritten = F.aggregate("_pairs", F.col("claim"), lambda acc, p: F.regexp_replace(
        acc, F.concat(F.lit(r"\b\Q"), p["variant"], F.lit(r"\E\b")), p["canonical"]))
    return (findings.join(hits, "finding_id", "left")
            .withColumn("claim", X.collapse_repeats(F.coalesce(rewritten, F.col("claim")))).drop("_pairs"))


def demote_spoken(df: DataFrame) -> DataFrame:
    """Rows known only from speech leave the supported and contested buckets."""
    t = F.coalesce("source_types", F.array().cast("array<string>"))
    spoken = (F.size(t) > 0) & F.forall(t, lambda x: x.isin(*V.SPOKEN_TYPES))
    return df.withColumn("label", F.when(spoken & F.col("label").isin("well-supported", "contested"), "unverified")
                         .otherwise(F.col("label")))


def unknown_candidates(m: DataFrame, known: DataFrame) -> DataFrame:
    """Person-shaped names that match no known name in either direction, with their mention count."""
    counts = m.filter(X.plausible_person(F.col("name"))).groupBy("name").agg(F.count("*").alias("n"))
    low = counts.select("name", "n", F.lower("name").alias("low"))
    k = known.select(F.lower(squash(F.col("name"))).alias("name")).distinct()
    near = _contained_either_way(low.select(F.col("low").alias("name")), k).withColumnRenamed("name", "low")
    tokens = k.select(F.col("name").alias("known"), F.get(_tokens(F.col("name")), 0).alias("f"))
    same = (low.withColumn("f", F.get(_tokens(F.col("low")), 0)).join(tokens, "f")
            .filter(same_entity(F.col("low"), F.col("known"))).select("low").distinct())
    return low.join(near, "low", "left_anti").join(same, "low", "left_anti").select("name", "n")


def discover(m: DataFrame, known: DataFrame, roles: DataFrame, min_mentions: int = 2) -> DataFrame:
    """Candidates merged to their longest spelling with summed mentions; each with its outcome and reason."""
    cand = unknown_candidates(m, known)
    comp = components(same_entity_edges(cand), cand, "name", "other", "name")
    merged = cand.join(comp, "name").groupBy("component").agg(
        F.min_by("name", F.struct(-F.length("name"), F.col("name"))).alias("name"), F.sum("n").alias("mentions"))
    judged = merged.filter(F.col("mentions") >= min_mentions).join(roles, "name", "left")
    role = F.lower(F.trim("role"))
    reason = (F.when(role.isNull(), "not_returned").when(role.isin(*V.NON_SUBJECT_ROLES), role))
    return judged.select("name", "mentions", reason.alias("reason"),
                         F.when(reason.isNull(), "candidate").otherwise("rejected").alias("outcome"))
