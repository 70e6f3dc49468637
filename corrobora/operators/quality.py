"""Checks on transcripts, documents and reports."""
from __future__ import annotations

import re

from pyspark.ml.feature import HashingTF, IDF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from corrobora.functions import exprs as X, vocab as V
from corrobora.functions.text import find_all, found_literals, matches, once, squash, tok, word_count, words, words4
from corrobora.operators.accounting import monoculture, tallies
from corrobora.session import cut, spread


# --- transcripts -----------------------------------------------------------------------------------
def validate_transcripts(df: DataFrame, relevance: DataFrame, key: str = "url") -> DataFrame:
    """Length, duration and relevance gates in that order; an unanswered relevance check keeps the row."""
    n = word_count(F.col("text"))
    expected = F.col("duration_s") / 60.0 * V.WORDS_PER_MINUTE
    ratio = F.when(F.col("duration_s") > 0, F.bround(n / expected, 3))
    rows = df.withColumn("n_words", n).withColumn("_ratio", ratio).join(relevance, key, "left")
    short = F.col("n_words") < V.MIN_WORDS
    broken = F.coalesce(F.col("_ratio") < V.DROP_RATIO, F.lit(False))
    flags = F.array_compact(F.array(
        F.when(F.col("_ratio") < V.FLAG_RATIO, "wordcount_suspect"),
        F.when(F.col("relevance") == "no", "irrelevant").when(
            F.coalesce(F.col("relevance") != "yes", F.lit(True)), "relevance_gate_error_kept")))
    reasons = (F.when(short, F.array(F.lit("under_100_words"))).when(broken, F.array(F.lit("far_under_duration")))
               .otherwise(flags))
    passed = ~short & ~broken & ~F.coalesce(F.col("relevance") == "no", F.lit(False))
    return rows.select(key, "n_words", F.when(~short, F.col("_ratio")).alias("wordcount_ratio"),
                       passed.alias("passed"), reasons.alias("reasons"))


# --- style -----------------------------------------------------------------------------------------
def voice_lint(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Violation rows (kind, detail, display: the detail cut for a list): banned phrases, long questions, openers without a concrete anchor."""
    t = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(t)
    phrases = once(low, lambda q: found_literals(q, V.BANNED_PHRASES))
    questions = F.filter(F.transform(find_all(t, r"(?<![^.!?])[^.!?]*+\?"), lambda q: F.trim(q)), lambda q: F.length(q) > 12)
    anchored = lambda s: F.substring(s, 4, 2**31 - 1).rlike(r"\b[A-Z][a-z]{2,}|\b\d+\b") | matches(s, V.NUMBER_WORD_ANCHOR)
    opener = once(F.substring_index(F.trim(t), ".", 1), lambda s: F.when((s != "") & ~anchored(s), F.array(s)).otherwise(
        F.array().cast("array<string>")))
    tag = lambda xs, kind: F.transform(xs, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("detail"), F.substring(x, 1, V.DISPLAY_CHARS).alias("display")))
    found = F.concat(tag(phrases, "banned phrase"),
                     tag(questions, "rhetorical question"),
                     tag(opener, "mood opener"))
    return docs.select(key, F.inline(found))


# --- fidelity --------------------------------------------------------------------------------------
def count_fidelity(reports: DataFrame, profiles: DataFrame, on: str = "report_id") -> DataFrame:
    """Numbers a report states for a status that differ from the tally.

    The gap between number and status may hold neither another number nor another status, and a hedge
    within 24 characters before the number exempts it; both are look-arounds, so it stays native.
    """
    t = cut(tallies(profiles, on).select(on, "status", "n"))
    known = t.groupBy(on).agg(F.collect_set("status").alias("all"))     # a closed set of statuses
    table = F.create_map(*[F.lit(x) for kv in V.COUNT_WORDS.items() for x in kv])
    value = lambda w: F.coalesce(F.try_element_at(table, w), w.try_cast("int"))
    names = [r["status"] for r in t.select("status").distinct().limit(STATUS_LIMIT + 1).collect()]
    if len(names) > STATUS_LIMIT:
        raise ValueError(f"more than {STATUS_LIMIT} statuses: normalise them to the closed set first")
    text = F.coalesce("text", F.lit(""))
    claims = F.lit(None)
    for s in sorted(names):     # one constant pattern per status, compiled once
        claims = F.when(F.col("status") == s, F.arrays_zip(
            find_all(text, _count_pattern(s), 1).alias("said"), find_all(text, _count_pattern(s), 2).alias("gap"))).otherwise(claims)
    others = F.array_join(F.filter("all", lambda s: s != F.col("status")), "|")
    rows = (t.join(known, on).join(reports.select(on, "text"), on)
            .select(on, "status", "n", others.alias("others"), F.inline(claims)))
    other_in_gap = (F.col("others") != "") & F.rlike(F.col("gap"), F.concat(F.lit(r"(?i)\b(?:"), "others", F.lit(r")\b")))
    return (rows.filter(~other_in_gap & (value(F.lower("said")) != F.col("n")))
            .select(on, "status", F.col("n").alias("recorded"), F.lower("said").alias("said")))


STATUS_LIMIT = 64


def _count_pattern(status: str) -> str:
    """Number, short gap without another number, status; not preceded by a hedge."""
    number = r"\d{1,3}|" + "|".join(V.COUNT_WORDS)
    unhedged = "".join(rf"(?<!{h}.{{0,{24 - len(h)}}})" for h in V.COUNT_HEDGES)
    return rf"(?is)\b(?=(?:{number})\b){unhedged}({number})\b\s*((?:(?!\b(?:{number})\b)[^.]){{0,40}}?){re.escape(status)}"


def _spans(low: Column, needle: Column, size: int = 320) -> Column:
    """Text windows starting at each occurrence of the needle."""
    n = ((F.length(low) - F.length(F.replace(low, needle, F.lit("")))) / F.greatest(F.length(needle), F.lit(1))).cast("int")
    at = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.length(F.call_function("substring_index", low, needle, i)) + 1)
    return F.when(n > 0, F.transform(at, lambda p: F.substr(low, p, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def profile_fidelity(reports: DataFrame, profiles: DataFrame, on: str = "report_id") -> DataFrame:
    """Does the report still say what the profiles say? Rows (name, kind, detail): MISSING, LOST, INVENTED.

    Each person is judged on the passage that carries most of their facts, full name before surname.
    """
    rows = profiles.join(reports.select(on, F.lower(F.coalesce("text", F.lit(""))).alias("low")), on).filter(squash(F.col("name")) != "")
    rows = rows.withColumn("_nm", F.lower(squash(F.col("name")))).withColumn("_sn", F.element_at(F.split("_nm", " "), -1))
    low, name, surname = F.col("low"), F.col("_nm"), F.col("_sn")
    status, cause = F.lower(F.coalesce("status", F.lit(""))), F.trim(F.coalesce("cause", F.lit("")))
    wanted = F.array_distinct(find_all(F.concat_ws(" ", F.coalesce("status", F.lit("")), cause), "[a-z]{4,}"))
    rows = rows.withColumn("_w", wanted).withColumn("_full", _spans(low, name)).withColumn("_short", _spans(low, surname))
    score = lambda s: F.size(F.filter("_w", lambda w: F.contains(s, w)))
    scored = lambda c, r: F.transform(F.col(c), lambda s, i: F.struct(
        (-score(s)).alias("o"), F.lit(r).alias("r"), i.alias("i"), s.alias("span")))
    rows = rows.withColumn("_f", F.array_min(scored("_full", 0))).withColumn("_a", F.array_min(F.concat(scored("_full", 0), scored("_short", 1))))
    seg = F.coalesce(F.when(F.col("_f.o") < 0, F.col("_f.span")).otherwise(F.col("_a.span")), F.lit(""))
    rows = rows.withColumn("_seg", seg)
    present = F.contains(low, name) | F.contains(low, surname)
    head = F.slice(find_all(F.lower(cause), "[a-z]{4,}"), 1, 2)
    case = lambda cond, kind, detail: F.when(cond, F.struct(F.lit(kind).alias("kind"), detail.alias("detail"), F.substring(detail, 1, V.CAUSE_CHARS + 6).alias("display")))
    found = F.array_compact(F.array(
        case(~present, "MISSING", F.lit("not in the report")),
        case(present & ~status.isin("", "unknown") & ~F.contains("_seg", status), "LOST", F.concat(F.lit("status "), status)),
        case(present & (F.size(head) > 0) & ~F.exists(head, lambda h: F.contains(F.col("_seg"), h)), "LOST", F.concat(F.lit("cause "), cause)),
        case(present & (status == "missing") & F.col("_seg").rlike(V.IMPLIES_DEATH), "INVENTED", F.lit("implies death"))))
    return rows.select(on, "name", F.inline(found))


# --- artifact challenge ----------------------------------------------------------------------------
def challenge(artifacts: DataFrame, samples: DataFrame) -> DataFrame:
    """Verdict per artifact (artifact_id, kind, case_text): no output escalates, any flag fails, else pass."""
    joined = samples.join(artifacts, "artifact_id")
    ws, case_terms = words4(F.col("text")), words4(F.col("case_text"))
    question = (F.col("kind") == "questions") & (X.bad_question(F.col("text")) != "")
    off = ((F.col("kind") == "findings") & (F.size(case_terms) > 0) & (F.size(ws) > 0) & ~F.arrays_overlap(ws, case_terms))
    stub = word_count(F.col("text")) < 3
    per = joined.groupBy("artifact_id").agg(
        F.count("*").alias("n_samples"), F.count_if(question).alias("unusable"), F.count_if(off).alias("off_case"), F.count_if(stub).alias("stubs"))
    mono = monoculture(joined.filter("kind = 'questions'"), "artifact_id").select("artifact_id", F.col("monoculture").cast("long").alias("mono"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    flags = z("unusable") + z("off_case") + z("stubs") + z("mono")
    return (artifacts.select("artifact_id").join(per, "artifact_id", "left").join(mono, "artifact_id", "left")
            .select("artifact_id", z("n_samples").alias("n_samples"), flags.alias("n_flags"),
                    F.when(z("n_samples") == 0, "escalate").when(flags > 0, "fail").otherwise("pass").alias("verdict")))


def grounded(suggestions: DataFrame, cases: DataFrame, cap: int | None = None, by: str = "case_id") -> DataFrame:
    """Suggested questions whose capitalised words touch the case at least once; usable, distinct, capped."""
    s = suggestions.join(cases.select(by, F.lower("case_text").alias("_case")), by).withColumn("q", squash(F.col("text")))
    caps = F.filter(find_all(F.col("q"), r"\b[A-Z][a-z]{2,}\b"), lambda w: ~F.lower(w).isin(*V.STOP_CAPS))
    anchored = F.exists(caps, lambda w: F.contains(F.col("_case"), F.lower(w)))
    ok = s.filter((F.col("q") != "") & ((F.size(caps) == 0) | anchored) & (X.bad_question(F.col("q")) == ""))
    first = ok.groupBy(by, F.lower("q").alias("k")).agg(F.min(F.struct("pos", "q")).alias("m"))
    total = first.groupBy(by).agg(F.count("*").alias("n_total"))
    rank = F.row_number().over(W.partitionBy(by).orderBy("m"))
    ranked = first.withColumn("rank", rank)
    ranked = ranked if cap is None else ranked.filter(F.col("rank") <= cap)
    return ranked.join(total, by).select(by, "rank", F.col("m.q").alias("q"), "n_total")


# --- hooks -----------------------------------------------------------------------------------------
def featurize(df: DataFrame, key: str, text: str = "text", dim: int = 1024) -> DataFrame:
    """Unit TF-IDF vectors for tables without embeddings; index and queries must share one call."""
    toks = df.select(key, tok(F.col(text)).alias("toks"))
    tf = HashingTF(inputCol="toks", outputCol="tf", numFeatures=dim).transform(toks)
    tfidf = IDF(inputCol="tf", outputCol="w").fit(tf).transform(tf)
    return Normalizer(inputCol="w", outputCol="v").transform(tfidf).select(key, vector_to_array("v").alias("embedding"))


def person_queries_lateral(entities: DataFrame, key: str = "entity_id", cap: int | None = None) -> DataFrame:
    """The name and angle fan-out as rows (pos, query), a lateral join with the native array."""
    asked = X.person_queries(F.col("name"), F.col("context"), cap=cap)
    return spread(entities.select(key, "name", "context")).select(key, F.posexplode(asked).alias("pos", "query"))


def register_person_queries(spark, cap: int | None = None, name: str = "person_queries") -> None:
    """Make ``name(name, context)`` a SQL table function with rows (pos, query), to be called with LATERAL. Its body is one
    expression over its arguments, so the engine inlines it and no Python worker runs."""
    lit = lambda w: "'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'"
    n, c = (rf"trim(regexp_replace(coalesce({x}, ''), r'\s+', ' '))" for x in ("person", "context"))
    angles = [lit(" " + a) for a in X.distinct_angles(V.PERSON_ANGLES)][:None if cap is None else max(int(cap) - 1, 0)]
    # one member arrays stand for names: what is in them is computed once for each row
    base = "trim(concat(p.n, if(p.c = '', '', ' '), p.c))"
    asked = f"transform(array({base}), b -> array({', '.join(['b', *(f'concat(b, {a})' for a in angles)])}))[0]"
    asked = asked if cap is None or cap > 0 else f"slice({asked}, 1, {int(cap)})"
    whole = f"transform(array(named_struct('n', {n}, 'c', substring({c}, 1, 40))), p -> CASE WHEN p.n = '' THEN cast(array() AS array<string>) ELSE {asked} END)[0]"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(person STRING, context STRING) RETURNS TABLE (pos INT, query STRING)
        RETURN SELECT * FROM posexplode({whole}) AS t(pos, query)""")
