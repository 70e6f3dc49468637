"""Secret scans: fixed patterns, and two character Markov models. DataFrame operations only.

One model knows random strings, the other ordinary identifiers; both are character transitions counted over labelled
samples. Random ones are what the fixed patterns find in all documents and uniform strings of every repertoire, in equal
shares; ordinary ones are words of sampled documents and identifiers made of them. A long token whose log-likelihood ratio
is high enough is a secret, whatever stands around it. What is enough is set for tokens without upper-case letters, without
lower-case ones and for the others: at most ``RATE`` of the identifiers made of words held out from the models reach it.

Where a text has matches, their places follow from the lengths of what lies between them (``split`` by the same
pattern), in code points. Defined cases: null and empty texts have no spans; a null id is kept; every row of docs has
one row; without held-out words nothing is added to the fixed patterns.
"""
from __future__ import annotations

import math
import random
import re

from pyspark.sql import Column, DataFrame, functions as F

from corrobora.llm.common import keep
from corrobora.llm.mixing import constant

#: fixed values: the patterns of the contract; (?i) covers ASCII letters only. Matches that the rule drops aren't retried:
#: the runs of access and hex are maximal, so their least lengths can stand in the pattern.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ORDINARY = r"(?<![A-Za-z0-9+/_=-])[A-Za-z][A-Za-z0-9_-]{7,}(?![A-Za-z0-9+/_=-])"
SAMPLE = 5_000          # documents that the samples are taken from, about
LEAST = 40.0            # log-likelihood ratio of a secret, in nats, where a caller brings a table
LEAST_MEAN = 1.8        # and for each character
RATE = 0.001            # of held-out identifiers that may pass for secrets, in each repertoire
SURE = math.log(1 / RATE)       # a secret's ratio at least, whatever the held-out identifiers have
WORDS = 4_000           # words that identifiers are made of, of either side
UNIFORM = 20_000        # transitions counted for each repertoire of random strings
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
REPERTOIRES = (_LOWER + _DIGITS, _UPPER + _DIGITS, _LOWER + _UPPER + _DIGITS, _LOWER + _UPPER + _DIGITS + "+/", _LOWER + _UPPER + _DIGITS + "-_",
               _UPPER + "234567", _LOWER, _UPPER, _DIGITS + "abcdef", _DIGITS + "ABCDEF")


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def places(text: Column, found: Column, pattern: str, kind: int) -> Column:
    """Structs (start, kind, end, m) of all matches of pattern, which ``found`` holds."""
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    kind_of = "array<struct<start:int,kind:int,end:int,m:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind_of).alias("out"))
    def step(acc, x):
        begin = acc["at"] + F.length(x["g"])
        end = begin + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(
            begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["m"].alias("m")))).alias("out"))
    pairs = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    return F.when(F.size(found) == 0, F.array().cast(kind_of)).otherwise(F.aggregate(pairs, start, step, lambda a: a["out"]))


def found_in(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, and the matches of each pattern."""
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return own.select("doc_id", "text", matches(F.col("text"), ASSIGN).alias("m_assign"), matches(F.col("text"), ACCESS).alias("m_access"),
                      matches(F.col("text"), HEX).alias("m_hex"), matches(F.col("text"), CANDIDATE).alias("m_random"))


# ---------------------------------------------------------------- models

def train(samples: DataFrame, alpha: float = 0.2, more: dict | None = None) -> list[float]:
    """samples: text, random (boolean); more: counts (random, a, b) beside theirs. The log-likelihood ratio of every two
    following characters, as one table."""
    n = len(ALPHABET) + 1                                             # place 0: before the first character
    codes = F.filter(F.transform(F.split("text", ""), lambda c: F.instr(F.lit(ALPHABET), c)), lambda c: c > 0)
    pairs = samples.filter("text is not null and text <> ''").select("random", F.concat(F.array(F.lit(0)), codes).alias("c"))
    steps = pairs.select("random", F.inline(F.zip_with(F.col("c"), F.slice(F.col("c"), F.lit(2), F.greatest(F.lit(0), F.size("c") - 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))))
    got = {(r["random"], r["a"], r["b"]): r["n"] for r in steps.filter("b is not null").groupBy("random", "a", "b").agg(F.count("*").alias("n")).collect()}
    if more:                                                          # what was found weighs as much as one repertoire
        found = sum(v for k, v in got.items() if k[0]) or 1
        got = {k: v * min(1.0, UNIFORM / found) if k[0] else v for k, v in got.items()}
        for k, v in more.items():
            got[k] = got.get(k, 0) + v
    table = [0.0] * (n * n)
    for a in range(n):
        of = {k: sum(got.get((k, a, b), 0) for b in range(1, n)) for k in (True, False)}
        for b in range(1, n):
            p = {k: (got.get((k, a, b), 0) + alpha) / (of[k] + alpha * (n - 1)) for k in (True, False)}
            table[a * n + b] = round(math.log(p[True]) - math.log(p[False]), 4)
    return table


def repertoire_py(token: str) -> int:
    """0: no upper-case letters, 1: no lower-case ones, 2: both."""
    return 0 if not re.search("[A-Z]", token) else 1 if not re.search("[a-z]", token) else 2


def repertoire(token: Column) -> Column:
    return F.when(~token.rlike("[A-Z]"), 0).when(~token.rlike("[a-z]"), 1).otherwise(2)


def identifiers(words: list[str], seed: int) -> list[str]:
    """Names of twenty characters and more, as they are made of words: joined or with signs, in every case, with a number
    or a day."""
    rng, out = random.Random(seed), []
    for i in range(len(words)):
        parts, n = [], 0
        while n < 20:
            parts.append(words[(i + len(parts)) % len(words)].lower())
            n += len(parts[-1])
        title = [p[:1].upper() + p[1:] for p in parts]
        number, day = str(rng.randrange(10_000)), f"20{rng.randrange(30):02d}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}"
        lower = ["".join(parts), "_".join(parts), "-".join(parts), "_".join([*parts, number]), "-".join([day, *parts]), "/".join(parts)]
        out += [*lower, *[x.upper() for x in lower], "".join(title), parts[0] + "".join(title[1:]), "".join([*title, number]), "-".join(title), "_".join(title)]
    return out


def made_counts(names: list[str]) -> dict:
    """Transitions of identifiers, and of uniform strings of all repertoires."""
    at, got = {c: i + 1 for i, c in enumerate(ALPHABET)}, {}
    for name in names:
        last = 0
        for code in filter(None, map(at.get, name)):
            got[False, last, code] = got.get((False, last, code), 0) + 1
            last = code
    for letters in REPERTOIRES:
        for b in letters:
            got[True, 0, at[b]] = got.get((True, 0, at[b]), 0) + UNIFORM / 32 / len(letters)
            for a in letters:
                got[True, at[a], at[b]] = got.get((True, at[a], at[b]), 0) + UNIFORM / len(letters) ** 2
    return got


def ratio_py(token: str, table: list[float]) -> float:
    last, total = 0, 0.0
    for c in token:
        code = ALPHABET.find(c) + 1
        total, last = total + table[last * (len(ALPHABET) + 1) + code], code
    return total


def learned(samples: DataFrame) -> tuple[list[float], list[float]]:
    """samples: text, random. The table, and the least ratio of a secret in each repertoire. Every fourth ordinary word, by its
    hash, is held out."""
    held = F.pmod(F.xxhash64("text", F.lit(17)), F.lit(4).cast("long")) == 0
    words = samples.filter(~F.col("random")).select("text").distinct()
    some = lambda side: [r["text"] for r in words.filter(side).orderBy(F.xxhash64("text", F.lit(19)), "text").limit(WORDS).collect()]
    table = train(samples.filter(F.col("random") | ~held), more=made_counts(identifiers(some(~held), 1)))
    reached: list[list[float]] = [[], [], []]
    for name in identifiers(some(held), 2):
        reached[repertoire_py(name)].append(ratio_py(name, table))
    return table, [least_of(sorted(x, reverse=True)) for x in reached]


def least_of(ratios: list[float]) -> float:
    """The least ratio of a secret: less than RATE of the falling ratios are over it. Too few to tell: LEAST above them all."""
    if not ratios:
        return math.inf
    return max(SURE, ratios[int(RATE * len(ratios))] + 1e-3 if len(ratios) >= 1 / RATE else ratios[0] + LEAST)


def samples_of(found: DataFrame, n_docs: int, sample: int = SAMPLE) -> DataFrame:
    """Labelled samples from about ``sample`` documents (all, if there are no more), chosen by a hash of the id: what the
    fixed patterns found is random, other words of eight characters and more are ordinary."""
    share = min(1.0, sample / max(1, n_docs))
    some = found.filter(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 20).cast("long")) < int(share * (1 << 20)) + (share == 1.0))
    secret = F.concat(F.transform("m_assign", lambda m: F.regexp_extract(m, ASSIGN, 2)), F.col("m_access"), F.col("m_hex"))
    plain = matches(F.regexp_replace("text", f"{ASSIGN}|{ACCESS}|{HEX}", " "), ORDINARY)
    both = some.select(F.array_distinct(secret).alias("s"), F.array_distinct(plain).alias("p"))
    return (both.select(F.lit(True).alias("random"), F.explode("s").alias("text")).filter(F.length("text") >= 16)
            .unionByName(both.select(F.lit(False).alias("random"), F.explode("p").alias("text"))))


def ratio(token: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of a token of the alphabet's characters."""
    n = len(ALPHABET) + 1
    start = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum"))
    t = constant(table, "array<double>")
    def step(acc, c):
        code = F.instr(F.lit(ALPHABET), c)
        return F.struct(code.alias("last"), (acc["sum"] + F.get(t, acc["last"] * n + code)).alias("sum"))
    return F.aggregate(F.split(token, ""), start, step, lambda a: a["sum"])


# ---------------------------------------------------------------- the operator

def scan(docs: DataFrame, table: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text",
         least: float = LEAST, least_mean: float = LEAST_MEAN) -> DataFrame:
    """doc_id, spans: array of (start, kind, end, m), ordered by start, then kind; kind counts within KINDS. ``least`` and
    ``least_mean`` go with a given table; otherwise both are learned."""
    found = found_in(docs, id_col, text_col)
    text, enough = F.col("text"), lambda m: F.greatest(F.lit(least), F.length(m) * least_mean)
    if table is None:
        small = docs.select(docs[id_col].cast("long").alias("doc_id"))
        n = small.count()
        share = min(1.0, SAMPLE / max(1, n))
        few = docs.filter(F.pmod(F.xxhash64(docs[id_col].cast("long"), F.lit(13)), F.lit(1 << 20).cast("long")) < int(share * (1 << 20)) + 1)
        secrets = samples_of(found, 0).filter("random")
        table, bounds = learned(keep(samples_of(found_in(few, id_col, text_col), 0).filter("not random").unionByName(secrets), "samples"))
        enough = lambda m: F.when(repertoire(m) == 0, bounds[0]).when(repertoire(m) == 1, bounds[1]).otherwise(bounds[2])
    likely = F.filter("m_random", lambda m: ratio(m, table) >= enough(m))
    rows = found.withColumn("likely", likely)
    assign = F.filter(places(text, F.col("m_assign"), ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["m"], ASSIGN, 2)) >= 8)
    base = rows.withColumn("base", F.concat(assign, places(text, F.col("m_access"), ACCESS, 1), places(text, F.col("m_hex"), HEX, 2)))
    runs = F.when(F.size("likely") == 0, F.array().cast("array<struct<start:int,kind:int,end:int,m:string>>")).otherwise(
        F.filter(places(text, F.col("m_random"), CANDIDATE, 3), lambda s: F.array_contains("likely", s["m"]) & ~F.exists(
            "base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))
    return base.select("doc_id", F.array_sort(F.concat("base", runs)).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def secret_digest(docs: DataFrame, table: list[float] | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (all of them, joined), n_random."""
    found = scan(docs, table)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = joined(F.filter("spans", lambda s: s["kind"] < 3))
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count(3).alias("n_random"))
