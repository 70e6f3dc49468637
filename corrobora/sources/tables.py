"""Reading, writing and reshaping the evidence tables."""
from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from corrobora import schemas
from corrobora.functions import vocab as V
from corrobora.functions.text import any_literal, find_all, squash
from corrobora.session import ship


# --- findings --------------------------------------------------------------------------------------
def all_findings(df: DataFrame, branch: str | None = None) -> DataFrame:
    """Every finding of a branch (or of all): nothing is cut, defaults are filled on read."""
    rows = df.filter((F.col("node_kind").isNull() | (F.col("node_kind") == "finding"))
                     & (squash(F.col("claim")) != ""))
    if branch is not None:
        rows = rows.filter(F.col("branch_id") == branch)
    real = lambda xs: F.filter(F.coalesce(F.col(xs), F.array().cast("array<string>")),
                               lambda x: (x != "_") & (x != ""))
    return rows.select(
        "finding_id", "branch_id", "claim", real("source_types").alias("source_types"),
        real("urls").alias("urls"),
        F.coalesce("confidence_tier", F.lit(V.DEFAULT_TIER)).alias("confidence_tier"),
        F.coalesce("corroboration_count", F.lit(1)).alias("corroboration_count"))


def write_findings(df: DataFrame, path: str) -> None:
    """Branch-partitioned sink; only the branches present in ``df`` are replaced."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("branch_id").parquet(path))


def read_findings(spark: SparkSession, path: str, branch: str | None = None) -> DataFrame:
    df = spark.read.schema(schemas.FINDINGS).parquet(path)
    return df if branch is None else df.filter(F.col("branch_id") == branch)


def branch_stats(df: DataFrame) -> DataFrame:
    return (df.rollup("branch_id").agg(F.count("*").alias("n"), F.grouping("branch_id").alias("g"))
            .select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("branch_id")).alias("branch_id"), "n")
            .orderBy(F.desc("n"), "branch_id"))


def get_metas(df: DataFrame, ids: DataFrame, key: str = "finding_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def delete_nodes(df: DataFrame, ids: DataFrame, key: str = "finding_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def write_edges(edges: DataFrame, path: str, fmt: str = "json") -> None:
    """Neighbour export, one folder per branch."""
    edges.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("branch_id").format(fmt).save(path)


# --- raw sources -----------------------------------------------------------------------------------
def upsert_raw(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Latest text per (url, branch). ``max_by`` combines map-side, so a hot url shuffles one row per task."""
    cols = ["url", "branch_id", "title", "source_type", "raw_text", "created_at"]
    rows = existing.select(cols).unionByName(new.select(cols)).filter(
        (squash(F.col("url")) != "") & (squash(F.col("raw_text")) != ""))
    latest = F.max(F.struct("created_at", "raw_text", "title", "source_type")).alias("r")
    return (rows.groupBy("url", "branch_id").agg(latest)
            .select("url", "branch_id", "r.title", "r.source_type", "r.raw_text",
                    F.length("r.raw_text").cast("long").alias("char_len"), "r.created_at"))


def link_raw(findings: DataFrame, raw: DataFrame) -> DataFrame:
    """Each finding next to the stored text of each url it cites; unmatched urls stay with null text."""
    cited = findings.select("finding_id", "branch_id", F.explode("urls").alias("url"))
    return cited.join(raw.select("url", "branch_id", "char_len", "raw_text"), ["url", "branch_id"], "left")


# --- JSON-lines ledgers ----------------------------------------------------------------------------
def read_ledger(spark: SparkSession, path: str, schema: T.StructType, branch: str | None = None) -> DataFrame:
    """Append-only ledger; blank lines and unreadable lines are skipped."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return df if branch is None else df.filter(F.col("branch_id") == branch)


def append_ledger(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


# --- text sources ----------------------------------------------------------------------------------
@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    """Full named/numeric entity set; the only step without a native expression."""
    return texts.map(lambda s: html.unescape(s) if s is not None and "&" in s else s)


def html_text(c: Column, min_chars: int = 200) -> Column:
    ship(SparkSession.active())
    s = F.regexp_replace(c, V.HTML_UNREAD, " ")
    s = F.regexp_replace(s, V.HTML_TAG, " ")
    s = F.trim(F.regexp_replace(_unescape(s), r"\s+", " "))
    return F.when(F.length(s) >= min_chars, s)


def html_to_text(pages: DataFrame, min_chars: int = 200) -> DataFrame:
    return pages.withColumn("text", html_text(F.col("html"), min_chars)).drop("html")


def normalize_captions(df: DataFrame, col: str = "raw") -> DataFrame:
    """Caption files to plain text: JSON segments joined, otherwise cue lines dropped and tags removed."""
    raw = F.coalesce(F.col(col), F.lit(""))
    is_json = raw.rlike(r"^\s*[\{\[]")
    wrapped = F.when(raw.rlike(r"^\s*\["), F.concat(F.lit('{"segments":'), raw, F.lit("}"))).otherwise(raw)
    parsed = F.from_json(F.when(is_json, wrapped), T.StructType([
        T.StructField("segments", schemas.SEGMENTS), T.StructField("body", schemas.SEGMENTS)]))
    joined = F.array_join(F.transform(F.coalesce(parsed["segments"], parsed["body"]),
                                      lambda s: F.coalesce(s["text"], F.lit(""))), " ")
    # a list of plain strings
    strings = F.array_join(F.from_json(F.when(raw.rlike(r'^\s*\[\s*"'), raw), "array<string>"), " ")
    joined = F.coalesce(F.nullif(strings, F.lit("")), joined)
    lines = F.transform(F.split(raw, r"\r\n|\n|\r"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: (x != "") & (x != "WEBVTT") & ~x.rlike(V.CUE_NUMBER) & ~x.contains("-->"))
    plain = F.array_join(F.transform(kept, lambda x: F.regexp_replace(x, V.CAPTION_TAG, "")), " ")
    return df.withColumn("text", F.when(is_json & (F.trim(joined) != ""), joined).otherwise(plain))


def ordered_links(text: Column) -> Column:
    """Links of one page: first-seen order, repeats and noise hosts dropped, source-looking hosts first.

    Stays inside the row, so no shuffle however many pages there are.
    """
    found = F.concat(find_all(text, V.MARKDOWN_LINK, 1),
                     find_all(text, V.BARE_LINK))
    urls = F.array_distinct(F.transform(found, lambda u: F.rtrim(u, F.lit(".,);]"))))
    urls = F.filter(urls, lambda u: ~any_literal(F.lower(u), V.CHASE_NOISE))
    source = lambda u: any_literal(F.lower(u), V.SOURCE_HINTS)
    return F.concat(F.filter(urls, source), F.filter(urls, lambda u: ~source(u)))


def outbound_links(pages: DataFrame, key: str = "page_id", col: str = "text") -> DataFrame:
    return pages.select(key, F.posexplode(ordered_links(F.col(col))).alias("rank", "url"))


def description_links(df: DataFrame, key: str, col: str) -> DataFrame:
    """Source links of a video description page: redirect targets unwrapped, social hosts dropped."""
    page = F.col(col)
    wrapped = find_all(page, V.REDIRECT_LINK, 1)
    targets = F.transform(wrapped, lambda u: F.try_url_decode(F.try_parse_url(
        F.regexp_replace(u, r"\\u0026", "&"), F.lit("QUERY"), F.lit("q"))))
    targets = F.filter(targets, lambda u: u.startswith("http"))
    described = F.regexp_extract(page, V.DESCRIPTION_TEXT, 1)
    # the whole JSON string is decoded, so an escaped character never cuts a link
    described = F.from_json(F.concat(F.lit('{"d":"'), described, F.lit('"}')), "d string")["d"]
    plain = find_all(F.coalesce(described, F.lit("")), V.DESCRIPTION_LINK)
    links = F.array_sort(F.array_distinct(F.concat(targets, plain)))
    kept = F.filter(links, lambda u: ~any_literal(F.lower(u), V.DESCRIPTION_NOISE))
    return df.select(key, F.posexplode(kept).alias("rank", "url"))
