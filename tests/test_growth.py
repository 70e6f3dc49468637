"""Work that is done once for each row or text, and tables that travel once; results against plain Python."""
import re

from pyspark.sql import functions as F

from corrobora.functions import exprs as X
from corrobora.operators import lexical, quality
from corrobora.plans.catalog import load_all

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_slug_reads_the_head_of_a_text(spark):
    texts = ["", None, "?! …", "One two", "a-b c_d é İx Kb e f g.h , , i j k l m", "x" * 90, " \n lead  and\ttabs ", "é é é 1 2 3 4 5 6 7 8 9",
             "word " * 5000, "!" * 3000 + " z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", "t", X.slug(F.col("t"), F.lit("find_abcdef")).alias("s"))
    for r in df.collect():
        ws = re.sub(r"[^a-z0-9\s]", "", re.sub("İ", "i", (r["t"] or "").lower().replace("i̇", "i")), flags=re.A)
        want = "-".join(re.sub(r"[^a-z0-9 \t\n\r\f\v]", "", ws).split()[:8])[:60].strip("-") or "finding"
        assert r["s"] == want + "--abcdef", r["t"]
    assert "regexp_replace(lower(regexp_extract(" in plan(df).replace("coalesce", "")


def test_person_queries_are_put_together_once_for_each_row(spark, rows):
    e = rows("entity_id int, name string, context string", (1, " Mara  Voss", "x" * 50), (2, "", "c"), (3, "Ilya", None))
    df = quality.person_queries_lateral(e, cap=3)
    assert plan(df).count("regexp_replace") == 2 and "Repartition" in plan(df)
    got = [(r["entity_id"], r["pos"], r["query"]) for r in df.orderBy("entity_id", "pos").collect()]
    angles = X.distinct_angles(X.V.PERSON_ANGLES)[:2]
    want = [(i, p, q) for i, b in ((1, "Mara Voss " + "x" * 40), (3, "Ilya")) for p, q in enumerate([b, *(f"{b} {a}" for a in angles)])]
    assert got == want


def test_an_index_of_a_text_is_made_where_the_text_is(spark):
    df = load_all()["B24_rebuild_abstract"].run(spark, SF)
    assert "hashpartitioning(work_id" in df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(work_id#\d+L, word", df._jdf.queryExecution().executedPlan().toString())
    assert df.count() == spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id % 5 <> 0").count()


def test_words_are_counted_where_their_document_is(spark, rows):
    d = rows("doc_id int, text string", (1, "a a b"), (2, "b"), (3, ""))
    index = lexical.bm25_index(d)
    assert not re.search(r"Exchange hashpartitioning\(doc_id#\d+, term#\d+", index._jdf.queryExecution().executedPlan().toString())
    assert sorted((r["doc_id"], r["term"], r["tf"], r["dl"]) for r in index.collect()) == [(1, "a", 2, 3), (1, "b", 1, 3), (2, "b", 1, 1)]
