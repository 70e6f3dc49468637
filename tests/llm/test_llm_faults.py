"""Cases that went wrong once: overlapping fragments, account numbers before words, fully labelled tables, odd column names."""
import random

import pytest
from pyspark.sql import functions as F
from test_llm_corpus import SF, plain_tiles

from corrobora.llm import decontaminate, mixing, pages, personal, quality, simhash


def test_overlapping_fragments_are_tiled_whole():
    w = [f"w{i}" for i in range(14)]
    doc = w[5:11] + w[:6] + [f"x{i}" for i in range(20)]
    assert sorted(decontaminate.tiles(doc, w, 5)) == [(0, 5, 6), (6, 0, 5)] or sum(n for *_, n in decontaminate.tiles(doc, w, 5)) == 11
    rng = random.Random(6)
    for _ in range(400):
        item = [f"w{i}" for i in range(rng.randrange(10, 40))]
        doc = []
        while len(doc) < 60:
            at = rng.randrange(len(item))
            doc += item[at:at + rng.randrange(1, 15)] + ["x"] * rng.randrange(2)
        got, want = decontaminate.tiles(doc, item, 5), plain_tiles(doc, item, 5)
        assert sorted(got) == sorted(want)


def test_account_numbers_end_where_their_country_says():
    de = "DE89 3704 0044 0532 0130 00"
    for text in (f"{de} BIC", f"{de}.", de, f"IBAN {de} COBADEFF and more", f"{de.replace(' ', '')} 12 ABC", f"{de} 99 99 99 99 99 99 99 99"):
        at = text.index("DE89")
        end = at + (22 if "DE893704" in text else len(de))
        assert list(personal._ibans(text)) == [(at, end)], text
    assert list(personal._ibans("DE89 3704 0044 0532 0130 01 BIC")) == []
    assert len(list(personal._ibans(f"{de} GB82 WEST 1234 5698 7654 32"))) == 2
    assert list(personal._ibans(f"{de}7 and")) == [] and list(personal._ibans("")) == []


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").limit(120)


NAMES = ("a.b", "__id", "__tokens", "__h", "__row", "column1", "fp", "rep")


def test_stages_bear_any_column_name(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    odd = docs.withColumns({n: F.lit(i) for i, n in enumerate(NAMES)})
    model = quality.train(odd, labels)
    for out in (quality.scored(odd, model, carry=True), simhash.one_of_each(odd), decontaminate.clean(odd, spark.read.parquet(f"{SF}/benchmark.parquet")),
                mixing.mixed(odd, mixing.domain_labels(labels))):
        assert out.columns == odd.columns and out.schema.simpleString() == odd.schema.simpleString()
        rows = out.collect()
        assert rows and all(tuple(r)[-len(NAMES):] == tuple(range(len(NAMES))) for r in rows)
    assert mixing.mixing_rates(odd, mixing.domain_labels(labels)).count() == odd.count()


def test_quality_where_all_rows_are_labelled_or_none_is(spark, docs):
    truth = spark.read.parquet(f"{SF}/labels.parquet").filter("quality is not null").select("doc_id", "quality")
    known = docs.join(truth.dropDuplicates(["doc_id"]), "doc_id", "left_semi")
    model = quality.train(known, truth)
    got = {r["doc_id"]: r["predicted"] for r in quality.scored(known, model).collect()}
    assert model.learned and any(got.values())
    nothing = quality.train(docs, truth.limit(0))
    assert not nothing.learned and quality.scored(docs, nothing, carry=True).count() == docs.count()


def test_article_text_inside_math_and_fallbacks_is_kept():
    """Formulas and fallback texts are text of their block; forms, scripts and styles stay out, closed or not."""
    import time
    model = pages.fit(list(pages.written_pages()))
    page = ("<html><body><nav><a href=/>no home</a></nav><article><p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> as known, "
            "said in a sentence of some length.<p>See <object data=x>the chart of it</object> and <svg><text>Figure 1</text><style>no</style></svg> and "
            "<video src=y>a film</video> for more of the same, at length.<p>Kept <button>no press</button>to the end<select><option>no</select>.</article></body></html>")
    assert pages.main_text(page, model) == (
        "Energy is E=m as known, said in a sentence of some length.\nSee the chart of it and Figure 1 and a film for more of the same, at length.\n"
        "Kept to the end .")
    start = time.time()
    assert pages.parse("<p>text " + "<template>" * 40_000)[1].items[0] == "text "
    assert time.time() - start < 2
