"""Evidence-shaped views over the given tables, written once and rendered in two SQL dialects.

Every view reads whole tables: its rows grow with them. ``$``-tokens stand for the few spellings that
differ between Spark SQL and DuckDB.
"""
from __future__ import annotations

import re
from functools import cache
from string import Template

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

_TEXT_TABLES = ("documents", "pages", "conversations", "orders")

_SPARK = {"ARR": "array", "AT": "element_at", "STR": "string", "EMPTY": "cast(array() as array<string>)",
          "POW": "pow", "EXPL": "explode", "SEQ": "sequence", "WORDS": "split"}
_DUCK = {"ARR": "list_value", "AT": "list_extract", "STR": "varchar", "EMPTY": "cast([] as varchar[])",
         "POW": "pow", "EXPL": "unnest", "SEQ": "generate_series", "WORDS": "string_split"}

_TYPES = ("$ARR('web','youtube','podcast','structured_source','primary_source','abstract','llm',"
          "'secondary_review')")
_GIVEN = "$ARR('Mara','Ilya','Tomas','Greta','Oskar','Lena','Pavel','Nadia','Henrik','Sofia','Anton','Vera')"
_MIDDLE = "$ARR('Elin','Jonas','Ruth')"
_SURNAME = "$ARR('Voss','Lindqvist','Marchetti','Okafor','Brandt','Castell','Dravic','Haldane','Ivers','Quill')"


def _name(k: str) -> str:
    """A person name from an integer expression; a third of the names carry a middle name."""
    return (f"($AT({_GIVEN}, cast(({k}) % 12 + 1 as int)) || "
            f"CASE WHEN ({k}) % 3 = 0 THEN ' ' || $AT({_MIDDLE}, cast(floor(({k}) / 3) % 3 + 1 as int)) ELSE '' END || "
            f"' ' || $AT({_SURNAME}, cast(floor(({k}) / 12) % 10 + 1 as int)))")


VIEWS: dict[str, str | tuple[str, str]] = {
    "v_assertions": """
        SELECT l.l_orderkey AS claim_id, l.l_suppkey AS source_id,
               $AT($ARR('llm','web','youtube','podcast','structured_source'), cast(n.n_regionkey + 1 as int)) AS source_type,
               CASE WHEN l.l_returnflag = 'R' AND l.l_linenumber = 1 AND l.l_discount >= 0.08
                    THEN 'contradict' ELSE 'agree' END AS stance
        FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
             JOIN nation n ON s.s_nationkey = n.n_nationkey""",
    "v_dated_assertions": """
        SELECT l.l_orderkey AS claim_id, l.l_suppkey AS source_id,
               $AT($ARR('llm','web','youtube','podcast','structured_source'), cast(n.n_regionkey + 1 as int)) AS source_type,
               CASE WHEN l.l_returnflag = 'R' AND l.l_linenumber = 1 AND l.l_discount >= 0.08
                    THEN 'contradict' ELSE 'agree' END AS stance, l.l_shipdate AS ts
        FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
             JOIN nation n ON s.s_nationkey = n.n_nationkey""",
    "v_findings": f"""
        SELECT 'find_' || cast(doc_id as $STR) AS finding_id, doc_id, lang AS branch_id, text AS claim, n_chars,
               CASE WHEN n_chars % 11 = 0 THEN NULL
                    WHEN n_chars % 3 = 0 THEN $ARR($AT({_TYPES}, cast(cast(substr(source, 4) as int) % 8 + 1 as int)),
                                                   $AT({_TYPES}, cast(n_chars % 8 + 1 as int)))
                    ELSE $ARR($AT({_TYPES}, cast(cast(substr(source, 4) as int) % 8 + 1 as int))) END AS source_types,
               CASE WHEN n_chars % 7 = 0 THEN $EMPTY
                    ELSE $ARR('https://www.' || source || '.example.com/' || cast(doc_id as $STR)) END AS urls,
               cast(1 + n_chars % 5 as int) AS corroboration_count,
               CASE WHEN n_chars % 13 = 0 THEN 'Controversial' WHEN n_chars % 29 = 0 THEN NULL
                    WHEN n_chars % 5 >= 2 THEN 'Accepted' WHEN n_chars % 5 = 1 THEN 'Moderately Accepted'
                    ELSE 'Speculative' END AS confidence_tier,
               CASE WHEN n_chars % 17 = 0 THEN 'gap' WHEN n_chars % 19 = 0 THEN NULL ELSE 'finding' END AS node_kind,
               CASE WHEN n_chars % 23 = 0 THEN NULL WHEN n_chars % 31 = 0 THEN 'undated'
                    ELSE cast(2017 + n_chars % 8 as $STR) || '-' || lpad(cast(1 + doc_id % 12 as $STR), 2, '0') || '-'
                         || lpad(cast(1 + n_chars % 28 as $STR), 2, '0') || 'T06:00:00Z' END AS created_at
        FROM documents""",
    "v_truth": """
        SELECT finding_id, CASE WHEN n_chars % 10 = 0 THEN NULL WHEN n_chars % 9 = 0 THEN 'Controversial' ELSE confidence_tier END AS confidence_tier
        FROM v_findings""",
    "v_twins": (
        """SELECT a.vec_id + 1000000000 AS vec_id, a.label AS branch_id, zip_with(cast(a.embedding as array<double>), cast(b.embedding as array<double>), (x, y) -> 0.97D * x + 0.24D * y) AS embedding
           FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
           UNION ALL
           SELECT a.vec_id + 2000000000, a.label, zip_with(cast(a.embedding as array<double>), cast(b.embedding as array<double>), (x, y) -> 0.75D * x + 0.66D * y)
           FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
        """SELECT a.vec_id + 1000000000 AS vec_id, a.label AS branch_id, [0.97::double * z[1] + 0.24::double * z[2] for z in list_zip(cast(a.embedding as double[]), cast(b.embedding as double[]))] AS embedding
           FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
           UNION ALL
           SELECT a.vec_id + 2000000000, a.label, [0.75::double * z[1] + 0.66::double * z[2] for z in list_zip(cast(a.embedding as double[]), cast(b.embedding as double[]))]
           FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""),
    "v_probes": (
        "SELECT vec_id, label AS branch_id, cast(embedding as array<double>) AS embedding FROM embeddings",
        "SELECT vec_id, label AS branch_id, cast(embedding as double[]) AS embedding FROM embeddings"),
    "v_vectors": """
        SELECT vec_id, branch_id, embedding FROM v_probes UNION ALL SELECT vec_id, branch_id, embedding FROM v_twins""",
    "v_index": """
        SELECT vec_id, branch_id, embedding,
               CASE WHEN vec_id % 13 = 0 THEN 'Controversial' WHEN vec_id % 3 = 0 THEN 'Accepted'
                    WHEN vec_id % 3 = 1 THEN 'Moderately Accepted' ELSE 'Speculative' END AS confidence_tier,
               CASE WHEN vec_id % 7 = 0 THEN 'gap' ELSE 'finding' END AS node_kind,
               cast(1 + vec_id % 4 as int) AS corroboration_count,
               CASE WHEN vec_id % 2 = 0 THEN $ARR('web') ELSE $ARR('web', 'podcast') END AS source_types,
               CASE WHEN vec_id % 11 = 0 THEN $EMPTY ELSE $ARR('https://e' || cast(vec_id % 40 as $STR) || '.example.org/' || cast(vec_id as $STR)) END AS urls,
               cast(2018 + vec_id % 7 as $STR) || '-03-01T00:00:00Z' AS created_at
        FROM v_twins""",
    "v_relations": """
        SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN NULL ELSE
               $AT($ARR('same','collaborative','distinct','contradicts','unsure'), cast(vec_id % 5 + 1 as int)) END AS relation
        FROM embeddings""",
    "v_judge": """
        SELECT vec_id AS probe_id, CASE WHEN vec_id % 8 = 0 THEN NULL WHEN vec_id % 3 = 0 THEN 'no' ELSE 'yes' END AS answer
        FROM embeddings""",
    "v_questions": """
        SELECT conv_id * 1000 + turn AS question_id, cast(conv_id % 4 as $STR) AS branch_id, text,
               CASE WHEN turn % 3 = 0 THEN 'web' WHEN turn % 3 = 1 THEN 'podcast' ELSE 'youtube' END AS lane
        FROM conversations WHERE role = 'user'
        UNION ALL
        SELECT 500000000 + item_id, cast(item_id % 4 as $STR),
               $AT($ARR('Who found ' || substr(text, 1, 12) || '?', 'Is there any record of ' || substr(text, 1, 10),
                        'What happened?  And what else? ' || substr(text, 1, 5), '  ',
                        'Verify the identity, current status of this person from primary/authoritative sources: ' || substr(text, 1, 16),
                        'Who last spoke to  Mara Voss and what was said ?. '), cast(item_id % 6 + 1 as int)), 'web'
        FROM benchmark""",
    "v_asked": """
        SELECT branch_id, replace(text, ' ', '  ') || ' ?' AS text FROM v_questions WHERE lane <> 'podcast'""",
    "v_case_claims": f"""
        SELECT finding_id, doc_id, branch_id, source_types, corroboration_count, confidence_tier, n_chars,
               CASE cast(n_chars % 12 as int)
                 WHEN 0 THEN {_name('doc_id * 7')} || ' was found dead near the river in ' || cast(1990 + n_chars % 36 as $STR) || ', officials said.'
                 WHEN 1 THEN 'Officials said ' || {_name('doc_id * 5 + 1')} || ' vanished in ' || cast(2012 + n_chars % 6 as $STR) || ' while working at the Alder National Laboratory.'
                 WHEN 2 THEN {_name('doc_id + 2')} || ', a wine tourism consultant, spoke at the county fair.'
                 WHEN 3 THEN 'The Voss County office closed the road.'
                 WHEN 4 THEN 'The wife of ' || {_name('doc_id * 3')} || ' asked for privacy.'
                 WHEN 5 THEN {_name('doc_id * 11 + 5')} || ' was born in ' || cast(1940 + n_chars % 40 as $STR) || ' and studied at Tarn University.'
                 WHEN 6 THEN {_name('doc_id + n_chars')} || ' and ' || {_name('doc_id * 2 + 1')} || ' both worked for the Alder National Laboratory.'
                 WHEN 7 THEN 'A report from ' || cast(2000 + n_chars % 20 as $STR) || ' names nobody at all.'
                 WHEN 8 THEN {_name('n_chars')} || ', a plasma physicist, joined the Tarn Institute near Sandia.'
                 WHEN 9 THEN 'Police spoke with ' || {_name('n_chars * 3 + 2')} || ' about the case of ' || {_name('doc_id * 9 + 4')} || ' in Brandt Street.'
                 WHEN 10 THEN 'The response is omitted here because the search results name nobody.'
                 ELSE 'Detective Haldane said the file of ' || {_name('doc_id * 13')} || ' stays open.' END AS claim
        FROM v_findings""",
    "v_roster": f"""
        SELECT DISTINCT {_name('s_suppkey * 5')} AS name FROM supplier""",
    "v_cards": f"""
        SELECT name, max(role) AS role, max(employer) AS employer, max(place) AS place, max(born) AS born, max(died) AS died FROM (
        SELECT {_name('s_suppkey * 5')} AS name,
               $AT($ARR('plasma physicist','', 'engineer at  Tarn Institute','botanist'), cast(s_suppkey % 4 + 1 as int)) AS role,
               $AT($ARR('Alder National Laboratory','Tarn Institute',''), cast(s_suppkey % 3 + 1 as int)) AS employer,
               n_name AS place,
               CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE cast(1940 + s_suppkey % 30 as int) END AS born,
               CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE cast(2012 + s_suppkey % 9 as int) END AS died
        FROM supplier JOIN nation ON s_nationkey = n_nationkey) c GROUP BY name""",
    "v_links": f"""
        SELECT {_name('l_suppkey * 5')} AS entity_a, {_name('l_partkey * 5')} AS entity_b, count(*) AS n
        FROM lineitem GROUP BY 1, 2""",
    "v_works": """
        SELECT doc_id AS work_id, d.text AS title, (7 * doc_id + 1) % (SELECT count(*) FROM documents) AS ref_a,
               (11 * doc_id + 3) % (SELECT count(*) FROM documents) AS ref_b,
               n_chars % 40 AS cited_count, cast(2010 + n_chars % 15 as int) AS pub_year, lang AS branch_id,
               CASE WHEN n_chars % 4 = 0 THEN NULL ELSE 'https://doi.org/10.5555/' || cast(doc_id as $STR) END AS doi,
               CASE WHEN n_chars % 3 = 0 THEN NULL ELSE 'https://pages.example.org/' || cast(doc_id as $STR) END AS landing_page_url,
               CASE WHEN doc_id % 3 = 0 THEN 'https://oa.example.org/' || cast(doc_id as $STR) ELSE NULL END AS oa_url,
               CASE WHEN doc_id % 5 = 0 THEN NULL ELSE d.text END AS abstract
        FROM documents d""",
    "v_transcripts": """
        SELECT 'https://video.example.com/watch?v=' || lpad(cast(doc_id as $STR), 11, 'x') AS url, doc_id, text,
               CASE WHEN doc_id % 7 = 0 THEN NULL ELSE n_chars / 16.0 * (1 + doc_id % 4) END AS duration_s
        FROM documents""",
    "v_verdicts": """
        SELECT f.finding_id, f.branch_id AS file,
               CASE WHEN l.quality = 0 THEN ' Reject' WHEN l.toxic = 1 THEN 'context' WHEN l.doc_id IS NULL THEN NULL
                    WHEN f.n_chars % 6 = 0 THEN 'maybe' ELSE 'keep' END AS verdict
        FROM v_findings f LEFT JOIN labels l ON l.doc_id = f.doc_id""",
    "v_cycle_log": """
        SELECT user_id AS run_id, event_type AS cycle,
               cast(sum(CASE WHEN value < 5 THEN 1 ELSE 0 END) as bigint) AS novel,
               cast(sum(CASE WHEN value >= 5 AND value < 12 THEN 1 ELSE 0 END) as bigint) AS incremental,
               cast(sum(CASE WHEN value >= 12 AND value < 60 THEN 1 ELSE 0 END) as bigint) AS redundant,
               max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS kb_reuse
        FROM events GROUP BY user_id, event_type""",
    "v_cred_events": """
        SELECT 'src' || cast(user_id as $STR) || '.example.com' AS domain, ts, event_id,
               CASE WHEN event_type = 'purchase' THEN 1 WHEN event_type = 'error' THEN -1 WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS delta,
               event_type AS reason
        FROM events""",
    "v_requests": """
        SELECT $AT($ARR('exa','jina','firecrawl','wayback','openrouter','groq','perplexity','openalex'), cast(user_id % 8 + 1 as int)) AS provider,
               event_id, ts, value AS duration_s
        FROM events""",
    "v_coverage": """
        SELECT c_custkey AS lead_id, 'What happened to ' || c_name || '?' AS lead, cast(c_custkey % 3 + 1 as int) AS round_n,
               count(o_orderkey) AS findings, CASE WHEN count(o_orderkey) > 0 THEN 1 ELSE 0 END AS covered
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name""",
    "v_hypotheses": """
        SELECT p_partkey AS hyp_id, 'Still live: ' || p_name AS hypothesis, CASE WHEN p_size % 4 = 0 THEN ' Survives' WHEN p_size % 4 = 1 THEN 'refuted'
               WHEN p_size % 4 = 2 THEN 'weakened' ELSE 'odd' END AS verdict,
               CASE WHEN p_size % 3 = 0 THEN $EMPTY ELSE $ARR('size ' || cast(p_size as $STR), p_brand) END AS disconfirming
        FROM part""",
    "v_ledger": """
        SELECT o_orderkey AS claim_id, 'claim ' || cast(o_orderkey % 500 as $STR) AS claim,
               $AT($ARR('verified','debunked','contested','unproven','hearsay','likely','bogus'), cast(o_orderkey % 7 + 1 as int)) AS verdict,
               $AT($ARR('toward','away','balanced','sideways'), cast(o_orderkey % 4 + 1 as int)) AS lean,
               $AT($ARR('slight','moderate','strong',''), cast(o_orderkey % 4 + 1 as int)) AS magnitude
        FROM orders""",
    "v_profiles": f"""
        SELECT o_orderkey AS report_id, k AS slot, {_name('o_orderkey * 3 + k * 17')} AS name,
               $AT($ARR('deceased','missing','found safe','unknown'), cast((o_orderkey + k) % 4 + 1 as int)) AS status,
               CASE WHEN (o_orderkey + k) % 4 = 0 THEN 'gunshot wound, homicide' WHEN (o_orderkey + k) % 4 = 3 THEN NULL
                    WHEN k = 2 THEN 'drowning in lake' ELSE '' END AS cause
        FROM (SELECT o_orderkey, $EXPL($SEQ(1, 3)) AS k FROM orders) o""",
    "v_reports": f"""
        SELECT o_orderkey AS report_id,
               CASE WHEN o_orderpriority LIKE '1%' THEN 'A grim silence hangs over the case. ' ELSE '' END
               || 'One person is deceased and two are missing. '
               || CASE WHEN o_orderkey % 5 = 0 THEN 'At least 10 missing people were counted nationwide. ' ELSE '' END
               || {_name('o_orderkey * 3 + 17')} || ' is ' || $AT($ARR('deceased','missing','found safe','unknown'), cast((o_orderkey + 1) % 4 + 1 as int))
               || CASE WHEN o_orderkey % 3 = 0 THEN ' after a gunshot wound. ' ELSE '. ' END
               || {_name('o_orderkey * 3 + 34')} || CASE WHEN o_orderkey % 7 = 0 THEN ' was found dead by a hiker' ELSE ' is ' || $AT($ARR('deceased','missing','found safe','unknown'), cast((o_orderkey + 2) % 4 + 1 as int)) END
               || ' in ' || cast(2000 + o_orderkey % 24 as $STR) || ' from drowning. '
               || CASE WHEN o_orderkey % 4 = 0 THEN 'Could the nation face an unseen threat? '
                       ELSE {_name('o_orderkey * 3 + 51')} || ' was reported missing in March. ' END
               || CASE WHEN o_orderkey % 6 = 0 THEN 'The link is unproven.' ELSE '' END AS text
        FROM orders""",
    "v_scores": """
        SELECT 'model-' || cast(l_linenumber as $STR) AS model, l_partkey AS fixture,
               CASE WHEN l_linestatus = 'O' THEN 'on' ELSE 'off' END AS protocol,
               cast(l_quantity as bigint) % 8 AS softening, cast(floor(l_quantity / 8) as bigint) AS stripping
        FROM lineitem""",
    "v_disputes": """
        SELECT o_orderkey AS dispute_id, $ARR('find_' || cast(o_orderkey % 300 as $STR), 'find_' || cast(o_custkey as $STR), 'find_0' ) AS finding_ids,
               CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'yes it did' END AS side_a,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'no it did not' END AS side_b
        FROM orders""",
    "v_responses": """
        SELECT conv_id, turn, role AS source_label, CASE WHEN (conv_id + turn) % 5 = 0 THEN 'timeout' ELSE NULL END AS error,
               CASE WHEN (conv_id + turn) % 7 = 0 THEN '  ' ELSE text END AS raw_text
        FROM conversations""",
    "v_entity_ctx": f"""
        SELECT c_custkey AS entity_id, {_name('c_custkey')} AS name,
               CASE WHEN c_custkey % 3 = 0 THEN '' ELSE lower(c_mktsegment) || ' customer of the northern regional office number ' || cast(c_custkey as $STR) END AS context,
               n_name AS place, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE cast(2000 + c_custkey % 20 as $STR) END AS when_
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "v_pages_md": """
        SELECT page_id, url, html || ' [source](' || url || ') and [paper](https://doi.org/10.1000/' || cast(page_id as $STR)
               || ') shared at https://twitter.com/p/' || cast(page_id as $STR) || ' also ' || url || '; see (https://data.example.gov/x) .' AS text
        FROM pages""",
    "v_feeds": """
        SELECT doc_id AS feed_id, source AS show, text AS title, lang AS author FROM documents""",
    "v_topics": "SELECT item_id AS topic_id, text AS topic FROM benchmark",
    "v_incoming": """
        SELECT doc_id AS claim_id, CASE WHEN n_chars % 9 = 0 THEN 'This response is new. ' || text ELSE text END AS claim
        FROM documents WHERE source IN ('src0','src1','src2','src3','src4','src5','src6','src7','src8','src9')""",
    "v_existing": """
        SELECT doc_id AS claim_id, text AS claim FROM documents
        WHERE source NOT IN ('src0','src1','src2','src3','src4','src5','src6','src7','src8','src9')""",
}


@cache
def _closure(name: str) -> tuple[str, ...]:
    """The view and the views it reads, dependencies first."""
    out: list[str] = []
    for dep in _mentioned(_text(name, "duck")):
        for d in _closure(dep):
            if d not in out:
                out.append(d)
    return (*out, name)


def _text(name: str, dialect: str) -> str:
    body = VIEWS[name]
    if isinstance(body, tuple):
        return body[0 if dialect == "spark" else 1]
    return Template(body).substitute(_SPARK if dialect == "spark" else _DUCK)


def _mentioned(sql: str) -> list[str]:
    return [v for v in dict.fromkeys(re.findall(r"\bv_[a-z_]+\b", sql)) if v in VIEWS]


def with_views(body: str) -> str:
    """Prepend the CTEs a DuckDB query mentions."""
    names: list[str] = []
    for v in _mentioned(body):
        for d in _closure(v):
            if d not in names:
                names.append(d)
    body = body.strip()
    ctes = [f"{v} AS ({_text(v, 'duck')})" for v in names]
    if body.upper().startswith("WITH RECURSIVE "):
        head, rest = ", ".join(ctes), body[len("WITH RECURSIVE "):]
        return f"WITH RECURSIVE {head + ', ' if head else ''}{rest}"
    if body.upper().startswith("WITH "):
        head, rest = ", ".join(ctes), body[len("WITH "):]
        return f"WITH {head + ', ' if head else ''}{rest}"
    return (f"WITH {', '.join(ctes)} " if ctes else "") + body


class Tables:
    """``t.documents`` reads a table, ``t.v_findings`` builds a view; both are lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        made = self._made
        if name not in made:
            if name in TABLES:
                made[name] = self._spread(self.spark.read.parquet(f"{self.dir}/{name}.parquet"), name)
            elif name in VIEWS:
                made[name] = self._view(name)
            else:
                raise AttributeError(name)
        return made[name]

    def _spread(self, df: DataFrame, name: str) -> DataFrame:
        """A text table that arrives as fewer splits than there are cores is dealt out once."""
        cores = self.spark.sparkContext.defaultParallelism
        if name in _TEXT_TABLES and df.rdd.getNumPartitions() < cores:
            return df.repartition(cores)
        return df

    def _view(self, name: str) -> DataFrame:
        return self.sql(_text(name, "spark"))

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over tables and views by name, without touching the session catalog."""
        inputs = {}

        def hold(m):
            word = m.group(0)
            inputs[word] = getattr(self, word)
            return "{" + word + "}"
        names = "|".join([*TABLES, *VIEWS])
        bound = re.sub(rf"(?<=FROM )({names})\b|(?<=JOIN )({names})\b", hold, text)
        bound = re.sub(r"(\{(?:%s)\})(?=\s*(?:$|\n|\)|WHERE|GROUP|UNION|JOIN|LEFT|CROSS|,))" % names,
                       lambda m: f"{m.group(1)} AS {m.group(1)[1:-1]}", bound)
        return self.spark.sql(bound, **inputs)
