"""BM25, rank fusion and hybrid retrieval as equi-joins on terms."""
from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from corrobora.functions.text import tok, words4
from corrobora.operators.similarity import knn
from corrobora.session import cut, one_row, ship, small_side

K1, B, RRF_K = 1.5, 0.75, 60
BLOCK_POSTINGS = 250_000        # postings of a block of documents, about
GROUP_TERMS = 200_000           # query terms that meet a block at once, about
SLACK = 2e-6                    # more than rounding can move a score
SET_SIZES = (8, 64)             # word sets are compared in classes up to these sizes, then all larger ones
BLOCK_WORDS = 12_000_000        # words of a block of word sets, about (96 MB)


def bm25_index(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (doc_id, term, tf, dl) with idf and the average length attached. Texts are dealt by document, so words are
    counted where their document is and only postings travel to their term."""
    terms = docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("text")).repartition("doc_id").select(
        "doc_id", tok(F.col("text")).alias("toks"))
    stats = terms.agg(F.count("*").alias("n_docs"), F.avg(F.size("toks")).alias("avgdl"))
    postings = (terms.select("doc_id", F.size("toks").alias("dl"), F.explode("toks").alias("term"))
                .groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl")))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.withColumn("s", one_row(stats)).select("term", "s.avgdl", F.log(
        1 + (F.col("s.n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    return postings.join(idf, "term")


def bm25_search(queries: DataFrame, docs: DataFrame, k: int, query_id: str = "query_id", text: str = "text",
                doc_id: str = "doc_id", doc_text: str = "text", skip_own_text: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank) for all queries at once; a repeated query term adds repeatedly. With
    ``skip_own_text`` documents of the query's own text (case and outer blanks aside) never count.

    Texts are read once, and only terms some query uses leave the tokeniser. Postings are dealt into blocks of documents, queries into groups
    that fit a task; a block meets a group in one task, which walks each query's terms by falling upper bound and stops
    admitting documents once what is left can't reach the k-th best (``best_of_block``). The k best of each block leave
    it, so what is shuffled behind it doesn't grow with the documents that share a common word. Exact; scores are rounded
    before ranking so equal documents tie whatever the sum order.
    """
    spark = docs.sparkSession
    ship(spark)
    said = lambda c: own_text(F.col(c)) if skip_own_text else F.lit(0).cast("long")
    qt = cut(queries.select(F.col(query_id).alias("query_id"), said(text).alias("own"), F.explode(tok(F.col(text))).alias("term"))
             .groupBy("query_id", "own", "term").agg(F.count("*").alias("qtf")))
    toks = docs.select(F.col(doc_id).alias("doc_id"), said(doc_text).alias("said"), tok(F.col(doc_text)).alias("toks"))
    wanted = small_side(qt.select("term").union(spark.range(1).select(F.lit(""))).distinct())
    tf, dl = F.col("tf"), F.col("dl")
    found = cut(toks.select("doc_id", "said", F.size("toks").alias("dl"), F.explode(F.array_append("toks", F.lit(""))).alias("term"))
                .join(wanted, "term", "left_semi").groupBy("doc_id", "term")
                .agg(F.count("*").alias("tf"), F.first("dl").alias("dl"), F.first("said").alias("said"), F.sum("dl").alias("words")))
    each = F.col("term") == ""                              # one more term in every document: what the table's size is read from
    stats = found.filter(each).agg(F.sum("tf").alias("n_docs"), (F.sum("words") / F.sum("tf")).alias("avgdl"))
    postings = found.filter(~each).withColumn("s", one_row(stats)).select(
        "doc_id", "said", "term", (tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("s.avgdl")))).alias("part"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.withColumn("s", one_row(stats)).select("term", "s.avgdl", F.log(
        1 + (F.col("s.n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    return postings.join(idf, "term")


def bm25_search(queries: DataFrame, docs: DataFrame, k: int, query_id: str = "query_id", text: str = "text",
                doc_id: str = "doc_id", doc_text: str = "text", skip_own_text: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank) for all queries at once; a repeated query term adds repeatedly. With
    ``skip_own_text`` documents of the query's own text (case and outer blanks aside) never count.

    Texts are read once, and only terms some query uses leave the tokeniser. Postings are dealt into blocks of documents, queries into groups
    that fit a task; a block meets a group in one task, which walks each query's terms by falling upper bound and stops
    admitting documents once what is left can't reach the k-th best (``best_of_block``). The k best of each block leave
    it, so what is shuffled behind it doesn't grow with the documents that share a common word. Exact; scores are rounded
    before ranking so equal documents tie whatever the sum order.
    """
    spark = docs.sparkSession
    ship(spark)
    said = lambda c: own_text(F.col(c)) if skip_own_text else F.lit(0).cast("long")
    qt = cut(queries.select(F.col(query_id).alias("query_id"), said(text).alias("own"), F.explode(tok(F.col(text))).alias("term"))
             .groupBy("query_id", "own", "term").agg(F.count("*").alias("qtf")))
    toks = docs.select(F.col(doc_id).alias("doc_id"), said(doc_text).alias("said"), tok(F.col(doc_text)).alias("toks"))
    stats = cut(toks.agg(F.count("*").alias("n_docs"), F.avg(F.size("toks")).alias("avgdl")))
    tf, dl = F.col("tf"), F.col("dl")
    found = (toks.select("doc_id", "said", F.size("toks").alias("dl"), F.explode("toks").alias("term"))
             .join(small_side(qt.select("term").distinct()), "term", "left_semi")
             .groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"), F.first("said").alias("said")))
    postings = cut(found.withColumn("s", one_row(stats)).select(
        "doc_id", "said", "term", (tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("s.avgdl")))).alias("part")))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    weight = cut(qt.join(df, "term").withColumn("s", one_row(stats)).select(
        "query_id", "own", "term", (F.col("qtf") * F.log(1 + (F.col("s.n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("w")))

    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    blocks, groups = postings.count() // BLOCK_POSTINGS + 1, weight.count() // GROUP_TERMS + 1
    weight = weight.withColumn("qgroup", dealt("query_id", groups))
    homes = postings.withColumn("block", dealt("doc_id", blocks))
    homes = (homes.withColumn("qgroup", F.lit(0)) if groups == 1 else
             homes.join(small_side(weight.select("term", "qgroup").distinct()), "term"))
    asks = weight.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    types = {f.name: f.dataType.simpleString() for f in [*qt.schema, *postings.schema]}
    schema = f"query_id {types['query_id']}, doc_id {types['doc_id']}, score double"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return best_of_block(left, right, k, skip_own_text)
    best = homes.groupBy("block", "qgroup").cogroup(asks.groupBy("block", "qgroup")).applyInArrow(run, schema)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).withColumnRenamed("query_id", query_id)


def _coded(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """(place of each value among the different ones in ascending order, these); null first."""
    found = column.combine_chunks().dictionary_encode(null_encoding="encode")
    order = pc.sort_indices(found.dictionary, null_placement="at_start")
    place = np.empty(len(order), np.int64)
    place[np.asarray(order)] = np.arange(len(order))
    return place[np.asarray(found.indices)], found.dictionary.take(order)


def best_of_block(postings: pa.Table, asks: pa.Table, k: int, skip_own: bool, tally: list | None = None) -> pa.Table:
    """The k best documents of a block for each query: (query_id, doc_id, score).

    A term adds at most its weight times its largest part in the block. Terms are walked by falling bound; once the
    bounds of those left sum to less than the k-th best so far, no document that has none of the terms walked can
    enter, and of the others only those that can still reach it are followed. ``tally`` gets, for each query, how
    many postings were added to a score and how many its terms have.
    """
    empty = pa.table({"query_id": asks["query_id"].slice(0, 0), "doc_id": postings["doc_id"].slice(0, 0),
                      "score": pa.array([], pa.float64())})
    if not len(postings) or not len(asks):
        return empty
    doc, ids = _coded(postings["doc_id"])
    term, terms = _coded(postings["term"])
    by = np.lexsort((doc, term))
    doc, part = doc[by], np.asarray(postings["part"])[by]
    starts = np.searchsorted(term[by], np.arange(len(terms) + 1))
    top = np.maximum.reduceat(part, starts[:-1])
    said = np.zeros(len(ids), np.int64)
    said[doc] = np.asarray(postings["said"])[by]

    asked = pc.index_in(asks["term"].combine_chunks(), value_set=terms)
    query, names = _coded(asks["query_id"])
    own, weight = np.asarray(asks["own"]), np.asarray(asks["w"])
    here = np.flatnonzero(np.asarray(asked.is_valid()))
    at = np.asarray(asked.fill_null(0), np.int64)
    here = here[np.lexsort((-weight[here] * top[at[here]], query[here]))]
    cuts = np.flatnonzero(np.r_[True, query[here][1:] != query[here][:-1], True]) if len(here) else [0]
    score, out = np.zeros(len(ids)), []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        rows = here[lo:hi]
        barred = said == own[rows[0]] if skip_own else None
        bound = weight[rows] * top[at[rows]]
        left = np.cumsum(bound[::-1])[::-1] - bound             # what all later terms can add
        score[:] = 0.0
        live, added = None, 0
        for row, rest in zip(rows, left):
            span = slice(starts[at[row]], starts[at[row] + 1])
            docs, parts = doc[span], part[span]
            if live is None:
                score[docs] += weight[row] * parts
                added += len(docs)
                if barred is not None:
                    score[barred] = 0.0
                if len(score) <= k:
                    continue
                kth = np.partition(score, -k)[-k]
                if kth > rest + SLACK:
                    live = np.flatnonzero(score + rest + SLACK >= kth)
            else:
                found = np.minimum(np.searchsorted(docs, live), len(docs) - 1)
                same = docs[found] == live
                score[live[same]] += weight[row] * parts[found[same]]
                added += int(same.sum())
                kth = np.partition(score[live], -k)[-k]
                live = live[score[live] + rest + SLACK >= kth]
        ended = np.flatnonzero(score) if live is None else live
        if tally is not None:
            tally.append((added, int((starts[at[rows] + 1] - starts[at[rows]]).sum())))
        value = np.round(score[ended], 6)
        kept = np.lexsort((ended, -value))[:k]
        kept = kept[value[kept] > 0]
        out.append((np.full(len(kept), query[rows[0]]), ended[kept], value[kept]))
    if not out:
        return empty
    q, d, v = (np.concatenate(c) for c in zip(*out))
    return pa.table({"query_id": names.take(pa.array(q)), "doc_id": ids.take(pa.array(d)), "score": pa.array(v)})


def own_text(c):
    """What a text says, as one number: case and outer blanks aside."""
    return F.xxhash64(F.lower(F.trim(F.coalesce(c, F.lit("")))))


def rrf(ranked: list[DataFrame], weights: list[float], top: int, query_id: str = "query_id",
        ident: str = "doc_id") -> DataFrame:
    """Weighted reciprocal-rank fusion of ranked lists (rank counted from 1 in the inputs)."""
    parts = [r.select(query_id, ident, (F.lit(float(w)) / (RRF_K + F.col("rank") - 1)).alias("s"))
             for r, w in zip(ranked, weights)]
    all_parts = parts[0]
    for p in parts[1:]:
        all_parts = all_parts.unionByName(p)
    fused = all_parts.groupBy(query_id, ident).agg(F.round(F.sum("s"), 8).alias("fused"))
    rank = F.row_number().over(W.partitionBy(query_id).orderBy(F.desc("fused"), ident))
    return fused.withColumn("rank", rank).filter(F.col("rank") <= top)


def hybrid(queries: DataFrame, docs: DataFrame, vectors: DataFrame, k: int, skip_own_text: bool = False) -> DataFrame:
    """Vector and BM25 lists of 4k fused 1:2; a hit only the words found reports similarity 0.0. With ``skip_own_text``
    documents that say what the query says are in neither list."""
    skip = None
    if skip_own_text:
        vectors = vectors.join(docs.select(F.col("doc_id").alias("vec_id"), F.col("text").alias("_said")), "vec_id", "left")
        skip = (own_text(F.col("text")), own_text(F.col("_said")))
    dense = knn(queries.withColumnRenamed("query_id", "probe_id"), vectors, 4 * k, scope=None, skip=skip)
    dense = cut(dense.select(F.col("probe_id").alias("query_id"), F.col("vec_id").alias("doc_id"), "score", "rank"))
    words = bm25_search(queries, docs, 4 * k, skip_own_text=skip_own_text)
    fused = rrf([dense, words], [1.0, 2.0], k)
    return (fused.join(dense.select("query_id", "doc_id", "score"), ["query_id", "doc_id"], "left")
            .withColumn("score", F.coalesce("score", F.lit(0.0))))


def _word_sets(df: DataFrame) -> DataFrame:
    """(claim_id, set_id, hs): a claim's distinct words as 64-bit hashes; claims of one word set share its id."""
    sets = df.select("claim_id", F.sort_array(words4(F.col("claim"))).alias("ws"))
    return sets.select("claim_id", F.unhex(F.substring(F.sha2(F.array_join("ws", " "), 256), 1, 32)).alias("set_id"),
                       F.transform("ws", lambda w: F.xxhash64(w)).alias("hs"))


def known_claims(new: DataFrame, existing: DataFrame, overlap: float = 0.6) -> DataFrame:
    """(claim_id, known): does an existing claim share enough of the smaller word set? Exact.

    Existing sets are asked by rising size: a small one is contained in many claims, and a claim that is known asks no
    more. Within a class of sizes a block of existing sets meets a block of new ones in one task, which counts the words
    they share and lets nothing out but the new sets that are known (``known_of_block``); no pair is ever a row.
    """
    ship(new.sparkSession)
    n = cut(_word_sets(new))
    one = lambda d: d.groupBy("set_id").agg(F.first("hs").alias("hs")).filter(F.size("hs") > 0)
    left, es, found, low = cut(one(n)), cut(one(_word_sets(existing))), [], 1
    for high in (*SET_SIZES, 2**31 - 1):
        met = cut(_known_sets(left, es.filter(F.size("hs").between(low, high)), overlap))
        left, low = left.join(met, "set_id", "left_anti"), high + 1
        found.append(met)
    hit = reduce(DataFrame.union, found).withColumn("known", F.lit(True))
    return n.select("claim_id", "set_id", F.size("hs").alias("n_words")).join(hit, "set_id", "left").select(
        "claim_id", "n_words", F.coalesce("known", F.lit(False)).alias("known"))


def _known_sets(new: DataFrame, existing: DataFrame, overlap: float, block: int = BLOCK_WORDS) -> DataFrame:
    """set_id of the new sets that share enough with an existing one; blocks hold ``block`` words of a side, about."""
    count = lambda d: d.agg(F.coalesce(F.sum(F.size("hs")), F.lit(0))).first()[0]
    blocks = count(existing) // block + 1
    groups = max(count(new) // block + 1, -(-2 * new.sparkSession.sparkContext.defaultParallelism // blocks))
    dealt = lambda n: F.pmod(F.xxhash64("set_id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = existing.select(dealt(blocks).alias("block"), each(groups).alias("group"), "hs")
    asks = new.select(each(blocks).alias("block"), dealt(groups).alias("group"), "set_id", "hs")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return known_of_block(left, right, overlap)
    met = asked.groupBy("block", "group").cogroup(asks.groupBy("block", "group")).applyInArrow(run, "set_id binary")
    return met if blocks == 1 else met.distinct()


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(all members of a list column, where each list starts and the last ends)."""
    lists = column.combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    size = np.asarray(pc.list_value_length(lists))
    return np.asarray(lists.flatten()), np.concatenate([[0], np.cumsum(size, dtype=np.int64)])


def known_of_block(existing: pa.Table, new: pa.Table, overlap: float) -> pa.Table:
    """set_id of the new sets that share ``overlap`` of the smaller set with an existing one, by counting along postings."""
    none = new.select(["set_id"]).slice(0, 0)
    if not len(existing) or not len(new):
        return none
    word, at = _flat(existing["hs"])
    size = np.diff(at)
    order = np.argsort(word, kind="stable")
    holder = np.repeat(np.arange(len(size), dtype=np.int32), size)[order]
    word = word[order]
    starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    words, starts = word[starts], np.r_[starts, len(word)]
    asked, at = _flat(new["hs"])
    own = np.diff(at)
    place = np.minimum(np.searchsorted(words, asked), len(words) - 1)
    there = words[place] == asked
    place, at = place[there], np.concatenate([[0], np.cumsum(there)])[at]
    lo, hi = starts[place], starts[place + 1]
    known = np.zeros(len(own), bool)
    for i in np.flatnonzero(at[1:] > at[:-1]):
        spans = [holder[x:y] for x, y in zip(lo[at[i]:at[i + 1]], hi[at[i]:at[i + 1]])]
        shared = np.bincount(np.concatenate(spans), minlength=len(size))
        known[i] = (shared >= overlap * np.minimum(size, own[i]) - 1e-9).any()
    return new.select(["set_id"]).filter(pa.array(known))


def novel_claims(new: DataFrame, existing: DataFrame, overlap: float = 0.6, min_words: int = 4) -> DataFrame:
    """New claims that say something the existing ones do not; too-short claims are not novel."""
    return (known_claims(new, existing, overlap)
            .filter((F.col("n_words") >= min_words) & ~F.col("known")).select("claim_id"))
