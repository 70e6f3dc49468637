"""Repeated bytes, vector codes and spelling variants against brute force."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corrobora.llm import codes, repeats, variants
from corrobora.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- repeated bytes

def plain_without(docs, w=100):
    """docs: (doc_id, text, order among equal ids); every window in order, the first of equals stays."""
    seen, out = set(), []
    for doc_id, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - w + 1):
            x = data[i:i + w]
            if x in seen:
                gone[i:i + w] = b"\1" * w
            seen.add(x)
        kept = bytes(c for c, g in zip(data, gone) if not g)
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((doc_id, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def removed(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()), key=repr)


def test_suffix_order_equals_sorting():
    rng = random.Random(1)
    for _ in range(2_000):
        text = [rng.randrange(1, rng.randrange(2, 5)) for _ in range(rng.randrange(40))] + [0]
        assert repeats.suffix_order(text) == sorted(range(len(text)), key=lambda i: text[i:])
    for text in ([1] * 500 + [0], [1, 2] * 300 + [0], [2] * 200 + [1] * 200 + [0], [0]):
        assert repeats.suffix_order(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_repeated_bytes_query_equals_brute_force(spark):
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = removed(QUERIES["op12_repeated_bytes"](spark, SF))
    assert got == plain_without(docs) and sum(r[2] for r in got) > 10_000


def corpus(rng, n):
    """Texts of few blocks, edited, cut, shifted and repeated; some of one letter or of a short period."""
    blocks = ["".join(rng.choices("abcdefgh é", k=rng.randrange(20, 260))) for _ in range(12)]
    out = []
    for i in range(n):
        t = "".join(rng.choice(blocks) + "".join(rng.choices("xyzé ", k=rng.choice((0, 0, 1, 3, 40)))) for _ in range(rng.randrange(6)))
        if rng.random() < 0.3:
            t = t[rng.randrange(60):]
        if rng.random() < 0.2:
            t += "ab" * rng.randrange(200) + "a" * rng.randrange(300)
        if rng.random() < 0.2:
            t += "the line that all texts share, so to say;" + "".join(rng.choices("klmn", k=80))
        out.append((i, t))
    return out


@pytest.mark.parametrize("group", [2, 4_096])
def test_repeats_of_every_kind_equal_brute_force(spark, group, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 900)
    docs = corpus(random.Random(group), 160)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert removed(repeats.without_repeats(df, group=group, sample=80)) == plain_without(docs)


def test_repeats_odd_rows(rows):
    rng = random.Random(4)
    long = "".join(rng.choices("abcdefghij ", k=150_000))
    text = "".join(rng.choices("klmnop ü", k=400))
    data = [(5, text), (5, text), (5, text), (None, text[30:]), (1, None), (2, ""), (3, "short"), (3, "short"), (9, long), (8, long[70_000:]), (7, "é" * 49), (6, "é" * 51)]
    df = rows("doc_id long, text string", *data).withColumns({c: F.lit(1) for c in ("thash", "start", "place", "anchor", "windows", "count", "a.b")})
    got = removed(repeats.without_repeats(df))
    order = [(None, text[30:]), (1, ""), (2, ""), (3, "short"), (3, "short"), (5, text), (5, text), (5, text), (6, "é" * 51), (7, "é" * 49), (8, long[70_000:]), (9, long)]
    assert got == plain_without(order)
    assert repeats.without_repeats(df.limit(0)).count() == 0


# ---------------------------------------------------------------- vector codes

def plain_codes(data, parts=16, entries=64, rounds=2):
    """data: (vec_id, vector or None, label) in order of id."""
    import math
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in data
            if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    dim = max(Counter(len(v) for _, v, _ in kept).items(), key=lambda c: (c[1], c[0]))[0]
    kept = [k for k in kept if len(k[1]) == dim]
    cut = [dim * i // parts for i in range(parts + 1)]
    part = lambda v, p: v[cut[p]:cut[p + 1]]                                                   # noqa: E731
    first = sorted(kept, key=lambda k: (k[0] is None, k[0] or 0, k[1]))[:entries]
    books = [[part(k[1], p) for k in first] for p in range(parts)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for _, v, _ in kept:
                members[best(part(v, p), books[p])[1]].append(part(v, p))
            for j, m in members.items():
                books[p][j] = [sum(c) // len(m) for c in zip(*m)]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    rows, total = [], Counter()
    for i, v, lab in kept:
        found = [best(part(v, p), books[p]) for p in range(parts)]
        err = min(2 ** 63 - 1, sum(d for d, _ in found))
        total[lab] += err
        rows.append((i, "".join(f"{j:02x}" for _, j in found), err, lab))
    top = 2 ** 63 - 1
    return sorted(((i, c, e, min(total[lab], top), sha) for i, c, e, lab in rows), key=repr)


def coded(df):
    return sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in df.collect()), key=repr)


def test_vector_codes_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    cur = con.execute(codes.SQL)
    names = [d[0] for d in cur.description]
    want = sorted((tuple(r[names.index(c)] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in cur.fetchall()), key=repr)
    assert coded(QUERIES["op11_vector_codes"](spark, SF)) == want and len(want) > 100


@pytest.mark.parametrize("dim, scale", [(16, 1.0), (32, 1e4), (21, 1e9), (5, 1e13)])
def test_vector_codes_equal_plain_rounds(spark, dim, scale):
    rng = np.random.default_rng(dim)
    data = [(i, (rng.normal(size=dim) * scale).tolist() if i % 3 else [0.25] * dim, i % 4 or None) for i in range(200)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").repartition(4)
    assert coded(codes.codebook_codes(df, rounds=3, owner=16)) == plain_codes(data, rounds=3)


def test_vector_codes_odd_rows(rows):
    nan, inf = float("nan"), float("inf")
    data = [(1, [0.5] * 16, 1), (1, [0.5] * 16, 1), (2, None, 1), (3, [], 1), (4, [nan] * 16, 2), (5, [inf] + [0.0] * 15, 2), (6, [None] + [1.0] * 15, 2),
            (7, [0.0] * 16, None), (8, [-0.3] * 16, None), (None, [1.0] * 16, 1), (9, [1.0] * 32, 1), (10, [1e300] * 16, 5), (1, [0.1] * 16, 2)]
    df = rows("vec_id long, embedding array<double>, label int", *data).withColumns({c: F.lit(1) for c in ("id", "v", "pos", "entry", "x", "code", "error", "a.b")})
    fine = [d for d in data if d[0] != 10]
    assert coded(codes.codebook_codes(df.filter("vec_id is null or vec_id <> 10"))) == plain_codes(fine)
    assert codes.codebook_codes(df).count() == 7
    assert codes.codebook_codes(df.limit(0)).count() == 0 and codes.codebook_codes(df.filter("vec_id = 2")).count() == 0


# ---------------------------------------------------------------- spelling variants

def one_edit(p, q):
    if abs(len(p) - len(q)) > 1 or p == q:
        return False
    if len(p) == len(q):
        return sum(a != b for a, b in zip(p, q)) == 1
    p, q = sorted((p, q), key=len)
    return any(q[:i] + q[i + 1:] == p for i in range(len(q)))


def plain_variants(docs, often=2, times=10, every=31):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= often}
    near, cut = defaultdict(set), defaultdict(set)
    for w in n:                                                             # words without one letter meet
        for i in range(len(w)):
            cut[w[:i] + w[i + 1:]].add(w)
    for v, group in cut.items():
        group = group | ({v} if v in n else set())
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= times * n[w]:
            form[w] = best
    def root(w):
        while w in form:
            w = form[w]
        return w
    return sorted(((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n), key=repr)


def variant_rows(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()), key=repr)


def test_near_pairs_equal_brute_force():
    rng = random.Random(2)
    for _ in range(1_500):
        words = sorted({"".join(rng.choices("abc"[:rng.randrange(1, 4)], k=rng.randrange(9))) for _ in range(rng.randrange(1, 25))})
        want = [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if one_edit(words[i], words[j])]
        assert [(i, j) for i, j, _ in variants.near_pairs(words)] == want


def test_spelling_variants_query_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = variant_rows(QUERIES["op13_spelling_variants"](spark, SF))
    assert got == plain_variants(docs) and sum(r[1] is not None for r in got) >= 5


@pytest.mark.parametrize("group", [3, 10_000])
def test_variants_in_large_groups_and_chains(spark, group):
    rng = random.Random(group)
    stems = ["".join(rng.choices("abé", k=rng.randrange(7, 13))) for _ in range(60)]
    words = [s for i, s in enumerate(stems) for _ in range(rng.choice((2, 3, 30, 400)))]
    words += ["mnmnmnmn"] * 3 + ["mnmnmnmm"] * 9 + ["mnmnmmmm"] * 27
    words += [s[:i] + rng.choice("abcé") + s[i + rng.randrange(2):] for s in stems for i in range(0, len(s), 2) for _ in range(2)]
    rng.shuffle(words)
    docs = [(i, " ".join(words[i::40])) for i in range(40)]
    got = variant_rows(variants.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string"), every=10 ** 9, times=3, group=group))
    assert got == plain_variants(docs, times=3, every=10 ** 9) and ("mnmnmnmn", "mnmnmnmm", "mnmnmmmm", 3, 1, 9) in got


def test_variants_odd_rows(rows):
    data = [(1, None), (None, "Straßen Straßen, ÄPFELBAUM äpfelbaum×"), (2, ""), (3, "abcdefg abcdefg abcdefgh abcdefgh"), (3, "abcdefg abcdefg abcdefgh abcdefgh"),
            (4, "z" * 3_000 + " " + "z" * 3_000), (5, "z" * 2_999 + " " + "z" * 2_999 + " don't don't 1234567")]
    df = rows("doc_id long, text string", *data).withColumns({c: F.lit(1) for c in ("word", "n", "key", "size", "lo", "root", "a.b")})
    assert variant_rows(variants.spelling_variants(df)) == plain_variants(data)
    assert variants.spelling_variants(df.limit(0)).count() == 0
