"""Operators on vectors and urls, and the pipeline as a whole."""

import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import op3_url_filter as urls
from keelson.llm import op5_embedding_dedup as same
from keelson.llm import op9_nearest as near
from keelson.llm.common import components

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, rows):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    for c in ("id", "key", "keys", "rep", "size", "side", "n", "block", "asked", "rank", "score"):
        df = df.withColumn(c, F.col("label"))
    return df


def clusters(seed, n=400, d=64):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((12, d))
    rows = [(7 * i, (base[i % 12] + rng.standard_normal(d) * rng.choice([0.01, 0.25, 0.34, 3.0])).astype(np.float32).tolist()) for i in range(n)]
    return rows + [(10**6 + i, rows[i][1]) for i in range(30)]


def graph(rows, threshold=0.9):
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    met = x @ x.T >= threshold
    label = np.arange(len(rows))
    order = np.argsort([i for i, _ in rows])
    ids = np.array([i for i, _ in rows])
    low = ids.copy()
    while True:
        new = np.array([low[met[i]].min() for i in label])
        if (new == low).all():
            break
        low = new
    return {int(ids[i]): (int(met[i].sum()) - 1, int(low[i])) for i in order}


@pytest.mark.parametrize(("seed", "block"), [(1, 1024), (2, 8)])
def test_links_equal_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(same, "BLOCK", block)
    rows = clusters(seed)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in same.dedup(table(spark, rows)).collect()}
    want = graph(rows)
    missed = sum(want[i][0] - got[i][0] for i in want)
    assert set(got) == set(want) and 0 <= missed <= 0.001 * sum(w[0] for w in want.values())
    if not missed:
        assert got == want


@pytest.mark.parametrize(("d", "hashes", "least"), [(64, 2, 0.997), (64, 3, 0.997), (64, 4, 0.997), (256, 2, 0.99), (256, 3, 0.99)])
def test_recall_at_the_threshold(d, hashes, least):
    rng = np.random.default_rng(3)
    a = rng.standard_normal((2000, d))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal(a.shape)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(0.19) * b / np.linalg.norm(b, axis=1, keepdims=True)
    x, y = (same.keys(v, same.tables_for(hashes), hashes) for v in (a, b))
    assert np.mean([bool(set(p) & set(q)) for p, q in zip(x.tolist(), y.tolist(), strict=True)]) >= least


def mixed_lengths():
    rows = clusters(4, n=120) + [(2_000_000 + i, v[:3]) for i, v in clusters(5, n=60)]
    return rows + [(4_000_001, [1.0]), (4_000_002, [5.0]), (4_000_003, [-1.0]), (4_000_004, [0.0, 0.0]), (4_000_005, None)]


def test_vectors_of_every_length_take_part(spark):
    rows = table(spark, mixed_lengths()).select("vec_id", "embedding")
    con = duckdb.connect()
    arrow = rows.toArrow()  # noqa: F841 - read by name
    con.execute("CREATE VIEW embeddings AS SELECT * FROM arrow")
    want = con.execute(f"SELECT vec_id, n_links, component_id, kept FROM ({same.ORACLE})").fetchall()
    got = [tuple(r) for r in same.dedup(rows).select("vec_id", "n_links", "component_id", "kept").collect()]
    assert sorted(got) == sorted(want) and dict((r[0], r[1]) for r in got)[4_000_001] == 1
    found = {}
    for r in near.nearest(rows, F.col("vec_id") % 50 == 0).collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    size = {i: len(v or []) for i, v in mixed_lengths()}
    asked = [i for i in size if i % 50 == 0]
    assert set(found) == set(asked) and {size[q] for q in asked} >= {3, 64}
    assert all(len(v) == 5 and {size[x] for x in v} == {size[q]} for q, v in found.items())


def odd_vectors():
    one = [1.0] * 64
    return [(1, None), (2, [0.0] * 64), (3, [float("nan")] + one[1:]), (4, [float("inf")] + one[1:]), (5, [None] + one[1:]), (6, [1.0, 2.0]), (7, []), (50, one), (100, one), (100, one), (150, [1e-30] * 64), (200, [-1.0] * 64)]


def test_odd_vectors_take_no_part(spark):
    got = {}
    for r in same.dedup(table(spark, odd_vectors())).collect():
        got.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    assert all(got[i] == [(0, i, True)] for i in range(1, 8))
    assert got[50] == [(3, 50, True)] and got[100] == [(3, 50, False)] * 2 and got[150] == [(3, 50, False)] and got[200] == [(0, 200, True)]
    assert same.dedup(table(spark, [])).count() == 0
    found = near.nearest(table(spark, odd_vectors()), F.col("vec_id") % 50 == 0).collect()
    assert {r["query_id"] for r in found} == {50, 100, 150, 200}
    first = sorted((r["rank"], r["vec_id"]) for r in found if r["query_id"] == 50)
    assert first == [(1, 100), (2, 100), (3, 150), (4, 200)]
    assert all(r["vec_id"] != r["query_id"] for r in found) and near.nearest(table(spark, []), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("block", [4096, 64])
def test_nearest_recall_order_and_scores(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "QUERY_BLOCK", 5)
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(64).astype(np.float32).tolist()) for i in range(1500)]
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    got = near.nearest(table(spark, rows), F.col("vec_id") % 50 == 0).collect()
    want = {(q, int(v)) for q in range(0, 1500, 50) for v in np.argsort(-s[q], kind="stable")[:5]}
    assert len({(r["query_id"], r["vec_id"]) for r in got} & want) >= 0.9 * len(want) and len(got) == len(want)
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        assert abs(r["score"] - s[r["query_id"], r["vec_id"]]) < 1e-12
        by.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    assert all(v == sorted(v) for v in by.values())


def test_nearest_of_the_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids = [r["vec_id"] for r in rows]
    x = np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    want = {(q, ids[v]) for i, q in enumerate(ids) if q % 50 == 0 for v in np.argsort(-s[i])[:5]}
    got = {(r["query_id"], r["vec_id"]) for r in near.query(spark, sf).collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_components_of_long_paths(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 60)] + [(5000, 5000)]
    rng.shuffle(edges)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1000 + i: 1000 for i in range(1, 60)}


# --- urls ---

ODD_URLS = [None, "", "no scheme", "http://", "https://COM/en/x", "ftp://a.b.example.com/en/7?x#y", "x://example.com/en/77", "http://xexample.net/de/8", "http://example.net/de/8", "http://a.example.net?/de/8", "http://.org/es/", "http://org#/es/", "http://u@org:80/es/", "a://b://c.org/es/", "http://net/de", "http://É.net/de/\n", "http://a..com/en/", "http://example.com./en/7"]


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fit = [(len(h + p), h, p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *((max(fit)[1] + max(fit)[2], max(fit)[3]) if fit else (None, "allow")))


@pytest.mark.parametrize(("most", "prefix"), [(100_000, 4), (0, 4), (0, 0), (100_000, 0)])
def test_urls_equal_brute_force(spark, monkeypatch, most, prefix):
    monkeypatch.setattr(urls, "BROADCAST_BYTES", most)  # 0: rules are shuffled, not broadcast
    rng = random.Random(3)
    every = ODD_URLS + [f"http://{rng.choice(['', 'a.', 'b.c.'])}{rng.choice(['com', 'example.com', 'net', 'example.net', 'org', 'orgs'])}/{rng.choice(['en', 'de', 'es', 'e'])}/{rng.choice(['', '7', '8', '78/x?q=/en/'])}" for _ in range(300)]
    pages = spark.createDataFrame([(i, u, "<p>") for i, u in enumerate(every + every[:5])], "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("digest", F.lit(2))
    # With a prefix of no bytes every rule collides with every expression, and only full digests tell them apart.
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(pages, urls.rules_frame(spark, urls.RULES), prefix=prefix).collect()}
    assert got == {i: brute_url(u) for i, u in enumerate(every + every[:5])}
    assert urls.filter_urls(pages.limit(0), urls.rules_frame(spark, urls.RULES)).count() == 0
    assert {r["verdict"] for r in urls.filter_urls(pages, urls.rules_frame(spark, []), "block").collect()} == {"block"}


def test_rules_join_on_the_prefix_alone(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/")], "page_id long, url string")
    plan = urls.filter_urls(pages, urls.rules_frame(spark, urls.RULES))._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "bucket" in line]
    assert len(joins) == 1 and re.search(r"Join \[bucket#\d+\], \[bucket#\d+\], (Inner|LeftOuter)", joins[0])


def test_rules_of_any_length_and_ties(spark):
    long = "/" + "x" * 3000
    rules = urls.rules_frame(spark, [("com", long, "block"), ("com", "/a/b", "block"), ("a.com", "/a", "allow"), ("com", "/a/b", "allow")])
    pages = spark.createDataFrame([(1, f"http://com{long}y"), (2, f"http://com{long[:-1]}"), (3, "http://a.com/a/b"), (4, "http://com/a/b"), (5, None)], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.filter_urls(pages, rules).collect()}
    # a.com/a and com/a/b are equally long: the longer host wins; of two verdicts for one rule, the later by name.
    assert got == {1: ("com" + long, "block"), 2: (None, "allow"), 3: ("a.com/a", "allow"), 4: ("com/a/b", "block"), 5: (None, "allow")}


def test_url_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    columns = ["page_id", "host", "path", "rule", "verdict"]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({urls.ORACLE})").fetchall()
    plan = urls.query(spark, sf)
    assert sorted(map(tuple, plan.select(columns).collect()), key=str) == sorted(want, key=str)
    assert "Python" not in plan._jdf.queryExecution().toString() and "Arrow" not in plan._jdf.queryExecution().toString()


# --- the pipeline ---


def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    from test_texts import brute_near, brute_substrings

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("extra", F.lit(1))
    kept = [docs.count()]
    for (name, stage), nxt in zip(pipeline.STAGES[:-1], ["near", "substrings", None], strict=True):
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = pipeline.materialize(stage(spark, docs, sf), name)
        assert out.columns == list(pipeline.COLUMNS)
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "language_id":
            assert len(after) >= 0.97 * len(before)
        if name == "near_dedup":
            assert set(after) == {d for d, (_, c) in brute_near(before, 5).items() if d == c}
        if name == "substring_dedup":
            want = {d: (t if not m else k) for (d, n, m, k), (_, t) in ((x, next(b for b in before if b[0] == x[0])) for x in brute_substrings(before, 20)) if not m or m < n}
            assert after == want
        docs = out
        kept.append(len(after))
    assert pipeline.run(spark, sf).select("doc_id").distinct().count() == kept[-1]


@pytest.mark.parametrize("name", ["op3_url_filter", "op4_substring_dedup", "op5_embedding_dedup", "op6_minhash_dedup"])
def test_registered_query_equals_its_sql(spark, name):
    from keelson.llm import queries

    sf = "/root/testdata/sf0.001"
    got = queries.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.select(columns).collect()))) == sorted(map(str, want))


PIPELINE_ROWS = "doc_id long, text string, lang string, source string, n_chars long"


def stage_docs(spark, rows):
    """Documents with columns whose names the stages use themselves."""
    docs = spark.createDataFrame([(d, t, "en" if d is None or d % 2 else None, "s", len(t or "")) for d, t in rows], PIPELINE_ROWS).repartition(3)
    for c in ("near_id", "text_hash", "kept", "found", "rejected", "kept_text", "n_removed", "ids", "length", "rank", "d", "t"):
        docs = docs.withColumn(c, F.lit("x"))
    return docs


def test_rows_that_share_a_doc_id_are_dropped_one_by_one(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    copy = "one two three four five six seven"
    rows = [(3, copy), (5, "a clean text of its own that stays as it is"), (5, copy.upper()), (None, copy), (7, None), (9, "loaded twice, word for word, as it is"), (9, "loaded twice, word for word, as it is")]
    rows += [(None, "no id but two copies of this text here"), (None, "no id but two copies of this text here"), (None, None), (11, "")]
    got = sorted(((r["doc_id"], r["text"]) for r in pipeline.near_dedup(spark, stage_docs(spark, rows), "").collect()), key=str)
    # The copies of doc 3 go whatever their id, and one row is left of equal ones.
    assert got == sorted([rows[0], rows[1], rows[4], rows[5], rows[7], rows[9], rows[10]], key=str)


def test_stages_of_odd_tables(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    passage = " ".join(f"w{i}" for i in range(25))
    rows = [(1, passage + " tail"), (2, "head " + passage), (3, passage), (4, None), (5, ""), (6, " \n"), (None, "late " + passage), (8, "short"), (8, "short"), (9, "123 !?"), (10, "long text " * 30_000)]
    docs = stage_docs(spark, rows)
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pipeline.substring_dedup(spark, docs, "").collect()}
    assert out[1] == (rows[0][1], len(rows[0][1])) and out[2] == ("head", 4) and 3 not in out and out[None] == ("late", 4)
    assert (out[4], out[5], out[6]) == ((None, 0), ("", 0), (" \n", 2)) and out[10][0] != rows[10][1]
    kept = [r["doc_id"] for r in pipeline.language_id(spark, docs, "").collect()]
    assert not {4, 5, 6, 9} & set(kept) and kept.count(8) == 2 and 10 in kept  # one language learned: nothing is tied
    packed = pipeline.packing(spark, docs, "").collect()
    assert sorted({(r["doc_id"], r["length"]) for r in packed if r["doc_id"] in (4, 5)}) == [(4, 1), (5, 1)] and sum(r["doc_id"] == 8 for r in packed) == 2
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert pipeline.language_id(spark, unlabelled, "").count() == 0
    for name, stage in pipeline.STAGES:
        none = stage(spark, docs.limit(0), "")
        assert none.count() == 0 and (name == "packing" or none.columns == list(pipeline.COLUMNS))
