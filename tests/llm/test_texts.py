"""Operators on documents: language ID, sharding, substring and MinHash dedup, SentencePiece, packing, token files."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keelson.llm import common, tokens
from keelson.llm import op1_language_id as lang
from keelson.llm import op2_shard as shard
from keelson.llm import op4_substring_dedup as sub
from keelson.llm import op6_minhash_dedup as near
from keelson.llm import op7_sentencepiece as piece
from keelson.llm import op8_pack as pack
from keelson.llm import op10_token_files as tokens_out
from keelson.llm.common import Words

public_tokenizers = pytest.importorskip("public_tokenizers")

WHITE = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \t\n", "123 !?", "x", "Σας ΟΔΟΣ x", "日本 語 text", "a\x0bb\x1cc d", "é é ́x", "<|endoftext|> hi", "it's we'll  A   B ", "a​b  c"]


def words(text):
    return WHITE.findall(text or "")


def test_words_are_cut_and_hashed_alike_everywhere(monkeypatch):
    texts = [*ODD, "one two\tone", "two  one\n"]
    w = Words(pa.array(texts))
    assert w.counts().tolist() == [len(words(t)) for t in texts]
    names = [x for t in texts for x in words(t)]
    by_name = defaultdict(set)
    for name, h in zip(names, w.hash.tolist(), strict=True):
        by_name[name].add(h)
    assert all(len(v) == 1 for v in by_name.values()) and len({h for v in by_name.values() for h in v}) == len(by_name)
    low = Words(pa.array(["ABC é", "abc É"]), lower=True).hash.tolist()
    assert low[0] == low[2] and low[1] != low[3]  # only A-Z are lowered
    assert len(Words(pa.array([], pa.string())).hash) == 0
    monkeypatch.setattr(common, "STRETCH", 5)
    assert Words(pa.array(texts)).hash.tolist() == w.hash.tolist()


# --- language ID ---


def test_languages_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lang.query(spark, "/root/testdata/sf0.01").where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)


def test_language_edge_cases(spark, documents):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the", "and", "of", "with"] if i % 2 else ["der", "und", "von", "mit"]) + rng.choice("abc") for _ in range(30)), "en" if i % 2 else "de") for i in range(40)]
    model = lang.learn(documents(rows).select("text", "lang"))
    assert set(model) == {"en", "de"}
    odd = documents([(100 + i, t, None) for i, t in enumerate(ODD)] + [(100, None, None), (None, "the and of the with " * 20000, None)])
    got = lang.identify(odd, model)
    assert [c for c in got.columns if got.columns.count(c) > 1] == []
    rows = got.collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        has = bool(r["text"]) and any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] != "und") == has and 0 <= r["score"] <= 1 and (has or r["rejected"])
    assert [r["lang_pred"] for r in rows if r["doc_id"] is None] == ["en"]
    assert {r["lang_pred"] for r in lang.identify(odd, {}).collect()} == {"und"}
    assert lang.identify(odd.limit(0), model).count() == 0 and lang.learn(odd.select("text", "lang")) == {}


def test_narrow_margins_are_rejected_and_clean_texts_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lang.learn(docs.where(~lang.held_out(F.col("doc_id"))).select("text", "lang"))
    clean = [r for r in docs.where(lang.held_out(F.col("doc_id"))).orderBy("doc_id").collect() if len(r["text"] or "") >= 200]
    rng = random.Random(5)
    unknown = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(200)) for _ in range(200)]
    pairs = [rng.sample(clean, 2) for _ in range(600)]
    mixed = [f"{a['text'][:n]} {b['text'][:n]}" for a, b in pairs for n in [min(len(a["text"]), len(b["text"]), 1000)] if a["lang"] != b["lang"]]
    sets = {"clean": [r["text"] for r in clean], "unknown": unknown, "mixed": mixed}
    rows = spark.createDataFrame([(k, t) for k, v in sets.items() for t in v], "kind string, text string").repartition(8)
    share = {r["kind"]: r["part"] for r in lang.identify(rows, model).groupBy("kind").agg(F.avg(F.col("rejected").cast("int")).alias("part")).collect()}
    assert share["clean"] <= 0.01 and share["unknown"] >= 0.97 and share["mixed"] >= 0.15


def test_predictions_equal_brute_force(spark):
    """Every text against every dictionary, one by one, outside Spark."""
    import regex
    import zstandard

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labelled = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect() if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    model = lang.learn(docs.where(~lang.held_out(F.col("doc_id"))).select("text", "lang"))
    assert set(model) == {k for _, t, k in labelled if t and regex.search(r"\p{L}", t)}
    made = {}
    for k, raw in model.items():
        params = zstandard.ZstdCompressionParameters.from_level(3, write_content_size=0, write_checksum=0, write_dict_id=0, **lang.SEARCH)
        made[k] = (zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), params)
    got = {r["doc_id"]: r for r in lang.query(spark, sf).collect()}
    for r in docs.collect():
        mine = got[r["doc_id"]]
        assert mine["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if not r["text"] or not regex.search(r"\p{L}", r["text"]):
            assert (mine["lang_pred"], mine["score"], mine["rejected"]) == ("und", 0.0, True)
            continue
        text = regex.sub(r"[^\p{L}]+", " ", r["text"]).lower().encode()
        sizes = {k: len(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress(text)) for k, (d, p) in made.items()}
        best = min(sizes.values())
        assert sizes[mine["lang_pred"]] == best
        second = sorted(sizes.values())[1] if len(sizes) > 1 else None
        margin = 1.0 if second is None else (second - best) / second
        assert abs(mine["margin"] - margin) < 1e-9 and mine["rejected"] == (margin < lang.MARGIN)


def test_every_language_is_learned_and_ties_are_rejected(documents):
    rows = [(i, " ".join(f"l{i}x{j}".translate(str.maketrans("0123456789", "abcdefghij")) for j in range(12)), f"lang{i}") for i in range(401)]
    model = lang.learn(documents(rows).select("text", "lang"))
    assert len(model) == 401
    same = {"aa": b"one two three", "bb": b"one two three"}
    odd = documents([(1, "one two"), (2, "one two three " * 400)]).withColumn("letters", F.lit(1)).withColumn("plain", F.lit("x")).withColumn("__plain", F.lit(1)).withColumn("__letters", F.lit(1))
    got = lang.identify(odd, same).collect()
    assert [(r["lang_pred"], r["rejected"], r["letters"], r["plain"]) for r in got] == [("aa", True, 1, "x")] * 2


# --- sharding ---


def check_shards(rows, shards):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    for of in by.values():
        assert sorted(r["slot"] for r in of) == list(range(len(of)))
    sizes = [sum(r["size"] for r in by[k]) for k in range(shards)]
    return sizes


def test_shards_are_near_equal_in_bytes(spark):
    rows = shard.query(spark, "/root/testdata/sf0.01").collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    sizes = check_shards(rows, 40)
    assert max(sizes) <= 1.01 * sum(sizes) / 40
    at = defaultdict(set)
    for r in rows:
        raw = docs[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "bytes" and r["grown_shard"] is None
        at[docs[r["doc_id"]]].add(r["shard"])
    assert all(len(v) == 1 for v in at.values())
    for k, most in (("tokens", 1.05), (None, 1.1)):
        sums = Counter()
        for r in rows:
            sums[r["shard"]] += r[k] if k else 1
        assert len(sums) == 40 and max(sums.values()) <= most * sum(sums.values()) / 40


def brute_placement(sizes, shards):
    """Largest first, by dot product with what is left; plain Python."""
    total = [max(sum(s[c] for s in sizes), 1) for c in range(3)]
    share = [[s[c] / total[c] * shards for c in range(3)] for s in sizes]
    left, out = [[1.0] * 3 for _ in range(shards)], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-max(share[i]), i)):
        room = [min(x - y for x, y in zip(b, share[i], strict=True)) for b in left]
        fits = [k for k in range(shards) if room[k] >= 0]
        dot = lambda k: sum(x * y for x, y in zip(left[k], share[i], strict=True))
        k = max(fits, key=lambda k: (round(dot(k), 9), -k)) if fits else max(range(shards), key=lambda k: (round(room[k], 9), -k))
        out[i] = k
        left[k] = [x - y for x, y in zip(left[k], share[i], strict=True)]
    return [out[i] for i in range(len(sizes))]


@pytest.mark.parametrize("seed", range(3))
def test_placement_equals_brute_force(monkeypatch, seed):
    rng = random.Random(seed)
    sizes = [[rng.randrange(16, 5000), rng.randrange(0, 900), rng.randrange(1, 6)] for _ in range(300)]
    monkeypatch.setattr(shard, "NEAR", 10)  # no exchange afterwards
    want = brute_placement(sizes, 7)
    got = shard.place(np.array(sizes, float), 7).tolist()
    assert sum(a == b for a, b in zip(got, want, strict=True)) >= 295  # rounding may turn a near tie


def test_a_hot_group_below_a_shard_stays_whole_in_pieces(documents):
    rows = [(i, "hot " * 20 if i % 10 == 0 else f"{i} " * (i % 17 + 1)) for i in range(2000)]
    got = shard.shard(documents(rows), shards=4, parcels=64).collect()
    check_shards(got, 4)
    assert len({r["shard"] for r in got if r["doc_id"] % 10 == 0}) == 1


def test_a_hot_group_is_split(documents):
    rng = random.Random(2)
    rows = [(i, "hot text " * 30 if i % 3 == 0 else f"{rng.random()} " * rng.randrange(1, 30)) for i in range(1500)]
    sizes = check_shards(shard.shard(documents(rows), shards=8).collect(), 8)
    assert max(sizes) <= 1.1 * sum(sizes) / 8


def test_shard_edge_cases(documents):
    got = shard.shard(documents([(1, None), (1, None), (2, ""), (None, "x"), (3, "é" * 100_000)]), shards=4).collect()
    assert sorted((r["size"], r["text_crc32"]) for r in got)[:3] == [(16, 0)] * 3 and len(got) == 5
    check_shards(got, 4)
    assert shard.shard(documents([(1, "x")]).limit(0), shards=4).count() == 0


# --- substring dedup ---


def brute_substrings(rows, length):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    first = {}
    for i in order:
        w = words(rows[i][1])
        for s in range(len(w) - length + 1):
            k = tuple(w[s : s + length])
            at = (rows[i][0] is None, rows[i][0] or 0, s)
            first[k] = min(first.get(k, at), at)
    out = []
    for doc, text, *_ in rows:
        w = words(text)
        gone = set()
        for s in range(len(w) - length + 1):
            if first[tuple(w[s : s + length])] < (doc is None, doc or 0, s):
                gone.update(range(s, s + length))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return Counter(out)


def got_substrings(df):
    return Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in df.collect())


@pytest.mark.parametrize("seed", range(4))
def test_substrings_equal_brute_force(documents, monkeypatch, seed):
    monkeypatch.setattr(sub, "FREQUENT", [512, 3, 20, 1][seed])  # few frequent prefixes, or most of them
    monkeypatch.setattr(sub, "GROUP", [8192, 8192, 2, 5][seed])  # groups that fit, or prefixes that must be lengthened
    rng = random.Random(seed)
    passages = [[rng.choice("abcdefgh") for _ in range(rng.randrange(10, 60))] for _ in range(6)]
    rows = []
    for i in range(120):
        text = []
        for _ in range(rng.randrange(0, 6)):
            text += rng.choice(passages) if rng.random() < 0.6 else [f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 30))]
        rows.append((rng.randrange(10**6) if i % 40 else None, rng.choice([" ", "\n", " \t"]).join(text)))
    rows += [rows[5], rows[7], (1, None), (2, ""), (3, " a ")]
    assert got_substrings(sub.dedup_substrings(documents(rows))) == brute_substrings(rows, 20)


def brute_repeats(sequences, least):
    """(words, times) of every maximal repeat: extending it to either side loses an occurrence."""
    at = defaultdict(list)
    for i, w in enumerate(sequences):
        for a in range(len(w)):
            for b in range(a + least, len(w) + 1):
                at[tuple(w[a:b])].append((i, a, b))
    out = set()
    for k, places in at.items():
        before = {sequences[i][a - 1] if a else (i, "start") for i, a, _ in places}
        after = {sequences[i][b] if b < len(sequences[i]) else (i, "end") for i, _, b in places}
        if len(places) > 1 and len(before) > 1 and len(after) > 1:
            out.add((k, len(places)))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_deep_nodes_are_the_maximal_repeats(seed):
    rng = random.Random(seed)
    common = [rng.choice("abc") for _ in range(25)]
    sequences = []
    for _ in range(rng.randrange(1, 9)):
        a = rng.randrange(20)
        sequences.append([rng.choice("ab") for _ in range(rng.randrange(0, 12))] + common[a : a + rng.randrange(0, 25)] + [rng.choice("abc") for _ in range(rng.randrange(0, 9))])
    names = {c: np.uint64(hash((c, seed)) & (2**64 - 1)) for c in "abc"}
    h = np.array([names[c] for w in sequences for c in w], np.uint64)
    first = np.concatenate([[0], np.cumsum([len(w) for w in sequences])])
    for least in (1, 3):
        tree = sub.SuffixTree(h, first, least)
        leaf = [sequences[i][o:] for i, o in zip(tree.run.tolist(), tree.offset.tolist(), strict=True)]
        assert len(leaf) == sum(max(len(w) - least + 1, 0) for w in sequences)
        for x, y, n in zip(leaf[:-1], leaf[1:], tree.common[1:].tolist(), strict=True):
            assert x[:n] == y[:n] and (x[n : n + 1] != y[n : n + 1] or len(x) == n or len(y) == n)
        got = {(tuple(leaf[a][:n]), b - a) for a, b, n in tree.maximal_repeats(least)}
        assert got == brute_repeats(sequences, least)
        roots = tree.roots(least)
        assert len(set(roots.tolist())) == len({tuple(x[:least]) for x in leaf})
    empty = sub.SuffixTree(np.zeros(0, np.uint64), np.zeros(3, np.int64), 1)
    assert len(empty.run) == 0 and empty.maximal_repeats(1) == []


def test_a_passage_in_many_contexts_is_split_by_longer_prefixes(documents, monkeypatch):
    monkeypatch.setattr(sub, "GROUP", 16)
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(24)]
    rows = [(i, " ".join([f"a{i}x{j}" for j in range(rng.randrange(3, 20))] + passage + [f"b{i}x{j}" for j in range(rng.randrange(3, 20))])) for i in range(200)]
    base = documents(rows).select(F.col("doc_id").alias("d"), F.hash("text").alias("t"), "text")
    kinds = {r["kind"] for r in sub.split_groups(sub.find_runs(base, 20)).collect()}
    assert sub.LARGE in kinds
    assert got_substrings(sub.dedup_substrings(documents(rows))) == brute_substrings(rows, 20)


def test_one_very_long_text_and_none(documents):
    rng = random.Random(9)
    block = [f"{rng.randrange(10**6):x}" for _ in range(600_000)]
    rows = [(5, " ".join(block + block[:500_000])), (6, " ".join(block[1000:1100])), (7, " ".join(["same"] * 300))]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in sub.dedup_substrings(documents(rows)).collect()}
    want = {doc: (n, m) for doc, n, m, _ in brute_substrings(rows, 20)}
    assert got == want
    none = sub.dedup_substrings(documents(rows).limit(0))
    assert none.count() == 0 and none.columns.count("kept_text") == 1


def test_a_phrase_hot_in_one_document_of_many_is_frequent(spark):
    # 16,500 documents; each of the last three holds a phrase of its own in 600 contexts.
    hot = [(16_500 + i, " ".join(f"p{i}a p{i}b p{i}c p{i}d p{i}e x{i}y{j}" for j in range(600))) for i in range(3)]
    docs = spark.range(16_500).selectExpr("id AS doc_id", "concat_ws(' ', id, id + 1, id + 2, id + 3, id + 4, id + 5) AS text").union(spark.createDataFrame(hot, "doc_id long, text string"))
    want = [common.grams(Words(pa.array([t])).hash, sub.GRAM)[0] for _, t in hot]
    assert set(want) <= set(sub.frequent_prefixes(docs))


def test_substring_query_hashes_kept_words(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = Counter(tuple(r) for r in sub.query(spark, "/root/testdata/sf0.001").select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == Counter((a, b, c, hashlib.sha256(d.encode()).hexdigest()) for (a, b, c, d), n in brute_substrings(rows, 20).items() for _ in range(n))


# --- MinHash near-dedup ---


def shingles(text, k):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_near(rows, k, percent=80):
    """component of each doc_id (unique, not null)."""
    sets = {d: shingles(t, k) for d, t, *_ in rows}
    ids = sorted(sets)
    part = {d: d for d in ids}

    def root(d):
        while part[d] != d:
            d = part[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                part[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def families(seed, n=40):
    """Texts around common ancestors, with edits that put many similarities close to 0.8 on both sides."""
    rng = random.Random(seed)
    out = []
    for _ in range(4):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([8, 60, 150]))]
        for _ in range(n):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 8))):
                at = rng.randrange(len(w))
                w[at] = f"x{rng.randrange(3000)}"
            out.append(" ".join(w))
    rng.shuffle(out)
    return [(3 * i + 1, t.upper() if i % 5 == 0 else t) for i, t in enumerate(out)]


@pytest.mark.parametrize(("seed", "k", "block"), [(1, 2, 512), (2, 2, 8), (3, 5, 512)])
def test_components_equal_brute_force(documents, monkeypatch, seed, k, block):
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "FAN", 7)
    if seed == 2:
        monkeypatch.setattr(common, "HOTTEST", 3)
    rows = families(seed)
    rows += [(2000, rows[3][1]), (2001, rows[3][1].replace(" ", "\n"))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near.dedup(documents(rows), k).collect()}
    assert got == brute_near(rows, k)


def test_near_dedup_of_the_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near.query(spark, "/root/testdata/sf0.001").collect()}
    assert got == {d: (n, c, c == d) for d, (n, c) in brute_near(docs, 2).items()}


def test_near_dedup_edge_cases(documents):
    rows = [(4, None), (5, ""), (6, " \n"), (7, "one"), (8, "ONE "), (9, "two"), (None, "one"), (10, "word " * 50_000), (11, "word " * 60_000), (12, "a b"), (12, "a b")]
    got = near.dedup(documents(rows), 2).collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append((r["n_shingles"], r["component_id"], r["kept"]))
    assert by[4] == by[5][:0] + [(0, 4, True)] and by[6] == [(0, 6, True)]
    assert by[7] == [(1, 7, True)] and by[8] == [(1, 7, False)] and by[9] == [(1, 9, True)]
    assert by[None] == [(1, None, True)] or by[None][0][2] is True
    assert by[11] == [(1, 10, False)] and by[12] == [(1, 12, True)] * 2
    assert near.dedup(documents(rows).limit(0), 2).count() == 0


def test_signatures_within_the_distance_share_a_bucket():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a = rng.integers(0, 65536, near.VALUES).astype("<u2")
        b = a.copy()
        b[rng.choice(near.VALUES, 23, replace=False)] += 1
        x, y = near.bucket_keys(np.stack([a, b]))
        assert set(x.tolist()) & set(y.tolist())


# --- SentencePiece ---


@pytest.fixture(scope="module")
def segmenter():
    return piece.Segmenter(public_tokenizers.path("piece_bpe_32k.model"))


def brute_segmentations(text, pieces, n):
    w = piece.SPACE + text.replace(" ", piece.SPACE) if text else ""
    best = [[(0.0, ())]]
    for e in range(1, len(w) + 1):
        found = []
        for b in range(max(0, e - pieces.longest), e):
            if w[b:e] in pieces.pieces:
                i, s = pieces.pieces[w[b:e]]
                found += [(score + s, p + (i,)) for score, p in best[b]]
            elif e - b == 1:
                found += [(score + pieces.unknown, p + tuple(pieces.byte[list(w[b:e].encode())].tolist())) for score, p in best[b]]
        best.append(sorted(found, key=lambda x: -x[0])[: n + 8])
    return best[-1]


@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_n_best_equals_brute_force(segmenter, n):
    rng = random.Random(n)
    texts = [*ODD, "Hello  world\n x", "x" * 40, *["".join(rng.choice("abcdeth on.,\n é1'ß語") for _ in range(rng.randrange(1, 50))) for _ in range(150)]]
    for text, found in zip(texts, segmenter.nbest(texts, n), strict=True):
        want = brute_segmentations(text or "", segmenter.pieces, n)
        assert [s for s, _ in found] == [s for s, _ in want[:n]]
        assert len({tuple(ids.tolist()) for _, ids in found}) == len(found)
        assert all(segmenter.decode(ids) == (text or "") for _, ids in found)


def test_long_texts_go_in_stretches(monkeypatch, segmenter):
    rng = random.Random(11)
    texts = ["".join(rng.choice("abcdeth on.,\n é1'ß語") for _ in range(rng.randrange(1, 60))) for _ in range(120)] + ["x" * 40, "a b " * 20]
    want = segmenter.nbest(texts, 3)
    monkeypatch.setattr(piece, "LONG", 7)
    for text, found, whole in zip(texts, segmenter.nbest(texts, 3), want, strict=True):
        assert np.allclose([s for s, _ in found], [s for s, _ in whole], atol=1e-6)
        assert len({tuple(ids.tolist()) for _, ids in found}) == len(found) and all(segmenter.decode(ids) == text for _, ids in found)


def test_sentencepiece_query_equals_its_parts(spark):
    """The registered query's columns, from brute force over short documents and the library's own decoding."""
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    made, library = piece.Segmenter(path), SentencePieceProcessor(model_file=path)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = defaultdict(list)
    for r in piece.query(spark, "/root/testdata/sf0.001").collect():
        got[r["doc_id"]].append(r)
    assert set(got) == set(docs)
    for doc, text in docs.items():
        rows = sorted(got[doc], key=lambda r: r["rank"])
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)
        assert all(r["decoded_crc32"] == zlib.crc32((text or "").encode()) for r in rows)
        for r, (score, ids) in zip(rows, made.nbest([text], 3)[0], strict=True):
            assert (r["n_pieces"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids.astype("<u4").tobytes())) and abs(r["score"] - score) < 1e-6
            assert library.decode(ids.tolist()) == text or "\u2581" in text or text != text.strip()
        if text and len(text) < 400:
            want = brute_segmentations(text, made.pieces, 3)
            assert np.allclose([r["score"] for r in rows], [s for s, _ in want[:3]], atol=1e-6)


def test_equal_scores_come_in_the_same_order_every_time(spark, documents):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = [(i, "aa bb aa bb zz zz") for i in range(4)]
    runs = [sorted((r["doc_id"], r["rank"], bytes(r["ids"])) for r in piece.encode(documents(rows), path, 4).collect()) for _ in range(2)]
    assert runs[0] == runs[1] and len({x[1:] for x in runs[0]}) == 4


def test_sentencepiece_operator(spark, documents):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = [(i, t) for i, t in enumerate(ODD)] + [(0, "again"), (None, "word and more " * 30_000)]
    got = piece.encode(documents(rows), path, 2).collect()
    assert all(r["decoded"] in {t or "" for _, t in rows} for r in got) and {r["rank"] for r in got} == {1, 2}
    assert [r["score"] for r in got if r["doc_id"] == 1] == [0.0]
    assert piece.encode(documents(rows).limit(0), path).count() == 0


# --- token ids, packing, token files ---


@pytest.mark.parametrize(("kind", "name"), [(tokens.ByteEncoder, "byte_bpe_50k.json"), (tokens.WordEncoder, "word_bpe_49k.json")])
def test_ids_equal_the_library(spark, monkeypatch, kind, name):
    monkeypatch.setattr(tokens, "MOST_CHUNKS", 50)
    monkeypatch.setattr(tokens, "MOST_PIECES", 20)
    rng = random.Random(4)
    texts = [*ODD, "a   b", " x", "a  \n", "I'M we'll a's 12 345", *["".join(rng.choice("aB c\n\t.,'sé1İſ ") for _ in range(rng.randrange(60))) for _ in range(300)]]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    made = kind(public_tokenizers.path(name))
    want = [e.ids for e in made.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for at in range(0, len(texts), 100):
        flat, bounds = made.ids(pa.array(texts[at : at + 100], pa.string()))
        assert [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == want[at : at + 100]


@pytest.mark.parametrize("seed", range(5))
def test_patterns_hold_every_piece_and_little_else(seed):
    rng = random.Random(seed)
    histogram = {s: rng.randrange(0, 400) for s in rng.sample(range(1, 1025), 300)}
    found = pack.patterns(histogram, 1024)
    held = Counter()
    for sizes, n in found:
        assert sum(sizes) <= 1024 and n > 0
        for s in sizes:
            held[s] += n
    assert held == Counter({s: n for s, n in histogram.items() if n})
    total = sum(s * n for s, n in histogram.items())
    assert sum(n for _, n in found) * 1024 <= 1.07 * total + 1024  # even lengths are the hardest
    assert pack.patterns({}, 1024) == []


def brute_patterns(histogram, length):
    """Plain shortest-pack-first, a piece at a time: longest pieces first, each into the shortest pack with room."""
    packs = []
    for size in sorted(histogram, reverse=True):
        for _ in range(histogram[size]):
            k = min(range(len(packs)), key=lambda i: sum(packs[i]), default=None)
            if k is None or sum(packs[k]) + size > length:
                packs.append([size])
            else:
                packs[k].append(size)
    return Counter(tuple(p) for p in packs)


@pytest.mark.parametrize("seed", range(6))
def test_patterns_equal_brute_force(seed):
    rng = random.Random(seed)
    histogram = {s: rng.randrange(1, 12) for s in rng.sample(range(1, 65), rng.randrange(1, 40))}
    found, want = pack.patterns(histogram, 64), brute_patterns(histogram, 64)
    assert sum(n for _, n in found) == sum(want.values())
    rooms = [Counter(), Counter()]
    for at, each in zip(rooms, (found, want.items()), strict=True):
        for p, n in each:
            at[64 - sum(p)] += n
    assert rooms[0] == rooms[1]  # packs of equal length may have changed places, no more


def check_packed(rows, ids):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for of in by_sequence.values():
        at = 0
        for offset, n in sorted(of):
            assert offset == at and n > 0
            at += n
        assert at <= 1024
    for doc, want in ids.items():
        pieces = sorted(by_doc[doc], key=lambda r: r["start"])
        assert [r["start"] for r in pieces] == [sum(x["length"] for x in pieces[:i]) for i in range(len(pieces))]
        for r in pieces:
            assert r["ids_crc32"] == zlib.crc32(np.array(want[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) and r["doc_tokens"] == len(want)
        assert sum(r["length"] for r in pieces) == len(want)
    return len(by_sequence)


def test_packing(spark, documents):
    tokenizer = tokens.ByteEncoder(public_tokenizers.path("byte_bpe_50k.json")).tokenizer
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(ODD)] + [(20_000, "long text " * 30_000)]
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for d, t in rows}
    n = check_packed(pack.pack_rows(documents(rows)).collect(), ids)
    assert n * 1024 <= 1.02 * sum(map(len, ids.values())) + 1024
    assert pack.pack_rows(documents([(1, "x"), (1, "x"), (None, "y")])).count() == 3
    assert pack.pack_rows(documents(rows).limit(0)).count() == 0


def test_token_files(spark, documents):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = tokens.WordEncoder(path).tokenizer
    rows = [(r["doc_id"] * 7 - 300, r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(ODD)] + [(20_000, "Long Text " * 30_000)]
    files = tokens_out.write(documents(rows), path)
    got = {r["doc_id"]: r for r in tokens_out.read(spark, files).collect()}
    at = 0
    for doc, text in sorted(rows):
        want = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        r = got[doc]
        assert (r["start"], r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist()) == (at, len(want), want)
        at += len(want)
    parts = spark.read.parquet(files.blocks).select(F.col("_metadata.file_name").alias("file"), "first_doc", "last_doc").collect()
    order = [(r["first_doc"], r["last_doc"]) for r in sorted(parts, key=lambda r: (r["file"], r["first_doc"]))]
    assert len({r["file"] for r in parts}) > 1 and order == sorted(order)  # files follow each other in doc_id order
    assert tokens_out.read_document(spark, files, 10_004) == [[*tokenizer.encode("x", add_special_tokens=False).ids, 2]]
    assert tokens_out.read_document(spark, files, 5) == []


def test_token_file_edge_cases(spark, documents):
    path = public_tokenizers.path("word_bpe_49k.json")
    files = tokens_out.write(documents([(5, "b b"), (5, "a"), (None, "first"), (1, None)]), path)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in tokens_out.read(spark, files).collect())
    assert [d for _, d, _ in got] == [None, 1, 5, 5] and [s for s, _, _ in got] == [sum(n for _, _, n in got[:i]) for i in range(4)]
    assert len(tokens_out.read_document(spark, files, 5)) == 2
    assert tokens_out.read(spark, tokens_out.write(documents([(1, "x")]).limit(0), path)).count() == 0
