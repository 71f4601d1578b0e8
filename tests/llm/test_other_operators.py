"""Url rules, conversations, embeddings, WARC and the pipeline."""

from __future__ import annotations

import gzip
import hashlib
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cirrolite.llm import embedding_dedup as emb
from cirrolite.llm.chat import format_conversations, read_conversations, reply_paths
from cirrolite.llm.common import components
from cirrolite.llm.oracles import ORACLES
from cirrolite.llm.queries import QUERIES
from cirrolite.llm.url_filters import url_verdicts
from cirrolite.llm.warc import read_archive, write_archive

from ..conftest import DATA
from . import cases
from .test_text_operators import check_packing


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    df = QUERIES[name](spark, DATA)
    c = con.execute(ORACLES[name])
    columns = [x[0] for x in c.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(str, c.fetchall()))


def brute_verdict(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(-len(h) - len(p), -len(h), h + p, a) for h, p, a in rules if h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = min(fit, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


@pytest.mark.parametrize("size", [100_000, 2])
def test_url_rules(spark, monkeypatch, size):
    from cirrolite.llm import url_filters

    monkeypatch.setattr(url_filters.prefix_stacks, "__defaults__", (size,))
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.net", "/en/a", "block"), ("a.example.net", "", "allow"), ("org", "/fr/", "allow"), ("org", "/fr/", "allow"), ("com", "/x", "block"), (None, "/", "block"), ("x-y.net", "/", "allow")]
    urls = [None, "", "no scheme", "http://", "http://NET/", "http://net", "https://example.net/en/abc?x#y", "https://b.example.net/en/", "http://a.example.net?q=/", "http://b.a.example.net/en/a", "http://notexample.net/en/", "ftp://u@example.org/fr/1", "http://example.org:80/fr/", "http://ex.com/xy", "http://ex.com/x", "http://x-y.net/z", "http://x.net/z", "http://..net/", "a://b://c.net/d", "http://é.net/é"] * 2
    got = url_verdicts(spark.createDataFrame([(i, u, "old", 1) for i, u in enumerate(urls)], "page_id bigint, url string, host string, r_key int"), spark.createDataFrame(rules, "host string, path string, action string"))
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()} == {i: brute_verdict(u, rules) for i, u in enumerate(urls)}
    none = url_verdicts(spark.createDataFrame([(1, "http://a.net/")], "page_id bigint, url string"), spark.createDataFrame([], "host string, path string, action string"), default="block")
    assert none.first()["verdict"] == "block"


def test_reply_trees(spark):
    rows = [
        ("a", 1, None, 0.0, "user", "q"), ("a", 2, 1, 1.0, "assistant", "x"), ("a", 3, 1, 2.0, "assistant", "y <turn user>\\b"), ("a", 4, 3, None, "user", None), ("a", 5, 2, 5.0, "user", "z"),
        ("b", 1, 9, 0.0, None, "orphan"), ("b", 1, 9, 0.0, None, "orphan"), ("c", 1, 2, 0.0, "user", "loop"), ("c", 2, 1, 0.0, "user", "loop"), ("c", 3, 2, 0.0, "user", "below"), (None, 1, 1, 0.0, "assistant", ""),
    ] + [("long", i, i - 1 if i else None, 0.0, "assistant" if i % 2 else "user", f"</turn>\n{i}") for i in range(100)]
    m = spark.createDataFrame([(*r, "t", 1) for r in rows], "tree string, node bigint, parent bigint, score double, role string, text string, t string, leaf int")
    p = reply_paths(m, keep=2)
    got = {(r["t"], r["leaf"]): (r["rank"], r["path_score"]) for r in p.collect()}
    assert got == {("va", 5): (1, 6.0), ("va", 4): (2, 2.0), ("vb", 1): (1, 0.0), ("n", 1): (1, 0.0), ("vlong", 99): (1, 0.0)}
    back = {(r["tree"], r["rank"]): r for r in read_conversations(format_conversations(m, keep=2)).collect()}
    assert [(t["role"], t["text"]) for t in back["a", 1]["turns"]] == [("user", "q"), ("assistant", "x"), ("user", "z")] and back["a", 1]["loss_text"] == "x"
    assert [(t["role"], t["text"]) for t in back["a", 2]["turns"]] == [("user", "q"), ("assistant", "y <turn user>\\b"), ("user", "")] and back["a", 2]["loss_text"] == "y <turn user>\\b"
    assert [t["text"] for t in back["long", 1]["turns"]] == [f"</turn>\n{i}" for i in range(100)]
    assert back["long", 1]["loss_text"] == "".join(f"</turn>\n{i}" for i in range(1, 100, 2))
    assert format_conversations(m.limit(0)).collect() == []


def brute_links(rows, cosine=0.93):
    good = []
    for i, v, lab in rows:
        ok = i is not None and lab is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        good.append(ok)
    links = [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if good[a] and good[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]) and np.dot(rows[a][1], rows[b][1]) / np.linalg.norm(rows[a][1]) / np.linalg.norm(rows[b][1]) >= cosine]
    n = [0] * len(rows)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    top, least = cases.roots(len(rows), links), {}
    for k, t in enumerate(top):
        if rows[k][0] is not None:
            least[t] = min(least.get(t, rows[k][0]), rows[k][0])
    return sorted(((rows[k][0], n[k], least[top[k]] if rows[k][0] is not None else None) for k in range(len(rows))), key=str)


def points():
    """Random points, clusters of several widths, and one of near copies that holds a third of all."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 8))
    v = base[rng.integers(0, 12, 160)] + rng.normal(size=(160, 8)) * rng.choice([0.0, 0.05, 0.25], (160, 1))
    rows = [(int(i), [float(np.float32(y)) for y in x], int(i) % 3) for i, x in enumerate(v)]
    near = base[0] + rng.normal(size=(90, 8)) * 0.03
    return rows + [(1000 + i, [float(np.float32(y)) for y in x], 1) for i, x in enumerate(near)]


@pytest.mark.parametrize("options", [{}, {"leaf": 12, "fanout": 3}, {"leaf": 5, "fanout": 8}])
def test_embeddings(spark, options):
    rows = points()
    rows += [(500, None, 0), (501, [0.0] * 8, 0), (502, [float("nan")] * 8, 0), (503, rows[0][1], None), (504, [1.0, None], 0), (505, [1.0, 2.0], 0), (506, [2.0, 4.0], 0), (507, [], 0), (None, rows[0][1], 0), (0, rows[0][1], 0), (508, [float("inf")] + [0.0] * 7, 0)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id bigint, embedding array<float>, label int, id int, node string, n int")
    assert sorted((tuple(r) for r in emb.near_links(df, **options).collect()), key=str) == brute_links(rows)
    assert emb.near_links(df.limit(0)).collect() == []


@pytest.mark.parametrize("leaf", [2048, 9])
def test_embeddings_on_the_table(spark, monkeypatch, leaf):
    monkeypatch.setattr(emb.near_links, "__defaults__", (*emb.near_links.__defaults__[:-2], leaf, 4))
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = QUERIES["op9_embedding_dedup"](spark, DATA).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == brute_links(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_node_pairs_are_pruned(spark):
    """Clusters far from each other: most pairs of nodes go by their radii, and the wide cluster of near copies is one tight node."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(30, 16))
    v = np.repeat(base, 40, 0) + rng.normal(size=(1200, 16)) * 0.02
    p = spark.createDataFrame([(i, i, 1, [float(y) for y in x], "a:16") for i, x in enumerate(v)], "key bigint, id bigint, n bigint, embedding array<double>, node string")
    leaves, levels = emb._levels(p, 50, 8, float(np.sqrt(2 - 2 * 0.93)))
    pairs = emb.node_pairs(p.select("node").distinct(), levels, 0.93).groupBy("kind").count().collect()
    n = {r["kind"]: r["count"] for r in pairs}
    assert leaves.count() == 1200 and leaves.select("node").distinct().count() >= 25
    assert n[0] > 3 * (n.get(1, 0) + n.get(2, 0)), n


def test_cover_tree_finds_all_pairs():
    rng = np.random.default_rng(5)
    x = emb.unit(rng.normal(size=(8, 6))[rng.integers(0, 8, 700)] + rng.normal(size=(700, 6)) * 0.15)
    n = rng.integers(1, 4, 700)
    hit = x @ x.T >= 0.93
    np.fill_diagonal(hit, False)
    order, tree = emb.grow(x)
    assert sorted(order.tolist()) == list(range(700)) and len(tree) > 8
    for t in tree:  # each node covers its points
        assert emb.apart(x[order[t["lo"] : t["hi"]]], x[order[t["lo"]]][None]).max() <= t["radius"] + 1e-6
    links = emb.Links(x[order], n[order], None, None, 0.93)
    links.traverse(tree, tree)
    assert (links.count == (hit[np.ix_(order, order)] * n[order]).sum(1)).all()
    want = cases.roots(700, [(int(i), int(j)) for i, j in zip(*np.nonzero(hit[np.ix_(order, order)]))])
    assert links.roots().tolist() == want
    (o1, t1), (o2, t2) = emb.grow(x[:300]), emb.grow(x[300:])
    links = emb.Links(x[:300][o1], n[:300][o1], x[300:][o2], n[300:][o2], 0.93)
    links.traverse(t1, t2)
    cross = hit[:300, 300:][np.ix_(o1, o2)]
    assert links.count.tolist() == [*(cross * n[300:][o2]).sum(1).tolist(), *(cross.T * n[:300][o1]).sum(1).tolist()]


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (9, 8), (7, 9), (2, 5), (1, 1)] + [(i, i + 1) for i in range(100, 160)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {2: 2, 3: 2, 4: 2, 5: 2, 7: 7, 8: 7, 9: 7} | {i: 100 for i in range(100, 161)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("split, ranges", [(700, True), (1 << 24, None), (700, False)])
def test_warc(spark, tmp_path, split, ranges):
    big, other = "<p>é</p>" * 300, "WARC/1.1\r\n\r\n\x1f" * 200
    rows = [(1, "http://a/", big), (2, "http://b/ \r\nX: y", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (None, "u", big), (7, "u", other), (7, "u", other), (8, "u", "x" * 200_000), (9, "u", "".join(map(str, range(500_000))))]
    write_archive(spark.createDataFrame([(*r, 1, "s") for r in rows], "page_id bigint, url string, html string, size int, digest string").repartition(3), str(tmp_path / "w"))
    for f in (tmp_path / "w").glob("part-*"):
        whole = f.read_bytes()
        assert not whole or gzip.decompress(whole).count(b"WARC/1.1\r\nWARC-Type: ") >= 1  # each file is one valid gzip stream
    got = read_archive(spark, str(tmp_path / "w"), split_bytes=split, ranges=ranges).collect()
    first = {big: 2, other: 7}
    want = []
    for i, _, h in rows:
        h = h or ""
        revisit = h in first and i != first[h]
        want.append((i, len(h.encode()), hashlib.sha1(h.encode()).hexdigest(), "revisit" if revisit else "response", first[h] if revisit else None, None if revisit else h.encode()))
    assert sorted(((r["record_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got), key=str) == sorted(want, key=str)
    assert next(r for r in got if r["record_id"] == 1)["record_type"] == "revisit" and {r["target_uri"] for r in got if r["record_id"] == 3} == {None}


def test_warc_of_nothing(spark, tmp_path):
    write_archive(spark.createDataFrame([], "page_id bigint, url string, html string"), str(tmp_path / "w"))
    assert read_archive(spark, str(tmp_path / "w")).collect() == []


def test_pipeline_stages(spark):
    """Each stage on its predecessor's rows, against what its operator's brute force says."""
    from .test_text_operators import brute_contamination, jaccard_components

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    columns = docs.columns
    text = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())
    (n1, quality), (n2, near), (n3, passages), (n4, clean), (n5, pack) = corpus_pipeline.STAGES
    one = quality(spark, docs, DATA).cache()
    kept = {i for i, _ in text(one)}
    assert one.columns == columns and np.mean([labels[i] == (i in kept) for i in labels]) > 0.9
    two = near(spark, one, DATA).cache()
    assert two.columns == columns and {i for i, _ in text(two)} == {i for i, _, c in jaccard_components(text(one)) if c == i}
    three = passages(spark, two, DATA).cache()
    before, after = dict(text(two)), dict(text(three))
    assert three.columns == columns and set(before) == set(after) and all(len(after[i]) <= len(before[i]) for i in after)
    assert [r["n_chars"] == len(r["text"]) for r in three.collect() if after[r["doc_id"]] != before[r["doc_id"]]].count(False) == 0
    four = clean(spark, three, DATA).cache()
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    want = {i for i, n, hit, _ in brute_contamination(text(three), items) if not (hit and 20 * hit >= n)}
    assert four.columns == columns and {i for i, _ in text(four)} == want
    check_packing(text(four), pack(spark, four, DATA).collect(), 2048)


def test_pipeline_decides_by_row(spark):
    """One id with two texts, and rows without id: each row is judged by its own text."""
    p = [cases.prose(90, 500 + i) for i in range(7)]
    rows = [(1, p[0]), (2, p[0]), (2, p[1]), (None, p[0]), (None, p[2]), (None, p[2]), (3, p[2] + " x"), (4, p[3]), (4, p[3]), (None, p[4]), (None, p[4]), (None, ""), (None, None), (5, ""), (5, p[5]), (6, None)]
    d = cases.docs(spark, rows)
    stages = dict(corpus_pipeline.STAGES)
    out = stages["n-gram join"](spark, d, DATA)
    order = lambda rows: sorted(rows, key=repr)
    assert out.columns == d.columns
    assert order((r["doc_id"], r["text"]) for r in out.collect()) == order([(1, p[0]), (2, p[1]), (3, p[2] + " x"), (4, p[3]), (None, p[4]), (None, ""), (None, None), (5, ""), (5, p[5]), (6, None)])
    # rows of one id and rows without id, with and without a benchmark passage
    item = max((r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect() if r["text"]), key=lambda t: len(t.split()))
    bad = p[6] + " " + item
    rows = [(1, bad), (1, p[0]), (None, bad), (None, p[1]), (2, None), (None, ""), (3, "one")]
    out = stages["decontamination"](spark, cases.docs(spark, rows), DATA)
    assert out.columns == d.columns
    assert order((r["doc_id"], r["text"]) for r in out.collect()) == order([(1, p[0]), (None, p[1]), (2, None), (None, ""), (3, "one")])
    one = out.filter("doc_id = 3").first()  # the other columns stay with their rows
    assert (one["score"], one["hit"], one["items"], one["row"], one["spans"]) == (0.5, 5, "i", "r", "s")


def test_pipeline_edges(spark):
    d = cases.docs(spark).withColumn("n_chars", F.length("text"))
    for name, stage in corpus_pipeline.STAGES:
        if name == corpus_pipeline.STAGES[0][0]:  # it learns from labelled documents: these too
            mine = spark.read.parquet(f"{DATA}/documents.parquet")
            mine = mine.withColumns({c: F.lit(None).cast(k) for c, k in d.dtypes if c not in ("doc_id", "text", "n_chars")}).select(*d.columns).unionByName(d.withColumn("doc_id", F.col("doc_id") + 100_000))
            assert stage(spark, mine, DATA).columns == d.columns
            continue
        out = stage(spark, d, DATA)
        if name == corpus_pipeline.STAGES[-1][0]:
            assert out.count() >= d.count() and stage(spark, d.limit(0), DATA).count() == 0
            continue
        assert out.columns == d.columns and out.count() > 0, name
        assert stage(spark, d.limit(0), DATA).count() == 0, name


def test_each_word_is_looked_up_once():
    """Of texts taken together only different words go to the cache, and the ids are those of the whole texts."""
    import random

    import public_tokenizers

    from cirrolite.llm.packing import WordTokens

    class Counting(dict):
        looked = 0

        def get(self, *a):
            self.looked += 1
            return super().get(*a)

    tokens = WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    tokens.cache = Counting()
    texts = [cases.prose(200, 1) + ", " + cases.prose(100, 2) + "."] * 50
    assert tokens(texts) == tokens.whole(texts) and tokens.cache.looked <= len(set(texts[0].split())) + 2
    r = random.Random(5)
    some = ["a", "B", "é", "3", ",", ".", "..", "?,", "'s", "don't,", " ", "\n", " ", "　", "\x85", "\x1c", "<|", "—", "x.", "é", "Σ", "İ", "日本", "٣.", "²,", "\x00", "\U0001f600."]
    texts = ["", " ", ",", "a,", *("".join(r.choice(some) for _ in range(r.randrange(14))) for _ in range(3000))]
    assert tokens(texts) == tokens.whole(texts) and tokens([]) == []
