"""Operators on documents against brute force, with edge cases."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cirrolite.llm import contamination as con
from cirrolite.llm import packing, quality
from cirrolite.llm.ngram_join import ngram_components
from cirrolite.llm.passages import cut_passages
from cirrolite.llm.queries import QUERIES
from cirrolite.llm.suffix_dedup import previous_factors, remove_repeats

from ..conftest import DATA
from . import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def kept_bytes(rows, length=50):
    """rows: (id, text), ids not null. What is left of each, by brute force over all windows."""
    owner = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            owner[w] = min(i, owner.get(w, i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if owner[b[k : k + length]] < i:
                gone[k : k + length] = True
        left = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out)


def runs():
    """Runs of one byte, lines that repeat with every period, and copies that begin anywhere in them."""
    line = cases.prose(12, 77)
    rows = [(300, " " * 3000 + "x" + "-" * 900), (301, "y" + " " * 5000), (302, "ab" * 400 + "!" + "ab" * 30), (303, "b" + "ab" * 200), (304, (line + "\n") * 60), (305, "q" + (line + "\n") * 9 + cases.prose(30, 3)), (306, line[5:] + line + line), (307, "-" * 50), (308, "-" * 49)]
    return rows + [(310 + k, ("0123456789abcdefghijklmnopqrstuvwxyz!?"[:k] * 80) + str(k)) for k in range(1, 38, 4)] + [(360 + k, "z" + ("0123456789abcdefghijklmnopqrstuvwxyz!?"[:k] * 9)) for k in range(1, 38, 4)]


@pytest.mark.parametrize("most_bytes", [8 << 20, 0])
def test_suffix_dedup(spark, monkeypatch, most_bytes):
    from cirrolite.llm import common

    monkeypatch.setattr(common.small, "__defaults__", (16, most_bytes))
    rows = cases.texts() + runs()
    got = remove_repeats(cases.docs(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    want = kept_bytes([r for r in rows if r[0] is not None])
    assert sorted(tuple(r) for r in got if r["doc_id"] is not None) == want
    assert sorted((r["n_bytes"], r["n_removed"]) for r in got if r["doc_id"] is None) == sorted([(0, 0), (len(cases.texts()[19][1].encode()), 0)])
    for length in (31, 272):
        with pytest.raises(ValueError):
            remove_repeats(cases.docs(spark), length=length)


@pytest.mark.parametrize("length", [32, 120])
def test_suffix_dedup_lengths(spark, length):
    rows = [r for r in cases.texts() if r[0] is not None] + runs()
    got = remove_repeats(cases.docs(spark, rows), length=length).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == kept_bytes(rows, length)


def test_suffix_dedup_of_long_texts(spark):
    """Texts of several blocks: a shared passage across a block's edge, a long run."""
    a, b = cases.prose(190_000, 41), cases.prose(30_000, 42)
    edge = 1 << 20
    rows = [(1, a), (2, b[:70_000] + a[edge - 3000 : edge + 3000] + " " * 100_000), (3, " " * 100_000 + a[5:900])]
    assert len(a.encode()) > edge + 4000
    got = remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == kept_bytes(rows)


def test_suffix_dedup_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in QUERIES["op1_suffix_dedup"](spark, DATA).collect()) == kept_bytes(rows)
    assert remove_repeats(cases.docs(spark, [])).collect() == []


def several_texts():
    """Ids with more than one text, null ids among them."""
    a, b, c = cases.prose(150, 61), cases.prose(150, 62), cases.prose(150, 63)
    return [(1, a), (2, a), (2, b), (3, a + " " + c), (3, c), (3, b[:400] + " x"), (4, b), (4, b), (5, c[9:] + a), (None, a), (None, b), (5, "")]


@pytest.mark.parametrize("most_bytes", [8 << 20, 0])
def test_one_id_with_several_texts(spark, monkeypatch, most_bytes):
    from cirrolite.llm import common

    monkeypatch.setattr(common.tagged, "__defaults__", (most_bytes,))
    rows = several_texts()
    got = remove_repeats(cases.docs(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(tuple(r) for r in got if r["doc_id"] is not None) == kept_bytes([r for r in rows if r[0] is not None])
    assert all(r["n_removed"] == 0 for r in got if r["doc_id"] is None)
    cut = cut_passages(cases.docs(spark, rows))
    left = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in cut.filter("doc_id is not null").collect())
    by_id = {i: sorted(n for d, _, n in left if d == i) for i in range(1, 6)}
    assert by_id[1] == [0] and by_id[2] == [0, 150] and by_id[4] == [150, 150] and by_id[5][0] == 0 and by_id[5][1] >= 295
    assert by_id[3][0] == 0 and by_id[3][1] >= 50 and by_id[3][2] >= 150 and sum(by_id[3]) < 230
    assert cut.filter("doc_id is null and n_removed > 0").isEmpty()


def test_previous_factors():
    rng = np.random.default_rng(1)
    s, doc = rng.integers(97, 99, (60, 8)).astype(np.uint8), rng.integers(0, 5, 60)
    want = [max([0, *(next((k for k in range(8) if s[i, k] != s[j, k]), 8) for j in range(60) if doc[j] < doc[i])]) for i in range(60)]
    assert previous_factors(s, doc, 8).tolist() == want


def shingles(t):
    w = WORD.findall(lower(t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard_components(rows):
    sets = [shingles(t) for _, t in rows]
    by = defaultdict(list)
    links = []
    for k, s in enumerate(sets):
        meet = defaultdict(int)
        for x in s:
            for y in by[x]:
                meet[y] += 1
            by[x].append(k)
        links += [(y, k) for y, n in meet.items() if 100 * n >= 75 * (len(s) + len(sets[y]) - n)]
    top = cases.roots(len(rows), links)
    least = {}
    for k, t in enumerate(top):
        if rows[k][0] is not None:
            least[t] = min(least.get(t, rows[k][0]), rows[k][0])
    return sorted((i, len(sets[k]), least[top[k]]) for k, (i, _) in enumerate(rows) if i is not None)


@pytest.mark.parametrize("options", [{}, {"tile": 2}])
def test_ngram_join(spark, options):
    rows = cases.texts() + [(100 + i, " ".join([cases.prose(60, 1), cases.prose(3, i)])) for i in range(40)] + [(200 + i, cases.prose(60, 2) + " " + cases.prose(90, 50 + i)) for i in range(30)]
    rows = [r for r in rows if r != (None, None)]
    got = ngram_components(cases.docs(spark, rows), **options).collect()
    assert sorted(tuple(r) for r in got if r["doc_id"] is not None) == jaccard_components(rows)
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]


def test_ngram_join_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op5_ngram_join"](spark, DATA).collect())) == jaccard_components(rows)
    assert ngram_components(cases.docs(spark, [])).collect() == []


def test_passages(spark):
    shared, tail = cases.prose(60, 900), cases.prose(200, 901)
    words = shared.split()
    near = words[:30] + ["other"] + words[31:]
    rows = [(1, cases.prose(80, 1) + " " + shared + " " + cases.prose(80, 2)), (2, cases.prose(90, 3) + " " + shared), (3, " ".join(near) + " " + cases.prose(50, 4)), (4, cases.prose(300, 5)), (5, " ".join(words[:45]) + " " + cases.prose(100, 6)), (6, tail), (7, "".join(c.upper() if c.isascii() else c for c in tail)), (8, cases.prose(40, 7)), (9, cases.prose(40, 7))]
    got = {r["doc_id"]: r for r in cut_passages(cases.docs(spark, rows)).collect()}
    assert {i for i, r in got.items() if r["n_removed"]} == {2, 3, 7}
    assert got[2]["n_removed"] >= 60 and shared not in got[2]["text"] and got[2]["text"].startswith(cases.prose(90, 3)[:200])
    assert 50 <= got[3]["n_removed"] <= 70 and got[7]["text"] == "" and got[7]["n_removed"] == 200
    for r in got.values():
        assert r["n_words"] - r["n_removed"] == len(r["text"].split()) and r["host"] == "h"
    text = dict(rows)[2]
    assert "".join(text[s["start"] : s["end"]] for s in got[2]["removed_spans"]) == shared


def test_passages_edges(spark):
    got = cut_passages(cases.docs(spark)).collect()
    assert len(got) == len(cases.texts())
    by = {r["doc_id"]: r for r in got}
    assert by[8]["text"] is None and by[7]["text"] == "" and by[1]["n_removed"] == 0 and by[2]["n_removed"] == 120 and by[12]["n_removed"] == 0
    assert by[6]["n_removed"] >= 66 and by[16]["n_removed"] >= 5990 and by[15]["n_removed"] == 0
    assert cut_passages(cases.docs(spark, [])).collect() == []


def test_passages_on_the_table(spark):
    """Every exact repeat of over 50 words goes, but for words at its ends that are equal by chance; documents that share none are left alone."""
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    got = {r["doc_id"]: r for r in QUERIES["op8_substring_dedup"](spark, DATA).collect()}
    first, least, common = {}, 0, {}
    for i, t in rows:
        w = lower(t or "").split()
        hit = np.zeros(len(w), bool)
        for k in range(len(w) - 51):
            x = tuple(w[k : k + 52])
            if first.setdefault(x, i) < i:
                hit[k : k + 52] = True
        least += int(hit.sum())
        common[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    assert sum(r["n_removed"] for r in got.values()) >= 0.97 * least
    for i, _ in rows:
        if got[i]["n_removed"] and i:
            assert max(len(common[i] & common[j]) for j, _ in rows if j < i) >= 0.75 * 46


def brute_contamination(rows, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))

    out = []
    for i, t in rows:
        w, hit, ids = words(t), set(), set()
        for item, q in items:
            q = words(q)
            k = min(13, len(q))
            for s in range(len(q) - k + 1 if k else 0):
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == q[s : s + k]:
                        hit |= set(range(p, p + k))
                        ids.add(item)
        out.append((i, len(w), len(hit), sorted(str(x) for x in ids if x is not None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [1 << 20, 60])
def test_contamination(spark, limit):
    items = [(1, cases.prose(20, 1)), (2, "Short Question?"), (3, None), (4, ""), (5, "..."), (None, "null id"), (6, cases.prose(20, 1))]
    rows = [(1, cases.prose(40, 8) + " " + cases.prose(20, 1).upper().replace(" ", ", ")), (2, "a short question é here"), (3, None), (4, ""), (5, "short-question short question"), (6, cases.prose(300, 9)), (6, "null id"), (None, "short question")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = con.contamination(cases.docs(spark, rows), bench, automaton_bytes=limit).collect()
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got], key=str) == brute_contamination(rows, items)
    r = next(r for r in got if r["doc_id"] == 2)
    assert [rows[1][1][s["start"] : s["end"]] for s in r["spans"]] == ["short question"]
    assert con.contamination(cases.docs(spark, []), bench).collect() == [] and con.contamination(cases.docs(spark), bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_quality(spark):
    sf = DATA.replace("0.001", "0.01")
    got = QUERIES["op2_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 50 and (held.predicted == held.quality).mean() >= 0.92 and got.score.between(0, 1).all()
    rank, good = held.score.rank(), held.quality == 1
    assert (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum()) >= 0.97


def labelled(spark):
    rows = [(k, cases.prose(40 + k, k) if k % 2 else "Buy cheap now!! " * (5 + k)) for k in range(40)]
    labels = [(k, k % 2) for k in range(40)] + [(3, 1), (5, 0), (12, None), (None, 1), (7, 9)]
    return cases.docs(spark, [*rows, (9, "zz"), (9, rows[9][1]), (100, None), (101, ""), (None, "x"), (102, cases.prose(9000, 4))]), spark.createDataFrame(labels, "doc_id bigint, quality int"), rows


def test_quality_edges(spark):
    d, labels, rows = labelled(spark)
    m = quality.fit_quality(labels, d)
    got = quality.quality_scores(d, m).collect()
    by = {r["doc_id"]: r["score"] for r in got}
    assert len(got) == d.count() and all(0 <= r["score"] <= 1 for r in got) and by[100] == by[101]
    assert by[1] > 0.5 > by[0] and quality.fit_quality(labels, d.orderBy("text")) == m  # the same model whatever the order of rows
    assert quality.quality_scores(d.limit(0), m).collect() == [] and quality.keep_good(d, m, least=0.0).columns == d.columns
    with pytest.raises(ValueError):
        quality.fit_quality(labels.limit(5), d)
    with pytest.raises(ValueError):
        quality.fit_quality(labels.limit(0), d)


def test_quality_scores_by_plain_python(spark):
    """Compressed sizes from zstandard's plain interface, and the logistic formula by hand."""
    import zstandard

    d, labels, _ = labelled(spark)
    m = quality.fit_quality(labels, d)
    packs = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(x), write_checksum=False, write_content_size=False, write_dict_id=False) for x in (m.good, m.bad)]
    for r in d.join(quality.quality_scores(d, m).withColumnRenamed("score", "got"), "doc_id").filter("length(text) > 0").collect():
        t = r["text"].encode()
        parts = [t[i : i + 1024] for i in range(0, len(t), 1024)]
        diff = [len(packs[1].compress(p)) - len(packs[0].compress(p)) for p in parts]
        rel = [x / (len(p) + 300) for x, p in zip(diff, parts)]
        f = [sum(diff) / (len(t) + 100), sum(diff) / (len(t) + 600), min(rel), max(rel), 100 / (len(t) + 100), 300 / (len(t) + 300)]
        z = sum(w * x for w, x in zip(m.weights, f)) + m.weights[-1]
        if r["doc_id"] != 9:
            assert abs(1 / (1 + np.exp(-max(-30, min(30, z)))) - r["got"]) < 1e-9


TOKENS = None


def ids_of(text):
    global TOKENS
    if TOKENS is None:
        import public_tokenizers
        from tokenizers import Tokenizer

        TOKENS = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return np.array(TOKENS.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def check_packing(rows, got, capacity):
    text = defaultdict(list)
    for i, t in rows:
        text[i].append(ids_of(t))
    pieces, filled = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, versions in text.items():
        ps = sorted(pieces[i], key=lambda r: r["start"])
        assert sum(r["length"] for r in ps) == sum(map(len, versions))
        if len(versions) == 1:
            at = 0
            for r in ps:
                assert r["start"] == at and r["doc_tokens"] == len(versions[0]) and r["ids_crc32"] == zlib.crc32(versions[0][at : at + r["length"]].tobytes())
                at += r["length"]
    for places in filled.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= capacity


def test_packing(spark):
    import public_tokenizers

    rows = cases.texts() + [(30, "It's, the.. don't <|endoftext|> \x1c x"), (31, "ΣΑΣ İ, é. \u0065\u0301")]
    p = packing.token_pieces(cases.docs(spark, rows), public_tokenizers.path("word_bpe_49k.json"), capacity=512, with_ids=True).cache()
    got = packing.pack(p, capacity=512, group_rows=10).collect()
    check_packing(rows, got, 512)
    for r in got:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        assert r["padded_tokens"] == 512 or r["padded_tokens"] == r["sequence_tokens"]
    assert packing.pack(packing.token_pieces(cases.docs(spark, []), public_tokenizers.path("word_bpe_49k.json"))).collect() == []


def test_packing_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op6_packing"](spark, DATA).collect()
    check_packing(rows, got, 2048)
    padded = {r["sequence_id"]: r["padded_tokens"] for r in got}
    assert sum(r["length"] for r in got) / sum(padded.values()) > 0.95


def test_vector_limits():
    rng = np.random.default_rng(0)
    sizes = np.stack([rng.integers(1, 900, 500), np.ones(500, int), rng.integers(0, 300, 500)], 1)
    sizes[:, 2] = np.minimum(sizes[:, 2], sizes[:, 0])
    limits = np.array([1000, 4, 350])
    bins, place = packing.fill(sizes, limits)
    for b in range(bins.max() + 1):
        assert (sizes[bins == b].sum(0) <= limits).all() and sorted(place[bins == b]) == list(range((bins == b).sum()))
