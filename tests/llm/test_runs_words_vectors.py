"""Periodic runs, spelling variants and top-k search against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cirrolite.llm import periodic_runs as pr
from cirrolite.llm import spelling as sp
from cirrolite.llm import top_k as tk
from cirrolite.llm.queries import QUERIES

from ..conftest import DATA
from . import cases

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- periodic runs ----


def brute_runs(w, least=6):
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j - i >= 3 * q:
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items() if e - s >= max(least, 4 * q))


def kept(w, runs):
    return [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)]


def periodic(seed):
    r = random.Random(seed)
    n, letters = r.choice([0, 1, 5, 6, 7, 20, 50, 100, 300]), r.choice([1, 2, 2, 3, 50])
    w = [str(r.randrange(letters)) for _ in range(n)]
    for _ in range(r.randint(0, 3) if n > 8 else 0):
        a = r.randrange(n)
        p = 1 + r.randrange(max(1, (n - a) // 3))
        for i in range(a, min(n, a + p * r.randint(2, 9))):
            w[i] = w[a + (i - a) % p]
    kind = r.random()
    if kind < 0.15:  # runs within runs
        w = ((["x", "y"] * r.randint(2, 12) + ["z"]) * 20)[:n]
    elif kind < 0.25:  # Fibonacci words
        a, b = ["a"], ["b"]
        while len(a) < n:
            a, b = a + b, a
        w = a[:n]
    elif kind < 0.3:  # Thue-Morse words have no cubes
        w = [str(i.bit_count() % 2) for i in range(n)]
    return w


def test_runs_by_brute_force():
    for at in range(0, 2400, 12):
        texts = [periodic(k) for k in range(at, at + 12)]
        found = pr.runs_of_texts([[x.encode() for x in w] for w in texts], 6)
        for w, got in zip(texts, found):
            assert [tuple(r) for r in got.tolist()] == brute_runs(w)


def test_selected_positions_are_few_and_consistent():
    r = np.random.default_rng(3)
    words = r.integers(0, 1000, 20_000)
    words[12_000:13_000] = words[2_000:3_000]
    names = pr.mix(words.astype(np.uint64))
    for half in (1, 2, 4, 8, 16):
        names = pr.joined_names(names, half)
    at = pr.selected(names, 32)
    assert np.diff(at).max() <= 32 and len(at) < 20_000 / 8
    inner = at[(at >= 2_031) & (at < 2_930)]
    assert np.array_equal(inner + 10_000, at[(at >= 12_031) & (at < 12_930)])  # the same words, the same positions


def test_periodic_runs_of_all_kinds_of_rows(spark):
    many = ("a b c d " * 20_000) + "e " * 30_000
    rows = [*cases.texts(), (30, many), (31, "x " * 5), (32, "x " * 6), (33, "A a A a A a A a"), (34, "q\tq\nq\x0bq\x0cq\rq"), (35, "é é " * 7), (36, "u v " * 4)]
    got = pr.periodic_runs(cases.docs(spark, rows)).collect()
    want = []
    for i, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", t or "") if x]
        runs = brute_runs(w) if len(w) < 5000 else ([(0, 80_000, 4), (80_000, 30_000, 1)] if i == 30 else [])
        want.append((i, len(w), runs, " ".join(w[:4] + ["e"] if i == 30 else kept(w, runs))))
    assert sorted([(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got], key=str) == sorted(want, key=str)
    assert pr.periodic_runs(cases.docs(spark, [])).collect() == []


def test_op11_by_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in QUERIES["op11_periodic_runs"](spark, DATA).collect()}
    seen = 0
    for d in docs:
        w = [x for x in re.split("[\x20\x09-\x0d]+", d["text"] or "") if x]
        h = zlib.crc32(str(d["doc_id"]).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = brute_runs(w)
        best = max(runs, key=lambda r: ((r[1] << 64) // r[2], -r[0], -r[2]), default=None)
        r = got[d["doc_id"]]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *(best or (None,) * 3))
        assert r["exponent_milli"] == (best and 1000 * best[1] // best[2])
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(kept(w, runs)).encode()).hexdigest()
        seen += bool(runs)
    assert len(got) == len(docs) and seen > 5


# ---- spelling variants ----


def brute_words(rows):
    found = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(UP)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += len(run) >= 7
    return {w: n for w, n in found.items() if n >= 2}


def brute_variants(words):
    gaps = {}
    for w in words:  # words one replaced letter apart share a pattern with a gap; one inserted letter apart, the shorter one is the longer one without a letter
        for i in range(len(w)):
            gaps.setdefault((w[:i], w[i + 1 :]), []).append(w)
    near = {w: set() for w in words}
    for some in gaps.values():
        for a in some:
            near[a] |= set(some) - {a}
    for w in words:
        for i in range(len(w)):
            if (s := w[:i] + w[i + 1 :]) in words:
                near[w].add(s)
                near[s].add(w)
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("sizes", [{}, {"cell": 40}, {"cell": 5, "sample": 60}])
def test_spelling_variants_by_brute_force(spark, sizes):
    r = random.Random(7)
    words = {}
    for _ in range(60):
        w = "".join(r.choice("aabcé") for _ in range(r.choice([7, 7, 8, 9, 12])))
        words[w] = r.choice([2, 5, 40, 400])
        for _ in range(6):
            k, c = r.randrange(len(w)), r.choice("abÿ")
            v = r.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :], "".join(r.sample(w, len(w)))])
            words.setdefault(v, r.choice([2, 3, 4, 30, 4000]))
    words["a" * 3000], words["a" * 2999], words["a" * 2999 + "b"] = 2, 20, 2
    got = rows_of(sp.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n bigint"), **sizes))
    assert got == brute_variants(words) and sum(x[1] is not None for x in got) > 20


def test_words_with_equal_letters_are_dealt_in_tiles(spark):
    """All words have the same letters, or one other: no box can tell them apart."""
    r = random.Random(1)
    words = {"".join(r.sample("aabbccdd", 8)): 2 for _ in range(300)}
    words |= {w[:3] + "e" + w[4:]: 50 for w in list(words)[:100]}
    got = rows_of(sp.spelling_variants(spark.createDataFrame(list(words.items()), "word string, n bigint"), cell=20, sample=50))
    assert got == brute_variants(words)


def test_op12_by_brute_force(spark):
    rows = [(d["doc_id"], d["text"]) for d in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = rows_of(QUERIES["op12_spelling_variants"](spark, DATA))
    assert got == brute_variants(brute_words(rows)) and len(got) > 500


def test_words_of_all_kinds_of_rows(spark):
    rows = [*cases.texts(), (40, "Déjàvus déjàvus DÉJÀVUS x×÷ÿabcde ×÷ÿabcde"), (41, "Übergrößen über-größen ÜBERGRÖSSEN naïveté"), (41, "Übergrößen ÿÿÿÿÿÿÿ ÿÿÿÿÿÿÿ"), (42, "abcdefg1abcdefg日abcdefg")]
    got = {r["word"]: r["n"] for r in sp.varied_words(cases.docs(spark, rows)).collect()}
    assert got == brute_words(rows)
    assert rows_of(sp.spelling_variants(sp.varied_words(cases.docs(spark, rows)))) == brute_variants(got)
    assert sp.spelling_variants(sp.varied_words(cases.docs(spark, []))).collect() == []


# ---- top k ----


def brute_top(rows, asks, k=5, scale=256.0):
    able = [(i, np.floor(scale * np.array(v, np.float64)).astype(int).tolist()) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(able):
        if asks(i):
            found = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(able) if a != b and len(v) == len(q))
            out += [(i, n, j, -s) for n, (s, j) in enumerate(found[:k], 1)]
    return sorted(out)


def hits_of(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("sizes", [{}, {"block": 20, "pivots": 6, "sample": 50}, {"block": 7, "pivots": 1}])
def test_top_k_by_brute_force(spark, sizes):
    r = np.random.default_rng(4)
    centres = r.normal(size=(9, 12))
    rows = [(n, (centres[n % 9] * r.choice([0.5, 1, 2]) + 0.05 * r.normal(size=12)).tolist()) for n in range(250)]
    rows += [(300 + n, rows[3][1]) for n in range(60)] + [(5, rows[5][1]), (10, rows[6][1]), (-50, rows[7][1])]  # copies, repeated ids
    rows += [(400, None), (450, [None] + [0.5] * 11), (500, [float("nan")] * 12), (550, [float("inf")] * 12), (600, [0.0] * 12), (650, [1.0, -2.0]), (651, [0.1, 0.2]), (700, []), (701, []), (750, [1.0] * 3), (None, [1.0] * 12), (800, [3e5] * 12), (801, [-3e5] * 12)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({"label": F.lit(1), "id": F.lit("x"), "e": F.lit(2), "n": F.lit(0), "score": F.lit(0)})
    assert hits_of(tk.top_k(table, F.col("vec_id") % 50 == 0, **sizes)) == brute_top(rows, lambda i: i % 50 == 0)


def test_top_k_of_few_rows(spark):
    table = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [0.5, 0.1])], "vec_id bigint, embedding array<float>")
    assert hits_of(tk.top_k(table, F.col("vec_id") == 0)) == [(0, 1, 1, 327680), (0, 2, 2, 45568 - 45568 + 128 * 256 + 512 * 25)]
    assert tk.top_k(table.limit(0), F.col("vec_id") == 0).collect() == [] and tk.top_k(table, F.col("vec_id") == 9).collect() == []
    with pytest.raises(Exception, match="too long"):
        tk.top_k(spark.createDataFrame([(0, [1e15]), (1, [1.0])], "vec_id bigint, embedding array<double>"), F.col("vec_id") == 0).collect()


def test_bounds_leave_most_candidates_out():
    """Clusters apart: few scores are computed, and the result is that of all of them."""
    r = np.random.default_rng(5)
    x = tk.integers(np.repeat(r.normal(size=(20, 16)), 100, axis=0) + 0.02 * r.normal(size=(2000, 16)), 256.0)
    x[::2] = (x[::2] * (256 / np.sqrt((x[::2] ** 2).sum(1, keepdims=True)))).astype(np.int64)
    norms, pivots = (x * x).sum(1).astype(float), tk.chosen(x, 8)
    table, ids, looked = tk.pivot_table(x, tk.span(pivots)), np.arange(len(x)), 0
    for i in range(0, 2000, 40):
        best = tk.Best(5)
        looked += tk.search(best, x[i], table[i], norms[i], x, table, norms, ids, skip=i)
        score = x @ x[i]
        score[i] = -(2**62)
        assert best.id.tolist() == np.lexsort((ids, -score))[:5].tolist()
    assert looked < 50 * 2000 / 3


def test_bounds_hold_and_beat_single_pivots():
    r = np.random.default_rng(8)
    for dim, n in ((2, 5), (12, 6), (40, 30)):
        x = tk.integers(r.normal(size=(200, dim)) * r.choice([0.1, 1, 30], size=(200, 1)), 256.0)
        p = tk.chosen(x, n)
        table, norms = tk.pivot_table(x, tk.span(p)), (x * x).sum(1).astype(float)
        real, upper = x @ x.T, table @ table.T
        slack = tk.margin(np.maximum(norms[:, None], norms))
        assert (upper + slack >= real).all()
        away = tk.distances(x, p)
        lower = np.abs(away[:, None] - away).max(2)
        assert (upper <= (norms[:, None] + norms - lower**2) / 2 + slack).all()


def test_op13_by_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    assert hits_of(QUERIES["op13_top_k"](spark, DATA)) == brute_top(rows, lambda i: i % 50 == 0)
