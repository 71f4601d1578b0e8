"""Passages under hot keys."""

from __future__ import annotations

import random
import sys

import numpy as np
import pytest

from cirrolite.llm import passages as passages_module
from cirrolite.llm.passages import accepted, cut_passages, partners
from cirrolite.llm.shingles import batch_shingle_hashes, batch_word_hashes, shingle_hashes, word_hashes

from . import cases


def test_passage_of_two_common_lines(spark):
    """Each line occurs in ten earlier documents, both in a row in two documents only."""
    rows, later = [], []
    for v in range(40):
        one, two = cases.prose(26, 5000 + v), cases.prose(26, 6000 + v)
        for k in range(20):
            s = 10_000 + 100 * v + k
            rows.append((100 * v + k, f"{cases.prose(70, s)} {(one, two)[k % 2]} {cases.prose(70, s + 5000)}"))
        for k in (20, 21):
            s = 10_000 + 100 * v + k
            rows.append((100 * v + k, f"{cases.prose(70, s)} {one} {two} {cases.prose(70, s + 5000)}"))
        later.append(100 * v + 21)
    got = {r["doc_id"]: r["n_removed"] for r in cut_passages(cases.docs(spark, rows)).select("doc_id", "n_removed").collect()}
    assert {i for i, n in got.items() if n} == set(later)
    assert all(52 <= got[i] <= 56 for i in later)


def test_partners():
    """Every document gets an earlier one that has what any earlier one shares with it."""
    r = np.random.default_rng(1)
    base = r.integers(1, 1 << 32, 91, np.uint32)
    near = np.tile(base, (600, 1))
    for row in near:
        i, j = sorted(r.integers(0, 91, 2))
        row[:i] = r.integers(1, 1 << 32, i, np.uint32)
        row[j:] = r.integers(1, 1 << 32, 91 - j, np.uint32)
    doc = np.arange(600)
    got = {}
    for a, b in partners(np.zeros(600, np.uint64), doc, near, 23).tolist():
        got.setdefault(a, []).append(b)
    same = near == base
    for a in range(600):
        mine = [same[a] & same[b] for b in got.get(a, [])]
        for b in range(a):
            common = same[a] & same[b]
            assert common.sum() < 23 or any((common <= m).all() for m in mine), (a, b)
    assert sum(map(len, got.values())) < 600 * 40


def test_passage_beside_a_denser_stretch_that_fails():
    line, passage = cases.prose(10, 1), cases.prose(60, 2)
    later = " ".join([*[line] * 8, cases.prose(30, 3), passage])
    earlier = " ".join([*[line] * 3, cases.prose(30, 4), passage])
    a, b = (shingle_hashes(word_hashes(t.encode())) for t in (later, earlier))
    found = list(accepted(a, b, 46, 0.75))
    assert any(i <= 110 and j >= 166 for i, j in found) and all(j - i >= 46 for i, j in found)


def families(count: int, size: int, edits: int, words: int) -> list[tuple[int, str]]:
    """Families of documents that share a passage, each copy with edits of its own."""
    r, rows = random.Random(0), []
    for f in range(count):
        base = cases.prose(words, 100_000 + f).split()
        for k in range(size):
            w = list(base)
            for e in range(edits):
                w[r.randrange(words)] = f"edit{f}x{k}x{e}"
            i = f * size + k
            rows.append((i, f"{cases.prose(60, 10_000_000 + i)} {' '.join(w)} {cases.prose(60, 20_000_000 + i)}"))
    return rows


def near_by_brute_force(rows: list[tuple[int, str]], size: int, words: int, width: int = 46) -> set[int]:
    """Documents of which a stretch of at least 50 words lies at a similarity of 0.75 or more to the stretch at the same place of an earlier member."""
    grams = {i: [tuple(t.split()[60 + j : 65 + j]) for j in range(words - 4)] for i, t in rows}
    found = set()
    for i, _ in rows:
        for b in range(i // size * size, i):
            s = np.concatenate(([0], np.cumsum([x == y for x, y in zip(grams[i], grams[b])])))
            if any((m := (s[w:] - s[:-w]).max()) >= 0.75 * (2 * w - m) for w in range(width, len(s))):
                found.add(i)
                break
    return found


@pytest.mark.parametrize("count, size, edits, words, least", [(10, 30, 3, 100, 0.95), (10, 30, 1, 60, 0.95), (100, 2, 2, 80, 0.9)])
def test_recall_of_near_passages(spark, count, size, edits, words, least):
    rows = families(count, size, edits, words)
    want = near_by_brute_force(rows, size, words)
    got = {r["doc_id"]: r["n_removed"] for r in cut_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(want) > 50 and sum(got[i] >= 40 for i in want) >= least * len(want)
    assert not {i for i, n in got.items() if n} - want


def test_tiles_of_a_hot_key(monkeypatch):
    """A key that many documents share is marked with its number of tiles."""
    rows = families(1, 60, 2, 90)
    monkeypatch.setattr(passages_module, "TILE", 7)
    windows = [shingle_hashes(word_hashes(t.encode())) for _, t in rows]
    e = np.concatenate([np.array([(1, i, 0, len(w) // 2, 45, 45)], passages_module.ENTRY) for (i, _), w in zip(rows, windows)])
    keys = [b for b in passages_module._shared(iter([passages_module.pack(e, np.zeros(len(e), np.int64))]))]
    tiles = np.frombuffer(keys[0].column("keys")[0].as_py(), passages_module.KEY)["key"][0] >> np.uint64(48)
    assert tiles == 9


def changed(words: list[str], kind: str, count: int, r: random.Random, name: str) -> list[str]:
    w = list(words)
    for e in range(count):
        k = r.randrange(len(w))
        w[k : k + (kind != "insert")] = [] if kind == "delete" else [f"edit{name}x{e}"]
    return w


@pytest.mark.parametrize("words, count, kind", [(80, 2, "replace"), (120, 3, "insert"), (120, 3, "delete"), (300, 9, "replace")])
def test_words_of_near_passages_go(spark, words, count, kind):
    """Of passages that are near-duplicates as a whole nine in ten of the words go."""
    r, rows, want = random.Random(words), [], {}
    for f in range(100):
        base = cases.prose(words, 300_000 + f).split()
        one, two = base, changed(base, kind, count, r, str(f))
        rows += [(2 * f + k, f"{cases.prose(60, 400_000 + 2 * f + k)} {' '.join(w)} {cases.prose(60, 500_000 + 2 * f + k)}") for k, w in enumerate((one, two))]
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (one, two))
        if len(a & b) >= 0.75 * len(a | b):
            want[2 * f + 1] = len(two)
    got = {x["doc_id"]: x["n_removed"] for x in cut_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    share = sum(min(got[i], n) for i, n in want.items()) / sum(want.values())
    print(words, count, kind, len(want), round(share, 3), round(float(np.mean([got[i] >= 0.8 * n for i, n in want.items()])), 3))
    assert len(want) > 20 and share >= 0.9
    assert all(got[2 * f] == 0 for f in range(100)) and all(got[i] <= n + 8 for i, n in want.items())


def test_words_of_a_batch():
    """Hashes of a batch tell the same words apart, wherever they stand in it."""
    r = random.Random(3)
    some = ["a", "B", "b", " ", "\n", "\x0b", "\x1c", "é", "z", "\x85", "  "]
    texts = [None, b"", *("".join(r.choice(some) for _ in range(r.randrange(60))).encode() for _ in range(500)), b"x" * 70_000 + b" Y " + b"X" * 70_000 + b" y", b"q " * 100_000, b"w" * 65_536 + b" " + b"W" * 65_537]
    w, at = batch_word_hashes(texts)
    words = [(t or b"").lower().split() for t in texts]
    assert np.diff(at).tolist() == [len(x) for x in words]
    pairs = {(x, h) for i, x in enumerate(words) for x, h in zip(x, w[at[i] : at[i + 1]].tolist())}
    assert len(pairs) == len({x for x, _ in pairs}) == len({h for _, h in pairs})
    assert all(np.array_equal(x, shingle_hashes(w[at[i] : at[i + 1]])) for i, x in enumerate(batch_shingle_hashes(texts)))


def test_repeats_that_cannot_be_similar(monkeypatch):
    """Two texts of thousands of words in a circle, 26 of 31 shingles in common: below the threshold in every part, so the parts are not searched."""
    calls, real = [], passages_module.densest
    monkeypatch.setattr(passages_module, "densest", lambda *x: calls.append(1) or real(*x))
    a = np.tile(np.arange(31, dtype=np.uint64), 300)
    b = np.where(a < 26, a, a + np.uint64(100))
    assert list(accepted(a, b, 46, 0.75)) == [] and len(calls) < 50
    b = np.where(a < 27, a, a + np.uint64(100))  # 27 of 35
    assert sum(j - i for i, j in accepted(a, b, 46, 0.75)) > 0.9 * len(a)


def test_partners_of_one_text(monkeypatch):
    """What one partner has accepted is not searched again with the others, and together they cover what each of them has."""
    base = cases.prose(300, 1).split()
    others = [base, *(changed(base, kind, 4, random.Random(k), str(k)) for k, kind in enumerate(["replace", "insert", "delete"] * 6)), base[150:] + cases.prose(100, 2).split()]
    text = [" ".join(base + cases.prose(100, 2).split()), *map(" ".join, others)]
    texts = batch_shingle_hashes([t.encode() for t in text])
    pairs = [(0, k) for k in range(1, len(texts))]
    alone = np.concatenate([passages_module.passages(texts, [pair], 46, 3, 0.75)[0] for pair in pairs])
    calls, real = [], passages_module.accepted
    monkeypatch.setattr(passages_module, "accepted", lambda *x: calls.append(1) or real(*x))
    found = passages_module.passages(texts, pairs, 46, 3, 0.75)
    places = [{k for i, j in x.tolist() for k in range(i, j)} for x in (alone, np.concatenate(found))]
    assert places[0] == places[1] and len(places[0]) > 350
    assert len(calls) < 8


def windows_by_definition(text: list[int], width: int) -> set[tuple[int, int, int]]:
    """(l, c, r): from the nearest smaller or equal value before c to the nearest smaller one after it."""
    out = set()
    for c, v in enumerate(text):
        l, r = c, c
        while l and text[l - 1] > v:
            l -= 1
        while r + 1 < len(text) and text[r + 1] >= v:
            r += 1
        if r - l + 1 >= width:
            out.add((l, c, r))
    return out


def test_windows_of_repeated_lines():
    """Equal values on both sides, several texts at once, texts shorter than a window."""
    r = np.random.default_rng(5)
    line = r.integers(1, 1 << 63, 17, np.uint64)
    texts = [np.tile(line, 20), r.integers(1, 1 << 63, 200, np.uint64), line[:3], np.concatenate((np.tile(line[:5], 30), r.integers(1, 1 << 63, 60, np.uint64), np.tile(line, 4))), np.repeat(line[:1], 90)]
    w = passages_module.windows(texts, 12)
    for t, text in enumerate(texts):
        for f in range(passages_module.FUNCTIONS):
            some = (w["text"] == t) & (w["f"] == f)
            values = (passages_module.mix(text ^ passages_module.SEEDS[f]) | np.uint64(1)).tolist()
            assert set(zip(w["l"][some].tolist(), w["c"][some].tolist(), w["r"][some].tolist())) == windows_by_definition(values, 12)
            assert w["v"][some].tolist() == [values[c] for c in w["c"][some].tolist()]


def test_windows_of_repeated_lines_take_few_rounds():
    """A line said 4,000 times before other text: smaller neighbours are found in some rounds over all of it, not in one round for each time the line is said."""
    r = np.random.default_rng(6)
    text = np.concatenate((np.tile(r.integers(1, 1 << 63, 40, np.uint64), 4000), r.integers(1, 1 << 63, 2000, np.uint64)))
    steps, code = [0], passages_module.windows.__code__

    def trace(frame, event, arg):
        steps[0] += event == "line"
        return trace if frame.f_code is code else None

    old = sys.gettrace()
    sys.settrace(trace)
    try:
        passages_module.windows([text], 12)
    finally:
        sys.settrace(old)
    assert steps[0] < 2000


def test_long_texts_by_place(monkeypatch):
    """Places of shingles kept by shingle, and numbers instead of hashes, give what flags give."""
    r = random.Random(8)
    base = cases.prose(400, 1).split()
    texts = [changed(base, kind, 12, r, kind) + cases.prose(80, k).split() + base[100:300] for k, kind in enumerate(["replace", "insert", "delete"])]
    hashes = batch_shingle_hashes([" ".join(t).encode() for t in texts])
    number = np.split(np.unique(np.concatenate(hashes), return_inverse=True)[1], np.cumsum([len(x) for x in hashes])[:-1])
    table = np.empty(sum(map(len, hashes)), np.int64)
    for i in range(3):
        for j in range(3):
            want = list(accepted(hashes[i], hashes[j], 46, 0.75))
            assert want and list(accepted(number[i], number[j], 46, 0.75, None, table)) == want
            with monkeypatch.context() as m:
                m.setattr(passages_module, "LONG", 10)
                assert list(accepted(hashes[i], hashes[j], 46, 0.75)) == want


def test_partners_of_texts_that_repeat_themselves():
    """Several windows of a document under one key, with shingles said several times: earlier documents only, and the one that has most."""
    r = np.random.default_rng(2)
    base = r.integers(1, 1 << 32, 30, np.uint32)
    near = np.stack([np.where(r.random(91) < 0.3, r.integers(1, 1 << 32, 91, np.uint32), base[r.integers(0, 30, 91)]) for _ in range(300)]).astype(np.uint32)
    doc, key = np.repeat(np.arange(100), 3), np.repeat(np.array([4, 9], np.uint64), 150)
    got = {}
    for a, b in partners(key, doc, near, 23).tolist():
        assert b < a and key[3 * a] == key[3 * b]
        got.setdefault(a, set()).add(b)
    for k in range(300):
        mine, times = np.unique(near[k], return_counts=True)
        common = {(int(b), times[np.isin(mine, near[o])].sum()) for o, b in enumerate(doc) if key[o] == key[k] and b < doc[k]}
        most = max((n for _, n in common), default=0)
        assert most < 23 or any((b, most) in common for b in got[int(doc[k])])
