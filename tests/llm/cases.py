"""Small tables with everything that real ones hold."""

from __future__ import annotations

import random

CLASHING = "id string, n int, set int, score double, spans string, row string, copy boolean, node int, label int, start int, hit int, items string, host string, sha string"


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["an", "the", "or", "é", "is", "tion", "wh"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def texts() -> list[tuple]:
    p = [prose(120, i) for i in range(8)]
    shared = prose(70, 99)
    edited = p[0].split()
    edited[60] = "changed"
    return [
        (1, p[0]), (2, p[0]), (3, " ".join(edited)), (4, p[1] + " " + shared + " " + p[2]), (5, p[3] + " " + shared), (6, shared), (7, ""), (8, None), (9, " \n\t "), (10, "one"), (11, "one two three"),
        (12, p[4]), (12, p[4]), (13, p[5].upper()), (14, p[5]), (15, prose(6000, 7)), (16, prose(6000, 7) + " end"), (17, "日本 " * 80), (18, "日本 " * 90), (None, p[6]), (None, None), (19, p[6] + " x"), (20, "a" * 3000), (21, "b" + "a" * 3000),
        (22, " ".join([prose(12, 5)] * 12)), (23, " ".join([prose(12, 5)] * 9)), (24, p[7]),
    ]


def docs(spark, rows=None):
    """documents with columns whose names the operators use themselves."""
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "x", 1, 2, 0.5, "s", "r", True, 3, 0, 4, 5, "i", "h", "f") for i, t in rows], "doc_id bigint, text string, " + CLASHING)


def roots(n: int, links: list[tuple[int, int]]) -> list[int]:
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]
