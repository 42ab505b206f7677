import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from claimlake.llm import vector_codes


def nearest(x, entries):
    apart = [(sum((int(a) - int(b)) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(entries)]
    return min(apart)[::-1]


def plain(rows, rounds=4):
    """The contract, vector by vector, in Python's whole numbers."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // 4
    parts = [[v[p * width : (p + 1) * width] for _, v, _ in kept] for p in range(4)]
    books = [[list(x) for x in part[:256]] for part in parts]
    for _ in range(rounds):
        for part, book in zip(parts, books, strict=True):
            members = defaultdict(list)
            for x in part:
                members[nearest(x, book)[0]].append(x)
            for entry, own in members.items():
                book[entry] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [[nearest(x, book) for x in part] for part, book in zip(parts, books, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    errors = [sum(f[n][1] for f in found) for n in range(len(kept))]
    by_label = defaultdict(int)
    for (_, _, label), e in zip(kept, errors, strict=True):
        by_label[label] += e
    return sorted(((i, "".join(f"{f[n][0]:02x}" for f in found), errors[n], by_label[label], digest) for n, (i, _, label) in enumerate(kept)), key=str)


@pytest.mark.parametrize("scale", [3, 400, 2**40])
def test_exponion_search_is_exact(scale):
    draw = np.random.default_rng(scale % 97)
    entries = draw.integers(-scale, scale, (60, 3))
    entries[7] = entries[30] = entries[2]  # equal entries: the lowest index wins
    x = np.concatenate([draw.integers(-scale, scale, (500, 3)), entries, (entries[:-1] + entries[1:]) // 2])
    code, distance = vector_codes.Codebook(entries).assign(x, draw.integers(0, 60, len(x)).astype(np.uint8))
    assert [(int(c), int(d)) for c, d in zip(code, distance, strict=True)] == [nearest(v, entries) for v in x]


def test_search_leaves_far_entries_out(monkeypatch):
    draw = np.random.default_rng(1)
    entries = draw.integers(-2000, 2000, (256, 4))
    x = entries[draw.integers(0, 256, 3000)] + draw.integers(-60, 60, (3000, 4))
    book = vector_codes.Codebook(entries)
    start, _ = book.assign(x, np.zeros(len(x), dtype=np.uint8))
    reach = [np.searchsorted(book.sorted[s], 4 * ((v - entries[s]) ** 2).sum(), side="right") for v, s in zip(x, start, strict=True)]
    assert np.mean(reach) < 5


@pytest.mark.parametrize("many", [3, 300])
def test_codes_of_odd_tables(spark, many):
    draw = np.random.default_rng(many)
    rows = [(i, [float(v) for v in draw.normal(0, 0.1, 8).round(2)], [None, "a", "b"][i % 3]) for i in range(many)]
    rows += [(many + 1, rows[0][1], "a"), (0, rows[1][1], None), (0, rows[1][1], None), (None, rows[2][1], "c"), (-5, rows[2][1], "b")]
    bad = [(-9, None, "a"), (-8, [None] + [0.0] * 7, "a"), (-7, [float("nan")] + [0.0] * 7, "b"), (-6, [0.0] * 7 + [float("inf")], None)]
    table = spark.createDataFrame(rows + bad, "`vec.id` long, embedding array<double>, `la.bel` string").selectExpr("*", "1 AS code", "'x' AS Error").repartition(3)
    got = vector_codes.vector_codes(table, "vec.id", "embedding", "la.bel")
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)
    assert vector_codes.vector_codes(table.where("false"), "vec.id", "embedding", "la.bel").count() == 0


def test_large_components_and_shorter_vectors(spark):
    rows = [(1, [2.0**50, 0.0, 0.0, 0.0], 1), (2, [-(2.0**50), 1.0], 1), (3, [1e300], 2), (4, [], 2)]
    got = vector_codes.vector_codes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert {r["vec_id"]: (r["code"], r["error"]) for r in got.collect()} == {1: ("00000000", 0), 2: ("01010000", 0), 3: ("02000000", 0), 4: ("03000000", 0)}
