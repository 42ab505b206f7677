import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from claimlake.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def plain(docs, items, k):
    """Every document's score for every item."""
    counts = [(i, n, Counter(TERM.findall((t or "").translate(FOLD)))) for n, (i, t) in enumerate(docs)]
    counts = [c for c in counts if c[2]]
    total = sum(c.total() for _, _, c in counts)
    df = Counter(t for _, _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, n, c in counts:
            m = 50 + 50 * c.total() * len(counts) // total
            own = set(TERM.findall((text or "").translate(FOLD))) & c.keys()
            score = sum(math.floor(1000 * math.log((2 * len(counts) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own)
            scores.append((-score, i is None, i or 0, n, i))
        out += [(item, rank, i, -score) for rank, (score, _, _, _, i) in enumerate(sorted(s for s in scores if s[0])[:k], 1)]
    return sorted(out, key=str)


def test_terms():
    text = "Ünï x1-X1\x00_a\x7fB ÄA 日本　語 KelvinK " + "long" * 10
    assert lexical.terms(text.encode()) == Counter(t.encode() for t in TERM.findall(text.translate(FOLD)))
    assert not lexical.terms(b"") and not lexical.terms(b" \n-")


@pytest.mark.parametrize("limits", [{}, {"NUMBERS": 64, "PART": 7, "DEPTH": 1}, {"QUERY_BYTES": 60}])
def test_scores_of_odd_tables(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(lexical, name, value)
    draw = random.Random(3)
    words = ["The", "the", "of", "x1", "ünï", "日本", "rare", "A" * 50, "b_c", "z"]
    docs = [(i, " ".join(draw.choices(words, range(1, 11), k=draw.randint(0, 30)))) for i in range(150)]
    docs += [(i + 1000, "the copy of z") for i in range(70)] + [(5, None), (6, ""), (7, " \n"), (None, "rare rare"), (None, "rare rare"), (8, "rare rare"), (8, "rare rare"), (9, "z " * 3000)]
    items = [(0, "the of THE"), (1, "rare, z-z"), (2, None), (3, "--"), (4, "unknown words"), (5, " ".join(words)), (5, "x1"), (None, "copy")]
    left = spark.createDataFrame(docs, "`doc.id` long, `t.x` string").selectExpr("*", "1 AS rid", "'x' AS n", "2 AS Item_ID").repartition(5)
    right = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'y' AS rank")
    got = lexical.ranked(left, right, 10, "t.x", "doc.id")
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, items, 10)
    assert lexical.ranked(left.where("false"), right, 10, "t.x", "doc.id").count() == 0
    assert lexical.ranked(left, right.where("false"), 10, "t.x", "doc.id").count() == 0


def test_item_ids_may_be_strings(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "d")], "doc_id int, text string")
    got = lexical.ranked(docs, spark.createDataFrame([("q", "A")], "item_id string, text string"))
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in got.collect()] == [("q", 1, 1)]


def test_search_stops_before_the_lists_end():
    draw = np.random.default_rng(0)
    rows = [(i, i, 100, np.array([0, 1], "<i4").tobytes(), np.array([1, 1 + int(draw.zipf(2) % 90)], "<i8").tobytes()) for i in range(4000)]
    block = lexical.Block(rows, np.array([5, 9000]), 4000, 400_000)
    best, read = lexical.Best(np.array([0, 1]), 10), []
    plainly = best.add
    best.add = lambda b, docs, scores: (read.extend(docs), plainly(b, docs, scores))
    best.meet(block)
    scores = block.lookup.sum(axis=0)
    want = sorted(range(4000), key=lambda i: (-scores[i], i))[:10]
    assert best.rows[2].tolist() == want
    assert len(read) == len(set(read)) < 2000


def test_scores_of_very_long_texts_do_not_overflow():
    rows = [(1, 1, 10**12, np.array([0], "<i4").tobytes(), np.array([3], "<i8").tobytes())]
    block = lexical.Block(rows, np.array([7]), 10**10, 10**16)
    m = 50 + 50 * 10**12 * 10**10 // 10**16
    assert block.impacts.tolist() == [7 * (3 * 10**9 // (3000 + 20 * m))]
