import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlake.retrieval import bm25, chunkers, dense, fusion, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def plain_bm25(docs, items, k):
    """Scores of every document, one by one, in millionths."""
    counts = [(i, n, Counter(TERM.findall((t or "").translate(FOLD)))) for n, (i, t) in enumerate(docs)]
    counts = [c for c in counts if c[2]]
    average = sum(c.total() for _, _, c in counts) / len(counts)
    df = Counter(t for _, _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, n, c in counts:
            score = 0
            for t in set(TERM.findall((text or "").translate(FOLD))) & c.keys():
                idf = math.log(1 + (len(counts) - df[t] + 0.5) / (df[t] + 0.5))
                score += math.floor(1_000_000 * (idf * (c[t] * (1.2 + 1) / (c[t] + 1.2 * (1 - 0.75 + 0.75 * c.total() / average)))))
            scores.append((-score, i is None, i or 0, n, i))
        out += [(item, rank, i, -score / 1_000_000) for rank, (score, _, _, _, i) in enumerate(sorted(s for s in scores if s[0])[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("limits", [{}, {"BLOCK": 8, "SEEDS": 1, "GROUP": 3}])
def test_bm25_of_odd_tables(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(bm25, name, value)
    draw = random.Random(5)
    words = ["The", "the", "of", "x1", "ünï", "日本", "rare", "A" * 50, "b_c", "z"]
    docs = [(i, " ".join(draw.choices(words, range(1, 11), k=draw.randint(0, 30)))) for i in range(150)]
    docs += [(i + 1000, "the copy of z") for i in range(70)] + [(5, None), (6, ""), (7, " \n"), (None, "rare rare"), (None, "rare rare"), (8, "rare rare"), (8, "rare rare"), (9, "z " * 3000)]
    items = [(0, "the of THE"), (1, "rare, z-z"), (2, None), (3, "--"), (4, "unknown words"), (5, " ".join(words)), (5, "x1"), (None, "copy")]
    left = spark.createDataFrame(docs, "`doc.id` long, `t.x` string").selectExpr("*", "1 AS block", "'x' AS term", "2 AS Ids").repartition(5)
    right = spark.createDataFrame(items, "`q.id` long, text string").selectExpr("*", "'y' AS rank")
    got = bm25.search(left, right, 10, "t.x", "doc.id", "text", "q.id")
    assert got.columns == ["query_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_bm25(docs, items, 10)
    assert bm25.search(left.where("false"), right, 10, "t.x", "doc.id", "text", "q.id").count() == 0
    assert bm25.search(left, right.where("false"), 10, "t.x", "doc.id", "text", "q.id").count() == 0


def test_bm25_leaves_blocks_out(spark, monkeypatch):
    monkeypatch.setattr(bm25, "BLOCK", 10)
    docs = spark.createDataFrame([(i, "common " + ("rare " if i // 10 in (3, 7) else "") + f"w{i} " * (i % 5)) for i in range(400)], "doc_id long, text string").coalesce(1)
    seen, scored = [], bm25.Index.scored
    monkeypatch.setattr(bm25.Index, "scored", lambda self, pairs, *a: seen.append(pairs.count()) or scored(self, pairs, *a))
    found = bm25.search(docs, spark.createDataFrame([(1, "common rare")], "item_id long, text string"), 5).collect()
    assert {r["doc_id"] // 10 for r in found} <= {3, 7}
    assert seen == [4, 0]  # of 40 blocks


def plain_recursive(text, size, overlap):
    """Offsets and texts, piece by piece."""
    out, at, before = [], 0, ""
    while at < len(text):
        own = text[at : at + size - overlap]
        if at + len(own) < len(text):
            for mark in (r"\n\n", r"\n", r"[.!?] ", " "):
                if ends := [m.end() for m in re.finditer(mark, own)]:
                    own = own[: ends[-1]]
                    break
        tail = before
        if len(before) > overlap:
            tail = re.sub(r"\A[^ \n]*[ \n]", "", before[len(before) - overlap :], count=1)
        out.append((at - len(tail), at, tail + own))
        at, before = at + len(own), own
    return out


TEXTS = ["", "a", "word " * 100, "x" * 250, "One. Two! Three? " * 20, "p1\n\n" + "line one is here\nline two\n\n" * 9, "日本語。ünï\n" * 30, "  \n\n \n" * 40, "a\n\n" + "b" * 99 + "\n\n" + "c d " * 60]


@pytest.mark.parametrize(("size", "overlap"), [(100, 20), (40, 0), (7, 3), (1, 0)])
def test_recursive_chunks(spark, size, overlap):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(50, None), (None, "null id " * 30), (2, TEXTS[2])]
    docs = spark.createDataFrame(rows, "`doc.id` long, text string").selectExpr("*", "1 AS chunk", "'x' AS Start")
    got = chunkers.recursive(docs, doc_id="doc.id", size=size, overlap=overlap)
    assert got.columns == ["doc_id", "chunk", "start", "length", "fresh", "text"]
    got = got.collect()
    for i, t in rows:
        copies = sum(1 for r in rows if r[0] == i)
        want = [(n, start, len(c), fresh, c) for n, (start, fresh, c) in enumerate(plain_recursive(t or "", size, overlap))]
        assert sorted(tuple(r)[1:] for r in got if r["doc_id"] == i) == sorted(want * copies)
        assert all(len(c) <= size and t[start : start + n] == c for _, start, n, _, c in want)
    assert chunkers.recursive(docs.where("false"), doc_id="doc.id").count() == 0
    with pytest.raises(ValueError, match="overlap"):
        chunkers.recursive(docs, doc_id="doc.id", size=5, overlap=5)


def test_chunks_of_a_long_text_take_linear_time(spark):
    import time

    took = []
    for times in (20_000, 20_000, 80_000):
        docs = spark.createDataFrame([(1, times)], "doc_id long, n int").select("doc_id", F.expr("repeat('Some words here. And\nmore of them, too. ', n)").alias("text"))
        begin = time.perf_counter()
        last = chunkers.recursive(docs, size=200, overlap=20).agg(F.max(F.col("start") + F.col("length")), F.sum(F.col("length") - F.col("fresh") + F.col("start"))).first()
        assert last[0] == last[1] == times * 40
        took.append(time.perf_counter() - begin)
    assert took[2] < 10 * took[1] + 2


def test_semantic_chunks(spark):
    topics = ["cats purr and cats sleep all day. ", "rates of interest rise for banks. "]
    text = topics[0] * 6 + topics[1] * 6 + topics[0] * 4
    rows = [(1, text), (2, None), (3, ""), (4, "one sentence only"), (5, "a. " * 40), (6, "...\n\n!"), (None, text), (1, text)]
    docs = spark.createDataFrame(rows, "doc_id long, `te.xt` string").selectExpr("*", "1 AS chunk", "2 AS N_Sentences")
    got = chunkers.semantic(docs, "te.xt").orderBy("doc_id", "chunk").collect()
    for i, t in {(i, t) for i, t in rows}:
        own = sorted({tuple(r)[1:] for r in got if r["doc_id"] == i})
        assert "".join(r[4] for r in own) == (t or "")
        assert all(t[start : start + n] == c for _, start, n, _, c in own)
    assert sorted({(r["n_sentences"]) for r in got if r["doc_id"] == 4}) == [1]
    assert [r["n_sentences"] for r in got if r["doc_id"] == 5] == [40]
    cuts = {r["start"] for r in got if r["doc_id"] == 1}
    assert {0, 6 * 34, 12 * 34} <= cuts and len(cuts) <= 1 + 15 * chunkers.SHARE
    assert chunkers.semantic(docs.where("false"), "te.xt").count() == 0


def test_parents_of_chunks(spark):
    docs = spark.createDataFrame([(1, "word " * 300), (2, "short"), (3, None), (4, "x" * 1000)], "doc_id long, text string")
    children, parents = chunkers.recursive(docs, size=60, overlap=20), chunkers.recursive(docs, size=333, overlap=50)
    links = chunkers.contained(children, parents, cell=100).collect()
    spans = {(r["doc_id"], r["chunk"]): (r["fresh"], r["start"] + r["length"]) for r in parents.collect()}
    assert len(links) == children.count()
    for r in links:
        low, high = spans[r["doc_id"], r["parent"]]
        fresh = next(c["fresh"] for c in children.collect() if (c["doc_id"], c["chunk"]) == (r["doc_id"], r["chunk"])) if r["chunk"] < 2 else None
        assert fresh is None or low <= fresh < high
    hits = spark.createDataFrame([(7, 1, 0, 2.0), (7, 1, 1, 5.0), (7, 1, 2, 5.0), (7, 9, 0, 1.0), (8, 2, 0, 1.0)], "query_id long, doc_id long, chunk int, score double")
    got = chunkers.expanded(hits, chunkers.contained(children, parents, cell=100)).collect()
    assert sorted(map(tuple, got)) == [(7, 1, 0, 5.0, 3, 1), (8, 2, 0, 1.0, 1, 0)]


def test_dense_search_of_odd_tables(spark):
    draw = np.random.default_rng(2)
    rows = [(i, [float(x) for x in draw.normal(size=6)]) for i in range(300)]
    rows += [(i, rows[i % 7][1]) for i in range(300, 340)]
    bad = [(900, None), (901, [None] + [1.0] * 5), (902, [math.nan] * 6), (903, [math.inf] + [0.0] * 5), (904, [0.0] * 6), (905, []), (None, [1.0] * 6)]
    table = spark.createDataFrame(rows + bad, "`vec.id` long, `em.b` array<double>").selectExpr("*", "1 AS list", "'x' AS Score").repartition(3)
    unit = np.array([v for _, v in rows]) / np.linalg.norm([v for _, v in rows], axis=1)[:, None]
    want = []
    for i in range(0, 340, 20):
        scores = sorted((-round(float(unit[i] @ unit[j]), 6), rows[j][0]) for j in range(340) if j != i)[:10]
        want += [(rows[i][0], n, j, -s) for n, (s, j) in enumerate(scores, 1)]
    asked = table.where("`vec.id` % 20 = 0 OR `vec.id` >= 900 OR `vec.id` IS NULL")
    asked = asked.unionAll(asked)
    got = dense.search(table, asked, exact=True, vec_id="vec.id", vector="em.b")
    assert [(q, n, j, pytest.approx(s)) for q, n, j, s in want] == sorted(map(tuple, got.collect()))
    assert dense.search(table.where("false"), asked, exact=True, vec_id="vec.id", vector="em.b").count() == 0
    assert dense.search(table, asked.where("false"), vec_id="vec.id", vector="em.b").count() == 0


def test_bm25_blocks_end_by_terms(spark, tmp_path, monkeypatch):
    """Long documents end a block before it has its number of documents; the index holds the same."""
    docs = spark.range(60).selectExpr("id AS doc_id", "array_join(transform(sequence(0, 99), x -> concat('w', x * id % 157)), ' ') AS text").coalesce(1)
    bm25.build(docs, f"file://{tmp_path}/whole")
    monkeypatch.setattr(bm25, "HELD", 500)
    bm25.build(docs, f"file://{tmp_path}/parts")
    whole, parts = (bm25.Index(spark, f"file://{tmp_path}/{n}") for n in ("whole", "parts"))
    assert whole.blocks.count() == 1 and parts.blocks.count() > 5
    queries_ = spark.createDataFrame([(1, "w1 w2 w30"), (2, "w156 w5")], "item_id long, text string")
    assert sorted(map(tuple, whole.search(queries_).collect())) == sorted(map(tuple, parts.search(queries_).collect()))


def test_bm25_search_indexes_what_is_asked(spark, monkeypatch):
    """One search reads the documents once and keeps postings of its own terms only, and finds what a whole index finds."""
    read, paths, build = spark.sparkContext.accumulator(0), [], bm25.build

    def ticked(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [(i, " ".join(f"w{i * x % 157}" for x in range(1, 30 + i % 50))) for i in range(90)] + [(200, "not asked"), (201, None), (202, "w2 " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    items = [(1, "w1 w2 W30"), (2, "w156 w5 none"), (3, "w2")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(bm25, "BLOCK", 16)
    monkeypatch.setattr(bm25, "build", lambda d, path, *a, **b: paths.append(path) or build(d, path, *a, **b))
    found = bm25.search(docs.mapInArrow(ticked, docs.schema), asked, 7).collect()
    assert read.value == len(rows)
    assert sorted(map(tuple, found), key=str) == plain_bm25(rows, items, 7)
    index = bm25.Index(spark, paths[0])
    assert {bytes(r["term"]) for r in index.postings.select("term").collect()} == {b"w1", b"w2", b"w30", b"w156", b"w5"}
    assert (index.documents, index.length) == (92, sum(len(t.split()) for _, t in rows if t))
    monkeypatch.setattr(bm25, "ASKED", 0)
    assert sorted(map(tuple, bm25.search(docs, asked, 7).collect())) == sorted(map(tuple, found))
    assert bm25.Index(spark, paths[1]).terms.count() == 159


def test_bm25_terms_of_long_texts(spark, monkeypatch):
    """Texts over the size that is counted at once, alone and among short ones, and texts without a term."""
    rows = [(1, "a b"), (2, "c " * 40 + "A b" * 30), (3, "..."), (4, ""), (5, "b " * 70), (6, "a" * 90), (7, "a c, c")]
    items = [(1, "a c"), (2, "b"), (3, "a" * 90), (4, "z")]
    docs, asked = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string")
    for size, most in ((64, 1 << 22), (64, 0), (1, 1 << 22), (1, 0)):
        monkeypatch.setattr(bm25, "TEXTS", size)
        monkeypatch.setattr(bm25, "ASKED", most)
        assert sorted(map(tuple, bm25.search(docs, asked).collect()), key=str) == plain_bm25(rows, items, 10)


def test_dense_drawn_rows(spark):
    """What is drawn are the rows of smallest hash, repeated ids and all, and no more rows than these meet in the sort."""
    rows = spark.range(20000).selectExpr("id % 15000 AS vec_id", "array(id / 7.0D, 1.0D) AS v").repartition(4)
    by_hash = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v")
    for n in (1, 700, 30000):
        assert dense.first_by_hash(rows, n).sort(F.xxhash64("vec_id"), "vec_id", "v").collect() == by_hash.limit(n).collect()
    once = {r["vec_id"] for r in dense.first_by_hash(rows, 50, 1, once=True).collect()}
    assert once == {r["vec_id"] for r in rows.select("vec_id").distinct().orderBy(F.xxhash64("vec_id", F.lit(1))).limit(50).collect()}
    assert dense.first_by_hash(rows.where("false"), 5).count() == 0


def test_dense_queries_meet_blocks_in_groups(spark, tmp_path, monkeypatch):
    """Queries are never broadcast, travel once per part and not once per list, and find the same in groups of any size."""
    draw = np.random.default_rng(3)
    vectors = draw.normal(size=(900, 8))
    vectors[500:520] = vectors[3]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(3)
    asked = table.where("vec_id % 3 = 0")
    dense.build(table, f"file://{tmp_path}/dense")
    lists = dense.Quantiser(spark, f"file://{tmp_path}/dense")
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    scores = np.round(unit @ unit.T, 6) + 0.0
    want = [(q, n, int(j), scores[q, j]) for q in range(0, 900, 3) for n, j in enumerate([j for j in np.lexsort((np.arange(900), -scores[q])) if j != q][:10], 1)]
    plan = lists.search(asked, probes=len(lists.centroids))._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan
    few = lists.search(asked, probes=2).collect()
    for asking, parts, numbers in ((dense.ASKING, dense.PARTS, dense.NUMBERS), (500, 3, 160), (100, 1, 8)):
        for name, value in (("ASKING", asking), ("PARTS", parts), ("NUMBERS", numbers)):
            monkeypatch.setattr(dense, name, value)
        for found in (lists.search(asked, probes=len(lists.centroids)), lists.search(asked, probes=2, exact=True)):
            assert [(q, n, j, pytest.approx(s)) for q, n, j, s in want] == sorted(map(tuple, found.collect()))
        assert sorted(map(tuple, few)) == sorted(map(tuple, lists.search(asked, probes=2).collect()))


def test_dense_recall(spark, data):
    rows = queries.dense_recall(spark, data).toPandas()
    assert rows["found"].sum() >= 0.9 * rows["wanted"].sum()


def test_rank_fusion_does_not_broadcast_vectors(spark, data):
    """What is broadcast are tables that were counted and scores, never blocks of queries by the lists they visit."""
    plan = queries.rank_fusion(spark, data)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join [" in line]
    assert joins and not [line for line in joins if "Join [list#" in line]


def test_fusion(spark):
    ranking = lambda rows: spark.createDataFrame(rows, "query_id long, doc_id long, rank int")
    a = ranking([(1, 10, 1), (1, 11, 2), (1, 12, 2), (2, 10, 1), (None, 5, 1), (1, 10, 7)])
    b = ranking([(1, 12, 1), (1, 13, 2), (1, None, 3), (None, 5, 2)])
    got = {(r["query_id"], r["doc_id"]): (r["rank"], r["score"], r["a_rank"], r["b_rank"]) for r in fusion.fused({"a": a, "b": b}).collect()}
    assert got == {
        (1, 12): (1, 1 / 62 + 1 / 61, 2, 1),
        (1, 10): (2, 1 / 61, 1, None),
        (1, 11): (3, 1 / 62, 2, None),
        (1, 13): (4, 1 / 62, None, 2),
        (1, None): (5, 1 / 63, None, 3),
        (2, 10): (1, 1 / 61, 1, None),
        (None, 5): (1, 1 / 61 + 1 / 62, 1, 2),
    }
    assert fusion.fused({"a": a, "b": b.where("false")}, k=1).count() == 3
    assert [r["doc_id"] for r in fusion.fused({"a": a, "b": b}, weights={"b": 5.0}, k=1).where("query_id = 1").collect()] == [12]
