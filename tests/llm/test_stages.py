"""Every stage of the pipeline against a plain version of what it decides, each on its own input."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from claimlake.llm import common, mixing, quality, tokens


@pytest.fixture(scope="module")
def stages(spark, data):
    """Name of the stage: its input and its output, as lists of rows."""
    docs, out = common.table(spark, data, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = common.materialize(stage(spark, docs, data), f"test-{name}")
        out[name] = (docs.collect(), made.collect())
        docs = made
    return out


def test_quality_stage_keeps_what_the_query_accepts(spark, data, stages):
    accepted = {r["doc_id"] for r in quality.op3(spark, data).where("predicted = 1").collect()}
    before, after = stages["quality"]
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before if r["doc_id"] in accepted)
    assert 0 < len(after) < len(before)


def test_quality_stage_learns_from_the_same_rows(spark, data):
    docs, labels = common.table(spark, data, "documents"), common.table(spark, data, "labels")
    some = quality.train(quality.labelled_statistics(docs, labels), labels)
    whole = quality.train(quality.with_statistics(docs, "text", "doc_id"), labels)
    assert some.weights == pytest.approx(whole.weights, abs=1e-6)
    ids = quality.labelled_statistics(docs.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id"))), labels)
    assert ids.where("doc_id is null").isEmpty()


def test_exact_dedup_stage(stages):
    before, after = stages["exact_dedup"]
    groups = defaultdict(list)
    for r in before:
        groups["".join(c for c in r["text"] or "" if c not in " \t\n\v\f\r")].append((-len(r["text"] or ""), r["doc_id"]))
    assert sorted(r["doc_id"] for r in after) == sorted(min(g)[1] for g in groups.values())


def test_near_dedup_stage(stages):
    before, after = stages["near_dedup"]
    sets = {}
    for r in before:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ")
        words = [w for w in words if w]
        sets[r["doc_id"]] = {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()
    root = {i: i for i in sets}
    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= 80 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root[i], root[j]))
                root = {k: x if v == y else v for k, v in root.items()}
    assert sorted(r["doc_id"] for r in after) == sorted(i for i in ids if root[i] == i)


def test_mixing_stage(spark, stages):
    before, after = stages["mixing"]
    copies = Counter(r["doc_id"] for r in after)
    sizes = spark.createDataFrame([(r["source"], len((r["text"] or "").split())) for r in before], "source string, size long")
    rates = {r["key"]: r["rate"] for r in mixing.targets(sizes).collect()}
    for r in before:
        rate = rates["-" if r["source"] is None else "s" + r["source"]]
        assert int(rate) <= copies[r["doc_id"]] <= int(rate) + (rate > int(rate))
    assert {(r["doc_id"], r["text"], r["source"]) for r in after} <= {(r["doc_id"], r["text"], r["source"]) for r in before}


def test_packing_stage(stages):
    before, after = stages["packing"]
    encoder = tokens.Encoder(tokens.tokenizer_path("byte_bpe_50k.json"))
    expected, found, sequences = Counter(), Counter(), defaultdict(list)
    for r in before:
        expected[r["doc_id"]] += len(encoder.ids(r["text"] or "")) // 4 + 1
    for r in after:
        found[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert found == expected
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024


def test_stages_on_odd_documents(spark, data):
    """Null and repeated ids, null, empty and very long texts, null sources, extra columns: each stage on its predecessor's rows."""
    long = " ".join(f"word{i % 9000}" for i in range(30000))
    rows = [(None, "alone without an id and with enough words to be read"), (1, None), (2, ""), (3, " \n"), (4, long), (5, long + " x"), (5, "the same row twice over here"), (5, "the same row twice over here"), (6, "plain words of a plain text here"), (7, " plain words of a plain text here")]
    docs = spark.createDataFrame([(i, t, "en", None if i == 6 else "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumns({"row": F.lit(1), "kept": F.lit(2), "size": F.lit(3), "key": F.lit(4)})
    for empty in (False, True):
        now = docs.where("false") if empty else docs
        for name, stage in corpus_pipeline.STAGES:
            before = [tuple(r) for r in now.collect()]
            made = common.materialize(stage(spark, now, data), f"odd-{name}")
            after = [tuple(r) for r in made.collect()]
            if name == "packing":
                assert Counter(r["doc_id"] for r in made.where("start = 0").collect()) == Counter(r[0] for r in before)
            else:
                assert made.columns == docs.columns and set(after) <= set(before)
            if name == "exact_dedup":
                texts = ["".join((r[1] or "").split()) for r in after]
                assert len(set(texts)) == len(texts) and set(texts) == {"".join((r[1] or "").split()) for r in before}
            if name == "near_dedup" and not empty:
                assert len([r for r in after if r[1] and r[1].startswith("word")]) <= 1
            now = made


def test_pipeline_runs_and_leaves_one_table(spark, data):
    at = common.mark()
    out = corpus_pipeline.run(spark, data)
    assert out.count() > 100 and common.mark() == at + 1
