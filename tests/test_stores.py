"""What is kept between runs: answers, snapshots, growing merges, and folds of late documents."""

import json
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from claimlake.operators import generate, ledger, merge
from claimlake.sources import snapshots
from claimlake.streaming import late

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import the tests


class Counting:
    """Counts its calls in a file that all workers share, and fails on the first tries of some prompts."""

    def __init__(self, path):
        self.path = str(path)

    def __call__(self, prompt):
        with open(self.path, "a") as seen:
            seen.write(json.dumps(prompt) + "\n")
        asked = [json.loads(line) for line in open(self.path)].count(prompt)
        if prompt and (prompt.startswith("never") or (prompt.startswith("later") and asked < 3)):
            raise ValueError("busy")
        return f"<{prompt}>"

    def calls(self):
        return [json.loads(line) for line in open(self.path)]


def test_answers_are_asked_once(spark, tmp_path):
    model = Counting(tmp_path / "calls")
    rows = spark.createDataFrame([(i, f"p{i % 5}") for i in range(40)] + [(40, "later"), (41, "never"), (42, None), (43, "")], "id int, prompt string").repartition(3)
    answers = generate.Answers(spark, str(tmp_path / "store"), at_once=4, tries=3, pause=0.01)
    first = {r["id"]: (r["raw"], r["error"]) for r in answers.ask(rows, model, "prompt", "id").collect()}
    assert len(first) == 44
    assert all(first[i] == (f"<p{i % 5}>", None) for i in range(40))
    assert first[40] == ("<later>", None) and first[41] == (None, "ValueError: busy")
    assert (first[42], first[43]) == (("<None>", None), ("<>", None))
    assert sorted(map(str, model.calls())) == sorted(["p0", "p1", "p2", "p3", "p4", "later", "later", "later", "never", "never", "never", "None", ""])
    again = {r["id"]: (r["raw"], r["error"]) for r in generate.Answers(spark, str(tmp_path / "store"), pause=0.01).ask(rows, model, "prompt", "id").collect()}
    assert again == first
    assert len(model.calls()) == 16 and model.calls()[-1] == "never"  # what failed is asked again
    assert answers.ask(rows.where("false"), model, "prompt", "id").count() == 0


def test_settings_tell_models_apart():
    a, b = generate.LocalServer(temperature=0.1), generate.LocalServer(temperature=0.2)
    assert generate.settings(a) != generate.settings(b)
    hosted = lambda token: generate.settings(generate.HostedServer(token=token))
    assert hosted("x") == hosted("y") and "x" not in json.loads(hosted("x"))[1].values()
    assert generate.settings(len) != generate.settings(sum)


def test_snapshots(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "claim_id string, v int")
    table = snapshots.Snapshots(spark, str(tmp_path / "t"), "claim_id string, v int", buckets=4)
    held = lambda v=None: sorted(((r["claim_id"], r["v"]) for r in table.read(v).collect()), key=str)
    assert (held(), table.version()) == ([], 0)
    assert table.replace(rows(("a", 1), ("b", 1), (None, 1), *((f"k{i}", i) for i in range(20)))) == 1
    opened = table.read()
    assert table.replace(rows(("a", 2), ("a", 3), (None, 2))) == 2
    assert [x for x in held() if x[0] in ("a", "b", None)] == [("a", 2), ("a", 3), ("b", 1), (None, 2)]
    assert sorted(r["v"] for r in opened.where("claim_id = 'a'").collect()) == [1]  # an open reader keeps its version
    assert ("a", 1) in held(1) and len(held()) == 24
    assert table.append(rows(("b", 9))) == 3 and [x for x in held() if x[0] == "b"] == [("b", 1), ("b", 9)]
    assert table.replace(rows().limit(0), rows(("b", 0))) == 4 and not [x for x in held() if x[0] == "b"]
    assert snapshots.Snapshots(spark, str(tmp_path / "t"), "claim_id string, v int", buckets=64).buckets == 4
    before = held()
    (tmp_path / "t" / "manifest" / "5.claim").touch()  # a write that is not finished, or not yet
    with pytest.raises(snapshots.Conflict):
        table.append(rows(("z", 1)))
    assert held() == before
    (tmp_path / "t" / "manifest" / "5.claim").unlink()
    table.append(rows(("z", 1)))
    table.vacuum(1)
    assert table.versions() == [5] and held() == sorted([*before, ("z", 1)], key=str)
    folders = {p.name for p in (tmp_path / "t" / "data").iterdir()}
    assert folders == {f.removeprefix("data/") for f in table._manifest(5)["folders"].values()}


def test_a_growing_merge_equals_the_full_one(spark, tmp_path):
    draw = random.Random(4)
    rows = [(c, d, f"d{d}", p, "r", draw.choice(["EUR 5", "€5", "x", " X ", None]), draw.choice([None, 1, 2])) for c in ("k1", "k2", "k3") for d in range(6) for p in ("a", "financials.b", "c") if draw.random() < 0.8]
    table = spark.createDataFrame(rows, "claim_id string, doc_idx int, doc string, path string, reason string, value string, page int")
    documents = spark.createDataFrame([(c, d) for c in ("k1", "k2", "k3") for d in range(6)], "claim_id string, doc_idx int")
    growing = merge.Merge(spark, str(tmp_path / "m"), buckets=2)
    plain = lambda df: sorted((tuple(map(str, r)) for r in df.collect()))
    seen = F.lit(False)
    assert growing.fields().count() == 0
    for batch in (F.col("doc_idx") < 2, (F.col("doc_idx") == 3) & (F.col("claim_id") != "k2"), F.col("doc_idx") < 4, F.col("doc_idx") < 6):
        growing.add(table.where(batch), documents.where(batch))
        seen = seen | batch
        assert plain(growing.fields()) == plain(merge.merge_fields(table.where(seen), documents.where(seen)))
    version = growing.parts.version()
    growing.add(table, documents)  # all known: nothing is written
    assert growing.parts.version() == version


def test_a_merge_that_stops_halfway_changes_nothing(spark, tmp_path, monkeypatch):
    schema = "claim_id string, doc_idx int, doc string, path string, reason string, value string, page int"
    one = spark.createDataFrame([("k", 0, "d0", "p", "r", "x", 1)], schema)
    two = spark.createDataFrame([("k", 1, "d1", "p", "r", "y", 1)], schema)
    growing = merge.Merge(spark, str(tmp_path / "m"))
    growing.add(one, one)
    before = growing.fields().collect()

    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(growing.documents, "replace", fails)
        with pytest.raises(OSError, match="lost"):
            growing.add(two, two)
    assert growing.fields().collect() == before
    growing.add(two, two)
    assert growing.fields().first()["field_value"] == "y"
    assert growing.fields().collect() == merge.merge_fields(one.unionAll(two), one.unionAll(two)).collect()


def update(diary, content):
    if content == "bad":
        raise ValueError("no")
    return f"<!-- BEGIN_DIARY -->{diary}/{content}<!-- END_DIARY --><!-- BEGIN_LEDGER_ENTRY -->{len(diary)}<!-- END_LEDGER_ENTRY -->"


def test_refolding_does_not_depend_on_batches():
    documents = [(0, "a", "x"), (1, "b", "y"), (1, "c", "bad"), (2, "d", "z"), (5, None, "w")]
    want, _ = late.refolded([], documents, update, "s")
    draw = random.Random(0)
    for _ in range(200):
        left, held = draw.sample(documents, len(documents)), []
        while left:
            n = draw.randint(1, len(left))
            came, left = left[:n], left[n:]
            held, place = late.refolded(held, came + came[:1], update, "s")
            assert place <= len(held)
        assert held == want
    assert late.refolded(want, documents, update, "s") == (want, len(want))
    changed, place = late.refolded(want, [(2, "d", "new")], update, "s")
    assert place == 3 and changed[:3] == want[:3] and changed[-1][3] == "s/x/y/new/w"


def test_late_documents_in_a_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "claim_id string, doc_idx int, doc string, content string"
    rows = [("k1", 2, "c", "C"), ("k1", 0, "a", "A"), ("k2", 0, "x", "X"), ("k1", 1, "b", "B"), ("k2", 1, "y", "bad"), ("k1", 3, "d", "D")]
    for i, batch in enumerate((rows[:1], rows[1:3], rows[3:])):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    folded = late.stream_refold(stream, update, "s")
    query = folded.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.parquet(str(tmp_path / "out"))
    newest = got.groupBy("claim_id", "doc_idx").agg(F.max_by(F.struct("diary", "ledger"), "revision").alias("x")).select("claim_id", "doc_idx", "x.*")
    want = ledger.fold(spark.createDataFrame(rows, schema), update, "s").select("claim_id", "doc_idx", "diary", "ledger")
    assert sorted(map(tuple, newest.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() > newest.count()
