import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from claimlake import prompts
from claimlake.functions import normalize, registry, tables, text
from claimlake.operators import extract, generate, layout, ledger, merge
from claimlake.plans import queries as plans
from claimlake.plans import runs
from claimlake.sources import files
from claimlake.streaming.fold import store, stream_fold


@pytest.mark.parametrize("name", list(plans.queries()))
def test_query_matches_sql(spark, data, duck, agree, name):
    out = plans.queries()[name](spark, data).toPandas()
    assert len(out)
    if name in plans.oracles():
        agree(out, duck.sql(plans.oracles()[name]).df())


def one(spark, make, value):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("kind", "value", "want"),
    [
        ("string", "  hello  ", "hello"), ("string", None, None), ("narrative", "  Hello \n  world  ", "Hello world"),
        *[("date", d, "2026-03-28") for d in ("28.03.2026", "28/03/2026", "03/28/2026", "March 28, 2026", "28 March 2026", "Mar 28, 2026", "28 Mar 2026", "20260328", "2026328", "2026-3-28")],
        ("date", "03/04/2026", "2026-04-03"), ("date", "202611", "2026-01-01"), ("date", "31/02/2026", "31/02/2026"), ("date", "Sept 3, 2026", "Sept 3, 2026"), ("date", None, None),
        ("currency", "EUR 12,650", "EUR 12650"), ("currency", "€12.650,00", "EUR 12650"), ("currency", "£ 100", "GBP 100"), ("currency", "$50.50", "USD 50"), ("currency", "1,000,000 USD", "USD 1000000"),
        ("currency", "100", "100"), ("currency", "Unknown 100", "Unknown 100"), ("currency", "EUR", "EUR"), ("currency", "12,650.00 EUR", "EUR 1265000"), ("currency", "$50.50 total", "USD 5050"),
        ("currency", "EUR 12,65", "EUR 12"), ("currency", "ABCD 100", "BCD 100"), ("currency", "eur 100", "eur 100"), ("currency", "EUR -50", "EUR -50"), ("currency", "EUR 007", "EUR 7"), ("currency", "EUR 1,000 to EUR 2,000", "EUR 1000"),
        ("enum", " Comm ", "commercial"), ("enum", "Barn", "barn"),
    ],
)
def test_normalizers(spark, kind, value, want):
    assert one(spark, normalize.NORMALIZERS[kind], value) == want


def test_corrected_cents(spark):
    assert one(spark, lambda c: normalize.currency(c, trim_amount=True), "12,650.00 EUR") == "EUR 12650"


@pytest.mark.parametrize("kind", list(normalize.NORMALIZERS))
def test_null_comparisons(spark, kind):
    row = spark.range(1).select(normalize.same(kind, F.lit(None).cast("string"), F.lit(None).cast("string")), normalize.same(kind, F.lit("x"), F.lit(None).cast("string"))).first()
    assert list(row) == [True, False]


def test_narrative_prefix(spark):
    a, b = "x" * 120 + "a", "X" * 120 + "b"
    assert spark.range(1).select(normalize.same("narrative", F.lit(a), F.lit(b))).first()[0]


def test_registry(spark):
    rows = registry.field_registry(spark).collect()
    kinds = [r["kind"] for r in rows]
    assert len(rows) == 37
    assert {k: kinds.count(k) for k in set(kinds)} == {"currency": 15, "string": 12, "narrative": 5, "date": 4, "enum": 1}


def test_text(spark):
    assert one(spark, text.clean_text, "a\n\n\n\nb  c\td\nhy-\n  phen gluedWord \n") == "a\n\nb c d\nhyphen glued Word"
    assert one(spark, text.clean_text, None) == ""
    assert one(spark, text.unfence, "```JSON\n{}\n```") == "{}"
    assert one(spark, text.clean_text, "a-\nb-\nc-\n") == "ab-\nc-"
    assert one(spark, text.sections, "<!-- BEGIN_A --><!-- BEGIN_B -->x<!-- END_B --><!-- END_C -->y<!-- END_B -->") == {"B": "x"}
    assert one(spark, text.sections, "plain") == {}
    raw = "<!-- BEGIN_A --> 1 <!-- END_A --><!-- begin_a -->\n2\n<!--END_A--><!-- BEGIN_B -->x<!-- END_C -->"
    assert one(spark, text.sections, raw) == {"A": "2"}
    assert one(spark, lambda c: text.first_section(c, "A"), raw) == "1"
    assert one(spark, text.ledger_cells, "| 1 | Claim ID | - | C1 |") == ["1", "Claim ID", "-", "C1"]
    assert one(spark, text.ledger_cells, "|| A | - | B |") is None


def test_tables(spark):
    rows = spark.sql("SELECT array(array('a|b', 'c'), array(null), array(' x\ny ')) AS r, cast(array() as array<array<string>>) AS e")
    got = rows.select(tables.to_markdown(F.col("r")), tables.to_markdown(F.col("e")), tables.to_json(F.col("e")), tables.to_json(F.col("r"))).first()
    assert got[0] == "| a\\|b | c |\n| --- | --- |\n|  |  |\n| x y |  |"
    assert got[1:3] == ("", "[]")
    assert json.loads(got[3]) == [["a|b", "c"], [None], [" x\ny "]]


def test_masking_and_lines(spark):
    rows = [("a", 1, "char", 50.0, 150.0, 60.0, 160.0), ("b", 1, "char", 120.0, 120.0, 130.0, 130.0), ("c", 1, "char", 90.0, 190.0, 110.0, 210.0), ("d", 1, "rect", 120.0, 120.0, 130.0, 130.0), ("e", 1, "char", 90.0, 120.0, 100.0, 130.0), ("f", 2, "char", 120.0, 120.0, 130.0, 130.0)]
    objects = spark.createDataFrame(rows, "id string, page int, object_type string, x0 double, top double, x1 double, bottom double")
    boxes = spark.createDataFrame([(1, 100.0, 100.0, 200.0, 200.0)], "page int, x0 double, top double, x1 double, bottom double")
    assert {r["id"] for r in layout.outside_tables(objects, boxes, ["page"]).collect()} == {"a", "d", "e", "f"}
    words = spark.createDataFrame([(1, i, str(t), 0.0, t, 1.0, t + 1) for i, t in enumerate([10.0, 11.5, 13.0, 12.1, 40.0, 10.9])], "page int, ordinal int, text string, x0 double, top double, x1 double, bottom double")
    assert [r["text"] for r in layout.cluster_lines(words, ["page"]).orderBy("line").collect()] == ["10.0 11.5 10.9", "13.0 12.1", "40.0"]


OBS = "claim_id string, doc_idx int, doc string, path string, reason string, value string, page int"


def merged(spark, path, values, pages=None):
    rows = [("c", i, f"d{i}", path, f"r{i}", v, (pages or [None] * len(values))[i]) for i, v in enumerate(values)]
    d = spark.createDataFrame(rows, OBS)
    return merge.merge_fields(d, d.select("claim_id", "doc_idx")).first()


def test_merge_cases(spark):
    money = "financials.reserves.other_reserve"
    r = merged(spark, money, ["EUR 13000", "€12,650", "12650 EUR"])
    assert (r["field_value"], r["source_documents"], r["confidence"]) == ("12650 EUR", ["d1", "d2"], 0.867)
    r = merged(spark, "coverage.coverage_type", ["alpha", "alpha", "alpha", "beta"])
    assert (r["field_value"], r["source_documents"], r["confidence"]) == ("alpha", ["d0", "d1", "d2"], 0.7)
    assert merged(spark, "x", ["v"])["confidence"] == 1.0
    r = merged(spark, "x", [None, None])
    assert (r["field_value"], r["reason"], r["source_documents"], r["pages"], r["confidence"]) == (None, None, [], [], 0.0)
    r = merged(spark, "x", ["z", "y", "y"], [None, None, 1])
    assert (r["pages"], r["confidence"]) == ([None, 1], 0.867)
    r = merged(spark, "coverage.policy_period_start", ["28.03.2026", "March 28, 2026"])
    assert (r["field_value"], r["confidence"]) == ("March 28, 2026", 1.0)
    assert merged(spark, "extra.note", [" Foo ", "foo"])["field_value"] == "foo"
    assert merged(spark, "x", ["null"])["field_value"] == "null"


def test_payments(spark):
    rows = [("c", 0, "d0", 0, "2026-04-05", "EUR 500", "first", 1), ("c", 1, "d1", 0, "05.04.2026", "€500", "again", 2)]
    p = spark.createDataFrame(rows, "claim_id string, doc_idx int, doc string, pos int, date string, amount string, description string, page int")
    r = merge.payments_record(p).first()
    assert (json.loads(r["field_value"]), r["source_documents"]) == ([{"date": "2026-04-05", "amount": "EUR 500", "description": "first", "_page": 1, "_source_document": "d0"}], ["d0"])
    whole = merge.final_claim(merge.merge_fields(spark.createDataFrame([("c", 0, "d0", "x", "r", "v", 1)], OBS), p.select("claim_id", "doc_idx")), p)
    assert [x["field_name"] for x in json.loads(merge.as_json(whole).first()["json"])] == ["x", "financials.payments_made"]


def test_leaves_and_payments(spark):
    raw = json.dumps({"general": None, "a": {"b": {"value": "x", "_page": 2, "reason": None}, "c": {"reason": None, "value": "x"}, "_d": {"value": 1, "_page": 1}}, "financials": {"payments_made": [{"date": "d", "amount": "a", "description": None, "_page": 3}]}})
    d = spark.createDataFrame([(1, raw)], "id int, raw string").select("id", F.parse_json("raw").alias("v"))
    assert {(r["path"], r["value"], r["page"]) for r in extract.leaves(d, "v", "id").collect()} == {("general", None, None), ("a.b", "x", 2), ("a.c.reason", None, None)}
    assert [(r["date"], r["page"]) for r in extract.payments(d, "v", "id").collect()] == [("d", 3)]


def docx(full: bool = True) -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "<w:p><w:r><w:t>One</w:t></w:r><w:r><w:t> two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t> a </w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:br w:type='page'/><w:t>Next</w:t></w:r></w:p>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body * full}</w:body></w:document>")
    return out.getvalue()


def test_merged_cells_repeat():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda text, more="": f"<w:tc><w:tcPr>{more}</w:tcPr><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:tc>"
    top = cell("wide", "<w:gridSpan w:val='2'/>") + cell("tall", "<w:vMerge w:val='restart'/>")
    low = cell("a") + cell("b") + cell("", "<w:vMerge/>")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:tbl><w:tr>{top}</w:tr><w:tr>{low}</w:tr></w:tbl></w:body></w:document>")
    assert files.decode_docx(out.getvalue())[0]["rows"] == [["wide", "wide", "tall"], ["a", "b", "tall"]]


def test_parser_labels(spark):
    names = ["a.pdf", "b.x.DOCX", "pdf", "c.txt", "docx.", "", None]
    d = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
    assert [r[0] for r in d.orderBy("i").select(files.parser_label(F.col("name"))).collect()] == ["<DocumentParser:PDF>", "<DocumentParser:DOCX>", "<DocumentParser:PDF>", None, None, None, None]


def test_texts_of_cells():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    r = lambda inner: f"<w:r>{inner}</w:r>"
    cells = [
        "<w:p>" + r("<w:t>a</w:t><w:br/><w:t>b</w:t><w:tab/><w:t>c</w:t>") + "</w:p><w:tbl><w:tr><w:tc><w:p>" + r("<w:t>NESTED</w:t>") + "</w:p></w:tc></w:tr></w:tbl><w:p/>",
        "<w:p>" + r("<w:t>one</w:t><w:cr/><w:t>two</w:t>") + "</w:p><w:p><w:hyperlink>" + r("<w:t>link</w:t>") + "</w:hyperlink>" + r("<w:noBreakHyphen/><w:br w:type='page'/><w:t>x</w:t>") + "</w:p>",
    ]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:tbl><w:tr>{''.join(f'<w:tc>{c}</w:tc>' for c in cells)}</w:tr></w:tbl></w:body></w:document>")
    assert files.decode_docx(out.getvalue())[0]["rows"] == [["a\nb\tc", "one\ntwo\nlink-x"]]


def test_files_are_decoded_once(spark, tmp_path, monkeypatch):
    (tmp_path / "k1").mkdir()
    (tmp_path / "k1" / "a.docx").write_bytes(docx())
    made = runs.contents(files.list_claims(spark, str(tmp_path)))
    assert "MapInPandas" not in made._jdf.queryExecution().executedPlan().toString()
    assert made.first()["content"] == "[Page 1]\nOne two\n\n[Page 1]\n| a |\n| --- |\n\n[Page 2]\nNext"


class FakePage:
    """A page as the optional PDF library shows it, as far as the decoder looks."""

    def __init__(self, words, tables=(), images=()):
        self.words, self.found, self.images, self.kept = words, tables, images, None

    def find_tables(self):
        return [type("Table", (), {"bbox": box, "extract": lambda self, rows=rows: rows})() for box, rows in self.found]

    def filter(self, keep):
        page = FakePage([x for x in self.words if keep(x)])
        return page

    def extract_words(self, **how):
        assert how == {"x_tolerance": files.X_TOLERANCE, "y_tolerance": files.Y_TOLERANCE, "keep_blank_chars": False, "use_text_flow": True}
        return self.words


def test_pdf_pages(spark, monkeypatch, tmp_path):
    """Words outside of tables become lines, in reading order with tables and images; needs no library."""
    import sys
    import types

    word = lambda text, x, top: {"object_type": "char", "text": text, "x0": float(x), "top": top, "x1": x + 9.0, "bottom": top + 8}
    pages = [
        FakePage([word("second", 10, 52.0), word("line", 30, 53.0), word("first", 10, 20.0), word("celltext", 100, 150.0)], [((90.0, 140.0, 200.0, 180.0), [["h", None], ["1", "2"]])], [{"x0": 1, "top": 200, "x1": 5, "bottom": 210, "width": 4, "height": 10}]),
        FakePage([word("next", 1, 1.0)], [], [{"x0": None, "top": None}]),
    ]
    opened = types.SimpleNamespace(pages=pages)
    library = types.ModuleType("pdfplumber")
    library.open = lambda stream: Opened(opened)
    monkeypatch.setitem(sys.modules, "pdfplumber", library)
    rows = files.decode_pdf(b"%PDF")
    assert [(r["page"], r["kind"], r.get("text")) for r in rows] == [(1, "table", None), (1, "word", "second"), (1, "word", "line"), (1, "word", "first"), (1, "image", None), (2, "word", "next"), (2, "image", None)]
    assert rows[4]["image"] is None and (rows[4]["y0"], rows[6]["y0"], rows[6]["width"]) == (200.0, 0.0, 0.0)
    names = [p.split()[0] for p in files.LAYOUT.replace("array<array<string>>", "cells").split(", ")]
    table = spark.createDataFrame([("d", *(r.get(n) for n in names)) for r in rows], f"doc string, {files.LAYOUT}")
    got = layout.chunks(table, ["doc"]).orderBy("page", "order").collect()
    assert [(r["page"], r["order"], r["chunk_type"], r["content"]) for r in got] == [
        (1, 0, "text", "first\nsecond line"), (1, 1, "table", "| h |  |\n| --- | --- |\n| 1 | 2 |"), (1, 2, "image", None),
        (2, 0, "image", None), (2, 1, "text", "next"),
    ]


class Opened:
    def __init__(self, pdf):
        self.pdf = pdf

    def __enter__(self):
        return self.pdf

    def __exit__(self, *_):
        return False


def test_long_pages_and_texts_take_linear_time(spark):
    import time

    took = []
    for n in (5000, 40_000):
        begin = time.perf_counter()
        assert layout.lines_of([float(3 * (i * 7919 % n)) for i in range(n)], 2.0) == list(range(n))
        assert max(layout.lines_of([float(i % 50) * 12 for i in range(n)], 2.0)) == 49
        took.append(time.perf_counter() - begin)
    assert took[1] < 30 * took[0]
    assert layout.lines_of([10, 11.5, 13, 12.1, 40, 10.9], 2.0) == [0, 0, 1, 1, 2, 0]
    assert layout.lines_of([None, 1.0, None, float("nan"), 1.0], 0.0) == [0, 1, 2, 3, 1]
    words = spark.range(20_000).selectExpr("1 AS doc", "id AS ordinal", "'w' AS text", "0.0 AS x0", "id * 5.0 AS top", "1.0 AS x1", "id * 5.0 + 1 AS bottom")
    assert layout.cluster_lines(words, ["doc"]).agg(F.count("*"), F.max("line")).first()[:] == (20_000, 19_999)
    took = []
    for n in (2000, 20_000):
        begin = time.perf_counter()
        d = spark.range(1).select(F.expr(f"array_join(transform(sequence(1, {n}), i -> '<!-- BEGIN_S' || i || ' -->body ' || i || '<!-- END_S' || i || ' -->'), 'x')").alias("t"))
        assert d.select(F.size(text.sections(F.col("t")))).first()[0] == n
        same = spark.range(1).select(F.expr(f"array_join(transform(sequence(1, {n}), i -> '<!-- BEGIN_S -->body ' || i || '<!-- END_S -->'), 'x')").alias("t"))
        assert same.select(text.sections(F.col("t"))["S"]).first()[0] == f"body {n}"
        took.append(time.perf_counter() - begin)
    assert took[1] < 20 * took[0]


def test_files(spark, tmp_path):
    (tmp_path / "k1").mkdir()
    for name, content in {"c_invoice.docx": docx(), "a_claim.pdf": b"%PDF", "readme.txt": b"x", "b.dOcX": b"broken"}.items():
        (tmp_path / "k1" / name).write_bytes(content)
    listed = files.list_claims(spark, str(tmp_path))
    assert [(r["name"], r["doc_idx"]) for r in listed.orderBy("doc_idx").collect()] == [("a_claim.pdf", 0), ("b.dOcX", 1), ("c_invoice.docx", 2)]
    rows = files.decode(listed, False, "claim_id", "doc_idx").collect()
    good = [r for r in rows if r["doc_idx"] == 2 and r["kind"] != "break"]
    assert [(r["kind"], r["text"], r["page"]) for r in good] == [("text", "One two", 1), ("table", None, 1), ("text", "Next", 2)]
    assert good[1]["rows"] == [["a"]]
    assert all(r["error"] for r in rows if r["doc_idx"] != 2)
    files.write_by_claim(listed.select("claim_id", "name"), str(tmp_path / "out"), "overwrite")
    files.write_by_claim(listed.select("claim_id", "name"), str(tmp_path / "out"), "overwrite")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert files.manifest(spark, str(tmp_path / "out")).count() >= 1


def test_generators(spark):
    with pytest.raises(ValueError, match="no generator"):
        generate.get_generator("none")
    with pytest.raises(ConnectionError):
        generate.get_generator("local", base_url="http://127.0.0.1:9/v1/").generate("x")

    def answer(prompt):
        if "bad" in prompt:
            raise ValueError("no")
        return '```json\n{"a": {"value": "%s", "_page": 1}}\n```' % prompt

    docs = spark.createDataFrame([("c", 0, "good"), ("c", 1, "bad"), ("c", 2, "fine"), ("c", 3, "  ")], "claim_id string, doc_idx int, content string")
    kept = generate.succeeded(generate.extract(docs, generate.Stub(answer=answer), "{{document}}", "claim_id", "doc_idx"))
    assert [(r["doc_idx"], r["path"], r["value"]) for r in extract.leaves(kept, "extraction", "claim_id", "doc_idx").orderBy("doc_idx").collect()] == [(0, "a", "good"), (1, "a", "fine")]


def said(role):
    return f"{role}: x."


def test_folds(spark, tmp_path):
    rows = [("c", i, f"d{i}", said(r)) for i, r in enumerate(("user", "system", "assistant"))]
    docs = spark.createDataFrame(rows, "claim_id string, doc_idx int, doc string, content string")
    want = ["s/user: x.", "s/user: x.", "s/user: x./assistant: x."]
    out = ledger.fold(docs, plans.stub_update, "s").orderBy("doc_idx").collect()
    assert [(r["diary"], r["ledger"], r["error"]) for r in out] == [(want[0], "| 1 | said | - | 8 |", None), (want[1], None, "no answer"), (want[2], "| 1 | said | - | 13 |", None)]
    docs.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: stream_fold(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), plans.stub_update, "s")
    query = stream().writeStream.format("memory").queryName("folded").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r["diary"], r["ledger"]) for r in spark.table("folded").orderBy("doc").collect()] == [(r["diary"], r["ledger"]) for r in out]
    at = {k: str(tmp_path / k) for k in ("diary", "ledger", "check")}
    for _ in range(2):  # the second start finds nothing new
        store(stream(), at["diary"], at["ledger"], at["check"]).awaitTermination(120)
    assert [(r["claim_id"], r["diary"]) for r in spark.read.parquet(at["diary"]).collect()] == [("c", want[2])]
    docs.limit(1).select("claim_id", F.lit(3).alias("doc_idx"), F.lit("d3").alias("doc"), F.lit("user: y.").alias("content")).write.mode("append").parquet(str(tmp_path / "in"))
    store(stream(), at["diary"], at["ledger"], at["check"]).awaitTermination(120)
    assert [r["diary"] for r in spark.read.parquet(at["diary"]).collect()] == [want[2] + "/user: y."]
    assert [(r["doc"], r["new_value"]) for r in spark.read.parquet(at["ledger"]).orderBy("doc").collect()] == [("d0", "8"), ("d2", "13"), ("d3", "8")]


def test_answers_of_the_protocol():
    good = "Hello.\n<!-- BEGIN_DIARY -->\n# Diary\n<!-- END_DIARY -->\n\n<!--  begin_ledger_entry -->\n| 1 | Claim ID | - | C1 |\n<!-- END_LEDGER_ENTRY -->"
    assert ledger.updated(good) == ("# Diary", "| 1 | Claim ID | - | C1 |")
    assert ledger.updated("<!-- BEGIN_DIARY -->x<!-- END_DIARY -->") == ("x", "")
    for bad in (None, "", "nothing", "<!-- BEGIN_DIARY -->  <!-- END_DIARY -->", "<!-- BEGIN_LEDGER_ENTRY -->x<!-- END_LEDGER_ENTRY -->"):
        assert ledger.updated(bad) is None


def test_deep_leaves(spark):
    deep = {"value": "x", "_page": 1, "reason": None}
    for i in range(40):
        deep = {f"k{i}": deep, "none": None}
    d = spark.createDataFrame([(1, json.dumps(deep)), (2, "[1, 2]"), (3, "null"), (4, '"x"'), (5, "{}"), (6, None)], "id int, raw string").select("id", F.parse_json("raw").alias("v"))
    rows = extract.leaves(d, "v", "id").collect()
    assert [(r["id"], r["value"]) for r in rows if r["value"]] == [(1, "x")]
    assert len(rows) == 41
    assert max(r["path"].count(".") for r in rows) == 39


def test_leaves_of_a_wide_document_take_linear_time(spark):
    import time

    field = lambda i: f"""'"k' || {i} || '":{{"value":1,"_page":2,"reason":"r"}}'"""
    took = []
    for n in (1000, 10_000, 100_000):
        d = spark.range(1).selectExpr("id", f"parse_json('{{' || array_join(transform(sequence(1, {n}), i -> {field('i')}), ',') || '}}') AS v")
        begin = time.perf_counter()
        assert extract.leaves(d, "v", "id").where("value = '1' AND page = 2 AND reason = 'r'").count() == n
        took.append(time.perf_counter() - begin)
    assert took[2] < 20 * took[1]


@pytest.fixture
def claims(tmp_path):
    for claim, names in {"k1": ["a.docx", "b.docx", "broken.docx"], "k2": ["only.DOCX"], "k3": ["blank.docx"]}.items():
        (tmp_path / "claims" / claim).mkdir(parents=True)
        for name in names:
            (tmp_path / "claims" / claim / name).write_bytes(b"broken" if "broken" in name else docx(name != "blank.docx"))
    return str(tmp_path / "claims")


def test_chunks_of_documents(spark, claims):
    listed = files.list_claims(spark, claims)
    rows = [r for r in runs.parse(listed).orderBy("claim_id", "doc_idx", "page", "order").collect() if r["name"] == "a.docx"]
    assert [(r["page"], r["order"], r["chunk_type"], r["content"]) for r in rows] == [(1, 0, "text", "One two"), (1, 1, "table", "| a |\n| --- |"), (2, 0, "text", "Next")]
    assert (rows[1]["num_rows"], rows[1]["num_cols"], rows[1]["y1"] - rows[1]["y0"]) == (1, 1, 20.0)
    assert {r["content"] for r in runs.contents(listed).where("doc = 'a.docx'").collect()} == {"[Page 1]\nOne two\n\n[Page 1]\n| a |\n| --- |\n\n[Page 2]\nNext"}
    assert runs.contents(listed).where("claim_id = 'k3' OR doc = 'broken.docx'").isEmpty()
    one = runs.parse(listed.where("name = 'a.docx'"), "json").drop("claim_id", "doc_idx", "name")
    whole = json.loads(runs.as_document(one, "a.docx", "docx"))
    assert [c["content"] for c in whole["chunks"]] == ["One two", '[["a"]]', "Next"]


def test_chunks_of_layout(spark):
    """Words of a page become cleaned lines in order of height, broken up by tables and images."""
    rows = [("word", "low", 1, 40.0), ("word", "Hello", 1, 10.0), ("word", "World", 1, 11.0), ("word", "again", 1, 30.0), ("image", None, 1, 35.0), ("table", None, 1, 10.0), ("word", "page2", 2, 5.0)]
    made = [(f"d.{ext}", i, None, kind, word, [["x"], ["y", "z"]] if kind == "table" else None, b"i" if kind == "image" else None, 1.0, 2.0, 0, None, page, float(i), y, i + 1.0, y + 5) for ext in ("pdf",) for i, (kind, word, page, y) in enumerate(rows)]
    d = spark.createDataFrame(made, "name string, " + files.LAYOUT)
    got = layout.chunks(d, ["name"]).orderBy("page", "order").collect()
    assert [(r["page"], r["order"], r["chunk_type"], r["content"]) for r in got] == [(1, 0, "table", "| x |  |\n| --- | --- |\n| y | z |"), (1, 1, "text", "Hello World\nagain"), (1, 2, "image", None), (1, 3, "text", "low"), (2, 0, "text", "page2")]
    assert (got[0]["num_rows"], got[0]["num_cols"]) == (2, 2)
    assert (got[1]["y0"], got[1]["y1"], bytes(got[2]["image"])) == (10.0, 35.0, b"i")


def test_ingest(spark, claims, tmp_path):
    def model(prompt):
        if "Ledger of changes" in prompt:
            return "no table" if "seen" not in prompt else "<!-- BEGIN_SUMMARY -->\n| Field |\n<!-- END_SUMMARY -->"
        if "# Diary so far" in prompt:
            assert "[Page 1]\nOne two" in prompt and "{{" not in prompt
            seen = prompt.split("# Diary so far")[1].split("# New document")[0].count("seen")
            return f"<!-- BEGIN_DIARY -->{'seen ' * (seen + 1)}<!-- END_DIARY --><!-- BEGIN_LEDGER_ENTRY -->\n| 1 | Status | - | {seen} |\nno row\n<!-- END_LEDGER_ENTRY -->"
        raise ValueError("an unknown prompt")

    for _ in range(2):  # a second run starts afresh
        out = runs.ingest(spark, claims, generate.Stub(answer=model))
    assert out == str(tmp_path / "processed")
    state = files.read_state(spark, f"{out}/diary", "claim_id string, diary string")
    assert {r["claim_id"]: r["diary"] for r in state.collect()} == {"k1": "seen seen", "k2": "seen", "k3": prompts.template("diary")}
    rows = files.read_state(spark, f"{out}/ledger", runs.LEDGER_ROWS).orderBy("claim_id", "doc_idx").collect()
    assert [(r["claim_id"], r["doc"], r["field_name"], r["new_value"]) for r in rows] == [("k1", "a.docx", "Status", "0"), ("k1", "b.docx", "Status", "1"), ("k2", "only.DOCX", "Status", "0")]
    assert {r["claim_id"]: r["summary"] for r in files.read_state(spark, f"{out}/summary", "claim_id string, summary string").collect()} == {"k1": "| Field |", "k2": "| Field |"}  # k3's answer holds none
    assert files.read_state(spark, f"{out}/nothing", "claim_id string").isEmpty()
    # a claim whose files can't be read any more starts afresh, and nothing of its last run stays
    for name in ("a.docx", "b.docx"):
        (tmp_path / "claims" / "k1" / name).write_bytes(b"broken")
    runs.ingest(spark, claims, generate.Stub(answer=model))
    again = files.read_state(spark, f"{out}/diary", "claim_id string, diary string").collect()
    assert {r["claim_id"]: r["diary"] for r in again} == {"k1": prompts.template("diary"), "k2": "seen", "k3": prompts.template("diary")}
    assert {r["claim_id"] for r in files.read_state(spark, f"{out}/ledger", runs.LEDGER_ROWS).collect()} == {"k2"}


def test_read_texts(spark, tmp_path):
    for claim in ("k1", "k2"):
        (tmp_path / claim).mkdir()
        (tmp_path / claim / "diary.md").write_text(f"# {claim}\n\nline\n")
    rows = files.read_texts(spark, str(tmp_path / "*" / "diary.md")).orderBy("claim_id").collect()
    assert [tuple(r) for r in rows] == [(c, "diary.md", f"# {c}\n\nline\n") for c in ("k1", "k2")]


def test_extract_and_merge(spark, claims):
    calls = []

    def model(prompt):
        assert "general.claim_identification.claim_id (string)" in prompt
        calls.append(1)
        return '```json\n{"general": {"claim_identification": {"claim_id": {"reason": "r", "value": "C-1", "_page": 1}}}, "financials": {"payments_made": [{"date": "2024-05-01", "amount": "EUR 5", "description": "é", "_page": 2}]}, "_document": "?"}\n```'

    out = runs.extract_and_merge(spark, claims, generate.Stub(answer=model))
    per = {(r["claim_id"], r["doc"]): json.loads(r["json"]) for r in spark.read.parquet(f"{out}/extraction").collect()}
    assert {k: v["_document"] for k, v in per.items()} == {("k1", "a.docx"): "a.docx", ("k1", "b.docx"): "b.docx", ("k2", "only.DOCX"): "only.DOCX"}
    final = {r["claim_id"]: json.loads(r["value"]) for r in spark.read.text(f"{out}/final_claim").collect()}
    assert set(final) == {"k1", "k2"}
    field, paid = final["k1"]
    assert (field["field_name"], field["field_value"], field["source_documents"], field["confidence"]) == ("general.claim_identification.claim_id", "C-1", ["a.docx", "b.docx"], 1.0)
    assert json.loads(paid["field_value"]) == [{"date": "2024-05-01", "amount": "EUR 5", "description": "é", "_page": 2, "_source_document": "a.docx"}]


def test_questions(spark):
    d = spark.createDataFrame([(1, "the sky is blue"), (2, "nothing")], "id int, content string")
    got = runs.answer(d, generate.Stub(answer=lambda p: " blue\n" if "sky" in p.split("Context:")[1] else prompts.REFUSAL), "What colour?", "id").orderBy("id").collect()
    assert [(r["answer"], r["found"]) for r in got] == [("blue", True), (prompts.REFUSAL, False)]


def test_prompts():
    with pytest.raises(FileNotFoundError):
        prompts.load("none")
    assert prompts.template("none") == "# None\n"
    assert prompts.fill("{{a}} {{b}}", {"a": "{{b}}", "b": "x"}) == "x x"
    assert all(f"{{{{{key}}}}}" in prompts.load(name) for name, keys in {"update": ["diary", "document"], "summary": ["diary", "ledger"], "extraction": ["fields", "document"], "question": ["question", "context"]}.items() for key in keys)


def test_image_targets():
    ns = "xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main' xmlns:a='http://schemas.openxmlformats.org/drawingml/2006/main' xmlns:r='http://schemas.openxmlformats.org/officeDocument/2006/relationships' xmlns:wp='http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing'"
    drawing = lambda i: f"<w:r><w:drawing><wp:inline><wp:extent cx='914400' cy='457200'/><a:blip r:embed='i{i}'/></wp:inline></w:drawing></w:r>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body><w:p>{drawing(1)}{drawing(2)}{drawing(3)}</w:p></w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", "<Relationships xmlns='http://schemas.openxmlformats.org/package/2006/relationships'><Relationship Id='i1' Target='media/a.png'/><Relationship Id='i2' Target='/word/media/a.png'/><Relationship Id='i3' Target='gone.png'/></Relationships>")
        z.writestr("word/media/a.png", b"png")
    got = [x for x in files.decode_docx(out.getvalue()) if x["kind"] == "image"]
    assert [(x["image"], x["width"], x["height"], x["image_index"]) for x in got] == [(b"png", 72.0, 36.0, 0), (b"png", 72.0, 36.0, 1), (None, 72.0, 36.0, 2)]


def test_labels_and_warnings(spark, monkeypatch):
    assert repr(generate.Stub()) == "<Generator:stub>"
    row = registry.labels(spark).orderBy("ord").first()
    assert (row["field_label"], row["kind_label"]) == ("<Field:general.claim_identification.claim_id>", "<FieldType:string>")
    monkeypatch.delenv("MODEL_TOKEN", raising=False)
    with pytest.warns(UserWarning, match="MODEL_TOKEN"):
        generate.get_generator("hosted")


def test_outside_tables_against_all_pairs(spark):
    """Boxes of all sizes, flat, inverted, endless and missing ones: what stays is what comparing all pairs leaves, in far fewer comparisons."""
    draw = random.Random(3)
    edge = lambda: draw.choice([None, float("nan"), float("inf"), -float("inf"), 0.0, -0.0] + [float(draw.randint(-40, 40))] * 30)

    def box(most):
        if draw.random() < 0.1:
            return tuple(edge() for _ in range(4))
        x, y = draw.randint(-80, 80) / 2, draw.randint(-80, 80) / 2
        return x, y, x + draw.randint(0, most), y + draw.choice([0, 1, 2, most])

    schema = "page int, object_type string, x0 double, top double, x1 double, bottom double, id int"
    chars = spark.createDataFrame([(draw.randint(0, 4), draw.choice(["char"] * 5 + ["rect", None]), *box(draw.choice([2, 4, 200])), i) for i in range(1500)], schema)
    boxes = spark.createDataFrame([(draw.randint(0, 3), *box(draw.choice([3, 3, 3, 300]))) for _ in range(60)], "page int, x0 double, top double, x1 double, bottom double")
    pairs = chars.alias("o").join(boxes.alias("b"), F.expr("o.page = b.page AND o.x0 < b.x1 AND o.x1 > b.x0 AND o.top < b.bottom AND o.bottom > b.top AND o.object_type = 'char'"), "left_anti")
    wanted = {r["id"] for r in pairs.collect()}
    assert 100 < len(wanted) < 1400
    assert {r["id"] for r in layout.outside_tables(chars, boxes, ["page"]).collect()} == wanted
    pieces = layout._clipped(spark.range(5000).selectExpr("1 AS page", "id % 70 / 7.0D AS x0", "id % 71 / 7.0D AS top", "id % 70 / 7.0D + 8 AS x1", "id % 71 / 7.0D + 8 AS bottom").distinct(), ["page"], 4.0, 4.0)
    assert pieces.groupBy("cx", "cy").count().agg(F.max("count")).first()[0] < 1000
