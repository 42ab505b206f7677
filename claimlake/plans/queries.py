"""Queries over the operators. Inputs are derived by one SQL text that Spark and the checking engine both read."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import prompts
from ..functions import normalize, registry, tables, text
from ..operators import extract, generate, layout, ledger, merge
from ..retrieval import queries as retrieval
from ..sources import files, scratch
from . import runs

TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@dataclass
class Query:
    """``derive`` makes the input d in both engines; ``run`` is the operator, ``check`` the SQL for its result.

    With ``spread`` a table that is read in fewer splits than there are cores is dealt out first: for work that costs far
    more than a row's way through a shuffle. Larger tables are left as they are.
    """

    derive: str
    run: Callable[[DataFrame], DataFrame]
    check: str | None = None
    spread: bool = False

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        sql = self.derive
        for t in TABLES:
            if re.search(rf"\bFROM {t}\b", sql):
                read, cores = spark.read.parquet(f"{sf_dir}/{t}.parquet"), spark.sparkContext.defaultParallelism
                read = read.repartition(cores) if self.spread and read.rdd.getNumPartitions() < cores else read
                read.createOrReplaceTempView(f"claimlake_{t}")
                sql = re.sub(rf"\bFROM {t}\b", f"FROM claimlake_{t}", sql)
        return self.run(spark.sql(sql))

    def oracle(self) -> str | None:
        return self.check and f"WITH d AS ({self.derive}) {self.check}"


def joined(c, sep: str = ",") -> F.Column:
    return F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("-"))), sep)


MERGE_IN = """
SELECT claim_id, doc_idx, 'doc' || CAST(doc_idx AS STRING) AS doc, path, value, page, 'r' || CAST(event_id AS STRING) AS reason FROM (
 SELECT user_id % 10 AS claim_id, CAST(dense_rank() OVER (PARTITION BY user_id % 10 ORDER BY CAST(ts AS DATE)) - 1 AS INT) AS doc_idx, event_id,
  event_type || '.' || CAST(row_number() OVER (PARTITION BY user_id % 10, CAST(ts AS DATE), event_type ORDER BY event_id DESC) AS STRING) AS path,
  CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 3 = 0 THEN '  BAND ' || CAST(event_id % 4 AS STRING) || ' ' ELSE 'band ' || CAST(event_id % 4 AS STRING) END AS value,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 9 AS INT) END AS page
 FROM events)"""

MERGE_OUT = """
, n AS (SELECT claim_id, count(DISTINCT doc_idx) AS n FROM d GROUP BY claim_id),
c AS (SELECT claim_id, path, lower(trim(value)) AS norm, max(doc_idx) AS last, min(doc_idx) AS first, count(*) AS size, arg_max(value, doc_idx) AS v, arg_max(reason, doc_idx) AS r,
  string_agg(doc, ',' ORDER BY doc_idx) AS docs, string_agg(coalesce(CAST(page AS STRING), '-'), ',' ORDER BY doc_idx) AS pages FROM d WHERE value IS NOT NULL GROUP BY ALL),
s AS (SELECT c.*, 0.6::DOUBLE * (CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE last::DOUBLE / (n - 1) END) + 0.4::DOUBLE * (size::DOUBLE / n) AS score FROM c JOIN n USING (claim_id)),
w AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY claim_id, path ORDER BY score DESC, first) = 1)
SELECT p.claim_id, p.path AS field_name, r AS reason, v AS field_value, coalesce(docs, '') AS source_documents, coalesce(pages, '') AS pages, coalesce(round_even(score, 3), 0.0) AS confidence
FROM (SELECT DISTINCT claim_id, path FROM d) p LEFT JOIN w USING (claim_id, path)"""


def merge_fields(d: DataFrame) -> DataFrame:
    out = merge.merge_fields(d, d.select("claim_id", "doc_idx").distinct())
    return out.withColumns({"source_documents": joined("source_documents"), "pages": joined("pages")})


def final_json(d: DataFrame) -> DataFrame:
    fields = merge.merge_fields(d, d.select("claim_id", "doc_idx").distinct())
    return merge.as_json(merge.final_claim(fields, d.limit(0).select("claim_id", "doc_idx", "doc", F.lit(0).alias("pos"), *[F.lit("").alias(c) for c in ("date", "amount", "description")], "page")))


def document_chunks(d: DataFrame) -> DataFrame:
    """Layout rows of three kinds as ordered chunks; a text's turns in a row are one."""
    rows = F.array(F.array("role", F.col("seq").cast("string")), F.array(F.lit("x|y"), F.lit(None).cast("string")))
    shown = d.withColumns({"pos": F.col("seq"), "rows": rows, "image": F.lit(b"i"), "width": F.lit(1.0), "height": F.lit(2.0), "image_index": F.lit(0)})
    return layout.chunks(shown, ["doc"]).select("doc", "page", "order", "chunk_type", "content", "x0", "y0", "x1", "y1")


def growing_merge(d: DataFrame) -> DataFrame:
    """The merge of all documents, added in three batches that are not in their order."""
    growing = merge.Merge(d.sparkSession, scratch.fresh(d.sparkSession, "growing-merge"), kind="bigint")
    for batch in (2, 0, 1):
        mine = d.where(F.col("doc_idx") % 3 == batch)
        growing.add(mine, mine)
    return growing.fields().withColumns({"source_documents": joined("source_documents"), "pages": joined("pages")})


def stored_answers(d: DataFrame) -> DataFrame:
    """Answers that are asked for twice: the second time only what failed is."""
    answers = generate.Answers(d.sparkSession, scratch.fresh(d.sparkSession, "stored-answers"), pause=0.0)
    answers.ask(d, generate.Stub(answer=reply), "prompt", "id", "turn")
    return answers.ask(d, generate.Stub(answer=reply), "prompt", "id", "turn")


def final_claim(d: DataFrame) -> DataFrame:
    fields = merge.merge_fields(d, d.select("claim_id", "doc_idx").distinct())
    amount = F.concat(F.lit("EUR "), (F.col("event_id") % 40).cast("string"))
    paid = d.where("event_id % 11 = 0").select("claim_id", "doc_idx", "doc", F.col("event_id").alias("pos"), F.lit("2024-05-01").alias("date"), amount.alias("amount"), F.lit(None).cast("string").alias("description"), "page")
    return merge.final_claim(fields, paid).select("claim_id", "ord", "field_name", "field_value", joined("source_documents").alias("source_documents"), "confidence")


DATES_IN = """
SELECT o_orderkey AS id, CASE CAST(o_orderkey % 12 AS INT)
 WHEN 0 THEN y || '-' || m || '-' || dd WHEN 1 THEN dd || '.' || m || '.' || y WHEN 2 THEN dd || '/' || m || '/' || y WHEN 3 THEN m || '/' || dd || '/' || y WHEN 4 THEN dd || '-' || m || '-' || y
 WHEN 5 THEN month || ' ' || dd || ', ' || y WHEN 6 THEN dd || '  ' || month || ' ' || y WHEN 7 THEN substr(month, 1, 3) || ' ' || dd || ', ' || y WHEN 8 THEN '  ' || dd || ' ' || substr(month, 1, 3) || ' ' || y
 WHEN 9 THEN y || lpad(m, 2, '0') || lpad(dd, 2, '0') WHEN 10 THEN '31/02/' || y ELSE NULL END AS raw FROM (
 SELECT o_orderkey, CAST(year(o_orderdate) AS STRING) AS y, CAST(month(o_orderdate) AS STRING) AS m, CAST(day(o_orderdate) AS STRING) AS dd,
  CASE CAST(month(o_orderdate) AS INT) WHEN 1 THEN 'January' WHEN 2 THEN 'february' WHEN 3 THEN 'March' WHEN 4 THEN 'April' WHEN 5 THEN 'May' WHEN 6 THEN 'JUNE' WHEN 7 THEN 'July' WHEN 8 THEN 'August' WHEN 9 THEN 'September' WHEN 10 THEN 'October' WHEN 11 THEN 'November' ELSE 'December' END AS month
 FROM orders)"""
DATES_OUT = """SELECT id, coalesce(strftime(try_strptime(regexp_replace(trim(raw), '\\s+', ' ', 'g'), ['%Y-%m-%d', '%d.%m.%Y', '%d/%m/%Y', '%m/%d/%Y', '%d-%m-%Y', '%B %d, %Y', '%d %B %Y', '%b %d, %Y', '%d %b %Y', '%Y%m%d']), '%Y-%m-%d'), trim(raw)) AS value FROM d"""

MONEY_IN = """
SELECT o_orderkey AS id, CASE CAST(o_orderkey % 9 AS INT) WHEN 0 THEN 'EUR ' || whole WHEN 1 THEN '€' || whole || '.50' WHEN 2 THEN whole || ' USD' WHEN 3 THEN '£ ' || substr(whole, 1, 1) || ',' || substr(whole, 2, 9)
 WHEN 4 THEN whole || '.25 CHF' WHEN 5 THEN '$' || whole || '.99 total' WHEN 6 THEN 'about ' || whole WHEN 7 THEN '  ABCD 00' || whole || ' ' ELSE NULL END AS raw
FROM (SELECT o_orderkey, CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) AS whole FROM orders)"""
MONEY_OUT = r"""
, m AS (SELECT id, trim(raw) AS s, '(?:([A-Z]{3})|([€$£¥₹]))\s*(\d[\d,.''\s]*)' AS p, '(\d[\d,.''\s]*)\s*([A-Z]{3})' AS q FROM d),
g AS (SELECT id, s, regexp_matches(s, p) AS front, regexp_matches(s, q) AS back, regexp_extract(s, p, 1) AS c1, regexp_extract(s, p, 2) AS sy, regexp_extract(s, p, 3) AS a1, regexp_extract(s, q, 1) AS a2, regexp_extract(s, q, 2) AS c2 FROM m),
a AS (SELECT id, s, front OR back AS hit, CASE WHEN front AND c1 <> '' THEN c1 WHEN front THEN CASE sy WHEN '€' THEN 'EUR' WHEN '$' THEN 'USD' WHEN '£' THEN 'GBP' WHEN '¥' THEN 'JPY' ELSE 'INR' END ELSE c2 END AS code,
  regexp_replace(regexp_replace(CASE WHEN front THEN a1 ELSE a2 END, '[.,]\d{1,2}$', ''), '[^\d]', '', 'g') AS digits FROM g)
SELECT id, CASE WHEN hit THEN code || ' ' || ltrim(digits, '0') ELSE s END AS value FROM a"""

TEXT_IN = """SELECT doc_id AS id, chr(9) || '  ' || text || chr(10) || chr(10) || chr(10) || chr(10) || 'broken-' || chr(10) || 'word gluedWords' || '  end  ' || chr(10) AS raw FROM documents"""
CLEAN_OUT = r"""
, a AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), '([\p{L}\p{N}_])-\s*\n\s*([\p{L}\p{N}_])', '\1\2', 'g'), '([a-zäöüß])([A-ZÄÖÜ])', '\1 \2', 'g') AS t FROM d)
SELECT id, trim(array_to_string(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ' || chr(9))), chr(10)), ' ' || chr(9) || chr(10)) AS value FROM a"""

CELLS_IN = """SELECT l_orderkey AS id, l_linenumber AS n, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE CAST(l_partkey AS STRING) || '|' || CAST(l_suppkey AS STRING) END AS a, ' ' || l_returnflag || chr(10) || l_linestatus AS b, l_linenumber % 3 = 1 AS short FROM lineitem"""
CELLS_IN = CELLS_IN.replace("l_linenumber AS n,", "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS n,")


def table_rows(d: DataFrame) -> DataFrame:
    row = F.when(F.col("short"), F.array("a")).otherwise(F.array("a", "b"))
    return d.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", row.alias("r")))), lambda x: x["r"]).alias("rows"))


CELLS_CTE = r""", r AS (SELECT id, n, max(CASE WHEN short THEN 1 ELSE 2 END) OVER (PARTITION BY id) AS w, trim(replace(replace(coalesce(a, ''), '|', '\|'), chr(10), ' ')) AS a, CASE WHEN short THEN '' ELSE trim(replace(b, chr(10), ' ')) END AS b, row_number() OVER (PARTITION BY id ORDER BY n) AS k FROM d)"""

TALK_IN = """SELECT doc, seq, CASE WHEN role = 'system' THEN 'table' WHEN seq % 5 = 4 THEN 'image' ELSE 'text' END AS chunk_type, CAST(1 + floor(seq / 4.0) AS INT) AS page, text AS content,
 CAST(seq AS DOUBLE) AS x0, CAST(seq * 2 AS DOUBLE) AS y0, CAST(seq + 5 AS DOUBLE) AS x1, CAST(seq * 2 + 1 AS DOUBLE) AS y1
FROM (SELECT conv_id AS doc, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INT) AS seq, role, text FROM conversations)"""

BOX_IN = """SELECT l_orderkey % 50 AS page, l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber = 7 THEN 'rect' ELSE 'char' END AS object_type, CAST(l_partkey % 600 AS DOUBLE) AS x0, CAST(l_suppkey % 700 AS DOUBLE) AS top, CAST(l_partkey % 600 + 8 AS DOUBLE) AS x1, CAST(l_suppkey % 700 + 10 AS DOUBLE) AS bottom, CASE WHEN l_linenumber = 1 AND l_orderkey % 7 = 0 THEN 1 ELSE 0 END AS box FROM lineitem"""


def bbox_mask(d: DataFrame) -> DataFrame:
    boxes = d.where("box = 1").select("page", "x0", "top", (F.col("x1") + 90).alias("x1"), (F.col("bottom") + 30).alias("bottom"))
    return layout.outside_tables(d, boxes, ["page"]).select("id", "page", "object_type")


LINES_IN = """SELECT user_id AS doc, event_id AS ordinal, event_type AS text, CAST(event_id % 500 AS DOUBLE) AS x0, CAST(event_id % 90 AS DOUBLE) / 2 AS top, CAST(event_id % 500 + 10 AS DOUBLE) AS x1, CAST(event_id % 90 AS DOUBLE) / 2 + 8 AS bottom FROM events"""

LINES_OUT = """
, w AS (SELECT doc, list([{top: top, text: text, x0: x0, up: top, x1: x1, bottom: bottom, n: 1}] ORDER BY ordinal) AS words FROM d GROUP BY doc),
l AS (SELECT doc, list_reduce(words, lambda a, x: CASE WHEN len(list_filter(a, lambda l: abs(l.top - x[1].top) <= 2.0)) = 0 THEN list_concat(a, x)
  ELSE list_transform(a, lambda l, i: CASE WHEN i = list_position(list_transform(a, lambda m: abs(m.top - x[1].top) <= 2.0), true)
   THEN {top: l.top, text: l.text || ' ' || x[1].text, x0: least(l.x0, x[1].x0), up: least(l.up, x[1].up), x1: greatest(l.x1, x[1].x1), bottom: greatest(l.bottom, x[1].bottom), n: l.n + 1} ELSE l END) END) AS lines FROM w),
u AS (SELECT doc, unnest(lines) AS v, unnest(range(len(lines))) AS line FROM l)
SELECT doc, CAST(line AS INT) AS line, v.text AS text, v.x0 AS x0, v.up AS top, v.x1 AS x1, v.bottom AS bottom, v.n AS n_words FROM u"""

SECTIONS_IN = """SELECT doc_id AS id, 'x <!-- BEGIN_DIARY -->' || chr(10) || 'old' || chr(10) || '<!-- END_DIARY --> <!-- ' || CASE WHEN doc_id % 2 = 0 THEN 'begin_diary' ELSE 'BEGIN_DIARY' END || ' --> ' || text || ' <!--END_DIARY-->' || CASE WHEN doc_id % 3 = 0 THEN '<!-- BEGIN_LEDGER_ENTRY --> | 1 | a | - | b | <!-- END_LEDGER_ENTRY -->' WHEN doc_id % 3 = 1 THEN '<!-- BEGIN_LEDGER_ENTRY --> cut <!-- END_OTHER -->' ELSE '' END AS raw FROM documents"""

LEDGER_IN = """SELECT o_custkey % 100 AS claim_id, o_orderkey AS doc_idx, CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN '| 1 | Status | - | ' || o_orderstatus || ' |' WHEN 1 THEN ' 2 | Priority | ' || o_orderpriority || ' | ' || o_orderstatus || '  ' WHEN 2 THEN '| 3 | only | three |' WHEN 3 THEN '| a | b | c | d | e |' WHEN 4 THEN '|| A | - | B |' ELSE 'no cells' END || chr(10) || '| 9 | Total | - | x' || CAST(o_orderkey AS STRING) || ' |' AS ledger FROM orders"""

STATUS_IN = """SELECT o_custkey AS claim_id, 'status' AS field, o_orderkey AS seq, CAST(CAST(o_orderdate AS DATE) AS STRING) AS day, o_orderstatus AS value FROM orders UNION ALL SELECT o_custkey, 'priority', o_orderkey, CAST(CAST(o_orderdate AS DATE) AS STRING), CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END FROM orders"""
CHANGES = """, l AS (SELECT claim_id, field, seq, day, lag(value) OVER (PARTITION BY claim_id, field ORDER BY day, seq) AS old_value, value AS new_value FROM d), c AS (SELECT * FROM l WHERE old_value IS DISTINCT FROM new_value)"""

PAY_IN = """SELECT o_custkey % 200 AS claim_id, CAST(o_orderkey AS INT) AS doc_idx, 'doc' || CAST(o_orderkey AS STRING) AS doc, 0 AS pos, CASE WHEN o_orderkey % 2 = 0 THEN '2024-0' || CAST(o_orderkey % 3 + 1 AS STRING) || '-05' ELSE '05.0' || CAST(o_orderkey % 3 + 1 AS STRING) || '.2024' END AS date, CASE WHEN o_orderkey % 5 = 0 THEN 'EUR 500' WHEN o_orderkey % 5 = 1 THEN '€500' ELSE CAST(o_orderkey % 4 AS STRING) || '00 EUR' END AS amount, o_orderstatus AS description, CAST(o_orderkey % 7 AS INT) AS page FROM orders"""
PAY_OUT = """, k AS (SELECT *, substr(CASE WHEN date LIKE '2024-%' THEN date ELSE substr(date, 7, 4) || '-' || substr(date, 4, 2) || '-' || substr(date, 1, 2) END, 1, 10) AS dk, CASE WHEN amount LIKE '%500' THEN 'eur 500' ELSE 'eur ' || coalesce(nullif(ltrim(regexp_replace(amount, '[^0-9]', '', 'g'), '0'), ''), '0') END AS ak FROM d)
SELECT claim_id, doc_idx, doc, pos, date, amount, description, page FROM k QUALIFY row_number() OVER (PARTITION BY claim_id, dk, ak ORDER BY doc_idx, pos) = 1"""

FILES_IN = """SELECT doc_id % 20 AS claim_id, CASE WHEN doc_id % 3 = 0 THEN upper(source) ELSE source END || '_' || CAST(doc_id AS STRING) || CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' WHEN 2 THEN '.docx' WHEN 3 THEN '.txt' ELSE '' END AS name FROM documents"""

REGISTERED_IN = f"""
SELECT claim_id, doc_idx, 'doc' || CAST(doc_idx AS STRING) AS doc, page, 'r' || CAST(event_id AS STRING) AS reason, canon,
 CASE n WHEN 1 THEN '{registry.FIELDS[2][0]}' WHEN 2 THEN '{registry.FIELDS[17][0]}' ELSE '{registry.FIELDS[9][0]}' END AS path,
 CASE n WHEN 1 THEN CASE form WHEN 0 THEN canon WHEN 1 THEN '0' || CAST(k AS STRING) || '.03.2026' ELSE 'March ' || CAST(k AS STRING) || ', 2026' END
  WHEN 2 THEN CASE form WHEN 0 THEN 'EUR 12,65' || CAST(k AS STRING) WHEN 1 THEN '€12.65' || CAST(k AS STRING) || ',00' ELSE '1265' || CAST(k AS STRING) || ' EUR' END
  ELSE CASE form WHEN 0 THEN ' Gate  ' || CAST(k AS STRING) WHEN 1 THEN 'gate ' || CAST(k AS STRING) || ' ' ELSE 'GATE ' || CAST(k AS STRING) END END AS value
FROM (SELECT *, CASE n WHEN 1 THEN '2026-03-0' || CAST(k AS STRING) WHEN 2 THEN 'eur 1265' || CAST(k AS STRING) ELSE 'gate ' || CAST(k AS STRING) END AS canon FROM (
 SELECT user_id % 10 AS claim_id, CAST(dense_rank() OVER (PARTITION BY user_id % 10 ORDER BY CAST(ts AS DATE)) - 1 AS INT) AS doc_idx, event_id, CAST(1 + event_id % 4 AS INT) AS k, CAST(event_id % 3 AS INT) AS form,
  CAST(row_number() OVER (PARTITION BY user_id % 10, CAST(ts AS DATE) ORDER BY event_id) AS INT) AS n, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 9 AS INT) END AS page
 FROM events) AS e WHERE n <= 3) AS f"""

FINAL_JSON_OUT = MERGE_OUT.replace("SELECT p.claim_id,", ", m AS (SELECT p.claim_id,") + """)
SELECT claim_id, '[' || string_agg('{"field_name":"' || field_name || '","reason":' || coalesce('"' || reason || '"', 'null') || ',"field_value":' || coalesce('"' || field_value || '"', 'null') || ',"source_documents":'
 || CASE WHEN source_documents = '' THEN '[]' ELSE '["' || replace(source_documents, ',', '","') || '"]' END || ',"pages":[' || replace(pages, '-', 'null') || '],"confidence":' || CAST(confidence AS VARCHAR) || '}', ',' ORDER BY field_name) || ']' AS json
FROM m GROUP BY claim_id"""

LAYOUT_IN = """SELECT doc, seq, role, CASE WHEN role = 'system' THEN 'table' WHEN seq % 5 = 4 THEN 'image' ELSE 'text' END AS kind, CAST(1 + floor(seq / 4.0) AS INT) AS page, '  turn ' || CAST(seq AS STRING) || ' by  ' || role AS text,
 CAST(seq AS DOUBLE) AS x0, CAST(seq * 2 AS DOUBLE) AS y0, CAST(seq + 5 AS DOUBLE) AS x1, CAST(seq * 2 + 1 AS DOUBLE) AS y1
FROM (SELECT conv_id AS doc, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INT) AS seq, role, text FROM conversations)"""
LAYOUT_OUT = """, s AS (SELECT *, CASE kind WHEN 'text' THEN 'turn ' || seq || ' by ' || role WHEN 'table' THEN '| system | ' || seq || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| x\\|y |  |' END AS c,
  CASE WHEN kind <> 'text' OR lag(kind) OVER w IS DISTINCT FROM 'text' OR lag(page) OVER w <> page THEN 1 ELSE 0 END AS start FROM d WINDOW w AS (PARTITION BY doc ORDER BY seq)),
i AS (SELECT *, sum(start) OVER (PARTITION BY doc ORDER BY seq) AS island FROM s),
g AS (SELECT doc, island, min(page) AS page, min(kind) AS chunk_type, string_agg(c, chr(10) ORDER BY seq) AS content, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM i GROUP BY doc, island)
SELECT doc, page, CAST(row_number() OVER (PARTITION BY doc, page ORDER BY island) - 1 AS INT) AS "order", chunk_type, content, x0, y0, x1, y1 FROM g"""

JSON_IN = """SELECT event_id AS id, CASE CAST(event_id % 4 AS INT) WHEN 0 THEN '```json' || chr(10) || '{"v": ' || CAST(event_id AS STRING) || '}' || chr(10) || '```' WHEN 1 THEN '```' || '{"v": ' || CAST(event_id AS STRING) || '}```' WHEN 2 THEN '  {"v": ' || CAST(event_id AS STRING) || '} ' ELSE 'sorry {"v": 1' END AS raw FROM events"""

LEAF_IN = """SELECT o_orderkey AS id, '{"general": ' || CASE WHEN o_orderkey % 5 = 0 THEN 'null' ELSE '{"status": {"reason": "r", "value": "' || o_orderstatus || '", "_page": ' || CAST(o_orderkey % 9 AS STRING) || '}, "_skip": {"value": "x", "_page": 1}, "cause": {"value": null, "reason": null, "_page": null}}' END || ', "odd": {"value": "y", "note": null}, "list": [1, 2], "financials": {"payments_made": [], "reserves": {"total": {"value": ' || CAST(o_orderkey AS STRING) || ', "_page": null, "reason": "t"}}}, "_document": "d"}' AS raw FROM orders"""
LEAF_OUT = """
SELECT id, 'general' AS path, NULL::VARCHAR AS reason, NULL::VARCHAR AS value, NULL::VARCHAR AS page FROM d WHERE id % 5 = 0
UNION ALL SELECT id, 'general.status', raw->'general'->'status'->>'reason', raw->'general'->'status'->>'value', raw->'general'->'status'->>'_page' FROM d WHERE id % 5 <> 0
UNION ALL SELECT id, 'general.cause', NULL, NULL, NULL FROM d WHERE id % 5 <> 0
UNION ALL SELECT id, 'odd.note', NULL, NULL, NULL FROM d
UNION ALL SELECT id, 'financials.reserves.total', 't', raw->'financials'->'reserves'->'total'->>'value', NULL FROM d"""

REGISTRY_IN = "SELECT o_orderkey AS id, CASE CAST(o_orderkey % 39 AS INT) " + " ".join(f"WHEN {i} THEN '{name}'" for i, (name, _) in enumerate(registry.FIELDS)) + " WHEN 37 THEN 'extra.note' END AS path FROM orders"
REGISTRY_OUT = ", f AS (SELECT * FROM (VALUES " + ", ".join(f"('{name}', '{kind}')" for name, kind in registry.FIELDS) + ") AS t(path, kind)) SELECT id, path, coalesce(kind, 'string') AS kind FROM d LEFT JOIN f USING (path)"

QUERIES: dict[str, Query] = {
    "merge_fields": Query(MERGE_IN, merge_fields, MERGE_OUT),
    "leaf_walk": Query(LEAF_IN, lambda d: extract.leaves(d.select("id", F.parse_json("raw").alias("v")), "v", "id").withColumn("page", F.col("page").cast("string")), LEAF_OUT, spread=True),
    "normalize_string": Query(TEXT_IN, lambda d: d.select("id", text.strip(F.col("raw")).alias("value")), "SELECT id, trim(raw, ' ' || chr(9) || chr(10)) AS value FROM d"),
    "normalize_narrative": Query(TEXT_IN, lambda d: d.select("id", normalize.narrative(F.col("raw")).alias("value")), r"SELECT id, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS value FROM d"),
    "normalize_date": Query(DATES_IN, lambda d: d.select("id", normalize.date(F.col("raw")).alias("value")), DATES_OUT),
    "normalize_currency": Query(MONEY_IN, lambda d: d.select("id", normalize.currency(F.col("raw")).alias("value")), MONEY_OUT),
    "normalize_enum": Query(
        "SELECT c_custkey AS id, CASE CAST(c_custkey % 6 AS INT) WHEN 0 THEN ' RES ' WHEN 1 THEN 'Commercial Property' WHEN 2 THEN 'ind' WHEN 3 THEN c_mktsegment WHEN 4 THEN 'comm' ELSE NULL END AS raw FROM customer",
        lambda d: d.select("id", normalize.enum(F.col("raw")).alias("value")),
        "SELECT id, CASE lower(trim(raw)) WHEN 'res' THEN 'residential' WHEN 'commercial property' THEN 'commercial' WHEN 'comm' THEN 'commercial' WHEN 'ind' THEN 'industrial' ELSE lower(trim(raw)) END AS value FROM d",
    ),
    "compare_matrix": Query(
        "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE ' ' || c_mktsegment END AS a, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) || ' ' ELSE c_name END AS b FROM customer",
        lambda d: d.select("id", *[normalize.same(k, F.col("a"), F.col("b")).alias(k) for k in ("string", "narrative", "date", "currency", "enum")]),
        "SELECT id, lower(trim(a)) IS NOT DISTINCT FROM lower(trim(b)) AS string, lower(trim(a)) IS NOT DISTINCT FROM lower(trim(b)) AS narrative, trim(a) IS NOT DISTINCT FROM trim(b) AS date, trim(a) IS NOT DISTINCT FROM trim(b) AS currency, lower(trim(a)) IS NOT DISTINCT FROM lower(trim(b)) AS enum FROM d",
    ),
    "clean_text": Query(TEXT_IN, lambda d: d.select("id", text.clean_text(F.col("raw")).alias("value")), CLEAN_OUT),
    "table_markdown": Query(
        CELLS_IN,
        lambda d: table_rows(d).select("id", tables.width(F.col("rows")).alias("width"), tables.to_markdown(F.col("rows")).alias("value")),
        CELLS_CTE + r""" SELECT id, CAST(max(w) AS INT) AS width, string_agg('| ' || a || CASE WHEN w = 2 THEN ' | ' || b ELSE '' END || ' |' || CASE WHEN k = 1 THEN chr(10) || CASE WHEN w = 2 THEN '| --- | --- |' ELSE '| --- |' END ELSE '' END, chr(10) ORDER BY k) AS value FROM r GROUP BY id""",
    ),
    "table_json": Query(
        CELLS_IN,
        lambda d: table_rows(d).select("id", tables.to_json(F.col("rows")).alias("value")),
        "SELECT id, CAST(to_json(list(CASE WHEN short THEN [a] ELSE [a, b] END ORDER BY n)) AS VARCHAR) AS value FROM d GROUP BY id",
    ),
    "merge_text_runs": Query(
        TALK_IN,
        lambda d: layout.merge_text_runs(d),
        ", s AS (SELECT *, CASE WHEN chunk_type <> 'text' OR lag(chunk_type) OVER w IS DISTINCT FROM 'text' OR lag(page) OVER w <> page THEN 1 ELSE 0 END AS start FROM d WINDOW w AS (PARTITION BY doc ORDER BY seq)), i AS (SELECT *, sum(start) OVER (PARTITION BY doc ORDER BY seq) AS island FROM s) SELECT doc, min(page) AS page, min(chunk_type) AS chunk_type, min(seq) AS seq, string_agg(coalesce(content, ''), chr(10) ORDER BY seq) AS content, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM i GROUP BY doc, island",
    ),
    "page_content": Query(
        TALK_IN,
        lambda d: layout.content(layout.ordered(d), page_tags=True),
        "SELECT doc, string_agg('[Page ' || CAST(page AS STRING) || ']' || chr(10) || content, chr(10) || chr(10) ORDER BY page, y0, CASE chunk_type WHEN 'table' THEN 0 WHEN 'text' THEN 1 ELSE 2 END, seq) AS content FROM d WHERE chunk_type IN ('text', 'table') AND content <> '' GROUP BY doc",
    ),
    "chunk_order": Query(
        TALK_IN.replace("CAST(seq * 2 AS DOUBLE)", "CAST(seq % 2 AS DOUBLE)"),
        lambda d: layout.ordered(d).select("doc", "page", "seq", "order"),
        """SELECT doc, page, seq, CAST(row_number() OVER (PARTITION BY doc, page ORDER BY y0, CASE chunk_type WHEN 'table' THEN 0 WHEN 'text' THEN 1 ELSE 2 END, seq) - 1 AS INT) AS "order" FROM d""",
    ),
    "page_counter": Query(
        "SELECT doc, pos, pos % 3 = 2 AS has_break FROM (SELECT conv_id AS doc, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos FROM conversations)",
        lambda d: layout.page_numbers(d).select("doc", F.col("pos").cast("long").alias("pos"), "page"),
        "SELECT doc, pos::BIGINT AS pos, 1 + sum(CASE WHEN has_break THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS page FROM d",
    ),
    "bbox_mask": Query(
        BOX_IN,
        bbox_mask,
        "SELECT id, page, object_type FROM d o WHERE object_type <> 'char' OR NOT EXISTS (SELECT 1 FROM d b WHERE b.box = 1 AND b.page = o.page AND o.x0 < b.x1 + 90 AND o.x1 > b.x0 AND o.top < b.bottom + 30 AND o.bottom > b.top)",
    ),
    "line_cluster": Query(LINES_IN, lambda d: layout.cluster_lines(d, ["doc"]), LINES_OUT),
    "chunk_counts": Query(
        TALK_IN,
        lambda d: layout.chunk_counts(d, "doc", "page"),
        "SELECT doc, page, count(*) FILTER (chunk_type = 'text') AS n_text, count(*) FILTER (chunk_type = 'table') AS n_table, count(*) FILTER (chunk_type = 'image') AS n_image FROM d GROUP BY doc, page",
    ),
    "section_extract": Query(
        SECTIONS_IN,
        lambda d: d.select("id", text.sections(F.col("raw")).alias("s"), text.first_section(F.col("raw"), "DIARY").alias("first")).select("id", F.try_element_at("s", F.lit("DIARY")).alias("diary"), F.try_element_at("s", F.lit("LEDGER_ENTRY")).alias("ledger"), "first"),
        r"""SELECT id, trim(list_extract(regexp_extract_all(raw, '(?is)<!--\s*BEGIN_DIARY\s*-->(.*?)<!--\s*END_DIARY\s*-->', 1), -1), ' ' || chr(10) || chr(9)) AS diary, trim(list_extract(regexp_extract_all(raw, '(?is)<!--\s*BEGIN_LEDGER_ENTRY\s*-->(.*?)<!--\s*END_LEDGER_ENTRY\s*-->', 1), -1)) AS ledger, trim(regexp_extract(raw, '(?is)<!--\s*BEGIN_DIARY\s*-->(.*?)<!--\s*END_DIARY\s*-->', 1), ' ' || chr(10)) AS first FROM d""",
    ),
    "ledger_parse": Query(
        LEDGER_IN,
        lambda d: ledger.parse_ledger(d, "ledger", "claim_id", "doc_idx"),
        r""", l AS (SELECT claim_id, doc_idx, unnest(string_split(ledger, chr(10))) AS raw, unnest(range(len(string_split(ledger, chr(10))))) AS line FROM d), c AS (SELECT *, string_split(trim(trim(raw), '|'), '|') AS cells FROM l WHERE contains(raw, '|'))
        SELECT claim_id, doc_idx, CAST(line AS INT) AS line, trim(cells[1]) AS page, trim(cells[2]) AS field_name, trim(cells[3]) AS old_value, trim(cells[4]) AS new_value FROM c WHERE len(cells) = 4""",
    ),
    "ledger_changes": Query(STATUS_IN, lambda d: ledger.changes(d, "claim_id", "field", ["day", "seq"]), CHANGES + " SELECT * FROM c"),
    "latest_per_field": Query(
        STATUS_IN,
        lambda d: ledger.latest(ledger.changes(d, "claim_id", "field", ["day", "seq"]), "claim_id", "field", ["day", "seq"]),
        CHANGES + " SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY claim_id, field ORDER BY day DESC, seq DESC) = 1",
    ),
    "claim_summary": Query(
        STATUS_IN,
        lambda d: ledger.summary(d.select("claim_id", "field").distinct(), ledger.changes(d, "claim_id", "field", ["day", "seq"]).withColumns({"document": F.concat(F.lit("doc"), F.col("seq")), "page": F.when(F.col("seq") % 2 == 0, F.col("seq") % 9)}), "claim_id", "field", ["day", "seq"]),
        CHANGES + ", z AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY claim_id, field ORDER BY day DESC, seq DESC) = 1) SELECT p.claim_id, p.field, coalesce(new_value, '—') AS field_value, coalesce('doc' || CAST(seq AS STRING), '—') AS document, coalesce(CAST(CASE WHEN seq % 2 = 0 THEN seq % 9 END AS STRING), '—') AS page FROM (SELECT DISTINCT claim_id, field FROM d) p LEFT JOIN z USING (claim_id, field)",
    ),
    "payments_union": Query(PAY_IN, lambda d: merge.union_payments(d), PAY_OUT),
    "doc_listing": Query(
        FILES_IN,
        lambda d: files.with_index(d).select("claim_id", "name", "doc_idx", text.file_stem(F.col("name")).alias("stem")),
        r"SELECT claim_id, name, CAST(row_number() OVER (PARTITION BY claim_id ORDER BY lower(name), name) - 1 AS INT) AS doc_idx, regexp_replace(name, '\.[^.]*$', '') AS stem FROM d WHERE lower(regexp_extract(name, '\.([^.]+)$', 1)) IN ('pdf', 'docx')",
    ),
    "parser_labels": Query(
        FILES_IN,
        lambda d: d.select("claim_id", "name", files.parser_label(F.col("name")).alias("label")),
        r"SELECT claim_id, name, CASE WHEN lower(regexp_extract(name, '[^.]*$')) IN ('pdf', 'docx') THEN '<DocumentParser:' || upper(regexp_extract(name, '[^.]*$')) || '>' END AS label FROM d",
    ),
    "json_fence": Query(
        JSON_IN,
        lambda d: d.select("id", text.parse_json(F.col("raw")).alias("v")).where("v is not null").select("id", F.try_variant_get("v", "$.v", "long").alias("value")),
        r"SELECT id, id AS value FROM d WHERE id % 4 <> 3",
    ),
    "render_prompt": Query(
        "SELECT conv_id AS id, turn, 'Q: {{question}} by {{role}} {{left}}' AS template, CASE WHEN turn % 3 = 0 THEN '{{role}}?' ELSE text END AS question, role FROM conversations",
        lambda d: d.select("id", "turn", text.render(F.col("template"), {"question": F.col("question"), "role": F.col("role")}).alias("prompt")).withColumns({"tokens": text.token_estimate(F.col("prompt")), "unfilled": text.unfilled(F.col("prompt"))}),
        "SELECT id, turn, replace(replace(template, '{{question}}', question), '{{role}}', role) AS prompt, CAST(length(replace(replace(template, '{{question}}', question), '{{role}}', role)) // 4 AS BIGINT) AS tokens, true AS unfilled FROM d",
    ),
    "chunk_summary": Query(
        "SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'text' ELSE 'table' END AS kind, text AS content, CAST(doc_id % 100 AS INT) AS page FROM documents",
        lambda d: d.select("id", text.chunk_line(F.col("page"), F.lit(1), F.col("kind"), F.col("content"), F.lit(2), F.lit(3), F.lit(0), F.lit(1.0), F.lit(1.0)).alias("line")),
        ", s AS (SELECT id, kind, page, CASE WHEN kind = 'text' THEN replace(content, chr(10), ' ') ELSE 'Table (2x3)' || CASE WHEN content <> '' THEN ' ' || string_split(content, chr(10))[1] ELSE '' END END AS t FROM d) SELECT id, 'Page ' || lpad(CAST(page AS STRING), 2, '0') || ' | Order 01 | ' || CASE WHEN kind = 'text' THEN 'TEXT ' ELSE 'TABLE' END || ' | ' || CASE WHEN length(t) > 100 THEN substr(t, 1, 97) || '...' ELSE t END AS line FROM s",
    ),
    "answer_quality": Query(
        MONEY_IN.replace("'about ' || whole", "'\"' || whole || '|\"'").replace("ELSE NULL END AS raw", "ELSE NULL END AS value, CAST(o_orderkey % 4 AS INT) AS page, CASE WHEN o_orderkey % 9 < 7 THEN 'currency' ELSE 'date' END AS kind, CASE WHEN o_orderkey % 2 = 0 THEN 'said' END AS reason"),
        lambda d: generate.quality_flags(d, "kind", "value", "reason", "page").groupBy("kind").agg(*[F.count_if(~F.col(c)).alias(c.replace("_ok", "_bad")) for c in ("money_ok", "date_ok", "page_ok", "absence_ok", "cell_ok", "quotes_ok")]),
        "SELECT kind, count(*) FILTER (kind = 'currency' AND value IS NOT NULL AND NOT regexp_matches(value, '^[A-Z]{3} [0-9]+$')) AS money_bad, count(*) FILTER (kind = 'date' AND value IS NOT NULL AND NOT regexp_matches(value, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')) AS date_bad, 0::BIGINT AS page_bad, count(*) FILTER (value IS NULL AND reason IS NOT NULL) AS absence_bad, count(*) FILTER (contains(value, '|')) AS cell_bad, count(*) FILTER (starts_with(value, chr(34)) OR ends_with(value, chr(34))) AS quotes_bad FROM d GROUP BY kind",
    ),
    "image_bytes": Query(
        "SELECT doc, image_index, 1 AS page, CASE WHEN image_index % 2 = 0 THEN CAST(image_index AS DOUBLE) END AS x0, 0.5 AS y0, CAST(NULL AS DOUBLE) AS x1, 2.5 AS y1, size FROM (SELECT conv_id AS doc, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INT) AS image_index, length(text) AS size FROM conversations)",
        lambda d: layout.with_image_bytes(d.drop("size"), d.where("image_index % 3 <> 0").select("doc", "page", "image_index", "size")).select("doc", "image_index", "x0", "x1", F.coalesce(F.col("size").cast("long"), F.lit(-1)).alias("size")),
        "SELECT doc, image_index, coalesce(x0, 0.0) AS x0, coalesce(x1, 0.0)::DOUBLE AS x1, CASE WHEN image_index % 3 <> 0 THEN coalesce(size::BIGINT, -1) ELSE -1 END AS size FROM d",
    ),
    "diary_fold": Query(
        "SELECT claim_id, doc_idx, 't' || CAST(doc_idx AS STRING) AS doc, role || ': ' || coalesce(text, '') || '.' AS content FROM (SELECT conv_id AS claim_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INT) AS doc_idx, role, text FROM conversations)",
        lambda d: ledger.fold(d, stub_update, "start").select("claim_id", "doc_idx", "diary", "ledger"),
        "SELECT claim_id, doc_idx, 'start' || coalesce(string_agg(CASE WHEN content NOT LIKE 'system:%' THEN '/' || content END, '') OVER (PARTITION BY claim_id ORDER BY doc_idx), '') AS diary, CASE WHEN content NOT LIKE 'system:%' THEN '| 1 | said | - | ' || length(content) || ' |' END AS ledger FROM d",
    ),
    "fold_ledger": Query(
        "SELECT claim_id, doc_idx, 't' || CAST(doc_idx AS STRING) AS doc, role || ': ' || coalesce(text, '') || '.' AS content FROM (SELECT conv_id AS claim_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INT) AS doc_idx, role, text FROM conversations)",
        lambda d: ledger.ledger_text(runs.entries(ledger.fold(d, stub_update, "start")), "# Ledger"),
        "SELECT claim_id, '# Ledger' || chr(10) || string_agg('| ' || doc || ' | 1 | said | - | ' || length(content) || ' |', chr(10) ORDER BY doc_idx) || chr(10) AS ledger FROM d WHERE content NOT LIKE 'system:%' GROUP BY claim_id",
    ),
    "compare_values": Query(
        "SELECT c_custkey AS id, CASE CAST(c_custkey % 6 AS INT) WHEN 0 THEN '2024-03-05' WHEN 1 THEN 'EUR 500' WHEN 2 THEN 'March 5, 2024' WHEN 4 THEN 'USD 5' WHEN 5 THEN ' ' || c_name END AS a, CASE CAST(c_custkey % 6 AS INT) WHEN 0 THEN '05.03.2024' WHEN 1 THEN '€500,00' WHEN 2 THEN '5  Mar 2024' WHEN 4 THEN 'EUR 5' WHEN 5 THEN c_name || ' ' END AS b FROM customer",
        lambda d: d.select("id", *[normalize.same(k, F.col("a"), F.col("b")).alias(k) for k in ("date", "currency")]),
        "SELECT id, id % 6 IN (0, 2, 3, 5) AS date, id % 6 IN (1, 3, 5) AS currency FROM d",
    ),
    "normalize_by_kind": Query(
        "SELECT c_custkey AS id, CASE CAST(c_custkey % 6 AS INT) WHEN 0 THEN 'date' WHEN 1 THEN 'currency' WHEN 2 THEN 'enum' WHEN 3 THEN 'narrative' WHEN 4 THEN 'other' END AS kind, CASE CAST(c_custkey % 6 AS INT) WHEN 0 THEN '7.3.2024 ' WHEN 1 THEN '$ ' || CAST(c_custkey AS STRING) || '.20' WHEN 2 THEN ' Comm' ELSE '  A  ' || c_name || ' ' END AS raw FROM customer",
        lambda d: d.select("id", normalize.normalize(F.col("kind"), F.col("raw")).alias("value"), normalize.merge_key(F.col("kind"), F.col("raw")).alias("key")),
        ", v AS (SELECT id, CASE id % 6 WHEN 0 THEN '2024-03-07' WHEN 1 THEN 'USD ' || CAST(id AS VARCHAR) WHEN 2 THEN 'commercial' WHEN 3 THEN regexp_replace(trim(raw), ' +', ' ', 'g') ELSE trim(raw) END AS value FROM d) SELECT id, value, lower(value) AS key FROM v",
    ),
    "registered_merge": Query(REGISTERED_IN, merge_fields, MERGE_OUT.replace("lower(trim(value)) AS norm", "canon AS norm")),
    "final_json": Query(MERGE_IN, final_json, FINAL_JSON_OUT),
    "document_chunks": Query(LAYOUT_IN, document_chunks, LAYOUT_OUT),
    "answered_questions": Query(
        "SELECT conv_id AS id, turn, role || ': ' || coalesce(text, '') AS content FROM conversations",
        lambda d: runs.answer(d, generate.Stub(answer=answer_of), "What is said?", "id", "turn"),
        f"SELECT id, turn, CASE WHEN content LIKE 'system: %' THEN '{prompts.REFUSAL}' ELSE 'said' END AS answer, content NOT LIKE 'system: %' AS found, CAST(NULL AS VARCHAR) AS error FROM d",
    ),
    "kept_summaries": Query(
        "SELECT conv_id AS claim_id, 'claim <' || CAST(conv_id AS STRING) || '> of ' || CAST(count(*) AS STRING) AS diary FROM conversations GROUP BY conv_id",
        lambda d: runs.summaries(d, d.where("claim_id % 2 = 0").select("claim_id", F.lit("| x |").alias("ledger")), generate.Stub(answer=summary_of)),
        "SELECT claim_id, 'facts of ' || claim_id AS summary FROM d WHERE claim_id % 3 <> 0 AND claim_id % 5 <> 0",
    ),
    "growing_merge": Query(MERGE_IN, growing_merge, MERGE_OUT),
    "stored_answers": Query(
        "SELECT conv_id AS id, turn, role || ': ' || coalesce(text, '') AS prompt FROM conversations",
        stored_answers,
        "SELECT id, turn, CASE WHEN prompt NOT LIKE 'system:%' THEN 're ' || prompt END AS raw, CASE WHEN prompt LIKE 'system:%' THEN 'ValueError: no answer' END AS error FROM d",
    ),
    "registry_lookup": Query(REGISTRY_IN, lambda d: registry.with_kind(d), REGISTRY_OUT),
    "kept_extractions": Query(
        JSON_IN.replace("SELECT event_id AS id,", "SELECT event_id % 50 AS claim_id, CAST(event_id AS INT) AS doc_idx,"),
        lambda d: generate.succeeded(d.withColumn("extraction", text.parse_json(F.col("raw")))).select("claim_id", F.try_variant_get("extraction", "$.v", "long").alias("value"), F.col("doc_idx").cast("long").alias("doc_idx")),
        "SELECT claim_id, CAST(doc_idx AS BIGINT) AS value, row_number() OVER (PARTITION BY claim_id ORDER BY doc_idx) - 1 AS doc_idx FROM d WHERE doc_idx % 4 <> 3",
    ),
    "payments_record": Query(
        PAY_IN,
        lambda d: merge.payments_record(d).select("claim_id", "field_name", "field_value", joined("source_documents").alias("source_documents"), "confidence"),
        PAY_OUT.replace("SELECT claim_id, doc_idx, doc, pos, date, amount, description, page FROM k", ", z AS (SELECT * FROM k") + """)
    SELECT claim_id, 'financials.payments_made' AS field_name, '[' || string_agg('{"date":"' || date || '","amount":"' || amount || '","description":"' || description || '","_page":' || page || ',"_source_document":"' || doc || '"}', ',' ORDER BY doc_idx, pos) || ']' AS field_value,
     string_agg(doc, ',' ORDER BY doc_idx) AS source_documents, 1.0::DOUBLE AS confidence FROM z GROUP BY claim_id""",
    ),
    "final_claim": Query(
        MERGE_IN.replace("SELECT claim_id, doc_idx,", "SELECT claim_id, doc_idx, event_id,", 1),
        final_claim,
        MERGE_OUT.replace("SELECT p.claim_id,", ", m AS (SELECT p.claim_id,") + """),
    y AS (SELECT claim_id, doc_idx, doc, event_id, page, 'EUR ' || (event_id % 40) AS amount FROM d WHERE event_id % 11 = 0 QUALIFY row_number() OVER (PARTITION BY claim_id, event_id % 40 ORDER BY doc_idx, event_id) = 1),
    x AS (SELECT claim_id, 0 AS late, field_name, field_value, source_documents, confidence FROM m UNION ALL
     SELECT claim_id, 1, 'financials.payments_made', '[' || string_agg('{"date":"2024-05-01","amount":"' || amount || '","description":null,"_page":' || coalesce(CAST(page AS VARCHAR), 'null') || ',"_source_document":"' || doc || '"}', ',' ORDER BY doc_idx, event_id) || ']',
      (SELECT string_agg(u, ',' ORDER BY CAST(substr(u, 4) AS INT)) FROM (SELECT unnest(list_distinct(list(doc))) AS u)), 1.0 FROM y GROUP BY claim_id)
    SELECT claim_id, CAST(row_number() OVER (PARTITION BY claim_id ORDER BY late, field_name) AS INT) AS ord, field_name, field_value, source_documents, confidence FROM x""",
    ),
    "chunk_records": Query(
        TALK_IN,
        lambda d: layout.as_records(d),
        """SELECT '{"doc":' || doc || ',"seq":' || seq || ',"chunk_type":"' || chunk_type || '","page":' || page || ',"content":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || ',"bbox":{"x0":' || x0 || ',"y0":' || y0 || ',"x1":' || x1 || ',"y1":' || y1 || '}}' AS record FROM d""",
    ),
    "document_render": Query(
        TALK_IN,
        lambda d: layout.rendered(layout.ordered(d.withColumns({"num_rows": F.lit(2), "num_cols": F.lit(3), "image_index": F.lit(0), "width": F.lit(1.5), "height": F.lit(2.0)}))),
        """, s AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY y0, CASE chunk_type WHEN 'table' THEN 0 WHEN 'text' THEN 1 ELSE 2 END, seq) - 1 AS o,
         CASE chunk_type WHEN 'text' THEN replace(content, chr(10), ' ') WHEN 'table' THEN 'Table (2x3)' || CASE WHEN content <> '' THEN ' ' || string_split(content, chr(10))[1] ELSE '' END ELSE 'Image index=0 size=1.5x2.0' END AS t FROM d)
        SELECT doc, 'Document: ' || doc || ' (' || count(*) || ' chunks extracted)' || chr(10) || repeat('-', 120) || chr(10) || 'PAGE | ORDER | TYPE  | CONTENT SUMMARY' || chr(10) || repeat('-', 120) || chr(10)
         || string_agg('Page ' || CASE WHEN page < 10 THEN '0' ELSE '' END || page || ' | Order ' || CASE WHEN o < 10 THEN '0' ELSE '' END || o || ' | ' || rpad(upper(chunk_type), 5, ' ') || ' | ' || CASE WHEN chunk_type <> 'image' AND length(t) > 100 THEN substr(t, 1, 97) || '...' ELSE t END, chr(10) ORDER BY page, o) AS shown FROM s GROUP BY doc""",
    ),
    "sources_by_field": Query(
        "SELECT o_orderstatus AS field, 'd' || CAST(o_orderkey % 7 AS STRING) || ',d' || CAST(o_orderkey % 3 AS STRING) AS docs FROM orders",
        lambda d: runs.sources_by_field(d.withColumn("sources", F.split("docs", ",")), "field").select("field", joined("sources").alias("sources")),
        "SELECT field, string_agg(u, ',' ORDER BY u) AS sources FROM (SELECT DISTINCT field, unnest(string_split(docs, ',')) AS u FROM d) GROUP BY field",
    ),
}


def stub_update(diary: str, content: str) -> str:
    """A model that adds the content to the diary, and fails on what the system says."""
    if content.startswith("system:"):
        raise ValueError("no answer")
    return f"<!-- BEGIN_DIARY -->{diary}/{content}<!-- END_DIARY --><!-- BEGIN_LEDGER_ENTRY -->| 1 | said | - | {len(content)} |<!-- END_LEDGER_ENTRY -->"


def answer_of(prompt: str) -> str:
    """A model that refuses contexts of the system."""
    return f" {prompts.REFUSAL} " if prompt.rsplit("Context:\n", 1)[1].startswith("system: ") else " said\n"


def summary_of(prompt: str) -> str:
    """A model that gives some claims no summary, and others an empty one."""
    claim = int(re.search("claim <([0-9]+)>", prompt)[1])
    return "none" if claim % 3 == 0 else f"<!-- BEGIN_SUMMARY --> {f'facts of {claim}' if claim % 5 else ''}\n<!-- END_SUMMARY -->"


def reply(prompt: str) -> str:
    """A model that answers all but the system."""
    if prompt.startswith("system:"):
        raise ValueError("no answer")
    return "re " + prompt


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES | retrieval.QUERIES


def oracles() -> dict[str, str]:
    return {name: sql for name, q in QUERIES.items() if (sql := q.oracle())} | retrieval.ORACLES
