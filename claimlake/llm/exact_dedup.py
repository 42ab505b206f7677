"""Exact dedup by two-pass Bloom filtering.

Pass 1 sets bits from the hash of every normalised text and keeps the bits that were set twice.
Pass 2 probes every row: rows that miss a bit are unique for certain and pass straight through;
only possible repeats are written once, shuffled by hash and resolved exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

OUTPUTS = ["keep_id", "group_size", "kept", "text_sha256"]


def fingerprint(docs: DataFrame, text: str, doc_id: str, carry: list[str]) -> DataFrame:
    """Scratch table (row, _id, _sha, _points, _a, _b): the carried columns as one, hash of the text without white space, code points as written, address."""
    whole = F.coalesce(common.col(text).cast("string"), F.lit(""))
    sha = F.sha2(F.regexp_replace(whole, common.WS + "+", ""), 256)
    row = F.struct(*[common.col(c) for c in carry]) if carry else F.lit(None).cast("boolean")
    made = docs.select(row.alias("row"), common.col(doc_id).alias("_id"), sha.alias("_sha"), F.length(whole).alias("_points"), *common.address(doc_id, text))
    return common.materialize(made, "fingerprints")


def decide(rows: DataFrame) -> DataFrame:
    """Rows of ``fingerprint`` with _keep (id of the row that stays), _size (of the group) and _kept; each comes out once."""
    bits = common.filter_bits(rows.count())
    twice = common.materialize(common.filter_words(rows, "_sha", bits, least=2), "dedup-filter")
    probed = common.might_hold(rows, twice, "_sha", bits, "_maybe")
    unique = probed.where(~F.col("_maybe")).drop("_maybe").select("*", F.col("_id").alias("_keep"), F.lit(1).cast("long").alias("_size"), F.lit(True).alias("_kept"))

    maybe = common.materialize(probed.where("_maybe").drop("_maybe").withColumn("_rid", F.monotonically_increasing_id()), "dedup-maybe")
    best = F.min_by(F.struct("_id", "_rid"), F.struct(-F.col("_points"), F.col("_id").isNull(), "_id", "_rid"))
    groups = common.materialize(maybe.groupBy("_sha").agg(F.count("*").alias("_size"), best.alias("_best")), "dedup-groups")
    resolved = maybe.join(groups, "_sha").select(*rows.columns, F.col("_best._id").alias("_keep"), "_size", (F.col("_rid") == F.col("_best._rid")).alias("_kept"))
    return unique.unionByName(resolved)


def mark_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all unless told) with keep_id, group_size, kept and text_sha256; every row comes out once.

    Null text counts as empty. Of equal texts the longest original stays, then the smallest id, null ids last; of
    repeated rows that tie in all of it exactly one stays. Columns named like an output, in whatever case, are replaced. An empty table
    gives an empty result.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in OUTPUTS]
    out = decide(fingerprint(docs, text, doc_id, carry))
    own = [F.col("row")[c].alias(c) for c in carry]
    return out.select(*own, F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), F.col("_kept").alias("kept"), F.col("_sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows that stay, as by ``mark_copies``, with the columns of the input. Only hashes are compared; texts of copies alone meet their verdict."""
    decided = decide(fingerprint(docs, text, doc_id, []))
    return common.keep_rows(docs, decided.select("_a", "_b", F.col("_kept").alias("kept")), doc_id, text)


def op10(spark, sf_dir: str) -> DataFrame:
    return mark_copies(common.table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"]).select("doc_id", *OUTPUTS)


OP10_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM n
WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
"""
