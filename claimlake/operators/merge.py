"""One authoritative value per claim and field, with where it came from and how sure it is."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import normalize
from ..functions.registry import kind_of
from ..sources import scratch
from ..sources.snapshots import BUCKETS, Snapshots

#: Weights of recency and frequency: fixed values.
RECENCY, FREQUENCY = 0.6, 0.4


MEMBERS = "array<struct<doc_idx:int,doc:string,page:int,reason:string,value:string>>"
#: What is known of a claim's candidates: columns of ``partials``, but the claim.
PARTIALS = f"path string, norm string, last int, first int, size bigint, members {MEMBERS}"


def partials(rows: DataFrame, claim: str = "claim_id", kind: Column | None = None, null_tokens: tuple[str, ...] = ()) -> DataFrame:
    """What some documents say, by claim, path and candidate: rows (claim, PARTIALS) that ``united`` can add to others.

    Values that normalize alike are one candidate; a path without a value has a candidate null.
    """
    kind = kind_of(F.col("path")) if kind is None else kind
    value = F.when(F.lower(F.trim("value")).isin(*null_tokens), F.lit(None)).otherwise(F.col("value")) if null_tokens else F.col("value")
    seen = rows.withColumn("value", value).withColumn("norm", F.when(F.col("value").isNotNull(), normalize.merge_key(kind, F.col("value"))))
    member = F.struct("doc_idx", "doc", "page", "reason", "value")
    return seen.repartition(claim, "path").groupBy(claim, "path", "norm").agg(F.max("doc_idx").alias("last"), F.min("doc_idx").alias("first"), F.count("*").alias("size"), F.array_sort(F.collect_list(member)).alias("members"))


def united(parts: DataFrame, claim: str = "claim_id") -> DataFrame:
    """Partials of different documents as those of all of them, whatever the order they are added in."""
    all_ = F.array_sort(F.flatten(F.collect_list("members"))).alias("members")
    return parts.repartition(claim, "path").groupBy(claim, "path", "norm").agg(F.max("last").alias("last"), F.min("first").alias("first"), F.sum("size").alias("size"), all_)


def scored(parts: DataFrame, counts: DataFrame, claim: str = "claim_id") -> DataFrame:
    """Merged fields of partials; ``counts`` has how many documents (claim, n) each claim has, numbered from 0."""
    groups = parts.join(counts, claim)
    recency = F.when(F.col("n") == 1, F.lit(1.0)).otherwise(F.col("last") / (F.col("n") - 1))
    score = RECENCY * recency + FREQUENCY * (F.col("size") / F.col("n"))
    real = F.col("norm").isNotNull()
    best = F.max_by(F.when(real, F.struct("members", score.alias("score"))), F.when(real, F.struct(score.alias("score"), (-F.col("first")).alias("first")))).alias("best")
    won = groups.groupBy(claim, "path").agg(best)
    latest = F.try_element_at(F.col("best.members"), F.lit(-1))
    listed = lambda name, kind_: F.coalesce(F.transform("best.members", lambda m: m[name]), F.array().cast(f"array<{kind_}>"))
    return won.select(
        claim,
        F.col("path").alias("field_name"),
        latest["reason"].alias("reason"),
        latest["value"].alias("field_value"),
        listed("doc", "string").alias("source_documents"),
        listed("page", "int").alias("pages"),
        F.coalesce(F.bround("best.score", 3), F.lit(0.0)).alias("confidence"),
    )


def merge_fields(rows: DataFrame, documents: DataFrame, claim: str = "claim_id", kind: Column | None = None, null_tokens: tuple[str, ...] = ()) -> DataFrame:
    """Merge rows (claim, doc_idx, doc, path, reason, value, page) to one row per claim and path.

    ``documents`` has one row (claim, doc_idx) per successfully extracted document, numbered from 0. A candidate's score
    weighs its latest document against how many documents agree, and ties go to the candidate seen first. The latest
    wording of the winner is reported with all documents and pages in order. A path without any value comes out with
    nulls, no documents and confidence 0. Two aggregations share the partitioning by claim and path, so rows shuffle
    once; the number of documents per claim joins in as a small side.
    """
    counts = documents.groupBy(claim).agg(F.count_distinct("doc_idx").alias("n"))
    return scored(partials(rows, claim, kind, null_tokens), counts, claim)


class Merge:
    """A merge that grows by batches of new documents: partials and documents are kept, scores are taken when it is read.

    Only the buckets of a batch's claims are written. New partials lie beside the valid ones until the documents' table
    names their batch, so a reader or a crash in between sees the state before. Documents that are known already add
    nothing, so a batch can be repeated.
    """

    def __init__(self, spark: SparkSession, path: str, claim: str = "claim_id", kind: str = "string", buckets: int = BUCKETS):
        self.claim = claim
        self.parts = Snapshots(spark, f"{path}/partials", f"{claim} {kind}, {PARTIALS}, batch string", claim, buckets)
        self.documents = Snapshots(spark, f"{path}/documents", f"{claim} {kind}, doc_idx int, batch string", claim, buckets)

    def add(self, rows: DataFrame, documents: DataFrame, **how) -> None:
        """Add rows and documents as ``merge_fields`` takes them; documents that are known already are left out."""
        name, claim = uuid.uuid4().hex, self.claim
        fresh = documents.select(claim, "doc_idx").distinct().join(self.documents.read().select(claim, "doc_idx"), [claim, "doc_idx"], "left_anti")
        fresh = scratch.written(fresh, "merge-documents")
        if fresh.isEmpty():
            return
        mine = scratch.written(partials(rows.join(fresh, [claim, "doc_idx"], "left_semi"), claim, **how), "merge-partials")
        named = fresh.select(claim).distinct()
        valid = self.documents.read().select(claim, "batch").distinct()
        known = self.parts.read().join(named, claim, "left_semi").join(valid, [claim, "batch"], "left_semi")
        whole = united(known.drop("batch").unionByName(mine), claim).withColumn("batch", F.lit(name))
        # what was valid stays beside the new until the documents name the batch: a crash in between changes no result
        self.parts.replace(known.unionByName(whole), named)
        held = self.documents.read().join(named, claim, "left_semi").drop("batch")
        self.documents.replace(held.unionByName(fresh).withColumn("batch", F.lit(name)), named)

    def fields(self) -> DataFrame:
        """The merged fields of all documents added so far."""
        claim = self.claim
        documents = scratch.written(self.documents.read(), "merge-known")
        valid = self.parts.read().join(documents.select(claim, "batch").distinct(), [claim, "batch"], "left_semi").drop("batch")
        return scored(valid, documents.groupBy(claim).agg(F.count("*").alias("n")), claim)


def union_payments(payments: DataFrame, claim: str = "claim_id") -> DataFrame:
    """Payments without repetitions: of equal date and amount the first by document and place stays."""
    key = [F.lower(F.coalesce(normalize.date(F.col("date")), F.lit(""))).alias("date_key"), F.lower(F.coalesce(normalize.currency(F.col("amount")), F.lit(""))).alias("amount_key")]
    keyed = payments.select("*", *key)
    first = Window.partitionBy(claim, "date_key", "amount_key").orderBy("doc_idx", "pos")
    return keyed.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank", "date_key", "amount_key")


def payments_record(payments: DataFrame, claim: str = "claim_id") -> DataFrame:
    """The kept payments of each claim as one record in the shape of a merged field; documents in order of their index."""
    kept = union_payments(payments, claim)
    one = F.struct("doc_idx", "pos", F.struct("date", "amount", "description", F.col("page").alias("_page"), F.col("doc").alias("_source_document")).alias("payment"))
    docs = F.array_sort(F.collect_set(F.struct("doc_idx", "doc")))
    out = kept.groupBy(claim).agg(F.array_sort(F.collect_list(one)).alias("all"), docs.alias("docs"))
    return out.select(
        claim,
        F.lit("financials.payments_made").alias("field_name"),
        F.lit(None).cast("string").alias("reason"),
        F.to_json(F.transform("all", lambda x: x["payment"]), {"ignoreNullFields": "false"}).alias("field_value"),
        F.transform("docs", lambda d: d["doc"]).alias("source_documents"),
        F.array().cast("array<int>").alias("pages"),
        F.lit(1.0).alias("confidence"),
    )


def final_claim(fields: DataFrame, payments: DataFrame, claim: str = "claim_id") -> DataFrame:
    """Merged fields in order of their paths, then the payments record; ``ord`` keeps the order."""
    last = payments_record(payments, claim).withColumn("ord", F.lit(1))
    both = fields.withColumn("ord", F.lit(0)).unionByName(last)
    return both.withColumn("ord", F.row_number().over(Window.partitionBy(claim).orderBy("ord", "field_name")))


def as_json(final: DataFrame, claim: str = "claim_id") -> DataFrame:
    """One JSON array per claim, records in order, nulls kept."""
    record = F.struct("ord", F.struct("field_name", "reason", "field_value", "source_documents", "pages", "confidence").alias("r"))
    return final.groupBy(claim).agg(F.array_sort(F.collect_list(record)).alias("all")).select(claim, F.to_json(F.transform("all", lambda x: x["r"]), {"ignoreNullFields": "false"}).alias("json"))
