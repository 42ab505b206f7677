"""Ledger of changes, latest values, and the fold over a claim's documents."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def parse_ledger(rows: DataFrame, body: str = "ledger", *keys: str) -> DataFrame:
    """(keys, line, page, field_name, old_value, new_value) of the well-formed lines of a ledger text."""
    lines = rows.select(*keys, F.posexplode(F.split(body, "\n")).alias("line", "raw")).withColumn("cells", text.ledger_cells(F.col("raw")))
    names = ["page", "field_name", "old_value", "new_value"]
    return lines.where(F.col("cells").isNotNull()).select(*keys, "line", *[F.col("cells")[i].alias(n) for i, n in enumerate(names)])


def ledger_text(entries: DataFrame, heading: str, claim: str = "claim_id") -> DataFrame:
    """(claim, ledger): the entries (claim, doc_idx, doc, line, page, field_name, old_value, new_value) of each claim as one table under a heading."""
    row = F.concat(F.lit("| "), F.concat_ws(" | ", "doc", "page", "field_name", "old_value", "new_value"), F.lit(" |"))
    rows = F.array_sort(F.collect_list(F.struct("doc_idx", "line", row.alias("row"))))
    return entries.groupBy(claim).agg(F.concat(F.lit(heading.rstrip("\n") + "\n"), F.array_join(F.transform(rows, lambda r: r["row"]), "\n"), F.lit("\n")).alias("ledger"))


def changes(values: DataFrame, claim: str, field: str, order: list[str], value: str = "value") -> DataFrame:
    """Old and new value wherever a field's value differs from the one before; the first value counts as a change from none."""
    w = Window.partitionBy(claim, field).orderBy(*order)
    old = values.withColumn("old_value", F.lag(value).over(w)).withColumnRenamed(value, "new_value")
    return old.where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def latest(ledger: DataFrame, claim: str, field: str, order: list[str]) -> DataFrame:
    """The last entry of every field."""
    w = Window.partitionBy(claim, field).orderBy(*[F.desc(c) for c in order])
    return ledger.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def summary(fields: DataFrame, ledger: DataFrame, claim: str, field: str, order: list[str]) -> DataFrame:
    """Fields with the document and page of their last entry, unknown where there is none."""
    last = latest(ledger, claim, field, order).select(claim, field, "new_value", "document", "page")
    out = fields.select(claim, field).join(last, [claim, field], "left")
    unknown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(text.UNKNOWN)).alias(c)
    return out.select(claim, field, unknown("new_value").alias("field_value"), unknown("document"), unknown("page"))


Update = Callable[[str, str], str]

#: Delimited sections of an answer, and the names of the two that an update has: fixed values.
SECTION = re.compile(r"<!--\s*BEGIN_(\w+)\s*-->(.*?)<!--\s*END_\1\s*-->", re.S | re.I)
DIARY, ENTRY = "DIARY", "LEDGER_ENTRY"


def updated(answer: str | None) -> tuple[str, str] | None:
    """New diary and ledger text of an answer; None unless it holds a diary."""
    found = {m[1].upper(): m[2].strip() for m in SECTION.finditer(answer or "")}
    return (found[DIARY], found.get(ENTRY, "")) if found.get(DIARY) else None


def fold(documents: DataFrame, update: Update, start: str, claim: str = "claim_id") -> DataFrame:
    """Fold each claim's documents (claim, doc_idx, doc, content) in order into a diary; one row per document.

    ``update`` maps (diary, content) to an answer with diary and ledger sections. An answer that fails or holds no
    diary leaves the diary as it is and adds nothing to the ledger. The fold is sequential within a claim by
    definition; claims run in parallel.
    """
    kind = documents.schema[claim].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        diary, out = start, []
        for r in rows.sort_values("doc_idx").itertuples():
            try:
                new = updated(update(diary, r.content))
            except Exception as failed:  # the document is dropped, the rest proceeds
                new, error = None, str(failed)
            else:
                error = None
            diary = new[0] if new else diary
            out.append((getattr(r, claim), r.doc_idx, r.doc, diary, new[1] if new else None, error))
        return pd.DataFrame(out, columns=[claim, "doc_idx", "doc", "diary", "ledger", "error"])

    return documents.select(claim, "doc_idx", "doc", "content").groupBy(claim).applyInPandas(run, f"{claim} {kind}, doc_idx int, doc string, diary string, ledger string, error string")
