"""The diary fold as a stream: state is a claim's diary, output is the ledger text that each document adds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ledger import parse_ledger, updated
from ..sources.files import write_by_claim

OUT = "claim_id string, doc_idx int, doc string, diary string, ledger string"


def stream_fold(documents: DataFrame, update: Callable[[str, str], str], start: str) -> DataFrame:
    """Fold a stream of (claim_id, doc_idx, doc, content) per claim, in order within a batch; one row per document.

    An answer that fails or holds no diary leaves the state as it is. Restarting from the checkpoint resumes.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        diary = state.get[0] if state.exists else start
        out = []
        for r in pd.concat(list(batches)).sort_values("doc_idx").itertuples():
            try:
                new = updated(update(diary, r.content))
            except Exception:  # the document is dropped, the rest proceeds
                new = None
            diary = new[0] if new else diary
            out.append((key[0], r.doc_idx, r.doc, diary, new[1] if new else None))
        state.update((diary,))
        yield pd.DataFrame(out, columns=["claim_id", "doc_idx", "doc", "diary", "ledger"])

    return documents.groupBy("claim_id").applyInPandasWithState(run, OUT, "diary string", "append", GroupStateTimeout.NoTimeout)


def store(folded: DataFrame, diary_path: str, ledger_path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write a folded stream: each claim's newest diary replaces the one before, ledger entries are added.

    A batch that is repeated after a failure replaces its own entries, which lie in a folder of their own per claim
    and batch; so entries are neither lost nor doubled.
    """

    def write(rows: DataFrame, batch: int) -> None:
        rows.persist()
        try:
            newest = rows.groupBy("claim_id").agg(F.max_by("diary", "doc_idx").alias("diary"))
            write_by_claim(newest, diary_path, "overwrite")
            added = parse_ledger(rows.where("ledger is not null"), "ledger", "claim_id", "doc_idx", "doc").withColumn("batch", F.lit(batch))
            added.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("claim_id", "batch").parquet(ledger_path)
        finally:
            rows.unpersist()

    return folded.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
