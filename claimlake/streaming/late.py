"""The diary fold as a stream whose documents may come late.

State is a claim's documents in order, each with the diary and ledger text that it led to. Documents that come after the
last one are folded on; one that belongs before others refolds from its place, so the end state depends on the documents
alone and not on the batches that they came in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ledger import updated

STATE = "doc_idx int, doc string, content string, diary string, ledger string"


def refolded(held: list[tuple], come: list[tuple], update: Callable[[str, str], str], start: str) -> tuple[list[tuple], int]:
    """Documents in order with diary and ledger after some more came, and from which place on they were folded anew.

    ``held`` has rows of STATE, ``come`` rows (doc_idx, doc, content). A document that came before, by index and name,
    is replaced; if its content is the same, nothing is folded for it. An answer that fails or holds no diary leaves the
    diary as it is.
    """
    contents = {row[:2]: row[2] for row in held}
    fresh = {row[:2]: row[2] for row in sorted(come, key=lambda r: (r[0], r[1] or "", r[2] or "")) if row[:2] not in contents or contents[row[:2]] != row[2]}
    if not fresh:
        return held, len(held)
    order = lambda key: (key[0], key[1] or "")
    first = min(map(order, fresh))
    out = [row for row in held if order(row[:2]) < first]
    place = len(out)
    diary = out[-1][3] if out else start
    for key, content in sorted(((contents | fresh).items()), key=lambda item: order(item[0])):
        if order(key) < first:
            continue
        try:
            new = updated(update(diary, content))
        except Exception:  # the document is dropped, the rest proceeds
            new = None
        diary = new[0] if new else diary
        out.append((*key, content, diary, new[1] if new else None))
    return out, place


class Refold(StatefulProcessor):
    def __init__(self, update: Callable[[str, str], str], start: str):
        self.update, self.start = update, start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.documents = handle.getListState("documents", STATE)
        self.revision = handle.getValueState("revision", "revision long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        come = [(int(r.doc_idx), r.doc, r.content) for batch in rows for r in batch.itertuples()]
        held = [tuple(r) for r in self.documents.get()]
        now, place = refolded(held, come, self.update, self.start)
        revision = (self.revision.get()[0] if self.revision.exists() else 0) + 1
        if place == len(held):
            if now[place:]:
                self.documents.appendList(now[place:])
        else:
            self.documents.put(now)
        self.revision.update((revision,))
        yield pd.DataFrame([(key[0], i, d, diary, ledger, revision) for i, d, _, diary, ledger in now[place:]], columns=["claim_id", "doc_idx", "doc", "diary", "ledger", "revision"])

    def close(self) -> None:
        pass


def stream_refold(documents: DataFrame, update: Callable[[str, str], str], start: str) -> DataFrame:
    """Fold a stream of (claim_id, doc_idx, doc, content) per claim; rows (claim_id, doc_idx, doc, diary, ledger, revision).

    Every document that is folded, for the first time or anew, gives a row; of one document the highest revision counts.
    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    kind = documents.schema["claim_id"].dataType.simpleString()
    out = f"claim_id {kind}, doc_idx int, doc string, diary string, ledger string, revision long"
    return documents.groupBy("claim_id").transformWithStateInPandas(Refold(update, start), out, "Update", "None")
