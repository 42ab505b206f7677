"""Packing documents into sequences by cutting-stock column generation.

Documents are cut at multiples of the sequence length; what is left over, the rest pieces, is counted by
length class. A linear program over packing patterns covers these counts; a knapsack dynamic programme over
the dual prices finds the next pattern worth adding. The rounded patterns are then handed out to pieces by
their rank in their length class. Where even the best patterns leave room, their pieces are laid end to end
instead and cut where a sequence is full. Only the histogram, one row per class, reaches the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .tokens import encoder, tokenizer_path

LENGTH = 1024
#: Vocabulary: the tokenizer file, and its ranks for the fast path.
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Length classes are exact up to EXACT tokens and STEP tokens wide beyond.
EXACT, STEP = 64, 8
#: Columns are added until the linear program is within this share of its optimum, or none improves it, or so many turns.
GAP, TURNS = 0.002, 200
#: Patterns filled less than this are dissolved: their pieces are cut freely, at multiples of MARK tokens within a piece.
LEAST_FILL, MARK = 0.98, 8
PIECES = "start long, length long, ids_crc32 long, doc_tokens long"


def class_sizes(length: int = LENGTH) -> np.ndarray:
    """Largest token count of each class, ascending; the last is the sequence length."""
    exact = list(range(1, min(EXACT, length) + 1))
    return np.array(exact + [x for x in range(EXACT + STEP, length, STEP)] + [length] * (length > EXACT), dtype=np.int64)


def price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack over dual prices: the best pattern that fits, and its value.

    Each class is tried in doubling multiples for all capacities at once. Following the choices back may meet
    one that was bettered since, which only makes the pattern worth more.
    """
    best = np.zeros(capacity + 1)
    klass, copies = np.full(capacity + 1, -1), np.zeros(capacity + 1, dtype=np.int64)
    for c in np.flatnonzero(values > 1e-12):
        many = 1
        while many * sizes[c] <= capacity:
            step = int(many * sizes[c])
            worth = best[:-step] + many * values[c]
            better = np.flatnonzero(worth > best[step:] + 1e-12) + step
            best[better], klass[better], copies[better] = worth[better - step], c, many
            many *= 2
    pattern, room = np.zeros(len(sizes), dtype=np.int64), capacity
    while room > 0:
        if klass[room] < 0:
            room -= 1
        else:
            many = copies[room]
            pattern[klass[room]] += many
            room -= many * sizes[klass[room]]
    return float(pattern @ values), pattern


def first_basis(demand: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Patterns that cover the demand exactly, one used up class each: a triangular basis that is feasible.

    The largest class left is joined by what fills its room best; the pattern is used, in fractions, until one
    of its classes runs out.
    """
    left, columns = demand.astype(float).copy(), []
    open_ = np.ones(len(sizes), dtype=bool)
    while open_.any():
        top = int(np.flatnonzero(open_)[-1])
        _, pattern = price(np.where(open_, sizes, 0).astype(float), sizes, capacity - int(sizes[top]))
        pattern[top] += 1
        ratios = np.where(pattern > 0, left / np.maximum(pattern, 1), np.inf)
        out = int(np.argmin(ratios))
        left = np.maximum(left - ratios[out] * pattern, 0)
        left[out], open_[out] = 0.0, False
        columns.append((out, pattern))
    basis = np.zeros((len(sizes), len(sizes)))
    for out, pattern in columns:
        basis[:, out] = pattern
    return basis


def solve(demand: np.ndarray, sizes: np.ndarray, capacity: int, gap: float = GAP, most_rounds: int = TURNS) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows, copies of each class) and how often to use each, for every unit of demand exactly once.

    Revised simplex whose columns are generated on demand, rounded down; the few units that rounding leaves
    (fewer than classes * pieces in a pattern) are packed largest first. The prices tried lie between the
    simplex's and the best bound's so far, which starts at the sizes themselves.
    """
    used = np.flatnonzero(demand)
    d, s = demand[used].astype(float), sizes[used]
    k = len(used)
    patterns = first_basis(d, s, capacity) if k else np.zeros((0, 0))
    safe, bound = s / capacity, float(d @ s) / capacity
    amounts = inverse = np.zeros((0, 0))
    for turn in range(most_rounds if k else 0):
        if turn % 32 == 0:
            inverse = np.linalg.inv(patterns)
        amounts = np.maximum(inverse @ d, 0)
        if amounts.sum() <= bound * (1 + gap):
            break
        prices = np.maximum(inverse.sum(axis=0), 0)
        for share in (0.8, 0.4, 0.0):
            tried = share * safe + (1 - share) * prices
            value, column = price(tried, s, capacity)
            if float(tried @ d) / max(value, 1) > bound:
                bound, safe = float(tried @ d) / max(value, 1), tried / max(value, 1)
            if prices @ column > 1 + 1e-9:
                break
        else:
            break
        direction = inverse @ column
        ratios = np.where(direction > 1e-9, amounts / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(np.argmin(ratios))
        row = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, row)
        inverse[out] = row
        patterns[:, out] = column
    amounts = np.maximum(np.linalg.solve(patterns, d), 0) if k else np.zeros(0)
    times = np.floor(amounts + 1e-9).astype(np.int64)
    found: dict[tuple[int, ...], int] = {}
    left = demand[used].astype(np.int64).copy()
    for j in range(k):
        p = patterns[:, j].astype(np.int64)
        n = min(times[j], *(left[p > 0] // p[p > 0]))  # guards against round-off
        if n > 0:
            found[tuple(p)] = found.get(tuple(p), 0) + int(n)
            left -= p * n
    while left.any():
        room, p = capacity, np.zeros(k, dtype=np.int64)
        for i in range(k - 1, -1, -1):
            p[i] = min(left[i], room // s[i])
            room -= p[i] * s[i]
        n = int(min(left[p > 0] // p[p > 0]))
        found[tuple(p)] = found.get(tuple(p), 0) + n
        left -= p * n
    out = np.zeros((len(found), len(sizes)), dtype=np.int64)
    out[:, used] = np.array(list(found), dtype=np.int64).reshape(len(found), k)
    return out, np.array(list(found.values()), dtype=np.int64)


class Layout:
    """Where the piece of a given rank in its class goes: pattern, sequence and place in it.

    The first pieces of a class go to the patterns that are filled well, in turn. The others, class after class, lie on
    a line of slots as long as their class, of which each sequence takes ``window``; a piece that reaches into the next
    window is cut there. A cut falls on the last mark before the window's end, so a sequence takes up to MARK - 1 tokens
    more at its start, which the window leaves room for.
    """

    def __init__(self, patterns: np.ndarray, times: np.ndarray, sizes: np.ndarray, capacity: int):
        self.sizes, self.window = sizes, capacity - MARK
        fits = patterns.max(axis=1, initial=0, where=patterns > 0) if len(patterns) else np.zeros(0)
        longest = np.array([sizes[np.flatnonzero(p)[-1]] for p in patterns], dtype=np.int64)
        dissolved = (patterns @ sizes < LEAST_FILL * capacity) & (longest <= self.window) & (fits > 0)
        if dissolved.sum() and (times[dissolved].sum() < 2 or capacity <= 4 * MARK):
            dissolved[:] = False
        loose = (patterns[dissolved] * times[dissolved, None]).sum(axis=0)
        patterns, times = patterns[~dissolved], times[~dissolved]
        self.sequences = int(times.sum())
        self.base = np.concatenate([[0], np.cumsum(loose * sizes)])
        first = np.concatenate([[0], np.cumsum(times)])
        self.by_class = []
        for c in range(patterns.shape[1]):
            rows = np.flatnonzero(patterns[:, c])
            per = patterns[rows, c]
            starts = np.concatenate([[0], np.cumsum(per * times[rows])])
            before = patterns[rows, :c].sum(axis=1)
            self.by_class.append((starts, per, first[rows], before, patterns[rows].sum(axis=1)))

    def place(self, klass: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sequence, order within it, whether others share it, and after how many slots the piece is to be cut (0: nowhere)."""
        sequence, order, cut = (np.zeros(len(rank), dtype=np.int64) for _ in range(3))
        shared = np.ones(len(rank), dtype=bool)
        for c in np.unique(klass):
            at = np.flatnonzero(klass == c)
            starts, per, first, before, total = self.by_class[c]
            held = rank[at] < starts[-1]
            own = at[held]
            row = np.searchsorted(starts, rank[own], side="right") - 1
            into = rank[own] - starts[row]
            sequence[own], order[own], shared[own] = first[row] + into // np.maximum(per[row], 1), before[row] + into % np.maximum(per[row], 1), total[row] > 1
            free = at[~held]
            slot = self.base[c] + (rank[free] - starts[-1]) * self.sizes[c]
            sequence[free], order[free] = self.sequences + slot // self.window, 1 + slot % self.window
            room = self.window - slot % self.window
            cut[free] = np.where(room < self.sizes[c], room, 0)
        return sequence, order, shared, cut


def prefix_sums(ids: bytes) -> bytes:
    """CRC-32 of the first MARK ids, of the first 2 * MARK and so on, packed as 32-bit integers."""
    sums, crc = [], 0
    for at in range(0, len(ids) - 4 * MARK, 4 * MARK):
        crc = zlib.crc32(ids[at : at + 4 * MARK], crc)
        sums.append(crc)
    return np.array(sums, dtype="<u4").tobytes()


def rest_sum(whole: int, first: int, tokens: int) -> int:
    """CRC-32 of the last ids of a piece, from that of the whole and of the part before them.

    A CRC's register is linear in what it held before: zeros carry the first part's share on, and it is taken off.
    """
    return whole ^ zlib.crc32(bytes(4 * tokens), first ^ 0xFFFFFFFF) ^ 0xFFFFFFFF


def cut_pieces(docs: DataFrame, text: str, doc_id: str, path: str, ranks: str | None, length: int, keep_ids: bool = False) -> DataFrame:
    """Pieces of every document with class and rank among the pieces of its partition and class."""
    kind = docs.schema[doc_id].dataType.simpleString()
    sizes = class_sizes(length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path, ranks).ids, TaskContext.get().partitionId()
        seen = np.zeros(len(sizes), dtype=np.int64)
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                chunk = batch.slice(begin, 512)
                owner, start, size, crc, total, marks, kept = [], [], [], [], [], [], []
                for i, value in enumerate(chunk.column(1).to_pylist()):
                    ids = encode(value or "") + b"\0\0\0\0"
                    n = len(ids) // 4
                    for at in range(0, n, length):
                        piece = ids[4 * at : 4 * (at + length)]
                        owner.append(i)
                        start.append(at)
                        size.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(n)
                        marks.append(prefix_sums(piece) if len(piece) < 4 * length else b"")
                        if keep_ids:
                            kept.append(piece)
                klass = np.searchsorted(sizes, size)
                rank = np.empty(len(klass), dtype=np.int64)
                for c in np.unique(klass):
                    at = np.flatnonzero(klass == c)
                    rank[at] = np.arange(len(at)) + seen[c]
                    seen[c] += len(at)
                columns = [chunk.column(0).take(pa.array(owner, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, size, crc, total)), pa.array(klass, pa.int32()), pa.array(np.full(len(klass), part), pa.int32()), pa.array(rank, pa.int64()), pa.array(marks, pa.binary())]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "part", "rank", "marks"]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * keep_ids, names + ["ids"] * keep_ids)

    schema = f"doc_id {kind}, {PIECES}, class int, part int, rank long, marks binary" + ", ids binary" * keep_ids
    return docs.select(common.col(doc_id).alias("doc_id"), common.col(text).cast("string").alias("text")).mapInArrow(common.tidy(cut), schema)


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, ranks: str | None = None, length: int = LENGTH, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids on request).

    Null and empty texts are one piece with the id 0 alone. Repeated rows are packed as often as they occur.
    An empty table gives an empty result. Other columns of the input are left out.
    """
    if path is None:
        path, ranks = tokenizer_path(TOKENIZER), tokenizer_path(RANKS)
    pieces = common.materialize(cut_pieces(docs, text, doc_id, path, ranks, length, keep_ids), "pieces")
    counts = common.materialize(pieces.groupBy("part", "class").agg(F.count("*").alias("n")), "piece-counts")
    sizes = class_sizes(length)
    demand = np.zeros(len(sizes), dtype=np.int64)
    for row in counts.groupBy("class").agg(F.sum("n").alias("n")).collect():  # at most one row per class
        demand[row["class"]] = row["n"]
    layout = Layout(*solve(demand, sizes, length), sizes, length)

    upto = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = common.materialize(counts.select("part", "class", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before")), "piece-starts")
    ranked = pieces.join(common.small_side(before), ["part", "class"]).withColumn("rank", F.col("rank") + F.col("before")).drop("part", "before")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, order, shared, cut = layout.place(batch.column("class").to_numpy(), batch.column("rank").to_numpy())
            start, size, crc = (batch.column(n).to_numpy().copy() for n in ("start", "length", "ids_crc32"))
            keep = cut // MARK * MARK
            late = np.flatnonzero((cut > 0) & (keep == 0))  # too little room for a first part: all of it goes on
            sequence[late], order[late] = sequence[late] + 1, 0
            two = np.flatnonzero((keep > 0) & (keep < size))
            first = np.array([int.from_bytes(batch.column("marks")[int(i)].as_py()[4 * (int(keep[i]) // MARK - 1) :][:4], "little") for i in two], dtype=np.int64)
            rest = np.array([rest_sum(int(crc[i]), int(f), int(size[i] - keep[i])) for i, f in zip(two, first, strict=True)], dtype=np.int64)
            owner = np.concatenate([np.arange(len(size)), two])
            start, old = np.concatenate([start, start[two] + keep[two]]), size[two] - keep[two]
            size[two], crc[two] = keep[two], first
            columns = [batch.column("doc_id").take(pa.array(owner)), pa.array(start), pa.array(np.concatenate([size, old])), pa.array(np.concatenate([crc, rest])), batch.column("doc_tokens").take(pa.array(owner))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if keep_ids:
                ids = batch.column("ids").to_pylist()
                tails = [ids[i][4 * int(keep[i]) :] for i in two]
                for i in two:
                    ids[i] = ids[i][: 4 * int(keep[i])]
                columns.append(pa.array(ids + tails, pa.binary()))
                names.append("ids")
            where = [np.concatenate([sequence, sequence[two] + 1]), np.concatenate([order, np.zeros(len(two), dtype=np.int64)]), np.concatenate([shared, shared[two]])]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x) for x in where)], [*names, "sequence_id", "place", "shared"])

    kind = docs.schema[doc_id].dataType.simpleString()
    placed = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids, "marks", "class", "rank").mapInArrow(common.tidy(place), f"doc_id {kind}, {PIECES}{', ids binary' * keep_ids}, sequence_id long, place long, shared boolean")
    placed = common.materialize(placed, "placed")
    alone = placed.where("NOT shared").withColumn("offset", F.lit(0).cast("long"))
    within = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    shared = placed.where("shared").withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0)).cast("long"))
    return alone.unionByName(shared).drop("place", "shared", *["ids"] * (not keep_ids))


def sequences(packed: DataFrame) -> DataFrame:
    """From ``pack(..., keep_ids=True)``: one row per sequence with its ids as little-endian 32-bit integers.

    Pieces of documents without an id have null in ``doc_ids``. An empty table gives an empty result.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.expr("aggregate(parts.ids, X'', (a, x) -> concat(a, x))").alias("ids"), F.expr("parts.doc_id").alias("doc_ids"))


def op1(spark, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
