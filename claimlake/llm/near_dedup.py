"""Near-duplicate detection by b-bit MinHash.

A document is the set of its distinct word shingles. Sets that are equal form a class and only one of each
goes on. Bands of minima name candidate buckets; inside a bucket the packed low bits of the minima estimate
the similarity, corrected for chance collisions, and a spanning forest of promising pairs comes out. The
clusters of that forest are confirmed on full sets, again keeping a spanning forest of the links that hold.
Buckets and clusters of any size are dealt out in blocks, each compared with itself and the group's leader;
only members left unconnected to the leader meet the other blocks. So no task holds a whole large group, and
a group of near copies costs as much as its size, not its square.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SHINGLE, PERCENT = 5, 85
#: Least bands, rows per band, and the probability under which a pair at the threshold shares no band, see bands_for().
BANDS, ROWS, MISSED = 24, 5, 1e-6
#: Low bits kept of each minimum, and how far under the threshold an estimate may lie (over four standard errors).
BITS, MARGIN = 4, 0.15
#: Members of a block of a bucket or cluster on average, and shingles of a block of a cluster.
BLOCK, BLOCK_SHINGLES = 256, 1_000_000
SEED = 11

_PLACE = np.random.default_rng(SEED).integers(0, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def bands_for(percent: int) -> int:
    """Bands with which a pair at the threshold is missed with a probability under MISSED; an even number, so that signatures are whole bytes."""
    alike = (percent / 100) ** ROWS
    need = math.ceil(math.log(MISSED) / math.log1p(-alike)) if alike < 1 else 1
    return max(BANDS, need + need % 2)


@cache
def _family(bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors and summands of bands * ROWS hash functions, and the weights of band keys."""
    draw = np.random.default_rng((SEED, bands))
    multiply = (draw.integers(0, 2**32, bands * ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
    return multiply, draw.integers(0, 2**32, bands * ROWS, dtype=np.uint64).astype(np.uint32), draw.integers(0, 2**63, (bands, ROWS), dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; with fewer words, one for the whole sequence; none without words."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()  # on bytes both know ASCII alone
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    if len(words) < width:
        whole = (hashed * _PLACE[width : width + len(words)]).sum(dtype=np.uint64) + np.uint64(len(words))
        return _mix(np.array([whole], dtype=np.uint64))
    total = np.zeros(len(words) - width + 1, dtype=np.uint64)
    for k in range(width):
        total += hashed[k : k + len(total)] * _PLACE[k]
    return np.unique(_mix(total))


def minima(values: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """bands * ROWS minima of a non-empty set of hashes."""
    multiply, add, _ = _family(bands)
    low = (values >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(multiply), 2**32 - 1, dtype=np.uint32)
    for at in range(0, len(low), 4096):
        np.minimum(out, (low[at : at + 4096, None] * multiply + add).min(axis=0), out=out)
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    wide = low.reshape(-1, ROWS).astype(np.uint64)
    weights = _family(len(wide))[2]
    return _mix((_mix(wide + np.uint64(1)) * weights).sum(axis=1, dtype=np.uint64) + np.arange(len(wide), dtype=np.uint64)).view(np.int64)


def pack_bits(low: np.ndarray) -> bytes:
    """The low BITS bits of each (mixed) minimum, packed."""
    kept = (_mix(low.astype(np.uint64)) & np.uint64(2**BITS - 1)).astype(np.uint8)
    bits = (kept[:, None] >> np.arange(BITS, dtype=np.uint8)) & 1
    return np.packbits(bits.ravel()).tobytes()


def estimates(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of all pairs of packed signatures (rows of bytes)."""
    apart = left[:, None, :] ^ right[None, :, :]
    nibble = ((apart & 15) != 0).astype(np.uint8) + ((apart >> 4) != 0)
    equal = 1 - nibble.sum(axis=2, dtype=np.int32) / (left.shape[1] * 8 // BITS)
    chance = 2.0**-BITS
    return (equal - chance) / (1 - chance)


def _forest(n: int, linked: Callable[[int, np.ndarray], np.ndarray], others: Callable[[int], np.ndarray]) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Spanning forest of n nodes and each node's tree; linked(i, candidates) says which candidates of others(i) node i links to."""
    label, edges = np.arange(n), []
    for i in range(n):
        rest = others(i)
        rest = rest[label[rest] != label[i]]
        if not len(rest):
            continue
        for j in rest[linked(i, rest)]:
            a, b = label[i], label[j]
            if a != b:
                label[label == max(a, b)] = min(a, b)
                edges.append((i, int(j)))
    return edges, label


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, whole, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        if last is not None and first != last:
            yield pa.Table.from_batches(held)
            held = []
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for low, high in zip(starts, starts[1:], strict=False):
            if low:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def signatures(docs: DataFrame, text: str, doc_id: str, bands: int = BANDS) -> DataFrame:
    """(doc_id, _a, _b, key, n, bands, sig) of every row; key, 128 bits of hash over the full set, and the rest are null without words.

    _a and _b are the row's address, by which the text of a class is found again.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches):
            keys, sizes, banded, sigs = [], [], [], []
            for value in batch.column(1).to_pylist():
                s = shingles(value)
                sizes.append(len(s))
                low = minima(s, bands) if len(s) else None
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                banded.append(band_keys(low) if len(s) else None)
                sigs.append(pack_bits(low) if len(s) else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("doc_id", "_a", "_b")), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(banded, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], ["doc_id", "_a", "_b", "key", "n", "bands", "sig"])

    kept = docs.select(common.col(doc_id).alias("doc_id"), common.col(text).cast("string").alias("text"), *common.address(doc_id, text))
    schema = T.StructType([kept.schema["doc_id"], *T._parse_datatype_string("_a long, _b long, key binary, n long, bands array<long>, sig binary").fields])
    return kept.mapInArrow(common.tidy(compute), schema)


def _dealt(rows: DataFrame) -> DataFrame:
    """Groups of (cluster, i, j) whole, in order, dealt out evenly."""
    keys = ["cluster", "i", "j"]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys)


def _spread(count: str) -> Column:
    """The numbers from 0 to a column of counts, one row each."""
    return F.explode(F.sequence(F.lit(0), F.col(count).cast("int") - 1))


def _trees(linker: Callable[[pa.Table], Callable[[int, np.ndarray], np.ndarray]], first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per group of (cluster, i, j): edges (a, b) of a spanning forest and, the first time, rows (a, null) for loose members.

    The first time all members of a group meet each other; later those with ``left`` meet those without.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["cluster", "i", "j"]):
            node, left = group.column("node").to_numpy(), group.column("left").to_numpy(zero_copy_only=False)
            if len(node) < 2:
                continue
            right = np.flatnonzero(~left)
            others = (lambda a, n=len(node): np.arange(a + 1, n)) if first else (lambda a, left=left, right=right: right if left[a] else right[:0])
            found, label = _forest(len(node), linker(group), others)
            edges = [(node[a], node[b]) for a, b in found if node[a] != node[b]]
            if first and group.column("blocks")[0].as_py() > 1:
                lead = label[node == group.column("leader")[0].as_py()][:1]
                edges += [(x, None) for x in node[~np.isin(label, lead)]]
            if edges:
                a, b = zip(*edges, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([group.column("cluster")[0].as_py()] * len(a), pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["cluster", "a", "b"])

    return compare


def spanning_edges(members: DataFrame, linker: Callable[[pa.Table], Callable[[int, np.ndarray], np.ndarray]]) -> DataFrame:
    """Edges (a, b) that connect in every cluster what its links connect; members is a scratch table (cluster, node, blocks, leader, ...).

    Every block of a cluster is compared with itself and the cluster's leader. Members that this leaves unconnected
    to the leader, the loose ones, then meet the whole cluster. A cluster whose members are near its leader thus
    costs as much as its size, and any pair that could still join two trees is compared.
    """
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = members.withColumns({"i": own, "j": F.lit(0), "left": F.lit(True)})
    guests = members.where("blocks > 1 AND node = leader").select("*", _spread("blocks").alias("i"), F.lit(0).alias("j"), F.lit(True).alias("left")).where(F.col("i") != own)
    result = "cluster long, a long, b long"
    found = common.materialize(_dealt(placed.unionByName(guests)).mapInArrow(common.tidy(_trees(linker, True)), result), "near-trees")
    edges, loose = found.where("b is not null").select("a", "b"), found.where("b is null").select("cluster", F.col("a").alias("node"))
    if loose.isEmpty():
        return edges
    width = common.materialize(loose.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).alias("loose")), "near-loose")
    open_ = members.join(width, "cluster")
    left = open_.join(loose, ["cluster", "node"]).select("*", F.pmod(F.xxhash64("node"), F.col("loose")).cast("int").alias("i"), _spread("blocks").alias("j"), F.lit(True).alias("left"))
    right = open_.select("*", _spread("loose").alias("i"), own.alias("j"), F.lit(False).alias("left"))
    crossed = common.materialize(left.unionByName(right).drop("loose", "blocks", "leader"), "near-crossed")
    return edges.unionAll(_dealt(crossed).mapInArrow(common.tidy(_trees(linker, False)), result).select("a", "b"))


def _signatures_of(group: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(group.num_rows, -1)


def candidates(classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) between classes that connect, in every bucket, the pairs whose estimate is near enough; and (node, weight).

    The weight is the number of members of all buckets of a node: the more central a class, the higher.
    """
    least = percent / 100 - MARGIN
    rows = classes.select("node", F.explode("bands").alias("cluster"))
    shared = common.materialize(rows.groupBy("cluster").agg(F.count("*").alias("m"), F.min("node").alias("leader")).where("m > 1"), "near-buckets")
    bits = common.filter_bits(shared.count())  # most buckets hold one class; their rows need not shuffle again
    words = common.materialize(common.filter_words(shared, "cluster", bits), "near-bucket-filter")
    rows = common.might_hold(rows, words, "cluster", bits, "_hit").where("_hit").drop("_hit")
    inside = rows.join(shared, "cluster").select("cluster", "node", "m", F.ceil(F.col("m") / BLOCK).alias("blocks"), "leader")
    members = common.materialize(inside.join(classes.select("node", "sig"), "node"), "near-members")
    weights = members.groupBy("node").agg(F.sum("m").alias("weight"))

    def near(group: pa.Table) -> Callable[[int, np.ndarray], np.ndarray]:
        sig = _signatures_of(group)
        return lambda a, rest: estimates(sig[a : a + 1], sig[rest])[0] >= least

    return spanning_edges(members.drop("m"), near), weights


def confirmed(docs: DataFrame, classes: DataFrame, clusters: DataFrame, repeated: DataFrame, text: str, doc_id: str, percent: int) -> DataFrame:
    """Edges (a, b) between classes that connect, in every cluster of (cluster, node, weight), the pairs that hold on their full sets; ``repeated`` has the addresses (_a, _b) of several rows."""
    wanted = common.materialize(clusters.join(classes.select("node", F.col("a").alias("_a"), F.col("b").alias("_b"), "key", "n", "sig"), "node"), "near-wanted")
    bits = common.filter_bits(wanted.count())
    words = common.materialize(common.filter_words(wanted, "_a", bits), "near-filter")
    addressed = docs.select(*common.address(doc_id, text), common.col(text).cast("string").alias("text"))
    texts = common.might_hold(addressed, words, "_a", bits, "_hit").where("_hit").drop("_hit")
    entries = repeated.count()
    if entries:  # of rows that share id and text one brings the class its set
        few = common.filter_bits(entries)
        asked = common.might_hold(texts, common.materialize(common.filter_words(repeated, "_a", few), "near-repeated-filter"), "_a", few, "_again")
        texts = asked.where(~F.col("_again")).drop("_again").unionByName(asked.where("_again").groupBy("_a", "_b").agg(F.first("text").alias("text")))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks")
    sizes = common.materialize(wanted.groupBy("cluster").agg(blocks, F.max(F.struct("weight", "node"))["node"].alias("leader")), "near-clusters")
    wanted = wanted.join(sizes, "cluster")
    kept_columns = ["cluster", "node", "blocks", "leader", "sig"]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches):
            rows = []
            for at, (value, key) in enumerate(zip(batch.column("text").to_pylist(), batch.column("key").to_pylist(), strict=True)):
                s = shingles(value).tobytes()
                if hashlib.blake2b(s, digest_size=16).digest() == key:
                    rows.append((at, s))
            kept = batch.take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([*(kept.column(n) for n in kept_columns), pa.array([r[1] for r in rows], pa.binary())], [*kept_columns, "items"])

    sets = texts.join(wanted, ["_a", "_b"]).select(*kept_columns, "key", "text").mapInArrow(common.tidy(gather), "cluster long, node long, blocks long, leader long, sig binary, items binary")

    def holding(group: pa.Table) -> Callable[[int, np.ndarray], np.ndarray]:
        sig, items = _signatures_of(group), group.column("items").to_pylist()
        size = np.array([len(x) // 8 for x in items])
        ids = np.unique(np.frombuffer(b"".join(items), np.uint64), return_inverse=True)[1]
        ends = np.concatenate([[0], np.cumsum(size)])
        mark = np.zeros(ids.max() + 1, dtype=np.int32)

        def holds(a: int, rest: np.ndarray) -> np.ndarray:
            out = np.zeros(len(rest), dtype=bool)
            able = np.flatnonzero((np.minimum(size[a], size[rest]) * 100 >= percent * np.maximum(size[a], size[rest])) & (estimates(sig[a : a + 1], sig[rest])[0] >= percent / 100 - MARGIN))
            own = ids[ends[a] : ends[a + 1]]
            mark[own] = 1
            for x in able:
                b = rest[x]
                both = int(mark[ids[ends[b] : ends[b + 1]]].sum())
                out[x] = 100 * both >= percent * (size[a] + size[b] - both)
            mark[own] = 0
            return out

        return holds

    return spanning_edges(common.materialize(sets, "near-sets"), holding)


def _rows(docs: DataFrame, text: str, doc_id: str, percent: int) -> DataFrame:
    """Per input row: doc_id, _a, _b, n_shingles, component_id, kept; see near_groups()."""
    rows = common.materialize(signatures(docs, text, doc_id, bands_for(percent)).withColumn("rid", F.monotonically_increasing_id()), "near-signatures")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "rid", F.col("_a").alias("a"), F.col("_b").alias("b")))
    classes = rows.where("key is not null").groupBy("key").agg(best.alias("best"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = common.materialize(classes.select("key", F.col("best.rid").alias("node"), F.col("best.doc_id").alias("min_id"), "best.a", "best.b", "n", "bands", "sig"), "near-classes")
    repeated = common.materialize(rows.where("key is not null").groupBy("_a", "_b").agg(F.count("*").alias("m")).where("m > 1").select("_a", "_b"), "near-repeats")
    found, weights = candidates(classes, percent)
    edges = common.materialize(found, "near-candidates")
    clusters = common.components(edges)
    clusters = clusters.select("node", F.col("root").alias("cluster")).unionAll(clusters.select(F.col("root").alias("node"), F.col("root").alias("cluster")).distinct())
    links = common.components(confirmed(docs, classes, common.materialize(clusters.join(weights, "node"), "near-clustered"), repeated, text, doc_id, percent))
    linked = common.materialize(links.unionAll(links.select(F.col("root").alias("node"), "root").distinct()).join(classes.select("node", "min_id"), "node"), "near-linked")
    heads = common.materialize(linked.groupBy("root").agg(F.min(F.struct(F.col("min_id").isNull().alias("null"), "min_id", "node")).alias("head")), "near-heads")
    owners = common.materialize(linked.join(heads, "root").select("node", F.col("head.min_id").alias("head_id"), F.col("head.node").alias("head_node")), "near-owners")
    head_id = F.when(F.col("head_node").isNull(), F.col("min_id")).otherwise(F.col("head_id"))
    resolved = common.materialize(classes.select("key", "node", "min_id").join(owners, "node", "left").select("key", head_id.alias("component_id"), F.coalesce("head_node", "node").alias("keeper")), "near-resolved")
    out = rows.select("rid", "doc_id", "_a", "_b", "key", "n").join(resolved, "key", "left")
    own = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "_a", "_b", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("keeper") == F.col("rid"), F.lit(True)).alias("kept"))


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Rows link if 100 * intersection >= percent * union of their shingle sets. component_id is the smallest id
    reachable (null ids last), and of a component exactly one row is kept: the first with that id. Rows without
    words link to nothing and are kept. An empty table gives an empty result.
    """
    return _rows(docs, text, doc_id, percent).drop("_a", "_b")


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """The input without rows that are near copies of a kept one, with its columns. Every row is decided by itself, null and repeated ids too.
    """
    decided = _rows(docs, text, doc_id, percent).select("_a", "_b", "kept")
    return common.keep_rows(docs, decided, doc_id, text)


def op4(spark, sf_dir: str) -> DataFrame:
    return near_groups(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS items
  FROM w),
e AS MATERIALIZED (SELECT doc_id, len(items) AS n, unnest(items) AS item FROM s),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS n_both
  FROM e a JOIN e b ON a.item = b.item AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM p WHERE 100 * n_both >= 85 * (nx + ny - n_both)),
r AS (SELECT doc_id, doc_id AS seen FROM s UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.seen = l.x)
SELECT s.doc_id, len(s.items)::BIGINT AS n_shingles, min(r.seen) AS component_id, s.doc_id = min(r.seen) AS kept
FROM s JOIN r USING (doc_id) GROUP BY s.doc_id, s.items
"""
