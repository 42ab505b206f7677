"""Plumbing shared by the corpus operators.

Scratch tables live in the folder that the session names in ``spark.checkpoint.dir``: every executor
and the driver sees them, so a lost executor never takes intermediate results with it.
"""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only after its rows were counted and are at most this many.
BROADCAST_ROWS = 100_000
#: Bit arrays of filters: bits per entry and least bits, words of 64 bits in a cell, and bytes of a filter that are broadcast at a time.
BITS_PER_ENTRY, LEAST_BITS, CELL, BROADCAST_BYTES = 32, 1 << 16, 1024, 1 << 27
HASHES = 2
#: ASCII white space of the contracts, for Java and RE2 regular expressions.
WS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_own: list[str] = []
_runs = threading.local()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its name, whatever characters it holds: dots and backticks are no paths or quotes."""
    return F.col("`" + name.replace("`", "``") + "`")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, which the session must name; on a single machine a temporary one will do."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="claimlake-"))
        base = _own[0]
    return base.rstrip("/")


def _written() -> list[str]:
    """Scratch tables of this thread: runs side by side in one driver never remove each other's."""
    if not hasattr(_runs, "written"):
        _runs.written = []
    return _runs.written


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once to a shared scratch table and read it back: cuts lineage, fixes row ids."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/claimlake/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written().append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def mark() -> int:
    """Where this thread's list of scratch tables ends now, for release()."""
    return len(_written())


def release(spark: SparkSession, since: int = 0, *keep: DataFrame) -> None:
    """Remove the scratch tables written since a mark, save the kept ones; call it when nothing reads them any more."""
    kept = [file.rsplit("/", 1)[0] for df in keep for file in df.inputFiles()]
    written = _written()
    stay = [path for path in written[since:] if any(k.endswith(path.rsplit("/", 1)[1]) for k in kept)]
    for path in written[since:]:
        if path not in stay:
            _delete(spark, path)
    written[since:] = stay


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many: a worker holds what it derives from that many texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same work, after which a worker gives back the memory that it no longer uses: it lives on for other tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            trim()

    return run


def trim() -> None:
    """Hand freed memory back to the system, where the C library knows how."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if give_back:
            give_back(0)


def discard(*tables: DataFrame) -> None:
    """Remove scratch tables that nothing will read again."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            _delete(df.sparkSession, file.rsplit("/", 1)[0])


def small_side(df: DataFrame) -> DataFrame:
    """Mark a scratch table for broadcast if its counted size allows; else the join shuffles and AQE splits hot keys."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def count_runs(text: Column, separator: str) -> Column:
    """How many words a class of separators leaves: one more than its runs, but for runs at the ends.

    A class that lists characters is matched from a table, its complement is not; so separators are counted, not words.
    """
    ends = [F.when(c.rlike(separator), 1).otherwise(0) for c in (F.substring(text, 1, 1), F.right(text, F.lit(1)))]
    runs = F.regexp_count(text, F.lit(separator + "+"))
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(runs + 1 - ends[0] - ends[1]).cast("long")


def unit_hash(*cols: Column | str, seed: int | Column = 0) -> Column:
    """A number in [0, 1) that depends on the values and the seed alone."""
    salt = seed if isinstance(seed, Column) else F.lit(seed)
    return F.pmod(F.xxhash64(*cols, salt), F.lit(1 << 48)) / F.lit(float(1 << 48))


def filter_bits(entries: int) -> int:
    bits = LEAST_BITS
    while bits < BITS_PER_ENTRY * entries:
        bits *= 2
    return bits


def _place(key: Column, bits: int) -> tuple[Column, list[Column]]:
    """A key's word in a filter, and its bits in there."""
    spread = F.xxhash64(key, F.lit(1))
    return F.pmod(F.xxhash64(key, F.lit(0)), F.lit(bits // 64)), [F.shiftrightunsigned(spread, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(HASHES)]


def _mask(bits_: list[Column]) -> Column:
    out = F.call_function("shiftleft", F.lit(1).cast("long"), bits_[0])
    for b in bits_[1:]:
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))
    return out


def filter_words(keys: DataFrame, key: str, bits: int, least: int = 1) -> DataFrame:
    """Blocked Bloom filter of a key column as rows (word, mask): the bits that at least ``least`` rows set.

    All bits of a key lie in one word. With least = 2 a key all of whose bits are set occurred twice, save for
    collisions.
    """
    word, spots = _place(F.col(key), bits)
    if least == 1:
        return keys.select(word.alias("word"), _mask(spots).alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    bit = keys.select(word.alias("word"), F.explode(F.array_distinct(F.array(*spots))).alias("b")).groupBy("word", "b").agg(F.count("*").alias("n"))
    return bit.where(F.col("n") >= least).groupBy("word").agg(F.bit_or(_mask([F.col("b")])).alias("mask"))


def filter_cells(words: DataFrame, bits: int) -> DataFrame:
    """Scratch table (_cell, _filter): the filter without gaps, CELL words to a row, so that a word takes little over its 8 bytes."""
    size = min(CELL, bits // 64)
    empty = words.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("mask"))
    whole = words.select("word", "mask").unionByName(empty).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    packed = whole.groupBy(F.expr(f"word div {size}").alias("_cell")).agg(F.array_sort(F.collect_list(F.struct("word", "mask"))).alias("all"))
    return materialize(packed.select("_cell", F.transform("all", lambda w: w["mask"]).alias("_filter")), "filter-cells")


def might_hold(df: DataFrame, words: DataFrame, key: str, bits: int, hit: str) -> DataFrame:
    """Add boolean column ``hit``: whether the filter may hold the key; df has no columns named _cell, _filter, _word, _to, _at or _own.

    No row of df shuffles, however large the filter: it is broadcast, BROADCAST_BYTES of it at a time. A larger one is
    probed part by part, and the rows of each part, which other passes skip, are written once.
    """
    size = min(CELL, bits // 64)
    cells = filter_cells(words, bits)
    word, spots = _place(F.col(key), bits)
    at = F.get(F.col("_filter"), F.col("_at").cast("int"))
    own = F.col("_own")
    parts = max(1, bits // 8 // BROADCAST_BYTES)

    def probed(rows: DataFrame, filter_: DataFrame) -> DataFrame:
        placed = rows.withColumns({"_own": _mask(spots), "_at": word % size, "_word": word}).withColumn("_to", F.expr(f"_word div {size}"))
        joined = placed.join(F.broadcast(filter_), F.col("_to") == F.col("_cell"))
        return joined.select(*[col(c) for c in df.columns], (at.bitwiseAND(own) == own).alias(hit))

    if parts == 1:
        return probed(df, cells)
    per, done = bits // 64 // parts, []
    for p in range(parts):
        mine = df.where((word >= p * per) & (word < (p + 1) * per))
        done.append(materialize(probed(mine, cells.where(F.col("_cell").between(p * per // size, (p + 1) * per // size - 1))), "filter-probed"))
    return reduce(DataFrame.unionByName, done)


def address(doc_id: str, text: str) -> list[Column]:
    """Two hashes of a row's id and text, 128 bits: rows with one address share both."""
    whole = col(text).cast("string")
    return [F.xxhash64(col(doc_id), whole).alias("_a"), F.xxhash64(F.lit(1), whole, col(doc_id)).alias("_b")]


def keep_rows(docs: DataFrame, decided: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of docs that are kept, with its columns, by (_a, _b, kept): one row per row of docs, with its address.

    Of rows with one address some of which are kept, one stays. Rows whose address a filter does not know pass
    straight; the others alone are joined with the addresses of rows that go.
    """
    gone = decided.groupBy("_a", "_b").agg(F.min("kept").alias("all_kept"), F.max("kept").alias("one"))
    gone = materialize(gone.where(~F.col("all_kept")).select(F.col("_a").alias("_x"), F.col("_b").alias("_y"), "one"), "gone")
    entries = gone.count()
    bits = filter_bits(entries)
    words = materialize(filter_words(gone, "_x", bits), "gone-filter")
    addressed = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), *address(doc_id, text))
    probed = might_hold(addressed, words, "_a", bits, "_hit")
    clear = probed.where(~F.col("_hit")).select("row.*")
    hits = probed.where("_hit").join(F.broadcast(gone) if entries <= BROADCAST_ROWS else gone, (F.col("_a") == F.col("_x")) & (F.col("_b") == F.col("_y")), "left")
    other = hits.where("_x IS NULL").select("row.*")
    once = hits.where("one").groupBy("_a", "_b").agg(F.first("row").alias("row")).select("row.*")
    return clear.unionByName(other).unionByName(once)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b) of longs: rows (node, root), root the smallest node reachable.

    Alternates large-star and small-star steps. Each step is one aggregation for the least neighbour and
    one join back; edges are scratch tables, so joins shuffle both sides and AQE may split a hub's edges.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    last = None
    for _ in range(most_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == last or not state[0]:
            break
        last = state
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = materialize(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        discard(least, now)
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        joined = large.join(least, "a")
        now = materialize(joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct(), "edges")
        discard(least, large)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
