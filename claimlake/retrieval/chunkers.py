"""Chunkers over whole texts, in column expressions. Offsets count code points of the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind
from ..sources import scratch

SIZE, OVERLAP = 1000, 150
#: Where a text may be cut, best first: after a paragraph, a line, a sentence, a word. Patterns with the characters each takes.
SEPARATORS = [(r"\n\n", 2), (r"\n", 1), (r"[.!?] ", 2), (" ", 1)]
#: A sentence with what ends it; sentences follow one another without gaps.
SENTENCE = r"[^.!?\n]*[.!?\n]+ *|[^.!?\n]+"
#: Sentences on each side of a gap that are compared, and the share of a text's gaps that become cuts at most.
WINDOW, SHARE = 3, 0.2


def _sums(numbers: Column) -> Column:
    """(total, before): the sum of an array and of what comes before each element."""
    state = "struct<total:bigint,before:array<bigint>>"
    begin = F.struct(F.lit(0).alias("total"), F.array().alias("before")).cast(state)
    return F.aggregate(numbers, begin, lambda s, n: F.struct((s["total"] + n).alias("total"), F.array_append(s["before"], s["total"]).alias("before")))


def starts(lengths: Column, group: int = 256) -> Column:
    """What comes before each element of an array of lengths. Groups are summed apart, as arrays are copied when they grow."""
    count = lambda a: F.greatest(F.ceil(F.size(a) / group).cast("int"), F.lit(1))
    split = lambda a: F.transform(F.sequence(F.lit(0), count(a) - 1), lambda g: _sums(F.slice(a, g * group + 1, F.lit(group))))
    shift = lambda inner, base: F.flatten(F.zip_with(inner, base, lambda i, b: F.transform(i["before"], lambda x: x + b)))
    return bind(lengths, lambda a: bind(split(a), lambda inner: bind(_sums(F.transform(inner, lambda i: i["total"]))["before"], lambda base: shift(inner, base))))


def pattern(size: int) -> str:
    """The next piece: all that is left if it fits, else up to the last of the best separators within the size, else the size."""
    cuts = [f".{{0,{size - n}}}{p}" for p, n in SEPARATORS if n <= size]
    return "(?s)" + "|".join([f".{{1,{size}}}\\z", *cuts, f".{{1,{size}}}"])


def pieces(text: Column, size: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern(size)), F.lit(0))


def tail(piece: Column, overlap: int) -> Column:
    """The last characters of a piece, from the first whole word on if there is white space among them."""
    if not overlap:
        return F.lit("")
    return bind(F.right(piece, F.lit(overlap)), lambda t: F.when(F.length(piece) <= overlap, t).otherwise(F.regexp_replace(t, r"(?s)\A[^ \n]*[ \n]", "")))


def recursive(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Rows doc_id, chunk, start, length, fresh, text: chunks of at most ``size`` characters that follow a hierarchy of separators.

    What is ``fresh`` (an offset into the source) follows on the chunk before without gaps; ahead of it stand up to
    ``overlap`` characters of that chunk, from a word's beginning if they hold one. Null and empty texts have no chunks.
    Every input row is cut on its own, and in time linear in its text. Other columns are left out.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    parts = pieces(scratch.col(text).cast("string"), size - overlap)

    def shape(own: Column, at: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            before = F.when(i > 0, tail(F.get(own, i - 1), overlap)).otherwise(F.lit(""))
            return bind(before, lambda b: F.struct((F.get(at, i) - F.length(b)).alias("start"), (F.length(p) + F.length(b)).cast("long").alias("length"), F.get(at, i).alias("fresh"), F.concat(b, p).alias("text")))

        return F.transform(own, one)

    made = bind(parts, lambda own: bind(starts(F.transform(own, lambda p: F.length(p).cast("long"))), lambda at: shape(own, at)))
    return docs.where(F.length(scratch.col(text).cast("string")) > 0).select(scratch.col(doc_id).alias("doc_id"), F.posexplode(made).alias("chunk", "c")).select("doc_id", "chunk", "c.start", "c.length", "c.fresh", "c.text")


def words(text: Column) -> Column:
    """Distinct words: runs of digits, ASCII letters, which are lower-cased, and everything beyond ASCII."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), ""))


def semantic(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """Rows doc_id, chunk, start, length, n_sentences, text: chunks between the gaps where the wording changes most.

    A gap's similarity is that of the words of the sentences around it, ``window`` on each side: shared ones by all. A text
    is cut at gaps whose similarity lies below the value that a ``share`` of its own gaps does not exceed, so there is no
    fixed size, and a text whose gaps are alike stays whole. Null and empty texts have no chunks. Other columns are left out.
    """
    sentences = F.regexp_extract_all(scratch.col(text).cast("string"), F.lit(SENTENCE), F.lit(0))

    def similarity(sets: Column, i: Column) -> Column:
        left = F.array_distinct(F.flatten(F.slice(sets, F.greatest(i - window + 1, F.lit(1)), F.least(i, F.lit(window)))))
        right = F.array_distinct(F.flatten(F.slice(sets, i + 1, F.lit(window))))
        return bind(left, lambda a: bind(right, lambda b: F.size(F.array_intersect(a, b)).cast("double") / F.greatest(F.size(F.array_union(a, b)), F.lit(1))))

    def gaps(own: Column) -> Column:
        many = F.size(own)
        return F.when(many > 1, bind(F.transform(own, words), lambda sets: F.transform(F.sequence(F.lit(1), F.greatest(many - 1, F.lit(1))), lambda i: similarity(sets, i)))).otherwise(F.array().cast("array<double>"))

    def cut(similar: Column) -> Column:
        """Numbers of the sentences that begin a chunk."""
        least = F.get(F.array_sort(similar), F.floor(F.size(similar) * F.lit(share)).cast("int"))
        low = bind(least, lambda m: F.filter(F.transform(similar, lambda s, i: F.when(s < m, i + 1)), lambda i: i.isNotNull()))
        return F.concat(F.array(F.lit(0)), low)

    def shape(own: Column, begin: Column, at: Column) -> Column:
        def one(b: Column, i: Column) -> Column:
            n = F.coalesce(F.get(begin, i + 1), F.size(own)) - b
            return bind(F.array_join(F.slice(own, b + 1, n), ""), lambda t: F.struct(F.get(at, b).alias("start"), F.length(t).cast("long").alias("length"), n.alias("n_sentences"), t.alias("text")))

        return F.transform(begin, one)

    made = bind(sentences, lambda own: bind(bind(gaps(own), cut), lambda begin: bind(starts(F.transform(own, lambda s: F.length(s).cast("long"))), lambda at: shape(own, begin, at))))
    return docs.where(F.length(scratch.col(text).cast("string")) > 0).select(scratch.col(doc_id).alias("doc_id"), F.posexplode(made).alias("chunk", "c")).select("doc_id", "chunk", "c.start", "c.length", "c.n_sentences", "c.text")


def contained(children: DataFrame, parents: DataFrame, doc_id: str = "doc_id", cell: int = SIZE) -> DataFrame:
    """Rows doc_id, chunk, parent: every chunk of ``children`` with the chunk of ``parents`` that its fresh part begins in.

    Both tables are as ``recursive`` makes them, of any sizes. Texts are laid out in cells; a parent goes to the cells it
    covers, a child to the one it begins in, so that a long text costs no more than its length. A chunk of a row without
    an id, and one that begins in no parent, has none. Ids must be unique.
    """
    end = (F.col("start") + F.col("length")).alias("end")
    spans = parents.select(F.col(doc_id).alias("d"), F.col("chunk").alias("parent"), F.col("fresh").alias("low"), end)
    cells = F.sequence(F.expr(f"low div {cell}"), F.expr(f"greatest(low, end - 1) div {cell}"))
    spans = spans.withColumn("cell", F.explode(cells))
    hits = children.select(F.col(doc_id).alias("doc_id"), "chunk", "fresh", F.expr(f"fresh div {cell}").alias("cell"))
    on = (F.col("doc_id") == F.col("d")) & (hits["cell"] == spans["cell"]) & (F.col("fresh") >= F.col("low")) & (F.col("fresh") < F.col("end"))
    return hits.join(spans, on, "left").select("doc_id", "chunk", "parent")


def expanded(hits: DataFrame, links: DataFrame, query_id: str = "query_id", score: str = "score") -> DataFrame:
    """Rows query_id, doc_id, parent, score, n_hits, best_chunk: hits on children as one row per query and parent.

    A parent has the score of its best child, of equal ones the first. Hits without a parent go.
    """
    joined = hits.select(F.col(query_id).alias("query_id"), "doc_id", "chunk", F.col(score).alias("score")).join(links.where("parent IS NOT NULL"), ["doc_id", "chunk"])
    best = F.min_by("chunk", F.struct(-F.col("score"), F.col("chunk"))).alias("best_chunk")
    return joined.groupBy("query_id", "doc_id", "parent").agg(F.max("score").alias("score"), F.count("*").alias("n_hits"), best)


def recursive_sql(docs: str, name: str, size: int = SIZE, overlap: int = OVERLAP) -> str:
    """CTEs that end in ``name`` (doc_id, chunk, start, length, fresh, text); docs is a table (doc_id, text)."""
    own = size - overlap
    cuts = ", ".join(f"nullif(length(regexp_extract(w, '(?s)^.*{p}')), 0)" for p, _ in SEPARATORS)
    step = f"CASE WHEN length(rest) <= {own} THEN length(rest) ELSE coalesce({cuts}, {own}) END"
    back = f"CASE WHEN length(p) <= {overlap} THEN p ELSE regexp_replace(right(p, {overlap}), '(?s)^[^ \\n]*[ \\n]', '') END"
    return f"""
{name}_w(doc_id, chunk, fresh, rest, piece) AS (
  SELECT doc_id, -1, 0::BIGINT, text, '' FROM {docs} WHERE length(text) > 0
  UNION ALL
  SELECT doc_id, chunk + 1, fresh + length(piece), substr(rest, n + 1), substr(rest, 1, n)
  FROM (SELECT *, {step} AS n FROM (SELECT *, substr(rest, 1, {own}) AS w FROM {name}_w WHERE rest <> ''))),
{name}_p AS (SELECT doc_id, chunk, fresh, piece, lag(piece) OVER (PARTITION BY doc_id ORDER BY chunk) AS p FROM {name}_w WHERE chunk >= 0),
{name}_b AS (SELECT doc_id, chunk, fresh, piece, CASE WHEN p IS NULL THEN '' ELSE {back} END AS b FROM {name}_p),
{name} AS MATERIALIZED (
  SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, fresh - length(b) AS start, length(b) + length(piece) AS length, fresh, b || piece AS text
  FROM {name}_b)"""


SEMANTIC_SQL = rf"""
WITH s AS (SELECT doc_id, regexp_extract_all(text, '{SENTENCE}') AS own FROM documents WHERE length(text) > 0),
w AS (
  SELECT doc_id, own, list_transform(own, lambda x: list_distinct(list_filter(regexp_split_to_array(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda t: t <> ''))) AS sets
  FROM s),
g AS (
  SELECT doc_id, own, list_transform(range(1, len(own)), lambda i: list_distinct(flatten(sets[greatest(i - {WINDOW - 1}, 1) : i]))) AS a,
    list_transform(range(1, len(own)), lambda i: list_distinct(flatten(sets[i + 1 : i + {WINDOW}]))) AS b
  FROM w),
m AS (
  SELECT doc_id, own, list_transform(range(1, len(own)), lambda i: len(list_intersect(a[i], b[i]))::DOUBLE / greatest(len(a[i]) + len(b[i]) - len(list_intersect(a[i], b[i])), 1)) AS sims
  FROM g),
c AS (
  SELECT doc_id, own, list_concat([0], list_filter(range(1, len(own)), lambda i: sims[i] < list_sort(sims)[1 + floor(len(sims) * {SHARE})::BIGINT])) AS begins
  FROM m),
e AS (SELECT doc_id, own, begins, unnest(range(1, len(begins) + 1)) AS k FROM c),
t AS (SELECT doc_id, k - 1 AS chunk, own[begins[k] + 1 : coalesce(begins[k + 1], len(own))] AS part FROM e),
j AS (SELECT doc_id, chunk, len(part) AS n_sentences, array_to_string(part, '') AS text FROM t)
SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, (coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start,
  length(text) AS length, CAST(n_sentences AS INTEGER) AS n_sentences, text
FROM j
"""
