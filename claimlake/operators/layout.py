"""From layout primitives of pages to ordered, page-annotated content. All operators work per document and page."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables
from ..functions import text as functions_text
from ..sources import scratch

#: How far the tops of words on one line may lie apart: fixed value.
TOLERANCE = 2.0
#: Cells of a grid that a box may lie in; larger ones are compared with all of their page.
MOST_CELLS = 256


EDGES = ("x0", "top", "x1", "bottom")


def _cells(rows: DataFrame, width: float, height: float) -> DataFrame:
    """Add ``cx`` and ``cy``: a row for every cell of a grid in which a box has an area."""
    span = lambda low, high, size: F.explode(F.sequence(F.floor(F.col(low) / size), F.ceil(F.col(high) / size) - 1))
    return rows.withColumn("cx", span("x0", "x1", width)).withColumn("cy", span("top", "bottom", height))


def _clipped(boxes: DataFrame, keys: list[str], width: float, height: float) -> DataFrame:
    """Boxes cut into cells. Of the pieces in a cell that agree in three edges the largest stays, so a cell that a box fills keeps one."""
    low = {"x0": F.greatest("x0", F.col("cx") * F.lit(width)), "top": F.greatest("top", F.col("cy") * F.lit(height))}
    high = {"x1": F.least("x1", (F.col("cx") + 1) * F.lit(width)), "bottom": F.least("bottom", (F.col("cy") + 1) * F.lit(height))}
    pieces, cell = _cells(boxes, width, height).withColumns({**low, **high}), [*keys, "cx", "cy"]
    for edge in EDGES:
        widest = F.min(edge) if edge in low else F.max(edge)
        pieces = pieces.groupBy(*cell, *[e for e in EDGES if e != edge]).agg(widest.alias(edge))
    whole = (F.col("x1") - F.col("x0") == width) & (F.col("bottom") - F.col("top") == height)
    full = F.max(whole).over(Window.partitionBy(*cell))
    return pieces.withColumn("full", full).where(~F.col("full") | whole).drop("full")


def outside_tables(objects: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Layout objects that overlap no table box of their page (touching edges do not overlap); only characters are masked.

    Characters meet pieces of boxes in the cells of a grid, half as wide and high as a usual box. What has no area, no
    finite edge or lies in more than MOST_CELLS cells is compared with all of its page.
    """
    place = [*keys, *EDGES]
    typed = [*keys, *[F.col(e).cast("double").alias(e) for e in EDGES]]
    known = F.forall(F.array(*EDGES), lambda e: e.isNotNull())
    spots = scratch.written(objects.where("object_type = 'char'").select(*typed).where(known).distinct(), "char-spots")
    tables_ = scratch.written(boxes.select(*typed).where(known).distinct(), "table-boxes")
    size = tables_.agg(*[F.median(F.when(d > 0, d)).alias(n) for n, d in (("w", F.col("x1") - F.col("x0")), ("h", F.col("bottom") - F.col("top")))]).first()
    width, height = (2.0 ** (math.floor(math.log2(s)) - 1) if s and math.isfinite(s) and 1e-9 < s < 1e9 else 1.0 for s in (size["w"], size["h"]))
    covers = ((F.col("x1") - F.col("x0")) / width + 2) * ((F.col("bottom") - F.col("top")) / height + 2)
    usual = (F.col("x0") < F.col("x1")) & (F.col("top") < F.col("bottom")) & (F.greatest(*[F.abs(e) / (width if e in ("x0", "x1") else height) for e in EDGES]) < 2.0**52) & (covers <= MOST_CELLS)

    def met(chars: DataFrame, at: DataFrame, by: list[str]) -> DataFrame:
        o, b = chars.alias("o"), at.alias("b")
        on = (F.col("o.x0") < F.col("b.x1")) & (F.col("o.x1") > F.col("b.x0")) & (F.col("o.top") < F.col("b.bottom")) & (F.col("o.bottom") > F.col("b.top"))
        for k in by:
            on = on & (F.col(f"o.{k}") == F.col(f"b.{k}"))
        return o.join(b, on, "left_semi").select(*place)

    in_cells = met(_cells(spots.where(usual), width, height), _clipped(tables_.where(usual), keys, width, height), [*keys, "cx", "cy"])
    masked = in_cells.unionByName(met(spots, tables_.where(~usual), keys)).unionByName(met(spots.where(~usual), tables_.where(usual), keys)).distinct()
    o, m = objects.alias("o"), masked.alias("m")
    on = F.col("o.object_type") == "char"
    for c in place:
        on = on & ((F.col(f"o.{c}").cast("double") if c in EDGES else F.col(f"o.{c}")) == F.col(f"m.{c}"))
    return o.join(m, on, "left_anti")


def lines_of(tops: list[float | None], tolerance: float) -> list[int]:
    """The line of every word of a page, by its top: the first line whose first word's top is near enough, else a new one.

    Lines lie in cells as wide as the tolerance, so that a word meets the few lines in the cells around its own.
    """
    cells: dict[int, list[tuple[int, float]]] = {}
    out, count = [], 0
    for top in tops:
        near = []
        if top is not None and top == top and abs(top) != float("inf"):
            cell = int(top // tolerance) if tolerance else hash(top)
            near = [line for c in range(cell - 2, cell + 3) for line, first in cells.get(c, ()) if abs(first - top) <= tolerance]
            if not near:
                cells.setdefault(cell, []).append((count, top))
        out.append(min(near, default=count))
        count += not near
    return out


def cluster_lines(words: DataFrame, keys: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """Lines of words, in order of appearance: text and box. A word joins the first line whose first word's top is near enough.

    First fit depends on the order of words, so the tops of a page are one ordered array; a page bounds its size. Words
    without a top are lines of their own.
    """

    def place(tops: pa.Array) -> pa.Array:
        return pa.array([lines_of(page, tolerance) for page in tops.to_pylist()], pa.list_(pa.int32()))

    word = F.struct("ordinal", "text", "x0", "top", "x1", "bottom")
    typed = words.select(*keys, F.col("ordinal").cast("long"), "text", *[F.col(c).cast("double") for c in ("x0", "top", "x1", "bottom")])
    pages = typed.groupBy(*keys).agg(F.array_sort(F.collect_list(word)).alias("words"))
    placed = pages.withColumn("lines", F.arrow_udf(place, "array<int>")(F.transform("words", lambda w: w["top"])))
    each = placed.select(*keys, F.explode(F.arrays_zip("lines", "words")).alias("w")).select(*keys, F.col("w.lines").alias("line"), "w.words.*")
    said = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text", "x0", "top", "x1", "bottom"))), lambda w: w["text"])
    return each.groupBy(*keys, "line").agg(F.array_join(said, " ").alias("text"), F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"), F.count("*").cast("int").alias("n_words"))


def ordered(chunks: DataFrame, doc: str = "doc") -> DataFrame:
    """Add ``order``: place within the page by y0, then tables, texts, images, then the order of extraction."""
    rank = F.when(F.col("chunk_type") == "table", 0).when(F.col("chunk_type") == "text", 1).otherwise(2)
    return chunks.withColumn("order", F.row_number().over(Window.partitionBy(doc, "page").orderBy("y0", rank, "seq")) - 1)


def _keys(doc: str | list[str]) -> list[str]:
    return [doc] if isinstance(doc, str) else list(doc)


def merge_text_runs(chunks: DataFrame, doc: str | list[str] = "doc") -> DataFrame:
    """Consecutive texts of a page as one chunk: joined by line feeds, boxes united. Other chunks pass through.

    Consecutive means in order of seq within the document; a table, an image or a new page ends a run. Further columns
    keep the value of a run's first chunk.
    """
    keys = _keys(doc)
    w = Window.partitionBy(*keys).orderBy("seq")
    starts = (F.col("chunk_type") != "text") | (F.lag("chunk_type").over(w) != "text") | (F.lag("page").over(w) != F.col("page"))
    island = F.sum(F.coalesce(starts, F.lit(True)).cast("int")).over(w)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("content", F.lit("")).alias("content")))), lambda x: x["content"]), "\n")
    boxes = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    known = {*keys, "page", "chunk_type", "seq", "content", "x0", "y0", "x1", "y1"}
    rest = [F.min_by(c, "seq").alias(c) for c in chunks.columns if c not in known]
    runs = chunks.withColumn("island", island).groupBy(*keys, "island").agg(F.first("page").alias("page"), F.first("chunk_type").alias("chunk_type"), F.min("seq").alias("seq"), text.alias("content"), *boxes, *rest)
    return runs.drop("island")


def page_numbers(rows: DataFrame, doc: str = "doc", position: str = "pos", breaks: str = "has_break") -> DataFrame:
    """Add ``page``: one more than the breaks up to and including the row."""
    w = Window.partitionBy(doc).orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("page", 1 + F.sum(F.coalesce(F.col(breaks), F.lit(False)).cast("int")).over(w))


def content(chunks: DataFrame, doc: str | list[str] = "doc", page_tags: bool = False) -> DataFrame:
    """One row per document: its texts and tables that hold anything, in order, with blank lines between."""
    part = F.concat(F.format_string("[Page %d]\n", "page"), F.col("content")) if page_tags else F.col("content")
    kept = chunks.where(F.col("chunk_type").isin("text", "table") & (F.length("content") > 0))
    parts = F.array_sort(F.collect_list(F.struct("page", "order", part.alias("part"))))
    return kept.groupBy(*_keys(doc)).agg(F.array_join(F.transform(parts, lambda p: p["part"]), "\n\n").alias("content"))


def chunk_counts(chunks: DataFrame, *keys: str) -> DataFrame:
    kinds = [F.count_if(F.col("chunk_type") == k).alias(f"n_{k}") for k in ("text", "table", "image")]
    return chunks.groupBy(*keys).agg(*kinds)


def with_image_bytes(images: DataFrame, bytes_: DataFrame, doc: str = "doc") -> DataFrame:
    """Image metadata with the bytes of the same page and place, null where there are none; missing places are 0."""
    out = images.join(bytes_, [doc, "page", "image_index"], "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("x0", "y0", "x1", "y1")})


def table_chunks(layout: DataFrame, form: str = "markdown") -> DataFrame:
    """Rows of cells as text in the form asked for, with num_rows and num_cols (the longest row)."""
    cells = F.col("rows")
    return layout.withColumns({"content": tables.to_json(cells) if form == "json" else tables.to_markdown(cells), "num_rows": F.size(cells), "num_cols": tables.width(cells)})


def chunks(layout: DataFrame, doc: list[str], form: str = "markdown") -> DataFrame:
    """Ordered chunks of decoded files: words become lines, lines are cleaned, texts in a row are one chunk, and chunks are numbered per page from 0.

    A format with a reading order of its own gives ``seq``; else chunks of a page go by their upper edge, and of equal
    ones tables come before texts and texts before images.
    """
    box = ["x0", "y0", "x1", "y1"]
    shape = [*doc, "page", "seq", "pos", *box]
    words = layout.where("kind = 'word'").select(*doc, "page", F.col("pos").alias("ordinal"), "text", "x0", F.col("y0").alias("top"), "x1", F.col("y1").alias("bottom"))
    lines = cluster_lines(words, [*doc, "page"]).select(*doc, "page", F.lit(None).cast("int").alias("seq"), F.col("line").alias("pos"), "x0", F.col("top").alias("y0"), "x1", F.col("bottom").alias("y1"), F.col("text").alias("content"))
    texts = layout.where("kind = 'text'").select(*shape, F.col("text").alias("content")).unionByName(lines)
    texts = texts.withColumns({"content": functions_text.clean_text(F.col("content")), "chunk_type": F.lit("text")})
    boxed = table_chunks(layout.where("kind = 'table'"), form).select(*shape, "content", "num_rows", "num_cols", F.lit("table").alias("chunk_type"))
    images = layout.where("kind = 'image'").select(*shape, "image", "width", "height", "image_index", F.lit("image").alias("chunk_type"))
    every = texts.unionByName(boxed, allowMissingColumns=True).unionByName(images, allowMissingColumns=True)
    rank = F.when(F.col("chunk_type") == "table", 0).when(F.col("chunk_type") == "text", 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy(*doc).orderBy("page", "y0", "seq", rank, "pos", "image_index"))
    runs = merge_text_runs(every.withColumn("seq", place).drop("pos"), doc)
    said = F.when(F.col("chunk_type") != "image", F.col("content"))
    return runs.withColumns({"content": said, "order": F.row_number().over(Window.partitionBy(*doc, "page").orderBy("seq")) - 1})


def rendered(chunks: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, shown): a document as text for reading: heading, column heads between rules, one line per chunk."""
    line = functions_text.chunk_line(*[F.col(c) for c in ("page", "order", "chunk_type", "content", "num_rows", "num_cols", "image_index", "width", "height")])
    lines = F.array_sort(F.collect_list(F.struct("page", "order", line.alias("line"))))
    rule = F.lit("-" * 120)
    head = F.concat(F.lit("Document: "), F.col(doc).cast("string"), F.lit(" ("), F.count("*").cast("string"), F.lit(" chunks extracted)"))
    parts = [head, rule, F.lit("PAGE | ORDER | TYPE  | CONTENT SUMMARY"), rule, F.array_join(F.transform(lines, lambda x: x["line"]), "\n")]
    return chunks.groupBy(doc).agg(F.concat_ws("\n", *parts).alias("shown"))


def as_records(chunks: DataFrame) -> DataFrame:
    """Chunks as JSON text; bytes are replaced by whether there are any."""
    box = F.struct("x0", "y0", "x1", "y1").alias("bbox")
    own = [c for c in chunks.columns if c not in ("x0", "y0", "x1", "y1", "image")]
    has = [F.col("image").isNotNull().alias("has_bytes")] if "image" in chunks.columns else []
    return chunks.select(F.to_json(F.struct(*own, box, *has), {"ignoreNullFields": "false"}).alias("record"))
