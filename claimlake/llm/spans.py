"""Places of all matches of a pattern, with built-in functions alone.

A text is the pieces between matches and the matches, in turn. Splitting and extracting by the same pattern
walk through the text alike, so running lengths give every match's place in code points. A fold copies what it
has gathered at every step, so running values are built block by block: n matches cost n * BLOCK, not n * n.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_SPANS = "array<struct<start:int,end:int,found:string>>"
#: Values in a block of running values, and characters in a chunk of a text.
BLOCK, CHUNK = 128, 4096


def bind(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), with c computed once however often it occurs in there."""
    return F.transform(F.array(c), use)[0]


def _fold(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running values of a short array: op over each value and those before it."""
    none = F.array().cast("array<int>")
    return F.aggregate(values, none, lambda a, x: F.array_append(a, F.when(F.size(a) == 0, x).otherwise(op(F.element_at(a, -1), x))))


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each of an array<int> without nulls, op (sum or greatest) over it and all values before it."""

    def blocks(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / BLOCK).cast("int") - 1), lambda b: _fold(F.slice(v, b * BLOCK + 1, F.lit(BLOCK)), op))

    def joined(local: Column) -> Column:
        carried = _fold(F.transform(local, lambda block: F.element_at(block, -1)), op)
        shift = lambda c: F.flatten(F.transform(local, lambda block, i: F.when(i == 0, block).otherwise(F.transform(block, lambda x: op(c[i - 1], x)))))
        return bind(carried, shift)

    whole = bind(values, lambda v: F.when(F.size(v) <= BLOCK, _fold(v, op)).otherwise(bind(blocks(v), joined)))
    return whole


def total(a: Column, b: Column) -> Column:
    return a + b


def places(text: Column, pattern: Column, context: int = 0) -> Column:
    """array<struct<start, end, found>> of the leftmost non-overlapping matches; the pattern must not match nothing.

    With ``context`` there are also ``before`` and ``after``: so many characters around a match, up to the next one.
    """

    def gap(g: Column) -> Column:
        around = [F.right(g, F.lit(context)).alias("before"), F.left(g, F.lit(context)).alias("after")] if context else []
        return F.struct(F.length(g).alias("n"), *around)

    def located(x: Column) -> Column:
        n = F.size(x["hits"])
        pairs = F.zip_with(x["hits"], F.slice(x["gaps"], 1, n), lambda h, g: F.struct(h.alias("found"), g.alias("gap")))
        ends = running(F.zip_with(x["hits"], F.slice(x["gaps"], 1, n), lambda h, g: F.length(h) + g["n"]), total)
        spans = F.zip_with(pairs, ends, lambda p, e: F.struct((e - F.length(p["found"])).alias("start"), e.alias("end"), p["found"].alias("found"), *([p["gap"]["before"].alias("before")] if context else [])))
        if not context:
            return spans
        after = F.slice(x["gaps"], 2, n)
        return F.zip_with(spans, after, lambda s, g: F.struct(*[s[k].alias(k) for k in ("start", "end", "found", "before")], g["after"].alias("after")))

    hits, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.transform(F.split(text, pattern, -1), gap)
    kind = NO_SPANS.replace(">>", ",before:string,after:string>>") if context else NO_SPANS
    return bind(F.struct(hits.alias("hits"), gaps.alias("gaps")), lambda x: F.when(F.size(x["hits"]) > 0, located(x)).otherwise(F.array().cast(kind)))


def clear_of(spans: Column, others: Column) -> Column:
    """Those spans (with start and end, end exclusive) that overlap none of the others, in order of their starts."""

    def check(items: Column) -> Column:
        ends = running(F.transform(items, lambda x: F.when(x["own"], F.lit(0)).otherwise(x["span"]["end"])), F.greatest)
        starts = F.reverse(running(F.reverse(F.transform(items, lambda x: F.when(x["own"], F.lit(-(2**31) + 1)).otherwise(-x["span"]["start"]))), F.greatest))
        free = F.zip_with(F.zip_with(items, ends, lambda x, e: F.struct(x.alias("x"), e.alias("e"))), starts, lambda p, s: F.struct(p["x"].alias("x"), (p["e"] <= p["x"]["span"]["start"]).alias("after"), (-s >= p["x"]["span"]["end"]).alias("before")))
        return F.transform(F.filter(free, lambda f: f["x"]["own"] & f["after"] & f["before"]), lambda f: f["x"]["span"])

    tag = lambda a, own: F.transform(a, lambda m: F.struct(m["start"].alias("at"), F.lit(own).alias("own"), m.alias("span")))
    return bind(F.array_sort(F.concat(tag(others, False), tag(spans, True))), check)


def united(spans: Column) -> Column:
    """Spans (kind, start, end, found) that overlap as one, from the first's start to the last end, with the first's kind and text.

    Of equal starts the longer comes first, then the kind in order of code points.
    """

    def merge(s: Column) -> Column:
        upto = running(F.transform(s, lambda m: m["end"]), F.greatest)

        def clusters(e: Column) -> Column:
            opens = lambda m, i: (i == 0) | (F.get(e, i - 1) <= m["start"])
            first = F.filter(s, opens)
            last = F.transform(F.filter(F.transform(e, lambda x, i: F.struct(x.alias("end"), i.alias("i"))), lambda x: (x["i"] == F.size(s) - 1) | (F.get(s, x["i"] + 1)["start"] >= x["end"])), lambda x: x["end"])
            return F.zip_with(first, last, lambda m, end: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), end.alias("end"), m["found"].alias("found")))

        return bind(upto, clusters)

    order = F.array_sort(F.transform(spans, lambda m: F.struct(m["start"].alias("start"), (-m["end"]).alias("last"), m["kind"].alias("kind"), m["found"].alias("found"))))
    plain = F.transform(order, lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), (-m["last"]).alias("end"), m["found"].alias("found")))
    return bind(plain, merge)


def replaced(text: Column, spans: Column) -> Column:
    """The text with each of its spans (kind, start, end), in order and clear of each other, replaced by its kind in angle brackets."""

    def cut(chunks: Column, low: Column, high: Column) -> Column:
        a, b = F.floor(low / CHUNK).cast("int"), F.floor(high / CHUNK).cast("int")
        at = lambda i: F.coalesce(F.get(chunks, i), F.lit(""))
        one = F.substring(at(a), low % CHUNK + 1, high - low)
        many = F.concat(F.substring(at(a), low % CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice(chunks, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), F.substring(at(b), F.lit(1), high % CHUNK))
        return F.when(a == b, one).otherwise(many)

    def fill(x: Column) -> Column:
        s, chunks = x["spans"], x["chunks"]
        parts = F.transform(s, lambda m, i: F.concat(cut(chunks, F.coalesce(F.get(s, i - 1)["end"], F.lit(0)), m["start"]), F.lit("<"), m["kind"], F.lit(">")))
        return F.concat(F.array_join(parts, ""), cut(chunks, F.element_at(s, -1)["end"], x["n"]))

    chunks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, bind(F.struct(spans.alias("spans"), chunks.alias("chunks"), F.length(text).alias("n")), fill)).otherwise(text)
