"""Table cells, array<array<string>>, as text. Rows may be ragged, cells null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def width(rows: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))


def to_markdown(rows: Column) -> Column:
    """Pipe table whose first row is the header; short rows are padded; '' without rows."""
    cols = width(rows)
    cell = lambda v: strip(F.replace(F.replace(F.coalesce(v, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    body = F.transform(rows, lambda r: line(F.transform(F.concat(r, F.array_repeat(F.lit(""), cols - F.size(r))), cell)))
    rule = F.array(line(F.array_repeat(F.lit("---"), cols)))
    whole = F.array_join(F.concat(F.slice(body, 1, 1), rule, F.slice(body, 2, F.greatest(F.size(body), F.lit(1)))), "\n")
    return F.when(F.coalesce(F.size(rows), F.lit(0)) > 0, whole).otherwise(F.lit(""))


def to_json(rows: Column) -> Column:
    """The cells as JSON, an array of arrays; '[]' without rows."""
    return F.when(F.coalesce(F.size(rows), F.lit(0)) > 0, F.to_json(rows, {"ignoreNullFields": "false"})).otherwise(F.lit("[]"))
