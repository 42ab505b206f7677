"""From nested extractions to field observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

PAYMENTS = "payments_made"
#: Levels that are written out in the expression; what lies deeper is folded.
LEVELS = 4
NODES = "array<struct<path:string,v:variant>>"


def text_of(v: Column, name: str) -> Column:
    """A member of a variant as text; null if it is absent or null."""
    return F.try_variant_get(v, f"$.{name}", "string")


def _is_leaf(v: Column) -> Column:
    """Whether a variant is null, or an object with both a value and a page."""
    has = [F.try_variant_get(v, f"$.{n}", "variant").isNotNull() for n in ("value", "_page")]
    return F.coalesce(F.is_variant_null(v) | (has[0] & has[1]), F.lit(False))


def _children(node: Column) -> Column:
    """The members of an object that are walked, with their paths; none of a scalar or an array."""
    members = F.map_entries(F.try_variant_get(node["v"], "$", "map<string,variant>"))
    walked = F.filter(members, lambda e: ~e["key"].startswith("_") & (e["key"] != PAYMENTS))
    path = lambda e: F.when(node["path"] == "", e["key"]).otherwise(F.concat_ws(".", node["path"], e["key"]))
    return F.coalesce(F.transform(walked, lambda e: F.struct(path(e).alias("path"), e["value"].alias("v"))), F.array().cast(NODES))


def _marked(nodes: Column) -> Column:
    """Nodes with whether they are leaves."""
    return F.transform(nodes, lambda n: F.struct(n["path"].alias("path"), n["v"].alias("v"), _is_leaf(n["v"]).alias("leaf")))


def _deeper(path: Column, v: Column) -> Column:
    """The leaves below a node, however deep they lie: opened level by level until no object is left.

    A node has no more levels than opening braces.
    """
    state = f"struct<open:{NODES},leaves:{NODES}>"
    first = F.struct(F.array(F.struct(path.alias("path"), v.alias("v"))).alias("open"), F.array().cast(NODES).alias("leaves")).cast(state)

    def level(s: Column, _: Column) -> Column:
        below = lambda kids: F.struct(F.filter(kids, lambda n: ~_is_leaf(n["v"])).alias("open"), F.concat(s["leaves"], F.filter(kids, lambda n: _is_leaf(n["v"]))).alias("leaves")).cast(state)
        return F.when(F.size(s["open"]) == 0, s).otherwise(text.bind(F.flatten(F.transform(s["open"], _children)), below))

    most = F.regexp_count(F.to_json(v), F.lit(r"\{"))
    return F.aggregate(F.sequence(F.lit(0), most), first, level, lambda s: s["leaves"])


def leaves(extractions: DataFrame, variant: str, *keys: str) -> DataFrame:
    """(keys, path, reason, value, page) for every leaf of a variant, however deep it lies.

    A leaf is an object with both ``value`` and ``_page``, or a bare null. Other objects are walked; scalars and arrays
    are skipped (elements of arrays have no key), as are keys that start with an underscore and payments. Texts are read
    within the row: a member of a variant that leaves it takes the names of the whole document along.
    """
    nodes = _marked(_children(F.struct(F.lit("").alias("path"), F.col(variant).alias("v"))))
    for _ in range(LEVELS):
        nodes = F.flatten(F.transform(nodes, lambda n: F.when(n["leaf"], F.array(n)).otherwise(_marked(_children(n)))))
    nodes = F.flatten(F.transform(nodes, lambda n: F.when(n["leaf"], F.array(F.struct(n["path"].alias("path"), n["v"].alias("v")))).otherwise(_deeper(n["path"], n["v"]))))
    read = lambda n: F.struct(n["path"].alias("path"), text_of(n["v"], "reason").alias("reason"), text_of(n["v"], "value").alias("value"), F.try_variant_get(n["v"], "$._page", "int").alias("page"))
    return extractions.where(F.col(variant).isNotNull()).select(*keys, F.explode(F.transform(nodes, read)).alias("one")).select(*keys, "one.*")


def observations(leaf_rows: DataFrame) -> DataFrame:
    """Leaves that say something; the texts 'null' and '' do."""
    return leaf_rows.where(F.col("value").isNotNull())


def payments(extractions: DataFrame, variant: str, *keys: str) -> DataFrame:
    """(keys, pos, date, amount, description, page): the payments that extractions list."""
    rows = extractions.select(*keys, F.try_variant_get(variant, f"$.financials.{PAYMENTS}", "array<struct<date:string,amount:string,description:string,_page:int>>").alias("p"))
    return rows.select(*keys, F.posexplode("p").alias("pos", "one")).select(*keys, "pos", "one.date", "one.amount", "one.description", F.col("one._page").alias("page"))
