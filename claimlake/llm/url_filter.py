"""URL filtering by association rules.

URLs that a list rule decides are labelled with its verdict; all others have no label. FP-growth mines the token
combinations that go with a blocked label. A combination becomes a rule if enough labelled URLs support it, if nearly
all of them are blocked, and if they are most of all the URLs that hold it: a host whose pages the list blocks, but
for a few that it does not mention, is blocked altogether, whereas one of which it mentions a few is not. Rules that a
shorter one covers are dropped; the others lie in an inverted index from their rarest token. A URL looks up its tokens
there and checks what else a rule asks for. Rules may have any number of tokens. List rules always win; what no rule of either kind covers is allowed.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: (verdict, host, path): fixed values. A rule fits its host and all subdomains if the path starts with the rule's.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Least share of labelled URLs that support a rule, least share of these that are blocked, least share of a rule's URLs that are labelled.
MIN_SUPPORT, MIN_CONFIDENCE, MIN_COVERAGE = 0.01, 0.9, 0.65
#: Least number of labelled URLs that support a rule: fewer tell nothing.
MIN_URLS = 10
#: Most tokens of a URL that FP-growth combines: its rarest frequent ones. Combinations of more are grown level by level; matching reads all tokens.
MOST_TOKENS = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first '://' up to '/', '?', '#' or end, in lower case; path: from there up to '?', '#' or end."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def list_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, at, under in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(under)
        out = F.when(fits, F.struct(F.lit(at + under).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: host labels with their place from the right, the parts of hyphenated ones, and all path segments with their place."""
    labels = F.reverse(F.split(host, r"\."))
    hosts = F.transform(labels, lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit(":"), x))
    hyphened = F.flatten(F.transform(F.filter(labels, lambda x: x.contains("-")), lambda x: F.split(x, "-")))
    parts = F.transform(F.filter(hyphened, lambda x: F.length(x) > 0), lambda x: F.concat(F.lit("w:"), x))
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: F.length(x) > 0), lambda x, i: F.concat(F.lit("p"), i.cast("string"), F.lit(":"), x))
    return F.when(F.length(host) > 0, F.array_distinct(F.concat(hosts, parts, segments))).otherwise(F.array().cast("array<string>"))


def frequent(urls: DataFrame, label: str, least: int) -> DataFrame:
    """(_item, _n): tokens of at least so many URLs with the label and how many URLs hold them; of tokens that lie in the same URLs, the first by name."""
    each = urls.select("_url", "verdict", F.explode("tokens").alias("_item"))
    often = common.materialize(each.where(F.col("verdict") == label).groupBy("_item").agg(F.count("*").alias("_hits")).where(F.col("_hits") >= least), "url-often")
    where = [F.bit_xor(F.xxhash64("_url", F.lit(seed))).alias(f"_x{seed}") for seed in (0, 1)]
    covers = each.join(common.small_side(often), "_item").groupBy("_item").agg(F.count("*").alias("_n"), *where)
    return covers.groupBy("_n", "_x0", "_x1").agg(F.min("_item").alias("_item")).select("_item", "_n")


def grown(sets: DataFrame, label: str, least: int) -> DataFrame:
    """(items): token sets of any size that at least so many rows (_url, verdict, kept) with the label hold, grown by one token at a time.

    A set that as many URLs hold as one of its subsets has that one's figures and fits the same URLs, and so does all that
    grows from it: only sets rarer than all their subsets go on. What is left out is thus covered by a shorter rule.
    """
    counts = [F.count_if(F.col("verdict") == label).alias("_hits"), F.count("*").alias("_all")]
    held = common.materialize(sets.select("_url", "verdict", F.explode("kept").alias("_item")).select("_url", "verdict", F.array("_item").alias("items")), "url-held")
    good = common.materialize(held.groupBy("items").agg(*counts).select("items", "_all"), "url-good")
    out, size = good.select("items"), 1
    while not good.isEmpty():
        parts = held.select("_url", "verdict", F.slice("items", 1, size - 1).alias("_head"), F.element_at("items", -1).alias("_last"))
        other = parts.select("_url", "_head", F.col("_last").alias("_next"))
        pairs = parts.join(other, ["_url", "_head"]).where(F.col("_last") < F.col("_next"))
        pairs = common.materialize(pairs.select("_url", "verdict", F.concat("_head", F.array("_last", "_next")).alias("items")), "url-pairs")
        counted = common.materialize(pairs.groupBy("items").agg(*counts).where(F.col("_hits") >= least).select("items", "_all"), "url-counted")
        subsets = counted.select(F.col("items").alias("_set"), F.col("_all").alias("_own"), F.explode(F.transform("items", lambda x: F.array_remove("items", x))).alias("items"))
        rarer = subsets.join(common.small_side(good), "items").where(F.col("_own") < F.col("_all")).groupBy(F.col("_set").alias("items"), F.col("_own").alias("_all")).count()
        good, size = common.materialize(rarer.where(F.col("count") == size + 1).drop("count"), "url-good"), size + 1
        held = common.materialize(pairs.join(common.small_side(good), "items").select("_url", "verdict", "items"), "url-held")
        out = out.unionByName(good.select("items"))
    return out


def mine(judged: DataFrame, label: str = "block", min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_coverage: float = MIN_COVERAGE, min_urls: int = MIN_URLS) -> DataFrame:
    """Rules (items, support, confidence, coverage) for a label from rows (tokens, verdict); rows without a label have a null verdict.

    Only tokens frequent among URLs with the label are mined, of those that always come together one. FP-growth mines
    their combinations, of a URL with more than MOST_TOKENS the rarest ones, so that it forms at most 2 ** (MOST_TOKENS + 1)
    sets per URL. Where a URL has more, the combinations of all its tokens are grown level by level besides.
    """
    spark = judged.sparkSession
    urls = common.materialize(judged.where(F.size("tokens") > 0).select(F.monotonically_increasing_id().alias("_url"), "tokens", "verdict"), "url-tokens")
    n = urls.where(F.col("verdict").isNotNull()).count()
    none = spark.createDataFrame([], "items array<string>, support long, confidence double, coverage double")
    least = max(min_urls, int(min_support * n))
    if n < least:
        return none
    items = common.materialize(frequent(urls, label, least), "url-frequent")
    each = urls.select("_url", "verdict", F.explode("tokens").alias("_item")).join(common.small_side(items), "_item")
    rarest = F.transform(F.array_sort(F.collect_list(F.struct("_n", "_item"))), lambda k: k["_item"])
    sets = common.materialize(each.groupBy("_url", "verdict").agg(rarest.alias("kept")), "url-sets")
    labelled = sets.where(F.col("verdict").isNotNull())
    if labelled.isEmpty():
        return none
    goal = F.lit("=" + label)
    mined = labelled.select(F.array_append(F.slice("kept", 1, MOST_TOKENS), F.concat(F.lit("="), F.col("verdict"))).alias("items"))
    own = common.materialize(mined, "url-mined")
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / own.count())).fit(own).freqItemsets
    found = common.materialize(found.select(F.array_sort("items").alias("items"), "freq"), "url-itemsets")
    hits = found.where((F.size("items") > 2) & F.array_contains("items", "=" + label)).select(F.array_remove("items", goal).alias("items"), F.col("freq").alias("hits"))
    combined = hits.join(found, "items").where(F.col("hits") >= min_confidence * F.col("freq")).select("items")
    tried = combined.unionByName(items.select(F.array("_item").alias("items")))
    if not sets.where(F.size("kept") > MOST_TOKENS).isEmpty():
        tried = tried.unionByName(grown(sets, label, least).select(F.array_sort("items").alias("items")))
    tried = common.materialize(tried.distinct(), "url-tried")
    # counted over all URLs, labelled or not, so that a rule's figures do not depend on which tokens were mined together
    rare = tried.select("items", F.explode("items").alias("_item")).join(common.small_side(items), "_item").groupBy("items").agg(F.min_by("_item", F.struct("_n", "_item")).alias("_item"))
    met = sets.select("verdict", "kept", F.explode("kept").alias("_item")).join(common.small_side(common.materialize(rare, "url-anchors")), "_item")
    fits = met.where(F.size(F.array_except("items", "kept")) == 0)
    counted = fits.groupBy("items").agg(F.count_if(F.col("verdict") == label).alias("support"), F.count("verdict").alias("known"), F.count("*").alias("all"))
    rules = counted.select("items", "support", (F.col("support") / F.col("known")).alias("confidence"), (F.col("known") / F.col("all")).alias("coverage"))
    return rules.where((F.col("support") >= least) & (F.col("confidence") >= min_confidence) & (F.col("coverage") >= min_coverage))


def inverted_index(rules: DataFrame, shortest: bool = False) -> dict[str, list[list[str]]]:
    """From a rule's least used token (the first by name of ties) to what else it asks for; with ``shortest`` rules that hold a shorter rule are dropped."""
    rows = sorted(rules.select("items").collect(), key=lambda r: (len(r["items"]), r["items"]))  # bounded by 1 / min_support, see mine()
    kept: list[frozenset[str]] = []
    for row in rows:
        items = frozenset(row["items"])
        if not (shortest and any(k <= items for k in kept)):
            kept.append(items)
    used: dict[str, int] = {}
    for items in kept:
        for item in items:
            used[item] = used.get(item, 0) + 1
    index: dict[str, list[list[str]]] = {}
    for items in kept:
        anchor = min(sorted(items), key=lambda x: used[x])
        index.setdefault(anchor, []).append(sorted(items - {anchor}))
    return index


def _lookup(index: dict[str, list[list[str]]]) -> Column:
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rest = lambda r: "array(" + ", ".join(map(quoted, r)) + ")" if r else "cast(array() as array<string>)"
    return F.expr("map(" + ", ".join(f"{quoted(k)}, array({', '.join(map(rest, v))})" for k, v in index.items()) + ")")


def matches(toks: Column, index: dict[str, list[list[str]]]) -> Column:
    """Whether any rule of the index fits the tokens."""
    if not index:
        return F.lit(False)
    lookup = _lookup(index)
    return F.exists(toks, lambda t: F.exists(F.coalesce(F.try_element_at(lookup, t), F.array().cast("array<array<string>>")), lambda rest: F.size(F.array_except(rest, toks)) == 0))


def filter_urls(pages: DataFrame, url: str = "url", rules=RULES, **how) -> DataFrame:
    """All columns with host, path, rule and verdict (such columns of the input are replaced).

    A null URL or one without '://' has empty host and path and is allowed; repeated rows are judged alike and all
    come out; where the list decides nothing, nothing is mined; an empty table gives an empty result.
    """
    host, path = host_and_path(common.col(url))
    own = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    parted = pages.select(F.struct(*[common.col(c) for c in own]).alias("row") if own else F.lit(None).alias("row"), host.alias("host"), path.alias("path"))
    judged = parted.withColumns({"list": list_rule(F.col("host"), F.col("path"), rules), "tokens": tokens(F.col("host"), F.col("path"))})
    index = inverted_index(mine(judged.select("tokens", F.col("list.verdict").alias("verdict")), **how), shortest=True)
    verdict = F.coalesce(F.col("list.verdict"), F.when(matches(F.col("tokens"), index), F.lit("block")).otherwise(F.lit("allow")))
    decided = judged.select("row", "host", "path", F.col("list.rule").alias("rule"), verdict.alias("verdict"))
    return decided.select(*[F.col("row")[c].alias(c) for c in own], "host", "path", "rule", "verdict")


def op8(spark, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")
