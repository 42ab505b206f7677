"""Personal data by candidate gradient boosting.

Base patterns find e-mail addresses, IP addresses, cards and phone numbers for certain. High-recall generators
propose further spans, which may overlap; boosted trees over format and context features score them, and a
threshold calibrated for precision selects what is added. Everything runs on built-in functions; the trees are
fitted once on examples from grammars of formats and become one arithmetic expression.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .pii_examples import HASH, PERSON, SECRET, THING, Example, examples
from .spans import NO_SPANS, bind, clear_of, places, replaced, united

#: Base patterns: fixed values, written so that no text makes them retry or recurse.
#: A match may start only where a run of its first class starts, or where the match before it ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried at all.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
_DATE = r"(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9])"
#: Generators of further candidates: kind, pattern, and what any match of it holds one of (nothing: a digit).
PROPOSED = [
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}[\x20]?[(\[][\x20]?(?:at|AT)[\x20]?[)\]][\x20]?[A-Za-z0-9-]{1,63}(?:[\x20]?[(\[][\x20]?(?:dot|DOT)[\x20]?[)\]][\x20]?[A-Za-z0-9-]{1,63}){1,4}", "(["),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}[\x20]?[(\[][\x20]?(?:at|AT)[\x20]?[)\]][\x20]?[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,4}", "(["),
    ("phone", r"(?<![0-9A-Za-z+-])(?:\([0-9]{3}\)[\x20]?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9A-Za-z-])"),
    ("phone", r"(?<![0-9A-Za-z+-])00[1-9][0-9]{0,2}[\x20.-][0-9][0-9\x20.-]{6,14}[0-9](?![0-9A-Za-z-])"),
    ("phone", r"(?<![0-9A-Za-z+.-])0[1-9][0-9]{0,3}(?:[\x20/-][0-9]{2,6}){2,5}(?![0-9A-Za-z-])"),
    ("phone", r"(?<![0-9A-Za-z+./-])0[1-9][0-9]{1,4}[\x20/-][0-9]{5,8}(?![0-9A-Za-z/-])"),
    ("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){3,7}(?:[\x20]?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
    ("secret", r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{20,}+={0,2}"),
    ("secret", r"(?<![A-Za-z])(?i:password|passwd|pwd|secret|token|api[_-]?key)[\x22']?[\x20]{0,3}[:=][\x20]{0,3}[\x22']?[^\s\x22',;]{6,}+[\x22']?", ":="),
    ("secret", r"(?<![A-Za-z0-9_+/.-])eyJ[A-Za-z0-9_-]{5,}+(?:\.[A-Za-z0-9_-]{5,}+){1,2}", "J"),
    ("secret", r"-----BEGIN[A-Z\x20]{0,40}PRIVATE[\x20]KEY-----", "-"),
    ("birth", r"(?<![A-Za-z])(?i:born|dob|birth|geboren|née?|nacid[oa])[^0-9\n]{1,24}" + _DATE),
]
KINDS = [*BASE, "ssn", "iban", "secret", "birth"]
SPAN = "array<struct<kind:string,start:int,end:int,found:string>>"
PROPOSAL = "array<struct<kind:string,start:int,end:int,found:string,before:string,after:string>>"
CONTEXT = 32
#: Rounds of boosting, learning rate, cuts tried per feature, and the precision that the threshold is calibrated for.
ROUNDS, RATE, CUTS, LEAST_PRECISION = 50, 0.3, 12, 0.98


def _words(words: list[str]) -> str:
    return rf"(?i)(?<![a-z])(?:{'|'.join(words)})"


def _valid_account(found: Column) -> Column:
    """Whether an account number's check digits hold modulo 97."""
    plain = F.replace(found, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    digits = F.flatten(F.transform(F.split(moved, ""), lambda c: F.when(c.rlike("^[0-9]$"), F.array(c.cast("int"))).otherwise(F.array(F.floor((F.ascii(c) - 55) / 10).cast("int"), ((F.ascii(c) - 55) % 10).cast("int")))))
    return F.aggregate(F.filter(digits, lambda d: d.isNotNull()), F.lit(0), lambda a, d: (a * 10 + d) % 97) == 1


def features(kind: Column, found: Column, before: Column, after: Column) -> dict[str, Column]:
    """Format and context features by name, doubles."""
    count = lambda pattern, c=found: F.regexp_count(c, F.lit(pattern))
    group = lambda n: F.regexp_extract(found, r"^[^0-9]*([0-9]+)" + r"[^0-9]+([0-9]+)" * (n - 1), n)
    number = lambda c: F.coalesce(c.try_cast("int"), F.lit(-1))
    size = F.greatest(F.length(found), F.lit(1))
    value = F.regexp_replace(found, r"^(?i:password|passwd|pwd|secret|token|api[_-]?key)[\x22']?[\x20]{0,3}[:=][\x20]{0,3}", "")
    date = F.regexp_extract(found, rf"({_DATE})", 1)
    iso = date.rlike("^[0-9]{4}-")
    parts = F.split(date, "[./-]")
    day, month, year = (number(F.when(iso, F.get(parts, F.lit(2 - i))).otherwise(F.get(parts, F.lit(i)))) for i in range(3))
    flags = {
        "person": before.rlike(_words(PERSON)),
        "thing": before.rlike(_words(THING)),
        "secret_word": before.rlike(_words(SECRET)) | found.rlike(r"^(?i:password|passwd|pwd|secret|token|api[_-]?key)"),
        "hash_word": before.rlike(_words(HASH)),
        "assigned": before.rlike(r"[=:][\x20]?[\x22']?$"),
        "quoted": after.rlike(r"^[\x22']"),
        "in_table": before.rlike(r"\|[\x20]?$") | after.rlike(r"^[\x20]?\|"),
        "number_before": before.rlike(r"[0-9][\x20]?$"),
        "number_after": after.rlike(r"^[\x20][0-9]"),
        "separators": count(r"[-./\x20]"),
        "spaces": count(r"[\x20]"),
        "dots": count(r"[.]"),
        "dashes": count(r"-"),
        "digits": count("[0-9]"),
        "groups": count("[0-9]+"),
        "first_group": F.length(group(1)),
        "first_digit": number(F.substring(group(1), 1, 1)),
        "second_digit": number(F.substring(group(2), 1, 1)),
        "round": F.length(F.regexp_extract(found, "(0*)$", 1)),
        "paren": found.startswith("("),
        "double_zero": found.startswith("00"),
        "valid_account": (kind == "iban") & _valid_account(F.when(kind == "iban", found).otherwise(F.lit(""))),
        "valid_ssn": (kind == "ssn") & ~found.rlike(r"^(?:000|666|9[0-9]{2})-|-00-|-0000$"),
        "last_label": F.length(F.regexp_extract(found, r"([A-Za-z]*)$", 1)),
        "key_block": found.startswith("-----BEGIN"),
        "token_prefix": found.rlike(r"^(?:eyJ|ghp_|AKIA|sk-)"),
        "in_url": before.rlike(r"(?:://|www\.)[^\s\x22'<>]*$"),
        "value_digits": count("[0-9]", value) / F.greatest(F.length(value), F.lit(1)),
        "value_length": F.length(value),
        "digit_runs": count("[0-9]+", value) / F.greatest(F.length(value), F.lit(1)),
        "upper": count("[A-Z]", value) / F.greatest(F.length(value), F.lit(1)),
        "distinct": F.size(F.array_distinct(F.split(F.substring(value, 1, 256), ""))) / F.least(size, F.lit(256)),
        "joints": count("[_/-]", value),
        "hex": value.rlike(r"^[\x22']?[0-9a-f]{16,}[\x22']?$"),
        "date_ok": (kind == "birth") & day.between(1, 31) & month.between(1, 12) & (F.least(day, month) <= 12),
        "year_ok": (kind == "birth") & year.between(1900, 2025),
        **{f"kind_{k}": kind == k for k in ("email", "phone", "ssn", "iban", "secret", "birth")},
    }
    return {name: F.coalesce(c.cast("double"), F.lit(0.0)) for name, c in flags.items()}


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> tuple[float, list]:
    """Gradient boosting for the logistic loss with trees of depth three: start value and trees.

    A tree is a leaf value or (feature, cut, left, right); rows at or under the cut go left.
    """
    share = min(max(float(y.mean()) if len(y) else 0.5, 0.01), 0.99)
    start = math.log(share / (1 - share))
    scores, trees = np.full(len(y), start), []
    cuts = []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        middle = (values[1:] + values[:-1]) / 2
        cuts.append(middle[np.unique(np.linspace(0, len(middle) - 1, min(CUTS, len(middle))).astype(int))] if len(middle) else middle)

    def grow(at: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        leaf = rate * g[at].sum() / (h[at].sum() + 1.0)
        if not depth or len(at) < 8:
            return float(leaf)
        best = (g[at].sum() ** 2 / (h[at].sum() + 1.0) + 1e-9, None, 0.0)
        for f, tried in enumerate(cuts):
            if len(tried):
                low = x[at, f][None, :] <= tried[:, None]
                gl, hl = low @ g[at], low @ h[at]
                gain = gl**2 / (hl + 1.0) + (g[at].sum() - gl) ** 2 / (h[at].sum() - hl + 1.0)
                top = int(np.argmax(gain))
                if gain[top] > best[0] + 1e-9:
                    best = (float(gain[top]), f, float(tried[top]))
        if best[1] is None:
            return float(leaf)
        side = x[at, best[1]] <= best[2]
        return best[1], best[2], grow(at[side], g, h, depth - 1), grow(at[~side], g, h, depth - 1)

    for _ in range(rounds if len(y) else 0):
        p = 1 / (1 + np.exp(-scores))
        trees.append(grow(np.arange(len(y)), y - p, p * (1 - p), 3))
        scores = scores + grown(trees[-1], x)
    return start, trees


def grown(tree, x: np.ndarray) -> np.ndarray:
    """What a tree adds to the score of each row."""
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    return np.where(x[:, tree[0]] <= tree[1], grown(tree[2], x), grown(tree[3], x))


def tree_column(tree, inputs: list[Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    return F.when(inputs[tree[0]] <= tree[1], tree_column(tree[2], inputs)).otherwise(tree_column(tree[3], inputs))


def matrix(spark: SparkSession, rows: list[Example]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of examples, by the same expressions as the corpus' candidates."""
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, kind string, found string, before string, after string, label int")
    made = d.select("i", "label", F.array(*features(*(F.col(c) for c in ("kind", "found", "before", "after"))).values()).alias("x")).collect()  # the examples, whose number is fixed
    made.sort(key=lambda r: r["i"])
    return np.array([r["x"] for r in made]), np.array([r["label"] for r in made], dtype=float)


_fitted: list[tuple[float, list, float]] = []


def model(spark: SparkSession) -> tuple[float, list, float]:
    """Start value, trees and the least score that is selected, fitted once per process on the examples.

    The threshold is calibrated out of fold: the least one, from one half on, that holds the precision asked for.
    """
    if not _fitted:
        x, y = matrix(spark, examples())
        scored = np.zeros(len(y))
        for fold in range(4):
            out = np.arange(len(y)) % 4 == fold
            start, trees = fit(x[~out], y[~out])
            scored[out] = start + sum(grown(t, x[out]) for t in trees)
        precise = [c for c in np.unique(scored) if c >= 0 and y[scored >= c].mean() >= LEAST_PRECISION]
        _fitted.append((*fit(x, y), float(min(precise, default=math.inf))))
    return _fitted[0]


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    values = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


#: A decimal number up to 255, leading zeros allowed.
BYTE = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{0,2})"


def _fine(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        return found.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & luhn(F.substring(digits, 1, 19))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _fine_span(kind: str):
    return lambda m: _fine(kind, m["found"])


def base_spans(text: Column) -> dict[str, Column]:
    """Per kind array<struct<start, end, found>> of the base matches that hold."""
    out = {}
    for kind, pattern in BASE.items():
        there = text.contains(HINT[kind]) if kind == "email" else text.rlike(HINT[kind])
        found = F.filter(places(text, F.lit(pattern)), _fine_span(kind))
        out[kind] = F.when(there, found).otherwise(F.array().cast(NO_SPANS))
    return out


def candidates(text: Column) -> Column:
    """array<struct<kind, start, end, found, before, after>> of what the generators propose; a generator runs where its own pattern matches."""
    out = []
    for kind, pattern, *marks in PROPOSED:
        tagged = F.transform(places(text, F.lit(pattern), CONTEXT), _tag(kind, "before", "after"))
        may = reduce(or_, [text.contains(c) for c in marks[0]]) if marks else text.rlike("[0-9]")
        out.append(F.when(may & text.rlike(pattern), tagged).otherwise(F.array().cast(PROPOSAL)))
    return F.concat(*out)


def _tag(kind: str, *more: str):
    return lambda m: F.struct(F.lit(kind).alias("kind"), *[m[n].alias(n) for n in ("start", "end", "found", *more)])


def selected(proposals: Column, fitted: tuple[float, list, float]) -> Column:
    """The proposals whose score reaches the threshold, as spans."""
    start, trees, least = fitted

    def good(m: Column) -> Column:
        inputs = F.array(*features(m["kind"], m["found"], m["before"], m["after"]).values())
        score = lambda x: reduce(lambda a, t: a + tree_column(t, [x[i] for i in range(len(names))]), trees, F.lit(start))
        return bind(inputs, lambda x: score(x) >= least)

    names = list(features(*[F.lit("")] * 4))
    kept = F.filter(proposals, good) if least < math.inf else F.slice(proposals, 1, 0)
    return F.transform(kept, lambda m: F.struct(*[m[n].alias(n) for n in ("kind", "start", "end", "found")]))


def _located(docs: DataFrame, text: str) -> DataFrame:
    """(row, text, base, added): the input as one column, so that no name of it can clash."""
    fitted = model(docs.sparkSession)
    none = F.array().cast(SPAN)
    held = docs.select(F.struct(*[common.col(c) for c in docs.columns]).alias("row"), F.coalesce(common.col(text).cast("string"), F.lit("")).alias("text"))
    whole = F.col("text")
    kinds = F.when(whole.rlike("[0-9@]"), F.struct(*[c.alias(k) for k, c in base_spans(whole).items()]))
    held = held.withColumns({"kinds": kinds, "more": candidates(whole)})
    base = F.coalesce(F.concat(*[F.transform(f"kinds.{k}", _tag(k)) for k in BASE]), none)
    held = held.select("row", "text", base.alias("base"), "more")
    added = bind(selected(F.col("more"), fitted), lambda m: F.when(F.size(m) > 0, united(clear_of(m, F.col("base")))).otherwise(none))
    return held.select("row", "text", "base", F.when(F.size("more") > 0, added).otherwise(none).alias("added"))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns with ``base`` and ``added``: arrays of (kind, start, end, found), in code points, end exclusive.

    A null text has no spans. Added spans never overlap base ones; those that overlap each other are one span, with the
    kind and text of the first. Columns named like an output are replaced; repeated rows come out as often as they
    occur; an empty table gives an empty result.
    """
    found = _located(docs, text)
    return found.select(*[F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in ("base", "added")], "base", "added")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input with every span of its text replaced by its kind in angle brackets; null stays null. Overlapping spans are one; an empty table stays empty."""
    clean = F.when(F.col("row")[text].isNotNull(), replaced(F.col("text"), united(F.concat("base", "added"))))
    found = _located(docs, text).select("row", clean.alias("clean"))
    return found.select(*[F.col("clean").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])


def digest(spans: Column) -> Column:
    """kind:start:end of each span, by kind as listed and then start, comma-joined."""
    rank = lambda k: F.array_position(F.array(*[F.lit(x) for x in KINDS]), k)
    sorted_ = F.array_sort(F.transform(spans, lambda m: F.struct(rank(m["kind"]).alias("r"), m["start"].alias("start"), m["end"].alias("end"), m["kind"].alias("kind"))))
    return F.array_join(F.transform(sorted_, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ",")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda m: m["kind"] == k)).cast("long").alias(f"n_{k}")
    both = F.concat("base", "added")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(both).alias("spans"), F.size(both).cast("long").alias("n_spans"), F.size("added").cast("long").alias("n_added"))
