import hashlib
import itertools
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlake.llm import common, exact_dedup, license_scan, mixing, near_dedup, packing, pii, pii_examples, quality, queries, sharding, spans, tokens, topk, url_filter

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30000 + "ann@example.com"
ODD = [(1, None), (2, ""), (3, "  \n"), (4, "a b"), (5, "a b"), (5, "a b"), (None, "a  b"), (6, LONG), (7, "ünï 日本 <|endoftext|>  x"), (8, LONG)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None, None if i in (1, 4) else "s", None) for i, t in ODD], DOC).withColumns({"shard": F.lit("x"), "kept": F.lit(1), "labels": F.lit("y"), "base": F.lit(2)})


@pytest.fixture(scope="module")
def docs(spark, data):
    return common.table(spark, data, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_matches_sql(spark, data, duck, agree, name):
    agree(queries.QUERIES[name](spark, data).toPandas(), duck.sql(queries.ORACLES[name]).df())


@pytest.mark.parametrize("apply", [packing.pack, mixing.mix, near_dedup.near_groups, near_dedup.near_dedup, sharding.shard, pii.find, pii.redact, license_scan.scan, exact_dedup.exact_dedup, lambda d: url_filter.filter_urls(d, "text")])
def test_odd_and_empty_tables(odd, apply):
    assert apply(odd).count() > 0
    assert apply(odd.where("false")).count() == 0


def test_exact_dedup(odd):
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.mark_copies(odd).collect()}
    assert got == {(1, 3, 3, False), (2, 3, 3, False), (3, 3, 3, True), (4, None, 4, False), (5, None, 4, False), (None, None, 4, True), (6, 6, 2, True), (8, 6, 2, False), (7, 7, 1, True)}
    assert exact_dedup.exact_dedup(odd).count() == 4


def test_packing(spark, data, texts):
    rows = packing.op1(spark, data).collect()
    slow = tokens.Encoder(tokens.tokenizer_path("byte_bpe_50k.json"))
    ids = {i: slow.ids(t) + bytes(4) for i, t in texts.items()}
    seen, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(ids[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"]
        assert 4 * r["doc_tokens"] == len(ids[r["doc_id"]])
        seen[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for group, total in [(v, len(ids[k]) // 4) for k, v in seen.items()] + [(v, None) for v in sequences.values()]:
        at = 0
        for start, length in sorted(group):
            assert start == at
            at += length
        assert at == total if total is not None else at <= packing.LENGTH
    assert set(seen) == set(ids)
    padded = sum(packing.LENGTH - n for v in sequences.values() if (n := sum(x for _, x in v)) & (n - 1))
    assert padded < 0.03 * packing.LENGTH * len(sequences)


def test_packing_ids_round_trip(spark):
    d = spark.createDataFrame([(1, "one two"), (2, "three " * 1500), (3, None)], "doc_id long, text string")
    packed = packing.pack(d, keep_ids=True)
    slow = tokens.Encoder(tokens.tokenizer_path("byte_bpe_50k.json"))
    whole = b"".join(bytes(r["ids"]) for r in packing.sequences(packed).collect())
    assert Counter(np.frombuffer(whole, "<u4").tolist()) == Counter(np.frombuffer(b"".join(slow.ids(t) + bytes(4) for t in ("one two", "three " * 1500, "")), "<u4").tolist())


def test_packing_cuts_where_patterns_leave_room(spark):
    """Texts of about 600 ids, of which no two fit a sequence: cut, the sequences are full, and every id is in one piece with its sum."""
    draw = np.random.default_rng(8)
    texts = {i: " ".join(f"w{x}" for x in draw.integers(0, 9, draw.integers(296, 304))) for i in range(400)}
    slow = tokens.Encoder(tokens.tokenizer_path("byte_bpe_50k.json"))
    ids = {i: slow.ids(t) + bytes(4) for i, t in texts.items()}
    for keep in (False, True):
        rows = packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), keep_ids=keep).collect()
        parts, load = defaultdict(list), defaultdict(list)
        for r in rows:
            piece = ids[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]
            assert zlib.crc32(piece) == r["ids_crc32"] and (not keep or bytes(r["ids"]) == piece)
            parts[r["doc_id"]].append((r["start"], r["length"]))
            load[r["sequence_id"]].append((r["offset"], r["length"]))
        for group in [*parts.values(), *load.values()]:
            at = 0
            for start, length in sorted(group):
                assert start == at
                at += length
        assert {i: sum(n for _, n in v) for i, v in parts.items()} == {i: len(x) // 4 for i, x in ids.items()}
        assert max(sum(n for _, n in v) for v in load.values()) <= packing.LENGTH
        assert sum(map(len, ids.values())) / 4 / packing.LENGTH / len(load) > 0.95
        assert len(rows) > 400


@pytest.mark.parametrize("n", [1, 8, 9, 16, 17, 700, 1023])
def test_sums_of_cut_pieces(n):
    ids = np.random.default_rng(n).integers(0, 50000, n).astype("<u4").tobytes()
    marks = np.frombuffer(packing.prefix_sums(ids), "<u4").tolist()
    assert marks == [zlib.crc32(ids[: 4 * k]) for k in range(packing.MARK, n, packing.MARK)]
    assert [packing.rest_sum(zlib.crc32(ids), m, n - k) for m, k in zip(marks, range(packing.MARK, n, packing.MARK), strict=True)] == [zlib.crc32(ids[4 * k :]) for k in range(packing.MARK, n, packing.MARK)]


def test_packing_long_white_space(spark):
    texts = [" " * 1_000_000, "\n" * 1_000_000 + "x", "a" + "\t " * 300_000, "x" * 300_000]
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    slow = tokens.Encoder(tokens.tokenizer_path("byte_bpe_50k.json"))
    assert {r["doc_id"]: r["doc_tokens"] for r in rows} == {i: len(slow.ids(t)) // 4 + 1 for i, t in enumerate(texts)}
    assert sum(r["length"] for r in rows) == sum(len(slow.ids(t)) // 4 + 1 for t in texts)


def test_column_generation():
    sizes = packing.class_sizes()
    for n in (0, 1, 700):
        lengths = np.random.default_rng(n).integers(1, 1025, n)
        demand = np.bincount(np.searchsorted(sizes, lengths), minlength=len(sizes))
        patterns, times = packing.solve(demand, sizes, 1024)
        assert ((patterns * times[:, None]).sum(0) == demand).all()
        assert (patterns @ sizes <= 1024).all()
        assert times.sum() <= lengths.sum() / 1024 * 1.15 + 1


def test_mixing(spark, data, docs):
    rows = mixing.op2(spark, data).collect()
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        s = source[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    weight = {s: float((3, 1, 2)[i % 3]) for i, s in enumerate(sorted(sizes))}
    want, fixed, left = {}, {}, 1.5 * sum(sizes.values())
    while True:
        free = [s for s in sizes if s not in fixed]
        want = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if want[s] > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            fixed[s] = 2.0 * sizes[s]
        left = 1.5 * sum(sizes.values()) - sum(fixed.values())
    assert target == pytest.approx(want | fixed)
    assert abs(sum(taken.values()) - sum(target.values())) < 0.1 * sum(target.values())
    assert sorted(map(str, rows)) == sorted(map(str, mixing.op2(spark, data).collect()))


def test_sharding(spark, data, texts):
    rows = sharding.op6(spark, data).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in texts.items()}
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(24))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_op6_describes_what_the_operator_writes(spark, data, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "shards"))
    place = lambda rows: {(r["doc_id"], r["shard"], r["slot"]) for r in rows.select("doc_id", "shard", "slot").collect()}
    assert place(sharding.op6(spark, data)) == place(spark.read.parquet(str(tmp_path / "shards")))


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if fine:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_base_spans(spark, texts):
    hard = ["a@b.c_d@e.f x", "1.2.3.4.5.6.7.8", "999.1.1.1 0255.1.1.01", "4111 1111 1111 1111x4111-1111-1111-1111", "+1 (244) 555-4688.", "é😀 a.b@c-d.org", "@@", "a@b", "+1", "1" * 5000, "x@" + "y." * 5000 + "z", "a" * 50000]
    d = spark.createDataFrame(list(enumerate([*hard, *texts.values()])), "doc_id long, text string")
    for r in pii.find(d).collect():
        assert [(m["kind"], m["start"], m["end"]) for m in r["base"]] == brute_spans(r["text"]), r["text"][:80]


def test_pii_additions(spark):
    want = {
        "please call 555-223-4567 now": ["phone"], "please send to 415-555-2671 tomorrow": ["phone"], "order no. 555-123-4567 shipped": [], "whatsapp 0033 1 42 68 53 00 ok": ["phone"], "call 0045 33 12 34 56 now": ["phone"], "sum of 100 200 3000 units": [], "isbn 978-316-1484": [],
        "my ssn 123-45-6789": ["ssn"], "code 000-12-3456": [], "iban DE89 3704 0044 0532 0130 00": ["iban"], "iban DE88 3704 0044 0532 0130 00": [], "key AB12 CDEF GHIJ KLMN activates": [], "mail me: ann (at) example (dot) com": ["email"],
        'x token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" y': ["secret"], "commit 24be64439e3e49cf46b2d7c90f3602a3d0b907ff fixed": [], "password: required for all": [], "-----BEGIN RSA PRIVATE KEY-----": ["secret"], "https://example.com/en/articles/2024/some-long-title-of-the-page": [],
        "born on 12.03.1980 in Lyon": ["birth"], "nothing here at all": [], "": [],
    }
    d = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    assert {r["text"]: [m["kind"] for m in r["added"]] for r in pii.find(d).collect()} == want
    rows = [(1, "to a@b.org and +1 (244) 555-4688!"), (2, None), (3, 'é😀 token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff".'), (4, "+49 30 901820 a@b.c_d@e.f")]
    clean = pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["text"] for r in clean] == ["to <email> and <phone>!", None, "é😀 <secret>.", "<phone> <email><email>"]


def test_pii_held_out(spark):
    """Examples that the trees never saw: precision and recall, over all and for each kind."""
    rows = pii_examples.examples(seed=99, each=200)
    x, y = pii.matrix(spark, rows)
    start, trees, least = pii.model(spark)
    hit = start + sum(pii.grown(t, x) for t in trees) >= least
    assert y[hit].mean() > 0.97 and hit[y == 1].mean() > 0.95
    for kind in {r[0] for r in rows}:
        own = np.array([r[0] == kind for r in rows])
        assert y[hit & own].mean() > 0.9 and hit[own & (y == 1)].mean() > 0.9, kind


def test_pii_generators_propose_their_examples(spark):
    rows = [e for e in pii_examples.examples(seed=5, each=200) if e[4]]
    d = spark.createDataFrame([(e[0], e[1]) for e in rows], "kind string, text string").distinct()
    missed = d.where(~F.exists(pii.candidates(F.col("text")), lambda m: (m["kind"] == F.col("kind")) & F.col("text").endswith(m["found"]))).collect()
    assert len(missed) < 0.02 * len(rows), missed[:5]


def test_pii_query_by_columns(spark, data, texts):
    """Counts, digest and spans of the query against a plain version of the contract; added spans are clear of base ones."""
    for r in pii.op7(spark, data).collect():
        text = texts[r["doc_id"]]
        base = brute_spans(text)
        assert [r[f"n_{k}"] for k in PII] == [sum(b[0] == k for b in base) for k in PII]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        every = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r["spans"].split(",") if x)]
        added = [x for x in every if x not in base]
        assert sorted(every) == sorted([*base, *added]) and len(every) == r["n_spans"] and len(added) == r["n_added"]
        assert not any(a < d and c < b for _, a, b in added for _, c, d in [*base, *(x for x in added if x[1:] != (a, b))])
        for secret in re.finditer(r'token = "([0-9a-f]{40})"', text):
            assert any(k == "secret" and a <= secret.start(1) and secret.end(1) <= b for k, a, b in added)


def test_pii_many_spans_in_one_text(spark):
    """A text with many matches costs as much as its length: the outcome is right and quickly there."""
    text = " ".join(f"ann{i}@example.com ssn {100 + i % 500}-45-{1000 + i % 8000}" for i in range(20000))
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.perf_counter()
    r = pii.find(d).select(F.size("base").alias("b"), F.size("added").alias("a"), F.element_at("base", -1).alias("last")).first()
    assert (r["b"], r["a"], r["last"]["found"]) == (20000, 20000, "ann19999@example.com")
    assert pii.redact(d).first()["text"] == " ".join(["<email> ssn <ssn>"] * 20000)
    assert time.perf_counter() - began < 60


def test_spans_against_plain_versions(spark):
    draw = np.random.default_rng(4)
    kind = "array<struct<kind:string,start:int,end:int,found:string>>"
    made = lambda n, top: [("ab"[i % 2], int(s), int(s + draw.integers(1, 9)), "f") for i, s in enumerate(draw.integers(0, top, n))]
    rows = [(k, made(draw.integers(0, 8), 60), made(draw.integers(0, 8), 60)) for k in range(200)] + [(k, made(400, 9000), made(300, 9000)) for k in (200, 201)]
    text = "".join(chr(97 + i % 26) if i % 7 else "é" for i in range(9100))
    d = spark.createDataFrame(rows, f"k int, a {kind}, b {kind}").withColumn("t", F.lit(text))
    for r in d.select("a", "b", spans.clear_of(F.col("a"), F.col("b")).alias("c"), spans.united(F.col("a")).alias("u"), spans.replaced(F.col("t"), spans.united(F.col("a"))).alias("x")).collect():
        assert Counter(map(tuple, r["c"])) == Counter(tuple(x) for x in r["a"] if not any(o["start"] < x["end"] and x["start"] < o["end"] for o in r["b"]))
        whole, out, at = [], "", 0
        for s, minus, k in sorted((x["start"], -x["end"], x["kind"]) for x in r["a"]):
            if whole and s < whole[-1][2]:
                whole[-1][2] = max(whole[-1][2], -minus)
            else:
                whole.append([k, s, -minus])
        assert [[x["kind"], x["start"], x["end"]] for x in r["u"]] == whole
        for k, s, e in whole:
            out, at = out + text[at:s] + f"<{k}>", e
        assert r["x"] == out + text[at:]


def test_url_filter(spark):
    urls = ["https://Www.Example.com/en/71", "http://x.com/en/1?a", "http://com/en/", "http://notcom/en/", "http://a.net/de/8", "http://a.example.net/de/80#x", "ftp://org/es/", "no scheme", None, "http://host", "x://a.com?/en/"]
    got = {r["id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "id long, url string")).collect()}
    assert got == {
        0: ("www.example.com", "/en/71", "example.com/en/7", "allow"), 1: ("x.com", "/en/1", "com/en/", "block"), 2: ("com", "/en/", "com/en/", "block"), 3: ("notcom", "/en/", None, "allow"), 4: ("a.net", "/de/8", "net/de/", "block"),
        5: ("a.example.net", "/de/80", "example.net/de/8", "block"), 6: ("org", "/es/", "org/es/", "block"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("host", "", None, "allow"), 10: ("a.com", "", None, "allow"),
    }


def plain_rules(rows, least, confidence, coverage, most=3):
    """Rules by counting every combination: token sets of (tokens, verdict or None)."""
    seen = defaultdict(lambda: [0, 0, 0])
    for toks, verdict in rows:
        for k in range(1, most + 1):
            for items in itertools.combinations(sorted(set(toks)), k):
                seen[items][0] += verdict == "block"
                seen[items][1] += verdict is not None
                seen[items][2] += 1
    return {k: v[0] for k, v in seen.items() if v[0] >= least and v[0] >= confidence * v[1] and v[1] >= coverage * v[2]}


def test_url_rules_against_counting(spark):
    draw = np.random.default_rng(6)
    rows = []
    for _ in range(600):
        toks = [f"a{draw.integers(3)}", f"b{draw.integers(4)}", f"c{draw.integers(6)}"]
        bad = toks[0] == "a1" and toks[2] != "c0"
        rows.append((toks, None if draw.random() < (0.2 if bad else 0.7) else "block" if bad and draw.random() < 0.97 else "allow"))
    d = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    got = {tuple(r["items"]): r["support"] for r in url_filter.mine(d, min_support=0.02, min_confidence=0.9, min_coverage=0.6, min_urls=5).collect()}
    n = sum(v is not None for _, v in rows)
    assert got == plain_rules(rows, max(5, int(0.02 * n)), 0.9, 0.6)
    assert got


def test_url_rules_of_many_tokens(spark):
    """Rules of four tokens, and of tokens that are not among a URL's ten rarest: the same rows are met as by counting all combinations."""
    draw = np.random.default_rng(8)
    rows = []
    for _ in range(300):
        toks = [f"t{i}{'a' if draw.random() < (0.6 if i < 2 else 0.85) else 'b'}" for i in range(12)] + ["u", "v"]
        bad = toks[0] == "t0a" and toks[9:12] == ["t9a", "t10a", "t11a"]
        rows.append((toks, None if draw.random() < 0.2 else "block" if bad else "allow"))
    how = {"min_support": 0.2, "min_confidence": 0.98, "min_coverage": 0.6}
    got = [frozenset(r["items"]) for r in url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), **how).collect()]
    wanted = plain_rules([(t[:12], v) for t, v in rows], int(0.2 * sum(v is not None for _, v in rows)), 0.98, 0.6, most=12)
    assert wanted and {i for i, (t, _) in enumerate(rows) if any(r <= set(t) for r in got)} == {i for i, (t, _) in enumerate(rows) if any(set(r) <= set(t) for r in wanted)}


def test_url_rules_decide_unlisted_pages(spark):
    """A host whose pages the list blocks but for a few is blocked altogether; one of which it mentions a few is not."""
    rows = [f"http://www.cheap-pills.example.com/{'en' if i % 5 else 'fr'}/1{i}" for i in range(100)] + [f"http://blog.fine.example.com/{'en' if i % 5 == 0 else 'fr'}/{i}00" for i in range(100)]
    rows += [f"http://a{i}.example.com/en/7{i}" for i in range(40)] + [f"http://b{i}.example.org/fr/deep/{'/'.join(map(str, range(30)))}/{i}" for i in range(60)] + [f"http://{'.'.join(f'x{k}' for k in range(25))}.com/en/{i}" for i in range(60)]
    got = url_filter.filter_urls(spark.createDataFrame(list(enumerate(rows)), "id long, url string").withColumns({"host": F.lit(1), "tokens": F.lit(2), "list": F.lit(3), "row": F.lit(4)}))
    assert set(got.columns) == {"id", "url", "tokens", "list", "row", "host", "path", "rule", "verdict"}
    verdicts = Counter((r["url"].split("/")[2].split(".")[1], r["url"].split("/")[3], r["rule"], r["verdict"]) for r in got.collect() if "example.com" in r["url"] and "/7" not in r["url"][:30])
    assert verdicts[("cheap-pills", "fr", None, "block")] == 20
    assert verdicts[("cheap-pills", "en", "com/en/", "block")] == 80
    assert verdicts[("fine", "fr", None, "allow")] == 80
    assert got.where("rule IS NULL AND verdict = 'block' AND url NOT LIKE '%pills%'").isEmpty()


def test_url_query_list_columns(spark, data, duck, agree):
    """Host, path, rule and, where a rule fits, verdict of the query as SQL has them."""
    sql = r"""
    WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
    r AS (SELECT * FROM (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')) AS t(verdict, site, under)),
    f AS (SELECT page_id, site || under AS rule, verdict FROM h JOIN r ON (host = site OR ends_with(host, '.' || site)) AND starts_with(path, under) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(site || under) DESC) = 1)
    SELECT page_id, host, path, rule, verdict FROM h LEFT JOIN f USING (page_id)"""
    out = url_filter.op8(spark, data)
    assert {r["verdict"] for r in out.collect()} <= {"allow", "block"}
    agree(out.withColumn("verdict", F.when(F.col("rule").isNotNull(), F.col("verdict"))).toPandas(), duck.sql(sql).df())


def test_license_scan(spark, texts):
    hard = ["The MIT-License, mit license mit license", "GNU General Public License, version 3 or later", "licensed under CC BY-NC 4.0.", "Apache License, Version 2.0", "mitlicense", "MİT license", "SPDX-License-Identifier: Apache-2.0"]
    d = spark.createDataFrame(list(enumerate([*hard, *texts.values()])), "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan.scan(d).collect()}
    for i, text in enumerate([*hard, *texts.values()]):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        words, starts, labels = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower), [], set()
        for phrase, label in license_scan.PHRASES:
            p = phrase.split()
            at = [j for j in range(len(words)) if words[j : j + len(p)] == p]
            starts += at
            labels |= {label} if at else set()
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))
        assert labels <= set(r["labels"].split(","))
    assert got[1]["labels"] == "gpl,gpl-3.0-or-later"
    assert got[2]["labels"] == "cc-by-nc-4.0"
    assert len(license_scan.rules()) > 200


def plain_labels(text):
    """Labels of the rules' places that are left when places that overlap are settled one after the other, by comparing all pairs."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in re.sub(license_scan.PLUS, r"\1 or later ", text))
    words = f" {' '.join(re.findall('[^' + chr(0) + '-/:-`{-' + chr(127) + ']+', lower))} "
    found = []
    for label, _, pattern, priority in license_scan.rules():
        found += [(m.start(), m.end(), priority, label) for m in re.finditer(rf"(?<= )(?:{pattern})(?= )", words)]
    found = sorted(set(found), key=lambda d: (d[0], -d[1], -d[2], d[3]))
    kept = []
    for d in found:
        over = [o for o in kept if o[1] > d[0]]
        if not any(o[2] >= d[2] for o in over):
            kept = [o for o in kept if o not in over] + [d]
    return {d[3] for d in kept}, max((d[2] for d in kept), default=0)


def test_license_query_against_plain_rules(spark, data, texts):
    """All columns of the query and the suppression of contained detections, on the documents and on mixed phrases."""
    draw = np.random.default_rng(12)
    phrases = [p for _, _, pattern, _ in license_scan.rules() for p in bare_phrases(pattern)] + [p for p, _ in license_scan.PHRASES]
    glue = [" ", ", ", "\n", " and ", ". The ", " or later ", " 2.0 ", " x-"]
    mixed = ["".join(draw.choice(phrases) + draw.choice(glue) for _ in range(draw.integers(1, 8))) for _ in range(150)]
    got = license_scan.scan(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(mixed)], "doc_id long, text string")).unionByName(license_scan.op9(spark, data).withColumn("text", F.lit(None)), allowMissingColumns=True)
    rows = got.collect()
    assert len(rows) == len(mixed) + len(texts)
    for r in rows:
        text = mixed[-1 - r["doc_id"]] if r["doc_id"] < 0 else texts[r["doc_id"]]
        labels, best = plain_labels(text)
        base = set(filter(None, r["base_labels"].split(",")))
        assert r["labels"] == ",".join(sorted(labels | base)), text[:200]
        assert r["score"] == max(license_scan.CONFIDENCE.get(best, 0.0), license_scan.CONFIDENCE[license_scan.MIDDLE] if base else 0.0)


def bare_phrases(pattern):
    """The shortest and the longest way to write a rule: optional parts left out with first alternatives, then all of them with last ones."""
    for long in (False, True):
        text = re.sub(r"\[(\w+)\]", lambda m: m[1][-long], pattern)
        while "(?:" in text:
            text = re.sub(r"\(\?:([^()]*)\)(\??)", lambda m: "" if m[2] and not long else m[1].split("|")[-long], text)
        yield re.sub(r"(.)\?", r"\1" if long else "", text)


def test_license_rules_fire_on_bare_phrases(spark):
    """Nothing but the phrase in the text, on one line or broken over lines."""
    cases = [(label, join.join(phrase.split())) for label, _, pattern, _ in license_scan.rules() for phrase in bare_phrases(pattern) for join in (" ", "\n  ")]
    cases += [("apache-2.0", "Apache-2.0"), ("apache-2.0", "Apache Version 2.0"), ("bsd-3-clause", "BSD 3-Clause"), ("bsd-3-clause", "3-clause BSD"), ("proprietary", "all rights\nreserved"), ("cc-by-4.0", "Creative  Commons\tAttribution 4.0")]
    d = spark.createDataFrame(cases, "label string, text string")
    missed = [(r["label"], r["text"], r["labels"]) for r in license_scan.scan(d.withColumnRenamed("label", "want")).withColumnRenamed("want", "label").collect() if r["label"] not in r["labels"].split(",") or not r["score"]]
    assert not missed, missed[:10]
    assert license_scan.scan(spark.createDataFrame([(1, "the clauses of apaches and of the public, all reserved")], "doc_id long, text string")).first()["labels"] == ""


def test_near_dedup_chain_and_short_texts(spark):
    base = [f"w{i}" for i in range(200)]
    chain = [" ".join(base)]
    for k in range(1, 8):
        words = chain[-1].split()
        words[k * 20] = f"new{k}"
        chain.append(" ".join(words))
    other = ["a b", "A  b", "a b c", "", None, " ".join(f"z{i}" for i in range(100))]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(chain + other)], "doc_id long, text string")
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in near_dedup.near_groups(d).collect()}
    assert all(got[i] == (0, i == 0) for i in range(8))
    assert [got[i] for i in range(8, 14)] == [(8, True), (8, False), (10, True), (11, True), (12, True), (13, True)]


def test_near_dedup_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join([*base[: i % 7], f"x{i}", *base[i % 7 + 1 :]])) for i in range(60)]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0}
    assert sum(r["kept"] for r in got) == 1


def brute_components(texts, percent):
    sets = [set(zip(*[t.split()[k:] for k in range(5)])) for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= percent * len(a | b):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root


@pytest.mark.parametrize("block", [4, 256])
def test_near_dedup_families_in_blocks(spark, monkeypatch, block):
    """Variants of a base that link only through it, chains and strangers: as brute force finds them, whatever the size of blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    draw, texts = np.random.default_rng(5), []
    for family in range(3):
        base = [f"f{family}w{i}" for i in range(240)]
        variants = []
        for v in range(25):
            words = list(base)
            for at in draw.choice(48, draw.integers(1, 5), replace=False) * 5:
                words[at] = f"v{family}x{v}x{at}"
            variants.append(" ".join(words))
        texts += [*variants[:20], " ".join(base), *variants[20:]]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts, near_dedup.PERCENT)


def test_near_dedup_repeated_rows(spark, monkeypatch):
    """Thousands of rows with one id and text bring their class one set, and one of them stays."""
    base = " ".join(f"w{i}" for i in range(200))
    near = [" ".join(f"w{i}" for i in range(k, 200 + k)) for k in (1, 2)]
    rows = [(None, base)] * 5000 + [(4, near[0])] * 300 + [(None, near[1]), (9, ""), (9, ""), (None, None)]
    sets, whole = [], common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, label: (out := whole(df, label), sets.append(out) if label == "near-sets" else None)[0])
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r["component_id"], r["kept"]) for r in near_dedup.near_groups(d).collect()) == {(4, False): 5300, (4, True): 1, (9, True): 2, (None, True): 1}
    assert [s.count() for s in sets] == [3]
    left = near_dedup.near_dedup(d.withColumns({"row": F.lit(1), "_a": F.lit(2), "key": F.lit(3)}))
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == {(4, near[0]): 1, (9, ""): 2, (None, None): 1}
    assert left.columns == ["doc_id", "text", "row", "_a", "key"]


def test_near_dedup_null_ids(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(None, f"{base} {i}") for i in range(30)] + [(3, f"{base} z"), (None, "alone in the whole wide world")]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["component_id"], r["kept"]) for r in got) == {(3, True): 1, (3, False): 30, (None, True): 1}


def test_bit_estimates():
    a = near_dedup.shingles(" ".join(f"w{i}" for i in range(1000)))
    b = near_dedup.shingles(" ".join(f"w{i}" for i in range(60, 1060)))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    sig = [np.frombuffer(near_dedup.pack_bits(near_dedup.minima(x)), np.uint8)[None, :] for x in (a, b)]
    assert abs(near_dedup.estimates(*sig)[0, 0] - true) < 0.12
    assert near_dedup.estimates(sig[0], sig[0])[0, 0] == 1


@pytest.mark.parametrize("percent", [60, 80, 85, 95])
def test_bands_and_margin_suit_the_threshold(spark, percent):
    """At the threshold a pair shares no band with under one in a million, and the margin is over four standard errors."""
    rows = near_dedup.signatures(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), "text", "doc_id", near_dedup.bands_for(percent)).first()
    bands, n, alike = len(rows["bands"]), len(rows["sig"]) * 8 // near_dedup.BITS, percent / 100
    assert n == bands * near_dedup.ROWS
    assert (1 - alike**near_dedup.ROWS) ** bands < 1e-6
    equal = alike + (1 - alike) / 2**near_dedup.BITS
    assert near_dedup.MARGIN > 4 * (equal * (1 - equal) / n) ** 0.5 / (1 - 2**-near_dedup.BITS)


def test_near_dedup_takes_bands_from_percent(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(near_dedup, "signatures", lambda *how: asked.append(how[3:]) or 1 / 0)
    for percent in (80, 85):
        with pytest.raises(ZeroDivisionError):
            near_dedup.near_dedup(spark.createDataFrame([(1, "a")], "doc_id long, text string"), percent=percent)
    assert asked == [(36,), (24,)]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 3), (7, 7), (3, 1)], "a long, b long")
    assert {(r["node"], r["root"]) for r in common.components(edges).collect()} == {(2, 1), (3, 1), (9, 1), (5, 4)}
    assert common.components(edges.where("false")).count() == 0


def test_quality_held_out(spark):
    data = "/root/testdata/sf0.01"
    got = quality.op3(spark, data).join(common.table(spark, data, "labels"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 50
    assert (held.predicted == held.quality).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_quality_against_plain_numpy(spark, data, docs):
    """Every score of the query by a plain version: all training rows in one array, a fold left out at a time, pooled bins."""
    labels = {r["doc_id"]: r["quality"] for r in common.table(spark, data, "labels").collect()}
    rows = docs.select("doc_id", "text").collect()
    x = np.array([quality.statistics(r["text"]) for r in rows])
    held = np.array([zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows])
    teach = np.flatnonzero([r["doc_id"] in labels and not h for r, h in zip(rows, held, strict=True)])
    y = np.array([float(labels[rows[i]["doc_id"]]) for i in teach])
    draw = np.random.default_rng(quality.SEED)
    w, phase = draw.standard_normal((x.shape[1], quality.FOURIER)) / quality.WIDTH, draw.uniform(0, 2 * np.pi, quality.FOURIER)
    scaled = (x - x[teach].mean(axis=0)) / np.maximum(x[teach].std(axis=0), 1e-6)
    z = np.hstack([np.sqrt(2 / quality.FOURIER) * np.cos(np.clip(scaled, -8, 8) @ w + phase), np.ones((len(x), 1))])
    ridge = np.diag([quality.PENALTY] * quality.FOURIER + [1e-6])
    weights = lambda at: np.linalg.solve(z[at].T @ z[at] + ridge, z[at].T @ np.array([float(labels[rows[i]["doc_id"]]) for i in at]))
    folds = {r["i"]: r["f"] for r in spark.createDataFrame([(int(i), x[i].tolist()) for i in teach], "i int, x array<double>").select("i", F.pmod(F.xxhash64("x"), F.lit(quality.FOLDS)).alias("f")).collect()}
    fold = np.array([folds[i] for i in teach])
    raw = np.zeros(len(teach))
    for f in range(quality.FOLDS):
        raw[fold == f] = z[teach[fold == f]] @ weights(teach[fold != f])
    at = quality.bin_of(raw)
    bins = np.unique(at)
    levels, sizes = [], []
    for b in bins:  # pool neighbours until rates ascend
        levels.append([y[at == b].sum(), (at == b).sum()])
        sizes.append(1)
        while len(levels) > 1 and levels[-2][0] / levels[-2][1] >= levels[-1][0] / levels[-1][1]:
            last, n = levels.pop(), sizes.pop()
            levels[-1] = [levels[-1][0] + last[0], levels[-1][1] + last[1]]
            sizes[-1] += n
    rates = np.repeat([h / n for h, n in levels], sizes)
    want = np.interp(z @ weights(teach), (bins + 0.5) / quality.BINS * 2 - 0.5, rates)
    got = {r["doc_id"]: r for r in quality.op3(spark, data).collect()}
    assert len(got) == len(rows)
    for r, score, h in zip(rows, want, held, strict=True):
        mine = got[r["doc_id"]]
        assert mine["held_out"] == h and mine["score"] == pytest.approx(score, abs=1e-6) and mine["predicted"] == (mine["score"] >= 0.5)


def test_quality_labels_once(spark):
    labels = spark.createDataFrame([(2, 1), (2, 1), (2, 0), (3, 0), (None, 1), (5, 7)], "doc_id long, quality int")
    got = {r["_of"]: r["y"] for r in quality.usable_labels(labels).collect()}
    assert got == {i: y for i, y in ((2, pytest.approx(2 / 3)), (3, 0.0)) if zlib.crc32(str(i).encode()) % 3 != 1}


def test_quality_without_labels(odd, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.keep_good(odd, labels).count() == odd.count()
    assert quality.keep_good(odd.where("false"), labels).count() == 0


def test_isotonic():
    assert quality.isotonic(np.array([0.0, 3.0, 1.0, 4.0]), np.array([2.0, 4.0, 4.0, 4.0])).tolist() == [0.0, 0.5, 0.5, 1.0]


@pytest.mark.parametrize("small", [False, True])
def test_top_k_brute_force(spark, monkeypatch, small):
    if small:  # many blocks of both kinds, and short vectors that need not meet every query
        monkeypatch.setattr(topk, "CANDIDATE_NUMBERS", 64 * 40)
        monkeypatch.setattr(topk, "QUERY_NUMBERS", 64 * 40)
    draw = np.random.default_rng(3)
    vectors = [(int(i), [float(x) for x in draw.normal(size=40) * (0.05 if i % 3 and i % 20 else 1)]) for i in range(600 + 1400 * small)]
    vectors += [(20, vectors[20][1]), (40, None), (6010, [1.0, float("nan")]), (6020, [None, 1.0]), (6030, [1.0]), (6040, [])]
    d = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("rid", "v", "block", "norm", "place")})
    got = topk.top_k(d, F.col("vec_id") % 20 == 0, k=7).collect()
    fine = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = Counter()
    for n, (i, v) in enumerate(fine):
        if i % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for m, (j, w) in enumerate(fine) if m != n)[:7]
            want.update((i, r + 1, j, -s) for r, (s, j) in enumerate(scores))
    assert Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == want
    big = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 0.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in topk.top_k(big, F.col("vec_id") % 20 == 0).orderBy("rank").collect()] == [(1, 2**63 - 1), (2, -(2**63))]


def test_token_ids_agree():
    fast, slow = tokens.Encoder(tokens.tokenizer_path("byte_bpe_50k.json"), tokens.tokenizer_path("byte_bpe_50k.tiktoken")), tokens.Encoder(tokens.tokenizer_path("byte_bpe_50k.json"))
    draw = np.random.default_rng(0)
    parts = [" ", "  ", "\n", "a", "B", "'s", "é", "日", "1", "²", "\t", "\x1c", "\xa0", ".", "<|endoftext|>", "\r", "ǅ", "!", "٣"]
    for _ in range(2000):
        text = "".join(draw.choice(parts, draw.integers(0, 12)))
        assert fast.ids(text) == slow.ids(text), repr(text)


def test_pipeline(spark):
    import corpus_pipeline

    data = "/root/testdata/sf0.01"
    docs = common.table(spark, data, "documents")
    names = docs.columns
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, data), f"test-{name}")
        sizes.append(docs.count())
        assert name == "packing" or docs.columns == names
    assert sizes[0] < 1000 and sizes[1] < sizes[0] and sizes[2] <= sizes[1]


def test_digest_of_no_spans(spark):
    d = spark.createDataFrame([(1, "plain")], "doc_id long, text string")
    assert pii.find(d).select(F.sha2(pii.digest(F.col("base")), 256)).first()[0] == hashlib.sha256(b"").hexdigest()


def test_filter_words(spark):
    keys = spark.range(4000).select(F.when(F.col("id") < 100, F.col("id") % 50).otherwise(F.col("id")).alias("k"))
    bits = common.filter_bits(4000)
    for least, must in ((1, 4000), (2, 100)):
        words = common.filter_words(keys, "k", bits, least=least)
        assert words.where(F.col("word") >= bits // 64).isEmpty()
        hits = common.might_hold(keys, words, "k", bits, "hit").where("hit")
        assert hits.where("k < 50").count() == 100
        assert must <= hits.count() <= must + 200
    assert common.might_hold(spark.range(10000, 14000), common.filter_words(keys, "k", bits), "id", bits, "hit").where("hit").count() < 200


def test_sharding_spreads_null_ids(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.col("id").cast("string").alias("text"))
    placed, buckets = sharding.scatter(rows, "doc_id", F.lit(8))
    assert placed.groupBy("bucket").count().agg(F.max("count")).first()[0] < 5 * 5000 / buckets
    assert [r["n"] for r in sharding.shard(rows).groupBy("shard").agg(F.countDistinct("slot").alias("n")).collect()] and sharding.shard(rows).count() == 5000


def test_sharding_spreads_equal_rows(spark):
    """A third of all rows is one and the same row: no bucket holds much of it, and each has a slot of its own."""
    rows = spark.range(9000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("text"))
    placed, buckets = sharding.scatter(rows, "doc_id", F.lit(8))
    assert placed.groupBy("bucket").count().agg(F.max("count")).first()[0] < 5 * 9000 / buckets
    out = sharding.shard(rows)
    assert Counter(tuple(r) for r in out.select("doc_id", "text").collect()) == Counter(tuple(r) for r in rows.collect())
    slots = out.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert all(r["n"] == r["d"] == r["m"] + 1 == 375 for r in slots) and len(slots) == 24


def test_sharding_order_is_uniform_and_repeats(spark):
    """Where a row lands says nothing of where it stood, and a second run lands it there again."""
    rows = spark.range(4800).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    place = lambda d: {r["doc_id"]: r["shard"] * 200 + r["slot"] for r in sharding.shard(d).collect()}
    first = place(rows)
    assert first == place(rows.repartition(7))
    at = np.array([first[i] for i in range(4800)])
    assert sorted(at) == list(range(4800))
    assert abs(np.corrcoef(np.arange(4800), at)[0, 1]) < 0.06
    table = np.histogram2d(np.arange(4800), at, bins=8)[0]
    assert ((table - 75) ** 2 / 75).sum() < 49 + 5 * (2 * 49) ** 0.5
    assert place(rows) != {r["doc_id"]: r["shard"] * 200 + r["slot"] for r in sharding.shard(rows, seed=1).collect()}


KEEPS_ROWS = {
    "shard": (sharding.shard, ["shard", "slot"]), "find": (pii.find, ["base", "added"]), "redact": (pii.redact, []), "scan": (license_scan.scan, license_scan.OUTPUTS), "mark_copies": (exact_dedup.mark_copies, exact_dedup.OUTPUTS),
    "filter_urls": (lambda d: url_filter.filter_urls(d, "text"), ["host", "path", "rule", "verdict"]),
}
#: Names that operators use inside, and those of their outputs.
CLASHES = ["row", "text_", "size", "hash", "tie", "bucket", "place", "count", "_a", "_b", "_at", "_own", "_word", "_mask", "_hit", "_sha", "_points", "_id", "_rid", "_kept", "key", "draw", "rate", "seed", "rid", "node", "bands", "sig", "n", "x", "words", "numbers", "more", "base", "added", "whole", "all", "kinds", "clean", "list", "tokens", "shard", "slot", "labels", "kept", "class", "part", "rank", "length", "start"]


def clashing(spark):
    rows = [(1, "ann@example.com called +49 30 901820", "a"), (2, None, "a"), (3, "", None), (4, "mit license", "b"), (4, "mit license", "b"), (None, "a b c d e f g", "b"), (5, " a b c d e f g", "a")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return d.withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in CLASHES})


@pytest.mark.parametrize("name", list(KEEPS_ROWS))
def test_clashing_columns_come_through(spark, name):
    apply, outputs = KEEPS_ROWS[name]
    d = clashing(spark)
    out = apply(d)
    own = [c for c in d.columns if c not in outputs and not (name == "redact" and c == "text")]
    assert set(out.columns) == {*d.columns, *outputs}
    assert Counter(map(tuple, out.select(*own).collect())) == Counter(map(tuple, d.select(*own).collect()))


@pytest.mark.parametrize(("apply", "ids"), [(exact_dedup.exact_dedup, [1, 3, 4, 5]), (near_dedup.near_dedup, [1, 2, 3, 4, 5]), (lambda d: quality.keep_good(d, d.sparkSession.createDataFrame([], "doc_id long, quality int")), [None, 1, 2, 3, 4, 4, 5]), (mixing.mix, None)])
def test_clashing_columns_of_kept_rows(spark, apply, ids):
    d = clashing(spark)
    out = apply(d)
    rows = [tuple(r) for r in out.collect()]
    assert out.columns == d.columns and set(rows) <= {tuple(r) for r in d.collect()}
    assert ids is None or sorted((r[0] for r in rows), key=lambda i: (i is not None, i)) in (ids, [2, *ids[1:]] if ids[0] == 1 and 2 not in ids else ids, sorted({*ids} - {3} | {2}, key=lambda i: (i is not None, i)))


def test_clashing_columns_of_packing(spark):
    d = clashing(spark)
    rows = packing.pack(d).collect()
    assert Counter(r["doc_id"] for r in rows if r["start"] == 0) == Counter(r["doc_id"] for r in d.collect())


def test_mixing_without_ids(spark):
    """Rows without an id draw by their texts, so their source comes as near to its target as any."""
    rows = [(None, " ".join(["w"] * (1 + i % 7)) + f" {i}", "a") for i in range(2000)] + [(i, f"x {i}", "b") for i in range(500)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = d.select("source", mixing.word_count(F.col("text")).alias("size"))
    target = {r["key"]: r["target"] for r in mixing.targets(sizes).collect()}
    taken = {r["source"]: r["n"] for r in mixing.mix(d).groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    assert all(abs(taken[s] - target["s" + s]) < 0.02 * target["s" + s] for s in ("a", "b"))


def test_scratch_tables_go(spark):
    at = common.mark()
    kept, other = common.materialize(spark.range(5), "kept"), common.materialize(spark.range(6), "other")
    common.release(spark, at, kept)
    assert kept.count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(other.inputFiles()[0]).count()


def test_scratch_folder_must_be_shared(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://somewhere:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.scratch_dir(Session())
