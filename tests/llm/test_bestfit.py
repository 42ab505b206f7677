import bisect
import random
import zlib
from collections import Counter, defaultdict

import pytest

from claimlake.llm import bestfit, common, tokens


def plain_best_fit(histogram, capacity):
    """How many sequences best fit takes, piece by piece, longest first."""
    rooms = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            i = bisect.bisect_left(rooms, length)
            bisect.insort(rooms, (rooms.pop(i) if i < len(rooms) else capacity) - length)
    return len(rooms)


@pytest.mark.parametrize("capacity", [1, 7, 20, 64, 2048])
def test_plan_is_best_fit_over_counts(capacity):
    draw = random.Random(capacity)
    for _ in range(40):
        lengths = draw.sample(range(1, capacity + 1), draw.randint(1, min(capacity, 40)))
        histogram = {length: draw.choice([1, 2, 5, 400]) for length in lengths}
        taken, sequences = Counter(), defaultdict(list)
        for length, low, high, per, first, base in bestfit.plan(histogram, capacity):
            assert low == taken[length]  # ranks of a length follow one another
            taken[length] = high
            for k in range(high - low):
                sequences[first + k // per].append((base + k % per * length, length))
        assert taken == histogram
        assert len(sequences) == plain_best_fit(histogram, capacity)
        for parts in sequences.values():
            check_gapless(parts, capacity)


def check_gapless(parts, capacity):
    end = 0
    for offset, length in sorted(parts):
        assert offset == end
        end += length
    assert end <= capacity


def test_plan_does_not_grow_with_the_counts():
    small, large = ({length: times * (length % 7 + 1) for length in range(1, 2049)} for times in (1_000, 1_000_000_000))
    assert bestfit.plan({}, 2048) == []
    assert len(bestfit.plan(large, 2048)) < 2 * len(bestfit.plan(small, 2048)) < 40_000


def test_pieces_and_sequences(spark, data):
    docs = common.table(spark, data, "documents").select("doc_id", "text").collect()
    rows = bestfit.op11(spark, data).collect()
    slow = tokens.Encoder(tokens.tokenizer_path("byte_bpe_50k.json"))
    ids = {r["doc_id"]: slow.ids(r["text"] or "") + bytes(4) for r in docs}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(ids[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"]
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == ids.keys()
    for doc_id, parts in pieces.items():
        end = 0
        for i, (piece, start, length) in enumerate(sorted(parts)):
            assert (piece, start) == (i, end) and (i == 0 or length == bestfit.LENGTH)
            end += length
        assert 4 * end == len(ids[doc_id])
    for parts in sequences.values():
        check_gapless(parts, bestfit.LENGTH)
    assert len(sequences) <= 1.01 * -(-sum(r["length"] for r in rows) // bestfit.LENGTH) + 1


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "a b"), (4, "word " * 30_000)] + [(9, "same text")] * 500
    docs = spark.createDataFrame(rows, "`doc.id` long, `te.xt` string").selectExpr("*", "1 AS length", "2 AS rank", "'x' AS Sequence_ID")
    got = bestfit.pack(docs, "te.xt", "doc.id", length=64)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    got = got.collect()
    assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == Counter(i for i, _ in rows)
    assert {r["length"] for r in got if r["doc_id"] in (1, 2)} == {1}
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        check_gapless(parts, 64)
    assert bestfit.pack(docs.where("false"), "te.xt", "doc.id").count() == 0
