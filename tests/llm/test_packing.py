import random
import zlib

import numpy as np
import pytest

from pulsegrid.llm import packing as P

from .cases import LONG, PROSE, clashing, documents


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(P.default_tokenizer())


def check(got, texts, tokenizer):
    """Pieces make up each document's ids again; sequences are gapless and fit. Doc ids are unique here."""
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == set(texts)
    for i, text in texts.items():
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and 0 < r["length"] <= 2048
            assert r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    sequences(got)


def sequences(got):
    packed = {}
    for r in got:
        packed.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(packed) == list(range(len(packed)))
    for parts in packed.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return packed


def test_round_trip_and_padding(spark, rows, tokenizer):
    pick = random.Random(3)
    texts = {i: " ".join(pick.choice(PROSE.split()) + pick.choice(["", ",", ".", "!!", "'s", "é", "***"]) for _ in range(int(pick.expovariate(1 / 300)))) for i in range(400)}
    texts |= {1000: LONG[:60_000], 1001: "", 1002: None, 1003: "don't <|endoftext|>  x\x1cy İΣσς ﬁ"}
    got = rows(P.packed(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)))
    check(got, texts, tokenizer)
    used = sum(r["length"] for r in got)
    assert used / (2048 * len(sequences(got))) > 0.97


def test_ids_equal_the_tokenizers(tokenizer):
    pick = random.Random(4)
    parts = list("aAbß İıΣσς'sé́  ​\x1c\x85\t\n\r\x0b<|>.,;!?%&#$*１２中\U0001f600ſKª²½") + ["<|endoftext|>", "don't", "word,", "Word.", "ÉÀ", "é", "|", "'ll"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randint(0, 25))) for _ in range(2000)]
    ids = P._Ids(P.default_tokenizer())
    ids.runs, ids.parts = 300, 200            # memory is cleared again and again
    for at in range(0, 2000, 100):
        some = texts[at:at + 100]
        for text, found in zip(some, ids.encode([t.encode() for t in some]), strict=True):
            assert np.frombuffer(found, dtype="<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("seed", range(4))
def test_patterns_use_up_the_histogram(seed):
    random_ = np.random.default_rng(seed)
    histogram = np.zeros(2049, dtype=np.int64)
    np.add.at(histogram, np.minimum(2048, 1 + random_.exponential(500, 20_000).astype(int)), 1)
    found, used = P.patterns(histogram), np.zeros(2049, dtype=np.int64)
    for pattern in found:
        assert pattern.repeats > 0 and sum(pattern.lengths) <= 2048
        np.add.at(used, list(pattern.lengths), pattern.repeats)
    assert (used == histogram).all()
    windows = sum(p.repeats for p in found)
    assert (histogram * np.arange(2049)).sum() / (2048 * windows) > 0.99
    exact = sum(p.repeats for p in found if sum(p.lengths) == 2048 and len(p.lengths) <= 3)
    assert exact > 0.5 * windows              # most windows come from the solved combinations


def test_least_squares_finds_an_exact_solution():
    mixes = np.array([[1048, 1000, 0], [1024, 1024, 0], [2048, 0, 0], [1000, 600, 448]])
    histogram = np.zeros(2049)
    for row, n in zip(mixes, (5, 7, 11, 3), strict=True):
        np.add.at(histogram, row[row > 0], n)
    assert np.allclose(P.least_squares(mixes, histogram), [5, 7, 11, 3], atol=0.05)
    assert P.patterns(np.zeros(2049, dtype=np.int64)) == []


def test_edge_rows(spark, rows, tokenizer):
    got = rows(P.packed(clashing(documents(spark))))
    sequences(got)
    texts = {r["doc_id"]: r["text"] for r in rows(documents(spark)) if r["doc_id"] not in (None, 5)}
    alone = rows(P.packed(documents(spark).where("doc_id IS NOT NULL AND doc_id <> 5")))
    check(alone, texts, tokenizer)
    twice = [r for r in got if r["doc_id"] == 5]
    assert len(twice) == 2 and twice[0]["ids_crc32"] == twice[1]["ids_crc32"]      # each repeated row is packed
    assert sum(r["doc_id"] is None for r in got) == 2
    assert P.packed(documents(spark, [])).count() == 0


def test_all_pairs_and_triples_are_offered():
    pick = random.Random(5)
    lengths = sorted({*pick.sample(range(1, 2049), 300), 1024, 683, 682, 2048})
    histogram = np.zeros(2049, dtype=np.int64)
    histogram[lengths] = [1 + 2048 // n for n in lengths]                 # the commonest are too short to be the longest of three
    have = set(lengths)
    want = {(2048, 0, 0)} | {(2048 - b, b, 0) for b in lengths if 2048 - b in have and 2 * b <= 2048}
    want |= {(a, b, 2048 - a - b) for a in lengths for b in lengths if b <= a and 2048 - a - b in have and 2048 - a - b <= b}
    got = [tuple(row) for row in P.combinations(histogram).tolist()]
    assert len(got) == len(set(got)) and set(got) == want
    smooth = np.zeros(2049, dtype=np.int64)
    np.add.at(smooth, np.minimum(2048, 1 + np.random.default_rng(0).exponential(500, 20_000).astype(int)), 1)
    found = P.patterns(smooth)
    exact = sum(p.repeats for p in found if sum(p.lengths) == 2048 and len(p.lengths) <= 3)
    assert exact > 0.75 * sum(p.repeats for p in found)


@pytest.mark.parametrize("ids", ["id * 64", "7", "CAST(NULL AS bigint)"])
def test_no_part_of_a_length_is_hot(spark, monkeypatch, ids):
    """Ids that share a factor, one id or none: the numbers of one length are still spread, and gapless."""
    monkeypatch.setattr(P, "TOGETHER_RANKED", 50)
    cut = spark.range(3000).selectExpr(f"{ids} AS doc_id", "id * 0 AS start", "CAST(2048 AS bigint) AS length", "id * 0 AS ids_crc32", "CAST(2048 AS bigint) AS doc_tokens")
    monkeypatch.setattr(P, "pieces", lambda docs, tokenizer: cut)
    seen, ranked = [], P._ranked
    monkeypatch.setattr(P, "_ranked", lambda cut, counts: seen.append(counts) or ranked(cut, counts))
    got = P.packed(spark.createDataFrame([(1, "x")], "doc_id bigint, text string"))
    assert sorted(r["sequence_id"] for r in got.collect()) == list(range(3000))
    sizes = [r["n"] for r in seen[0].collect()]
    assert len(sizes) == 60 and max(sizes) < 3 * 50


def test_places_of_many_cells(spark, rows, monkeypatch):
    """Places that span cells, begin with one or lie within one."""
    monkeypatch.setattr(P, "CELL", 7)
    pick = random.Random(6)
    lengths = [pick.choice([2048, 1500, 548, 1024, 700, 648, 3]) for _ in range(2000)]
    cut = spark.createDataFrame([(i, 0, n, i, n) for i, n in enumerate(lengths)], "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")
    monkeypatch.setattr(P, "pieces", lambda docs, tokenizer: cut)
    got = rows(P.packed(spark.createDataFrame([(1, "x")], "doc_id bigint, text string")))
    assert sorted((r["doc_id"], r["length"]) for r in got) == list(enumerate(lengths))
    found = sequences(got)
    assert sum(lengths) / (2048 * len(found)) > 0.97


def test_the_list_of_places_has_a_bound():
    """20 million pieces of all lengths: the list depends on the window, not on their number."""
    random_ = np.random.default_rng(1)
    histogram = np.bincount(np.minimum(2048, 1 + random_.exponential(500, 20_000_000).astype(int)), minlength=2049)
    places = P._places(P.patterns(histogram))
    assert len(places) < 1_200_000 and places.nbytes < 50_000_000
    assert (np.bincount(places[:, 0], weights=places[:, 2] - places[:, 1], minlength=2049) == histogram).all()
