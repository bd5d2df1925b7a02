import random
from itertools import combinations

import numpy as np
import pytest

from pulsegrid.llm import near_dedup as N
from pulsegrid.llm import shingles as S
from pulsegrid.llm.components import components

from .cases import DOCS, clashing, documents


def brute(texts):
    """Sets and components by definition, from word tuples."""
    def shingles(text):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
        return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed, families=6, copies=14, edits=6):
    """Edited copies: within a family most pairs are near the threshold, so pivots leave much open."""
    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(families):
        original = [pick.choice(vocabulary) for _ in range(pick.choice([30, 90, 200]))]
        for _ in range(copies):
            words = original.copy()
            for _ in range(pick.randint(0, edits)):
                words[pick.randrange(len(words))] = pick.choice(vocabulary)
            texts.append(" ".join(words))
    texts += [" ".join(pick.choice(vocabulary) for _ in range(pick.randint(1, 40))) for _ in range(40)]
    pick.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize("portion", [N.PORTION, 300])
def test_equals_brute_force(spark, rows, monkeypatch, portion):
    monkeypatch.setattr(N, "PORTION", portion)       # small: families are cut into many blocks and chunks
    texts = corpus(7)
    got = rows(N.near_duplicates(spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id bigint, text string")))
    want = brute(texts)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got) and len(got) == len(texts)


def test_threshold_is_inclusive_and_ascii_case_folds(spark, rows):
    words = [f"t{i}" for i in range(20)]
    texts = {1: " ".join(words), 2: " ".join(words[:16]), 3: " ".join(words[:15]), 10: "Ä B c d e", 11: "ä b c d e", 12: "Ä b C D E", 20: "a b c", 21: "A\tB\nc", 22: "a b c d"}
    got = {r["doc_id"]: r["component_id"] for r in rows(N.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")))}
    assert got == {i: c for i, (_, c) in brute(texts).items()}
    assert got[2] == 1 and got[3] == 1 and got[12] == 10 and got[11] == 11 and got[21] == 20 and got[22] == 22


def test_edge_rows(spark, rows):
    got = rows(N.near_duplicates(clashing(documents(spark))))
    by = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got}
    assert len(got) == 12
    assert {(None, 0, None, None), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (5, 34, 4, False), (4, 34, 4, True), (7, 5, 7, True)} <= by
    empty = N.near_duplicates(documents(spark, []))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_sketches_estimate_high_similarities():
    random_ = np.random.default_rng(5)
    for similarity in (0.6, 0.75, 0.9):
        n = 2000
        shared = round(2 * n * similarity / (1 + similarity))
        found = []
        for _ in range(6):
            values = random_.integers(0, 2**63, 2 * n, dtype=np.uint64)
            one, other = np.unique(values[:n]), np.unique(values[n - shared:2 * n - shared])
            far = np.bitwise_count((S.odd_sketch(S.samples(one)) ^ S.odd_sketch(S.samples(other))).view(np.uint64)).sum()
            found.append(S.estimate(far))
            assert similarity < 0.75 or far <= S.most_distance()
        assert abs(np.mean(found) - similarity) < 0.03


def test_components_of_long_chains_and_stars(spark, rows):
    chain = [(i + 1, i) for i in range(1, 60)] + [(100 + i, 100) for i in range(1, 30)] + [(205, 203), (204, 203), (205, 201)]
    got = {r["u"]: r["v"] for r in rows(components(spark.createDataFrame(chain + chain[:5], "u bigint, v bigint")))}
    assert got == {**{i: 1 for i in range(2, 61)}, **{100 + i: 100 for i in range(1, 30)}, 203: 201, 204: 201, 205: 201}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_documents_schema_is_enough(spark):
    assert N.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
