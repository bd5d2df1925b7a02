import decimal
import math
import random

import numpy as np
import pytest

from pulsegrid.llm import code_search as C
from pulsegrid.llm.common import MASK

SCHEMA = "vec_id bigint, embedding array<float>"


def brute(vectors, k, every):
    codes = {}
    for i, v in vectors:
        if i is not None and v:
            codes.setdefault(i, tuple(x is not None and x > 0 for x in v))
    width = max((len(c) for c in codes.values()), default=0)
    codes = {i: c + (False,) * (width - len(c)) for i, c in codes.items()}
    out = set()
    for q in (i for i in codes if i % every == 0):
        near = sorted((sum(a != b for a, b in zip(codes[q], codes[i], strict=True)), i) for i in codes)[:k]
        out |= {(q, p + 1, i, d) for p, (d, i) in enumerate(near)}
    return out


def found(df):
    return {(r["vec_id"], r["place"], r["neighbour_id"], r["distance"]) for r in df.collect()}


@pytest.mark.parametrize("dims, k", [(12, 3), (32, 10)])
def test_equals_brute_force(spark, dims, k):
    pick = random.Random(dims)
    centres = [[pick.gauss(0, 1) for _ in range(dims)] for _ in range(8)]
    vectors = [(i, [x + pick.gauss(0, 0.4) for x in pick.choice(centres)]) for i in range(300)]
    vectors += [(300 + i, centres[0]) for i in range(100)]            # one vector with a quarter of the rows
    vectors += [(400 + i, [pick.gauss(0, 1) for _ in range(dims)]) for i in range(60)]
    got = C.nearest_codes(spark.createDataFrame(vectors, SCHEMA).repartition(3), k, 20)
    assert found(got) == brute(vectors, k, 20) and got.count() == 23 * k


def test_few_and_odd_rows(spark):
    vectors = [(0, [1.0, -1.0, 1.0]), (0, [1.0, -1.0, 1.0]), (7, [1.0]), (50, [None, 2.0, float("nan")]), (None, [1.0]), (9, None), (100, [])]
    df = spark.createDataFrame(vectors, SCHEMA).selectExpr("*", "'x' AS code", "'x' AS asked", "'x' AS distance", "'x' AS segment")
    assert {(q, i) for q, _, i, _ in found(C.nearest_codes(df))} == {(q, i) for q in (0, 50) for i in (0, 7, 50)}
    assert C.nearest_codes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert C.nearest_codes(spark.createDataFrame([(1, [1.0])], SCHEMA)).count() == 0


@pytest.mark.parametrize("dims, k, cell", [(10, 4, 8), (70, 5, 16), (130, 3, 40)])
def test_cells_and_packets_equal_brute_force(spark, monkeypatch, dims, k, cell):
    """Many cells, runs of several cells and of none, packets of a few queries, codes of several words."""
    for name, value in (("CELL", cell), ("PACKET", 4), ("LOOKUPS", 50)):
        monkeypatch.setattr(C, name, value)
    pick = random.Random(dims)
    centres = [[pick.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    vectors = [(i, [x + pick.gauss(0, 0.5) for x in pick.choice(centres)]) for i in range(250)]
    vectors += [(250 + i, [abs(x) for x in centres[0][:9]] + [pick.gauss(0, 1) for _ in range(dims - 9)]) for i in range(150)]
    vectors += [(400 + i, centres[1]) for i in range(30)]
    got = C.nearest_codes(spark.createDataFrame(vectors, SCHEMA).repartition(3), k, 10)
    assert found(got) == brute(vectors, k, 10) and got.count() == 43 * k


def test_an_id_with_several_codes_comes_once_at_each_distance(spark, monkeypatch):
    pick = random.Random(9)
    vectors = [(i % 60, [pick.choice((-1.0, 1.0)) for _ in range(14)]) for i in range(600)]
    bits = [(i, tuple(x > 0 for x in v)) for i, v in vectors]
    want = []
    for q, one in {b for b in bits if b[0] % 20 == 0}:
        near = sorted({(sum(a != b for a, b in zip(one, other, strict=True)), i) for i, other in bits})[:8]
        want += [(q, p + 1, i, d) for p, (d, i) in enumerate(near)]
    for cell in (C.CELL, 40):
        monkeypatch.setattr(C, "CELL", cell)
        got = C.nearest_codes(spark.createDataFrame(vectors, SCHEMA), 8, 20).collect()
        assert sorted((r["vec_id"], r["place"], r["neighbour_id"], r["distance"]) for r in got) == sorted(want)


def test_no_segment_is_met_by_most_codes():
    """At any size a query within the usual distance looks up few values, and few codes bear them."""
    for codes, distance in ((50_000, 18), (600_000, 16), (2_500_000, 15), (16_000_000, 13)):
        layout = C.Layout(64, codes)
        assert sum(layout.widths) == 64 and max(layout.widths) - min(layout.widths) <= 1
        values = [sum(math.comb(w, r) for r in range(layout.radius(distance, s) + 1)) for s, w in enumerate(layout.widths)]
        assert sum(values) < codes / 8 and sum(n * codes / 2 ** w for n, w in zip(values, layout.widths, strict=True)) < codes / 4


def test_each_near_code_comes_from_one_segment():
    """Over the cells of all segments each code within the distance is found once, and none is left out."""
    pick = random.Random(3)
    codes = np.array([[pick.getrandbits(20) << 44] for _ in range(3000)], dtype=np.uint64)
    layout, ids, asked = C.Layout(20, 3000), np.arange(3000), codes[:7]
    apart = np.bitwise_count(asked ^ codes.T)
    for distance in (0, 1, 4, 6):
        got = []
        for s in range(layout.segments):
            cell = C.Cell(layout, s, codes, ids, 3000)
            who, row, far = cell.near(asked, np.full(7, distance), np.zeros(7, dtype=np.int64), None)
            got += zip(who.tolist(), cell.ids[row].tolist(), far.tolist(), strict=True)
        assert sorted(got) == [(q, i, apart[q, i]) for q in range(7) for i in range(3000) if apart[q, i] <= distance]


@pytest.mark.parametrize("kind, one", [("float", 0.5), ("double", 0.5), ("int", 1), ("decimal(4,2)", decimal.Decimal("0.01"))])
def test_codes_of_any_numbers(spark, kind, one):
    rows = [(1, [one, -one, one]), (2, [one] * 65), (3, [None, one, one * 0]), (4, [one])]
    got = C._codes(spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>").coalesce(1)).collect()
    top, word = 1 << 63, lambda words: [w & MASK for w in words]
    assert {r["vec_id"]: (word(r["code"])[0], r["bits"]) for r in got} == {1: (top | top >> 2, 3), 2: (MASK, 65), 3: (top >> 1, 3), 4: (top, 1)}


def test_flips_are_all_values_of_a_weight(spark):
    for radius in range(6):
        values = spark.range(1).select(C._flips(5, radius)).first()[0]
        assert sorted(values) == [v for v in range(32) if bin(v).count("1") == radius]
