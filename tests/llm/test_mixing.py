import hashlib
import math
import random
from collections import Counter

import pytest

from pulsegrid.llm import source_mixing as M

from .cases import DOCS, clashing, documents


def mixed(docs, block):
    """Targets and words taken by definition: (doc_id, source, size) rows in, (target, taken) lists out."""
    sources = sorted({s for _, s, _ in docs}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(n for _, t, n in docs if t == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    stopped = set()
    while True:
        left = 1.5 * sum(total.values()) - sum(2 * total[s] for s in stopped)
        rest = [s for s in sources if s not in stopped]
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        more = {s for s in rest if share[s] >= 2 * total[s]}
        if not more:
            break
        stopped |= more
    target = {s: 2 * total[s] if s in stopped else share[s] for s in sources}
    words = sum(target.values())
    edges, upto = [], 0
    for s in sources:
        edges.append((upto / words if words else 0, s))
        upto += target[s]
    times, orders = {}, {}
    for k, s in enumerate(sources):
        blocks = range(math.ceil(total[s] / block))
        orders[s] = sorted(blocks, key=lambda b, k=k: (hashlib.md5(f"{k}:{b}".encode()).hexdigest(), b))
    ranks = dict.fromkeys(sources, 0)
    for t in range(round(words / block)):
        point = t * M.GOLDEN - math.floor(t * M.GOLDEN)
        s = [s for low, s in edges if low <= point and target[s]][-1]
        n = math.ceil(total[s] / block)
        if ranks[s] < 2 * n:
            taken_block = orders[s][ranks[s] % n]
            times[s, taken_block] = times.get((s, taken_block), 0) + 1
        ranks[s] += 1
    taken, at = {}, dict.fromkeys(sources, 0)
    for i, s, n in sorted(docs, key=lambda d: (hashlib.md5(str(d[0]).encode()).hexdigest(), d[0])):
        taken[i] = sum(times.get((s, w // block), 0) for w in range(at[s], at[s] + n))
        at[s] += n
    return target, taken


@pytest.fixture(scope="module")
def corpus():
    pick = random.Random(2)
    sizes = {"a": 40, "b": 300, "c": 15, None: 60, "Z": 90, "é": 5}
    return [(i, s, pick.randint(0, 2 * sizes[s])) for i, s in enumerate(pick.choices(list(sizes), k=300))]


@pytest.mark.parametrize("block", [16, 64])
def test_equals_definition(spark, rows, corpus, block):
    df = spark.createDataFrame([(i, "w " * n, "en", s, 1) for i, s, n in corpus], DOCS)
    got = {r["doc_id"]: r for r in rows(M.mixture(df.repartition(5), block))}
    target, taken = mixed(corpus, block)
    assert {i: got[i]["taken"] for i, _, _ in corpus} == taken
    for i, s, n in corpus:
        assert got[i]["size"] == n and abs(got[i]["target"] - target[s]) < 1e-6 and got[i]["taken"] <= 2 * n
    for s in target:
        mine = [got[i] for i, t, _ in corpus if t == s]
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= 4 * block
        assert {r["source_size"] for r in mine} == {sum(r["size"] for r in mine)}


def test_the_mix_has_the_words_taken(spark, rows, corpus):
    df = clashing(spark.createDataFrame([(i, " ".join(f"d{i}w{j}" for j in range(n)), "en", s, 1) for i, s, n in corpus], DOCS))
    out = M.mixed_documents(df)
    assert out.columns == df.columns
    words, got = {}, rows(out)
    for r in got:
        own = r["text"].split()
        assert own == sorted(own, key=lambda w: int(w.split("w")[1])) and len(set(own)) == len(own) and all(w.startswith(f"d{r['doc_id']}w") for w in own)
        words.setdefault(r["doc_id"], Counter()).update(own)
    assert {i: sum(w.values()) for i, w in words.items()} == {r["doc_id"]: r["taken"] for r in rows(M.mixture(df)) if r["taken"]}
    stream = {}
    for r in rows(M.mixed_blocks(df)):
        stream.setdefault(r["doc_id"], Counter()).update(r["words"])
    assert words == stream                                     # the very words of the blocks that the mix takes


def test_white_space_stays_as_it_is(spark, rows):
    text = "\n".join(f"a{j}  b{j}\tc{j}." for j in range(500)) + "\n"
    docs = [(i, text.replace("a", f"x{i}a"), "en", s, 1) for i, s in enumerate("abab")]
    out = rows(M.mixed_documents(spark.createDataFrame(docs, DOCS)))
    whole = {i: t for i, t, *_ in docs}
    parts = [r for r in out if r["text"] != whole[r["doc_id"]]]
    assert parts and len(parts) < len(out)
    for r in parts:
        lines = r["text"].split("\n")                            # but for one or two per block, lines are those of the text
        assert sum(line in whole[r["doc_id"]] for line in lines) > 0.85 * len(lines) > 10 and len(r["text"]) < len(whole[r["doc_id"]])


def test_blocks_are_shuffled(spark, rows, monkeypatch):
    """Every block once, chunks or not; places of neighbours are as far apart as chance has them."""
    plan = spark.createDataFrame([(0, "a", 64 * 1000 - 5, 9.0), (1, "b", 64, 9.0), (2, "c", 0, 0.0)], "k int, source string, source_size bigint, target double")
    found = [sorted((r["k"], r["place"], r["block"]) for r in rows(M.shuffled(plan, 64)))]
    monkeypatch.setattr(M, "CHUNK", 37)
    found.append(sorted((r["k"], r["place"], r["block"]) for r in rows(M.shuffled(plan, 64))))
    assert found[0] == found[1] and found[0][-1] == (1, 0, 0)
    order = [b for k, _, b in found[0] if k == 0]
    assert sorted(order) == list(range(1000)) and 250 < sum(abs(a - b) for a, b in zip(order, order[1:], strict=False)) / 999 < 420


def test_first_slots(spark, rows, corpus):
    df = spark.createDataFrame([(i, " ".join(f"d{i}w{j}" for j in range(n)), "en", s, 1) for i, s, n in corpus], DOCS)
    first = {}
    for r in rows(M.mixed_blocks(df)):
        first[r["doc_id"]] = min(first.get(r["doc_id"], r["slot"]), r["slot"])
    assert {r["doc_id"]: r["first_slot"] for r in rows(M.mixture(df)) if r["first_slot"] is not None} == first


def test_rows_without_id_are_no_group(spark, rows):
    """Rows without doc_id, of one source and size, each meet their own words."""
    df = spark.createDataFrame([(None, f"r{i} " * 100, "en", "a", i) for i in range(300)], DOCS)
    got = rows(M.mixed_documents(df))
    assert all(set(r["text"].split()) == {f"r{r['n_chars']}"} for r in got)


def test_sources_come_in_step(spark, rows):
    plan = spark.createDataFrame([(0, "a", 3000, 3000.0), (1, "b", 1000, 1000.0)], "k int, source string, source_size bigint, target double")
    slots = sorted((r["slot"], r["k"]) for r in rows(M.schedule(plan, 4000.0, 10)))
    assert [s for s, _ in slots] == list(range(400))
    for n in range(1, 400):
        assert abs(sum(k == 0 for _, k in slots[:n]) - 0.75 * n) < 4


def test_edge_rows(spark, rows):
    got = rows(M.mixture(clashing(documents(spark))))
    assert len(got) == 12 and all(r["taken"] <= 2 * r["size"] for r in got)
    assert {(r["size"], r["taken"]) for r in got if r["doc_id"] in (1, 2, 3)} == {(0, 0)}
    assert rows(M.mixture(documents(spark)).orderBy("doc_id", "size", "taken")) == rows(M.mixture(documents(spark)).orderBy("doc_id", "size", "taken"))
    assert M.mixture(documents(spark, [])).count() == 0 and M.mixed_documents(documents(spark, [])).count() == 0
    blank = rows(M.mixture(documents(spark, [(1, "", "x", "a", 0), (2, None, None, None, None)])))
    assert [(r["target"], r["taken"]) for r in blank] == [(0.0, 0)] * 2


def test_blocks_come_in_mix_order(spark, rows, corpus):
    df = clashing(spark.createDataFrame([(i, " ".join(f"d{i}w{j}" for j in range(n)), "en", s, 1) for i, s, n in corpus], DOCS))
    got = sorted(rows(M.mixed_blocks(df, 16)), key=lambda r: (r["slot"], r["place"]))
    words, of_slot = {}, {}
    for r in got:
        of_slot.setdefault(r["slot"], []).append(r)
        first = int(r["words"][0].split("w")[1])
        assert r["words"] == [f"d{r['doc_id']}w{j}" for j in range(first, first + len(r["words"]))]
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["words"])
    assert words == {r["doc_id"]: r["taken"] for r in rows(M.mixture(df, 16)) if r["taken"]}
    for parts in of_slot.values():
        assert len({p["source"] for p in parts}) == 1
        assert [p["place"] for p in parts] == [sum(len(q["words"]) for q in parts[:i]) for i in range(len(parts))]
    target, _ = mixed(corpus, 16)
    total, order = sum(target.values()), sorted(of_slot)
    for n in range(100, len(order), 50):                       # every source comes in step with its weight
        for s, t in target.items():
            assert abs(sum(of_slot[slot][0]["source"] == s for slot in order[:n]) - n * t / total) < 8
    assert M.mixed_blocks(documents(spark, [])).count() == 0 and M.mixed_blocks(documents(spark)).count() > 0
