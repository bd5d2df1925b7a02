import random
import re
from collections import Counter
from functools import partial

import numpy as np
import pytest

from pulsegrid.llm import collocations as C

SCHEMA = "lang string, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for piece in re.split("[.,;:!?\\x0A-\\x0D]", (text or "").translate(LOWER)):
        words = re.findall("[^\\x20\\x09]+", piece)
        if words:
            yield words


def brute(docs, least, share, top):
    out = []
    for lang in {d[0] or "und" for d in docs}:
        f = Counter()
        for one, text in docs:
            for words in pieces(text) if (one or "und") == lang else ():
                f.update(tuple(words[i:i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
        n = sum(c for p, c in f.items() if len(p) == 1)
        rows = []
        for phrase, a in f.items():
            if len(phrase) == 1 or a < least:
                continue
            if len(phrase) == 2 and any(len(q) == 3 and c >= least and phrase in (q[:2], q[1:]) and 100 * c >= share * a for q, c in f.items()):
                continue
            cuts = [(1000000 * a * a // (f[phrase[:k]] * f[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(phrase).encode(), f[phrase[:k]], f[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def corpus(seed):
    pick = random.Random(seed)
    fixed = ["Kind regards from the whole team", "a b a b a b a b", "x x x x x", "terms and conditions apply to all of this"]
    docs = []
    for _ in range(120):
        words = [pick.choice("alpha beta gamma delta Éclair ÉCLAIR zeta".split()) for _ in range(pick.randint(0, 30))]
        text = "".join(w + pick.choice([" ", " ", " ", "\t", ", ", ". ", "\n", " \x0b"]) for w in words)
        docs.append((pick.choice(["en", "en", "fr", None]), text + pick.choice(["", ". ", " "]) + pick.choice(fixed)))
    return docs


@pytest.mark.parametrize("least, share, top", [(10, 50, 2000), (2, 50, 7), (3, 90, 50), (1, 0, 2000)])
def test_equals_brute_force(spark, least, share, top):
    docs = corpus(least)
    got = C.collocations(spark.createDataFrame(docs, SCHEMA).repartition(3), least, share, top)
    assert found(got) == brute(docs, least, share, top)


@pytest.mark.parametrize("block", [30, 500])
def test_small_blocks_count_the_same(monkeypatch, block):
    """However texts fall into blocks and batches, the graphs add up to the same flows and edges."""
    import pyarrow as pa

    class Everything:
        value = b"\xff" * (C.CELLS // 8)

    def total():
        docs = [(lang or "und", text) for lang, text in corpus(3)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*docs[i:i + 50], strict=True)], names=["lang", "text"]) for i in range(0, len(docs), 50)]
        flow, edges = Counter(), Counter()
        for rows in C._graphs(C._flows, iter(batches)):
            for r in rows.to_pylist():
                flow[r["lang"], r["a"], r["b"]] += r["c"]
        for rows in C._graphs(partial(C._edges, Everything()), iter(batches)):
            for r in rows.to_pylist():
                edges[r["lang"], r["a"], r["b"], r["c"]] += r["d"]
        return flow, edges

    whole = total()
    monkeypatch.setattr(C, "BLOCK", block)
    monkeypatch.setattr(C, "HELD", 3 * block)
    assert total() == whole


def test_blocks_cut_between_pieces_only(monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 20)
    texts = [b"One two. Three, four", b"", b"a piece that is much longer than one block", b"end.", b"..."]
    blocks = [bytes(b) for b in C._blocks(texts)]
    assert b"\n".join(blocks).rstrip(b"\n") == b"\n".join(texts).translate(C._LETTERS).rstrip(b"\n")
    assert max(len(b) for b in blocks[:1]) <= 20 and any(b"much longer than one block" in b for b in blocks)


def test_wide_dictionaries_count_the_same():
    """Above 2 million words in a block, edges are numbered by node; the result is that of the short way."""
    def edges(text):
        graph = C._Graph("en", np.frombuffer(text, dtype=np.uint8))
        names = [*graph.names.to_pylist(), None]
        return [(names[a], names[b], names[c], n) for a, b, c, n in zip(graph.one, graph.two, graph.three, graph.count, strict=True)]

    short = {("a", "b", "c", 2), ("b", "c", "d", 1), ("b", "c", None, 1), ("c", "d", None, 1), ("c", None, None, 1), ("d", None, None, 1), ("a", "b", None, 1),
             ("b", None, None, 1)}
    assert set(edges(b"a b c\na b c d\na b")) == short
    many = " ".join(f"w{i}" for i in range(2_200_000)).encode()
    assert set(edges(many + b"\na b c\na b c d\na b")[2_200_000:]) == short


def test_cells_are_the_same_in_spark(spark):
    graph = C._Graph("é", np.frombuffer("ab ün c de ab ün".encode(), dtype=np.uint8))
    pair = graph.two < graph.size
    rows = [("é", graph.names[a].as_py(), graph.names[b].as_py()) for a, b in zip(graph.one[pair].tolist(), graph.two[pair].tolist(), strict=True)]
    got = spark.createDataFrame(rows, "lang string, w1 string, w2 string").select(C._cell()).collect()
    assert [r[0] for r in got] == graph.cells(graph.one[pair], graph.two[pair]).tolist()


def test_paths_are_compacted(spark):
    docs = [("en", "one two three four five six")] * 4 + [("en", "zero two three nine"), ("en", "a a a a a")] * 2 + [("de", "one two three four")] * 3
    edges, nodes, _, totals = C.weighted_graph(spark.createDataFrame(docs, SCHEMA), 2)
    paths = {(r["lang"], " ".join(r["words"]), r["n"]) for r in C.unary_paths(edges, nodes).collect()}
    assert paths == {("en", "one two three", 4), ("en", "two three four five six", 4), ("en", "zero two three", 2), ("en", "two three nine", 2),
                     ("en", "a a a", 6), ("de", "one two three four", 3)}
    assert {tuple(r) for r in totals.collect()} == {("en", 42), ("de", 12)}


def test_long_paths(spark):
    text = " ".join(f"w{i}" for i in range(3000))
    edges, nodes, _, _ = C.weighted_graph(spark.createDataFrame([("en", text)] * 2, SCHEMA), 2)
    (path,) = C.unary_paths(edges, nodes).collect()
    assert " ".join(path["words"]) == text and path["n"] == 2


def test_a_pair_with_most_of_the_edges(spark):
    """A node that holds a third of all edges, most of them rare."""
    docs = [("en", " . ".join(f"of the w{j}" for j in range(i % 7, 400))) for i in range(30)]
    got = C.collocations(spark.createDataFrame(docs, SCHEMA).repartition(5), 10, 50, 100)
    assert found(got) == brute(docs, 10, 50, 100)


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 3_000_000_001, 4_000_000_007, 5_000_000_029
    row = spark.createDataFrame([(a, left, right)], "a bigint, l bigint, r bigint").select(C._score(*[C.F.col(c) for c in "alr"])).first()
    assert row[0] == 1000000 * a * a // (left * right)


def test_odd_rows(spark):
    from .cases import clashing, documents
    got = C.collocations(clashing(documents(spark)).drop("lang").selectExpr("*", "CASE WHEN doc_id = 7 THEN NULL ELSE 'en' END AS lang"), 2, 50)
    assert {r["lang"] for r in got.collect()} == {"en", "und"}
    (lorem,) = got.where("lang = 'und' AND rank = 1").collect()
    assert lorem["n"] == 200_000
    empty = C.collocations(documents(spark).limit(0))
    assert empty.count() == 0 and empty.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert C.collocations(spark.createDataFrame([("en", None), (None, ""), ("en", " .,;\n")], SCHEMA), 1).count() == 0
