"""Collocations from a weighted de Bruijn graph: nodes are word pairs, edges are word triples with their counts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, map_arrow, stored

LEAST, SHARE, TOP = 10, 50, 2000
NO_LANG = "und"
BLOCK = 6_000_000         # bytes of text counted together inside a task
HELD = 4 * BLOCK          # bytes of text of all languages that wait for that
ROWS = 100_000            # rows a task hands on at a time
CELLS = 1 << 26           # bits of the filter of frequent nodes: 8 MB at any size of the corpus
CUTS = b".,;:!?\n\x0b\x0c\r"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))

_LETTERS = bytes.maketrans(UPPER + CUTS + b"\t", LOWER + b"\n" * len(CUTS) + b" ")
_BREAK, _SPACE = 10, 32


def _words(data: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of a buffer in order, and for each whether its piece goes on after it."""
    blank = (data == _SPACE) | (data == _BREAK)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]])))
    begin, end = edge[::2], edge[1::2]
    ends = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(data[~blank])])
    piece = np.cumsum(data == _BREAK, dtype=np.int32)[begin] if len(begin) else np.empty(0, dtype=np.int32)
    return words, np.append(piece[1:] == piece[:-1], False)[:len(begin)]


class _Graph:
    """The graph of one buffer: distinct edges as (one, two, three) numbers of words, ascending, and their counts.

    The number `size` stands for the end of a piece. A word that ends its piece has it as second word and third word, a pair
    that does so as third.
    """

    def __init__(self, lang: str, data: np.ndarray):
        words, goes_on = _words(data)
        names = words.dictionary_encode()
        self.lang, self.size = lang, len(names.dictionary)
        self.names = names.dictionary.cast(pa.string())
        base = self.size + 1
        first = names.indices.to_numpy().astype(np.int64)
        second = np.where(goes_on, np.append(first[1:], self.size)[:len(first)], self.size)
        third = np.where(second < self.size, np.append(second[1:], self.size)[:len(first)], self.size)
        if base ** 3 < 1 << 63:
            edge, self.count = np.unique((first * base + second) * base + third, return_counts=True)
            node, self.three = np.divmod(edge, base)
        else:
            known, number = np.unique(first * base + second, return_inverse=True)
            edge, self.count = np.unique(number * base + third, return_counts=True)
            node, self.three = known[edge // base], edge % base
        self.one, self.two = np.divmod(node, base)

    def cells(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The filter's bit of each node; `_cell` is the same in Spark."""
        own = np.uint64(xxhash.xxh64_intdigest(self.lang.encode(), seed=42))
        words = self.names.cast(pa.binary()).to_pylist()
        word = np.fromiter((xxhash.xxh64_intdigest(w, seed=42) for w in words), dtype=np.uint64, count=self.size)
        return (((word[one] >> np.uint64(7)) ^ word[two] ^ (own >> np.uint64(13))) & np.uint64(CELLS - 1)).astype(np.int64)

    def take(self, numbers: np.ndarray) -> pa.Array:
        return self.names.take(pa.array(numbers, pa.int64()))

    def rows(self, *columns: pa.Array) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(columns[0]), ROWS):
            part = [c.slice(at, ROWS) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array([self.lang] * len(part[0]), pa.string()), *part], names=["lang", *"abcdef"[:len(part)]])


def _flows(graph: _Graph) -> Iterator[pa.RecordBatch]:
    """Flow of each node (w1, w2), then of each word (w2 empty), then of all words (both empty)."""
    if not len(graph.count):
        return
    start = np.flatnonzero((np.diff(graph.one, prepend=-1) != 0) | (np.diff(graph.two, prepend=-1) != 0))
    flow, one, two = np.add.reduceat(graph.count, start), graph.one[start], graph.two[start]
    pair = two < graph.size
    begin = np.flatnonzero(np.diff(one, prepend=-1))
    per_word = np.add.reduceat(flow, begin)
    nothing = pa.array([""] * (len(begin) + 1), pa.string())
    w1 = pa.concat_arrays([graph.take(one[pair]), graph.take(one[begin]), pa.array([""], pa.string())])
    w2 = pa.concat_arrays([graph.take(two[pair]), nothing])
    yield from graph.rows(w1, w2, pa.array(np.concatenate([flow[pair], per_word, [flow.sum()]]), pa.int64()))


def _edges(frequent: Broadcast, graph: _Graph) -> Iterator[pa.RecordBatch]:
    """The edges between nodes that the filter lets pass."""
    bits = np.frombuffer(frequent.value, dtype=np.uint8)
    passes = lambda cell: (bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
    kept = np.flatnonzero((graph.three < graph.size) & (graph.count > 0))
    kept = kept[passes(graph.cells(graph.one[kept], graph.two[kept]))]
    kept = kept[passes(graph.cells(graph.two[kept], graph.three[kept]))]
    yield from graph.rows(*[graph.take(numbers[kept]) for numbers in (graph.one, graph.two, graph.three)], pa.array(graph.count[kept], pa.int64()))


def _blocks(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Texts as buffers of about `BLOCK` bytes, cut between pieces."""
    data = b"\n".join(texts).translate(_LETTERS)
    begin = 0
    while begin < len(data):
        end = len(data) if len(data) - begin <= BLOCK else data.rfind(b"\n", begin, begin + BLOCK)
        if end < 0:                                       # a piece longer than a block stays in one
            end = data.find(b"\n", begin + BLOCK)
            end = len(data) if end < 0 else end
        yield np.frombuffer(data, dtype=np.uint8, offset=begin, count=end - begin)
        begin = end + 1


def _graphs(give, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What `give` finds in the local graphs of the texts of each language; enough texts are counted at a time."""
    waiting: dict[str, list[bytes]] = {}
    held = 0

    def counted() -> Iterator[pa.RecordBatch]:
        for lang, texts in waiting.items():
            for block in _blocks(texts):
                yield from give(_Graph(lang, block))
        waiting.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1).cast(pa.large_binary()), strict=True):
            data = text.as_py()
            waiting.setdefault(lang.as_py(), []).append(data)
            held += len(data)
            if held >= HELD:
                yield from counted()
                held = 0
    yield from counted()


_PAIR, _EDGE = ["lang", "w1", "w2"], ["lang", "w1", "w2", "w3"]


def _cell() -> Column:
    low = F.call_function("shiftrightunsigned", F.xxhash64("w1"), F.lit(7)).bitwiseXOR(F.xxhash64("w2"))
    return low.bitwiseXOR(F.call_function("shiftrightunsigned", F.xxhash64("lang"), F.lit(13))).bitwiseAND(F.lit(CELLS - 1))


def _filter(nodes: DataFrame) -> bytes:
    """One bit per node's cell; CELLS / 8 bytes, whatever the number of nodes."""
    place = _cell() + 1
    parts = nodes.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    width = CELLS // 8 // 4096
    found = {r["part"]: bytes(r["bits"]) for r in parts.collect()}          # of 4096 bytes each
    return b"".join(found.get(i + 1, bytes(4096)) for i in range(width))


def weighted_graph(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(edges, nodes, words, totals) of the graph over `docs` (lang, text), per language.

    edges (lang, w1, w2, w3, n), nodes (lang, w1, w2, n) and words (lang, w1, n) have all that occur `least` times or more, with
    exact counts; totals (lang, n) has all word occurrences. Only triples are counted in the texts: a node's count is its flow,
    the sum of its edges and of the pieces that end there, and a word's count the sum of its nodes and piece ends.

    Two passes over the texts. The first sends the flows of each block. A frequent edge joins two frequent nodes, so
    the second sends only edges whose nodes a bit filter of fixed size lets pass; all are then counted, whatever passed.
    Every sum is combined per block of text before it is sent, so a hot pair or triple is one row per block, and rows are dealt
    out by the whole triple, so a pair with many edges is no burden to any task.
    """
    texts = columns_of(docs, "lang", "text").where("text <> ''").select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), "text")
    local = map_arrow(texts, partial(_graphs, _flows), "lang string, w1 string, w2 string, flow bigint")
    flow = local.repartition(*_PAIR).groupBy(*_PAIR).agg(F.sum("flow").alias("n"))
    flow = stored(flow.where((F.col("n") >= least) | (F.col("w1") == "")), "flow")
    nodes, words, totals = flow.where("w2 <> ''"), flow.where("w1 <> '' AND w2 = ''").select("lang", "w1", "n"), flow.where("w1 = ''").select("lang", "n")
    frequent = docs.sparkSession.sparkContext.broadcast(_filter(nodes))
    going = map_arrow(texts, partial(_graphs, partial(_edges, frequent)), "lang string, w1 string, w2 string, w3 string, c bigint")
    edges = stored(going.repartition(*_EDGE).groupBy(*_EDGE).agg(F.sum("c").alias("n")).where(F.col("n") >= least), "edges")
    return edges, nodes.select(*_PAIR, "n"), words, totals


def _links(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(lang, own, before, w3): each edge after a unary node with the one edge before it, as phrases.

    A node is unary where one edge brings all its flow and one edge takes all of it away. Pieces that start or end there
    would be missing from such an edge, so unary nodes never form a ring.
    """
    inner = nodes.select("lang", F.col("w1").alias("x"), F.col("w2").alias("y"), F.col("n").alias("all"))
    into = edges.select("lang", F.col("w1").alias("u"), F.col("w2").alias("x"), F.col("w3").alias("y"), "n")
    away = edges.select("lang", F.col("w1").alias("x"), F.col("w2").alias("y"), "w3", F.col("n").alias("m"))
    unary = into.join(inner, ["lang", "x", "y"]).where("n = all").join(away, ["lang", "x", "y"]).where("m = all")
    return unary.select("lang", F.concat_ws(" ", "x", "y", "w3").alias("own"), F.concat_ws(" ", "u", "x", "y").alias("before"), "w3")


def unary_paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(lang, words, n): the graph with its unary paths compacted; every edge lies in just one row.

    A path that runs through unary nodes has one count all along. Each edge finds the start of its path by doubling its
    steps back, so rounds grow with the logarithm of the longest path, which no piece of text exceeds.
    """
    links = stored(_links(edges, nodes), "links")
    state = links.select("lang", "own", F.col("before").alias("start"), F.lit(1).alias("steps"), "w3")
    while True:
        ahead = state.select("lang", F.col("own").alias("start"), F.col("start").alias("further"), F.col("steps").alias("more"))
        moved = state.join(ahead, ["lang", "start"], "left")
        state = stored(moved.select("lang", "own", F.coalesce("further", "start").alias("start"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
                                    "w3", F.col("further").isNotNull().alias("moved")), "paths")
        if state.where("moved").isEmpty():
            break
        state = state.drop("moved")
    rest = state.groupBy("lang", F.col("start").alias("phrase")).agg(F.sort_array(F.collect_list(F.struct("steps", "w3"))).alias("rest"))
    named = edges.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.array("w1", "w2", "w3").alias("own"), "n")
    inside = state.select("lang", F.col("own").alias("phrase"))
    starts = named.join(inside, ["lang", "phrase"], "left_anti").join(rest, ["lang", "phrase"], "left")
    return starts.select("lang", F.concat("own", F.coalesce(F.col("rest.w3"), F.array().cast("array<string>"))).alias("words"), "n")


def _windows(size: int, trim: int = 0) -> Column:
    """All runs of `size` words of a path, without the first and last `trim`."""
    at = F.sequence(F.lit(1 + trim), F.size("words") - size + 1 - trim)
    return F.transform(at, lambda i: F.slice("words", i, size))


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)) by whole numbers of up to 38 digits."""
    wide = lambda c: c.cast("decimal(18,0)")
    top = (wide(a) * wide(a)) * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", top.cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(38,0)"))


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """Per language the `top` phrases of two and three words: lang, rank, phrase, a, l, r, n, score.

    `docs` has lang and text; a null lang is "und", null texts are empty. A phrase counts from `least` occurrences on. Its
    score is that of its weakest cut, a * a / (l * r) in millionths, rounded down; ties go to the earlier cut. A pair goes
    where a triple that contains it has `share` percent of its count. Ranks go by score, count and phrase.

    Counts come from `weighted_graph`. Triples are read off the compacted paths; pairs inside a path have the count of
    the triples around them, and so go at once; pairs between paths have the flow of their node.
    """
    edges, nodes, words, totals = weighted_graph(docs, least)
    paths = stored(unary_paths(edges, nodes), "compact")
    triples = paths.select("lang", F.explode(_windows(3)).alias("g"), "n").select(
        "lang", *[F.col("g")[i].alias(f"w{i + 1}") for i in range(3)], F.col("n").alias("a"))
    inside = paths.where(F.size("words") > 3).select("lang", F.explode(_windows(2, 1)).alias("g")).select("lang", F.col("g")[0].alias("w1"), F.col("g")[1].alias("w2"))
    around = triples.select("lang", "w1", "w2", "a").union(triples.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    pairs = nodes.withColumnRenamed("n", "a")
    outer = pairs.join(inside, _PAIR, "left_anti").join(around.groupBy(*_PAIR).agg(F.max("a").alias("longer")), _PAIR, "left")
    outer = outer.where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    single = lambda at, name: words.select("lang", F.col("w1").alias(at), F.col("n").alias(name))
    double = lambda one, two, name: nodes.select("lang", F.col("w1").alias(one), F.col("w2").alias(two), F.col("n").alias(name))
    cut = lambda k, left, right: F.struct(_score(F.col("a"), left, right).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))
    first, second, third, head, tail = (F.col(c) for c in ("n1", "n2", "n3", "n12", "n23"))
    of_pairs = outer.join(single("w1", "n1"), ["lang", "w1"]).join(single("w2", "n2"), ["lang", "w2"])
    of_pairs = of_pairs.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", cut(1, first, second).alias("cut"))
    of_triples = triples.join(double("w1", "w2", "n12"), _PAIR).join(double("w2", "w3", "n23"), ["lang", "w2", "w3"])
    of_triples = of_triples.join(single("w1", "n1"), ["lang", "w1"]).join(single("w3", "n3"), ["lang", "w3"])
    of_triples = of_triples.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.least(cut(1, first, tail), cut(2, head, third)).alias("cut"))
    found = of_pairs.union(of_triples).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = stored(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top), "ranked")
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = f"""
WITH p AS (SELECT coalesce(lang, '{NO_LANG}') AS lang, unnest(string_split_regex(translate(text, '{UPPER.decode()}', '{LOWER.decode()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, unnest(w) AS w1, unnest(w[2:]) AS w2, unnest(w[3:]) AS w3 FROM w WHERE len(w) > 0),
f1 AS MATERIALIZED (SELECT lang, w1, count(*) AS f FROM g WHERE w1 IS NOT NULL GROUP BY ALL),
f2 AS MATERIALIZED (SELECT lang, w1, w2, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}),
f3 AS MATERIALIZED (SELECT lang, w1, w2, w3, count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}),
n AS (SELECT lang, sum(f)::bigint AS n FROM f1 GROUP BY 1),
long AS (SELECT lang, w1, w2, max(f) AS f FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
cuts AS (SELECT b.lang, b.w1 || ' ' || b.w2 AS phrase, b.f AS a, 1 AS k, x.f AS l, y.f AS r FROM f2 b JOIN f1 x ON x.lang = b.lang AND x.w1 = b.w1
    JOIN f1 y ON y.lang = b.lang AND y.w1 = b.w2 LEFT JOIN long m ON m.lang = b.lang AND m.w1 = b.w1 AND m.w2 = b.w2 WHERE m.f IS NULL OR 100 * m.f < {SHARE} * b.f
  UNION ALL SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 1, x.f, y.f FROM f3 t JOIN f1 x ON x.lang = t.lang AND x.w1 = t.w1
    JOIN f2 y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 2, x.f, y.f FROM f3 t JOIN f2 x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2
    JOIN f1 y ON y.lang = t.lang AND y.w1 = t.w3),
scored AS (SELECT *, (1000000::hugeint * a * a // (l::hugeint * r))::bigint AS score FROM cuts),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest QUALIFY rank <= {TOP})
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang)"""
