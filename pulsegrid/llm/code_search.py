"""Exact nearest binary codes by multi-index hashing: codes and queries meet in cells, where numpy looks up whole batches of probes."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, map_arrow, stored

TOP = 10
EVERY = 50            # queries are the rows whose id this number divides
WORD = 64             # bits of a word of a code, the first component's bit highest
CELL = 1 << 19        # codes of a cell, about
LOOKUPS = 1 << 18     # probes or candidates at a time, about
PACKET = 4096         # queries that go to a cell in one row, about
ENOUGH = 200          # candidates per place that a first bound is taken from
FOUND = "asked array<bigint>, vec_id bigint, distance int"
_NONE = (np.empty(0, dtype=np.int64),) * 3


def _signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, code, bits) of (vec_id, embedding): as many words as the longest embedding of the batch needs."""
    for batch in batches:
        lists = batch.column("embedding")
        if not len(lists):
            continue
        values, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        above = pc.or_(pc.greater(values, 0), pc.is_nan(values)).fill_null(False).to_numpy(zero_copy_only=False)     # Spark and SQL put NaN above all numbers
        words = -(-int(sizes.max()) // WORD)
        bits = np.zeros((len(sizes), words * WORD), dtype=bool)
        if sizes.min() == sizes.max():
            bits[:, :sizes[0]] = above.reshape(len(sizes), -1)
        else:
            bits[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(above)) - np.repeat(sizes.cumsum() - sizes, sizes)] = above
        code = np.packbits(bits, axis=1).view(">u8").astype(np.uint64)
        yield pa.record_batch({"vec_id": batch.column("vec_id"), "code": _lists(code), "bits": pa.array(sizes, pa.int32())})


def _lists(words: np.ndarray) -> pa.ListArray:
    offsets = pa.array(np.arange(len(words) + 1, dtype=np.int32) * words.shape[1], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(words.ravel().view(np.int64)))


def _codes(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, bits): one bit per component, set where it is above zero, in words; `bits` is the number of components."""
    kind = vectors.schema["embedding"].dataType.elementType.typeName()
    vectors = vectors if kind in ("float", "double") else vectors.withColumn("embedding", F.col("embedding").cast("array<double>"))
    return map_arrow(vectors, _signs, "vec_id bigint, code array<bigint>, bits int")


def _widths(bits: int, codes: int) -> list[int]:
    """Widths of the segments, as even as can be: some codes to each value of a segment, but no more values than twice the codes."""
    most = max(1.0, math.log2(max(codes, 2)))
    segments = min(bits, max(math.ceil(bits / most), round(bits / max(1.0, most - 3))))
    return [bits // segments + (s < bits % segments) for s in range(segments)]


def _field(code: Column, start: int, width: int) -> Column:
    """`width` bits of a code from bit `start` on, as a number."""
    if not width:
        return F.lit(0).cast("bigint")
    word, skip = divmod(start, WORD)
    value = F.shiftrightunsigned(F.shiftleft(code[word], skip), WORD - width)
    rest = skip + width - WORD
    return value if rest <= 0 else value.bitwiseOR(F.shiftrightunsigned(code[word + 1], WORD - rest))


def _field_of(codes: np.ndarray, start: int, width: int) -> np.ndarray:
    """As `_field`, of a row of words each."""
    if not width:
        return np.zeros(len(codes), dtype=np.int64)
    word, skip = divmod(start, WORD)
    value = (codes[:, word] << np.uint64(skip)) >> np.uint64(WORD - width)
    rest = skip + width - WORD
    if rest > 0:
        value |= codes[:, word + 1] >> np.uint64(WORD - rest)
    return value.astype(np.int64)


def _weighing(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for bits in itertools.combinations(range(width), radius)]


def _numbers(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _flips(width: int, radius: int) -> Column:
    """All values of `width` bits with `radius` bits set, as one constant array."""
    return _numbers(_weighing(width, radius))


@functools.cache
def _flips_of(width: int, radius: int) -> np.ndarray:
    return np.array(_weighing(width, radius), dtype=np.int64)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("asked").orderBy("distance", "vec_id")
    return found.withColumn("place", F.dense_rank().over(order)).where(F.col("place") <= k).distinct()


class Layout:
    """Where segments and cells lie. The codes with one value in the `high` first bits of a segment fill a run of cells."""

    def __init__(self, bits: int, codes: int):
        self.bits, self.widths = bits, _widths(bits, codes)
        self.segments = len(self.widths)
        self.starts = [sum(self.widths[:s]) for s in range(self.segments)]
        self.high = min(max(0, math.ceil(math.log2(max(codes, 1) / CELL))), *self.widths)
        self.first = list(range(self.segments + 1))       # number of the first cell of each run, and of all cells

    def parts(self, code: str) -> Column:
        """Per segment the number of the run that `code` belongs to."""
        return F.array(*[_field(F.col(code), start, self.high) + (s << self.high) for s, start in enumerate(self.starts)])

    def fill(self, index: DataFrame) -> None:
        """Gives each run as many cells as its codes need, none to an empty one."""
        if self.high:
            sizes = dict(index.select(F.explode(self.parts("code")).alias("run")).groupBy("run").count().collect())
            cells = [-(-sizes.get(run, 0) // CELL) for run in range(self.segments << self.high)]
            self.first = list(itertools.accumulate(cells, initial=0))

    def segment(self, cell: int) -> int:
        return (np.searchsorted(self.first, cell, side="right") - 1) >> self.high

    def cells(self, run: Column) -> tuple[Column, Column]:
        """The first cell of a run and the first after it."""
        first = _numbers(self.first)
        return F.get(first, run.cast("int")), F.get(first, run.cast("int") + 1)

    def masks(self) -> np.ndarray:
        """The bits of each segment, in words."""
        words = -(-self.bits // WORD)
        whole = [((1 << w) - 1) << (words * WORD - start - w) for start, w in zip(self.starts, self.widths, strict=True)]
        return np.array([[(mask >> (WORD * (words - 1 - i))) & ((1 << WORD) - 1) for i in range(words)] for mask in whole], dtype=np.uint64)

    def radius(self, distance: np.ndarray, segment: int) -> np.ndarray:
        """How far a segment is searched for all codes within `distance`; below zero: not at all.

        If each segment s were off by more than (distance - s) // segments bits, all together would be by more than `distance`.
        """
        return (distance - segment) // self.segments


class Cell:
    """Codes with the same high bits in one segment, ordered by its low bits, and the search among them."""

    def __init__(self, layout: Layout, segment: int, codes: np.ndarray, ids: np.ndarray, k: int):
        self.layout, self.segment, self.k = layout, segment, k
        self.start, self.low = layout.starts[segment] + layout.high, layout.widths[segment] - layout.high
        values = _field_of(codes, self.start, self.low)
        order = np.argsort(values, kind="stable")
        self.codes, self.ids, self.masks = codes[order], ids[order], layout.masks()
        self.first = np.concatenate([[0], np.bincount(values, minlength=1 << self.low).cumsum()])
        self.several = len(np.unique(ids)) < len(ids)          # ids of several codes

    def near(self, asked: np.ndarray, far: np.ndarray, off: np.ndarray, enough: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, distance): the k nearest codes of each query, as far as `far` asks for; the high bits are `off` by so many.

        The radius grows bit by bit. Once k codes are found, the k-th bounds what is still looked for. With `enough`, a
        query ends when it has met so many codes. Without, a code counts only in the first segment that has to find it:
        over all segments each comes once.
        """
        seen, far = np.zeros(len(asked), dtype=np.int64), far.copy()
        own = _field_of(asked, self.start, self.low)
        found = _NONE
        for step in range(self.low + 1):
            open_ = np.flatnonzero(self.layout.radius(far, self.segment) - off >= step)
            open_ = open_[seen[open_] < enough] if enough else open_
            if not len(open_):
                break
            whole = math.comb(self.low, step) > len(self.codes)        # then reading all codes takes less than looking them up
            if whole:
                others = ~np.isin(found[0], open_)
                found = tuple(part[others] for part in found)
            flips = np.zeros(1, dtype=np.int64) if whole else _flips_of(self.low, step)
            new, portion = [found], max(1, LOOKUPS // len(flips))
            for some in (open_[at:at + portion] for at in range(0, len(open_), portion)):
                probes = own[some, None] ^ flips
                first = np.zeros_like(probes) if whole else self.first[probes]
                count = np.full_like(probes, len(self.codes)) if whole else self.first[probes + 1] - first
                seen[some] += (met := count.sum(axis=1))
                ends = np.flatnonzero(np.diff(met.cumsum() // LOOKUPS, append=-1)) + 1
                for a, z in itertools.pairwise([0, *ends]):
                    new.append(self._met(asked, some[a:z], first[a:z], count[a:z], far, not enough))
            *found, kth = self._cut(*map(np.concatenate, zip(*new, strict=True)), len(asked))
            far = np.minimum(far, kth)
            if whole:
                break
        return tuple(found)

    def _met(self, asked: np.ndarray, some: np.ndarray, first: np.ndarray, count: np.ndarray, far: np.ndarray, once: bool) -> tuple[np.ndarray, ...]:
        """(query, row, distance) of the nearest of the rows that the queries `some` meet: `count` rows from `first` on, per probe."""
        hit = np.flatnonzero(count)
        first, count, query = first.ravel()[hit], count.ravel()[hit], hit // count.shape[1]
        row = np.repeat(first - count.cumsum() + count, count)
        row += np.arange(len(row))
        who = np.repeat(query, count)
        differ = self.codes[row]
        differ ^= asked[some][who]
        distance = _ones(differ)
        keep = np.flatnonzero(distance <= far[some][who])
        who, row, distance = who[keep], row[keep], distance[keep].astype(np.int64)
        if once:
            differ = differ[keep]
            radius = [self.layout.radius(distance, s) for s in range(self.segment + 1)]
            apart = [_ones(differ & self.masks[s]) for s in range(self.segment + 1)]
            mine = apart[-1] <= radius[-1]
            for s in range(self.segment):
                mine &= apart[s] > radius[s]
            who, row, distance = who[mine], row[mine], distance[mine]
        who, row, distance, _ = self._cut(who, row, distance, len(some))
        return some[who], row, distance

    def _cut(self, who: np.ndarray, row: np.ndarray, distance: np.ndarray, queries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The k nearest rows of each query, by distance and id, and the k-th distance; one above all where fewer are there. An id counts once at a distance."""
        if self.several:
            order = np.lexsort((self.ids[row], distance, who))
            who, row, distance = who[order], row[order], distance[order]
            new = np.ones(len(who), dtype=bool)
            new[1:] = (np.diff(who) != 0) | (np.diff(distance) != 0) | (np.diff(self.ids[row]) != 0)
            who, row, distance = who[new], row[new], distance[new]
        most = self.layout.bits + 1
        within = np.bincount(who * most + distance, minlength=queries * most).reshape(queries, most).cumsum(axis=1)
        kth = (within < self.k).sum(axis=1)
        keep = np.flatnonzero(distance <= kth[who])
        who, row, distance = who[keep], row[keep], distance[keep]
        order = np.lexsort((self.ids[row], distance, who))
        who, row, distance = who[order], row[order], distance[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        return who[place < self.k], row[place < self.k], distance[place < self.k], kth


def _ones(words: np.ndarray) -> np.ndarray:
    """Bits set in each row of words."""
    ones = np.bitwise_count(words)
    return ones[:, 0] if ones.shape[1] == 1 else ones.sum(axis=1, dtype=np.int32)


def _words(code: pa.Array, words: int) -> np.ndarray:
    return code.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, words)


def _searched(layout: Layout, k: int, enough: int | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the queries of one cell find among its codes, which come first."""
    words, codes, ids, cell = -(-layout.bits // WORD), [], [], None
    for batch in batches:
        packets = batch.filter(batch.column("query"))
        if len(packets) < len(batch):
            rows = batch.filter(pc.invert(batch.column("query")))
            codes.append(_words(rows.column("code"), words))
            ids.append(rows.column("vec_id").to_numpy())
        if not len(packets):
            continue
        if cell is None:
            codes, ids = np.concatenate(codes or [np.empty((0, words), dtype=np.uint64)]), np.concatenate(ids or [np.empty(0, dtype=np.int64)])
            cell = Cell(layout, layout.segment(packets.column("cell")[0].as_py()), codes, ids, k)
            codes = ids = None
        asked, far = _words(packets.column("code"), words), packets.column("far").flatten().to_numpy().astype(np.int64)
        off = np.repeat(packets.column("off").to_numpy().astype(np.int64), pc.list_value_length(packets.column("far")).to_numpy())
        for at in range(0, len(asked), PACKET):
            some = slice(at, at + PACKET)
            who, row, distance = cell.near(asked[some], far[some], off[some], enough)
            yield pa.record_batch({"asked": _lists(asked[some][who]), "vec_id": pa.array(cell.ids[row]), "distance": pa.array(distance, pa.int32())})


def _packets(asked: DataFrame, queries: int, layout: Layout) -> DataFrame:
    """(run, segment, code, far): queries of one run, their codes one after the other and the distance each asks for."""
    looks = asked.select("asked", "far", F.posexplode(layout.parts("asked")).alias("segment", "run"))
    part = F.pmod(F.xxhash64("asked"), F.lit(math.ceil(queries / (PACKET << layout.high)) or 1)).alias("part")
    looks = looks.where(F.col("far") >= F.col("segment")).groupBy("run", "segment", part).agg(F.collect_list(F.struct("asked", "far")).alias("queries"))
    return looks.select("run", "segment", F.flatten("queries.asked").alias("code"), F.col("queries.far").alias("far"))


def _found(index: DataFrame, asked: DataFrame, queries: int, layout: Layout, k: int, enough: int | None) -> DataFrame:
    """(asked, vec_id, distance): from each cell the k nearest codes of each query (asked, far) that has to look there.

    With `enough`, queries look only at the cells they belong to, and codes come once from each segment.
    """
    first, after = layout.cells(F.col("run"))
    cell = (first + F.pmod(F.xxhash64("code"), after - first)).cast("int").alias("cell")
    none = F.array().cast("array<int>").alias("far"), F.lit(0).alias("off")       # not null: Spark 4.1 measures lists of nulls from the start, row by row
    rows = index.select("code", "vec_id", F.explode(layout.parts("code")).alias("run")).select(cell, F.lit(False).alias("query"), "code", "vec_id", *none)
    # Queries go from their own run to those whose high bits are few enough off, in packets: a packet is one row for a cell.
    radius = 0 if enough else F.least(F.floor((F.array_max("far") - F.col("segment")) / layout.segments), F.lit(layout.high))
    flips = F.flatten(F.slice(F.array(*[_flips(layout.high, off) for off in range(layout.high + 1)]), 1, F.lit(1) + radius))
    looks = stored(_packets(asked, queries, layout), "packets").withColumn("flip", F.explode(flips))
    looks = looks.withColumn("run", F.col("run").bitwiseXOR(F.col("flip"))).where(after > first)
    looks = looks.withColumn("cell", F.explode(F.sequence(first, after - 1)))
    looks = looks.select(F.col("cell").cast("int"), F.lit(True).alias("query"), "code", F.lit(0).cast("bigint").alias("vec_id"), "far",
                         F.bit_count("flip").alias("off"))
    cells = rows.union(looks).repartitionById(layout.first[-1], F.col("cell")).sortWithinPartitions("query")
    return map_arrow(cells, functools.partial(_searched, layout, k, enough), FOUND)


def nearest_codes(vectors: DataFrame, k: int = TOP, every: int = EVERY) -> DataFrame:
    """Per query and place: vec_id, place (1 to k), neighbour_id, distance.

    `vectors` has vec_id and embedding (array of numbers). Queries are the rows whose vec_id `every` divides; all rows are searched,
    the query itself too. Places go by Hamming distance of the sign codes, then by id. Each distinct code is indexed once, with
    the k least ids that bear it, which is all a top-k can need; equal queries are searched once. Segments are about as wide as
    the logarithm of the number of codes, and even. Each segment's index is cut into cells by the segment's first bits. A query
    first meets the codes of its own cells, radius by radius until a k-th distance is sure; then it looks in each segment, cell
    by cell and radius by radius, for all codes within that distance, so no other code can be nearer. Where a radius has more
    values than the cell has codes, the cell is read. Rows without id or components are neither found nor asked; of rows that
    share an id and code one counts, and an id with several codes comes once at each distance.
    """
    rows = columns_of(vectors, "vec_id", "embedding").where("vec_id IS NOT NULL AND size(embedding) > 0")
    signs = stored(_codes(rows.select(F.col("vec_id").cast("bigint"), "embedding")), "signs")
    bits = signs.agg(F.max("bits")).first()[0] or 1
    words = -(-bits // WORD)
    code = F.slice(F.concat("code", F.array_repeat(F.lit(0).cast("bigint"), words)), 1, words)     # missing components count as zero
    coded = stored(signs.select("vec_id", code.alias("code")).distinct(), "codes")
    least = Window.partitionBy("code").orderBy("vec_id")
    index = stored(coded.withColumn("i", F.row_number().over(least)).where(F.col("i") <= k).drop("i"), "index")
    layout = Layout(bits, index.count())
    layout.fill(index)
    asked = stored(coded.where(F.pmod(F.col("vec_id"), F.lit(every)) == 0).select("vec_id", F.col("code").alias("asked")), "asked")
    open_ = stored(asked.select("asked").distinct(), "open")
    queries = open_.count()
    met = _found(index, open_.withColumn("far", F.lit(bits)), queries, layout, k, ENOUGH * k).groupBy("asked", "vec_id").agg(F.min("distance").alias("distance"))
    kth = F.get(F.sort_array(F.collect_list("distance")), F.lit(k - 1)).alias("kth")
    bound = open_.join(met.groupBy("asked").agg(kth), "asked", "left").select("asked", F.coalesce("kth", F.lit(bits)).alias("far"))
    answers = _best(_found(index, bound, queries, layout, k, None), k)
    return asked.join(answers.withColumnRenamed("vec_id", "neighbour_id"), "asked").select("vec_id", "place", "neighbour_id", "distance")


ORACLE = """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings),
q AS (SELECT * FROM c WHERE vec_id % 50 = 0),
d AS (SELECT q.vec_id, c.vec_id AS neighbour_id, list_sum(list_transform(list_zip(q.bits, c.bits), lambda p: CASE WHEN p[1] <> p[2] THEN 1 ELSE 0 END))::int AS distance
      FROM q, c),
r AS (SELECT *, (row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour_id))::int AS place FROM d)
SELECT vec_id, place, neighbour_id, distance FROM r WHERE place <= 10"""
