"""Near-duplicates: banded MinHash finds candidates, odd sketches sieve them, full shingle sets confirm them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .common import columns_of, map_arrow, map_pandas, stored
from .components import components

WORDS64 = S.SKETCH_BITS // 64
PORTION = 1 << 21     # shingles of one block or chunk: 16 MB of sets in a task
_SIGNATURE = "doc_id bigint, n_shingles bigint, node binary, bands array<bigint>, sketch array<bigint>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = S.WordHashes()
    for batch in batches:
        rows: list[list] = [[], [], [], []]
        for text in batch.column(1).cast(pa.large_binary()):
            words = S.word_list(text.as_py() or b"")
            found = S.shingle_set(words, hashes)
            least = S.samples(found) if len(found) else None
            for column, value in zip(rows, (len(found), S.same_words(words) if len(found) else None,
                                            None if least is None else S.band_keys(least),
                                            None if least is None else S.odd_sketch(least)), strict=True):
                column.append(value)
        lists = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary()),
             pa.array(rows[2], lists), pa.array(rows[3], lists)],
            names=["doc_id", "n_shingles", "node", "bands", "sketch"])


def signatures(docs: DataFrame) -> DataFrame:
    """Per row: size of the shingle set, name of the word sequence, band keys, odd sketch."""
    return map_arrow(docs.select(F.col("doc_id").cast("bigint"), "text"), _sign, _SIGNATURE)


def xor_count(one: Column, other: Column) -> Column:
    total = F.bit_count(one[0].bitwiseXOR(other[0]))
    for i in range(1, WORDS64):
        total = total + F.bit_count(one[i].bitwiseXOR(other[i]))
    return total


def _sieve(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs whose sizes and sketches allow a similarity of 0.75."""
    side = lambda s, key: sketches.select(F.col("doc_id").alias(key), F.col("sketch").alias(f"s{s}"),
                                          F.col("n_shingles").alias(f"n{s}"))
    joined = pairs.join(side(1, "u"), "u").join(side(2, "v"), "v")
    close = (100 * F.least("n1", "n2") >= 75 * F.greatest("n1", "n2")) & \
        (xor_count(F.col("s1"), F.col("s2")) <= S.most_distance())
    return joined.where(close).select("u", "v")


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, last, known = S.WordHashes(), None, np.empty(0, dtype=np.uint64)
    for batch in batches:
        keep = []
        one, other = batch.column(2).cast(pa.large_binary()), batch.column(3).cast(pa.large_binary())
        for i in range(batch.num_rows):
            if (right := other[i].as_py()) != last:  # rows come ordered by the pivot
                last, known = right, S.shingle_set(S.word_list(right), hashes)
            keep.append(S.linked(S.shingle_set(S.word_list(one[i].as_py()), hashes), known))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that are links on their full sets. Only texts of candidates leave the joins."""
    side = lambda key, name: texts.select(F.col("doc_id").alias(key), F.col("text").alias(name))
    both = pairs.join(side("u", "one"), "u").join(side("v", "other"), "v").select("u", "v", "one", "other")
    return map_arrow(both, _confirm, "u bigint, v bigint").distinct()


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text in column 0 gives way to its shingle set."""
    hashes = S.WordHashes()
    for batch in batches:
        sets = [S.shingle_set(S.word_list(t.as_py()), hashes).tobytes() for t in batch.column(0).cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), *batch.columns[1:]], names=["shingles", *batch.schema.names[1:]])


def _links_within(part: pd.DataFrame) -> pd.DataFrame:
    """Links between the rows of a block and those of a chunk that bear other labels, as far as components need them.

    Sketches sieve all pairs; whole sets decide. Once two labels are joined by a link, further pairs of the two are passed over.
    """
    limit, found = S.most_distance(), []
    block, chunk = part[part["outer"]], part[~part["outer"]]
    root: dict[int, int] = {}

    def lead(label: int) -> int:
        while root.setdefault(label, label) != label:
            root[label] = label = root[root[label]]
        return label

    if len(block) and len(chunk):
        ids, labels, sizes = (chunk[c].to_numpy() for c in ("doc_id", "label", "n_shingles"))
        bits = np.stack(chunk["sketch"].to_numpy()).view(np.uint64)
        sets = [np.frombuffer(x, dtype=np.uint64) for x in chunk["shingles"]]
        for i, label, size, sketch, own in zip(*(block[c] for c in ("doc_id", "label", "n_shingles", "sketch", "shingles")), strict=True):
            mine = np.frombuffer(own, dtype=np.uint64)
            far = np.bitwise_count(bits ^ np.asarray(sketch).view(np.uint64)).sum(axis=1)
            ok = (far <= limit) & (labels != label) & (100 * np.minimum(sizes, size) >= 75 * np.maximum(sizes, size))
            for j in np.flatnonzero(ok):
                one, other = lead(label), lead(labels[j])
                if one != other and S.linked(mine, sets[j]):
                    root[max(one, other)] = min(one, other)
                    found.append((max(i, ids[j]), min(i, ids[j])))
    return pd.DataFrame(found, columns=["u", "v"], dtype="int64")


def _cross(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """`_links_within` for each (family, block, chunk); rows come in this order, only the last group is carried on."""
    rest = None
    for frame in frames:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        key = frame[["family", "block", "chunk"]]
        starts = np.flatnonzero((key != key.shift()).any(axis=1).to_numpy())
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            yield _links_within(frame.iloc[a:b])
        rest = frame.iloc[starts[-1]:] if len(starts) else None
    if rest is not None:
        yield _links_within(rest)


def _labels(edges: DataFrame) -> DataFrame:
    """A first label per document from the links so far: its least neighbour, followed once."""
    first = stored(edges.groupBy("u").agg(F.min("v").alias("label")), "labels")
    jump = first.select(F.col("u").alias("label"), F.col("label").alias("next"))
    return first.join(jump, "label", "left").select(F.col("u").alias("doc_id"), F.coalesce("next", "label").alias("label"))


def _remaining_links(shared: DataFrame, edges: DataFrame, sketches: DataFrame, texts: DataFrame) -> DataFrame:
    """Links among candidates that the pivots have not settled.

    A bucket whose documents all bear one label is done. The others connect documents to families. In a family every
    document outside its heaviest label meets every other one, in blocks and chunks of about `PORTION` shingles that
    are spread over tasks; texts are read once per document, and only links leave a task.
    """
    named = shared.join(_labels(edges), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    named = stored(named.select("bucket", "doc_id", "label"), "named")
    unsettled = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("doc_id").alias("first"),
                                            F.count("*").alias("n")).where("low < high and n > 2")
    member = named.join(stored(unsettled.select("bucket", "first"), "unsettled"), "bucket")
    families = components(member.select(F.col("doc_id").alias("u"), F.col("first").alias("v")))
    family = F.coalesce("v", "doc_id").alias("family")
    docs = member.select("doc_id", "label").distinct().join(families, F.col("doc_id") == F.col("u"), "left").select("doc_id", "label", family)
    docs = stored(docs.join(sketches, "doc_id"), "members")
    weights = docs.groupBy("family", "label").agg(F.sum("n_shingles").alias("w")).groupBy("family").agg(
        F.max(F.struct("w", "label")).alias("most"), F.sum("w").alias("w"), F.count("*").alias("labels")).where("labels > 1")
    plan = stored(weights.select("family", F.col("most.label").alias("most"), F.ceil((F.col("w") - F.col("most.w")) / PORTION).alias("blocks"),
                                 F.ceil(F.col("w") / PORTION).alias("chunks")), "families")
    rows = docs.join(plan, "family").join(texts, "doc_id").select("text", "family", "doc_id", "label", "n_shingles", "sketch", "most", "blocks", "chunks")
    rows = map_arrow(rows, _with_sets, "shingles binary, family bigint, doc_id bigint, label bigint, n_shingles bigint, sketch array<bigint>, "
                                       "most bigint, blocks bigint, chunks bigint")
    zero = F.lit(0).cast("bigint")
    spot = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n))
    as_chunk = F.transform(F.sequence(zero, F.col("blocks") - 1),
                           lambda k: F.struct(F.lit(False).alias("outer"), k.alias("block"), spot("chunks").alias("chunk")))
    as_block = F.when(F.col("label") != F.col("most"), F.transform(
        F.sequence(zero, F.col("chunks") - 1), lambda k: F.struct(F.lit(True).alias("outer"), spot("blocks").alias("block"), k.alias("chunk"))))
    none = F.array().cast("array<struct<outer:boolean,block:bigint,chunk:bigint>>")
    parts = rows.select("family", "doc_id", "label", "n_shingles", "sketch", "shingles",
                        F.explode(F.concat(as_chunk, F.coalesce(as_block, none))).alias("p"))
    parts = parts.select("family", "p.*", "doc_id", "label", "n_shingles", "sketch", "shingles")
    grouped = parts.repartition("family", "block", "chunk").sortWithinPartitions("family", "block", "chunk")
    return map_pandas(grouped, _cross, "u bigint, v bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id, kept.

    Documents are linked at a Jaccard similarity of 0.75 or more of their word 5-gram sets; a component is
    what links reach. Rows with one doc_id are one document. Null, empty and blank texts have no shingles and
    stand alone. Rows without doc_id have a null component and a null `kept`.
    """
    docs = columns_of(docs, "doc_id", "text")
    signed = stored(signatures(docs), "signatures")
    some = signed.where(F.col("doc_id").isNotNull() & F.col("node").isNotNull())
    # Equal word sequences have equal sets: their least document stands for all.
    first = stored(some.groupBy("node").agg(F.min("doc_id").alias("first")), "first")
    one = some.select("doc_id", "node", "n_shingles", "bands", "sketch").join(
        first.select(F.col("first").alias("doc_id"), "node"), ["doc_id", "node"], "left_semi")
    sketches = stored(one.drop("node").dropDuplicates(["doc_id", "bands"]), "sketches")
    copies = some.select("doc_id", "node").join(first, "node").where(F.col("doc_id") > F.col("first"))

    buckets = sketches.select("doc_id", F.explode("bands").alias("bucket"))
    pivots = stored(buckets.groupBy("bucket").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last"))
                    .where(F.col("last") > F.col("pivot")).drop("last"), "pivots")
    shared = stored(buckets.join(pivots, "bucket"), "buckets")
    stars = shared.where(F.col("doc_id") > F.col("pivot")).select(F.col("doc_id").alias("u"), F.col("pivot").alias("v")).distinct()
    slim = sketches.select("doc_id", "n_shingles", "sketch")
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint"), "text")
    star_links = stored(_confirmed(stored(_sieve(stars, slim), "stars"), texts), "star-links")
    links = star_links.union(_remaining_links(shared, star_links, slim, texts))

    groups = components(links.union(copies.select(F.col("doc_id").alias("u"), F.col("first").alias("v"))))
    whole = signed.select("doc_id", "n_shingles").join(groups.select(F.col("u").alias("doc_id"), F.col("v").alias("root")), "doc_id", "left")
    component = F.coalesce("root", "doc_id")
    return whole.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
