"""Removal of byte strings that occur elsewhere in a corpus, found by deep-shallow sorting around shared anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import suffixes as S
from .common import columns_of, map_arrow, stored

LARGE = 20_000        # anchors with one gram that a single task still sorts; more are told apart by passage hashes
_NO_ID = -(1 << 63)


def _name(text: Column) -> Column:
    """128-bit name of a text; a null text is an empty one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _lists(sizes: list[int] | np.ndarray, values: pa.Array) -> pa.ListArray:
    """`values` cut into lists of the given sizes."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def _anchor(passage: S.Passage, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct gram hashes of each text and, for each, the places of its anchors: position, bytes before, bytes after in one number."""
    none = np.empty(0, dtype=np.int64)
    for batch in batches:
        grams, places, per_text, per_gram = [none], [none], [], [none]
        for text in batch.column(2).cast(pa.large_binary()):
            pos, gram, before, after = S.anchors(text.as_py() or b"", passage)
            order = np.argsort(gram, kind="stable")
            found, counts = np.unique(gram, return_counts=True)
            grams.append(found)
            places.append(((pos << 20) + (before << 10) + after)[order])
            per_text.append(len(found))
            per_gram.append(counts)
        inner = _lists(np.concatenate(per_gram), pa.array(np.concatenate(places), pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), _lists(per_text, pa.array(np.concatenate(grams), pa.int64())), _lists(per_text, inner)],
            names=["name", "id", "gram", "places"])


def _place(number: int) -> tuple[int, int, int]:
    return number >> 20, (number >> 10) & 1023, number & 1023


def _passages(rows: pa.RecordBatch) -> Iterator[tuple[bytes, bytes, list]]:
    for name, text, found in zip(rows.column(0), rows.column(1).cast(pa.large_binary()), rows.column(2), strict=True):
        yield name.as_py(), text.as_py(), found.as_py()


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around each anchor whose gram occurs elsewhere.

    Equal surroundings within one text, as in runs of one word, go on once. All their passages occur twice, so the spans
    they cover are settled here; such rows have no bytes, their start as `pos` and their length as `before`.
    """
    kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary())
    for batch in batches:
        for name, text, found in _passages(batch):
            rows, settled = [], []
            for anchor in found:
                seen: dict[tuple[int, bytes], list[int]] = {}
                for pos, before, after in map(_place, anchor["places"]):
                    seen.setdefault((before, text[pos - before:pos + after]), []).append(pos)
                for (before, data), at in seen.items():
                    rows.append((anchor["gram"], name, at[0], before, data))
                    if len(at) > 1:
                        settled += [(pos - before, pos - before + len(data)) for pos in at]
            rows += [(rows[0][0], name, start, stop - start, None) for start, stop in _merged(settled)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                             names=["gram", "name", "pos", "before", "bytes"])


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def _hashes(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A 128-bit hash of every single passage around an anchor; one that a text has more than once goes on once.

    What such passages cover is settled here: rows without a hash are spans that go.
    """
    kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int32())
    for batch in batches:
        for name, text, found in _passages(batch):
            places = [_place(p) for a in found for p in a["places"]]
            seen: dict[bytes, list[int]] = {}
            for start in {s for pos, before, after in places for s in range(pos - before, pos + after - length + 1)}:
                seen.setdefault(xxhash.xxh3_128_digest(text[start:start + length]), []).append(start)
            rows = [(passage, name, at[0], at[0] + length) for passage, at in seen.items()]
            rows += [(None, name, *span) for span in _merged([(s, s + length) for at in seen.values() if len(at) > 1 for s in at])]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                             names=["passage", "name", "start", "stop"])


def _sort(passage: S.Passage, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removed spans from contexts that come ordered by gram; only the last, unfinished group is carried on."""

    def spans(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        settled = rows.filter(pc.is_null(rows.column("bytes"))).combine_chunks()
        if settled.num_rows:
            start = settled.column("pos").to_numpy()
            yield pa.RecordBatch.from_arrays([settled.column("name").chunk(0), pa.array(start), pa.array(start + settled.column("before").to_numpy())],
                                             names=["name", "start", "stop"])
        rows = rows.filter(pc.is_valid(rows.column("bytes"))).combine_chunks()
        if not rows.num_rows:
            return
        gram, pos, left = (rows.column(c).to_numpy() for c in ("gram", "pos", "before"))
        data = pa.concat_arrays(rows.column("bytes").chunks).cast(pa.large_binary())
        ends = np.frombuffer(data.buffers()[1], dtype=np.int64)[data.offset:data.offset + len(data) + 1]
        flat = np.frombuffer(data.buffers()[2], dtype=np.uint8)
        group = np.cumsum(np.diff(gram, prepend=gram[:1]) != 0)
        left = left.astype(np.int64)
        near, far = S.repeated(group, flat, ends[:-1], left, np.diff(ends) - left, passage)
        hit = np.flatnonzero(far >= 0)
        yield pa.RecordBatch.from_arrays(
            [rows.column("name").combine_chunks().take(pa.array(hit)) if len(hit) else pa.array([], pa.binary()),
             pa.array((pos[hit] - far[hit]).astype(np.int32)), pa.array((pos[hit] - near[hit] + passage.length).astype(np.int32))],
            names=["name", "start", "stop"])

    rest: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        gram = rows.column("gram").to_numpy()
        cut = int(np.searchsorted(gram, gram[-1])) if len(gram) else 0
        if cut:
            yield from spans(rows.slice(0, cut))
        rest = rows.slice(cut)
    if rest is not None and rest.num_rows:
        yield from spans(rest)


def _texts(docs: DataFrame) -> DataFrame:
    """(name, id, text) of every row; a null id gets the least number.

    No name is null; saying so gives inner and outer joins with this frame one plan, and so one shuffle.
    """
    named = docs.select(_name(F.col("text")).alias("name"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID)).alias("id"),
                        F.coalesce("text", F.lit("")).alias("text"))
    return named.where(F.col("name").isNotNull())


def removals(texts: DataFrame, large: int = LARGE, length: int = S.PASSAGE.length) -> DataFrame:
    """(name, spans): per distinct text of which something goes, the byte spans that go; they may overlap.

    A span is what passages of `length` bytes cover that also start elsewhere, in the same text or another. Texts that
    occur more than once go whole if they have that length. Anchors (least hashed gram of a quarter of it) bring
    equal passages together; around anchors that share a gram both sides are ordered by deep-shallow sorting.
    Where more than `large` anchors share one, passages are counted by a 128-bit hash instead, combined before the
    shuffle, so no group of any size lands in one task. `texts` is shuffled by name, as a caller's join with the result
    does, so that one shuffle of the texts serves both.
    """
    passage = S.Passage(length)
    signed = stored(map_arrow(texts.where(F.octet_length("text") >= length), partial(_anchor, passage),
                              "name binary, id bigint, gram array<bigint>, places array<array<bigint>>"), "anchors")
    names = stored(signed.groupBy("name").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
                   .withColumn("no", F.monotonically_increasing_id()), "names")
    one = signed.join(names.select("name", "id", "no"), ["name", "id"])
    single = one.select("no", F.explode(F.arrays_zip("gram", "places")).alias("a")).select("no", "a.*")
    shared = stored(single.groupBy("gram").agg(F.sum(F.size("places")).alias("n")).where("n > 1"), "grams")
    wanted = single.join(shared, "gram").groupBy("no", (F.col("n") > large).alias("large")).agg(
        F.collect_list(F.struct("gram", "places")).alias("found"))
    wanted = stored(wanted.join(names.select("no", "name", "id"), "no").select("name", F.col("id").alias("own"), "large", "found"), "wanted")

    def around(large: bool) -> DataFrame:
        rows = wanted.where(F.col("large") == large)
        # One row of the text; as two inequalities, so that the name alone stays the key of the shuffle.
        return texts.join(rows, "name").where("id >= own AND id <= own").select("name", "text", "found")

    contexts = map_arrow(around(False), _contexts, "gram bigint, name binary, pos int, before int, bytes binary")
    # Rows of one gram meet in one task, at most `large` of them.
    spans = map_arrow(contexts.repartition("gram").sortWithinPartitions("gram"), partial(_sort, passage), "name binary, start int, stop int")
    if not wanted.where("large").isEmpty():
        # Both uses read the one shuffle of the texts; only the few contexts are hashed twice.
        schema = "passage binary, name binary, start int, stop int"
        twice = map_arrow(around(True), partial(_hashes, length), schema).groupBy("passage").agg(F.count("*").alias("texts")).where("texts > 1 AND passage IS NOT NULL")
        hot = map_arrow(around(True), partial(_hashes, length), schema).join(twice, "passage", "left").where("passage IS NULL OR texts IS NOT NULL")
        spans = spans.union(hot.select("name", "start", "stop"))
    cut = spans.groupBy("name").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    copied = names.where("copies > 1").select("name", F.lit(True).alias("whole"))
    span = "array<struct<start:int,stop:int>>"
    everything = F.array(F.struct(F.lit(0).alias("start"), F.lit((1 << 31) - 1).alias("stop"))).cast(span)
    return cut.join(copied, "name", "full").select("name", F.when(F.col("whole"), everything).otherwise(F.col("spans").cast(span)).alias("spans"))


def _kept(text: bytes, spans: list | None, words: int = 0) -> tuple[bytes, int]:
    """What is left of a text without the runs that its spans make up, and the number of these; runs of fewer than `words` words stay."""
    parts, at, runs = [], 0, 0
    for start, stop in _merged([(s["start"], s["stop"]) for s in spans or []]):
        if words and len(text[start:stop].split()) < words:
            continue
        parts.append(text[at:start])
        at, runs = stop, runs + 1
    parts.append(text[at:])
    return b"".join(parts), runs


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for text, spans in zip(batch.column(1).cast(pa.large_binary()), batch.column(2), strict=True):
            data = text.as_py()
            kept, n = _kept(data, spans.as_py())
            for column, value in zip(out, (len(data), len(data) - len(kept), n, hashlib.sha256(kept).hexdigest()), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.string())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeat_report(docs: DataFrame, large: int = LARGE) -> DataFrame:
    """Per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes that stay, joined).

    Null texts are empty; texts under 400 bytes stay whole. Rows that repeat a text are copies of it.
    """
    texts = _texts(columns_of(docs, "doc_id", "text"))
    rows = texts.join(removals(texts, large), "name", "left").select(F.nullif("id", F.lit(_NO_ID)).alias("doc_id"), "text", "spans")
    return map_arrow(rows, _apply, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def _cut(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [None if t.as_py() is None else _kept(t.as_py(), s.as_py(), words)[0].decode("utf-8", "ignore")
                   for t, s in zip(batch.column(1).cast(pa.large_binary()), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string())], names=["d", "text"])
    return cut


def without_repeats(docs: DataFrame, large: int = LARGE, length: int = S.PASSAGE.length, words: int = 0) -> DataFrame:
    """`docs` with the repeated passages cut out of `text`; a character of which only some bytes go, goes whole.

    A run of repeated bytes goes if passages of `length` bytes make it up and it has `words` words or more, cut ones at its ends
    included. All other columns, of any name, are handed on; null texts stay null.
    """
    gone = removals(_texts(columns_of(docs, "doc_id", "text")), large, length)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select(_name(F.col("text")).alias("name"), F.struct(*rest).alias("d"), "text").join(gone, "name", "left").select("d", "text", "spans")
    cut = map_arrow(rows, _cut(words), f"d {rows.schema['d'].dataType.simpleString()}, text string")
    return cut.select(*[F.col("text") if c == "text" else F.col("d").getField(c).alias(c) for c in docs.columns])
