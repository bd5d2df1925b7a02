"""Packing of token sequences into windows: non-negative least squares over shallow length combinations."""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, map_arrow, stored

WINDOW = 2048
END = 1
TOKENIZER = "word_bpe_49k.json"
TOGETHER_RANKED = 100_000  # pieces a part has on average in which pieces of one length are numbered
CELL = 4096               # places of one length that meet their pieces in one group
TOGETHER = 500            # texts whose unknown runs are encoded together
STEPS = 300               # iterations of the least-squares solver
_PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def _shown() -> dict[int, int]:
    """Byte-level vocabularies write each byte as one character: printable Latin-1 as itself, the others from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {byte: 256 + i for i, byte in enumerate(b for b in range(256) if b not in plain)}


class _Ids:
    """Token ids of runs of text without ASCII white space, as little-endian bytes.

    The tokenizer never joins anything across white space, so the ids of a text are those of its runs, in order. Nor does it
    join letters with the punctuation after them, and it lowers case: "Word,", "word." and "word" share one encoding of
    "word". That is used for Latin-1 letters, where lower case is one character for one and no other normalisation applies;
    they go to the tokenizer's model at once, in its byte alphabet. Any other run is encoded as it is. Runs and parts
    are remembered up to a bound.
    """

    runs, parts = 400_000, 600_000
    marks = b".,!?;:%*&$#|"
    shown = _shown()

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark runs one worker per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.of_run, self.of_part = self.tokenizer.model, {}, {}

    def _letters(self, run: bytes) -> bytes | None:
        """The letters that a run of Latin-1 letters and marks starts with, in lower case; None for other runs."""
        letters = run.lower().rstrip(self.marks)
        if letters.isalpha():                               # ASCII letters
            return letters
        text = run.decode()
        if max(text) <= "\u00ff" and (letters := text.lower().encode().rstrip(self.marks)).decode().isalpha():
            return letters
        return None

    def _whole(self, run: bytes) -> bytes:
        return array("I", self.tokenizer.encode(run.decode(), add_special_tokens=False).ids).tobytes()

    def _encode(self, run: bytes) -> bytes:
        letters = self._letters(run)
        if letters is None:
            return self._whole(run)
        of_part = self.of_part
        ids = of_part.get(letters)
        if ids is None:
            found = self.model.tokenize(letters.decode("latin-1").translate(self.shown))
            ids = of_part[letters] = array("I", [t.id for t in found]).tobytes()
        if len(run) == len(letters):
            return ids
        marks = run[len(letters):]
        if marks not in of_part:
            of_part[marks] = self._whole(marks)
        return ids + of_part[marks]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        runs = [text.split() for text in texts]             # bytes split at ASCII white space only
        if len(self.of_run) > self.runs:
            self.of_run = {}
        if len(self.of_part) > self.parts:
            self.of_part = {}
        of_run = self.of_run
        for run in set().union(*runs) - of_run.keys():
            of_run[run] = self._encode(run)
        return [b"".join(map(of_run.__getitem__, r)) for r in runs]


@cache
def _ids(path: str) -> _Ids:
    """One per worker process and file, kept from task to task."""
    return _Ids(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def _cutter(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    end = np.asarray([END], dtype="<u4").tobytes()
    width = 4 * WINDOW

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids(path)
        for batch in batches:
            rows: list[tuple] = []
            docs, texts = batch.column(0).to_pylist(), [t.as_py() or b"" for t in batch.column(1).cast(pa.large_binary())]
            for first in range(0, len(docs), TOGETHER):
                for doc, found in zip(docs[first:first + TOGETHER], ids.encode(texts[first:first + TOGETHER]), strict=True):
                    data = found + end
                    rows += [(doc, at // 4, len(piece := data[at:at + width]) // 4, zlib.crc32(piece), len(data) // 4)
                             for at in range(0, len(data), width)]
            kinds = (pa.int64(),) * 5
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
    return cut


def pieces(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Every document's ids and end id, cut after each full window: doc_id, start, length, ids_crc32, doc_tokens."""
    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    return map_arrow(rows, _cutter(tokenizer or default_tokenizer()), _PIECE)


@dataclass(frozen=True)
class Pattern:
    """`repeats` sequences, each filled by one piece of each of `lengths`."""

    lengths: tuple[int, ...]
    repeats: int


def combinations(histogram: np.ndarray) -> np.ndarray:
    """Rows of up to three lengths that fill a window exactly, 0 for none: all pairs and triples, which the window bounds to about 350,000."""
    lengths = np.flatnonzero(histogram)
    have = np.zeros(WINDOW + 1, dtype=bool)
    have[lengths] = True
    rows = [np.array([[WINDOW, 0, 0]])] if have[WINDOW] else []
    low = lengths[(2 * lengths <= WINDOW)]
    low = low[have[WINDOW - low]]
    rows.append(np.stack([WINDOW - low, low, np.zeros_like(low)], axis=1))
    for a in lengths[3 * lengths >= WINDOW]:                # the longest of three is a third of the window at least
        b = lengths[lengths <= a]
        c = WINDOW - a - b
        ok = (c > 0) & (c <= b)
        ok[ok] = have[c[ok]]
        rows.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], axis=1))
    return np.concatenate(rows)


def least_squares(mixes: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Non-negative repeat counts whose pieces come closest to the histogram, by accelerated projected gradients."""
    goal = histogram.astype(np.float64)
    flat = mixes.ravel()
    used = flat > 0
    owner = np.repeat(np.arange(len(mixes)), 3)[used]
    flat = flat[used]
    degree = np.bincount(flat, minlength=WINDOW + 1).max() if len(flat) else 1
    step = 1.0 / (3.0 * degree)
    x = y = np.zeros(len(mixes))
    t = 1.0
    for _ in range(STEPS):
        off = np.bincount(flat, weights=y[owner], minlength=WINDOW + 1) - goal
        new = np.maximum(y - step * np.bincount(owner, weights=off[flat], minlength=len(mixes)), 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / after * (new - x)
        x, t = new, after
    return x


def patterns(histogram: np.ndarray) -> list[Pattern]:
    """Patterns that use up the histogram exactly: solved and rounded repeats first, what is left greedily.

    Most triples get less than one repeat. Rounding carries the rest on to the next row, so that these count together.
    The work depends on the window only, not on how many pieces there are. The greedy part starts with the longest piece left
    and adds the longest that fits, for as many sequences at once as the counts allow.
    """
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    found: list[Pattern] = []

    def use(lengths: list[int], most: int) -> None:
        kinds, counts = np.unique(lengths, return_counts=True)
        n = int(min(most, (left[kinds] // counts).min()))
        if n > 0:
            left[kinds] -= n * counts
            found.append(Pattern(tuple(int(x) for x in lengths), n))

    mixes = combinations(left)
    if len(mixes):
        solved = least_squares(mixes, left)
        repeats = np.diff(np.floor(np.cumsum(solved) + 0.5).astype(np.int64), prepend=0)
        order = np.argsort(-solved, kind="stable")
        for i in order[repeats[order] > 0]:
            use([x for x in mixes[i].tolist() if x], int(repeats[i]))
    while left.any():
        room, lengths, spare = WINDOW, [], left.copy()
        while room and len(fits := np.flatnonzero(spare[1:room + 1])):
            lengths.append(int(fits[-1]) + 1)
            spare[lengths[-1]] -= 1
            room -= lengths[-1]
        use(lengths, int(left.max()))
    return found


def _places(found: list[Pattern]) -> np.ndarray:
    """Rows (length, low, high, first, offset): pieces `low` .. `high` - 1 of a length lie at `offset` of the sequences from `first` on."""
    taken = np.zeros(WINDOW + 1, dtype=np.int64)
    places, first = [], 0
    for pattern in found:
        offset = 0
        for length in pattern.lengths:
            places.append((length, int(taken[length]), int(taken[length]) + pattern.repeats, first, offset))
            taken[length] += pattern.repeats
            offset += length
        first += pattern.repeats
    return np.array(places, dtype=np.int64).reshape(-1, 5)


def _ranked(cut: DataFrame, counts: DataFrame) -> DataFrame:
    """Pieces with `rank`, their number among those of their length: within parts, then over the sums of the parts."""
    before = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    here = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")) - 1
    return cut.withColumn("here", here).join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("here")).drop("here", "before", "part")


def packed(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document's ids, with the end id, are cut only after full windows. Pieces of one length are numbered in two steps, in
    parts by a hash of the stored row, as many as there are pieces for, whatever their ids. They meet the places that patterns have for this length in groups of
    `CELL` numbers, in which each piece takes the last place that begins before it; so no sequence, length or place
    needs its pieces in one task, and nothing is broadcast. Sequence ids are gapless from 0. A null text is empty and has the end
    id alone; repeated rows are packed each.
    """
    import pandas as pd

    cut = stored(pieces(columns_of(docs, "doc_id", "text"), tokenizer).withColumn("row", F.monotonically_increasing_id()), "pieces")
    parts = max(1, -(-cut.count() // TOGETHER_RANKED))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts))).drop("row")
    counts = stored(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    histogram = np.zeros(WINDOW + 1, dtype=np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():       # one row per length, WINDOW at most
        histogram[row["length"]] = row["n"]

    # The window bounds this list: at most 1024 pairs, 350,000 triples and as many greedy patterns as the counts of a pattern can run out.
    table = pd.DataFrame(_places(patterns(histogram)), columns=["length", "low", "high", "first", "offset"], dtype="int64")
    spots = docs.sparkSession.createDataFrame(table, "length bigint, low bigint, high bigint, first bigint, offset bigint")
    cell = lambda column: F.floor(F.col(column) / CELL)
    spots = spots.withColumn("cell", F.explode(F.sequence(cell("low"), F.floor((F.col("high") - 1) / CELL))))
    place = F.struct("low", "first", "offset")
    starts = spots.select("length", "cell", F.greatest(F.col("low"), F.col("cell") * CELL).alias("rank"), place.alias("place"), F.lit(None).cast(
        "struct<doc_id:bigint,start:bigint,ids_crc32:bigint,doc_tokens:bigint>").alias("piece"))
    ranked = _ranked(cut, counts).select("length", cell("rank").alias("cell"), "rank", F.lit(None).cast("struct<low:bigint,first:bigint,offset:bigint>").alias("place"),
                                         F.struct("doc_id", "start", "ids_crc32", "doc_tokens").alias("piece"))
    # A place sorts before the piece that has its first number.
    order = Window.partitionBy("length", "cell").orderBy("rank", F.col("piece").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = starts.unionByName(ranked).withColumn("s", F.last("place", ignorenulls=True).over(order)).where("piece IS NOT NULL")
    return met.select("piece.doc_id", "piece.start", "length", "piece.ids_crc32", "piece.doc_tokens",
                      (F.col("s.first") + F.col("rank") - F.col("s.low")).alias("sequence_id"), F.col("s.offset").alias("offset"))
