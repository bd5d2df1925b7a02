"""Languages of whole texts as mixtures: expectation-maximisation over words with n-gram likelihoods."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, held_out, map_arrow

BITS = 15             # n-grams are hashed to 2**BITS buckets; a model has one number per bucket and language at any corpus size
BUCKETS = 1 << BITS
SMOOTHING = 0.5
ROUNDS = 8
LANGUAGES = 256       # languages that are learned at most, those with the most documents: bounds the model, which the driver holds
PENALTY = 3.0         # nats per further language and per logarithm of the number of words
TOGETHER = 1 << 22    # characters times languages that are worked on at once


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), dtype=bool, count=0x110000)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, starts, owners): hashed character 3-grams of all words, where each word's begin, and which text it is of.

    A word is a run of letters, lower-cased; it has one 3-gram around each letter, with 0 beyond its ends.
    """
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join(["", *lowered, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = np.where(_is_letter()[codes], codes, np.uint32(0))
    at = np.flatnonzero(letters)
    before, after = letters[at - 1], letters[at + 1]
    h = before * np.uint32(0x9E3779B1) + letters[at] * np.uint32(0x85EBCA77) + after * np.uint32(0xC2B2AE3D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    h = (h ^ (h >> np.uint32(12))) * np.uint32(0x297A2D39)
    starts = np.flatnonzero(before == 0)
    ends = 1 + np.cumsum([len(t) + 1 for t in lowered]) if lowered else np.empty(0, dtype=np.int64)
    return h >> np.uint32(32 - BITS), starts, np.searchsorted(ends, at[starts], side="right")


def _portions(texts: pa.Array, most: int) -> Iterator[slice]:
    """Runs of rows with about `most` bytes of text together."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        size += text.as_buffer().size if text.is_valid else 0
        if size >= most or i == len(texts) - 1:
            yield slice(begin, i + 1)
            begin, size = i + 1, 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of hashed n-grams per language over the rows of a task."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = np.array(batch.column(0).to_pylist(), dtype=object), batch.column(1)
        for part in _portions(texts, TOGETHER):
            some = texts[part].to_pylist()
            for lang in set(langs[part]):
                found, _, _ = grams([t for t, own in zip(some, langs[part], strict=True) if own == lang])
                totals[lang] = totals.get(lang, 0) + np.bincount(found, minlength=BUCKETS)
    for lang, total in totals.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])],
                                         names=["lang", "gram", "n"])


@dataclass(frozen=True)
class LanguageModel:
    names: list[str]
    weights: np.ndarray   # (BUCKETS, languages): log probabilities

    def likelihoods(self, buckets: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log-likelihood of every word in every language, a bounded number of words at a time."""
        out = np.empty((len(starts), len(self.names)), dtype=np.float32)
        step = max(1, TOGETHER // (8 * len(self.names)))
        for a in range(0, len(starts), step):
            own = starts[a:a + step]
            stop = starts[a + step] if a + step < len(starts) else len(buckets)
            out[a:a + step] = np.add.reduceat(self.weights[buckets[own[0]:stop]], own - own[0])
        return out


def train(docs: DataFrame) -> LanguageModel:
    """Smoothed n-gram log probabilities of each language over all documents that are not held out; of `LANGUAGES` languages at most."""
    rows = docs.where(~held_out() & F.col("lang").isNotNull())
    known = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isin([r["lang"] for r in known])).select("lang", "text")
    found = map_arrow(rows, _count, "lang string, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = found.toArrow()   # at most BUCKETS rows per language
    names = sorted(set(table.column("lang").to_pylist()))
    counts = np.zeros((BUCKETS, len(names)))
    place = {name: i for i, name in enumerate(names)}
    counts[table.column("gram").to_numpy(), [place[x] for x in table.column("lang").to_pylist()]] = table.column("n").to_numpy()
    counts += SMOOTHING
    return LanguageModel(names, np.log(counts / counts.sum(axis=0)).astype(np.float32))


def mixtures(likelihood: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Share of each language in each document, 0 outside its selected language set.

    `likelihood` has a row of log-likelihoods per word; the words of document i begin at `starts[i]`, and each has some. The set
    grows by one language at a time, in the order of the shares under all languages, while the likelihood gains more than
    the penalty; expectation-maximisation refits the shares of each set.
    """
    docs, langs = len(starts), likelihood.shape[1]
    top = likelihood.max(axis=1, keepdims=True)
    chance = np.exp(likelihood - top)
    sizes = np.diff(starts, append=len(likelihood))
    add = lambda values, begin: np.add.reduceat(values, begin, axis=0, dtype=np.float64)

    def fitted(rows: np.ndarray | slice, begin: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = chance[rows]
        n = np.diff(begin, append=len(own))
        for _ in range(ROUNDS):
            joint = own * np.repeat(share.astype(np.float32), n, axis=0)
            joint /= np.maximum(joint.sum(axis=1, keepdims=True), np.float32(1e-30))
            share = add(joint, begin) / n[:, None]
        mixed = np.einsum("ij,ij->i", own, np.repeat(share.astype(np.float32), n, axis=0))
        return share, add(np.log(np.maximum(mixed, np.float32(1e-30))), begin)

    alone = add(likelihood - top, starts)
    first = alone.argmax(axis=1)
    every, best = np.arange(docs), np.zeros((docs, langs))
    best[every, first] = 1
    if langs == 1:
        return best
    shares, _ = fitted(slice(None), starts, np.full((docs, langs), 1 / langs))
    shares[every, first] += 2          # the best single language leads the order
    rank = np.argsort(np.argsort(-shares, axis=1, kind="stable"), axis=1, kind="stable")
    value, active = alone[every, first], every
    penalty = PENALTY * np.log1p(sizes)
    # A further language cannot gain more than all languages together would if every word chose its best one.
    active = active[-value[active] > penalty[active]]
    for k in range(2, langs + 1):
        if not len(active):
            break
        n = sizes[active]
        begin = np.cumsum(n) - n
        rows = np.repeat(starts[active] - begin, n) + np.arange(n.sum())
        share, fit = fitted(rows, begin, np.where(rank[active] < k, 1.0 / k, 0.0))
        better = fit - value[active] > penalty[active]
        best[active[better]], value[active[better]] = share[better], fit[better]
        active = active[better]
    return best


def _predictor(model: LanguageModel) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held, texts = batch.column(0), batch.column(1), batch.column(2)
            for part in _portions(texts, TOGETHER // max(1, len(model.names))):
                yield pa.RecordBatch.from_arrays([ids[part], held[part], *_fit_texts(model, texts[part].to_pylist())],
                                                 names=["doc_id", "held_out", "lang_pred", "score", "languages", "proportions"])
    return predict


def _fit_texts(model: LanguageModel, texts: list[str | None]) -> list[pa.Array]:
    names, scores = ["und"] * len(texts), [0.0] * len(texts)
    sets: list[list[str]] = [[] for _ in texts]
    shares: list[list[float]] = [[] for _ in texts]
    if model.names:
        buckets, starts, owners = grams([t or "" for t in texts])
        if len(starts):
            at, begin = np.unique(owners, return_index=True)
            for i, share in zip(at.tolist(), mixtures(model.likelihoods(buckets, starts), begin), strict=True):
                order = [k for k in np.argsort(-share, kind="stable") if share[k] > 0]
                names[i], scores[i] = model.names[order[0]], float(min(1.0, share[order[0]]))
                sets[i], shares[i] = [model.names[k] for k in order], [float(share[k]) for k in order]
    return [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.list_(pa.string())),
            pa.array(shares, pa.list_(pa.float64()))]


def languages(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, held_out, lang_pred, score, languages, proportions.

    `lang_pred` is the language with the largest share and `score` that share; `languages` and `proportions` are the
    selected set. Null texts, texts without a letter, and all texts when nothing was learned get `und`, 0 and empty lists.
    """
    docs = columns_of(docs, "doc_id", "text", "lang")
    model = train(docs)
    rows = docs.select(F.col("doc_id").cast("bigint"), held_out().alias("held_out"), "text")
    return map_arrow(rows, _predictor(model), "doc_id bigint, held_out boolean, lang_pred string, score double, languages array<string>, proportions array<double>")
