import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from pulsegrid.llm import language_mixture as L

from .cases import DOCS, clashing, documents

STEMS = {"en": ["the", "ing", "tion", "wh", "ea", "sh"], "de": ["ung", "sch", "keit", "ei", "ver", "pf"], "fr": ["eau", "ment", "qu", "oi", "aux", "è"]}


def prose(lang, n, seed):
    pick = random.Random(seed)
    return " ".join("".join(pick.choices(STEMS[lang], k=pick.randint(1, 4))).capitalize() for _ in range(n))


@pytest.fixture(scope="module")
def training(spark):
    rows = [(i, prose(lang, 60, i), lang, "s", 1) for i, lang in enumerate(list(STEMS) * 60)]
    return spark.createDataFrame(rows, DOCS)


def test_held_out_documents(spark, rows, training):
    truth = {r["doc_id"]: r["lang"] for r in rows(training)}
    got = rows(L.languages(training))
    held = [r for r in got if r["held_out"]]
    assert len(got) == 180 and 20 < len(held) < 80
    assert all(r["lang_pred"] == truth[r["doc_id"]] and 0.9 < r["score"] <= 1 for r in held)
    assert all(r["languages"][0] == r["lang_pred"] and abs(sum(r["proportions"]) - 1) < 1e-5 for r in got)


def test_labels_of_held_out_documents_are_not_seen(spark, rows, training):
    from pyspark.sql import functions as F

    from pulsegrid.llm.common import held_out
    wrong = training.withColumn("lang", F.when(held_out(), F.lit("xx")).otherwise(F.col("lang")))
    assert rows(L.languages(wrong).orderBy("doc_id")) == rows(L.languages(training).orderBy("doc_id"))


def test_mixtures_are_found_with_their_shares(spark, rows, training):
    mixed = spark.createDataFrame([(1002, prose("en", 150, 1) + " " + prose("fr", 50, 2), None, None, 1)], DOCS)
    got = {r["doc_id"]: r for r in rows(L.languages(training.unionByName(mixed)))}[1002]
    assert got["languages"] == ["en", "fr"] and abs(got["proportions"][0] - 0.75) < 0.05


def test_sets_grow_only_for_a_gain():
    sure = np.log(np.array([[0.9, 0.1, 1e-9]] * 50 + [[0.1, 0.9, 1e-9]] * 50 + [[0.5, 0.5, 1e-9]] * 40, dtype=np.float32))
    best = L.mixtures(sure, np.array([0, 100]))
    assert (best[0] > 0).tolist() == [True, True, False] and abs(best[0, 0] - 0.5) < 0.02
    assert (best[1] > 0).sum() == 1
    assert L.mixtures(sure[:, :1], np.array([0, 5])).tolist() == [[1.0], [1.0]]


def test_edge_rows(spark, rows):
    got = rows(L.languages(clashing(documents(spark))))
    assert len(got) == 12
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    for i in (1, 2, 3, 9):
        assert (by[i]["lang_pred"], by[i]["score"], by[i]["languages"]) == ("und", 0.0, [])
    assert by[6]["lang_pred"] in ("en", "de") and by[7]["lang_pred"] in ("en", "de")
    assert all(r["held_out"] for r in got if r["doc_id"] is None)
    nothing = rows(L.languages(documents(spark, [(1, "some words", None, "s", 1)])))
    assert [(r["lang_pred"], r["score"]) for r in nothing] == [("und", 0.0)]
    assert L.languages(documents(spark, [])).count() == 0


def test_grams_by_definition():
    buckets, starts, owners = L.grams(["Ab, c9d", "", "..", "ß"])
    assert owners.tolist() == [0, 0, 0, 3] and len(buckets) == 5 and starts.tolist() == [0, 2, 3, 4]
    assert L.grams(["ab"])[0].tolist() == L.grams(["x AB"])[0].tolist()[1:]


def plain_words(text):
    """Words as lists of code points: runs of letters, in lower case."""
    out, word = [], []
    for c in (text or "").lower() + " ":
        if c.isalpha():
            word.append(ord(c))
        elif word:
            out.append(word)
            word = []
    return out


def plain_buckets(word):
    for before, own, after in zip([0, *word], word, [*word[1:], 0], strict=False):
        h = (before * 0x9E3779B1 + own * 0x85EBCA77 + after * 0xC2B2AE3D) % 2**32
        h = (h ^ h >> 15) * 0x2C1B3C6D % 2**32
        h = (h ^ h >> 12) * 0x297A2D39 % 2**32
        yield h >> 17


def plain_model(docs):
    counts = {}
    for i, text, lang in docs:
        if lang is not None and text is not None and crc32(str(i).encode()) % 4 != 2:
            counts.setdefault(lang, Counter()).update(b for w in plain_words(text) for b in plain_buckets(w))
    return {lang: (c, sum(c.values()) + 0.5 * 2**15) for lang, c in counts.items()}


def plain_mixture(model, text):
    """One document's languages and shares, a word and a language at a time."""
    names = sorted(model)
    words = plain_words(text)
    if not words:
        return []
    logs = [[sum(math.log((model[n][0][b] + 0.5) / model[n][1]) for b in plain_buckets(w)) for n in names] for w in words]
    chance = [[math.exp(x - max(row)) for x in row] for row in logs]
    alone = [sum(row[k] - max(row) for row in logs) for k in range(len(names))]
    first = max(range(len(names)), key=lambda k: alone[k])

    def fitted(share):
        for _ in range(L.ROUNDS):
            total = [0.0] * len(names)
            for row in chance:
                joint = [c * s for c, s in zip(row, share, strict=True)]
                total = [t + j / max(sum(joint), 1e-30) for t, j in zip(total, joint, strict=True)]
            share = [t / len(words) for t in total]
        return share, sum(math.log(max(sum(c * s for c, s in zip(row, share, strict=True)), 1e-30)) for row in chance)

    every, _ = fitted([1 / len(names)] * len(names))
    order = sorted(range(len(names)), key=lambda k: (k != first, -every[k], k))
    best, value, penalty = [float(k == first) for k in range(len(names))], alone[first], L.PENALTY * math.log1p(len(words))
    for size in range(2, len(names) + 1):
        if size == 2 and -value <= penalty:
            break
        share, fit = fitted([1 / size if k in order[:size] else 0.0 for k in range(len(names))])
        if fit - value <= penalty:
            break
        best, value = share, fit
    return sorted(((names[k], best[k]) for k in range(len(names)) if best[k] > 0), key=lambda p: -p[1])


def test_equals_a_plain_version(spark, rows):
    """Expectation-maximisation a word at a time, over documents of one to three languages."""
    pick = random.Random(12)
    docs = [(i, prose(lang, 40, i), lang) for i, lang in enumerate(list(STEMS) * 30)]
    for i in range(60):
        langs = pick.sample(list(STEMS), pick.randint(1, 3))
        docs.append((500 + i, ". ".join(prose(lang, pick.randint(1, 60), 1000 + i) for lang in langs), None))
    docs += [(900, None, "en"), (901, "12 !", "de"), (902, "É", None)]
    got = {r["doc_id"]: r for r in rows(L.languages(spark.createDataFrame(docs, "doc_id bigint, text string, lang string").repartition(3)))}
    model, several = plain_model(docs), 0
    for i, text, _ in docs:
        want, have = plain_mixture(model, text), got[i]
        assert have["languages"] == [name for name, _ in want], i
        assert all(abs(a - b) < 2e-3 for a, (_, b) in zip(have["proportions"], want, strict=True)), i
        assert have["lang_pred"] == (want[0][0] if want else "und")
        several += len(want) > 1
    assert several > 15


def test_a_dirty_column_has_a_bound(spark, rows, training, monkeypatch):
    """Of very many labels, those with the most documents are learned."""
    from pyspark.sql import functions as F
    dirty = training.unionByName(training.withColumns({"doc_id": F.col("doc_id") + 1000, "lang": F.concat(F.lit("x"), F.col("doc_id"))}))
    monkeypatch.setattr(L, "LANGUAGES", 3)
    assert L.train(dirty.select("doc_id", "text", "lang")).names == ["de", "en", "fr"]
