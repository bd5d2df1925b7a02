import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsegrid.llm import suffix_dedup as D
from pulsegrid.llm import suffixes as S

from .cases import clashing, documents


def covered(texts, length):
    """Bytes of each text that repeated passages cover, by definition."""
    seen = defaultdict(int)
    for b in texts:
        for i in range(len(b) - length + 1):
            seen[b[i:i + length]] += 1
    for b in texts:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = True
        gone[-1] = False
        yield b, gone


def brute(texts, length=400):
    """Removed bytes by definition, per text."""
    out = []
    for b, gone in covered(texts, length):
        kept = bytes(x for x, g in zip(b, gone[:-1], strict=True) if not g)
        out.append((len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcdéß") for _ in range(pick.randint(2, 8)))
    passages = [" ".join(word() for _ in range(n)) for n in (60, 75, 90, 140, 400)]
    texts = []
    for _ in range(50):
        parts = [" ".join(word() for _ in range(pick.randint(5, 60)))]
        for _ in range(pick.randint(0, 3)):
            p = pick.choice(passages)
            cut = pick.randrange(max(1, len(p) // 3))
            parts += [p[cut:] if pick.random() < 0.5 else p[:len(p) - cut], word()]
        texts.append(" ".join(parts))
    texts += [texts[0], texts[1], "x" * 1500, "ab" * 700, "short", "short", texts[2][:399], texts[3] + texts[3]]
    return texts


@pytest.mark.parametrize("large", [D.LARGE, 2])
def test_equals_brute_force(spark, rows, large):
    texts = corpus(3)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(D.repeat_report(df, large))}
    assert [got[i] for i in range(len(texts))] == brute([t.encode() for t in texts])


@pytest.mark.parametrize("length", [200, 96])
@pytest.mark.parametrize("large", [D.LARGE, 2])
def test_other_lengths_equal_brute_force(spark, rows, length, large):
    texts = corpus(length)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    spans = {bytes(r["name"]): r["spans"] for r in rows(D.removals(D._texts(df), large, length))}
    want = {b: np.flatnonzero(np.diff(gone.astype(int), prepend=0)).tolist() for b, gone in covered([t.encode() for t in texts], length)}
    for b, edges in want.items():
        found = D._merged([(s["start"], min(s["stop"], len(b))) for s in spans.get(hashlib.md5(b).digest()) or []])
        assert [x for span in found for x in span] == edges


def test_runs_of_few_words_stay(spark, rows):
    """Of repeats with 200 bytes and more, those with over 50 words go and shorter ones stay."""
    pick = random.Random(8)
    word = lambda: "".join(pick.choice("abcdefé") for _ in range(pick.randint(2, 8)))
    own = lambda: " ".join(word() for _ in range(40))
    long, short, bare = " ".join(word() for _ in range(51)), " ".join(word() for _ in range(45)), "".join(word() for _ in range(100))
    parts = [(f"{own()} {i}", passage, f"{i} {own()}") for i, passage in enumerate((long, long, short, short, bare, bare))]
    texts = ["\n".join(p) for p in parts]
    got = {r["doc_id"]: r["text"] for r in rows(D.without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), length=200, words=51))}
    for i, (before, passage, after) in enumerate(parts):
        assert got[i] == (before + after if passage is long else texts[i])


def test_passages_have_bounds():
    for length in (31, 1024):
        with pytest.raises(ValueError):
            S.Passage(length)


def test_edge_rows(spark, rows):
    got = rows(D.repeat_report(clashing(documents(spark))))
    assert len(got) == 12
    nothing = hashlib.sha256(b"").hexdigest()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert (by[1]["n_bytes"], by[1]["kept_sha256"], by[2]["n_removed"]) == (0, nothing, 0)
    assert by[7]["n_removed"] == by[7]["n_bytes"] and by[7]["n_spans"] == 1     # one megabyte of one line repeated
    assert by[4]["n_removed"] == 0                                              # copies under 400 bytes stay
    assert D.repeat_report(documents(spark, [])).count() == 0


def test_cut_texts_keep_their_rows(spark, rows):
    a, b, c = ("".join(random.Random(i).choices("aäb c", k=700)) for i in (1, 2, 3))
    df = clashing(documents(spark, [(1, a + b, "x", None, 1), (2, c + b, None, "s", 2), (3, None, "x", "s", 3), (None, a[:100], "x", "s", 4)]))
    out = D.without_repeats(df)
    assert out.columns == df.columns
    got = {r["n_chars"]: r for r in rows(out)}
    assert got[3]["text"] is None and got[4]["text"] == a[:100] and got[2]["lang"] is None
    assert len(got[1]["text"]) < 710 and got[1]["text"].startswith(a[:690]) and got[2]["text"].startswith(c[:690])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.binary(min_size=40, max_size=40).map(lambda b: bytes(x % 2 for x in b)), min_size=1, max_size=30), st.integers(1, 4))
def test_deep_shallow_orders_like_sorting(strings, groups):
    strings = strings + strings[:2]
    rows = np.array([list(s[:8] * 9 + s[:20]) + [0] * 4 for s in strings], dtype=np.uint8)     # alike beyond the shallow depth
    group = np.sort(np.arange(len(rows)) % groups)
    order, common = S.deep_shallow(rows, group)
    key = lambda i: (group[i], rows[i].tobytes())
    assert [key(i) for i in order] == sorted(map(key, range(len(rows))))
    for k in range(1, len(order)):
        a, b = rows[order[k - 1]], rows[order[k]]
        want = -1 if group[order[k]] != group[order[k - 1]] else len(a) if (a == b).all() else int(np.argmax(a != b))
        assert common[k] == want


def test_blind_trie_orders_distinct_strings():
    pick = random.Random(9)
    strings = list({bytes(pick.choice(b"ab") for _ in range(12)) for _ in range(300)})
    order, shared = S.blind_trie(strings)
    assert [strings[i] for i in order] == sorted(strings)
    for k in range(1, len(order)):
        a, b = strings[order[k - 1]], strings[order[k]]
        assert shared[k] == next(i for i in range(12) if a[i] != b[i])


@pytest.mark.parametrize("length", [400, 200])
@pytest.mark.parametrize("piece", [S.PIECE, 500])
def test_anchors_stand_for_every_passage(monkeypatch, piece, length):
    passage = S.Passage(length)
    monkeypatch.setattr(S, "PIECE", piece)
    pick = random.Random(4)
    text = bytes(pick.choice(b"abcd") for _ in range(3000)) + b"a" * 900 + b"xyz" * 200
    pos, gram, left, right = S.anchors(text, passage)
    covered = {s for p, a, b in zip(pos, left, right, strict=True) for s in range(p - a, p + b - length + 1)}
    assert covered == set(range(len(text) - length + 1))
    shifted = S.anchors(b"0123456789" + text, passage)
    assert set(gram.tolist()) <= set(shifted[1].tolist())
    assert all(len(x) == 0 for x in S.anchors(b"a" * (length - 1), passage))
