"""Pipeline stages on tables whose rows share a doc_id or have none."""

from pathlib import Path

import pytest

import corpus_pipeline as C
from pulsegrid.llm.common import table
from pulsegrid.llm.quality_classifier import quality_scores

from .cases import PROSE, clashing, documents

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not there")


def test_each_row_meets_its_own_quality(spark, rows):
    docs = table(spark, SF_DIR, "documents")
    scored = {r["doc_id"]: r["predicted"] for r in rows(quality_scores(docs, table(spark, SF_DIR, "labels")))}
    text = {r["doc_id"]: r["text"] for r in rows(docs.select("doc_id", "text"))}
    good, bad = [next(text[i] for i in sorted(text) if scored[i] == p) for p in (1, 0)]
    more = documents(spark, [(i, t, "en", "a", 1) for i in (None, -5) for t in (good, bad, None)]).select(docs.columns)
    out = clashing(C.keep_quality(spark, docs.unionByName(more), SF_DIR))
    got = sorted((r["doc_id"] or 0, r["text"]) for r in rows(out.where("doc_id IS NULL OR doc_id = -5")))
    assert got == [(-5, good), (0, good)]


def test_only_near_copies_go(spark, rows):
    other = " ".join(f"w{i}" for i in range(60))
    docs = clashing(documents(spark, [(i, t, "en", "a", 1) for i, t in [(4, PROSE), (5, PROSE), (5, other), (5, other), (5, None), (6, other + " end"), (7, "")]]))
    out = C.drop_near_copies(spark, docs, SF_DIR)
    assert out.columns == docs.columns
    texts = [r["text"] for r in rows(out)]
    assert sorted(t or "" for t in texts if t not in (other, other + " end")) == ["", "", PROSE]
    assert sum(t in (other, other + " end") for t in texts) == 1
