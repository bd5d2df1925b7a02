import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import url_rules as U

SCHEMA = "page_id bigint, url string"


@pytest.mark.parametrize("url, host, path, rule, verdict", [
    ("http://ORG/", "org", "/", "org/", "allow"),
    ("https://a.Example.org/es/1?x=/y", "a.example.org", "/es/1", "example.org/es/", "block"),
    ("https://example.org/en/1", "example.org", "/en/1", "example.org/en/1", "block"),
    ("https://example.org/en/21", "example.org", "/en/21", "org/", "allow"),
    ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("http://example.org", "example.org", "", None, "allow"),
    ("http://example.org?a/b", "example.org", "", None, "allow"),
    ("http://example.org#/es/", "example.org", "", None, "allow"),
    ("x://b.com/de/?q", "b.com", "/de/", "com/de/", "block"),
    ("http://b.com/DE/", "b.com", "/DE/", None, "allow"),
    ("http://telecom/fr/", "telecom", "/fr/", None, "allow"),
    ("http://a://com/fr/", "a:", "//com/fr/", None, "allow"),
    ("com/fr/", "", "", None, "allow"), ("", "", "", None, "allow"), (None, "", "", None, "allow"),
    ("://", "", "", None, "allow"), ("http:///fr/", "", "/fr/", None, "allow"), ("ÄÖ://ÄÖ.Com/fr/x\ny", "ÄÖ.com", "/fr/x\ny", "com/fr/", "allow"),
])
def test_given_rules(spark, url, host, path, rule, verdict):
    (row,) = U.url_verdicts(spark.createDataFrame([(1, url)], SCHEMA)).collect()
    assert tuple(row)[:5] == (1, host, path, rule, verdict)


def brute_rules(labelled, support, least, confidence):
    """Every token set that is frequent and sure enough, and not made needless by a part of it."""
    need = max(support * len(labelled), least)
    count, every = Counter(), Counter()
    for tokens, verdict in labelled:
        for k in range(1, len(tokens) + 1):
            for part in combinations(sorted(tokens), k):
                count[part, verdict] += 1
                every[part] += 1
    sure = {(s, v): (n / every[s], n) for (s, v), n in count.items() if n >= need and n / every[s] >= confidence}
    parts = lambda s: [p for k in range(1, len(s)) for p in combinations(s, k)]
    return {key: value for key, value in sure.items() if not any(sure.get((p, key[1]), (0,))[0] >= value[0] for p in parts(key[0]))}


def labelled_rows(seed):
    pick = random.Random(seed)
    rows = []
    for _ in range(300):
        tokens = {f"t{pick.randint(0, 3)}", f"s{pick.randint(0, 4)}", f"u{pick.randint(0, 9)}", *pick.sample(["x", "y", "z"], pick.randint(0, 2))}
        bad = {"t1", "x"} <= tokens or "s3" in tokens or ("u5" in tokens and pick.random() < 0.95)
        rows.append((sorted(tokens), "block" if bad else "allow"))
    return rows + [(["hot", "x"], "block")] * 150 + [([], "allow")] * 5


@pytest.mark.parametrize("support, least, confidence", [(0.01, 1, 0.9), (0.001, 4, 0.97), (0.05, 1, 0.6)])
def test_rules_equal_brute_force(spark, support, least, confidence):
    rows = labelled_rows(least)
    df = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    got = {(tuple(r["tokens"]), r["verdict"]): (r["confidence"], r["support"]) for r in U.association_rules(df, support, least, confidence).collect()}
    assert got == brute_rules(rows, support, least, confidence) and got


def test_the_surest_rule_wins(spark):
    rows = labelled_rows(2)
    df = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    rules = U.association_rules(df, 0.01, 1, 0.7)
    known = [(set(r["tokens"]), r["confidence"], r["support"], r["verdict"], " ".join(r["tokens"])) for r in rules.collect()]
    sets = df.select("tokens").distinct()
    got = {tuple(r["tokens"]): r["best"] for r in U._matched(sets, rules).collect()}
    for (tokens,) in sets.collect():
        fits = [(c, n, -len(t), v, p) for t, c, n, v, p in known if t <= set(tokens)]
        assert (tuple(got[tuple(tokens)]) if fits else None) == (max(fits) if fits else None) and (bool(fits) == (tuple(tokens) in got))


def test_given_labels_and_learnt_verdicts(spark):
    spam = [(f"http://www.pills{i}.net/buy/{i}?id={i}", "block") for i in range(20)]
    fine = [(f"http://www.news{i}.net/read/{i}", "allow") for i in range(20)]
    pages = [(1, "https://shop.other.net/buy/77?id=1"), (2, "https://shop.other.net/read/77"), (3, "http://x.org/buy/1?id=2"), (4, None)]
    labelled = spark.createDataFrame(spam + fine + spam[:1] * 500, "url string, verdict string")
    got = {r["page_id"]: (r["verdict"], r["rule"], r["pattern"]) for r in U.url_verdicts(spark.createDataFrame(pages, SCHEMA), labelled=labelled).collect()}
    assert got[1][0] == "block" and got[1][2] in ("dir=buy", "query=id") and got[2] == ("allow", None, "dir=read")
    assert got[3] == ("allow", "org/", None) and got[4] == ("allow", None, None)


def test_odd_rows(spark):
    rows = [(None, None), (None, "http://a.com/de/1"), (1, "http://a.net/de/1"), (1, "http://a.net/de/1"), (2, "http://" + "a." * 50_000 + "net/" + "b/" * 50_000), (3, "a b://c d.net/ x")]
    rows += [(10 + i, f"http://h{i % 3}.com/de/{i}") for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    odd = df.select("*", *[F.lit("x").alias(c) for c in "host path rule verdict given tokens best lead items freq size url_ label id".split()])
    got = U.url_verdicts(odd)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "pattern"] and got.count() == len(rows)
    assert sorted((r["page_id"] or 0, r["host"][:6], r["verdict"]) for r in got.where("page_id IS NULL OR page_id < 10").collect()) == [
        (0, "", "allow"), (0, "a.com", "block"), (1, "a.net", "block"), (1, "a.net", "block"), (2, "a.a.a.", "allow"), (3, "c d.ne", "allow")]
    assert U.url_verdicts(df.limit(0)).count() == 0 and U.url_verdicts(df, rules=()).where("verdict = 'allow'").count() == len(rows)
