import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import quality_classifier as C
from pulsegrid.llm import quality_rules as R

from .cases import DOCS, PROSE, clashing, documents

LABELS = "doc_id bigint, quality int, toxic int"


def text(good, seed):
    pick = random.Random(seed)
    words = [pick.choice(PROSE.split()) for _ in range(pick.randint(30, 200))]
    if good:
        return ". ".join(" ".join(words[i:i + 9]) for i in range(0, len(words), 9)) + "."
    return pick.choice([" ".join(w + "***" for w in words), " ".join([words[0]] * len(words)), "!! ".join(w.upper() for w in words)])


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.createDataFrame([(i, text(i % 4 > 0, i), "en", "s", 1) for i in range(400)], DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 400)], LABELS)
    return docs, labels


def test_classifier_on_held_out_rows(rows, labelled):
    got = rows(C.quality_scores(*labelled))
    held = [r for r in got if r["held_out"]]
    assert len(got) == 400 and len(held) > 60
    assert all(r["predicted"] == int(r["doc_id"] % 4 > 0) for r in held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)


def test_classifier_learns_nothing_from_held_out_or_contradictory_labels(spark, rows, labelled):
    docs, labels = labelled
    from pulsegrid.llm.common import held_out
    wrong = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    wrong = wrong.union(labels.where(~held_out() & (F.col("doc_id") < 20)).withColumn("quality", 1 - F.col("quality")))
    fewer = labels.where(F.col("doc_id") >= 20)
    one, other = (rows(C.quality_scores(docs, x).orderBy("doc_id")) for x in (wrong, fewer))
    assert np.allclose([r["score"] for r in one], [r["score"] for r in other], atol=1e-9)


def test_factors_invert_the_shrunken_covariances():
    random_ = np.random.default_rng(3)
    x = [random_.normal(size=(40, 3)) @ np.diag([1, 5, 0.1]), random_.normal(size=(7, 3)) + 2]
    model = C.fit(np.array([40.0, 7.0]), np.stack([a.sum(axis=0) for a in x]), np.stack([a.T @ a for a in x]))
    at = random_.normal(size=(5, 3))
    density = []
    for k in range(2):
        cov = np.linalg.inv(model.factors[k].T @ model.factors[k])
        off = at / model.scale - model.means[k]
        density.append(np.log((40, 7)[k] / 47) - 0.5 * np.log(np.linalg.det(cov)) - 0.5 * np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off))
    assert np.allclose(model.score(at), 1 / (1 + np.exp(density[0] - density[1])))


def test_classifier_edge_rows(spark, rows):
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, None), (None, 0, 0), (6, None, None), (77, 0, 0)], LABELS)
    got = rows(C.quality_scores(clashing(documents(spark)), clashing(labels)))
    assert len(got) == 12
    by = {r["doc_id"]: r["score"] for r in got if r["doc_id"] is not None}
    assert by[1] == by[2] == by[3] == 0.0 and by[7] == by[4] == 1.0          # one class only
    none = rows(C.quality_scores(documents(spark), spark.createDataFrame([], LABELS)))
    assert {r["score"] for r in none} == {0.0, 0.5}
    assert C.quality_scores(documents(spark, []), labels).count() == 0


def measures(text):
    """The base measures by definition."""
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    grams = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_rules_measure_by_definition(spark, rows):
    pick = random.Random(8)
    texts = ["", None, "a b\x0bc \x85d", "x " * 9, "x " * 8, "a # <b>\n\na # <b>\n \n"] + [
        " ".join(pick.choices("ab", k=pick.randint(5, 60))).replace("a b", "a\nb") for _ in range(40)] + [
        " ".join((words := [f"w{i}" for i in range(12)])) + " y " + " ".join(words[2:11]), "é\U0001f600 " * 30]
    got = {r["doc_id"]: r for r in rows(R.quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")))}
    for i, t in enumerate(texts):
        want = measures(t)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, (i, t)
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r["base_failed"] and r["kept"])


def test_verdicts_do_not_depend_on_the_order(spark, rows):
    texts = [PROSE, PROSE.upper(), PROSE.replace(" ", "*** "), "\n".join([PROSE[:60], PROSE[60:120], PROSE[:60]]), " ".join("%d" % i for i in range(50)),
             "\n".join(f"{w} {w}x ..." for w in PROSE.split()), " ".join("ab" for _ in range(3)) + " " + PROSE]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rules = R.standard_rules()
    verdicts = [[r["kept"] for r in rows(R.base_measures(df).withColumn("kept", R.cascade(order)).orderBy("doc_id"))] for order in (rules, rules[::-1])]
    assert verdicts[0] == verdicts[1] == [True, False, False, False, False, False, True]


def test_order_follows_rejections_per_cost(spark):
    rows = R.base_measures(spark.createDataFrame([(i, PROSE + f" {i}" + " #" * (i % 10)) for i in range(200)], "doc_id bigint, text string")).cache()
    never, often = R.Rule("never", F.col("n_words") < 0), R.Rule("often", F.col("n_symbols") > 1)
    found = R.estimate(rows, [never, often])
    assert [e.rule.name for e in found] == ["often", "never"] and found[0].share == 0.8 and all(e.seconds > 0 for e in found)


def test_rules_edge_rows(spark, rows):
    got = rows(R.quality_rules(clashing(documents(spark))))
    assert len(got) == 12
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert all((by[i]["n_words"], by[i]["base_failed"], by[i]["kept"]) == (0, True, False) for i in (1, 2, 3))
    assert by[7]["n_words"] == 200_000 == by[7]["n_repeat_words"] and by[4]["kept"]
    assert R.quality_rules(documents(spark, [])).count() == 0


def test_sample_sees_every_source(spark, tmp_path):
    """Stored by source, in a file each: the first files alone would fill the sample."""
    from pulsegrid.llm import quality_rules
    df = spark.range(40_000, numPartitions=8).selectExpr("id AS doc_id", "concat('text of source ', floor(id / 5000)) AS text")
    df.write.parquet(f"{tmp_path}/docs")
    got = quality_rules.sample_rows(spark.read.parquet(f"{tmp_path}/docs")).collect()
    assert len(got) == quality_rules.SAMPLE and len({r["text"] for r in got}) == 8
    assert len(quality_rules.sample_rows(df.limit(30)).collect()) == 30 and quality_rules.sample_rows(df.limit(0)).count() == 0


def plain_statistics(text):
    """The transformed statistics of a text by definition."""
    blank = " \t\n\x0b\x0c\r"
    data = text.encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    sizes = [len(w) for w in words]
    mean = sum(sizes) / len(sizes)
    spread = math.sqrt(sum((x - mean) ** 2 for x in sizes) / len(sizes))
    count = lambda chars: sum(text.count(c) for c in chars)
    upper = sum("A" <= c <= "Z" for c in text)
    letters = sum("A" <= c <= "Z" or "a" <= c <= "z" for c in text) + sum(0xC2 <= b < 0xF5 for b in data)
    ends = sum(c in ".,;:!?" and (i + 1 == len(text) or text[i + 1] in blank) for i, c in enumerate(text))
    shares = [sum(x <= 3 for x in sizes) / len(words), len(set(words)) / len(words), sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words),
              len(set(lines)) / len(lines), upper / max(letters, 1), count("0123456789") / len(data), count(".,;:") / len(words), count("!?") / len(words),
              count("|/\\_") / len(words), count("#*$%&<>@^~=+{}[]") / len(words), ends / len(words)]
    return [math.log(mean), math.log(1 + spread), *[math.log(0.01 + x) for x in shares]], len(words)


def test_classifier_equals_a_plain_version(spark, rows):
    """Means, shrunken covariances, and log densities from determinants and solved systems, without any factor."""
    pick = random.Random(21)
    good = lambda: " ".join(pick.choices(PROSE.split(), k=pick.randint(5, 120))) + pick.choice([".", "!", "", " é"])
    bad = lambda: " ".join(pick.choice(["###", "BUY", "now!!", "77", "|", "x"]) + pick.choice(["", "%", "\n"]) for _ in range(pick.randint(3, 80)))
    texts = {i: (good() if pick.random() < 0.85 else bad()) if i % 3 else (bad() if pick.random() < 0.9 else good()) for i in range(300)} | {900: "", 901: None}
    labels = {i: int(i % 3 != 0) for i in range(300) if i % 5}
    got = rows(C.quality_scores(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3),
                                spark.createDataFrame([(i, y, 0) for i, y in labels.items()], LABELS)))
    raw = {i: plain_statistics(t) for i, t in texts.items() if t and t.split()}
    average = np.mean([s for s, _ in raw.values()], axis=0)
    x = {i: average + (np.array(s) - average) * n / (n + C.STEADY) for i, (s, n) in raw.items()}
    learn = [(x[i], y) for i, y in labels.items() if zlib.crc32(str(i).encode()) % 4 != 2 and i in x]
    own = [np.array([v for v, y in learn if y == k]) for k in (0, 1)]
    within = [(v - v.mean(axis=0)).T @ (v - v.mean(axis=0)) for v in own]
    d, everything = len(average), sum(map(len, own))
    scale = np.sqrt(np.maximum(np.diag(within[0] + within[1]) / everything, 1e-6))
    pooled = (within[0] + within[1]) / everything / np.outer(scale, scale)

    def density(v, k):
        n = len(own[k])
        part = max(0.05, d / (d + n))
        cov = (1 - part) * within[k] / n / np.outer(scale, scale) + part * pooled
        cov = 0.99 * cov + 0.01 * max(np.trace(cov) / d, 1e-3) * np.eye(d)
        off = (v - own[k].mean(axis=0)) / scale
        return math.log(n / everything) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * off @ np.linalg.solve(cov, off)

    for r in got:
        want = 0.0 if r["doc_id"] not in x else 1 / (1 + math.exp(min(500, max(-500, density(x[r["doc_id"]], 0) - density(x[r["doc_id"]], 1)))))
        assert abs(r["score"] - want) < 1e-6 and r["predicted"] == int(r["score"] >= 0.7), r["doc_id"]
    assert 50 < sum(r["predicted"] for r in got) < 250
