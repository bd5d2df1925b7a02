"""URL verdicts: given rules first, then association rules that FP-growth learns from the urls those rules label."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, stored

# Verdict, host, path prefix.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
ALLOW, BLOCK = "allow", "block"
SUPPORT, LEAST, CONFIDENCE = 0.005, 5, 0.9       # of the labelled urls; urls at least; share of one verdict
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LABEL = "verdict="


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds host (after the first "://" up to "/", "?", "#" or the end, A-Z in lower case) and path (from there up to "?", "#" or the end); empty without "://"."""
    url = F.coalesce(F.col("url"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return pages.withColumn("host", host).withColumn("path", F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


def _rule(rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(size, rule, verdict) of the longest rule that fits host and path; null without one."""
    def fits(verdict: str, host: str, path: str) -> Column:
        inside = (F.col("host") == host) | F.col("host").endswith("." + host)
        known = F.struct(F.lit(len(host) + len(path)).alias("size"), F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))
        return F.when(inside & F.col("path").startswith(path), known)

    return F.array_max(F.array(*[fits(*r) for r in rules])) if rules else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def _tokens() -> Column:
    """What a url is made of, at most eight tokens: host, site (last two labels), last label, first label of more than two, first folder,
    first character of the last name, its ending, and the first key of the query or that there is a fragment."""
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    labels, names = F.split(host, "\\."), F.filter(F.split(path, "/"), lambda n: n != "")
    leaf = F.try_element_at(names, F.lit(-1))
    tail = F.regexp_extract(url, "[?]([^=&#]*)", 1)
    token = lambda kind, value: F.when(value != "", F.concat(F.lit(kind + "="), value))
    several = F.size(labels) > 2
    found = F.array(
        token("host", host), F.when(F.size(labels) > 1, token("site", F.array_join(F.slice(labels, -2, 2), "."))),
        token("top", F.try_element_at(labels, F.lit(-1))), F.when(several, token("sub", F.try_element_at(labels, F.lit(1)))),
        F.when(F.size(names) > 1, token("dir", F.try_element_at(names, F.lit(1)))), token("leaf", F.substring(leaf, 1, 1)),
        token("end", F.when(path.endswith("/"), F.lit("/")).otherwise(F.regexp_extract(leaf, "[.]([^.]*)$", 1))),
        F.coalesce(token("query", tail), F.when(F.instr(url, "#") > 0, F.lit("fragment"))))
    return F.sort_array(F.array_compact(found))


def association_rules(labelled: DataFrame, support: float = SUPPORT, least: int = LEAST, confidence: float = CONFIDENCE) -> DataFrame:
    """(tokens, lead, verdict, confidence, support) of the rules that say more than any shorter one.

    `labelled` has tokens (array) and verdict. Spark's FP-growth mines the token sets that at least a `support` part and `least`
    rows have, with the verdict as one more token. A set is a rule if `confidence` of its rows have the verdict and no part
    of it says the same with as much confidence. `lead` is a rule's rarest token. A row has at most eight tokens and its
    verdict, so there are fewer than 512 / support sets.
    """
    schema = "tokens array<string>, lead string, verdict string, confidence double, support bigint"
    labelled = stored(labelled.select(F.concat("tokens", F.array(F.concat(F.lit(_LABEL), "verdict"))).alias("items")), "labelled")
    rows = labelled.count()
    if not rows:
        return labelled.sparkSession.createDataFrame([], schema)
    mined = FPGrowth(itemsCol="items", minSupport=min(1.0, max(support, least / rows)), minConfidence=confidence).fit(labelled).freqItemsets
    sets = stored(mined.select(F.sort_array("items").alias("items"), "freq"), "itemsets")
    verdict = F.filter("items", lambda i: i.startswith(_LABEL))
    plain = sets.where(F.size(verdict) == 0).select(F.col("items").alias("tokens"), F.col("freq").alias("all"))
    said = sets.where(F.size(verdict) == 1).select(F.filter("items", lambda i: ~i.startswith(_LABEL)).alias("tokens"),
                                                   F.substring(verdict[0], len(_LABEL) + 1, 1 << 20).alias("verdict"), F.col("freq").alias("support"))
    sure = said.join(plain, "tokens").withColumn("confidence", F.col("support") / F.col("all")).where(F.col("confidence") >= confidence)
    sure = stored(sure.select("tokens", "verdict", "confidence", "support"), "rules")
    # All parts of a rule's tokens (fewer than 256): a part that says the same as surely makes the rule needless.
    masks = F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size("tokens")) - 2)
    part = lambda mask: F.filter("tokens", lambda t, i: F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1)) == 1)
    parts = sure.where(F.size("tokens") > 1).withColumn("mask", F.explode(masks)).select(part(F.col("mask")).alias("part"), "tokens", "verdict", "confidence")
    shorter = sure.select(F.col("tokens").alias("part"), "verdict", F.col("confidence").alias("known"))
    needless = parts.join(shorter, ["part", "verdict"]).where("known >= confidence").select("tokens", "verdict").distinct()
    left = sure.join(needless, ["tokens", "verdict"], "left_anti")
    freq = plain.where(F.size("tokens") == 1).select(F.col("tokens")[0].alias("lead"), "all")
    led = left.withColumn("lead", F.explode("tokens")).join(freq, "lead").groupBy("tokens", "verdict", "confidence", "support").agg(F.min(F.struct("all", "lead")).alias("least"))
    return led.select("tokens", F.col("least.lead").alias("lead"), "verdict", "confidence", "support")


def _matched(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, best): each token set with its best rule, by an index from a rule's rarest token."""
    index = rules.select("lead", F.col("tokens").alias("needed"), "verdict", "confidence", "support")
    met = sets.select("tokens", F.explode("tokens").alias("lead")).join(index, "lead").where(F.size(F.array_except("needed", "tokens")) == 0)
    # Sureness, then support, then shortness; what is still equal goes by the tokens, which say the same verdict or the later one.
    rank = F.struct("confidence", "support", (-F.size("needed")).alias("brevity"), "verdict", F.array_join("needed", " ").alias("pattern"))
    return met.groupBy("tokens").agg(F.max(rank).alias("best"))


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None, support: float = SUPPORT,
                 least: int = LEAST, confidence: float = CONFIDENCE) -> DataFrame:
    """Per row of `pages` (page_id, url): page_id, host, path, rule, verdict, pattern.

    The longest of `rules` (verdict, host, path) that fits decides: host and all its subdomains, paths that start with the path.
    Other urls go by the association rules learnt from `labelled` (url, verdict); without it, from the distinct urls that
    `rules` decide. The surest rule whose tokens the url has wins (then support, brevity, "block" before "allow"), and is shown as
    `pattern`; without one the url is allowed. Null urls and urls without "://" have an empty host and path and are allowed.

    Urls meet the rules as distinct token sets, so a host with a third of all rows is matched once; rules are found by an
    index on their rarest token.
    """
    judged = with_parts(columns_of(pages, "page_id", "url")).withColumn("given", _rule(rules))
    known = judged.where("given IS NOT NULL").select("page_id", "host", "path", F.col("given.rule").alias("rule"), F.col("given.verdict").alias("verdict"),
                                                     F.lit(None).cast("string").alias("pattern"))
    if labelled is None:
        labelled = judged.where("given IS NOT NULL").select("url", F.col("given.verdict").alias("verdict"))
    labelled = with_parts(columns_of(labelled, "url", "verdict").distinct().where("url IS NOT NULL AND verdict IS NOT NULL"))
    learnt = association_rules(labelled.select(_tokens().alias("tokens"), "verdict"), support, least, confidence)
    learnt = stored(learnt, "learnt")
    open_ = judged.where("given IS NULL").select("page_id", "host", "path", F.coalesce(_tokens(), F.array().cast("array<string>")).alias("tokens"))
    best = stored(_matched(open_.select("tokens").distinct(), learnt), "matched")
    rest = open_.join(best, "tokens", "left").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"),
                                                      F.coalesce("best.verdict", F.lit(ALLOW)).alias("verdict"), F.col("best.pattern").alias("pattern"))
    return known.union(rest)


def _twin() -> str:
    fits = " UNION ALL ".join(
        f"SELECT id, {len(h) + len(p)} AS size, '{h}{p}' AS rule, '{v}' AS verdict FROM p WHERE (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
        for v, h, p in RULES)
    token = lambda kind, value, when="true": f"CASE WHEN {when} AND {value} <> '' THEN '{kind}=' || {value} END"
    labels, names = "string_split(host, '.')", "list_filter(string_split(path, '/'), lambda x: x <> '')"
    leaf = f"({names})[-1]"
    tokens = ", ".join([
        token("host", "host"), token("site", f"array_to_string(({labels})[-2:], '.')", f"len({labels}) > 1"), token("top", f"({labels})[-1]"),
        token("sub", f"({labels})[1]", f"len({labels}) > 2"), token("dir", f"({names})[1]", f"len({names}) > 1"), token("leaf", f"left({leaf}, 1)"),
        token("end", f"CASE WHEN ends_with(path, '/') THEN '/' ELSE regexp_extract({leaf}, '[.]([^.]*)$', 1) END"),
        "coalesce(" + token("query", "regexp_extract(url, '[?]([^=&#]*)', 1)") + ", CASE WHEN contains(url, '#') THEN 'fragment' END)"])
    return f"""
WITH u AS (SELECT row_number() OVER () AS id, page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS MATERIALIZED (SELECT id, page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
k AS MATERIALIZED (SELECT id, arg_max(rule, size) AS rule, arg_max(verdict, size) AS verdict FROM ({fits}) GROUP BY 1),
t AS MATERIALIZED (SELECT p.*, k.rule, k.verdict, list_sort(list_filter([{tokens}], lambda x: x IS NOT NULL)) AS tokens FROM p LEFT JOIN k USING (id)),
l AS MATERIALIZED (SELECT DISTINCT url, verdict, tokens FROM t WHERE rule IS NOT NULL),
subsets AS (SELECT verdict, list_filter(tokens, lambda x, i: (m >> (i - 1)) & 1 = 1) AS s FROM (SELECT verdict, tokens, unnest(range(1, (1 << len(tokens))::bigint)) AS m FROM l)),
counted AS (SELECT s, verdict, count(*) AS n, sum(count(*)) OVER (PARTITION BY s) AS every FROM subsets GROUP BY s, verdict),
r AS MATERIALIZED (SELECT s, verdict, n / every AS confidence, n FROM counted
    WHERE n >= ceil(greatest({SUPPORT}::double, {LEAST}::double / (SELECT count(*) FROM l)) * (SELECT count(*) FROM l)) AND n / every >= {CONFIDENCE}),
o AS (SELECT id, list_filter(tokens, lambda x, i: (m >> (i - 1)) & 1 = 1) AS s
    FROM (SELECT id, tokens, unnest(range(1, (1 << len(tokens))::bigint)) AS m FROM t WHERE rule IS NULL)),
b AS (SELECT id, r.verdict, array_to_string(o.s, ' ') AS pattern FROM o JOIN r ON r.s = o.s
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY confidence DESC, n DESC, len(o.s), r.verdict DESC, array_to_string(o.s, ' ') DESC) = 1)
SELECT t.page_id, t.host, t.path, t.rule, coalesce(t.verdict, b.verdict, '{ALLOW}') AS verdict, b.pattern FROM t LEFT JOIN b USING (id)"""


ORACLE = _twin()
