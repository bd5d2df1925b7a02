"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, stored, words

WEIGHTS = (3, 1, 2)       # of sources in code-point order, repeating
SHARE = 1.5               # words of the mix per word of the input
MOST = 2                  # no source or document is taken more often
BLOCK = 64                # words of a block
GOLDEN = 0.6180339887498949
CELLS = 1024              # cells of the unit interval in which slots look for their source
CHUNK = 1 << 16           # slots that are ranked together


def word_count() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def sizes(docs: DataFrame, *more: str) -> DataFrame:
    """Per row: doc_id, source, size in words, the hash that shuffles it, a row number without meaning, and the columns `more`."""
    return docs.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), word_count().alias("size"),
                       F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h"),
                       F.monotonically_increasing_id().alias("row"), *more)


def targets(sized: DataFrame) -> DataFrame:
    """Per source: k (its place by code point, null last), source, source_size, target.

    Targets share `SHARE` of all words by weight; one that reaches `MOST` times its source stops there, and what is left is
    shared by the others. In the order of size per weight those that stop come first, so running sums decide at once.
    The windows run over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(F.col("k"), F.lit(len(WEIGHTS))) + 1).cast("int"))
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_source = by_source.select((F.row_number().over(order) - 1).cast("int").alias("k"), "source", "source_size").withColumn("weight", weight)
    limit = MOST * F.col("source_size")
    fill = Window.orderBy(limit / F.col("weight"), "k")
    everything = Window.partitionBy(F.lit(0))
    shared = by_source.withColumns({
        "stop": limit.cast("double"), "all": SHARE * F.sum("source_size").over(everything),
        "stopped": F.coalesce(F.sum(limit).over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "rest": F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))})
    shared = shared.withColumn("full", (F.col("all") - F.col("stopped")) * F.col("weight") >= F.col("stop") * F.col("rest"))
    used = F.sum(F.when(F.col("full"), F.col("stop")).otherwise(0.0)).over(everything)
    open_ = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("full"), F.col("stop")).otherwise((F.col("all") - used) / F.nullif(open_, F.lit(0.0)) * F.col("weight"))
    return shared.select("k", "source", "source_size", target.alias("target"))


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with `place`, their number from 0 among those of their k by the hash `h` and then `order`: within parts, then over the sums of the parts."""
    rows = rows.withColumn("part", F.substring("h", 1, 3))
    sums = rows.groupBy("k", "part").agg(F.count("*").alias("n"))
    before = sums.select("k", "part", (F.sum("n").over(Window.partitionBy("k").orderBy("part")) - F.col("n")).alias("before"))
    here = F.row_number().over(Window.partitionBy("k", "part").orderBy("h", *order)) - 1
    return rows.withColumn("here", here).join(before.hint("merge"), ["k", "part"]).withColumn("place", F.col("before") + F.col("here")).drop("part", "here", "before")


def shuffled(plan: DataFrame, block: int) -> DataFrame:
    """(k, place, block): the blocks of each source in an order by hash. Sources are unfolded in chunks, so a large one is no single task."""
    last = F.ceil(F.col("source_size") / block).cast("bigint") - 1
    chunks = plan.where("target > 0 AND source_size > 0").select("k", last.alias("last")).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("last") / CHUNK))))
    low = F.col("chunk") * CHUNK
    blocks = chunks.repartition("k", "chunk").select("k", F.explode(F.sequence(low, F.least(low + (CHUNK - 1), F.col("last")))).alias("block"))
    name = F.concat_ws(":", F.col("k").cast("string"), F.col("block").cast("string"))
    return _numbered(blocks.withColumn("h", F.md5(name.cast("binary"))), "block").select("k", "place", "block")


def schedule(plan: DataFrame, total: float, block: int) -> DataFrame:
    """(slot, k, block): which block of which source comes at each place of the mix.

    Slot t falls on the point frac(t * golden ratio) of the cumulative weights. Such points spread evenly at every length, so each
    source comes in step with its weight. Slots of a source are ranked in two steps, within chunks and over chunk counts,
    and take the source's blocks in shuffled order, in turn, `MOST` rounds at most.
    """
    spark = plan.sparkSession
    upto = F.sum("target").over(Window.orderBy("k"))
    spans = plan.where("target > 0").select("k", F.ceil(F.col("source_size") / block).cast("bigint").alias("blocks"),
                                            ((upto - F.col("target")) / total).alias("low"), (upto / total).alias("high"))
    last = F.max("k").over(Window.partitionBy(F.lit(0)))
    spans = spans.withColumn("high", F.when(F.col("k") == last, F.lit(2.0)).otherwise(F.col("high")))
    cell = lambda x: F.least(F.floor(x * CELLS), F.lit(CELLS - 1)).cast("int")
    spans = spans.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))))
    turn = F.col("id") * F.lit(GOLDEN)
    slots = spark.range(round(total / block)).select(F.col("id").alias("slot"), (turn - F.floor(turn)).alias("point"))
    placed = slots.withColumn("cell", cell(F.col("point"))).join(spans, "cell").where("low <= point and point < high")
    placed = stored(placed.select("slot", "k", "blocks", F.floor(F.col("slot") / CHUNK).alias("chunk")), "slots")
    counts = placed.groupBy("k", "chunk").agg(F.count("*").alias("n"))
    before = counts.select("k", "chunk", (F.sum("n").over(Window.partitionBy("k").orderBy("chunk")) - F.col("n")).alias("before"))
    here = F.row_number().over(Window.partitionBy("k", "chunk").orderBy("slot")) - 1
    ranked = placed.withColumn("here", here).join(before, ["k", "chunk"]).withColumn("rank", F.col("before") + F.col("here"))
    turns = ranked.where(F.col("rank") < MOST * F.col("blocks")).select("slot", "k", (F.col("rank") % F.col("blocks")).alias("place"))
    # Blocks are as many as slots; what they unfold from is small, which is no reason to broadcast them.
    return turns.join(shuffled(plan, block).hint("merge"), ["k", "place"]).select("slot", "k", "block")


def lines(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Documents of each source in shuffled order on one line of words: adds k, source_size, target, start.

    Running sums go by the first digits of the shuffling hash, then over the sums of these parts.
    """
    part = F.substring("h", 1, 3)
    rows = sized.join(plan.withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own"))).drop("own").withColumn("part", part)
    sums = rows.groupBy("k", "part").agg(F.sum("size").alias("n"))
    before = sums.select("k", "part", (F.sum("n").over(Window.partitionBy("k").orderBy("part")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("k", "part").orderBy("h", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("size").over(inside)).join(before, ["k", "part"])
    return rows.withColumn("start", F.col("before") + F.col("upto") - F.col("size")).drop("part", "upto", "before")


def _taken(sized: DataFrame, block: int) -> DataFrame:
    """A row per document and block that has words of it: row, doc_id, source, size, source_size, target, first (word of the document), n (words),
    times and slot (how often and where first the mix takes the block). Empty documents have one row without words."""
    plan = stored(targets(sized), "targets")
    total = plan.agg(F.sum("target")).first()[0] or 0.0
    placed = lines(sized, plan)
    stop = F.col("start") + F.col("size")
    over = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(F.greatest(stop - 1, F.col("start")) / block))))
    low, high = F.greatest(F.col("start"), F.col("block") * block), F.least(stop, (F.col("block") + 1) * block)
    over = over.select("row", "doc_id", "source", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), "k", "block",
                       (low - F.col("start")).alias("first"), (high - low).alias("n"))
    if not total:
        return over.withColumns({"times": F.lit(0).cast("bigint"), "slot": F.lit(None).cast("bigint")})
    times = schedule(plan, total, block).groupBy("k", "block").agg(F.count("*").alias("times"), F.min("slot").alias("slot"))
    return over.join(times, ["k", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))


def mixture(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per row of `docs`: doc_id, size, source_size, target, taken, first_slot.

    Sizes are words; null and empty texts have none. Sources follow by code point, null last, as a source of its own.
    A document's `taken` counts repeats and is at most twice its size; `first_slot` is the place in the mix of the first
    block with words of it, null without one. Equal rows may share their words unequally.
    """
    sized = stored(sizes(columns_of(docs, "doc_id", "source", "text")), "sizes")
    slot = F.min(F.when((F.col("n") > 0) & (F.col("times") > 0), F.col("slot")))
    found = _taken(sized, block).groupBy("row", "doc_id", "size", "source_size", "target").agg(
        F.sum(F.col("times") * F.col("n")).cast("bigint").alias("taken"), slot.alias("first_slot"))
    return found.drop("row")


def mixed_blocks(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix as a stream of blocks: slot, place, source, doc_id, words; ordered by slot and place it is the interleaved text.

    A slot has a row per document that its block has words of; `place` is where in the block they start. Empty texts have none.
    """
    columns = columns_of(docs, "doc_id", "source", "text")
    sized = sizes(columns.withColumn("text", F.coalesce(F.col("text"), F.lit(""))), "text")
    sized = stored(sized, "sized-texts")
    plan = stored(targets(sized), "targets")
    total = plan.agg(F.sum("target")).first()[0] or 0.0
    names = ["slot", "place", "source", "doc_id", "words"]
    if not total:
        return docs.sparkSession.createDataFrame([], "slot bigint, place bigint, source string, doc_id bigint, words array<string>")
    placed = lines(sized.drop("text"), plan).where("size > 0").select("row", "doc_id", "source", "size", "k", "start")
    stop = F.col("start") + F.col("size")
    over = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((stop - 1) / block))))
    low, high = F.greatest(F.col("start"), F.col("block") * block), F.least(stop, (F.col("block") + 1) * block)
    over = over.select("row", "doc_id", "source", "k", "block", (low - F.col("block") * block).alias("place"),
                       (low - F.col("start") + 1).cast("int").alias("first"), (high - low).cast("int").alias("n"))
    # The words are cut once per document and block, whatever the number of slots that take the block.
    parts = over.groupBy("row").agg(F.collect_list(F.struct("block", "place", "first", "n", "k", "doc_id", "source")).alias("parts"))
    cut = sized.select("row", words(F.col("text")).alias("all")).join(parts, "row")
    cut = cut.select("all", F.explode("parts").alias("p")).select("p.*", F.slice("all", F.col("p.first"), F.col("p.n")).alias("words"))
    return schedule(plan, total, block).select("slot", "k", "block").join(cut, ["k", "block"]).select(*names)


def _passages(text: Column, parts: Column) -> Column:
    """The words that `parts` name (first, n), with the white space that follows each in the text."""
    runs = F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*"), F.lit(0))
    return F.array_join(F.flatten(F.transform(parts, lambda p: F.slice(runs, p["first"].cast("int") + 1, p["n"].cast("int")))), "")


def mixed_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of the mix, with the columns of `docs`: a document comes once per round that takes words of it.

    Its text then has the words of the blocks that the round takes, in order, with the white space between them as it stands; a
    document that is taken whole is as it was.
    """
    columns = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    sized = stored(sizes(columns, "d"), "sized-documents")
    part = F.struct("first", "n", "times")
    takes = _taken(sized.drop("d"), block).where("n > 0 AND times > 0").groupBy("row").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    rows = sized.select("row", "d", "size").join(takes, "row").withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(MOST))))
    rows = rows.withColumn("parts", F.filter("parts", lambda p: p["times"] >= F.col("round"))).where(F.size("parts") > 0)
    words = F.aggregate("parts", F.lit(0).cast("bigint"), lambda total, p: total + p["n"])
    text = F.when(words >= F.col("size"), F.col("d.text")).otherwise(_passages(F.col("d.text"), F.col("parts")))
    return rows.select(F.col("d").withField("text", text).alias("d")).select("d.*")


ORACLE = f"""
WITH s AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0)::bigint AS size,
                  md5(coalesce(doc_id::varchar, '')) AS h FROM documents),
b AS (SELECT source, sum(size)::bigint AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1)::int AS k FROM s GROUP BY source),
w AS (SELECT *, CASE k % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::double AS weight, (2 * source_size)::double AS stop FROM b),
f AS (SELECT *, {SHARE}::double * sum(source_size) OVER () AS total,
             coalesce(sum(stop) OVER (ORDER BY stop / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
             sum(weight) OVER (ORDER BY stop / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
g AS (SELECT *, (total - stopped) * weight >= stop * rest AS is_full FROM f),
t AS (SELECT k, source, source_size, CASE WHEN is_full THEN stop ELSE (total - sum(CASE WHEN is_full THEN stop ELSE 0 END) OVER ())
             / nullif(sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER (), 0) * weight END AS target FROM g),
a AS (SELECT sum(target ORDER BY k) AS words FROM t),
i AS (SELECT k, ceil(source_size / {BLOCK})::bigint AS blocks, (sum(target) OVER (ORDER BY k) - target) / words AS low,
             CASE WHEN k = max(k) OVER () THEN 2.0 ELSE sum(target) OVER (ORDER BY k) / words END AS high FROM t, a WHERE target > 0),
p AS (SELECT range AS slot, range * {GOLDEN}::double - floor(range * {GOLDEN}::double) AS point
      FROM range((SELECT coalesce(round_even(words / {BLOCK}, 0), 0)::bigint FROM a))),
q AS (SELECT slot, k, blocks, row_number() OVER (PARTITION BY k ORDER BY slot) - 1 AS rank FROM p JOIN i ON low <= point AND point < high),
z AS (SELECT k, unnest(range(blocks)) AS block FROM i),
y AS (SELECT k, block, row_number() OVER (PARTITION BY k ORDER BY md5(k || ':' || block), block) - 1 AS place FROM z),
n AS (SELECT q.k, y.block, count(*) AS times, min(slot) AS slot FROM q JOIN y ON y.k = q.k AND y.place = q.rank % q.blocks WHERE rank < 2 * blocks GROUP BY ALL),
l AS (SELECT s.*, t.k, t.source_size, t.target, sum(size) OVER (PARTITION BY k ORDER BY h, doc_id, size, r) - size AS start
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
x AS (SELECT r, doc_id, size, source_size, target, k, start, unnest(range((start // {BLOCK})::bigint, (greatest(start + size - 1, start) // {BLOCK})::bigint + 1)) AS block FROM l)
SELECT doc_id, size, source_size, target, coalesce(sum(times * (least(start + size, (block + 1) * {BLOCK}) - greatest(start, block * {BLOCK}))), 0)::bigint AS taken,
    min(slot) FILTER (WHERE size > 0) AS first_slot
FROM x LEFT JOIN n USING (k, block) GROUP BY r, doc_id, size, source_size, target"""
