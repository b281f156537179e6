"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only).

Slot t of the schedule takes point (t + 1) * GOLDEN mod POINTS, a golden-ratio sequence in
whole numbers, through the cumulative targets of the sources. Slots are ranked per
source, and rank k of a source is the k-th equal block of words of that source's
shuffled, repeated stream of documents. What a source gives is what the first slots
deal it, up to ``most`` passes; the slots' order is the order of the mix, in which every
prefix has the target weights up to a few blocks.

Sums and ranks are taken in two levels (by range or bucket, then over these), so
no task sorts a whole source, nor all sources, however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

#: The golden section of POINTS, made odd: its multiples visit every point once.
POINTS, GOLDEN = 1 << 31, 1327217885
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
#: Most words of a block, slots that smaller mixes still have, slots a ranking chunk, least cells of the points.
BLOCK, SLOTS, RANKED, CELLS = 4096, 65_536, 8192, 4096


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; null counts 0."""
    squeezed = F.btrim(F.translate(text, "\t\n\u000b\f\r", "     "), F.lit(" "))
    return F.when(text.isNull() | (squeezed == ""), 0).otherwise(F.size(F.split(squeezed, " +"))).cast("long")


def running(df: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """Adds ``<name>_before`` for each of ``sums``: its sum over the rows ahead in a total order. Ranges of rows first, then their sums (one row a range)."""
    placed = stored(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    ranges = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    heads = placed.groupBy("range").agg(*[F.sum(c).alias(f"{c}_sum") for c in sums])
    heads = heads.select("range", *[F.coalesce(F.sum(f"{c}_sum").over(ranges), F.lit(0)).alias(f"{c}_head") for c in sums])
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(heads, "range").withColumns({f"{c}_before": F.col(f"{c}_head") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums})
    return out.drop("range", *[f"{c}_head" for c in sums])


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row a source (src, source_size, src_id by code point) with its target: weighted shares of ``share`` times all words, none over ``most`` times its source.

    Capping and resharing ends at one level L with target = min(most * size, L * weight).
    Sources with no words get 0.
    """
    w = F.array(*[F.lit(float(x)) for x in weights])
    ranked = running(sizes.withColumn("one", F.lit(1).cast("long")), [F.col("src").asc_nulls_last()], ["one"]).withColumnRenamed("one_before", "src_id")
    ranked = (
        ranked.withColumn("weight", F.element_at(w, (F.col("src_id") % len(weights) + 1).cast("int")))
        .withColumn("cap", (most * F.col("source_size")).cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    steps = stored(running(ranked, [F.col("ratio"), F.col("src_id")], ["cap", "weight"]))
    whole = steps.agg((share * F.sum("source_size").cast("double")).alias("total"), F.sum("weight").alias("weights"))
    levels = steps.crossJoin(F.broadcast(whole)).withColumn("level", (F.col("total") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before")))
    line = levels.agg(F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "src_id", "level")))["level"].alias("line"))  # one row
    return steps.crossJoin(F.broadcast(line)).select("src", "source_size", "src_id", F.when(F.col("line").isNull() | (F.col("cap") <= F.col("line") * F.col("weight")), F.col("cap")).otherwise(F.col("line") * F.col("weight")).alias("target"))


def schedule(arcs: DataFrame, total: int, slots: int, cells: int = CELLS) -> DataFrame:
    """(src_id, rank, slot) of the first ``slots`` slots; ``arcs`` has src_id, goal and goal_before (the goals of the sources ahead), of ``total`` words."""

    def point(words: Column) -> Column:
        return F.floor(words.cast("double") / float(max(total, 1)) * float(POINTS)).cast("long")

    width = max(1, POINTS // cells)
    arcs = arcs.where("goal > 0").select("src_id", point(F.col("goal_before")).alias("lo"), point(F.col("goal_before") + F.col("goal")).alias("hi")).where("lo < hi")
    arcs = arcs.withColumn("cell", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))))
    points = arcs.sparkSession.range(slots).select(F.col("id").alias("slot"), ((F.col("id") + 1) % POINTS * GOLDEN % POINTS).alias("x")).withColumn("cell", F.expr(f"x div {width}"))
    dealt = points.join(arcs, "cell").where("x >= lo and x < hi").select("slot", "src_id", F.expr(f"slot div {RANKED}").alias("part"))
    counts = dealt.groupBy("src_id", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("src_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("src_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("src_id", "part").orderBy("slot")
    return dealt.join(counts, ["src_id", "part"]).select("src_id", (F.col("before") + F.row_number().over(own) - 1).alias("rank"), "slot")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """How many words of each document the mix takes, and where in the mix it first stands.

    Returns one row a document: its id, size, source_size, target, taken, first_slot (null
    if nothing is taken; rows by first_slot are in the order of the mix), and epoch_0,
    epoch_1, ... (words taken in each of the ``most`` passes), and the columns ``extra`` of
    docs with source; these are shuffled, so texts are better joined after. Other columns,
    whatever their names, aren't read. ``block``: words a slot, by default BLOCK or fewer, so
    that a small mix has about SLOTS slots too. A source's taken words are off its target
    by a few blocks.

    The order within a source is that of md5 of doc_id and text, so reruns agree; rows that
    tie are the same. Null texts and texts without words have size 0 and take 0; null
    sources form one source, the last; repeated rows count each; an empty table gives no
    rows. ``share`` must not exceed ``most``.
    """
    if not 0 < share <= most:
        raise ValueError("share must be above 0 and at most the number of passes")
    words, ident = F.col(text_col).cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    slim = stored(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("src"), word_count(words).alias("size"),
        F.md5(F.concat(ident, F.lit(":"), F.md5(F.coalesce(words, F.lit("")).cast("binary"))).cast("binary")).alias("shuffled"), *extra,
    ))
    sums = targets(slim.groupBy("src").agg(F.sum("size").alias("source_size")), weights, share, most).withColumn("goal", F.floor("target").cast("long"))
    sums = stored(running(sums, [F.col("src_id")], ["goal", "source_size"]))
    sources, total = sums.agg(F.count("*"), F.coalesce(F.sum("goal"), F.lit(0)).cast("long")).first()
    block = block or max(1, min(BLOCK, total // SLOTS))
    plan = schedule(sums, total, -(-total // block), max(CELLS, 1 << int(sources).bit_length()))

    own = sums.select(F.col("src").alias("of"), "src_id", "source_size", "target", F.col("source_size_before").alias("base"))
    base = slim.join(own, F.col("src").eqNullSafe(F.col("of"))).drop("of").withColumnRenamed("src", "source")
    base = base.withColumn("bucket", F.substring("shuffled", 1, 4))
    keep = ["source", *extra] if extra else []
    heads = running(base.groupBy("src_id", "bucket").agg(F.sum("size").alias("n")), [F.col("src_id"), F.col("bucket")], ["n"])
    heads = heads.select("src_id", "bucket", F.col("n_before").alias("head"))
    inside = Window.partitionBy("src_id", "bucket").orderBy("shuffled", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = base.join(heads, ["src_id", "bucket"]).withColumn("at", F.col("head") - F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = stored(placed.select("doc_id", "src_id", "size", "source_size", "target", "at", *keep))

    passes = F.explode(F.array(*[F.struct(F.lit(e).alias("epoch"), (F.col("at") + e * F.col("source_size")).alias("lo")) for e in range(most)]))
    spans = placed.where("size > 0").select("src_id", "at", "size", passes.alias("e")).select("src_id", "at", "e.epoch", "e.lo", (F.col("e.lo") + F.col("size")).alias("hi"))
    parts = spans.withColumn("rank", F.explode(F.sequence(F.expr(f"lo div {block}"), F.expr(f"(hi - 1) div {block}"))))
    taken = (
        parts.join(plan, ["src_id", "rank"])
        .withColumn("words", F.least("hi", (F.col("rank") + 1) * block) - F.greatest("lo", F.col("rank") * block))
        .groupBy("src_id", "at")
        .agg(F.min("slot").alias("first_slot"), *[F.sum(F.when(F.col("epoch") == e, F.col("words"))).alias(f"epoch_{e}") for e in range(most)])
        .withColumn("some", F.lit(True))
    )
    full = placed.withColumn("some", F.col("size") > 0).join(taken, ["src_id", "at", "some"], "left")
    each = [F.coalesce(F.col(f"epoch_{e}"), F.lit(0)).cast("long").alias(f"epoch_{e}") for e in range(most)]
    return full.select("doc_id", "size", "source_size", "target", "first_slot", *keep, *each).withColumn("taken", sum((F.col(f"epoch_{e}") for e in range(1, most)), F.col("epoch_0")))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`mix` of all of documents with weights 5, 2, 1 and 150 % of all words, one row a row: doc_id, size, source_size, target, taken, first_slot."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS m,
                  CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM d GROUP BY source),
w AS (SELECT *, CASE rk % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, CAST(2 * source_size AS DOUBLE) AS cap FROM s),
l AS (SELECT *, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS total,
             sum(cap) OVER o - cap AS capped, sum(weight) OVER () - sum(weight) OVER o + weight AS wopen
      FROM w WINDOW o AS (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
v AS (SELECT *, (total - capped) / wopen AS level FROM l),
line AS (SELECT arg_min(level, cap / weight) AS line FROM v WHERE level <= cap / weight),
t AS (SELECT source, rk, source_size, CASE WHEN line IS NULL OR cap <= line * weight THEN cap ELSE line * weight END AS target FROM v CROSS JOIN line),
g AS (SELECT *, CAST(floor(target) AS BIGINT) AS goal, CAST(sum(CAST(floor(target) AS BIGINT)) OVER (ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto FROM t),
b AS (SELECT CAST(sum(goal) AS BIGINT) AS total, greatest(1, least(4096, CAST(sum(goal) AS BIGINT) // 65536)) AS block FROM g),
arcs AS (SELECT rk, floor(CAST(upto - goal AS DOUBLE) / CAST(total AS DOUBLE) * 2147483648.0::DOUBLE) AS lo, floor(CAST(upto AS DOUBLE) / CAST(total AS DOUBLE) * 2147483648.0::DOUBLE) AS hi FROM g CROSS JOIN b WHERE goal > 0),
slots AS (SELECT r.slot, (r.slot + 1) % 2147483648 * 1327217885 % 2147483648 AS x FROM b, unnest(range((total + block - 1) // block)) AS r(slot)),
plan AS (SELECT rk, slot, row_number() OVER (PARTITION BY rk ORDER BY slot) - 1 AS rank FROM slots JOIN arcs ON x >= lo AND x < hi),
n AS (SELECT rk, count(*) AS n FROM plan GROUP BY rk),
p AS (SELECT d.doc_id, d.size, g.rk, g.source_size, g.target, coalesce(n.n, 0) * block AS dealt, block,
             CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.m, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - d.size AS lo
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN n ON n.rk = g.rk CROSS JOIN b)
SELECT doc_id, size, source_size, target, plan.slot AS first_slot,
       CAST(greatest(0, least(lo + size, dealt) - lo) + greatest(0, least(lo + size + source_size, dealt) - lo - source_size) AS BIGINT) AS taken
FROM p LEFT JOIN plan ON plan.rk = p.rk AND plan.rank = p.lo // p.block AND p.size > 0
"""
