"""Mixing sources to target weights along a time-varying curriculum.

A source's weight is a piecewise-linear schedule over the training progress,
from 0 to 1.  Its integral decides the source's share of the words; its
cumulative integral, scaled to the source's target, is the number of words
that the training has asked of the source so far.  Inverting that demand at
the words that stand before a document gives the document's position, and a
range sort by position is the training order.

The words before a document are a prefix sum over its source in the order of
md5(doc_id).  A source with a third of all rows is no single window: the order
is cut into ``BUCKETS`` ranges of the digest, sums per (source, range) are
added up first, and each range has a window of its own.

Sources and their totals are one row each; the shares need one window over
that aggregated table.  Documents are joined to their (source, range) by an
equi-join whose hot partitions can be split, since a source is spread over its
ranges.

Special cases: a null text has no words; a document without words is never
placed (taken 0); a null source is a source of its own, after all others; a
null doc_id sorts before all others; rows that repeat a doc_id are documents
of their own, ordered by their size.  An empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of the digest that each source is cut into: three hexadecimal digits.
BUCKETS = 4096
#: Words of all documents that the mix takes in all, and the most that it takes of a source.
SHARE = 1.5
REPEATS = 2

Schedule = Callable[[Column], Column]


def word_count(text: Column) -> Column:
    """Runs of characters other than the six ASCII white-space ones; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def knots(*points: tuple[Column | float, Column | float]) -> Column:
    """A schedule's points: progress and weight there, in order of progress from 0 to 1."""
    return F.array(*[F.struct(F.lit(t).cast("double").alias("t"), F.lit(w).cast("double").alias("w")) for t, w in points])


def segments(points: Column) -> Column:
    """Pieces between points: start, weight there, slope, and the integral before and over the piece."""
    pieces = F.transform(
        F.sequence(F.lit(1), F.size(points) - 1),
        lambda i: F.struct(
            F.get(points, i - 1)["t"].alias("t"), F.get(points, i - 1)["w"].alias("w"),
            ((F.get(points, i)["w"] - F.get(points, i - 1)["w"]) / (F.get(points, i)["t"] - F.get(points, i - 1)["t"])).alias("slope"),
            ((F.get(points, i)["w"] + F.get(points, i - 1)["w"]) / 2 * (F.get(points, i)["t"] - F.get(points, i - 1)["t"])).alias("area"),
        ),
    )
    return pieces


def progress(pieces: Column, part: Column) -> Column:
    """The progress at which a schedule has reached ``part`` (0 to 1) of its integral."""
    whole = F.aggregate(pieces, F.lit(0.0), lambda a, p: a + p["area"])
    start = F.struct((part * whole).alias("left"), F.lit(None).cast("double").alias("at"))

    def step(acc, p):
        # Area w*x + slope*x*x/2 = left, solved for x without cancellation.
        x = 2 * acc["left"] / (p["w"] + F.sqrt(F.greatest(p["w"] * p["w"] + 2 * p["slope"] * acc["left"], F.lit(0.0))))
        here = F.when(acc["at"].isNull() & (acc["left"] <= p["area"]), p["t"] + F.when(acc["left"] <= 0, 0.0).otherwise(x))
        return F.struct((acc["left"] - p["area"]).alias("left"), F.coalesce(acc["at"], here).alias("at"))

    return F.least(F.coalesce(F.aggregate(pieces, start, step, lambda acc: acc["at"]), F.lit(1.0)), F.lit(1.0))


def cyclic_schedule(rank: Column) -> Column:
    """Mean weights 3, 1, 2 in turn by a source's rank from 0: rising to twice the mean, even, falling from twice the mean."""
    return F.when(rank % 3 == 0, knots((0, 0), (1, 6))).when(rank % 3 == 1, knots((0, 1), (1, 1))).otherwise(knots((0, 4), (1, 0)))


def source_targets(totals: DataFrame, schedule: Schedule, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """Adds rank, segments, weight and target to the source totals (no_source, name, source_size).

    A source's target stops at ``repeats`` times its size; the excess goes to the others by weight until none is
    above.  In the order of size over weight the sources that stop come first, so one pass over the running sums decides.
    """
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy("no_source", "name")) - 1)
    ranked = ranked.withColumn("pieces", segments(schedule(F.col("rank"))))
    ranked = ranked.withColumn("weight", F.aggregate("pieces", F.lit(0.0), lambda a, p: a + p["area"]))
    ranked = ranked.withColumn("most", F.col("source_size") * repeats)
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("most") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.select(
        "*", (F.sum("source_size").over(everything) * share).alias("budget"), F.sum("weight").over(everything).alias("weights"),
        F.coalesce(F.sum("most").over(before), F.lit(0)).alias("most_before"), F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("weight_before"),
    )
    ranked = ranked.withColumn("full", F.col("weight") * ((F.col("budget") - F.col("most_before")) / (F.col("weights") - F.col("weight_before"))) >= F.col("most"))
    taken = F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(everything), F.lit(0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.col("weight") * ((F.col("budget") - taken) / open_weight))
    return ranked.select("no_source", "name", "source_size", "rank", "weight", "pieces", target.alias("target"))


def place_documents(sized: DataFrame, schedule: Schedule, share: float = SHARE, repeats: int = REPEATS, order_by: str = "doc_id") -> DataFrame:
    """Adds source_size, target and ``copies`` to documents with ``source`` and ``size``.

    ``copies`` lists (copy, words, position) of every pass that the mix makes over the document, in order.
    The last copy of a source may take only the first ``words`` words of its document.  Columns of these names are replaced.
    """
    sized = sized.drop("source_size", "target", "copies")
    keyed = sized.withColumns({
        "__none": F.col("source").isNull(), "__name": F.coalesce("source", F.lit("")),
        "__digest": F.coalesce(F.md5(F.col(order_by).cast("string")), F.lit("")),
    }).withColumn("__bucket", F.coalesce(F.conv(F.substring("__digest", 1, 3), 16, 10).cast("int"), F.lit(0)))
    parts = keyed.groupBy("__none", "__name", "__bucket").agg(F.sum("size").alias("part"))
    totals = parts.groupBy(F.col("__none").alias("no_source"), F.col("__name").alias("name")).agg(F.sum("part").alias("source_size"))
    targets = source_targets(totals, schedule, share, repeats).withColumnsRenamed({"no_source": "__none", "name": "__name", "source_size": "__source_size", "target": "__target", "pieces": "__pieces"})
    before = Window.partitionBy("__none", "__name").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("__none", "__name", "__bucket", F.coalesce(F.sum("part").over(before), F.lit(0)).alias("__offset"))
    offsets = offsets.join(targets.select("__none", "__name", "__source_size", "__target", "__pieces"), ["__none", "__name"])
    inside = Window.partitionBy("__none", "__name", "__bucket").orderBy("__digest", order_by, "size").rowsBetween(Window.unboundedPreceding, -1)
    started = keyed.join(offsets, ["__none", "__name", "__bucket"]).withColumn("__start", F.col("__offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    goal = F.floor(F.col("__target") + 0.5)
    copies = F.transform(
        F.sequence(F.lit(0), F.lit(repeats - 1)),
        lambda k: F.struct(
            k.alias("copy"),
            F.greatest(F.lit(0), F.least(F.col("size"), goal - k * F.col("__source_size") - F.col("__start"))).cast("long").alias("words"),
        ),
    )
    copies = F.transform(
        F.filter(copies, lambda c: c["words"] > 0),
        lambda c: F.struct(
            c["copy"], c["words"],
            progress(F.col("__pieces"), (c["copy"] * F.col("__source_size") + F.col("__start") + c["words"] / 2) / goal).alias("position"),
        ),
    )
    return started.select(*[started[c] for c in sized.columns], F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), copies.alias("copies"))


def training_order(placed: DataFrame) -> DataFrame:
    """One row per copy, with copy, words and position, range-sorted by position."""
    rest = [c for c in placed.columns if c not in ("copies", "copy", "words", "position")]
    rows = placed.select(*rest, F.explode("copies").alias("__c")).select(*rest, "__c.*")
    return rows.orderBy("position", "doc_id", "copy")


def first_words(text: Column, words: Column) -> Column:
    """The text up to the end of its word number ``words``, without white space before the first one."""
    body = F.regexp_replace(text, "^[\\x20\\x09-\\x0D]+", "")
    parts = F.split(body, "[\\x20\\x09-\\x0D]+", (words + 1).cast("int"))
    rest = F.when(F.size(parts) > words, F.length(F.element_at(parts, -1))).otherwise(0)
    return F.regexp_replace(F.left(body, F.length(body) - rest), "[\\x20\\x09-\\x0D]+$", "")


def op4_curriculum_mix(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document, in the order of its first training position."""
    from escalade.llm.frames import read

    docs = read(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    placed = place_documents(docs, cyclic_schedule)
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    first = F.get("copies", F.lit(0))["position"]
    return placed.orderBy(first.asc_nulls_last(), "doc_id").select("doc_id", "size", "source_size", "target", taken.alias("taken"))


#: The same in SQL; positions only order the rows.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(doc_id::VARCHAR) AS digest FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, 2 * source_size AS most,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM totals),
summed AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget, sum(weight) OVER () AS weights,
         coalesce(sum(most) OVER w, 0)::DOUBLE AS most_before, coalesce(sum(weight) OVER w, 0)::DOUBLE AS weight_before
  FROM ranked WINDOW w AS (ORDER BY most::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stopped AS (SELECT *, weight * ((budget - most_before) / (weights - weight_before)) >= most AS stops FROM summed),
targets AS (
  SELECT source, source_size,
         CASE WHEN stops THEN most::DOUBLE
              ELSE weight * ((budget - coalesce(sum(CASE WHEN stops THEN most END) OVER (), 0)::DOUBLE) / sum(CASE WHEN NOT stops THEN weight END) OVER ()) END AS target
  FROM stopped),
started AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS goal,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.digest, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, goal - start)) + greatest(0, least(size, goal - source_size - start)))::BIGINT AS taken
FROM started
"""
