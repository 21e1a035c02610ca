"""Line dedup by winnowing over line hashes, in DataFrame functions alone.

The content lines of a document (those that are not blank) form a sequence of
64-bit line hashes.  Among any ``window`` consecutive lines the one with the
least hash (the first of equal ones) is the window's fingerprint, so two equal runs
of ``window`` lines always share a fingerprint: runs of that length cannot be missed.

1. Each document selects its fingerprints inside its own row.  Only these are
   written out: place, hash, the neighbouring line hashes that a window around
   it can reach, and the windows that it stands for.
2. Fingerprints that occur once in the corpus are dropped: nothing repeats there.
   The positions of the others are joined by their hash.
3. Each position is extended both ways, over its neighbours, to the windows that it
   is the least line of.  The first occurrence of an extension (by doc_id, then
   place) stays, every later one is a match.  Matches of neighbouring windows
   overlap, so that a match grows until the lines differ; the union of a
   document's later matches is what it loses.

A line of ``long_words`` words or more is a run of its own, since a whole
passage may stand on one line.

Only hashes and places are shuffled before the final join.  Minima and counts
per hash combine map-side and are written; a hash of very many positions is joined
by ``join_counted``, and no pair of occurrences is ever formed.

Results in special cases: a null text stays null and counts as no lines; blank
lines are kept and do not interrupt a run; rows that repeat doc_id and text are
one document and get the same result; of different texts under one doc_id the
text's hash decides which comes first; a null doc_id comes before all others.
Lines are compared as they stand, except for the hash; two equal windows need
equal 64-bit hashes of all their lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from escalade.llm.frames import join_counted, read, settle

#: Guaranteed length of a repeated run, in lines.
WINDOW = 2
#: A line with so many words is a run by itself.
LONG_WORDS = 50


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def content_lines(text: Column) -> Column:
    """Place in the text, hash and length of each line that is not blank."""
    every = F.transform(
        F.split(text, "\n", -1),
        lambda x, i: F.struct(i.alias("i"), F.xxhash64(x).alias("h"), F.trim(x) == "", F.regexp_count(x, F.lit("[^ \\t]+")).alias("words")),
    )
    return F.filter(every, lambda x: ~x["col3"])


def fingerprints_of(lines: Column, window: int, long_words: int) -> Column:
    """The least line of every window, once, and every long line: its place and hash, the hashes around it from place
    ``first`` on, and the runs (start, lines) that it stands for."""
    def least(hashes):
        def of(i):
            part = F.slice(hashes, i + 1, window)
            return (i + F.array_position(part, F.array_min(part)) - 1).cast("int")

        return F.when(F.size(hashes) >= window, F.transform(F.sequence(F.lit(0), F.size(hashes) - window), of)).otherwise(F.array().cast("array<int>"))

    def one(hashes, places, at):
        first, last = F.greatest(at - window + 1, F.lit(0)), F.least(at, F.size(hashes) - window)
        starts = F.filter(F.sequence(first, last), lambda i: F.get(places, i) == at)
        return F.struct(
            at.alias("at"), F.get(hashes, at).alias("h"), F.slice(hashes, first + 1, 2 * window - 1).alias("around"), first.alias("first"),
            F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(window).alias("lines"))).alias("runs"),
        )

    def selected(hashes):
        return bound(least(hashes), lambda places: F.transform(F.array_distinct(places), lambda at: one(hashes, places, at)))

    singles = F.transform(F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), x["h"].alias("h"), x["words"].alias("words"))), lambda x: x["words"] >= long_words),
                          lambda x: F.struct(x["at"].alias("at"), x["h"].alias("h"), F.array(x["h"]).alias("around"), x["at"].alias("first"),
                                             F.array(F.struct(x["at"].alias("start"), F.lit(1).alias("lines"))).alias("runs")))
    return F.concat(bound(F.transform(lines, lambda x: x["h"]), selected), singles)


def repeated_lines(docs: DataFrame, window: int = WINDOW, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc_id, version, removed): places of the content lines that stand in a later copy of a run.

    ``version`` is the 64-bit hash of the text; documents without such lines are absent.
    """
    seen = docs.where("text is not null").select(
        "doc_id", F.xxhash64("text").alias("version"), bound(content_lines(F.col("text")), lambda x: fingerprints_of(x, window, long_words)).alias("prints")
    )
    prints = seen.select("doc_id", "version", F.explode("prints").alias("p")).select("doc_id", "version", "p.*")
    # Read several times below; a row is a few numbers, while making it means scanning the text.
    prints = settle(prints, "line-fingerprints")
    place = F.struct("doc_id", "version", "at")
    shared = prints.groupBy("h").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count("*").alias("n"))
    shared = settle(shared.where("low <> high").select("h", "n"), "shared-lines")
    met = join_counted(prints, shared, "h").select("doc_id", "version", "h", "around", "first", F.explode("runs").alias("r"))
    extended = met.select("doc_id", "version", "h", F.col("r.start").alias("at"), F.col("r.lines").alias("lines"),
                          F.xxhash64(F.slice("around", F.col("r.start") - F.col("first") + 1, F.col("r.lines"))).alias("run"))
    extended = settle(extended, "extended-lines")
    first = extended.groupBy("h", "run").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"))
    first = settle(first.where("first <> last").select("h", "run", "first", "n"), "first-runs")
    later = join_counted(extended, first, ["h", "run"]).where(place > F.col("first"))
    spans = later.groupBy("doc_id", "version").agg(F.collect_set(F.struct("at", "lines")).alias("spans"))
    covered = F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["lines"] - 1)))
    return spans.select("doc_id", "version", F.array_distinct(covered).alias("removed"))


def dedup_lines(docs: DataFrame, window: int = WINDOW, long_words: int = LONG_WORDS) -> DataFrame:
    """The documents without the later copies of repeated runs of lines.

    Adds ``n_lines`` and ``n_removed`` (content lines); ``text`` is what is left, joined by newlines.  Columns of these names are replaced.
    """
    docs = docs.drop("n_lines", "n_removed")
    removed = repeated_lines(docs, window, long_words).withColumnsRenamed({"doc_id": "__id", "version": "__version", "removed": "__removed"})
    same = docs["doc_id"].eqNullSafe(removed["__id"]) & (F.xxhash64(docs["text"]) == removed["__version"])
    joined = docs.join(removed, same, "left")

    def rest(lines):
        # Places among the content lines become places in the text; array_except is linear and keeps the order.
        places = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.trim(F.get(lines, i)) != "")
        gone = bound(places, lambda at: F.transform("__removed", lambda k: F.get(at, k)))
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")

    left = F.when(F.col("__removed").isNull(), docs["text"]).otherwise(bound(F.split(docs["text"], "\n", -1), rest))
    n_lines = F.size(F.filter(F.split(docs["text"], "\n", -1), lambda x: F.trim(x) != ""))
    return joined.select(
        *[left.alias("text") if c == "text" else docs[c] for c in docs.columns],
        F.when(docs["text"].isNull(), 0).otherwise(n_lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("__removed"), F.lit(0)).cast("long").alias("n_removed"),
    )


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, text: all documents after line dedup."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


#: The same in SQL, on the texts of the windows instead of their hashes (window of 2 lines, long lines of 50 words).
SQL = r"""
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
raw AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM split),
content AS (
  SELECT doc_id, line, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place,
         lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS following,
         len(regexp_extract_all(line, '[^ \t]+')) AS words
  FROM raw WHERE trim(line) <> ''),
windows AS (
  SELECT doc_id, place, 2 AS lines, line || chr(10) || following AS content FROM content WHERE following IS NOT NULL
  UNION ALL SELECT doc_id, place, 1, line FROM content WHERE words >= 50),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lines, content ORDER BY doc_id, place) AS k FROM windows),
gone AS (
  SELECT DISTINCT doc_id, place FROM (
    SELECT doc_id, place FROM ranked WHERE k > 1 UNION ALL SELECT doc_id, place + 1 FROM ranked WHERE k > 1 AND lines = 2)),
kept AS (
  SELECT r.doc_id, string_agg(r.line, chr(10) ORDER BY r.i) AS text
  FROM raw r LEFT JOIN content c ON c.doc_id = r.doc_id AND c.i = r.i LEFT JOIN gone g ON g.doc_id = c.doc_id AND g.place = c.place
  WHERE g.place IS NULL GROUP BY r.doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM content GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT s.doc_id, coalesce(c.n, 0)::BIGINT AS n_lines, coalesce(l.n, 0)::BIGINT AS n_removed,
       CASE WHEN s.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM split s LEFT JOIN counts c USING (doc_id) LEFT JOIN lost l USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
