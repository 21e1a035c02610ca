"""Benchmark decontamination in DataFrame functions alone.

The words of a text are its runs of ASCII letters (in lower case), digits and
non-ASCII characters.  An item's windows are its runs of ``size`` words; an
item with fewer words, but one at least, is one window.

1. The distinct windows of the benchmark are a table of hash, text and the list
   of items that have them; equal lists are stored once.
2. Every window of a document is hashed and looked up in that table, which is
   broadcast as a hash set while it has at most ``MAX_WINDOWS`` rows (counted
   first).  The words stand in the same row, so a hit is verified at once by the
   text of its window, and nothing but hits and one row per document is
   shuffled.  A larger benchmark is joined by hash instead: (document, place,
   hash) travels, and hits go back to their documents to be verified.
3. A document's hits are counted as words covered.  Documents with the same item
   lists share one digest of their items, so that a passage of many items in
   many documents is written out once.

``decontaminate`` removes the words hit, or the documents that have any.

Special cases: a null or empty text has no words and stays as it is; rows that
repeat doc_id and text are one document here and get the same result each;
texts under one doc_id, or under none, are told apart by their hash; rows under
one item_id are one item, a null item_id is an item spelled as the empty text;
items without words have no windows; without a benchmark nothing is hit.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from escalade.llm.frames import join_counted, read, settle
from escalade.llm.line_dedup import bound

SIZE = 10
#: Rows of the window table that may be broadcast: some 150 MB as a hash set.
MAX_WINDOWS = 1 << 20
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words with the characters between them as pieces of their own; the class of a piece is that of its first character.
_PIECES = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BETWEEN = r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def words(text: Column) -> Column:
    """The words of a text, A to Z in lower case."""
    # ``lower`` would also change letters beyond ASCII; on plain ASCII it does the same as ``translate`` and is faster.
    plain = F.octet_length(text) == F.length(text)
    lower = F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.coalesce(F.regexp_extract_all(lower, F.lit(WORDS), F.lit(0)), F.array().cast("array<string>"))


def _spelled(found: Column, at: Column, length: Column) -> Column:
    return F.array_join(F.slice(found, at + 1, length), " ")


def item_windows(benchmark: DataFrame, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """(hash, window, length, list) of the distinct windows, and (list, items): the sorted items of each different list."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("words"))
    n = F.size("words")
    each = F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), lambda i: F.slice("words", i + 1, size))).when(n > 0, F.array("words"))
    windows = items.select("item", F.explode(each).alias("w")).groupBy("w").agg(F.array_sort(F.collect_set("item")).alias("items"))
    windows = settle(windows, "item-windows")
    # Written at once: the numbers are read again, never made again.
    lists = settle(windows.select("items").distinct().withColumn("list", F.monotonically_increasing_id()), "item-lists")
    numbered = windows.join(lists, "items").select(F.xxhash64("w").alias("hash"), F.array_join("w", " ").alias("window"), F.size("w").alias("length"), "list")
    return settle(numbered, "windows"), lists


def _document_windows(found: DataFrame, lengths: list[int]) -> DataFrame:
    """Place, length and hash of every window of the given lengths, after a mark (place -1) that every document has.

    One place is one row, and a window is hashed word by word from the row's array: compiled code all through, nothing copied.
    """
    placed = found.select("*", F.explode(F.sequence(F.lit(-1), F.col("n_words").cast("int") - 1)).alias("at"))

    def hashed(length: int) -> Column:
        own = F.xxhash64(*[F.get("words", F.col("at") + k) for k in range(length)])
        return F.when((F.col("at") >= 0) & (F.col("at") + length <= F.col("n_words")), own)

    if len(lengths) == 1:
        return placed.select("*", F.lit(lengths[0]).alias("length"), hashed(lengths[0]).alias("hash"))
    each = F.array(*[F.struct(F.lit(n).alias("length"), hashed(n).alias("hash")) for n in lengths or [1]])
    several = placed.select("*", F.explode(each).alias("w")).select(*placed.columns, "w.*")
    return several.where((F.col("at") >= 0) | (F.col("length") == F.lit((lengths or [1])[0])))


def document_hits(docs: DataFrame, windows: DataFrame, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """(doc_id, version, n_words, at, length, list): every verified hit, and for every row of ``docs`` one mark with place -1."""
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())  # at most the size of a window
    found = docs.select("doc_id", F.xxhash64("text").alias("version"), words(F.col("text")).alias("words"))
    found = found.withColumn("n_words", F.size("words").cast("long"))
    each = _document_windows(found, lengths)
    keys = ["doc_id", "version", "n_words", "at", "length"]
    table = windows.select("hash", "window", "list")
    if windows.count() <= max_windows:
        met = each.join(F.broadcast(table), "hash", "left")
        return met.where((F.col("at") == -1) | (F.col("window") == _spelled(F.col("words"), F.col("at"), F.col("length")))).select(*keys, "list")
    met = each.where("at >= 0").select(*keys, "hash").join(table.select("hash").distinct(), "hash", "left_semi")
    places = met.groupBy("doc_id", "version").agg(F.collect_set(F.struct("at", "length", "hash")).alias("places"))
    places = settle(places.select(F.col("doc_id").alias("__id"), F.col("version").alias("__version"), "places"), "places")
    again = found.join(places, found["doc_id"].eqNullSafe(places["__id"]) & (found["version"] == places["__version"]))
    again = again.select("doc_id", "version", "n_words", F.explode(F.transform("places", lambda p: F.struct(
        p["at"].alias("at"), p["length"].alias("length"), p["hash"].alias("hash"), _spelled(F.col("words"), p["at"], p["length"]).alias("window")
    ))).alias("w")).select("doc_id", "version", "n_words", "w.*")
    hits = again.join(table, ["hash", "window"]).select(*keys, "list")
    marks = found.select("doc_id", "version", "n_words", F.lit(-1).alias("at"), F.lit(0).alias("length"))
    return hits.unionByName(marks.withColumn("list", F.lit(None).cast("long")))


def covered(places: Column) -> Column:
    """Words inside at least one of the hits (at, length), which stand in order of place."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(acc, hit):
        end = F.greatest(acc["end"], hit["at"] + hit["length"])
        return F.struct((acc["n"] + end - F.greatest(acc["end"], hit["at"])).alias("n"), end.alias("end"))

    return F.aggregate(places, start, step, lambda acc: acc["n"].cast("long"))


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, max_windows: int = MAX_WINDOWS) -> tuple[DataFrame, DataFrame]:
    """Two tables.

    (doc_id, version, copies, n_words, places, lists): one row per document and its hits, ``copies`` rows of it in the input;
    (lists, n_items, items_sha256): the items of each different set of lists.
    """
    windows, lists = item_windows(benchmark, size)
    hit = F.col("at") >= 0
    per_document = document_hits(docs, windows, max_windows).groupBy("doc_id", "version", "n_words").agg(
        F.count_if(~hit).alias("copies"), F.collect_set(F.when(hit, F.struct("at", "length"))).alias("places"), F.array_sort(F.collect_set("list")).alias("lists"),
    )
    per_document = settle(per_document.withColumn("places", F.array_sort("places")), "contaminated")
    sets = per_document.where(F.size("lists") > 0).groupBy("lists").agg(F.count("*").alias("n"))
    named = sets.select("lists", "n", F.explode("lists").alias("list")).join(lists, "list").groupBy("lists", "n")
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))))
    named = named.agg(items.alias("items")).select("lists", "n", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return per_document, settle(named, "item-sets")


def decontaminate(docs: DataFrame, benchmark: DataFrame, whole: bool = False, size: int = SIZE, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The documents without the words that stand in a window of the benchmark; with ``whole``, without the documents that have any.

    With the words of a window goes what stands between them; adds ``n_hit``, the words removed.  A column of this name is replaced.
    """
    docs = docs.drop("n_hit")
    per_document, _ = contaminated(docs.select("doc_id", "text"), benchmark, size, max_windows)
    hits = per_document.where(F.size("places") > 0).select(F.col("doc_id").alias("__id"), F.col("version").alias("__version"), F.col("places").alias("__places"))
    same = docs["doc_id"].eqNullSafe(hits["__id"]) & (F.xxhash64(docs["text"]) == hits["__version"])
    if whole:
        return docs.join(hits, same, "left_anti").withColumn("n_hit", F.lit(0).cast("long"))

    def rest(pieces):
        # Words and what stands between them alternate: word k is piece 2k, or 2k + 1 behind a beginning without a word.
        shift = F.when(F.get(pieces, F.lit(0)).rlike(_BETWEEN), 1).otherwise(0)
        gone = F.flatten(F.transform("__places", lambda p: F.sequence(2 * p["at"] + shift, 2 * (p["at"] + p["length"]) - 2 + shift)))
        kept = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), gone)
        return F.array_join(F.transform(kept, lambda i: F.get(pieces, i)), "")

    left = F.when(F.col("__places").isNull(), docs["text"]).otherwise(bound(F.regexp_extract_all(docs["text"], F.lit(_PIECES), F.lit(0)), rest))
    return docs.join(hits, same, "left").select(
        *[left.alias("text") if c == "text" else docs[c] for c in docs.columns], F.coalesce(covered(F.col("__places")), F.lit(0)).cast("long").alias("n_hit")
    )


def op12_decontamination(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    docs, benchmark = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark")
    per_document, sets = contaminated(docs, benchmark)
    joined = join_counted(per_document.select("doc_id", "copies", "n_words", covered(F.col("places")).alias("n_hit"), "lists"), sets, "lists", how="left")
    rows = joined.select("*", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return rows.select(
        "doc_id", "n_words", "n_hit", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


#: The same in SQL, on the texts of the windows instead of their hashes.
SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORDS}') AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORDS}') AS ws FROM benchmark),
bw AS (SELECT item, ws, least(len(ws), {SIZE}) AS k, unnest(range(1, len(ws) - least(len(ws), {SIZE}) + 2)) AS i FROM b WHERE len(ws) > 0),
grams AS (SELECT DISTINCT item, k, array_to_string(ws[i:i + k - 1], ' ') AS gram FROM bw),
dw AS (SELECT r, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM grams) WHERE len(ws) >= k),
dg AS (SELECT r, k, i, array_to_string(ws[i:i + k - 1], ' ') AS gram FROM dw),
hits AS (SELECT r, i, dg.k, item FROM dg JOIN grams ON grams.k = dg.k AND grams.gram = dg.gram),
hw AS (SELECT r, count(DISTINCT w) AS n FROM (SELECT r, unnest(range(i, i + k)) AS w FROM hits) GROUP BY r),
hi AS (SELECT r, count(*) AS n, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(hw.n, 0) AS n_hit, coalesce(hi.n, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256,
  hw.n IS NOT NULL AS contaminated FROM d LEFT JOIN hw ON hw.r = d.r LEFT JOIN hi ON hi.r = d.r
"""
