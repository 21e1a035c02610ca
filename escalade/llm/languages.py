"""Language identification in two steps: the family, then the language within it.

The features of a text are relative frequencies of its byte bigrams and
trigrams (lower case; what is no letter is a space) in ``FEATURES`` hashed
places.  Families are told apart by one-versus-one linear support vector
machines over all languages, and the languages of a family by one-versus-one
machines of its own, which see only that family's texts and so can use the
small differences between close relatives.

Machines are fitted on a bounded sample: about ``PER_LANGUAGE`` different texts of
each language, drawn by the hash of the text; copies count once.  All languages are learned: where more
than ``GROUP`` families (or languages of a family) stand side by side, groups of
them are told apart first, in as many levels as it takes.  Each family and each
group is fitted by a task of its own, which holds its sample and nothing else;
predictions go over whole texts of all documents.

Special cases: ``und`` with score 0 for a null text, a text without a letter,
and any text if nothing could be learned; equal texts get equal predictions;
a language that ``FAMILIES`` does not name is a family of its own; rows with a null
doc_id are not learned from and not held out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from escalade.llm import arrays
from escalade.llm.arrays import Chunk
from escalade.llm.frames import read

#: Texts that each language's machines are fitted on (expected number).
PER_LANGUAGE = 1200
#: Classes that one level tells apart.
GROUP = 32
FEATURES = 1 << 11

# Languages by family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be bg mk sr hr bs sl cs sk pl",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk tt",
    "indo_aryan": "hi bn mr gu pa ur ne si or as sa",
    "iranian": "fa ku ps tg",
    "dravidian": "ta te kn ml",
    "semitic": "ar he am mt",
    "austronesian": "id ms jv su tl mg mi haw",
    "sino_tibetan": "zh yue my bo",
    "bantu": "sw zu xh rw sn",
}
FAMILY_OF = {language: family for family, names in FAMILIES.items() for language in names.split()}


def _letter_table() -> np.ndarray:
    table = np.full(256, 32, dtype=np.uint8)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


LETTERS = _letter_table()


def features(chunk: Chunk) -> np.ndarray:
    """Square roots of the hashed relative frequencies, one row per text, with a constant at the end."""
    n, data = len(chunk.offsets) - 1, LETTERS[chunk.data].astype(np.uint64)
    out = np.zeros((n, FEATURES + 1), dtype=np.float32)
    out[:, -1] = 1
    doc = np.repeat(np.arange(n), np.diff(chunk.offsets))
    counts = np.zeros(n * FEATURES)
    for size in (2, 3):
        if len(data) < size:
            continue
        last = len(data) - size + 1
        code = np.full(last, size, dtype=np.uint64)
        for k in range(size):
            code = (code << np.uint64(8)) | data[k:last + k]
        # Runs of spaces say nothing of the language.
        inside = (doc[:last] == doc[size - 1:]) & ~((data[:last] == 32) & (data[1:last + 1] == 32))
        place = (arrays.mix(code[inside]) % np.uint64(FEATURES)).astype(np.int64)
        counts += np.bincount(doc[:last][inside] * FEATURES + place, minlength=n * FEATURES)
    counts = counts.reshape(n, FEATURES)
    out[:, :-1] = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
    return out


def fit_machine(x: np.ndarray, y: np.ndarray, decay: float = 1e-4, rounds: int = 150) -> np.ndarray:
    """A linear support vector machine with squared hinge loss for labels -1 and 1, which weigh alike; accelerated gradient steps."""
    weight = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y < 0).mean(), 1e-9)).astype(np.float32)
    step = 1.0 / (2 * (x * x).sum(axis=1).mean() + decay)
    w = np.zeros(x.shape[1], dtype=np.float32)
    ahead, momentum = w.copy(), 1.0
    for _ in range(rounds):
        slack = np.maximum(1 - y * (x @ ahead), 0)
        new = ahead - step * (-2 * (x.T @ (weight * y * slack)) / len(y) + decay * ahead)
        after = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead, w, momentum = new + (momentum - 1) / after * (new - w), new, after
    return w


def fit_group(rows: pd.DataFrame) -> pd.DataFrame:
    """One machine for each two classes of a group (all families, or the languages of one); rows in one order, so that reruns add up alike."""
    rows = rows.sort_values(["name", "x"])
    x = np.stack([np.frombuffer(r, "<f2") for r in rows["x"]]).astype(np.float32)
    names = rows["name"].to_numpy()
    out = []
    for a, b in combinations(sorted(set(names)), 2):
        two = (names == a) | (names == b)
        out.append((a, b, fit_machine(x[two], np.where(names[two] == a, 1, -1).astype(np.float32)).astype("<f4").tobytes()))
    return pd.DataFrame(out, columns=["a", "b", "w"]).assign(level=rows["level"].iloc[0])[["level", "a", "b", "w"]]


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in arrays.chunks(batch.column("text")):
            x = features(chunk).astype("<f2")
            yield pa.RecordBatch.from_pydict({
                "lang": batch.column("lang").slice(chunk.first, chunk.last - chunk.first), "x": pa.array([r.tobytes() for r in x], pa.binary())
            })


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike("\\p{L}"), F.lit(False))


def tree_of(languages: dict[str, list[str]]) -> dict[str, list[str]]:
    """Children of every level: the root ``""`` leads to families ``f:``, these to languages ``l:``, by groups where there are many."""
    tree = {}

    def grow(level: str, children: list[str]) -> None:
        depth = 0
        while len(children) > GROUP:
            depth += 1
            groups = {f"{level or 'g:'}/{depth}.{k:06d}": children[k:k + GROUP] for k in range(0, len(children), GROUP)}
            tree.update(groups)
            children = list(groups)
        tree[level] = children

    for family, own in languages.items():
        grow(f"f:{family}", [f"l:{language}" for language in sorted(own)])
    grow("", [f"f:{family}" for family in sorted(languages)])
    return tree


def _places(tree: dict[str, list[str]], drawn: dict[str, float], per_language: int) -> list[tuple[str, str, str, float]]:
    """(language, level, child, share): where a language's sample goes.  Each child gets about as many texts as one language, or all it has."""
    below = {}

    def leaves(child: str) -> list[str]:
        if child not in below:
            below[child] = [child[2:]] if child.startswith("l:") else [x for c in tree[child] for x in leaves(c)]
        return below[child]

    out = []
    for level, children in tree.items():
        for child in children if len(children) > 1 else ():
            own = leaves(child)
            share = min(1.0, per_language / sum(drawn[x] for x in own))
            out.extend((x, level, child, share) for x in own)
    return out


def texts_by_language(known: DataFrame) -> dict[str, int]:
    """The number of different texts of each language; an estimate, as it sets shares only."""
    return {r["lang"]: max(r["n"], 1) for r in known.groupBy("lang").agg(F.approx_count_distinct("text", 0.02).alias("n")).collect()}


def sampled_texts(known: DataFrame, counts: dict[str, int], per_language: int) -> DataFrame:
    """(lang, text): about ``per_language`` different texts of each language, or all; copies are drawn together and count once."""
    shares = known.sparkSession.createDataFrame([(x, min(1.0, per_language / n)) for x, n in counts.items()], "lang string, share double")
    # A few rows a language, from the driver: texts need no shuffle to meet them.
    drawn = known.join(F.broadcast(shares), "lang").where(F.xxhash64("text") / F.lit(2.0**64) + 0.5 < F.col("share"))
    return drawn.select("lang", "text").distinct()


def fit(train: DataFrame, per_language: int = PER_LANGUAGE, families: dict[str, str] = FAMILY_OF) -> dict:
    """The model from ``text`` and ``lang``: the tree of levels, and machines by level (``""`` for the root)."""
    spark = train.sparkSession
    known = train.where(F.col("lang").isNotNull() & has_letter(F.col("text"))).select("lang", F.lower("text").alias("text"))
    counts = texts_by_language(known)
    model = {"tree": {}, "machines": {}}
    if not counts:
        return model
    languages = {}
    for language in counts:
        languages.setdefault(families.get(language, language), []).append(language)
    model["tree"] = tree_of(languages)
    places = _places(model["tree"], {x: min(n, per_language) for x, n in counts.items()}, per_language)
    places = spark.createDataFrame(places, "lang string, level string, name string, part double")
    # Places have a few rows a language and come from the driver: texts need no shuffle to meet them.
    drawn = sampled_texts(known, counts, per_language)
    drawn = drawn.mapInArrow(_sampled, "lang string, x binary")
    groups = drawn.join(F.broadcast(places), "lang").where(F.xxhash64("x") / F.lit(2.0**64) + 0.5 < F.col("part")).select("level", "name", "x")
    for row in groups.groupBy("level").applyInPandas(fit_group, "level string, a string, b string, w binary").collect():
        model["machines"].setdefault(row["level"], []).append((row["a"], row["b"], np.frombuffer(row["w"], "<f4")))
    return model


def decide(x: np.ndarray, names: list[str], machines: list) -> tuple[np.ndarray, np.ndarray]:
    """The class with most votes of the machines (ties: the greatest sum of margins), and how sure they are of it."""
    if len(names) == 1 or not machines:
        return np.zeros(len(x), dtype=np.int64), np.ones(len(x))
    place = {name: k for k, name in enumerate(names)}
    votes, margins, sure = np.zeros((len(x), len(names))), np.zeros((len(x), len(names))), np.zeros((len(x), len(names)))
    for a, b, w in machines:
        margin = x @ w
        for name, m in ((a, margin), (b, -margin)):
            votes[:, place[name]] += m > 0
            margins[:, place[name]] += np.clip(m, -1, 1)
            sure[:, place[name]] += 1 / (1 + np.exp(-np.clip(3 * m, -30, 30)))
    best = np.argmax(votes + margins / (4 * len(names)), axis=1)
    return best, sure[np.arange(len(x)), best] / (len(names) - 1)


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to the documents, from ``text`` alone."""
    tree, machines = model["tree"], model["machines"]

    def descend(x: np.ndarray, level: str, rows: np.ndarray, names: np.ndarray, sure: np.ndarray) -> None:
        best, found = decide(x[rows], tree[level], machines.get(level, []))
        sure[rows] *= found
        for k in np.unique(best):
            child, some = tree[level][k], rows[best == k]
            if child.startswith("l:"):
                names[some] = child[2:]
            else:
                descend(x, child, some, names, sure)

    @F.pandas_udf("lang_pred string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        found, scores = [], []
        for chunk in arrays.chunks(pa.array(texts, pa.string())):
            x = features(chunk)
            names, sure = np.empty(len(x), dtype=object), np.ones(len(x))
            descend(x, "", np.arange(len(x)), names, sure)
            found.append(names)
            scores.append(sure)
        return pd.DataFrame({"lang_pred": np.concatenate(found) if found else [], "score": np.concatenate(scores) if scores else []})

    if not tree:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    lettered = has_letter(F.col("text"))
    guessed = docs.withColumn("__g", guess(F.lower(F.coalesce("text", F.lit("")))))
    return guessed.withColumns({
        "lang_pred": F.when(lettered, F.col("__g.lang_pred")).otherwise("und"), "score": F.when(lettered, F.col("__g.score")).otherwise(0.0)
    }).drop("__g")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op6_languages(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = fit(docs.where(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
