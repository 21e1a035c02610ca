"""Quality classifier from weak labels.

1. Heuristic labellers look at figures of each text (share of capitals, of
   symbols, of repeated words and so on) and vote good, bad, or abstain.
2. Expectation-maximisation estimates each labeller's accuracy without any true
   label.  It needs only how often each pattern of votes occurs: at most
   3**labellers patterns, whatever the size of the corpus, counted by one
   grouping over all documents.
3. The posterior of each pattern labels a sample of ``SAMPLE`` different texts (the
   only bounded step, chosen by a hash of the text; copies count once), on which a linear scorer
   over hashed features learns.  Features are byte trigrams after letters are
   folded into classes (capital, small, non-ASCII, digit), so it learns shape
   and punctuation and not words, next to the labellers' figures.
4. The scorer rates every whole document; those under ``THRESHOLD`` are rejected.

Special cases: a null or empty text, or one without any word, scores 0 and is
rejected; equal texts score alike whatever their other columns; an empty table
gives an empty result.  Where no document can be sampled, every text with words scores 0.5 and is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from escalade.llm import arrays
from escalade.llm.arrays import Chunk

#: Most texts that the scorer is fitted on (expected number; drawn by the hash of the text).
SAMPLE = 6000
#: Hashed features of the scorer.
FEATURES = 1 << 11
#: Documents that score less are rejected.
THRESHOLD = 0.5
#: The share of good documents weighs as much as so many words of a text.
PRIOR_WORDS = 10
#: Rounds of expectation-maximisation at most.
ROUNDS = 200

FIGURES = ["n_words", "capitals", "symbols", "repeats", "distinct", "bare", "word_length", "ends", "doubled", "odd_ends"]

GOOD, BAD, ABSTAIN = 1, 0, -1


def _fold_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    for a, b, to in ((65, 91, 65), (97, 123, 97), (48, 58, 48), (128, 256, 128), (9, 14, 32)):
        table[a:b] = to
    return table


FOLD = _fold_table()
_LETTER = np.isin(FOLD, [65, 97, 128])
_PLAIN = _LETTER | arrays.SPACE | np.isin(np.arange(256), list(b"0123456789.,;:'\"!?()-"))
_MARK = ~_LETTER & ~arrays.SPACE & ~np.isin(np.arange(256), list(b"0123456789.-"))


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def figures(chunk: Chunk) -> np.ndarray:
    """One row of ``FIGURES`` per text, each between 0 and 1 but for n_words and word_length."""
    data, offsets = chunk.data, chunk.offsets
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    start, end, doc = arrays.runs(~arrays.SPACE[data], offsets)
    count = np.bincount(doc, minlength=n)
    tokens = np.maximum(count, 1)
    letters = np.maximum(_sums(_LETTER[data], offsets), 1)
    out = np.zeros((n, len(FIGURES)))
    out[:, 0] = count
    out[:, 1] = _sums(FOLD[data] == 65, offsets) / letters
    out[:, 2] = _sums(~_PLAIN[data], offsets) / size
    if len(start):
        hashes = arrays.range_hash(arrays.prefix_hash(data), start, end)
        same = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
        out[:, 3] = np.bincount(doc[1:][same], minlength=n) / tokens
        distinct = _distinct(doc, hashes, n)
        out[:, 4] = distinct / tokens
        has = np.concatenate([[0], np.cumsum(_LETTER[data], dtype=np.int64)])
        out[:, 5] = np.bincount(doc[has[end] == has[start]], minlength=n) / tokens
        out[:, 6] = np.bincount(doc, weights=end - start, minlength=n) / tokens
        out[:, 7] = np.bincount(doc[np.isin(data[end - 1], list(b".!?"))], minlength=n) / tokens
        out[:, 9] = np.bincount(doc[~_PLAIN[data[end - 1]]], minlength=n) / tokens
    if len(data) > 1:
        twice = (data[1:] == data[:-1]) & _MARK[data[1:]]
        out[:, 8] = _sums(np.r_[False, twice], offsets) / tokens
    return out


def _distinct(doc: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((hashes, doc))
    d, h = doc[order], hashes[order]
    new = np.r_[True, (d[1:] != d[:-1]) | (h[1:] != h[:-1])]
    return np.bincount(d[new], minlength=n)


def votes(rows: np.ndarray) -> np.ndarray:
    """What each labeller says of each row of figures: 1 good, 0 bad, -1 nothing.

    A labeller speaks up where its figure is telling and abstains between.
    """
    n_words, capitals, symbols, repeats, distinct, bare, length, ends, doubled, odd_ends = rows.T
    long = n_words >= 20
    said = [
        (capitals < 0.15, capitals > 0.3),
        (symbols < 0.005, symbols > 0.02),
        (repeats < 0.02, repeats > 0.1),
        (bare < 0.02, bare > 0.1),
        ((distinct > 0.35) & long, (distinct < 0.2) & long & (n_words < 2000)),
        ((length >= 3) & (length <= 8), (length < 2) | (length > 12)),
        (doubled < 0.01, doubled > 0.1),
        (odd_ends < 0.02, odd_ends > 0.1),
        ((ends > 0.02) & (ends < 0.3) & long, ((ends > 0.6) | (ends == 0)) & long),
    ]
    return np.stack([np.where(bad, BAD, np.where(good, GOOD, ABSTAIN)) for good, bad in said], axis=1)


LABELLERS = 9


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, dict]:
    """Posterior of good for each pattern of votes, and the model: share of good, and accuracies per class.

    Given the class, labellers vote independently; whether one abstains says nothing of the class.  Each is
    held to vote bad of bad documents at least as often as of good ones, which fixes which class is which.
    Starts from the share of bad votes: a document with none is taken to be good.
    """
    spoke = patterns != ABSTAIN
    bad = patterns == BAD
    posterior = np.where(bad.any(axis=1), 0.1, 0.95)
    for _ in range(rounds):
        up, down = counts * posterior, counts * (1 - posterior)
        share = np.clip(up.sum() / counts.sum(), 1e-3, 1 - 1e-3)
        # One vote either way keeps the estimates off 0 and 1.
        says_bad = [((c[:, None] * (spoke & bad)).sum(axis=0) + 1) / ((c[:, None] * spoke).sum(axis=0) + 2) for c in (up, down)]
        says_bad[1] = np.maximum(says_bad[1], says_bad[0])
        log = [(spoke * np.where(bad, np.log(p), np.log1p(-p))).sum(axis=1) for p in says_bad]
        odds = np.log(1 - share) + log[1] - np.log(share) - log[0]
        before, posterior = posterior, 1 / (1 + np.exp(np.clip(odds, -500, 500)))
        if np.abs(posterior - before).max() < 1e-9:
            break
    return posterior, {"share_good": float(share), "accuracy_good": (1 - says_bad[0]).tolist(), "accuracy_bad": says_bad[1].tolist()}


def hashed_features(chunk: Chunk) -> np.ndarray:
    """Relative frequencies of folded byte trigrams in ``FEATURES`` hashed places, one row per text."""
    n, data = len(chunk.offsets) - 1, FOLD[chunk.data].astype(np.uint64)
    out = np.zeros((n, FEATURES), dtype=np.float32)
    if len(data) < 3:
        return out
    code = (data[:-2] << np.uint64(16)) | (data[1:-1] << np.uint64(8)) | data[2:]
    place = (arrays.mix(code) % np.uint64(FEATURES)).astype(np.int64)
    doc = np.repeat(np.arange(n), np.diff(chunk.offsets))
    inside = doc[:-2] == doc[2:]
    flat = np.bincount(doc[:-2][inside] * FEATURES + place[inside], minlength=n * FEATURES)
    out[:] = flat.reshape(n, FEATURES)
    return np.sqrt(out / np.maximum(out.sum(axis=1, keepdims=True), 1))


def _inputs(chunk: Chunk, rows: np.ndarray) -> np.ndarray:
    scaled = np.column_stack([np.log1p(rows[:, 0]) / 10, rows[:, 1:6] * 4, rows[:, 6] / 10, rows[:, 7:] * 4])
    return np.column_stack([hashed_features(chunk), scaled.astype(np.float32), np.ones(len(rows), np.float32)])


def fit_scorer(x: np.ndarray, y: np.ndarray, decay: float = 1e-4, rounds: int = 200) -> np.ndarray:
    """Weights of a logistic scorer for soft labels ``y``: accelerated gradient steps on all rows, the classes weighing alike."""
    weight = np.where(y >= 0.5, 0.5 / max((y >= 0.5).mean(), 1e-3), 0.5 / max((y < 0.5).mean(), 1e-3)).astype(np.float32)
    step = 4.0 / ((x * x).sum(axis=1).mean() + decay)
    w = np.zeros(x.shape[1], dtype=np.float32)
    ahead, momentum = w.copy(), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        gradient = x.T @ ((p - y).astype(np.float32) * weight) / len(y) + decay * ahead
        new = ahead - 0.5 * step * gradient
        after = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead, w, momentum = new + (momentum - 1) / after * (new - w), new, after
    return w


def _vote_patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per pattern of votes in each batch: partial counts, so little is shuffled."""
    for batch in batches:
        seen: dict[int, int] = {}
        for chunk in arrays.chunks(batch.column("text")):
            rows = figures(chunk)
            codes, counts = np.unique((votes(rows[rows[:, 0] > 0]) + 1) @ (3 ** np.arange(LABELLERS)), return_counts=True)
            for code, count in zip(codes.tolist(), counts.tolist()):
                seen[code] = seen.get(code, 0) + count
        yield pa.RecordBatch.from_pydict({"pattern": pa.array(list(seen), pa.int64()), "n": pa.array(list(seen.values()), pa.int64())})


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in arrays.chunks(batch.column("text")):
            rows = figures(chunk)
            x = _inputs(chunk, rows)
            codes = (votes(rows) + 1) @ (3 ** np.arange(LABELLERS))
            yield pa.RecordBatch.from_pydict({"pattern": pa.array(codes, pa.int64()), "x": pa.array([r.astype("<f2").tobytes() for r in x], pa.binary())})


def sampled_texts(texts: DataFrame, sample: int) -> DataFrame:
    """About ``sample`` different texts, or all if there are fewer.

    Copies of a text are drawn together and count once, so the sample is bounded
    whatever is repeated; an estimate of the number of different texts sets its share.
    """
    different = texts.agg(F.approx_count_distinct("text", 0.02)).first()[0]
    share = min(1.0, sample / max(different, 1))
    drawn = texts if share == 1 else texts.where(F.xxhash64("text") < F.lit(int((share - 0.5) * (1 << 64))))
    return drawn.distinct()


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """The fitted model: labeller accuracies, posterior by pattern, and the scorer's weights (None without documents)."""
    texts = docs.select("text").where("text is not null")
    counted = texts.mapInArrow(_vote_patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toPandas()
    if counted.empty:
        return {"weights": None}
    codes = counted["pattern"].to_numpy()
    patterns = codes[:, None] // (3 ** np.arange(LABELLERS)) % 3 - 1
    posterior, model = expectation_maximisation(patterns, counted["n"].to_numpy(float))
    of = dict(zip(codes.tolist(), posterior.tolist()))
    chosen = sampled_texts(texts, sample).mapInArrow(_sampled, "pattern long, x binary")

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        # In one order, so that reruns add up alike.
        rows = rows.sort_values(["pattern", "x"])
        y = rows["pattern"].map(of)
        known = y.notna().to_numpy()
        if not known.any():
            return pd.DataFrame({"weights": [b""]})
        x = np.stack([np.frombuffer(r, "<f2") for r in rows["x"][known]]).astype(np.float32)
        return pd.DataFrame({"weights": [fit_scorer(x, y[known].to_numpy(np.float32)).astype("<f4").tobytes()]})

    # The sample is the scorer's only input and has a fixed bound, whatever is repeated, so one task may hold it.
    fitted = chosen.groupBy(F.lit(0).alias("all")).applyInPandas(learn, "weights binary").collect()
    weights = bytes(fitted[0]["weights"]) if fitted else b""
    return model | {"weights": np.frombuffer(weights, "<f4") if weights else None}


def score(docs: DataFrame, model: dict, text: Column | str = "text") -> DataFrame:
    """Adds ``score`` (0 to 1) and ``kept`` to the documents."""
    weights = model["weights"]
    share = model.get("share_good", 0.5)
    prior = float(np.log(share / (1 - share)))

    @F.pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        out = []
        for chunk in arrays.chunks(pa.array(texts, pa.string())):
            rows = figures(chunk)
            odds = np.zeros(len(rows)) if weights is None else np.clip(_inputs(chunk, rows) @ weights, -30, 30).astype(float)
            # A few words are little evidence: they lean to the share of good documents.
            odds = (rows[:, 0] * odds + PRIOR_WORDS * prior) / (rows[:, 0] + PRIOR_WORDS)
            out.append(np.where(rows[:, 0] > 0, 1 / (1 + np.exp(-odds)), 0.0))
        return pd.Series(np.concatenate(out) if out else [], dtype=float)

    rated = docs.withColumn("score", rate(F.col(text) if isinstance(text, str) else text))
    return rated.withColumn("kept", F.col("score") >= THRESHOLD)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, score, kept of every document."""
    from escalade.llm.frames import read

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs)).select("doc_id", "score", "kept")
