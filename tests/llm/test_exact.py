"""Operators with one right answer, against brute force and SQL."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from check import TABLES, compare
from escalade.llm import bloom_lookup, curriculum, line_dedup, projection_forest, suffix_dedup, weighted_minhash, word_bpe
from escalade.llm.queries import ORACLE, QUERIES

from .fixtures import ODD_ROWS, empty_documents, odd_documents, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_sql(spark, sf, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert compare(QUERIES[key](spark, sf).toPandas(), con.execute(ORACLE[key]).df()) == ""


def test_sql_of_nulls(spark, tmp_path):
    """Nulls, ties and blank texts in both engines; ids that differ, as SQL orders repeated ids at will."""
    rows = [(k, t, s) for k, (_, t, _, s) in enumerate(ODD_ROWS)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for key in ("op4_curriculum_mix", "op10_line_dedup"):
        assert compare(QUERIES[key](spark, str(tmp_path)).toPandas(), con.execute(ORACLE[key]).df()) == ""


# op1

def edited(texts):
    return [t[:len(t) - len(t) // 4] + o[:len(t) // 4] for t, o in zip(texts, texts[1:] + texts[:1])]


def test_fingerprints_of_edited_versions(docs):
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    want = edited([r.text for r in rows])
    block = bloom_lookup.neighbour_blocks(docs, block_rows=17)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    small = block.groupBy("block").applyInArrow(bloom_lookup._edited_block("doc_id"), schema).toPandas().set_index("doc_id")
    whole = bloom_lookup.edited_versions(docs).toPandas().set_index("doc_id")
    assert whole.sort_index().equals(small.sort_index())
    for r, text in zip(rows, want):
        assert whole.loc[r.doc_id, "n_chars"] == len(r.text)
        assert whole.loc[r.doc_id, "edited_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    long = whole[whole["n_chars"] > 300]
    assert (long["near_edited"] > long["near_next"]).mean() > 0.95 and long["near_edited"].median() > 0.6 and long["near_next"].median() < 0.1
    by_text = pd.DataFrame({"t": [r.text for r in rows], "f": [whole.loc[r.doc_id, "fingerprint"] for r in rows]}).groupby("t")["f"].nunique()
    assert (by_text == 1).all()


def test_peeling_recovers_exactly_the_differing_digests():
    rng = np.random.default_rng(3)
    for shared, only_a, only_b in ((0, 0, 0), (5, 1, 0), (400, 3, 2), (50, 500, 300), (0, 5000, 4000)):
        keys = rng.integers(1, 1 << 63, shared + only_a + only_b, dtype=np.uint64)
        a, b = keys[:shared + only_a], np.r_[keys[:shared], keys[shared + only_a:]]
        digest, pair, sign = bloom_lookup.differences((a, np.array([0, len(a)])), (b, np.array([0, len(b)])))
        assert set(digest[sign == 1].tolist()) == set(keys[shared:shared + only_a].tolist())
        assert set(digest[sign == -1].tolist()) == set(keys[shared + only_a:].tolist())


def test_odd_versions(spark):
    odd = odd_documents(spark)
    got = bloom_lookup.edited_versions(odd).toPandas()
    assert len(got) == len(ODD_ROWS)
    assert (got["near_edited"].between(0, 1) & got["near_next"].between(0, 1)).all()
    ordered = sorted(ODD_ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    assert sorted(got["n_chars"]) == sorted(len(t or "") for _, t, _, _ in ordered)
    assert bloom_lookup.edited_versions(empty_documents(spark)).count() == 0
    alone = bloom_lookup.edited_versions(odd.where("doc_id = 7")).first()
    text = ODD_ROWS[7][1]
    assert alone["edited_sha256"] == hashlib.sha256(edited([text])[0].encode()).hexdigest() and alone["near_next"] == 1
    versions = spark.createDataFrame([("a b c.\nd e.", "a b c.\nx y.", 1), (None, "", 2)], "old string, new string, likeness int")
    rows = bloom_lookup.compare_versions(versions).collect()
    assert rows[0]["only_old"] and rows[0]["only_new"] and 0 < rows[0]["likeness"] < 1 and rows[1]["likeness"] == 1
    assert bloom_lookup.fingerprints(odd).select("fingerprint").distinct().count() > 5


# op3

def test_bpe_is_the_library(spark, docs):
    tokenizer = Tokenizer.from_file(PATH)
    for table in (docs, odd_documents(spark)):
        encoded = word_bpe.decode(word_bpe.encode(table, PATH, block_bytes=3000), PATH)
        got = Counter((r.doc_id, tuple(r.ids), r.text) for r in encoded.collect())
        want = Counter()
        for r in table.select("doc_id", "text").collect():
            ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
            want[r.doc_id, tuple(ids), tokenizer.decode(ids, skip_special_tokens=False)] += 1
        assert got == want
        assert Counter((r.doc_id, tuple(r.ids), r.text) for r in word_bpe.encode(table, PATH, decoded=True).collect()) == want
    assert word_bpe.encode(empty_documents(spark), PATH).count() == 0


def test_words_can_be_encoded_alone():
    import random

    rng, tokenizer = random.Random(5), Tokenizer.from_file(PATH)
    odd = [" ", "  ", "\n", "\t", "\r", "\x1c", "\x85", "\xa0", "　", "​", "a", "B", "é", "1", "²", "!", "'s", "'", "<|endoftext|>", "日本", "😀", "́", "_"]
    for _ in range(3000):
        text = "".join(rng.choice(odd) for _ in range(rng.randrange(1, 12)))
        whole = tokenizer.encode(text, add_special_tokens=False).ids
        assert whole == [i for w in word_bpe.split_words(text) for i in tokenizer.encode(w, add_special_tokens=False).ids], repr(text)


def test_ids_without_piece_and_broken_characters(spark):
    rows = spark.createDataFrame([([-1, 99999, 0],), ([], ), (None,), ([162, 255],)], "ids array<int>")
    tokenizer = Tokenizer.from_file(PATH)
    assert [r.text for r in word_bpe.decode(rows.coalesce(1), PATH).collect()] == ["!", "", "", tokenizer.decode([162, 255])]


# op4

def test_schedules_are_integrated_and_inverted(spark):
    one = spark.range(1)
    for points in (((0, 0), (1, 6)), ((0, 1), (1, 1)), ((0, 4), (1, 0)), ((0, 1), (0.25, 3), (0.5, 0), (0.75, 0), (1, 2))):
        pieces = curriculum.segments(curriculum.knots(*points))
        for part in (0.0, 0.1, 0.5, 0.9, 1.0):
            at = one.select(curriculum.progress(pieces, F.lit(part))).first()[0]
            grid = np.linspace(0, 1, 200001)
            w = np.interp(grid, *zip(*points))
            area = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(grid))])
            assert abs(np.interp(at, grid, area) / area[-1] - part) < 1e-4


def test_mix_and_training_order(spark, docs):
    sized = docs.withColumn("size", curriculum.word_count(F.col("text")))
    placed = curriculum.place_documents(sized, curriculum.cyclic_schedule)
    rows = placed.withColumn("taken", F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])).toPandas()
    by = rows.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"))
    assert ((by["taken"] - by["target"]).abs() <= 0.5).all() and (rows["taken"] <= 2 * rows["size"]).all()
    assert abs(by["target"].sum() - 1.5 * by["size"].sum()) < 1e-6 * by["size"].sum()
    order = [r.position for r in curriculum.training_order(placed).select("position").collect()]
    assert order == sorted(order) and 0 <= order[0] and order[-1] <= 1
    rising = placed.where("source = 'src0'").select(F.explode("copies.position").alias("p")).agg(F.avg("p")).first()[0]
    even = placed.where("source = 'src1'").select(F.explode("copies.position").alias("p")).agg(F.avg("p")).first()[0]
    assert rising > even + 0.05


def test_targets_stop_and_share_again(spark):
    totals = spark.createDataFrame([(False, "a", 10), (False, "b", 1000), (False, "c", 100), (True, "", 0)], "no_source boolean, name string, source_size long")
    got = {r["name"]: r["target"] for r in curriculum.source_targets(totals, curriculum.cyclic_schedule).collect()}
    size, weight = {"a": 10, "b": 1000, "c": 100, "": 0}, {"a": 3, "b": 1, "c": 2, "": 3}
    left, want = dict(size), {}
    budget = 1.5 * 1110
    while True:
        share = {s: budget * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 2 * size[s]]
        if not over:
            break
        for s in over:
            want[s] = 2 * size[s]
            budget -= want[s]
            del left[s]
    assert got == pytest.approx(want | share)


def test_odd_mix(spark):
    sized = odd_documents(spark).withColumn("size", curriculum.word_count(F.col("text")))
    placed = curriculum.place_documents(sized, curriculum.cyclic_schedule)
    assert placed.count() == len(ODD_ROWS) and curriculum.training_order(placed).count() > 0
    empty = empty_documents(spark).withColumn("size", curriculum.word_count(F.col("text")))
    assert curriculum.place_documents(empty, curriculum.cyclic_schedule).count() == 0
    cut = spark.createDataFrame([("  a b\tc\n d ", n) for n in range(1, 6)], "t string, n long").select(curriculum.first_words(F.col("t"), F.col("n")))
    assert [r[0] for r in cut.collect()] == ["a", "a b", "a b\tc", "a b\tc\n d", "a b\tc\n d"]


# op7

def removed_by_force(rows, length=50):
    seen, out = {}, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (text or "").encode()
        for i in range(len(b) - length + 1):
            key = (doc_id is not None, doc_id or 0)
            seen[b[i:i + length]] = min(seen.get(b[i:i + length], key), key)
    for doc_id, text in rows:
        b, key = (text or "").encode(), (doc_id is not None, doc_id or 0)
        cover = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] < key:
                cover[i:i + length] = b"\1" * length
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(cover))]
        out.append((doc_id, len(b), tuple(spans), bytes(c for c, gone in zip(b, cover) if not gone)))
    return Counter(out)


@pytest.mark.parametrize("block_bytes,common", [(1 << 24, 256), (40_000, 3)])
def test_repeated_strings(spark, docs, block_bytes, common):
    for table in (docs.select("doc_id", "text"), odd_documents(spark)):
        got = suffix_dedup.repeated_strings(table, block_bytes=block_bytes, common=common).collect()
        got = Counter((r.doc_id, r.n_bytes, tuple((s.start, s.stop) for s in r.removed), bytes(r.kept)) for r in got)
        rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
        assert got == removed_by_force(rows)
    assert suffix_dedup.repeated_strings(empty_documents(spark)).count() == 0


def test_suffix_sort_of_periodic_strings():
    rng = np.random.default_rng(1)
    data = np.frombuffer(b"ab" * 300 + bytes(rng.integers(97, 99, 600).tolist()) + b"a" * 300, np.uint8)
    place = rng.permutation(len(data) - 50)[:700]
    group = place % 3
    got, groups = suffix_dedup.SuffixOrder(data, np.array([0]), np.array([len(data)]), 50).sort(place, group)
    want = sorted(place.tolist(), key=lambda p: (p % 3, bytes(data[p:p + 50])))
    body = lambda ps: [(p % 3, bytes(data[p:p + 50])) for p in ps]
    assert body(got.tolist()) == body(want) and sorted(got.tolist()) == sorted(want)


def test_false_friends_stay_apart():
    data = np.frombuffer(b"aaaabbbbaaaabbbb", np.uint8)
    start, size = np.array([0, 4, 8, 12]), np.full(4, 4)
    same = np.zeros(4, np.uint64)
    found = suffix_dedup.distinct_segments(data, start, size, np.zeros(4, np.int64), same, same, np.array([5, 1, 2, 3]))
    contents = [bytes(data[s:s + 4]) for s in found.start]
    assert [contents[k] for k in found.of] [0:1] + [contents[found.of[2]]] == [b"aaaa", b"aaaa"]
    assert found.least[found.of[0]] == 2


# op8

def test_vector_links(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((300, 24))
    near = np.vstack([base[:80] + 0.25 * rng.standard_normal((80, 24)), base[:10] * 3, base[:5], -base[:5]])
    rows = [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(np.vstack([base, near]))]
    rows += [(500, None), (501, []), (502, [0.0] * 24), (503, [float("nan")] + [1.0] * 23), (504, [None] + [1.0] * 23), (505, [float("inf")] * 24), (506, [1.0]), (507, [2.0])]
    rows += [(None, rows[0][1]), rows[0]]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, component int, n_links int")
    good = {i: np.array(v, dtype=np.float32).astype(float) for i, v in rows if i is not None and (i < 500 or i > 505)}
    links = {i: set() for i in good}
    for i in good:
        for j in good:
            if i < j and len(good[i]) == len(good[j]) and good[i] @ good[j] / np.linalg.norm(good[i]) / np.linalg.norm(good[j]) >= 0.9 - 1e-15:
                links[i].add(j)
                links[j].add(i)
    for options in ({}, {"task_points": 60, "leaf": 20, "trees": 24}):
        got = projection_forest.near_vectors(table, **options).collect()
        assert len(got) == len(rows)
        want_n = sum(len(x) for x in links.values())
        assert all(r.n_links <= len(links.get(r.vec_id, ())) for r in got)
        assert sum({r.vec_id: r.n_links for r in got}.values()) >= 0.98 * want_n
        seen = {r.vec_id: r for r in got}
        assert all(seen[k].component_id == k and seen[k].kept and seen[k].n_links == 0 for k in range(500, 506))
        assert seen[None].component_id is None and seen[None].kept and seen[507].component_id == 506 and not seen[507].kept
        assert seen[390].component_id == 0 and seen[380].component_id == 0
    assert projection_forest.near_vectors(table.limit(0)).count() == 0


@pytest.mark.parametrize("block", [700, projection_forest.BLOCK])
def test_links_of_a_large_cluster(spark, block):
    """Distinct close vectors, far more than a leaf holds; small groups and a vec_id with several vectors stand beside them."""
    rng = np.random.default_rng(8)
    cluster = rng.standard_normal(32) + 0.2 * rng.standard_normal((3000, 32))
    pairs = np.repeat(rng.standard_normal((100, 32)), 3, axis=0) + 0.2 * rng.standard_normal((300, 32))
    x = np.vstack([cluster, pairs])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    ids = np.arange(len(x))
    ids[3299] = 5
    near[5] |= near[3299]
    near[:, 5] |= near[:, 3299]
    near = near[:3299, :3299]
    np.fill_diagonal(near, False)
    table = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in projection_forest.near_vectors(table, block=block).collect()}
    want = near.sum(axis=1)
    assert want[:3000].mean() > 1000
    assert sum(got.values()) >= 0.999 * want.sum() and all(got[k] <= want[k] for k in got)
    assert [got[k] for k in range(3000) if k != 5] == [want[k] for k in range(3000) if k != 5]


# op9

def weights(texts):
    words = [re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())) for t in texts]
    frequency = Counter(w for x in words for w in set(x))
    idf = {w: math.log((len(words) + 1) / (n + 1)) + 1 for w, n in frequency.items()}
    out = []
    for x in words:
        grams = Counter(tuple(x[i:i + 5]) for i in range(len(x) - 4)) if len(x) >= 5 else Counter([tuple(x)] if x else [])
        out.append({g: n * sum(idf[w] for w in g) / len(g) for g, n in grams.items()})
    return out


def similarity(a, b):
    shared = sum(min(w, b[g]) for g, w in a.items() if g in b)
    return shared / max(sum(a.values()) + sum(b.values()) - shared, 1e-300)


def test_near_classes(docs):
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    table = weights([r.text for r in rows])
    root = {r.doc_id: r.doc_id for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(rows):
        for j in range(i):
            if table[i].keys() & table[j].keys() and similarity(table[i], table[j]) >= 0.8:
                x, y = sorted((find(a.doc_id), find(rows[j].doc_id)))
                root[y] = x
    got = weighted_minhash.near_classes(docs).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: find(i) for i in root}
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


@pytest.mark.parametrize("few, many, block, pairs", [(8, 64, 512, 16), (2, 3, 20, 16), (2, 3, 20, 0)])
def test_pairs_within_a_template(spark, monkeypatch, few, many, block, pairs):
    """Pairs in the middle of buckets that a shared passage makes hot, texts that lean on it still more, and links between groups of linked nodes."""
    for name, value in (("FEW", few), ("MANY", many), ("BLOCK", block), ("PAIRS", pairs)):
        monkeypatch.setattr(weighted_minhash, name, value)
    template, rows = prose(50, 150), []
    for k in range(120):
        own = prose(1000 + k, 90).split()
        rows += [" ".join([template, *own]), " ".join([template, *own[:-12], prose(3000 + k, 12)])]
    # Over a fifth of the weight is the passage's: its shingles reach into the prefixes.
    rows += [" ".join([prose(50, 150), prose(5000 + k, 25)]) for k in range(90)]
    # Chains, of which each text is near to its neighbours only.
    for k in range(8):
        words = prose(7000 + k, 130).split()
        rows += [" ".join([template, *words[8 * j:8 * j + 70]]) for j in range(7)]
    order = np.random.default_rng(5).permutation(len(rows))
    texts = [rows[k] for k in order]
    table = weights(texts)
    want = {(i, j) for j in range(len(texts)) for i in range(j) if table[i].keys() & table[j].keys() and similarity(table[i], table[j]) >= 0.8}
    root = list(range(len(texts)))
    for _ in texts:
        for i, j in want:
            root[i] = root[j] = min(root[i], root[j])
    assert len(want) > 120 and len(set(root)) > 100
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in weighted_minhash.near_classes(table).collect()}
    assert [got[k] for k in range(len(texts))] == root


def test_all_similarities_of_a_chunk():
    import pyarrow as pa

    from escalade.llm import arrays

    texts = [prose(1, 60) * 3, prose(1, 60), prose(1, 50) + " " + prose(2, 20), "a", "", "a " * 40, "a " * 25]
    idf = np.random.default_rng(0).uniform(1, 9, weighted_minhash.VOCABULARY)
    (chunk,) = arrays.chunks(pa.array(texts))
    found = weighted_minhash.all_similarities(chunk, idf)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            (left,), (right,) = arrays.chunks(pa.array([a])), arrays.chunks(pa.array([b]))
            assert i == j or abs(found[i, j] - weighted_minhash.similarities(left, right, idf)[0]) < 1e-9


def test_draws_estimate_the_weighted_similarity():
    import pyarrow as pa

    from escalade.llm import arrays

    a, b = prose(1, 400), prose(1, 400)[:1500] + prose(2, 120)
    idf = np.random.default_rng(0).uniform(1, 9, weighted_minhash.VOCABULARY)
    (chunk,) = arrays.chunks(pa.array([a, b]))
    (left,), (right,) = arrays.chunks(pa.array([a])), arrays.chunks(pa.array([b]))
    keys = weighted_minhash.band_keys(chunk, idf, 1500, 1)
    assert abs((keys[0] == keys[1]).mean() - weighted_minhash.similarities(left, right, idf)[0]) < 0.05


def test_odd_classes(spark):
    got = weighted_minhash.near_classes(odd_documents(spark)).collect()
    assert len(got) == len(ODD_ROWS)
    seen = {}
    for r in got:
        seen.setdefault(r.doc_id, set()).add((r.class_id, r.kept))
    assert seen[1] == {(1, True)} and seen[2] == seen[13] == {(1, False)} and seen[12] == {(1, False)}
    assert all(seen[k] == {(k, True)} for k in (3, 4, 5, 6, 7, 8, 9, 10, 11, 16)) and seen[None] == {(None, True)}
    assert weighted_minhash.near_classes(empty_documents(spark)).count() == 0


# op10

def lines_by_force(rows, window=2, long_words=50):
    first, docs = {}, []
    for doc_id, text in sorted(rows):
        lines = text.split("\n")
        content = [i for i, x in enumerate(lines) if x.strip(" ")]
        runs = [(k, window) for k in range(len(content) - window + 1)]
        runs += [(k, 1) for k, i in enumerate(content) if len(re.findall(r"[^ \t]+", lines[i])) >= long_words]
        gone = set()
        for k, n in sorted(runs):
            key = tuple(lines[i] for i in content[k:k + n])
            if first.setdefault(key, (doc_id, k)) != (doc_id, k):
                gone.update(content[k:k + n])
        docs.append((doc_id, len(content), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return sorted(docs)


@pytest.mark.parametrize("window", [2, 3])
def test_line_dedup(docs, window):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = line_dedup.dedup_lines(docs, window=window).select("doc_id", "n_lines", "n_removed", "text").collect()
    assert sorted(tuple(r) for r in got) == lines_by_force(rows, window)


def test_odd_lines(spark):
    odd = odd_documents(spark)
    got = line_dedup.dedup_lines(odd).collect()
    assert len(got) == len(ODD_ROWS)
    texts = {}
    for r in got:
        texts.setdefault(r.doc_id, []).append((r.text, r.n_lines, r.n_removed))
    assert (None, 0, 0) in texts[3] and texts[4] == [("", 0, 0)] and texts[5] == [("   \n\n\t ", 1, 0)]
    assert texts[2] == [("", 1, 1)] * 2 and texts[8][0][2] == 1 and texts[15][0][2] == 2
    assert line_dedup.dedup_lines(empty_documents(spark)).count() == 0


def test_words_encoded_together():
    tokenizer = Tokenizer.from_file(PATH)
    words = [w for _, t, _, _ in ODD_ROWS if t for w in word_bpe.split_words(t)][:5000] + [" ", "\n", " a<|endoftext|>b", "日本", " x "]
    assert word_bpe.encode_words(words, tokenizer) == [tuple(tokenizer.encode(w, add_special_tokens=False).ids) for w in words]
