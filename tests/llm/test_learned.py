"""Learned operators by held-out accuracy, WARC records by brute force, and the pipeline stage by stage."""

from __future__ import annotations

import hashlib
import html
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from escalade.llm import curriculum, languages, quality, warc
from escalade.llm.queries import QUERIES

from .fixtures import ODD_ROWS, empty_documents, odd_documents
from .test_exact import lines_by_force, similarity, weights


# op5

def test_quality_agrees_with_labels_it_never_saw(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op5_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    good, bad = got[got["quality"] == 1], got[got["quality"] == 0]
    assert good["kept"].mean() >= 0.98 and (~bad["kept"]).mean() >= 0.9 and got["score"].between(0, 1).all()


def test_expectation_maximisation_finds_the_accuracies():
    rng = np.random.default_rng(4)
    truth = rng.random(40000) < 0.8
    says_bad = np.array([(0.02, 0.5), (0.05, 0.9), (0.01, 0.3), (0.03, 0.6)])
    bad = rng.random((40000, 4)) < np.where(truth[:, None], says_bad[:, 0], says_bad[:, 1])
    votes = np.where(rng.random((40000, 4)) < 0.2, quality.ABSTAIN, np.where(bad, quality.BAD, quality.GOOD))
    patterns, of, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, model = quality.expectation_maximisation(patterns, counts.astype(float))
    assert abs(model["share_good"] - 0.8) < 0.02
    assert np.abs(np.array(model["accuracy_bad"]) - says_bad[:, 1]).max() < 0.05
    spoke, bad = patterns != quality.ABSTAIN, patterns == quality.BAD
    log = [(spoke * np.where(bad, np.log(p), np.log1p(-p))).sum(axis=1) for p in says_bad.T]
    best = (np.log(0.8) + log[0] >= np.log(0.2) + log[1])[of.ravel()]
    # As good as with the true accuracies known.
    assert ((posterior[of.ravel()] >= 0.5) == truth).mean() > (best == truth).mean() - 0.005


def test_odd_quality(spark):
    odd = odd_documents(spark)
    got = quality.score(odd, quality.fit(odd)).collect()
    assert len(got) == len(ODD_ROWS)
    assert all(r.score == 0 and not r.kept for r in got if not (r.text or "").strip())
    empty = empty_documents(spark)
    assert quality.score(empty, quality.fit(empty)).count() == 0
    assert quality.score(odd, quality.fit(empty)).where("kept").count() == sum(bool((t or "").strip()) for _, t, _, _ in ODD_ROWS)


def test_quality_sample_is_bounded_whatever_is_repeated(spark):
    # The text of the least hash is in every sample; a third of all rows repeat it.
    hot = spark.range(100).select(F.concat(F.lit("hot "), F.col("id")).alias("text")).orderBy(F.xxhash64("text")).first()["text"]
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit(hot)).otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    drawn = quality.sampled_texts(rows, 400).toPandas()["text"]
    assert drawn.is_unique and hot in set(drawn) and 200 < len(drawn) < 800
    assert quality.sampled_texts(rows, 5000).count() == 4001


def test_language_samples_are_bounded_whatever_is_repeated(spark):
    hot = spark.range(100).select(F.concat(F.lit("hot "), F.col("id")).alias("text")).orderBy(F.xxhash64("text")).first()["text"]
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit(hot)).otherwise(F.concat(F.lit("text "), F.col("id"))).alias("text"))
    known = rows.crossJoin(spark.createDataFrame([("en",), ("fr",)], "lang string"))
    counts = languages.texts_by_language(known)
    drawn = languages.sampled_texts(known, counts, 400).toPandas()
    assert all(abs(n - 4001) < 300 for n in counts.values())
    for _, texts in drawn.groupby("lang")["text"]:
        assert texts.is_unique and hot in set(texts) and 200 < len(texts) < 800


# op6

def test_languages_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op6_languages"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert 0.2 < len(held) / len(got) < 0.3 and (held["lang"] == held["lang_pred"]).mean() >= 0.97 and got["score"].between(0, 1).all()


def test_odd_languages(spark):
    odd = odd_documents(spark)
    model = languages.fit(odd)
    got = languages.predict(odd, model).collect()
    assert len(got) == len(ODD_ROWS)
    for r in got:
        if r.text is None or not re.search(r"[^\W\d_]", r.text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in {"en", "de", "fr", "es"} and 0 <= r.score <= 1
    assert languages.predict(empty_documents(spark), model).count() == 0
    nothing = languages.fit(empty_documents(spark))
    assert {r.lang_pred for r in languages.predict(odd, nothing).collect()} == {"und"}
    one = languages.fit(odd.where("lang = 'en'"))
    assert {r.lang_pred for r in languages.predict(odd, one).collect()} == {"und", "en"}


def test_all_of_many_languages_are_learned(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(280):
        words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(6)]
        rows += [(f"x{k:03d}", " ".join(rng.choice(words, 40))) for _ in range(2)]
    table = spark.createDataFrame(rows, "lang string, text string")
    got = languages.predict(table, languages.fit(table)).collect()
    assert len({r.lang for r in got if r.lang == r.lang_pred}) > 270


def test_three_relatives_are_told_apart():
    rng = np.random.default_rng(0)
    centre = rng.standard_normal((3, 20))
    y = np.repeat([0, 1, 2], 200)
    x = (centre[y] + 0.4 * rng.standard_normal((600, 20))).astype(np.float32)
    names = ["a", "b", "c"]
    machines = [(names[i], names[j], languages.fit_machine(x[(y == i) | (y == j)], np.where(y[(y == i) | (y == j)] == i, 1, -1).astype(np.float32))) for i, j in ((0, 1), (0, 2), (1, 2))]
    best, sure = languages.decide(x, names, machines)
    assert (best == y).mean() > 0.97 and ((sure >= 0) & (sure <= 1)).all()


# op2

HTML = [
    "<html lang='en'><head><title>A &amp; B\n</title><script>if (a<b) x()</script></head><body><p>One<br>two &lt;3&gt; &#233;</p><!-- no --><div>x <b>y</b>z</div></body></html>",
    None, "", "plain", "<p>open <script>never closed", "<!-- never closed <p>x", "a < b & c &nbsp; d", "<" * 5000 + "x", "<p" * 5000, "x" * 300000 + "&amp;" * 1000,
]
TEXT = ["One\ntwo <3> é\nx yz", "", "", "plain", "open", "", "a < b & c d", "<" * 5000 + "x", "<p" * 5000, "x" * 300000 + "&" * 1000]


def test_warc_records(spark, tmp_path):
    rows = [(k, f"http://e.org/{k}" if k else None, h, 1) for k, h in enumerate(HTML)] + [(3, "http://e.org/3", "plain", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, block int")
    records = warc.derivatives(warc.page_responses(pages), keep=("page_id",))
    got = records.collect()
    assert len(got) == 2 * len(rows)
    made = {(r.page_id, r.warc_type): r for r in got}
    for k, text in enumerate(TEXT):
        meta, conversion = made[k, "metadata"], made[k, "conversion"]
        if k != 8:
            assert conversion.block == text, k
        assert conversion.content_length == len(conversion.block.encode()) and meta.content_length == len(meta.block.encode())
        assert conversion.block_digest == "sha256:" + hashlib.sha256(conversion.block.encode()).hexdigest()
        assert conversion.source_digest == meta.source_digest == "sha256:" + hashlib.sha256((HTML[k] or "").encode()).hexdigest()
        assert conversion.refers_to == meta.refers_to and conversion.concurrent_to == meta.record_id and meta.concurrent_to == conversion.record_id
        assert meta.source_digest in meta.block and f"Content-Length: {len((HTML[k] or '').encode())}" in meta.source_headers
        assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-8[0-9a-f]{3}-8[0-9a-f]{3}-[0-9a-f]{12}>", meta.record_id)
    assert "title: A & B\r\n" in made[0, "metadata"].block and "languages-html: en\r\n" in made[0, "metadata"].block
    assert len({r.record_id for r in got}) == 2 * len(HTML)
    warc.write_records(records.where("page_id = 0"), f"{tmp_path}/out")
    import glob
    import gzip

    body = b"".join(gzip.open(p).read() for p in sorted(glob.glob(f"{tmp_path}/out/*.gz")))
    heads = [m.start() for m in re.finditer(rb"WARC/1\.1\r\n", body)]
    assert len(heads) == 2 and body.endswith(b"\r\n\r\n")
    for a, b in zip(heads, [*heads[1:], len(body)]):
        head, _, rest = body[a:b].partition(b"\r\n\r\n")
        assert int(re.search(rb"Content-Length: (\d+)", head)[1]) == len(rest) - 4
    assert warc.derivatives(warc.page_responses(pages.limit(0))).count() == 0


def test_plain_text_of_all_pages(spark, sf):
    """Against the standard library's parser, by words."""
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.hidden, self.out = 0, []

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in warc.HIDDEN.split()

        def handle_endtag(self, tag):
            self.hidden -= tag in warc.HIDDEN.split()

        def handle_data(self, data):
            if not self.hidden:
                self.out.append(data)

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for r in pages.withColumn("t", warc.plain_text(F.col("html"))).collect():
        parser = Words()
        parser.feed(r.html)
        parser.close()
        assert "".join("".join(parser.out).split()) == "".join(r.t.split()), r.page_id
        assert html.unescape("&amp;") == "&"


# pipeline

@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.settle(stage(spark, docs, sf), name)
        out.append((name, docs.toPandas(), after.toPandas()))
        docs = after
    return {name: (a, b) for name, a, b in out}


def test_stage_names_and_columns(stages):
    assert list(stages) == ["quality", "line_dedup", "near_dedup", "mixing", "bpe"]
    assert all(list(after) == corpus_pipeline.COLUMNS for name, (_, after) in stages.items() if name != "bpe")


def test_quality_stage_keeps_clean_documents(spark, sf, stages):
    before, after = stages["quality"]
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id")["quality"]
    kept = set(after["doc_id"])
    good, bad = [i for i in before["doc_id"] if labels.get(i) == 1], [i for i in before["doc_id"] if labels.get(i) == 0]
    assert sum(i in kept for i in good) >= 0.97 * len(good) and sum(i not in kept for i in bad) >= 0.8 * len(bad)
    assert after.merge(before).shape[0] == len(after)


def test_line_stage(stages):
    before, after = stages["line_dedup"]
    want = {i: t for i, _, gone, t in lines_by_force(list(zip(before["doc_id"], before["text"]))) if not gone or t.strip(" ")}
    assert dict(zip(after["doc_id"], after["text"])) == want and (after["n_chars"] == after["text"].str.len()).all()


def test_near_stage(stages):
    before, after = stages["near_dedup"]
    before = before.sort_values("doc_id")
    table, ids = weights(before["text"]), before["doc_id"].tolist()
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if table[i].keys() & table[j].keys() and similarity(table[i], table[j]) >= 0.8:
                x, y = sorted((find(ids[i]), find(ids[j])))
                root[y] = x
    assert sorted(after["doc_id"]) == [i for i in ids if find(i) == i]


def test_near_stage_of_odd_documents(spark):
    """Rows without doc_id stay, whatever they hold; a kept doc_id keeps each of its texts once."""
    odd = odd_documents(spark).unionByName(odd_documents(spark).where("doc_id = 16 or doc_id is null"))
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, odd, "").collect()), key=str)
    gone = {2, 12, 13}
    want = [(i, t) for i, t, _, _ in ODD_ROWS if i not in gone] + [(i, t) for i, t, _, _ in ODD_ROWS if i is None]
    assert got == sorted(want, key=str)


def test_mixing_stage(stages):
    before, after = stages["mixing"]
    words = lambda texts: texts.map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t)))
    size, taken = words(before["text"]).groupby(before["source"]).sum(), words(after["text"]).groupby(after["source"]).sum()
    assert abs(taken.sum() - 1.5 * size.sum()) <= len(size) and (taken <= 2 * size[taken.index]).all()
    assert after["doc_id"].value_counts().max() <= 2 and curriculum.REPEATS == 2


def test_bpe_stage(stages):
    before, after = stages["bpe"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((i, tokenizer.encode(t, add_special_tokens=False).ids) for i, t in zip(before["doc_id"], before["text"]))
    assert sorted(zip(after["doc_id"], map(list, after["ids"]))) == want


def test_pipeline_of_odd_documents(spark, tmp_path):
    odd_documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).where("n_tokens <> size(ids)").count() == 0
    empty_documents(spark).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
