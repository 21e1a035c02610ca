"""Prefix trie, decontamination and fill-in-middle against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from check import compare
from escalade.llm import decontamination, fill_middle, prefix_trie
from escalade.llm.frames import join_counted, settle
from escalade.llm.queries import ORACLE, QUERIES

from .fixtures import CLASHING, ODD_ROWS, PASSAGE, empty_documents, odd_documents, prose

SPACES = r"[^\x20\x09-\x0D]+"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# op11

def brute_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append((turn is not None, turn or 0, hashlib.md5((role + "\0" + text).encode()).digest(), role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    rebuilt = {}
    for c in own:
        base, h = c - int(np.fmod(c, 20)), zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    nodes = defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append(c)
    children = Counter(seq[:-1] for seq in nodes if seq)
    saved, leaves = Counter(), Counter()
    for seq, members in nodes.items():
        gain = (len(members) - 1) * len(re.findall(SPACES, seq[-1][1])) if seq else 0
        for d in range(len(seq) + 1):
            saved[seq[:d]] += gain
            leaves[seq[:d]] += children[seq] == 0
    return Counter(
        (min(m), len(seq), min(nodes[seq[:-1]]) if seq else None, len(m), children[seq], leaves[seq], saved[seq],
         sha(",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(seq)))) for seq, m in nodes.items()
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def odd_conversations():
    rows = [(c, t, "user" if t % 2 == 0 else "bot", f"turn {t} of {c % 3}") for c in range(60) for t in range(c % 6)]
    rows += [(c, 0, "system", "the same  start") for c in range(100, 160)]
    rows += [(61, None, None, None), (61, 0, "user", None), (61, 0, "user", ""), (61, 1, None, "a b"), (61, 1, None, "a b"), (None, 0, "user", "x"), (62, None, "user", "x")]
    rows += [(-5, t, "user", f"n{t}") for t in range(5)] + [(0, 9, "bot", "late")] + [(2**62 + k, 0, "user", "far") for k in range(3)]
    rows += [(200, t, "user", f"w {t % 7}") for t in range(500)] + [(201, t, "user", f"w {t % 7}") for t in range(499)]
    rows += [(k, 0, "user", "ties") for k in range(300, 320) for _ in range(4)]
    return rows


def trie_rows(df):
    return Counter(tuple(r) for r in df.select(*COLUMNS).collect())


def test_trie(spark):
    rows = odd_conversations()
    extra = ["depth", "part", "at", "m", "a", "n", "h", "words", "length"]
    df = spark.createDataFrame([(*r, *[7] * len(extra)) for r in rows], "conv_id long, turn long, role string, text string, " + ", ".join(f"{c} int" for c in extra))
    # A conversation of a third of all rows stands in several ranges, if these are not put together for being small.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    turns = prefix_trie.sorted_turns(df, 0, prefix_trie.BITS)
    assert turns.where("conv_id = 200").select("part").distinct().count() > 1 and turns.count() == len(rows) - 1
    assert trie_rows(prefix_trie.trie(df)) == brute_trie(rows)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert prefix_trie.trie(df.where("conv_id is null")).count() == 0
    alone = [(41, 0, "user", "only")]  # its head is taken from an absent base
    assert trie_rows(prefix_trie.trie(spark.createDataFrame(alone, "conv_id long, turn long, role string, text string"))) == brute_trie(alone)


def test_trie_starts_anew_after_collisions(spark):
    rows = [r for r in odd_conversations() if r[0] is None or r[0] < 200]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = prefix_trie.sorted_turns(df, 0, 3)
    paths, _ = prefix_trie.rebuilt_paths(turns)
    assert prefix_trie.collides(turns, paths)
    assert trie_rows(prefix_trie.trie(df, bits=3)) == brute_trie(rows)


def test_trie_sql_of_odd_rows(spark, tmp_path):
    rows = [r for r in odd_conversations() if r[0] is None or r[0] not in (200, 201)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert compare(QUERIES["op11_prefix_trie"](spark, str(tmp_path)).toPandas(), con.execute(ORACLE["op11_prefix_trie"]).df()) == ""


def test_maps_are_a_group():
    rng, p = np.random.default_rng(4), prefix_trie.PRIME
    x, y = (rng.integers(0, p, 200, dtype=np.uint64) for _ in range(2))
    x[:4], y[:4] = [0, 1, p - 1, p - 1], [p - 1, p - 1, p - 1, 1]
    assert prefix_trie.times(x, y).tolist() == [int(a) * int(b) % p for a, b in zip(x.tolist(), y.tolist())]
    a, b = (np.maximum(x, 1), y), (np.maximum(y, 1), x)
    back = prefix_trie.product(prefix_trie.product(a, b), prefix_trie.inverse(*b))
    assert back[0].tolist() == a[0].tolist() and back[1].tolist() == a[1].tolist()
    begins = np.repeat([0, 7, 50], [7, 43, 150])
    m, c = prefix_trie.scan(*a, begins)
    want = a[0][7:8], a[1][7:8]
    for k in range(8, 50):
        want = prefix_trie.product(want, (a[0][k:k + 1], a[1][k:k + 1]))
    assert (m[49], c[49]) == (want[0][0], want[1][0])


# op12

WORDS = re.compile(decontamination.WORDS)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_hits(docs, bench, size=10):
    windows = defaultdict(set)
    for item, text in bench:
        w = WORDS.findall(lowered(text))
        for i in range(max(len(w) - size, 0) + 1 if w else 0):
            windows[tuple(w[i:i + size])].add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w = WORDS.findall(lowered(text))
        hit, items = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i:i + n]))
                if found:
                    hit.update(range(i, i + n))
                    items |= found
        out.append((doc, len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit)))
    return out


BENCH = [(1, PASSAGE), (2, PASSAGE.upper() + " É x"), (2, "The other. of it"), (None, "a"), (10, ""), (11, None), (9, "... !"), (12, prose(50, 10)), (13, "ÄB c")]


def bench_table(spark):
    return spark.createDataFrame([(*b, 3) for b in BENCH], "item_id long, text string, list int")


def hit_documents():
    rows = [(i, t) for i, t, _, _ in ODD_ROWS]
    passage = PASSAGE.split()
    rows += [(100, "x " + " ".join(passage[5:15]) + " y " + " ".join(passage[14:40])), (101, "THE  other-of\nit"), (102, "äb c äB C"), (103, "ÄB C! " + prose(50, 10).upper())]
    rows += [(104, " ".join(passage[:9])), (105, "?! " + " ".join(passage[:12]) + " ?!"), (106, PASSAGE + " " + PASSAGE)] + [(107, PASSAGE)] * 3
    return rows


@pytest.mark.parametrize("max_windows", [decontamination.MAX_WINDOWS, 0])
def test_hits(spark, max_windows):
    rows = hit_documents()
    docs = spark.createDataFrame([(*r, *[7] * len(CLASHING)) for r in rows], "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in CLASHING))
    per_document, sets = decontamination.contaminated(docs, bench_table(spark), max_windows=max_windows)
    got = Counter()
    named = {tuple(r["lists"]): (r["n_items"], r["items_sha256"]) for r in sets.collect()}
    for r in per_document.withColumn("n_hit", decontamination.covered(F.col("places"))).collect():
        got[(r["doc_id"], r["n_words"], r["n_hit"], *named.get(tuple(r["lists"]), (0, sha(""))), r["n_hit"] > 0)] += r["copies"]
    assert got == Counter(brute_hits(rows, BENCH))
    assert sum(r[2] > 0 for r in got) > 6


def test_hits_query_of_odd_rows(spark, tmp_path):
    spark.createDataFrame(hit_documents(), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    bench_table(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    got = QUERIES["op12_decontamination"](spark, str(tmp_path))
    assert Counter(tuple(r) for r in got.collect()) == Counter(brute_hits(hit_documents(), BENCH))
    con = duckdb.connect()
    # Lists of all windows of a long text are slow there.
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet' WHERE doc_id IS DISTINCT FROM 9")
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{tmp_path}/benchmark.parquet/*.parquet'")
    assert compare(got.where("doc_id is null or doc_id <> 9").toPandas(), con.execute(ORACLE["op12_decontamination"]).df()) == ""
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.decontaminate(spark.createDataFrame(hit_documents(), "doc_id long, text string"), none).where("n_hit > 0").isEmpty()
    assert decontamination.decontaminate(empty_documents(spark), bench_table(spark)).isEmpty()


def test_hits_of_the_given_tables(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = Counter(tuple(r) for r in QUERIES["op12_decontamination"](spark, sf).collect())
    assert got == Counter(brute_hits([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in bench.select("item_id", "text").collect()]))


def test_removal(spark):
    rows = hit_documents()
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_hit int")
    left = decontamination.decontaminate(docs, bench_table(spark))
    text = defaultdict(list)
    for r in left.collect():
        text[r["doc_id"]].append((r["text"], r["n_hit"]))
    assert text[105] == [("?!  ?!", 12)] and text[104] == [(" ".join(PASSAGE.split()[:9]), 0)] and text[101] == [("", 4)] and text[107] == [(".", 60)] * 3
    assert text[7][0][0] == ODD_ROWS[7][1].replace(PASSAGE[:-1], "") and text[3] == [(None, 0)] and text[4] == [("", 0)]
    want = brute_hits(rows, BENCH)
    assert Counter((d, n) for d, ts in text.items() for _, n in ts) == Counter((w[0], w[2]) for w in want)
    whole = decontamination.decontaminate(docs, bench_table(spark), whole=True)
    assert Counter(r["doc_id"] for r in whole.collect()) == Counter(w[0] for w in want if not w[5])


def test_the_scan_has_no_python(spark, sf):
    plan = QUERIES["op12_decontamination"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan


def test_hot_keys_are_joined_by_broadcast(spark):
    rows = settle(spark.range(30000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), "id"), "rows")
    rows = rows.unionByName(spark.createDataFrame([(None, -1)], "k long, id long"))
    table = settle(rows.where("k is not null and k <> 10").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top")), "table")
    for how in ("inner", "left"):
        got = join_counted(rows, table, "k", how=how)
        assert Counter(tuple(r) for r in got.collect()) == Counter(tuple(r) for r in rows.join(table.drop("n"), "k", how).select(*got.columns).collect())
    assert got.count() == rows.count()


# op13

def brute_middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = sha("42:" + ("" if doc_id is None else str(doc_id)))
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, n, form, len(prefix), len(middle), sha(out), sha(text)


def test_middles(spark, sf):
    odd = [(i, t) for i, t, _, _ in ODD_ROWS] + [(300 + k, t) for k, t in enumerate(["<P> a", "a <M", " ", " a", "a ", "\x1c é\x0b\x0b x　y  ", "<S>", "a\n\n"] * 8)]
    given = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    for rows in (odd, given):
        df = spark.createDataFrame([(*r, *[7] * 8) for r in rows], "doc_id long, text string, row int, rank int, place int, piece int, n int, form int, h1 int, output_sha256 int")
        got = Counter(tuple(r) for r in fill_middle.digests(df).collect())
        assert got == Counter(brute_middle(*r) for r in rows)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}
    assert fill_middle.digests(empty_documents(spark)).count() == 0
    named = spark.createDataFrame([("a1", "x y z w"), (None, "x y")], "doc_id string, text string")
    assert Counter(tuple(r) for r in fill_middle.digests(named).collect()) == Counter([brute_middle("a1", "x y z w"), brute_middle(None, "x y")])


def test_outputs_are_texts(spark):
    text = prose(70, 40000)
    df = spark.createDataFrame([(k, text if k == 5 else prose(k, 30)) for k in range(40)], "doc_id long, text string")
    pieces = fill_middle.assembled(fill_middle.cut_texts(df, rate=100)).collect()
    outputs = defaultdict(bytes)
    for p in pieces:
        outputs[p["row"]] += p["piece"]
        assert len(p["piece"]) <= fill_middle.PIECE_BYTES
    assert len(outputs) == 40 and len(pieces) > 220
    digests = {r["output_sha256"] for r in fill_middle.digests(df, rate=100).collect()}
    assert {hashlib.sha256(o).hexdigest() for o in outputs.values()} == digests


def _traced(run):
    """The result, and the greatest number of bytes that Python and numpy held meanwhile."""
    import tracemalloc

    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def _block_of(texts, length=50, gram=25):
    import pyarrow as pa

    from escalade.llm import suffix_dedup

    body = b"".join(texts)
    table = pa.table({
        "n": [len(texts)], "ids": [suffix_dedup.pack(np.arange(len(texts)))], "lengths": [suffix_dedup.pack(np.array([len(t) for t in texts]))],
        "size": [len(body)], "body": [pa.compress(body, codec="zstd", asbytes=True)],
    })
    return suffix_dedup.Block(table, length, gram, 4)


def test_common_strings_are_one_segment_each_and_take_little_memory():
    from escalade.llm import arrays, suffix_dedup

    rng = np.random.default_rng(5)
    common = rng.integers(97, 123, 1500).astype(np.uint8).tobytes()
    texts = [common + rng.integers(97, 123, 30).astype(np.uint8).tobytes() for _ in range(400)]
    block = _block_of(texts)
    flags = np.where(block.counts >= 300, suffix_dedup._COMMON, np.where(block.counts >= 2, suffix_dedup._SHARED, suffix_dedup._NONE))
    block.segments(flags)  # the powers of the hash are kept from here on
    arrays.powers(len(block.data) + 1)
    found, peak = _traced(lambda: block.segments(flags))
    # Every occurrence leads to a segment of the same bytes, equal bytes to one segment, and the least id is that of the first text.
    body = block.data.tobytes()
    seen = {}
    for at, of in list(zip(found.at.tolist(), found.of.tolist()))[:: 37]:
        own = body[at:at + int(found.size[of])]
        assert own == body[int(found.start[of]):int(found.start[of]) + int(found.size[of])]
        assert seen.setdefault((int(found.key[of]), int(found.left[of]), own), of) == of
    assert len(found.start) < 10_000 and len(found.at) > 500_000
    assert set(found.least[found.of[found.at < 1400]].tolist()) == {0}
    assert peak / len(found.at) < 80


def test_segments_that_only_look_equal_stay_apart():
    from escalade.llm import suffix_dedup

    data = np.frombuffer(b"aaaabbbbaaaabbbb", np.uint8)
    start, size, left = np.array([0, 4, 8, 12]), np.full(4, 4), np.zeros(4, np.int64)
    same = np.full(4, 7, np.uint64)
    found = suffix_dedup.distinct_segments(data, start, size, left, same, same, np.array([3, 2, 1, 0]))
    for at, of in zip(found.at.tolist(), found.of.tolist()):
        assert data[at:at + 4].tobytes() == data[found.start[of]:found.start[of] + 4].tobytes()
    assert found.least[found.of].tolist() == [1, 2, 1, 0]


def test_a_block_of_words_takes_little_memory():
    import pyarrow as pa

    from escalade.llm import word_bpe

    rng = np.random.default_rng(7)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8)).decode() for _ in range(3000)]
    texts = pa.array([" ".join(rng.choice(words, 400)) for _ in range(3000)])
    word_bpe.Block(texts.slice(0, 500), 0, 8 << 20)
    block, peak = _traced(lambda: word_bpe.Block(texts, 0, 8 << 20))
    assert block.last == len(texts) and sum(block.counts) == len(block.numbers) > 1_000_000
    assert peak / len(block.numbers) < 60


def test_words_of_a_block_are_numbered_in_place():
    import pyarrow as pa

    from escalade.llm import word_bpe

    rng = np.random.default_rng(8)
    hashes = rng.integers(0, 1 << 12, 100_000).astype(np.uint64)
    of, head, often = word_bpe._numbered(hashes)
    values, first, number, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    assert (of == number).all() and (head == first).all() and (often == counts).all() and (hashes[head] == values).all()
    texts = pa.array([" ".join(rng.choice(["ab", "cde", "fghi", "jklmnop"], 400)) for _ in range(3000)])
    word_bpe.Block(texts.slice(0, 500), 0, 8 << 20)
    block, peak = _traced(lambda: word_bpe.Block(texts, 0, 8 << 20))
    assert block.last == len(texts) and len(block.numbers) > 1_000_000
    assert peak / len(block.numbers) < 40


def test_stages_hand_small_batches_to_workers(spark):
    import corpus_pipeline
    from escalade.llm import frames

    before = spark.conf.get(frames.BATCH_SETTING)
    try:
        for rows, left in (("10000", frames.BATCH_ROWS), ("0", frames.BATCH_ROWS), ("7", 7)):
            spark.conf.set(frames.BATCH_SETTING, rows)
            docs = spark.createDataFrame([(k, "a few words", None, None, 11) for k in range(3)], "doc_id long, text string, lang string, source string, n_chars long")
            corpus_pipeline.encode_texts(spark, docs, "")
            assert int(spark.conf.get(frames.BATCH_SETTING)) == left
    finally:
        spark.conf.set(frames.BATCH_SETTING, before)


def test_anchors_of_a_block_take_little_memory():
    import pyarrow as pa

    from escalade.llm import suffix_dedup

    rng = np.random.default_rng(9)
    texts = [bytes(rng.integers(97, 123, 3000).astype(np.uint8)) for _ in range(1000)]
    (row,) = suffix_dedup._packed_texts()(iter([pa.RecordBatch.from_pydict({
        "k": pa.array(range(1000), pa.int64()), "block": pa.array([0] * 1000, pa.int64()), "text": pa.array([t.decode() for t in texts]),
    })]))
    block, peak = _traced(lambda: suffix_dedup.Block(pa.Table.from_batches([row]), 50, 25, 3))
    assert block.data.tobytes() == b"".join(texts) and (block.anchors[block.anchor_of] == block.runs.anchor).all()
    assert (block.ids[block.doc] == block.runs.first // 3000).all() and (block.counts == 1).all()
    assert peak / len(block.data) < 13


def test_ranges_of_every_size_are_compared():
    from escalade.llm.arrays import equal_bytes

    rng = np.random.default_rng(10)
    for n in (0, 5, 8, 200):
        data = rng.integers(0, 2, n).astype(np.uint8)
        data[n // 2:n // 2 * 2] = data[:n // 2]
        size = rng.integers(0, n // 2 + 1, 3000)
        a = rng.integers(0, n // 2 - size + 1)
        b = a + rng.choice([n // 2, 0, (n - n // 2 * 2)], 3000)
        want = [data[x:x + s].tobytes() == data[y:y + s].tobytes() for x, y, s in zip(a, b, size)]
        assert equal_bytes(data, a, b, size).tolist() == want
        flipped = data.copy()
        for k in np.flatnonzero(size)[:40]:
            # One byte in the range at b decides, wherever it stands.
            flipped[b[k] + size[k] - 1] ^= 1
            same = flipped[a[k]:a[k] + size[k]].tobytes() == flipped[b[k]:b[k] + size[k]].tobytes()
            assert equal_bytes(flipped, a[k:k + 1], b[k:k + 1], size[k:k + 1]).tolist() == [same]


def test_chunks_read_every_kind_of_text():
    import pyarrow as pa

    from escalade.llm import arrays

    texts = ["ab", "", None, "déf", "x" * 9, "z"]
    for kind in (pa.string(), pa.large_string(), pa.binary(), pa.large_binary(), pa.string_view()):
        for values in (texts, [t or "" for t in texts]):
            column = pa.array(values, pa.string()).cast(kind).slice(1)
            got = [c.data[a:b].tobytes() for c in arrays.chunks(column, 4) for a, b in zip(c.offsets, c.offsets[1:])]
            assert got == [(t or "").encode() for t in texts[1:]]
