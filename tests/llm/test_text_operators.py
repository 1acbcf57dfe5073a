"""Encoding, the token store, media columns, licences, chats and quality scores, against libraries or brute force."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hostlens.llm import bpe, chat, licenses, media, pieces, quality, queries, token_store
from hostlens.llm._common import strings

tokenizers = pytest.importorskip("tokenizers")
DOCS = "doc_id long, text string, lang string, media string, ids int"


def odd_texts():
    rng = random.Random(1)
    letters = " \n\t  ab'sé中🙂1²,.!?aA \x1c\x85"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(800)]
    texts += ["".join(rng.choice("abcdeft hints") for _ in range(200)) for _ in range(60)]
    return [*texts, "aaaaaaaaaa" * 50, "<|endoftext|>", "foo  <|endoftext|> bar", "don't  x   y \n\n z", " ", "  ", "\n", ""]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe.tokenizer_path())


def test_prefix_encoder_equals_the_library(library):
    encoder = bpe.PrefixEncoder(bpe.tokenizer_path())
    for text in odd_texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == ids and encoder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_pieces_equal_whole_texts(library):
    texts = odd_texts()
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for encoder in (bpe.prefix_encoder(bpe.tokenizer_path())[1], token_store.library_encoder(bpe.tokenizer_path())):
        for _ in range(2):  # the second time from the cache
            ids, counts = encoder(texts)
            assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]
    forgetful = pieces.PieceEncoder(lambda ts: pieces.runs([library.encode(t, add_special_tokens=False).ids for t in ts.to_pylist()]), ("<|endoftext|>",), most=3)
    for t, w in zip(texts[:50], want, strict=False):
        assert forgetful([t])[0].tolist() == w


def test_encode_and_decode_columns(spark):
    df = spark.createDataFrame([(1, "héllo  world", "en", "m", 7), (2, None, None, None, None), (2, "", "x", "", 0), (None, "long " * 30_000, "en", None, 1)], DOCS)
    rows = bpe.decode(bpe.encode(df)).collect()
    assert sorted(r.decoded or "" for r in rows) == sorted(["héllo  world", "", "", "long " * 30_000])
    assert {r.n_tokens for r in rows if not r.decoded} == {0} and all(len(r.ids) == 4 * r.n_tokens for r in rows)
    assert rows[0].media is not None and bpe.encode(df.limit(0)).count() == 0


@pytest.mark.parametrize("ids", [[], [2], [0, 2**32 - 1, 5] * 100, list(range(256)), [7] * 300, [1] * 255 + [2**31]])
def test_image_round_trip(ids):
    image = token_store.encode_image(np.array([5]), np.array([len(ids)]), np.array(ids, np.uint32))
    docs, counts, back = token_store.decode_image(image)
    assert (docs.tolist(), counts.tolist(), back.tolist()) == ([5], [len(ids)], ids)


def test_any_block_reads_alone():
    ids = np.random.default_rng(0).geometric(0.001, 5000).astype(np.uint32)
    image = token_store.encode_image(np.array([1]), np.array([5000]), ids)
    assert token_store.decode_image(image, 3, 5)[2].tolist() == ids[768:1280].tolist() and len(image) < 5000 * 2
    with pytest.raises(ValueError):
        token_store.decode_image(image[:-1])


def test_store(spark, library):
    texts = {9: "a b c", 3: None, 4: "", 70: "hello world " * 500, 1: "x"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    start = 0
    rows = {r.doc_id: r for r in token_store.read_store(spark, token_store.write_store(df)).collect()}
    for i in sorted(texts):
        ids = [*library.encode(texts[i] or "", add_special_tokens=False).ids, 2]
        assert (rows[i].start, rows[i].n_tokens, zlib.crc32(rows[i].ids)) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_store.read_store(spark, token_store.write_store(df.limit(0))).count() == 0


@pytest.mark.parametrize("row_filter", range(5))
@pytest.mark.parametrize("pixel", [1, 3])
def test_png_round_trip(row_filter, pixel):
    data = np.random.default_rng(row_filter).integers(0, 256, 192 * 9, dtype=np.uint8).tobytes()
    png = media.encode_png(data, pixel, row_filter=row_filter)
    rows, got = media.decode_png(png)
    assert rows.tobytes() == data and got == pixel
    for bad in (png[:-5], png[:40] + b"\x00" + png[41:], b"no" + png):
        with pytest.raises((ValueError, zlib.error)):
            media.decode_png(bad)


def test_media_columns(spark):
    df = spark.createDataFrame([(1, "abc", "en", "old", 7), (2, "abc", "fr", None, 1), (3, None, None, None, None), (4, "z" * 5000, "en", "", 1)], DOCS)
    rows = {r.doc_id: r for r in media.read_png(media.with_png(df)).collect()}
    want = b"abc" + b" " * 189
    assert (rows[1].n_bytes, rows[1].payload_bytes, rows[1].payload_sha256, rows[1].tail_crc32) == (3, 192, hashlib.sha256(want).hexdigest(), zlib.crc32(b" " * 16))
    assert rows[1][-3:] == rows[2][-3:] and rows[3].payload_bytes == 192 and rows[3].n_bytes == 0 and rows[4].payload_bytes == 5184 and rows[1].ids == 7
    broken = spark.createDataFrame([(1, b"junk"), (2, None)], "doc_id long, media binary")
    assert all(r.feature is None for r in media.read_png(broken, strict=False).collect())


def test_hash_changes_little_with_the_text():
    a, b, c = ("lorem ipsum dolor " * 300, "lorem ipsum dolor " * 299 + "lorem ipsum dolxr ", "ZZZZ 12345 !!!! " * 300)
    bits = [int(media.cosine_hash(*media.decode_png(media.encode_png(media.padded(x.encode())))), 16) for x in (a, b, c)]
    assert bin(bits[0] ^ bits[1]).count("1") < bin(bits[0] ^ bits[2]).count("1")


def test_licences(spark):
    mit = licenses.KNOWN["MIT"]
    changed = "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace("LICENSE", "LICENCE").replace(",", " ,") + "\n\tAll rights reserved.\n"
    rows = [(1, mit), (2, changed), (3, mit + " also"), (4, None), (5, "..."), (6, ""), (7, "# Copyright 2001 X\nReleased under the MIT Licence!"), (7, "other")]
    got = sorted((r.doc_id, r.license_id) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.license_id)
    assert got == [(1, "MIT"), (2, "MIT"), (7, "notice-MIT")]
    known = spark.createDataFrame([("b", "same text"), ("a", "SAME  text."), (None, None)], "name string, text string")
    r = licenses.scan(spark.createDataFrame([(1, "same, text")], "doc_id long, text string"), known).first()
    assert r.license_id == "a" and licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").limit(0)).count() == 0
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [list(r) for r in rows])
    assert sorted(map(repr, con.execute(licenses.scan_sql()).fetchall())) == sorted(repr(tuple(r)) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_licences_as_published(spark):
    import textwrap

    notice = "Copyright (c) 2024, Some Body\n\n"
    wrap = lambda t, n=76: "\n".join(textwrap.fill(x, n) for x in t.split("\n"))
    isc = licenses.KNOWN["ISC"].replace("copyright notice and this", "\ncopyright notice and this", 1)
    rows = [(1, "ISC", "ISC License\n\n" + notice + isc), (2, "MIT", "MIT License\n\n" + notice + wrap(licenses.KNOWN["MIT"])), (3, "MIT", "The MIT License (MIT)\nCopyright © 2001 X\n" + wrap(licenses.KNOWN["MIT"], 60)), (4, None, "copyright notice")]
    for n in range(50, 90):
        rows += [(n * 10 + k, name, "\n\n".join([title, notice, wrap((licenses.KNOWN | licenses.MORE)[name], n)])) for k, (name, title) in enumerate([("BSD-3-Clause", "BSD 3-Clause License"), ("ISC", "ISC License"), ("BSD-2-Clause", "BSD 2-Clause License"), ("Unlicense", ""), ("MIT", "")])]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")).collect()}
    assert {i: got[i].license_id for i, _, _ in rows} == {i: name for i, name, _ in rows} and got[4].digest is not None
    con = pytest.importorskip("duckdb").connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [[i, t] for i, _, t in rows])
    assert {i: (d, n) for i, d, n in con.execute(licenses.scan_sql()).fetchall()} == {i: (r.digest, r.license_id) for i, r in got.items()}


def test_long_licences(spark):
    from pathlib import Path

    files = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}
    folder, end = Path("/usr/share/common-licenses"), "END OF TERMS AND CONDITIONS"
    texts = [(name, (folder / file).read_text()) for name, file in files.items() if (folder / file).exists()]
    if not texts:
        pytest.skip("no licence texts on this machine")
    texts += [(name, t[: t.index(end)] + end) for name, t in texts if len(licenses.LONG[name]) > 1]
    # Upper case, other line lengths and an added copyright line are the same wording; a word less is another.
    rows = [(k, t.upper() if k % 2 else " \n".join(t.split("\n")) + "\nCopyright (c) 2020 Somebody") for k, (_, t) in enumerate(texts)]
    got = {r.doc_id: r.license_id for r in licenses.scan(spark.createDataFrame([*rows, (99, rows[0][1].replace("Work", "", 1)), (None, rows[0][1])], "doc_id long, text string").withColumn("digest", F.lit("x"))).collect()}
    assert [got[k] for k in range(len(rows))] == [name for name, _ in texts] and got[99] is None and got[None] == texts[0][0]


def test_chats(spark):
    rows = [(1, 0, "u", "Hello there\nsecond line\n\nNew para"), (1, 1, "a", "> hello  THERE\n> second line\n\nmy answer"), (1, 2, "u", ">> Hello there\n>> second line\n> my answer\n\nok"),
            (1, 3, "u", "> nothing known\nx"), (1, 4, "z", None), (None, 1, "q", "> a"), (2, 0, "u", ">>>"), (1, 5, "u", "> new para\nyes"), (1, 6, "u", "> later"), (1, 7, "u", "later")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("level", F.lit(1)).withColumn("path", F.lit("x"))
    got = {(r.conv_id, r.turn): r for r in chat.format_chat(df).collect()}
    assert [got[1, t].parent_turn for t in range(8)] == [None, 0, 1, None, None, 0, None, None]
    assert sorted(range(8), key=lambda t: got[1, t].reply_path) == [0, 1, 2, 5, 3, 4, 6, 7]
    assert got[1, 2].depth == 2 and (got[1, 2].n_quotes, got[1, 2].n_linked) == (2, 2) and got[1, 2].text == "ok" and got[1, 4].text == "" and got[2, 0].text == ""
    assert chat.format_chat(df.limit(0)).count() == 0
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", [list(r) for r in rows if r[0] is not None])
    columns = ["conv_id", "turn", "role", "parent_turn", "depth", "reply_path", "n_quotes", "n_linked", "text"]
    assert sorted(map(repr, con.execute(queries.OP4_SQL).fetchall())) == sorted(repr(tuple(r[c] for c in columns)) for r in got.values() if r.conv_id is not None)


def test_long_threads(spark):
    rows = [(1, t, "u", f"> line {t - 1}\nline {t}") for t in range(40)]
    got = {r.turn: r for r in chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[39].depth == 39 and [int(x) for x in got[39].reply_path.split(".")] == list(range(40))


def test_conversations_come_in_order(spark, tmp_path):
    """The registered query on threads of more than ten turns, with negative and repeated ones."""
    rows = [(7, 0, "u", "root"), *[(7, t, "a", f"> root\nreply {t}") for t in range(1, 14)], (7, 14, "u", "> reply 2\nto two"), (7, 15, "u", "> reply 11\nto eleven"), (7, 16, "u", "> to two\nagain")]
    rows += [(8, -3, "u", "early"), (8, -20, "u", "earlier"), (8, 4, "u", "> early\nlate"), (8, 4, "u", "> early\nlate"), (9, 10**15, "u", "far")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = [(r.conv_id, r.turn) for r in queries.op4_chat_format(spark, str(tmp_path)).collect()]
    assert got == [(7, t) for t in [0, 1, 2, 14, 16, 3, 4, 5, 6, 7, 8, 9, 10, 11, 15, 12, 13]] + [(8, -20), (8, -3), (8, 4), (8, 4), (9, 10**15)]
    assert {r.n_linked for r in queries.op4_chat_format(spark, str(tmp_path)).where("turn = 16").collect()} == {1}


def test_chat_stays_in_the_engine(spark):
    plan = chat.format_chat(spark.createDataFrame([(1, 0, "u", "x")], "conv_id long, turn long, role string, text string"))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


def test_statistics_ignore_neighbours():
    texts = ["Plain words here. And more!", "", "SHOUT!! SHOUT!!", "a | b | c\nd", "é ü", "x " * 500]
    together = quality.statistics(*strings(pa.array(texts)))
    alone = np.concatenate([quality.statistics(*strings(pa.array([t]))) for t in texts])
    assert together.shape == (6, len(quality.STATISTICS)) and np.allclose(together, alone) and np.isfinite(together).all() and not together[1].any()


def test_isotonic():
    assert quality.isotonic(np.array([1.0, 3.0, 2.0, 4.0]), np.ones(4)).tolist() == [1.0, 2.5, 2.5, 4.0]
    assert quality.isotonic(np.array([3.0, 1.0]), np.array([1.0, 3.0])).tolist() == [1.5, 1.5]


def test_quality_learns_and_holds_out(spark):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["the", "cat", "sat", "on", "mats", "quietly", "and", "slept"]) for _ in range(rng.randint(20, 200))) + "."
    bad = lambda: " ".join(rng.choice(["BUY!!", "NOW###", "$$$", "|", "CLICK!!"]) for _ in range(rng.randint(20, 200)))
    rows = [(i, bad() if i % 4 == 0 else good()) for i in range(600)] + [(900, None), (901, ""), (None, "x"), (902, "word " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1) for i in range(600)] + [(1, None), (2, 7), (None, 1)], "doc_id long, quality int")
    model = quality.fit_on_labels(docs, labels)
    score = {r.doc_id: r.score for r in quality.scored(docs, model).collect()}
    held = [i for i in range(600) if quality.crc_fold(i) == 2]
    assert all((score[i] >= quality.THRESHOLD) == (i % 4 != 0) for i in held) and all(0 <= s <= 1 for s in score.values())
    # Held-out labels and labels themselves have no say.
    turned = labels.withColumn("quality", F.when(quality.fold("doc_id") == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in quality.scored(docs, quality.fit_on_labels(docs, turned)).collect()} == score
    none = quality.fit_on_labels(docs, labels.limit(0))
    assert {r.score for r in quality.scored(docs, none).collect()} == {0.5} and quality.scored(docs.limit(0), model).count() == 0


def test_quality_is_the_same_however_rows_are_dealt(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["the", "cat", "BUY!!", "mats.", "|", "12", "quietly"]) for _ in range(rng.randint(0, 60)))) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("cat" in t)) for i, t in rows], "doc_id long, quality int")
    runs = []
    for n in (1, 3, 7):
        model = quality.fit_on_labels(docs.repartition(n), labels.repartition(n + 1))
        runs.append({r.doc_id: r.score for r in quality.scored(docs.repartition(2 * n), model).collect()})
    assert runs[0] == runs[1] == runs[2]
    # Repeated labels count once; a document with both labels is not learned from.
    again = labels.unionByName(labels.where("doc_id < 50")).unionByName(labels.where("doc_id < 20"))
    assert {r.doc_id: r.score for r in quality.scored(docs, quality.fit_on_labels(docs, again)).collect()} == runs[0]
    both = labels.where("doc_id >= 100").unionByName(labels.where("doc_id = 50")).unionByName(spark.createDataFrame([(50, 0), (50, 1)], labels.schema))
    assert {r.doc_id: r.score for r in quality.scored(docs, quality.fit_on_labels(docs, both)).collect()} == {r.doc_id: r.score for r in quality.scored(docs, quality.fit_on_labels(docs, labels.where("doc_id >= 100"))).collect()}


def test_ridge_and_isotonic_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 2, (400, len(quality.STATISTICS)))
    y = (x[:, 0] + 0.3 * rng.normal(size=400) > 0.8).astype(int)
    rows = [(i, x[i].tolist(), int(y[i]), i % 4 == 3) for i in range(400)]
    model = quality.fit(spark.createDataFrame(rows, "id int, statistics array<double>, label int, calibrate boolean").repartition(3))
    # Ridge regression as a least-squares problem with one row for each penalty, on plain cosines in double precision.
    mean, scale = x.mean(axis=0), x.std(axis=0)
    assert np.allclose(model.mean, mean, atol=1e-3) and np.allclose(model.scale, scale, atol=1e-3)
    z = np.cos(((x - model.mean) / model.scale) @ model.frequency + model.phase) * np.sqrt(2 / model.features)
    z = np.column_stack([z, np.ones(400)])
    share, fit = y.mean(), np.arange(400) % 4 != 3
    root = np.sqrt(np.where(y == 1, 1 / (2 * share), 1 / (2 * (1 - share))))
    penalties = np.sqrt(np.append(np.full(model.features, quality.RIDGE), 1e-9))
    weights = np.linalg.lstsq(np.concatenate([z[fit] * root[fit, None], np.diag(penalties)]), np.concatenate([(y[fit] - 0.5) * root[fit], np.zeros(len(penalties))]), rcond=None)[0]
    assert np.abs(model.raw(x) - z @ weights).max() < 1e-3
    # The isotonic fit at i is the largest over starts up to i of the smallest over ends from i of the mean between them.
    value, weight = rng.uniform(size=40) + np.arange(40) / 40, rng.integers(1, 9, 40).astype(float)
    mean_of = lambda a, b: np.average(value[a : b + 1], weights=weight[a : b + 1])
    want = [max(min(mean_of(a, b) for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    assert np.allclose(quality.isotonic(value, weight), want)
