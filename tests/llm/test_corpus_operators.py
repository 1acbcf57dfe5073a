"""Near copies, repeated passages, mixing, components and the pipeline, against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostlens.llm import embedding, mixing, ngram_join, suffix_dedup
from hostlens.llm.components import components, forest

TEXTS = "doc_id long, text string"


def joined(links):
    label = {}

    def root(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return {x: root(x) for x in label}


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)] + [(5, 5), (1, 0)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    want = joined([e for e in edges if e[0] != e[1]])
    assert got == {k: v for k, v in want.items() if k in got} and set(got) == {x for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    v, r = forest(np.array([3, 9, 4]), np.array([2, 4, 3]))
    assert dict(zip(v.tolist(), r.tolist(), strict=True)) == {2: 2, 3: 2, 4: 2, 9: 2}


def brute_jaccard(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    found, links = {}, []
    for i, s in sets.items():
        shared = Counter(j for g in s for j in found.get(g, ()))
        links += [(i, j) for j, n in shared.items() if den * n >= num * (len(s) + len(sets[j]) - n)]
        for g in s:
            found.setdefault(g, []).append(i)
    group = joined(links)
    return {i: (len(s), group.get(i, i)) for i, s in sets.items()}


def near_copies():
    rng = random.Random(3)
    words, rows = [f"w{i}" for i in range(400)], []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([3, 5, 9, 20, 60, 150, 400]))]
        for _ in range(rng.choice([1, 2, 4, 12])):
            x = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(x) // 30, len(x) // 60])):
                x[rng.randrange(len(x))] = rng.choice(words)
            rows.append((len(rows), " ".join(x[: max(1, len(x) - rng.choice([0, 0, len(x) // 20]))])))
    return rows + [(9000, None), (9001, ""), (9002, "a"), (9003, "A\n"), (9004, " \t "), (9005, "a b"), (9006, "a b c"), (9007, "long word " * 20_000)]


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 8, 10)])
def test_jaccard_join(spark, k, num, den):
    rows = near_copies()
    df = spark.createDataFrame(rows, TEXTS).withColumn("id", F.lit(1)).withColumn("n", F.lit("x")).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df, k=k, num=num, den=den).collect()}
    assert got == brute_jaccard(rows, k, num, den)


def test_jaccard_edges(spark):
    df = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (2, None)], TEXTS)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df, k=3).collect()), key=repr)
    assert got == [(2, 0, 2), (4, 1, 4), (4, 1, 4), (None, 1, None)]
    assert ngram_join.jaccard_components(df.limit(0)).count() == 0


def test_jaccard_group_of_copies_that_hardly_link_makes_no_pairs(spark, monkeypatch):
    rng = random.Random(4)
    base, rows = [f"w{rng.randrange(5000)}" for _ in range(304)], []
    for i in range(160):  # two copies share 265 of 300 shingles, 267 would link them; only those of one number share 270
        x = list(base)
        for at in range(20, 300, 40):
            x[at] = f"x{i // 2}" if at == 20 and i < 40 else f"y{i}-{at}"
        rows.append((i, " ".join(x)))
    made, saved = {}, ngram_join.saved

    def counted(df, what="table", into=None):
        out = saved(df, what, into)
        made[what] = max(made.get(what, 0), out.count())
        return out

    monkeypatch.setattr(ngram_join, "saved", counted)
    monkeypatch.setattr(ngram_join, "SETS", 9_000, raising=False)  # several cells
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(spark.createDataFrame(rows, TEXTS), k=5, num=8, den=10).collect()}
    assert got == brute_jaccard(rows, 5, 8, 10)
    assert 0 < made["rest"] <= 8 * len(rows), made


def test_every_near_pair_shares_a_leaf():
    rng = np.random.default_rng(8)
    for num, den in ((9, 10), (8, 10)):
        parts = ngram_join.Parts(num, den)
        for n in (1, 2, 5, 11, 40, 64, 90, 300, 1500):
            for _ in range(30):
                a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
                d = int(n * (den - num) / num)
                drop = rng.integers(0, d + 1)
                b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, max(0, d - drop)).astype(np.uint64) * np.uint64(2)]))
                same = len(np.intersect1d(a, b))
                if not same * den >= num * (len(a) + len(b) - same):
                    continue
                doc = np.repeat([0, 1], [len(a), len(b)])
                texts, keys = parts.keys(doc, np.concatenate([a, b]), np.array([len(a), len(b)]))
                assert np.intersect1d(keys[texts == 0], keys[texts == 1]).size, (n, num)


def brute_repeats(rows, length):
    first = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        if i is not None:
            for j in range(len(b) - length + 1):
                w = b[j : j + length]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1 if i is not None else 0):
            if first[b[j : j + length]] < i:
                gone[j : j + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out.append((i, len(b), sum(gone), sum(1 for x in range(len(gone)) if gone[x] and not (x and gone[x - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("length", "gram", "hot"), [(50, 24, 200_000), (20, 8, 2), (33, 13, 1)])
def test_repeats(spark, length, gram, hot):
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    passages = [noise(rng.choice([49, 50, 51, 80, 200])) for _ in range(12)]
    rows = [(i * 3 % 151, "".join(rng.choice([noise(rng.randrange(60)), rng.choice(passages), rng.choice(passages)[rng.randrange(20) :]]) for _ in range(rng.randrange(8)))) for i in range(120)]
    rows += [(500, "a" * 300), (501, "a" * 120), (499, "a" * 60), (None, "a" * 80), (600, None), (601, ""), (602, rows[3][1]), (602, rows[3][1]), (603, "xy" * 100), (604, "yx" * 90), (605, rows[7][1])]
    df = spark.createDataFrame(rows, TEXTS).withColumn("unit", F.lit(0)).withColumn("bucket", F.lit(None)).repartition(5)
    got = sorted((tuple(r) for r in suffix_dedup.remove_repeats(df, length=length, gram=gram, hot_runs=hot).collect()), key=repr)
    assert got == brute_repeats(rows, length)
    kept = suffix_dedup.remove_repeats(df, length=length, gram=gram, keep_text=True).collect()
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in kept) and len(kept) == len(rows)
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(150, 16))
    x = np.concatenate([base, base[:60] + rng.normal(size=(60, 16)) * 0.15, np.repeat(base[:1], 40, axis=0), base[:1] * 3 + rng.normal(size=(30, 16)) * 0.05])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).repartition(4)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = u @ u.T >= 0.9
    group = joined([(int(a), int(b)) for a, b in zip(*np.nonzero(hit), strict=True) if a != b])
    got = {r.vec_id: r for r in embedding.near_duplicates(df).collect()}
    assert all(got[i].n_links == hit[i].sum() - 1 and got[i].component_id == group.get(i, i) and got[i].kept == (group.get(i, i) == i) for i in range(len(x)))


def test_embeddings_of_few_directions(spark):
    """Vectors of 100 and 64 components that vary in two directions only: neighbours lie straight across borders."""
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for dims in (100, 64):
        plane = np.linalg.qr(rng.normal(size=(dims, 3)))[0]
        x = np.column_stack([rng.normal(size=(400, 2)), np.full(400, 0.5)]) @ plane.T
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        hit = u @ u.T >= 0.9
        at = len(rows)
        group = joined([(int(a), int(b)) for a, b in zip(*np.nonzero(hit), strict=True) if a != b])
        want |= {at + i: (hit[i].sum() - 1, at + group.get(i, i)) for i in range(400)}
        rows += [(at + i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    assert {r.vec_id: (r.n_links, r.component_id) for r in embedding.near_duplicates(df).collect()} == want


def test_odd_vectors(spark):
    rows = [[1.0, 0.0], [2.0, 0.0], [0.0, 0.0], None, [1.0, None], [float("nan"), 1.0], [1e-200, 1e-200], [1e200, 1.1e200], [0.95, 0.1], [], [1.0, 0.0, 0.0], [float("inf"), 0.0]]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    got = [(r.n_links, r.component_id) for r in embedding.near_duplicates(df).orderBy("vec_id").collect()]
    assert got == [(2, 0), (2, 0), (0, 2), (0, 3), (0, 4), (0, 5), (1, 6), (1, 6), (2, 0), (0, 9), (0, 10), (0, 11)]
    assert embedding.near_duplicates(df.limit(0)).count() == 0


def test_vectors_are_told_apart_by_rows_not_ids(spark):
    rows = [(2, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.05]), (None, [1.0, 0.0]), (None, [0.0, 2.0, 0.0]), (None, None), (5, [1.0, 0.0, 0.0]), (6, [1.0, 0.0, 0.01]), (None, [0.0, -1.0]), (2, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(9) for c in ("id", "point", "digest", "unit", "n_links", "list")})
    got = sorted(map(repr, (tuple(r) for r in embedding.near_duplicates(df.repartition(3)).collect())))
    want = [(2, 3, 2, True), (2, 3, 2, True), (2, 0, 2, True), (3, 3, 2, False), (None, 3, 2, False), (None, 0, None, True), (None, 0, None, True), (5, 1, 5, True), (6, 1, 5, False), (None, 0, None, True)]
    assert got == sorted(map(repr, want))


@pytest.mark.parametrize("shape", ["isotropic", "towards others", "clusters", "copies"])
def test_no_link_is_lost(spark, shape):
    """Recall is 1 on random directions, on neighbours that lie straight towards another vector, in clusters and in a hot group."""
    rng = np.random.default_rng(8)
    dims, n = {"isotropic": 24, "towards others": 128, "clusters": 64, "copies": 32}[shape], 1500
    x = rng.normal(size=(n, dims))
    if shape == "isotropic":
        x[n // 2 :] = x[: n // 2] + rng.normal(size=(n // 2, dims)) * np.linalg.norm(x[: n // 2], axis=1)[:, None] * 0.45 / np.sqrt(dims)
    elif shape == "towards others":
        u = x / np.linalg.norm(x, axis=1)[:, None]
        x = np.concatenate([u[: n // 2], 0.72 * u[: n // 2] + 0.34 * u[n // 2 :]])
    elif shape == "clusters":
        x = x[rng.integers(0, 10, n)] + rng.normal(size=(n, dims)) * 0.33
    else:
        x[: n // 2] = x[0] + rng.normal(size=(n // 2, dims)) * 0.1
        x[n // 2 : n // 2 + 200] = x[0]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit = u @ u.T >= 0.9
    group = joined([(int(a), int(b)) for a, b in zip(*np.nonzero(hit), strict=True) if a != b])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding.near_duplicates(df).collect()}
    assert hit.sum() > n and got == {i: (hit[i].sum() - 1, group.get(i, i)) for i in range(n)}


def brute_targets(sizes, weights=(3, 1, 2), factor=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, full = factor * sum(sizes.values()), set()
    while True:
        rest = budget - sum(most * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s] + 1e-9}
        if not over:
            return {s: most * sizes[s] if s in full else share[s] for s in names}
        full |= over


def test_mix(spark):
    rng = random.Random(9)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 30, 200]))), rng.choice(["a", "a", "a", "a", "b", "c", "Z", None, "é", ""])) for i in range(400)] + [(1000, None, "a"), (1001, "  ", "q"), (1002, "x " * 50_000, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("block", F.lit(3))
    got = mixing.mix(df).collect()
    size = {i: len((t or "").split()) for i, t, _ in rows}
    sizes = Counter()
    for i, _, s in rows:
        sizes[s] += size[i]
    want = brute_targets(dict(sizes))
    taken = Counter()
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], abs_tol=1e-6) and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()), key=repr)
    docs = mixing.mixed_documents(df).groupBy("doc_id").agg(F.sum(mixing.words("text")).alias("n")).collect()
    assert {r.doc_id: r.n for r in docs} == {r.doc_id: r.taken for r in got if r.taken}
    assert mixing.mix(df.limit(0)).count() == 0


def test_blocks_split_exactly():
    counts = np.array([100, 3, 0, 57])
    dealt = mixing.split_blocks(counts, 7, np.random.default_rng(1))
    assert dealt.sum(axis=0).tolist() == counts.tolist() and set(dealt.sum(axis=1).tolist()) <= {160 // 7, 160 // 7 + 1}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    words = [f"{a}{b}" for a in ("lo", "ma", "ti", "re", "sun", "den") for b in ("ka", "ro", "mi", "st", "vel", "no", "ra")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    rows, labels = [], []
    for i in range(160):
        bad = i % 5 == 0
        rows.append((i, " ".join(rng.choice(["BUY!!", "###", "$$$", "NOW!!"]) for _ in range(80)) if bad else prose(rng.randint(30, 120)), "en", f"s{i % 4}"))
        labels.append((i, 0 if bad else 1, 0))
    passage = prose(60)
    rows += [(200, rows[1][1], "en", "s1"), (201, rows[2][1] + " more", "en", "s2"), (202, prose(40) + passage, "en", "s0"), (203, passage + prose(50), "en", "s0"), (204, "", "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        last, docs = docs, spark.read.parquet(path)
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert sorted(docs.columns) == sorted(last.columns)
    good = {i for i in range(160) if i % 5}
    assert good <= seen[0] and not seen[0] & {i for i in range(0, 160, 5)}
    assert good <= seen[1] and not seen[1] & {200, 201}
    cut = spark.read.parquet(f"{tmp_path}/suffix_dedup")
    assert passage not in cut.where("doc_id = 203").first().text and passage in cut.where("doc_id = 202").first().text
    assert cut.where("n_chars <> length(text)").count() == 0 and seen[4] == seen[3] and docs.where("length(ids) <> 4 * n_tokens").count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_stages_carry_every_row(spark, tmp_path):
    """Null and repeated ids, null texts and columns named like a stage's own."""
    import corpus_pipeline

    rng = random.Random(12)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    first = prose(60)
    passage = prose(30)
    rows = [(3, first), (5, first), (5, prose(50)), (5, prose(40)), (None, prose(40)), (None, prose(45)), (None, first), (7, None), (8, prose(25) + " " + passage), (9, passage + " " + prose(20)), (9, prose(30)), (9, passage)]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), f"row {k}", f"row {k}", f"row {k}", k, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars int, n_removed string, size string, shard string, key long, row long")
    read = lambda df: {(r["row"], r.text) for r in df.collect() if r.n_removed == r["size"] == r.shard == f"row {r['row']}" and r.key == r["row"]}
    everyone = set(enumerate(t for _, t in rows))

    def stage(k):
        out = corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path))
        assert out.columns == docs.columns and (k == 3 or out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType)
        return out

    one = stage(1)
    assert read(one) == everyone - {(1, first)} and one.count() == len(rows) - 1
    cut = stage(2)
    want = {(k, t) for k, t in everyone if k not in (1, 9, 11)}
    assert cut.count() == len(rows) - 2 and want <= read(cut)
    (left,) = (t for k, t in read(cut) if k in (1, 9, 11))
    assert rows[9][1].endswith(left) and passage not in left
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in cut.collect())
    mixed = stage(3)
    assert {r["row"] for r in mixed.collect()} == {k for k, _ in read(mixed)} != set()
    spark.createDataFrame([(3, 1), (5, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = stage(0)
    assert kept.count() == len(read(kept))


@pytest.mark.parametrize("same_text", [False, True])
def test_mix_with_one_id_on_a_third_of_all_rows(spark, same_text):
    """Targets are met within a document, however many rows share an id (or none, or id and text)."""
    rng = random.Random(3)
    text = lambda i: " ".join(["w"] * (20 if same_text else rng.randrange(1, 60)) + ([] if same_text else [f"t{i}"]))
    rows = [(7, text(i), "hot") for i in range(1500)] + [(None, text(i), "none") for i in range(300)] + [(i, text(i), rng.choice(["a", "b", None])) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    by_source: dict = {}
    for r in got:
        x = by_source.setdefault(r.source, [r.target, 0, 0])
        x[1], x[2] = x[1] + r.taken, max(x[2], r.size)
        assert r.taken <= 2 * r.size
    assert all(abs(target - taken) <= largest for target, taken, largest in by_source.values())
    key = lambda rs: Counter((r.doc_id, r.source, r.size, r.taken) for r in rs)
    assert key(got) == key(mixing.mix(df.repartition(4)).collect())
    docs = mixing.mixed_documents(df).groupBy("source").agg(F.sum(mixing.words("text")).alias("n")).collect()
    assert {r.source: r.n for r in docs} == {s: x[1] for s, x in by_source.items()}


def test_jaccard_with_several_texts_of_one_id(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(40):
        for j in range(2):
            t = [rng.choice(words) for _ in range(60)]
            rows += [(i, " ".join(t)), (1000 + 2 * i + j, " ".join([*t[:-1], "other"]))]
    rows += [(5, rows[0][1]), (None, rows[0][1]), (None, ""), (2000, ""), (2000, "alone here")]
    ids, texts = [r[0] for r in rows], [r[1].split() for r in rows]
    sets = [{tuple(t[p : p + 3]) for p in range(len(t) - 2)} or ({tuple(t)} if t else set()) for t in texts]
    label = list(range(len(rows)))
    # Labels to a fixed point, then the smallest id of each.
    changed = True
    while changed:
        changed = False
        for x in range(len(rows)):
            for y in range(x):
                if ids[x] is not None and ids[y] is not None and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 90 * len(sets[x] | sets[y]) and label[x] != label[y]:
                    label[x] = label[y] = min(label[x], label[y])
                    changed = True
    least: dict = {}
    for i, c in zip(ids, label, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = Counter((i, len(s), None if i is None else least[c]) for i, s, c in zip(ids, sets, label, strict=True))
    df = spark.createDataFrame(rows, TEXTS)
    for parts in (1, 5):
        got = ngram_join.jaccard_components(df.repartition(parts), k=3, num=90, den=100)
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == want
