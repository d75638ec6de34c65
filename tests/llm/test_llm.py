"""Training-data operators against brute force, round trips and held-out accuracy, with the awkward tables."""

import collections
import hashlib
import io
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import attribution, common, jaccard, langid, licenses, mixing, neighbours, packing, quality, queries, suffix, token_files, tokens
from lodestone.llm.graph import components

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_words long, token long, kept string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def awkward(spark):
    """Nulls in every column, empty, odd and long texts, ties, repeated rows, columns whose names clash with results."""
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "délta", "licen", "mit", "license", "x|y", "#"]
    long = " ".join(rng.choice(words) for _ in range(6000))
    base = " ".join(f"w{i}" for i in range(300))
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, long), (6, base), (7, base), (8, base.replace("w150", "changed")), (9, "MIT License\nmit  license, general public license"), (None, "no id here"), (10, None),
        (11, "<|endoftext|> ́a ÀÉ ß' it's"), (12, "aaaa" * 400), (13, "x" * 900), (14, base[:900]), (14, base[:900]), (15, "\x00 nul \x85 byte"), (16, "İstanbul K 日本語 テスト"),
    ]
    return spark.createDataFrame([(i, t, None if n % 3 == 0 else "en", None if n % 4 == 0 else f"s{n % 3}", 1, 2, "c") for n, (i, t) in enumerate(rows)], SCHEMA)


def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang", "source")


TABLES = {"awkward": awkward, "documents": documents, "empty": lambda spark: spark.createDataFrame([], SCHEMA)}


@pytest.fixture(params=sorted(TABLES))
def docs(spark, request):
    return TABLES[request.param](spark)


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def encoded(texts):
    lib = tokens.PieceEncoder(tokens.default_path()).lib
    return [np.append(np.array(e.ids, "<u4"), np.uint32(2)).astype("<u4") for e in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("keep", [5, 1000])
def test_encoder_is_the_library(keep):
    """Endings after apostrophes, digits, letters beyond ASCII, pieces longer than a key; with a full store too."""
    rng = random.Random(5)
    texts = ["''s 's're 'll've don't can'tx'rest it's'm 'd 'l \"'s (a'b) 're''re", "'", "'s", "a'", "ÄÖÜ ÀÉ ß\n\té", "1a2b!?", "x" * 100 + " " + "y" * 200 + "é", "", None, "naïve İ ok", "<|endoftext|> a"]
    texts += ["".join(rng.choice("abé'sS 1.!\n") for _ in range(200)) for _ in range(50)]
    e = tokens.PieceEncoder(tokens.default_path(), keep=keep)
    for _ in range(2):
        for t, ids, spans in zip(texts, e.ids(texts), e.char_spans(texts), strict=True):
            want = e.lib.encode(t or "", add_special_tokens=False)
            assert ids.tolist() == want.ids and [tuple(x) for x in spans.tolist()] == want.offsets


def test_token_counts(docs):
    got = collections.defaultdict(list)
    for r in attribution.token_counts(docs, tokens.default_path(), most_chars=50).collect():
        got[r.doc_id].append(r.n_tokens)
    rows = rows_of(docs)
    want = collections.Counter()
    for (i, _), ids in zip(rows, encoded([t for _, t in rows]), strict=True):
        want[i] += len(ids) - 1
    assert {k: sum(v) for k, v in got.items() if sum(v)} == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize(("rule", "want"), [("first", [2, 1]), ("last", [1, 2]), ("largest", [1, 2]), ("each", [2, 2])])
def test_boundary_rules(rule, want):
    counts, crossed, outside = attribution.allocate(np.array([[0, 2], [2, 6], [6, 8], [9, 10]]), np.array([[0, 3], [3, 8]]), rule)
    assert counts.tolist() == want and outside == 1 and crossed.sum() == (2 if rule == "each" else 1)


def test_packing(docs):
    rows = rows_of(docs)
    want = sorted((repr(i), zlib.crc32(x.tobytes()), len(x)) for (i, _), x in zip(rows, encoded([t for _, t in rows]), strict=True))
    by_id = collections.defaultdict(list)
    for (i, _), x in zip(rows, encoded([t for _, t in rows]), strict=True):
        by_id[i].append(x)
    sequences, covered = collections.defaultdict(list), collections.Counter()
    for r in packing.pack(docs, tokens.default_path(), size=256, windows=4, fan_in=2).collect():
        sequences[r.sequence_id].append((r.offset, r.length))
        covered[r.doc_id] += r.length
        assert any(zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and len(x) == r.doc_tokens for x in by_id[r.doc_id])
    assert covered == {i: sum(map(len, x)) for i, x in by_id.items()}
    assert len(want) == len(rows)
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == np.cumsum([0, *[n for _, n in s[:-1]]]).tolist() and sum(n for _, n in s) <= 256
    assert sum(sum(n for _, n in s) < 256 for s in sequences.values()) <= 1


def base_license(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    at = [(i, k) for k, p in licenses.BASE.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p]
    return len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({k for _, k in at}))


def test_license_scan(docs):
    got = licenses.scan(docs).collect()
    same([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], [(i, *base_license(t)) for i, t in rows_of(docs)])
    assert all(set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1 for r in got)


def test_license_rules(spark):
    texts = [
        "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "a license to kill time", "SPDX-License-Identifier: MIT", "SPDX-License-Identifier: Foo-1", "Licensed under my own terms",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "This program is free software; you can redistribute it and/or modify it", "SPDX-License-Identifier: GPL-3.0-or-later",
    ]
    got = [r.labels for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got == ["apache,apache-2", "cc-by-nc", "", "mit", "spdx", "other", "mit", "gpl", "gpl-3"]
    assert len(licenses.rules()) > 300


def test_license_labels_by_brute_force(docs):
    """Every rule over every text's words, without gates, then containment and priority."""
    want = []
    for i, t in rows_of(docs):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
        spaced, found = " " + " ".join(w) + " ", []
        for label, x, keyword, priority, sure in licenses.rules():
            if " " + keyword in spaced:
                for m in re.finditer(f" (?:{x})(?= )", spaced):
                    a = spaced[: m.start()].count(" ")
                    found.append((a, a + m[0].count(" "), priority, label, sure))
        left = [b for b in found if not any(a[0] <= b[0] and a[1] >= b[1] and (a[1] - a[0] > b[1] - b[0] or a[2] < b[2] or (a[2] == b[2] and a[3] < b[3])) for a in found)]
        base = set(filter(None, base_license(t)[4].split(",")))
        want.append((i, ",".join(sorted(base | {x[3] for x in left})), max((x[4] for x in left), default=0.0)))
    same([(r.doc_id, r.labels, r.score) for r in licenses.scan(docs).collect()], want)


def shingles(text, k):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80), (2, 60)])
def test_jaccard_groups(docs, k, num):
    rows = [(i, shingles(t, k)) for i, t in rows_of(docs)]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a][1], rows[b][1]
            if x and y and 100 * len(x & y) >= num * len(x | y):
                up[root(a)] = root(b)
    least = collections.defaultdict(list)
    for n, (i, _) in enumerate(rows):
        least[root(n)] += [i] if i is not None else []
    want = [(i, len(s), i if not s else min(least[root(n)], default=None)) for n, (i, s) in enumerate(rows)]
    same([tuple(r) for r in jaccard.jaccard_groups(docs, k=k, num=num).collect()], want)


def test_jaccard_family_keeps_every_link(spark):
    """A family of near copies at the threshold, in many groups."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(300):
        w = base.copy()
        for _ in range(rng.randrange(8)):
            w[rng.randrange(120)] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingles(t, 4) for t in texts]
    edges = [(a, b) for a in range(300) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    up = list(range(300))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(docs).collect()}
    assert got == {i: root(i) for i in range(300)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)]
    got = collections.defaultdict(set)
    for r in components(spark.createDataFrame(edges, "a long, b long")).collect():
        got[r.root].add(r.vertex)
    assert sorted(map(len, got.values())) == [2, 61]


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = queries.op5_language(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_language_of_odd_texts(spark, docs):
    model = langid.fit([("the and of with is " * 5, "en"), ("der die und ist nicht " * 5, "de"), ("", "xx")])
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.score <= 1 for r in got.values())
    assert langid.identify(docs, langid.fit([])).filter("lang_pred <> 'und'").count() == 0


def test_token_files(spark, docs):
    folder = token_files.token_file_folder(spark)
    manifest = token_files.write_token_files(docs, folder, tokens.default_path())
    got = [tuple(r) for r in token_files.read_token_files(spark, folder, manifest).orderBy("start").collect()]
    rows = rows_of(docs)
    ids = sorted(((i is not None, i or 0), i, x.tobytes()) for (i, _), x in zip(rows, encoded([t for _, t in rows]), strict=True))
    assert [r[0] for r in got] == [i for _, i, _ in ids]
    same([(r[0], r[2], r[3]) for r in got], [(i, len(x) // 4, zlib.crc32(x)) for _, i, x in ids])
    assert [r[1] for r in got] == np.cumsum([0, *[r[2] for r in got]])[:-1].tolist()


def test_token_file_reads_single_documents_and_finds_damage():
    sink = io.BytesIO()
    w = token_files.TokenFileWriter(sink, frame_ids=50)
    docs = [(i, np.arange(i, i + 20, dtype="<u4") + (70_000 if i == 7 else 0)) for i in range(20)]
    for d in docs:
        w.add(*d)
    w.close()
    raw = sink.getvalue()
    r = token_files.TokenFileReader(io.BytesIO(raw), len(raw))
    assert [x.tolist() for x in r.get(7)] == [docs[7][1].tolist()] and r.get(99) == [] and len(r.seek) > 3
    assert [k for k, _ in r] == list(range(20))
    bad = token_files.TokenFileReader(io.BytesIO(raw), len(raw))
    bad.seek = bad.seek.copy()
    bad.seek[0, 2] ^= 1
    with pytest.raises(ValueError):
        bad.frame(0)


def test_neighbours(spark):
    e = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = e.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    hits, n = 0, 0
    got = collections.defaultdict(list)
    for r in queries.op7_neighbours(spark, FOLDER).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        best = [int(ids[i]) for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        hits, n = hits + len(set(best) & {i for i, _ in got[q]}), n + 20
        assert all(abs(v - float(x[ids == i][0] @ x[ids == q][0])) < 1e-9 for i, v in got[q]) and len(got[q]) == 20
    assert hits >= 0.9 * n


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [0.5, 0.5]), (8, [1.0, 2.0, 3.0]), (20, [3.0, 4.0])]
    v = spark.createDataFrame([(i, e, 1) for i, e in rows], "vec_id long, embedding array<float>, score int")
    got = [(r.query_id, r["rank"], r.vec_id) for r in neighbours.nearest(v, "vec_id % 20 = 0").orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20), (0, 2, 1), (0, 3, 2), (0, 4, 7), (20, 1, 7), (20, 2, 0), (20, 3, 1), (20, 4, 2)]
    assert neighbours.nearest(v.limit(0), "vec_id % 20 = 0").count() == 0


def base_quality(text):
    t = text or ""
    w, lines = re.findall("[^\x20\x09-\x0d]+", t), [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    runs = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    at = {j for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(at), len(w) < 10 or 100 * len(at) > 20 * len(w)


def test_line_cleaning(docs):
    got = quality.clean_lines(docs).collect()
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got], [(i, *base_quality(t)) for i, t in rows_of(docs)])
    assert not any(r.kept and r.base_failed for r in got)


def test_line_rules(spark):
    good = "This is a plain sentence of ordinary words that says something.\n"
    text = good + "Home | News | Sport | About us\nAll rights reserved.\n----------\nNext\nAnother fine sentence with quite some words in it.\n"
    r = quality.clean_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).head()
    assert r.n_failed_lines == 4 and r.kept and r.cleaned == good + "Another fine sentence with quite some words in it."


@pytest.mark.parametrize("n", [400, 250, 64])
def test_remove_repeats(docs, n):
    rows = rows_of(docs)
    raw = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(x[i : i + n] for x in raw for i in range(len(x) - n + 1))
    want = []
    for (i, _), x in zip(rows, raw, strict=True):
        gone = bytearray(len(x))
        for j in range(len(x) - n + 1):
            if seen[x[j : j + n]] > 1:
                gone[j : j + n] = b"\1" * n
        kept = bytes(c for c, g in zip(x, gone, strict=True) if not g)
        want.append((i, len(x), sum(gone), len([s for s in bytes(gone).split(b"\0") if s]), hashlib.sha256(kept).hexdigest()))
    same([tuple(r)[:5] for r in suffix.remove_repeats(docs, length=n).collect()], want)


def test_buckets_of_equal_strings_are_equal_and_others_differ():
    """The rounds against the strings themselves, at depths that double and that don't."""
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 3000, dtype=np.uint8)
    data[2000:2600] = data[100:700]
    grams = suffix.Suffixes.grams(data)
    for depth in (8, 9, 16, 23, 64, 130, 400):
        at = np.arange(len(data) - depth)
        ids = suffix.Suffixes.refined(grams, at, depth)
        by = collections.defaultdict(set)
        for i in at.tolist():
            by[data[i : i + depth].tobytes()].add(int(ids[i]))
        assert all(len(x) == 1 for x in by.values()) and len({next(iter(x)) for x in by.values()}) == len(by)


def test_remove_repeats_of_so_many_words(spark):
    long, short = " ".join(f"w{i}" for i in range(51)), " ".join(f"quitelongword{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"a {long} b"), (2, f"c {long} d {short} e"), (3, f"f {short} g")], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in suffix.remove_repeats(docs, length=100, keep="text", min_words=51).collect()}
    assert got == {1: "ab", 2: f"cd {short} e", 3: f"f {short} g"}


def test_remove_repeats_carries_columns_that_clash(spark):
    docs = spark.createDataFrame([(1, "a" * 500, 7, "x"), (2, None, 8, "y")], "doc_id long, text string, n_bytes int, row string")
    got = suffix.remove_repeats(docs, carry=("n_bytes", "row", "text"))
    assert got.columns[6:] == ["n_bytes_in", "row", "text"]
    assert sorted((r.doc_id, r.n_removed, r.n_bytes_in, r.row) for r in got.collect()) == [(1, 500, 7, "x"), (2, 0, 8, "y")]


def test_remove_repeats_by_shuffled_joins(spark, monkeypatch):
    docs = documents(spark)
    want = [tuple(r) for r in suffix.remove_repeats(docs).collect()]
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    same([tuple(r) for r in suffix.remove_repeats(docs).collect()], want)


def test_mixing(docs):
    got = mixing.mix_sources(docs)
    rows = got.collect()
    same(rows, mixing.mix_sources(docs.repartition(3)).collect())
    assert len(rows) == docs.count() and all(r.taken == r.copies * r.size and 0 <= r.copies <= 3 for r in rows)
    size = collections.Counter()
    for r in rows:
        size[r.source] += r.size
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight, full, total = {s: i % 3 + 1 for i, s in enumerate(names)}, set(), sum(size.values())
    while names:
        rest, w = total - sum(3 * size[s] for s in full), sum(weight[s] for s in names if s not in full)
        target = {s: 3 * size[s] if s in full else rest * weight[s] / w for s in names}
        over = {s for s in names if target[s] > 3 * size[s] + 1e-6} - full
        if not over:
            break
        full |= over
    assert all(abs(r.target - target[r.source]) < 1e-6 and r.source_size == size[r.source] for r in rows)


def test_mixing_comes_near_its_targets(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (1 + F.col("id") % 97).cast("int")).alias("text"), F.concat(F.lit("s"), F.least(F.col("id") % 9, F.lit(4))).alias("source"))
    for r in mixing.mix_sources(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 0.02 * r.target


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = common.cut(stage(spark, docs, FOLDER))
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
        if name != "mix":
            assert docs.count() <= before
    # What repeated is gone, near copies too.
    once = docs.dropDuplicates(["doc_id"])
    assert suffix.remove_repeats(once, min_words=51).filter("n_removed > 0").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0


def pipeline_rows(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_pipeline_near_duplicates_decides_on_rows(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    words = lambda c: [f"{c}{i}" for i in range(200)]
    text = lambda c, *changed: " ".join("new" if i in changed else w for i, w in enumerate(words(c)))
    rows = [
        (1, text("a")), (2, text("a", 100)), (2, text("b")),  # one row of id 2 is a near copy, the other alone
        (3, text("c")), (3, text("c")), (3, text("c")),  # a row three times
        (None, text("d")), (4, text("d", 50)), (None, text("e")), (None, text("e", 7)),  # null ids last, and alone
        (5, text("f")), (None, text("g")), (6, None), (6, ""),
    ]
    got = corpus_pipeline.near_duplicates(spark, pipeline_rows(spark, [(*r, "s") for r in rows]), FOLDER)
    assert got.columns == list(corpus_pipeline.COLUMNS)
    got = [(r.doc_id, r.text) for r in got.collect()]
    nulls = [r for r in got if r in rows[8:10]]
    assert len(nulls) == 1
    same([r for r in got if r not in nulls], [rows[0], rows[2], rows[3], rows[7], *rows[10:]])


def test_pipeline_near_duplicates_of_the_awkward_table(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = rows_of(awkward(spark))
    got = rows_of(corpus_pipeline.near_duplicates(spark, pipeline_rows(spark, [(*r, "s") for r in rows]), FOLDER))
    kept, want = [], []
    # No chains here, so that a row goes if it links to one before it.
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        s = shingles(t, 5)
        if not s or all(100 * len(s & x) < 80 * len(s | x) for x in kept):
            kept += [s] if s else []
            want.append((i, t))
    same(got, want)


def test_pipeline_mix_decides_on_rows(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(None, f"null {i}", "s") for i in range(5)] + [(1, "one two", "s"), (1, "other words here", "s"), (2, "two", None), (2, "two", None)]
    # One weight for all, so each row is taken once.
    got = corpus_pipeline.mix(spark, pipeline_rows(spark, [(i, t, "s") for i, t, _ in rows]), FOLDER)
    same([(r.doc_id, r.text) for r in got.collect()], [r[:2] for r in rows])
    docs = pipeline_rows(spark, [*rows, *[(10 + n, "w " * (1 + n % 5), f"s{n % 3}") for n in range(60)]])
    want = collections.Counter()
    for r in mixing.mix_sources(docs).collect():
        want[r.doc_id, r.source, r.size] += r.copies
    got = collections.Counter((r.doc_id, r.source, len(r.text.split())) for r in corpus_pipeline.mix(spark, docs, FOLDER).collect())
    assert got == +want


def test_jaccard_links_through_rows_without_an_id(spark):
    """Documents 1 and 2 link only through a row without an id; another such row links to 3, two more to each other."""
    text = lambda c, *changed: " ".join("new" + str(i) if i in changed else f"{c}{i}" for i in range(200))
    rows = [(1, text("a", 20, 60)), (None, text("a", 60)), (2, text("a", 60, 100, 140)), (3, text("b")), (None, text("b", 9)), (None, text("c")), (None, text("c", 9)), (4, text("d"))]
    sets = [shingles(t, 4) for _, t in rows]
    close = lambda x, y: 100 * len(x & y) >= 91 * len(x | y)
    assert close(sets[0], sets[1]) and close(sets[1], sets[2]) and not close(sets[0], sets[2])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(docs, num=91).collect()]
    least = [1, 1, 1, 3, 3, None, None, 4]
    same(got, [(i, len(s), c) for (i, _), s, c in zip(rows, sets, least, strict=True)])


def test_language_learns_every_label(spark):
    """230 languages of 8 rows, where no more than 200 may give a whole sample, and one of a single row."""
    rows = [(n * 8 + i, f"word{n} text{i}", f"l{n:03d}") for n in range(230) for i in range(8)] + [(5000, "rare", "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for per_lang in (1, 4):
        sample = langid.training_sample(docs, "true", per_lang, "doc_id", "text", "lang")
        assert {lang for _, lang in sample} == {r[2] for r in rows}
        assert len(sample) <= 2 * 231 * per_lang
    assert len(sample) <= 2 * langid.FULL_LANGS * 4
    model = langid.fit(sample)
    assert model.langs == sorted({r[2] for r in rows})


@pytest.mark.parametrize(("n", "bits"), [(2, 15), (3, 15), (4, 15), (5, 15), (6, 15), (23, 15)])
def test_codewords(n, bits):
    """No bit is constant, repeats another or is its opposite; words are far apart, so that a wrong bit can be put right."""
    code = langid.codewords(n, bits)
    assert code.shape == (n, min(bits, 2 ** (n - 1) - 1))
    columns = {(c * c[0]).tobytes() for c in code.T}
    assert len(columns) == code.shape[1] and all(abs(c.sum()) < n for c in code.T)
    apart = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
    assert apart >= (2 ** (n - 2) if n <= 5 else 3)


def test_decoding_puts_a_wrong_bit_right():
    code = langid.codewords(4, 15)
    model = langid.Model(list("abcd"), code, np.concatenate([np.eye(7), np.zeros((1, 7))]), np.full(7, 1 / 7))
    for i in range(4):
        for wrong in range(7):
            margins = code[i].copy()
            margins[wrong] *= -1
            assert model.decode(margins[None])[0] == ["abcd"[i]]


def test_languages_of_rows_without_an_id(spark):
    docs = spark.createDataFrame([(None, "some text", "en"), (1, "other", "de")], "doc_id long, text string, lang string")
    assert docs.selectExpr(queries.HELD_OUT + " AS h").filter("h is null").count() == 0
    assert len(langid.training_sample(docs, f"not ({queries.HELD_OUT})", 5, "doc_id", "text", "lang")) >= 1


def test_token_counts_of_given_sections(spark):
    """Sums are the documents' own, whatever the sections: none, null, unsorted, overlapping, empty, past the end."""
    rows = [(1, "alpha beta gamma", [(0, 5), (11, 16)]), (2, "alpha beta", None), (3, "alpha beta gamma", [(6, 10), (0, 8), (3, 3), (90, 99)]), (4, None, [(0, 3)]), (5, "alpha", [None, (None, 5)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, parts array<struct<a:int,b:int>>")
    got = collections.Counter()
    for r in attribution.token_counts(docs, tokens.default_path(), spans_col="parts").collect():
        got[r.doc_id] += r.n_tokens
        assert (r.section == -1) == (r.start_char is None)
    want = {i: len(x) - 1 for (i, _, _), x in zip(rows, encoded([t for _, t, _ in rows]), strict=True)}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_neighbours_where_counting_prunes(spark):
    """Recall against brute force at a size at which most rows aren't verified."""
    x = np.array([r.embedding for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()], dtype=float)
    index, asked = neighbours.CollisionIndex(x), x[::20]
    hits = verified = 0
    for q, at in index.search(asked, 20):
        best = set(np.argsort(-(x @ asked[q]), kind="stable")[:20].tolist())
        hits, verified = hits + len(best & set(at.tolist())), verified + len(at)
    assert verified < 0.5 * len(x) * len(asked) and hits >= 0.9 * 20 * len(asked)


def base_kept(text):
    """Whether a document stays, line by line."""
    t = text or ""
    good = []
    for line in t.split("\n"):
        x = line.strip(quality.SPACE)
        if not x:
            continue
        bare = re.sub("[" + re.escape(quality.SPACE) + "]", "", x)
        letters, symbols, entries = sum(c not in quality.MARKS for c in x), sum(c in quality.SYMBOLS for c in x), sum(c in quality.SEPARATORS for c in x)
        fragment = len(x) <= 60 and x[-1] not in quality.TERMINAL and len(re.split(r"[\x20\x09-\x0D]+", x)) < quality.FRAGMENT_WORDS
        navigation = len(x) <= 40 and re.search(quality.NAVIGATION, x, re.ASCII)
        boilerplate = len(x) <= quality.BOILERPLATE_CHARS and re.search(quality.BOILERPLATE, x, re.ASCII)
        if not (letters * 4 < len(bare) or symbols * 4 >= letters or (entries >= 3 and entries * 24 >= letters) or fragment or navigation or boilerplate):
            good.append(line)
    chars = lambda y: len(re.sub("[" + re.escape(quality.SPACE) + "]", "", y))
    return not base_quality(t)[5] and chars("".join(good)) >= chars(t) * 0.5


def test_line_verdicts_by_brute_force(docs):
    same([(r.doc_id, r.kept) for r in quality.clean_lines(docs).collect()], [(i, base_kept(t)) for i, t in rows_of(docs)])


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_sql(spark, name):
    import oracle

    assert oracle.differences(spark, oracle.duck(FOLDER), name, queries.queries()[name], queries.oracle_sql()[name], FOLDER) == ""
