"""Text operators against brute force, and on odd input."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import components, decontamination, embedding_dedup, license_scan, mixing, quality, shingle_dedup, simhash_dedup, substring_dedup, suffix_dedup, token_counts, toxicity
from millrace.llm import packed as P

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=3, n=60):
    """Random texts with shared passages, exact and near copies, and odd ones."""
    r = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "été", "ß", "x"]
    text = lambda k: " ".join(r.choice(words) + str(r.randrange(30)) for _ in range(k))
    shared = [text(30) for _ in range(3)]
    out = []
    for i in range(n):
        kind = i % 6
        body = text(r.randrange(1, 80))
        if kind == 1:
            body += " " + r.choice(shared) + " " + text(10)
        elif kind == 2 and out:
            body = out[r.randrange(len(out))][1]
        elif kind == 3 and out:
            body = (out[r.randrange(len(out))][1] or "") + "\n\tend"
        elif kind == 4:
            body = "ab" * 60 + shared[0] + shared[0]
        out.append((i * 7 % 101, body))
    return [*out, (200, None), (201, ""), (202, " \n\t"), (203, text(9000)), (204, "a" * 5000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], DOCS).withColumn("key", F.lit("clash")).withColumn("block", F.lit(1)).withColumn("label", F.lit(0)).withColumn("size", F.lit(None).cast("int"))


def suffix_brute(rows, length=50):
    first = {}
    raw = sorted((i, (t or "").encode()) for i, t in rows)
    for i, b in raw:
        for k in range(len(b) - length + 1):
            first.setdefault(b[k : k + length], i)
    out = {}
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("options", [{}, {"block_bytes": 2000, "wide_seed": 2, "batch_bytes": 500}])
def test_suffix_dedup(spark, options):
    rows = corpus()
    got = {r[0]: tuple(r[1:]) for r in suffix_dedup.remove_repeats(frame(spark, rows), **options).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    assert got == suffix_brute(rows)


def test_suffix_family_levels_merge_and_find_all():
    r = np.random.default_rng(1)
    family, seen = suffix_dedup.SuffixFamily(4), {}
    for batch in range(20):
        text = r.integers(97, 99, 40).astype(np.uint8)
        at = np.arange(37)
        own = np.full(37, batch)
        want = [min(seen.get(text[a : a + 4].tobytes(), batch), batch) for a in at]
        assert family.add(text, at, own).tolist() == want
        for a in at:
            seen.setdefault(text[a : a + 4].tobytes(), batch)
    sizes = [len(x["at"]) for x in family.levels]
    assert all(a > 2 * b for a, b in zip(sizes, sizes[1:], strict=False))


def window_brute(rows, window=20):
    seen, out = set(), {}
    for i, t in sorted(rows):
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            g = tuple(words[k : k + window])
            if g in seen:
                gone[k : k + window] = [True] * window
            seen.add(g)
        kept = b" ".join(w for w, x in zip(words, gone, strict=True) if not x)
        out[i] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("size", [8 << 20, 2000])
def test_substring_dedup(spark, size):
    rows = corpus()
    got = {r[0]: tuple(r[1:]) for r in substring_dedup.remove_repeated_windows(frame(spark, rows), block_bytes=size).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()}
    assert got == window_brute(rows)


def test_cut_repeats_keeps_columns_and_untouched_texts(spark):
    rows = corpus()
    docs = frame(spark, rows)
    cut = substring_dedup.cut_repeats(docs)
    assert cut.columns == docs.columns
    want, before = window_brute(rows), dict(rows)
    for r in cut.collect():
        n, removed, digest = want[r.doc_id]
        assert r.text == before[r.doc_id] if not removed else hashlib.sha256(r.text.encode()).hexdigest() == digest and r.n_chars == len(r.text)
    assert {r.doc_id for r in cut.collect()} == {i for i, (n, removed, _) in want.items() if not removed or removed < n}


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(vertices, linked):
    parent = {v: v for v in vertices}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in linked:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {v: find(v) for v in vertices}


def test_simhash(spark):
    rows = corpus()
    marks = {i: brute_fingerprint(t) for i, t in rows}
    linked = [(a, b) for a in marks for b in marks if a < b and (marks[a] ^ marks[b]).bit_count() <= 4]
    found = brute_components(marks, linked)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: (f"{marks[i]:016x}", found[i]) for i in marks}


def test_keep_one_drops_edited_copies_and_keeps_others(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    texts = [" ".join(word() for _ in range(300)) for _ in range(12)]
    edited = []
    for t in texts[:4]:
        words = t.split()
        for at in (30, 120, 200):
            words[at] = word()
        edited.append(" ".join(words))
    half = [" ".join(t.split()[:150] + [word() for _ in range(150)]) for t in texts[4:8]]
    rows = list(enumerate(texts + edited + half + texts[8:10]))
    assert sorted(x.doc_id for x in simhash_dedup.keep_one(frame(spark, rows)).collect()) == [*range(12), *range(16, 20)]


@pytest.mark.parametrize("run", [0, 64])
def test_close_pairs(run, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "LONG_RUN", run)
    rng = np.random.default_rng(2)
    bits, key = rng.integers(0, 8, 300).astype(np.uint64), np.sort(rng.integers(0, 3, 300))
    got = {(int(a), int(b)) for i, j in simhash_dedup.close_pairs(bits, key, 1) for a, b in zip(i, j, strict=True) if (int(bits[a]) ^ int(bits[b])).bit_count() <= 1}
    assert got == {(i, j) for i in range(300) for j in range(i + 1, 300) if key[i] == key[j] and (int(bits[i]) ^ int(bits[j])).bit_count() <= 1}


@pytest.mark.parametrize("chain", [1, 2, 3])
def test_every_chain_and_tile_finds_the_same_links(spark, chain, monkeypatch):
    r = random.Random(chain)
    centres = [r.getrandbits(64) for _ in range(3)]
    marks = sorted({c ^ sum(1 << b for b in r.sample(range(64), r.randrange(7))) for c in centres for _ in range(25)})
    signed = [(m - (1 << 64) if m >> 63 else m, i) for i, m in enumerate(marks)]
    linked = [(i, j) for i in range(len(marks)) for j in range(i) if (marks[i] ^ marks[j]).bit_count() <= 4]
    if chain == 1:
        tiled = components.tiled
        monkeypatch.setattr(simhash_dedup, "tiled", lambda rows, bucket, id_column, tile: tiled(rows, bucket, id_column, tile=5))
    edges = simhash_dedup.similar_classes(spark.createDataFrame(signed, "bits long, rep long"), 4, chain)
    got = {r.node: r.component for r in components.components(edges).collect()}
    want = brute_components(range(len(marks)), linked)
    assert {i: got.get(i, i) for i in want} == want


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("tile", "hashes"), [(2048, None), (6, 1), (4, 2), (2048, 3)])
def test_embeddings(spark, tile, hashes, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 24))
    x = np.concatenate([b + 0.25 * rng.normal(size=(9, 24)) for b in base])
    data = [(i, v.astype(np.float32).tolist(), i % 2) for i, v in enumerate(x)]
    data += [(None, None, None)] * 3 + [(None, data[0][1], 0)] + [(110, None, None)]
    data += [(100, data[0][1], 0), (101, data[0][1], 0), (102, None, 0), (103, [0.0] * 24, 0), (104, [float("nan")] * 24, 0), (105, [None] * 24, 0), (106, data[0][1], None), (107, [], 0), (108, [1.0, 2.0], 0), (109, [2.0, 4.0], 0), (None, data[0][1], 0)]
    sound = [(i, np.array(v, float), y) for i, v, y in data if i is not None and v and y is not None and None not in v and np.isfinite(v).all() and any(v)]
    cosine = lambda a, b: len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93
    linked = [(a[0], b[0]) for a in sound for b in sound if a[0] < b[0] and a[2] == b[2] and cosine(a[1], b[1])]
    found = brute_components([r[0] for r in data if r[0] is not None], linked)
    links = {i: sum(i in pair for pair in linked) for i in found}
    original = components.tiled
    monkeypatch.setattr(embedding_dedup, "tiled", lambda rows, bucket, id_column, most=None: original(rows, bucket, id_column, tile=tile))
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit("clash"))
    every = embedding_dedup.near_vectors(df, hashes=hashes).collect()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in every}
    assert got.pop(None) == (0, None, False) and len(every) == len(data)
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0
    assert got == {i: (links[i], found[i], found[i] == i) for i in found}


@pytest.mark.parametrize("hashes", [1, 2, 3])
def test_embedding_recall_at_the_threshold_is_the_same_with_more_hashes(hashes):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    x, y = (embedding_dedup.codes_of(v, embedding_dedup.tables_for(hashes), embedding_dedup.PROBES, hashes, embedding_dedup.SEED) for v in (a, b))
    met = (x[:, :, :, None] == y[:, :, None, :]).any((1, 2, 3))
    apart = np.bitwise_count(embedding_dedup.sketches(a, 42) ^ embedding_dedup.sketches(b, 42)).sum(1)
    assert met.mean() > 0.999 and (apart <= embedding_dedup.sketch_limit(0.93)).mean() > 0.999


def test_license_scan(spark):
    rows = [(1, "All Rights reserved. all rights reserved"), (2, "cc-by: CC BY 4"), (3, "Licensed under the new Apache License, Version 2.0!"), (4, None), (5, ""), (5, "general public  license"), (6, "rights reserved all"), (6, "rights reserved all"), (None, "all rights reserved"), (7, "gnu général public license")]
    got = [tuple(r) for r in license_scan.scan_licenses(frame(spark, rows)).collect()]
    by = {}
    for r in got:
        by.setdefault(r[0], []).append(r[1:])
    assert by[1] == [(6, 2, 0, 3, "reserved", "reserved", 1.0)]
    assert by[2] == [(5, 2, 0, 2, "cc-by", "cc-by", 1.0)]
    assert by[3][0][1:6] == (0, None, None, "", "apache-2.0") and 0.8 <= by[3][0][6] < 1
    assert by[4] == [(0, 0, None, None, "", "", 0.0)] and sorted(r[1] for r in by[5]) == [0, 1]
    assert by[6] == [(3, 0, None, None, "", "", 2 / 3)] * 2 and by[None][0][1] == 1
    assert license_scan.scan_licenses(frame(spark, rows).limit(0)).count() == 0


def test_base_phrases_are_counted_as_a_plain_search_counts_them(spark):
    import re

    r = random.Random(40)
    parts = ["all", "rights", "reserved", "Reserved", "cc", "by", "CC", "general", "public", "license", "été", "K", "\u212a", "gnu", "x1"]
    gaps = [" ", "-", ". ", "\n", "  ", "/", "\u00a0"]
    rows = [(i, "".join(r.choice(parts) + r.choice(gaps) for _ in range(r.randrange(80)))) for i in range(60)] + [(70, "word " * 30_000 + "all rights reserved " + "by cc " * 30_000), (71, " . "), (72, ".cc by.")]
    phrases = {label: words.split() for label, words in license_scan.BASE}
    want = {}
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        at = [(k, label) for label, p in phrases.items() for k in range(len(w)) if w[k : k + len(p)] == p]
        want[i] = (len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at})))
    got = {x[0]: tuple(x)[1:6] for x in license_scan.scan_licenses(frame(spark, rows)).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 40


def test_a_span_is_verified_by_its_words(spark):
    rows = [(1, "released under the new mit license"), (2, "released under a b c the mit license"), (3, "of the " * 500 + "under the"), (4, "licensed beneath the apache software version 2 0")]
    got = {x.doc_id: (x.labels, round(x.score, 3)) for x in license_scan.scan_licenses(frame(spark, rows)).collect()}
    assert got[1] == ("mit", 0.833) and got[2][0] == "" and got[3][0] == "" and got[3][1] < 0.5 and got[4] == ("", 0.625)


def test_decontamination_finds_edited_copies(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(6)] + [(8, None), (None, "x y z"), (9, "one two")]
    edited = items[2][1].split()
    edited[5], edited[12], edited[20] = "new", "words", "here"
    rows = [(1, "pad " + items[0][1].upper() + " pad"), (2, " ".join(edited)), (3, " ".join(word() for _ in range(200))), (4, None), (5, ""), (6, items[1][1][:60]), (None, items[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.score for x in decontamination.find_leaks(frame(spark, rows), bench).collect()}
    assert set(got) == {(1, 0), (2, 2), (None, 3)} and got[1, 0] == 1 and 0.7 < got[2, 2] < 1
    sliced = {(x.doc_id, x.item_id) for x in decontamination.find_leaks(frame(spark, rows), bench, slice_bytes=300).collect()}
    assert sliced == set(got)
    assert sorted(x.doc_id for x in decontamination.drop_leaks(frame(spark, rows), bench).collect()) == [3, 4, 5, 6]
    assert decontamination.find_leaks(frame(spark, rows), bench.limit(0)).count() == 0


def test_alignment_against_plain_dynamic_programming():
    r = np.random.default_rng(4)
    for _ in range(30):
        a, b = r.integers(0, 4, 7), r.integers(0, 4, 9)
        h = np.zeros((8, 10), int)
        for i in range(7):
            for j in range(9):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        score, first, last = decontamination.align(a, b)
        assert score == h.max() and 0 <= first <= last + 1 <= 9


def test_mixing(spark):
    r = random.Random(9)
    rows = [(i, "w " * r.randrange(1, 60), "en", s, 0) for i, s in enumerate([None] * 40 + ["a"] * 300 + ["b"] * 200 + ["c"] * 150)] + [(900, None, "en", "a", 0), (901, "", None, "d", 0), (902, "x", "en", "b", 0), (902, "x", "en", "b", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix_sources(docs).toPandas()
    per = got.groupby(got["source"].fillna("zz")).agg(size=("size", "sum"), own=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (per["size"] == per["own"]).all() and abs(per["target"].sum() - 1.5 * per["size"].sum()) < 1e-6
    assert (per["target"] <= 2 * per["own"] + 1e-9).all() and ((per["taken"] - per["target"]).abs() <= 60).all()
    assert (got["taken"] <= 2 * got["size"]).all()
    small = mixing.mix_sources(docs.repartition(7), part=25).toPandas()
    again = mixing.mix_sources(docs, part=25).toPandas()
    key = ["doc_id", "size", "copies"]
    assert small[key].sort_values(key).to_numpy().tolist() == again[key].sort_values(key).to_numpy().tolist()
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_water_filling(spark):
    sized = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 10)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sized).collect()}
    assert got["a"] == 20 and got["b"] == 200 and got[None] == 20 and abs(sum(got.values()) - 1680) < 1e-9


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    size, p = rng.integers(1, 50, 200).astype(float), np.full(200, 0.37)
    q = mixing.flight(mixing.settle_large(p, size, rng, 0.02), np.stack([size, np.ones(200)], axis=1), rng)
    assert ((q > 0) & (q < 1)).sum() <= 2 and abs(q.sum() - p.sum()) < 1e-6 and abs((q * size).sum() - (p * size).sum()) < 1e-6
    mean = np.mean([mixing.flight(p[:6], np.stack([size[:6], np.ones(6)], axis=1), np.random.default_rng(i)) for i in range(2000)], axis=0)
    assert np.abs(mean - 0.37).max() < 0.05


def labelled(spark, n=300):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        good = i % 4 > 0
        words = [r.choice(["the", "river", "stone", "walks", "under", "bright", "sky"]) for _ in range(40)]
        if i % 7 == 0:
            words[5] = r.choice(["idiot", "scum"])
        rows.append((i, " ".join(words) + "." if good else " ".join(w + "%%%" for w in words)))
        if i % 3:
            labels.append((i, int(good), int(i % 7 == 0)))
    rows += [(5000, None), (5001, ""), (None, "the sky"), (1, "the sky"), (5002, "the stone " * 20000)]
    labels += [(7000, 1, 1), (7001, None, None), (None, 1, 1)]
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark):
    docs, labels = labelled(spark)
    model = quality.fit(docs, labels)
    got = quality.score_documents(docs, model)
    assert got.count() == docs.count() and got.where("score < 0 or score > 1 or score is null or held_out is null").count() == 0
    held = got.where("held_out").join(labels, "doc_id").toPandas()
    assert (held["predicted"] == held["quality"]).mean() > 0.95
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == got.where("predicted = 1").count()
    assert quality.score_documents(docs.limit(0), model).count() == 0
    assert {r.score for r in quality.score_documents(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}


def test_non_negative_risk_learns_without_negatives():
    rng = np.random.default_rng(3)
    positive, plain = rng.normal(1.5, 1, (400, 3)), np.concatenate([rng.normal(1.5, 1, (300, 3)), rng.normal(-1.5, 1, (700, 3))])
    w = quality.fit_risk(positive, plain, 0.3)
    assert (quality.forward(rng.normal(1.5, 1, (500, 3)), w)[1] > 0).mean() > 0.9 and (quality.forward(rng.normal(-1.5, 1, (500, 3)), w)[1] < 0).mean() > 0.9


def test_toxicity(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    got = toxicity.score_documents(docs, model)
    assert got.count() == docs.count() and got.where("score < 0 or score > 1 or score is null or held_out is null").count() == 0
    held = got.where("held_out").join(labels, "doc_id").toPandas()
    assert (held["predicted"] == held["toxic"]).mean() > 0.95
    for disguised in ("you 1d10t", "s c u m", "s.c.u.m", "iiidiooot here", "ID!0T"):
        assert model.score([disguised])[0] > 0.3, disguised
    assert (model.score(["the river walks", "", None]) < 0.3).all() and model.restore("an 1d10t walks") == "an idiot walks"
    assert {r.score for r in toxicity.score_documents(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0.0}


def test_character_counts_cover_all_documents(spark):
    docs, _ = labelled(spark)
    texts = [r.text or "" for r in docs.collect()]
    assert toxicity.count_characters(docs).sum() >= sum(map(len, texts))


def test_token_counts(spark, tmp_path):
    import base64

    vocabulary = [bytes([b]) for b in range(97, 123)] + [b"th", b"the", b" the", b"he", b"ing", b" a"]
    path = tmp_path / "v.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for i, t in enumerate(vocabulary)))
    rows = [(1, "the thing  then\n"), (2, None), (3, ""), (4, "  "), (5, "été the"), (None, "a"), (1, "the"), (6, "thething" * 3000)]
    trie = token_counts.PrefixTrie(token_counts.read_vocabulary(str(path)))

    def best(token):
        score = [(0.0, 0)] + [(float("-inf"), 0)] * len(token)
        for e in range(1, len(token) + 1):
            score[e] = max((score[a][0] + trie.weight[token[a:e]], -(-score[a][1] + 1)) for a in range(max(0, e - 8), e) if token[a:e] in trie.weight)
        return -score[-1][1]

    import re

    want = []
    for i, t in rows:
        raw = (t or "").encode()
        pre = re.findall(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", raw)
        want.append((i, len(raw), len(pre), sum(best(p) for p in pre)))
    got = token_counts.count_tokens(frame(spark, rows), vocabulary=str(path))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def test_null_ids_repeated_rows_and_empty_tables(spark):
    rows = [(None, "one two three four five six " * 10), (1, "a b c " * 30), (1, "a b c " * 30), (1, None), (None, None)]
    docs = frame(spark, rows)
    assert suffix_dedup.remove_repeats(docs).count() == 5 and substring_dedup.remove_repeated_windows(docs).count() == 5
    assert simhash_dedup.near_duplicates(docs).count() == 5 and token_counts.count_tokens(docs, "/opt/tokenizers/byte_bpe_50k.tiktoken").count() == 5
    assert simhash_dedup.keep_one(docs).where("doc_id = 1").count() <= 1 and mixing.mixed_documents(docs).columns[-1] == "copies"
    none = docs.limit(0)
    for made in (suffix_dedup.remove_repeats(none), substring_dedup.cut_repeats(none), simhash_dedup.keep_one(none), mixing.mixed_documents(none)):
        assert made.count() == 0


@pytest.mark.parametrize("edit", ["replace", "insert", "drop", "mixed"])
def test_decontamination_finds_every_pair_that_aligns(edit):
    r = random.Random(21)
    words = [f"w{min(r.randrange(400), r.randrange(400))}" for _ in range(20_000)]
    items = [words[i * 60 : i * 60 + r.choice((3, 4, 7, 15, 30, 45))] for i in range(40)]
    texts = [words[5_000 + i * 150 : 5_150 + i * 150] for i in range(40)]
    for i, item in enumerate(items):
        for every in (1, 2, 3, 4, 5, 10):
            copy = []
            for k, w in enumerate(item):
                how = r.choice(("replace", "insert", "drop")) if edit == "mixed" else edit
                if k % every != every - 1:
                    copy.append(w)
                elif how != "drop":
                    copy += ["new"] if how == "replace" else [w, *["new"] * r.choice((1, 1, 2))]
            texts.append(words[9_000 + i * 40 : 9_040 + i * 40] + copy + words[12_000 + i * 40 : 12_040 + i * 40])
    data, offsets = P.text_buffer(pa.array([" ".join(t) for t in texts]))
    found = decontamination.Items(list(range(40)), [" ".join(t) for t in items])
    h, row, at, g = found.grams_of(data, offsets)
    counts = {}
    for key in set(zip(row[at].tolist(), g.tolist())):
        counts[key[1]] = counts.get(key[1], 0) + 1
    found.keep_rare(np.array(list(counts), np.uint64), np.array(list(counts.values()), np.int64))
    got = {(m[0], m[1]): m[2] for m in found.matches(data, offsets)}
    begin = np.searchsorted(row, np.arange(len(texts) + 1))
    want = {(i, k): s / (2 * len(w)) for i in range(len(texts)) for k, w in enumerate(found.words) if (s := decontamination.align(w, h[begin[i] : begin[i + 1]])[0]) >= len(w)}
    assert got == want and len(want) > 100


def test_decontamination_finds_items_leaked_only_as_edited_copies(spark):
    r = random.Random(22)
    items = [[f"w{r.randrange(2_000)}" for _ in range(36)] for _ in range(10)]
    copies = [(i, " ".join(f"x{r.randrange(99)}" if k % 5 == 4 else w for k, w in enumerate(item)), None, None, 0) for i, item in enumerate(items)]
    bench = spark.createDataFrame([(i, " ".join(item)) for i, item in enumerate(items)], "item_id long, text string")
    docs = spark.createDataFrame(copies * 3, DOCS)
    got = decontamination.find_leaks(docs, bench)
    assert {(x.doc_id, x.item_id, x.n_places) for x in got.collect()} == {(i, i, 1) for i in range(10)} and decontamination.drop_leaks(docs, bench).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_keep_one_links_exactly_the_pairs_above_the_threshold(spark, monkeypatch, small):
    r = random.Random(31)
    line = " ".join(f"c{k}" for k in range(12))
    texts = []
    for k in range(30):
        base = [f"w{r.randrange(3_000)}" for _ in range(r.choice((4, 30, 120)))]
        for edits in (0, 1, 2, 3, 4):
            words = list(base)
            for at in r.sample(range(len(base)), min(edits, len(base) - 1)):
                words[at] = f"new{r.randrange(99)}"
            texts.append(" ".join(words) + (f" {line}" if k % 3 == 0 else ""))
    rows = [*enumerate(texts), (900, ""), (901, None), (902, "Two words"), (903, "two  WORDS"), (None, texts[0])]

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t in rows if i is not None}
    alike = lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    likeness = [len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(150) for b in range(a) if sets[a] & sets[b]]
    assert sum(0.7 < x < 0.8 for x in likeness) > 5 and sum(0.8 <= x < 0.9 for x in likeness) > 5
    want = brute_components(sets, [(a, b) for a in sets for b in sets if a < b and alike(a, b)])
    if small:
        near = shingle_dedup.near_duplicates
        monkeypatch.setattr(shingle_dedup, "near_duplicates", lambda *a: near(*a, block_bytes=3_000, tile=3))
    kept = simhash_dedup.keep_one(frame(spark, rows)).collect()
    assert sorted(x.doc_id for x in kept if x.doc_id is not None) == sorted(set(want.values())) and sum(x.doc_id is None for x in kept) == 1
    assert simhash_dedup.keep_one(frame(spark, rows).limit(0)).count() == 0


def test_the_pipeline_compares_shingles_not_fingerprints(spark):
    import corpus_pipeline

    r = random.Random(32)
    rows = []
    for k in range(40):  # 196 shingles: 4 words lost leave 0.815, 5 leave 0.774
        words = [f"w{r.randrange(10_000)}" for _ in range(200)]
        copy = list(words)
        for at in range(20, 20 + 30 * (4 + k % 2), 30):
            copy[at] = "new"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
    kept = {x.doc_id for x in corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), "").collect()}
    assert kept == {i for i in range(80) if i % 4 != 1}
