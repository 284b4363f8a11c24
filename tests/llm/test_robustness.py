"""Blocks, models and stages against plain Python, and on odd input."""

import itertools
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import components, decontamination, mixing, quality, simhash_dedup, substring_dedup, suffix_dedup, toxicity
from millrace.llm import packed as P
from tests.llm.test_operators import DOCS, frame

# Blocks ---------------------------------------------------------------------------


def block_sizes(spark, ids, size=20_000):
    rows = [(i, f"{k} " + "x" * 900, "en", "s", 0) for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    shape = P.corpus_shape(docs, size)
    dealt, _ = P.ordered_blocks(docs, shape)
    found = dealt.select("block", "key", "mark", F.octet_length("text").alias("n")).toPandas()
    order = found.sort_values("block", kind="stable")
    places = [(r.key != r.key, r.key if r.key == r.key else 0, r.mark) for r in order.sort_values(["block", "key", "mark"]).itertuples()]
    assert places == sorted(places)  # blocks rise with (key, mark), nulls last
    return found.groupby("block")["n"].sum()


@pytest.mark.parametrize(
    "ids",
    [
        [(s << 44) + k for s in range(40) for k in range(10)],
        [None] * 400,
        [7] * 400,
        [*range(100), *[5_000] * 200, *[None] * 100],
        [-(1 << 60), *range(398), (1 << 62)],
    ],
    ids=["gaps", "null", "one", "hot", "far"],
)
def test_blocks_are_of_like_size_whatever_the_ids(spark, ids):
    sizes = block_sizes(spark, ids)
    assert len(ids) * 905 / 20_000 <= len(sizes) + 1 and sizes.max() <= 2 * 20_000
    assert len(sizes) <= 2 + 2 * len(ids) * 970 / 20_000


def test_one_id_over_many_blocks_is_one_document(spark):
    r = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(i, f"{passage} " + " ".join(f"w{r.randrange(9_999)}" for _ in range(60))) for i in [None] * 20 + [3] * 20]
    got = suffix_dedup.remove_repeats(frame(spark, rows), block_bytes=1_500).groupBy("doc_id").agg(F.sum("n_removed").alias("n"), F.count(F.lit(1)).alias("rows")).collect()
    by = {x.doc_id: (x.n, x.rows) for x in got}
    assert by[3] == (0, 20) and by[None][1] == 20 and by[None][0] >= 20 * len(passage)
    words = substring_dedup.remove_repeated_windows(frame(spark, rows), block_bytes=1_500).agg(F.sum("n_removed")).first()[0]
    assert words == 39 * 40  # within a document the first place stays


# Toxicity -------------------------------------------------------------------------


def test_viterbi_against_all_readings():
    rng = np.random.default_rng(3)
    cost = rng.random(toxicity.SYMBOLS**3) * 6
    flat = cost.tolist()
    for token in ("1d0t", "ba44b", "a b", "$$.x", "o-o", "c0 0l", "zzz", "a  b", "!d!", "é1é", "0", "..."):
        best = None
        arcs = [toxicity.arcs_of(c, token[i - 1] if i else "") for i, c in enumerate(token)]
        for path in itertools.product(*arcs):
            state, total, out = 0, 0.0, ""
            for symbol, letter, extra in path:
                total += extra
                if symbol < 0 or symbol == 0 and not state & 63:
                    continue
                total += flat[state << 6 | symbol]
                state = (state & 63) << 6 | symbol
                out += letter
            total += flat[state << 6] if state & 63 else 0.0
            best = min(best or (total, out), (total, out))
        read, value = toxicity.decode(token, flat)
        assert abs(value - best[0]) < 1e-9 and read == best[1].strip(" ")


def spoken_model():
    words = ["loser", "moron", "clown", "idiot"]
    counts = np.zeros(toxicity.SYMBOLS**3)
    for line in ["such a loser", "you moron", "what a clown", "the river walks", "an idiot", "see the old tree"] * 50:
        s = np.r_[np.uint8(0), toxicity.symbols_of(line), np.uint8(0)].astype(np.int64)
        np.add.at(counts, (s[:-2] << 12) | (s[1:-1] << 6) | s[2:], 1)
    return toxicity.Model(toxicity.own_words(toxicity.cost_table(counts), words), words, np.ones(4))


@pytest.mark.parametrize(
    ("text", "word"),
    [("such a l o s e r", "loser"), ("y o u m o r o n", "moron"), ("a lo se r", "loser"), ("c-l.o_w*n", "clown"), ("1d10t", "idiot"), ("mmmooorrrooonnn", "moron"), ("c10wn!!", "clown"), ("(l0wn", "clown"), ("i d 1 0 t", "idiot"), ("LO$ER", "loser")],
)
def test_disguises_are_seen_through(text, word):
    model = spoken_model()
    assert model.evidence(text) == [model.place[word]] and word in model.restore(text)


def test_plain_text_stays_plain():
    model = spoken_model()
    assert model.evidence("the old tree by the river, 1990-2000 (see p. 4)") == [] and model.restore("the river walks") == "the river walks"


def test_very_long_tokens_take_linear_time():
    r = random.Random(1)
    model = spoken_model()
    token = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(1 << 20))
    began = time.time()
    model.evidence(token)
    model.evidence("a " * 500_000)
    assert time.time() - began < 120


# Quality --------------------------------------------------------------------------


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.85])
def test_the_prior_of_a_known_mixture_is_found(prior):
    rng = np.random.default_rng(8)
    n = 20_000
    positive = rng.normal(2, 1, 3_000)
    plain = np.concatenate([rng.normal(2, 1, int(n * prior)), rng.normal(-2, 1, n - int(n * prior))])
    found = quality.prior_of(positive, plain, np.ones(n))
    assert abs(found - prior) < 0.05
    slope, shift = quality.fit_posterior(positive, plain, np.ones(n), found)
    x = np.linspace(-2, 2, 9)
    true = 1 / (1 + (1 - prior) / prior * np.exp(-4 * x))
    assert np.abs(quality.sigmoid(slope * x + shift) - true).max() < 0.2


def test_no_label_zero_is_read(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["river", "stone", "under", "sky"]) + ("." if i % 4 else "%%%") for _ in range(40))) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 400, 3)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    one, two = quality.fit(docs, labels), quality.fit(docs, labels.withColumn("quality", F.when(F.col("quality") == 1, 1)))
    assert one.prior == two.prior and one.scale == two.scale and 0.6 < one.prior < 0.9
    got = quality.classify(docs, labels).toPandas()
    assert ((got["predicted"] == 1) == (got["doc_id"] % 4 > 0)).mean() > 0.97


def test_every_document_counts_among_the_unlabelled(spark):
    rows = [(i, f"text number {i} " * (1 + i % 7)) for i in range(300)] + [(None, None), (301, "")]
    counted = quality.statistics(frame(spark, rows).repartition(6))
    x, share = quality.drawn(counted, lambda v: (v[:, 10] * 100).astype(np.int64) % quality.CELLS, most=2)
    assert abs(share.sum() - 302) < 1e-6 and len(x) < 302


# Mixing and decontamination ---------------------------------------------------------


def test_mixing_columns_against_plain_python(spark):
    r = random.Random(12)
    names = ["b", "a", None, "\U0001f600", "￿", "Z", "é"]
    rows = [(i, " ".join("w" for _ in range(r.randrange(1, 50 * (1 + names.index(s))))), "en", s, 0) for i, s in enumerate(r.choices(names, k=400))] + [(900, None, "en", "a", 0), (901, " \t\n", "en", "new", 0)]
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    sources = sorted({x[3] for x in rows}, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    whole = {s: sum(size[x[0]] for x in rows if x[3] == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, open_, left = {}, list(sources), 1.5 * sum(whole.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level > 2 * whole[s]]
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in full:
            target[s] = 2.0 * whole[s]
            left -= target[s]
            open_.remove(s)
    got = mixing.digest(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    by = {x.doc_id: x for x in got}
    for i, _, _, s, _ in rows:
        assert by[i].size == size[i] and by[i].source_size == whole[s] and abs(by[i].target - target[s]) < 1e-6 and 0 <= by[i].taken <= 2 * size[i]
    for s in sources:
        assert abs(sum(by[x[0]].taken for x in rows if x[3] == s) - target[s]) <= max(size[x[0]] for x in rows if x[3] == s)


def test_hot_rows_are_dealt_to_parts(spark):
    docs = spark.createDataFrame([(None, f"w{k} " * (k % 9), "en", "s", 0) for k in range(300)] + [(5, f"v{k} x", "en", "s", 0) for k in range(300)], DOCS)
    got = mixing.mix_sources(docs, part=20).toPandas()
    assert len(got) == 600 and abs(got["taken"].sum() - got["target"].iloc[0]) < 40


def test_decontamination_query_against_all_pairs(spark):
    r = random.Random(33)
    words = [f"w{r.randrange(60)}" for _ in range(3_000)]
    items = [(k, " ".join(words[k * 40 : k * 40 + r.choice((2, 3, 5, 9, 20, 33))])) for k in range(30)] + [(31, None), (None, "w1 w2 w3"), (32, "")]
    rows = [(i, " ".join(words[i * 35 : i * 35 + 90])) for i in range(70)] + [(200, None), (201, ""), (None, items[4][1]), (3, items[5][1].upper()), (3, items[5][1].upper())]
    split = lambda t: np.array([hash(w) for w in re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())])
    want = []
    for i, t in rows:
        for k, item in items:
            own = split(item)
            if k is None or item is None or len(own) < 3 or not len(split(t)):
                continue
            h = np.zeros((len(own) + 1, len(split(t)) + 1), int)
            text = split(t)
            for a in range(len(own)):
                for b in range(len(text)):
                    h[a + 1, b + 1] = max(0, h[a, b] + (2 if own[a] == text[b] else -1), h[a, b + 1] - 1, h[a + 1, b] - 1)
            if h.max() >= len(own):
                want.append((i, k, round(h.max() / (2 * len(own)), 9)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(x.doc_id, x.item_id, round(x.score, 9)) for x in decontamination.find_leaks(frame(spark, rows), bench, slice_bytes=900).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 60


def test_alignment_of_long_texts_holds_one_row(spark):
    rng = np.random.default_rng(1)
    text = rng.integers(0, 1 << 40, 300_000)
    score, first, last = decontamination.align(text[1_000:1_400], text)
    assert (score, first, last) == (800, 1_000, 1_399)


# Stages ---------------------------------------------------------------------------


CLASHING = ("_key", "_nth", "copies", "_copies", "key", "mark", "name", "group", "row", "block", "again", "_kept", "label", "score", "component")


def clashing(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], DOCS)
    return docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    spark.createDataFrame([(1, "never seen words of a test item that nobody holds")], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_keep_columns_with_clashing_names(spark, tables, stage):
    r = random.Random(4)
    text = lambda: " ".join(f"w{r.randrange(500)}" for _ in range(60))
    same = text()
    rows = [(i, text()) for i in range(30)] + [(50, same), (51, same), (51, same), (52, None), (None, ""), (None, text()), (53, "long " * 200_000), (54, " ")]
    docs = clashing(spark, rows)
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, tables)
    more = ["copies_2"] if stage == "mix" else []
    assert out.columns == [*docs.columns, *more]
    kept = out.collect()
    assert kept and all(x[c] == f"own {c}" for x in kept for c in CLASHING)


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_an_empty_table_and_on_null_texts(spark, tables, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    docs = frame(spark, [(1, "a b")])
    assert run(spark, docs.limit(0), tables).count() == 0
    nulls = run(spark, spark.createDataFrame([(1, None, None, None, None), (2, None, None, None, None), (None, None, None, None, None)], DOCS), tables)
    assert nulls.count() <= 3


def test_the_pipeline_leaves_only_its_last_input(spark, tables, tmp_path, monkeypatch):
    r = random.Random(6)
    frame(spark, [(i, " ".join(f"w{r.randrange(900)}" for _ in range(50)) + ".") for i in range(60)]).write.parquet(f"{tables}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "shared_folder", lambda spark: str(tmp_path))
    corpus_pipeline.run(spark, tables).collect()
    assert [p.name for p in tmp_path.glob("pipeline-*/*")] == ["benchmark_leaks"]


def test_a_cluster_without_a_shared_folder_is_an_error(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        components.shared_folder(Session())


# Pigeonring of the stage ------------------------------------------------------------


def test_chains_prune_no_pair_within_the_limit():
    rng = np.random.default_rng(2)
    limit = simhash_dedup.wide_limit(0.8)
    one = rng.integers(0, 1 << 63, 4).astype(np.uint64)
    others, apart = [], []
    for _ in range(400):
        n = int(rng.integers(0, 2 * limit))
        flip = np.zeros(256, bool)
        flip[rng.choice(256, n, replace=False)] = True
        others.append(one ^ np.packbits(flip).view(np.uint64))
        apart.append(n)
    got = simhash_dedup.near_enough(one, np.stack(others), np.full(400, 99), 0.8)
    assert got.tolist() == [n <= limit for n in apart]


def test_fingerprints_of_near_duplicates_stay_within_the_limit():
    r = np.random.default_rng(9)
    limit, far = simhash_dedup.wide_limit(0.8), 0
    for n in (40, 200, 1_000):
        for _ in range(40):
            both, own = int(n * 8 / 9) + 1, n - int(n * 8 / 9) - 1  # likeness just above 0.8
            shared = r.integers(0, 1 << 63, both).astype(np.uint64)
            a, b = (np.sort(np.r_[shared, r.integers(0, 1 << 63, own).astype(np.uint64)]) for _ in range(2))
            marks = simhash_dedup.wide_fingerprints(np.r_[a, b], np.repeat([0, 1], n), 2)
            far += int(np.bitwise_count(marks[0] ^ marks[1]).sum()) > limit
    assert far == 0


def test_wide_fingerprints_against_plain_counting():
    r = np.random.default_rng(4)
    grams, row = r.integers(0, 1 << 63, 200_000).astype(np.uint64), np.sort(r.integers(0, 7, 200_000))
    row[row == 3] = 4
    got = simhash_dedup.wide_fingerprints(grams, row, 8)
    for k in range(simhash_dedup.WORDS):
        hashes = P.mix(grams, 16 + k)
        for i in range(8):
            own = hashes[row == i]
            want = sum(1 << b for b in range(64) if 2 * int(((own >> np.uint64(b)) & np.uint64(1)).sum()) > len(own))
            assert int(got[i, k]) == want


def test_place_names_sort_like_places():
    keys = pa.array([5, None, -3, 5, 1 << 62, 0, None], pa.int64())
    marks = pa.array([-1, 4, 9, 7, 0, -(1 << 63), -4], pa.int64())
    order = np.argsort(P.sorted_places(P.place_names(keys, marks)), kind="stable").tolist()
    want = sorted(range(7), key=lambda i: (keys[i].as_py() is None, keys[i].as_py() or 0, marks[i].as_py()))
    assert order == want


@pytest.mark.parametrize("length", [3, 8, 13])
def test_suffix_families_find_strings_with_zero_bytes(length):
    r = np.random.default_rng(length)
    family, seen = suffix_dedup.SuffixFamily(length), {}
    for batch in range(25):
        text = r.choice(np.array([0, 1, 97, 255], np.uint8), 60)
        at = np.arange(60 - length + 1)
        own = r.integers(batch, batch + 3, len(at))
        least = dict(seen)
        for a, o in zip(at.tolist(), own.tolist(), strict=True):
            k = text[a : a + length].tobytes()
            least[k] = min(least.get(k, o), o)
        assert family.add(text, at, own).tolist() == [least[text[a : a + length].tobytes()] for a in at]
        seen = least
    for level in family.levels:
        keys = family._keys(level["text"], level["at"])
        assert (keys[1:] > keys[:-1]).all()
