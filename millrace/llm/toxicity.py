"""Toxicity behind disguise: noisy-channel deobfuscation, then a lexicon's score.

Tokens that may be disguised - digits or marks among letters, letters drawn out -
and runs of very short tokens become character lattices: a symbol may be itself or
a letter that it stands for, a mark may vanish, a repeated symbol may shrink, the
space between two short tokens may vanish or stay.  ``decode`` finds the likeliest
reading exactly, by Viterbi over positions and the last two letters, under a
character trigram model times the channel's costs; its time is linear in the
token.  The model is counted over the letters of all documents, mixed with the
letters of the lexicon's words.

Words of the restored text (as they stand and as decoded), and their beginnings,
are looked up in a lexicon learned from the training labels: the features of the
highest likelihood ratio that explain toxic rows which the ones before leave
unexplained.  A text's score is the fitted logistic of its features' log odds.

``fit`` reads a sample bounded by ``bound`` labelled rows; the character counts
and the scores cover every whole text.

Defined results for odd input: a null or empty text restores to the empty text
and gets the score of no evidence; rows with an equal doc_id are scored each for
itself; a null doc_id is not held out; without toxic labels every score is 0;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import cut_lineage
from millrace.llm.labelled import remainder, training_rows
from millrace.llm.quality import fit_scale, sigmoid

BOUND = 12_000
THRESHOLD = 0.3
MODULUS, HELD = 4, 2
#: Letters that a symbol may stand for. Fixed values.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "{": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
#: Channel costs in nats: a symbol for a letter, a mark put in, a symbol put in that stands for letters, a symbol drawn out, a space put in.
SUBSTITUTE, INSERT, INSERT_SIGN, REPEAT, SPACED = 1.0, 0.7, 5.0, 0.5, 0.7
#: Share of the lexicon's words in the character model.
OWN_WORDS = 0.3
#: Decoded tokens up to this length are remembered.
REMEMBERED = 64
#: Words and word beginnings of these lengths are the lexicon's features.
BEGINNINGS = (4, 5, 6, 7)
#: A feature needs so many toxic rows; so many with the highest likelihood ratio enter the fit.
LEAST, LEXICON = 3, 1_500
#: A pick needs so much log likelihood ratio; others join with this share of the picks' largest support.
ENOUGH, ALIKE = 10.0, 0.15
DRAWN_OUT = re.compile(r"(\w)\1\1")
EDGE = ".,;:!?\"'()[]{}<>«»¿¡*_~`"
OUTSIDE = "".join(c for c in EDGE if c not in STANDS_FOR)
#: Letters of the model: boundary 0, a-z 1-26, U+00DF-U+00FF 27-59, any other letter 60, anything else 61.
SYMBOLS = 64
OTHER, MARK = 60, 61


def symbol_table() -> np.ndarray:
    """Model symbol of every code point below U+0250, by rule from the lower-case letter."""
    out = np.full(0x250, MARK, np.uint8)
    for code in range(0x250):
        low = chr(code).lower()
        if len(low) != 1 or not low.isalpha():
            continue
        c = ord(low)
        out[code] = c - 96 if 97 <= c <= 122 else 27 + c - 0xDF if 0xDF <= c <= 0xFF else OTHER
    for code in (9, 10, 11, 12, 13, 32):
        out[code] = 0
    return out


TABLE = symbol_table()


def symbols_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return TABLE[points] if not len(points) or points.max() < 0x250 else np.where(points < 0x250, TABLE[np.minimum(points, 0x24F)], OTHER).astype(np.uint8)


def count_characters(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Trigram counts of model symbols over all documents; a table of fixed size."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            at, size = 0, pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy()
            while at < batch.num_rows:  # some MB of texts at once
                end = max(at + 1, int(np.searchsorted(np.cumsum(size[at:]), 2 << 20)) + at)
                line = "\n".join(x or "" for x in batch.column(0).slice(at, end - at).to_pylist())
                s = np.r_[np.uint8(0), symbols_of(line), np.uint8(0)].astype(np.int32)
                total += np.bincount((s[:-2] << 12) | (s[1:-1] << 6) | s[2:], minlength=SYMBOLS**3)
                at = end
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], ["gram", "n"])

    rows = docs.select(F.col(text).cast("string")).mapInArrow(each, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SYMBOLS**3)
    out[rows["gram"].to_numpy(np.int64)] = rows["n"].to_numpy(float)
    return out


def cost_table(counts: np.ndarray) -> np.ndarray:
    """-log p(c | a, b), trigrams smoothed by bigrams and those by letters."""
    n3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    n2, n1 = n3.sum(0), n3.sum((0, 1))
    p1 = (n1 + 0.5) / (n1 + 0.5).sum()
    p2 = (n2 + 5 * p1) / (n2.sum(1, keepdims=True) + 5)
    return -np.log((n3 + 5 * p2[None]) / (n3.sum(2, keepdims=True) + 5))


def suspicious(core: str) -> bool:
    """Whether a token may be disguised: letters with other symbols among them, or a letter three times on end."""
    return not core.isalpha() and any(c.isalpha() for c in core) or DRAWN_OUT.search(core) is not None


def own_words(cost: np.ndarray, words: list[str], share: float = OWN_WORDS) -> np.ndarray:
    """The model's costs, mixed with the trigrams of some words."""
    counts = np.zeros(SYMBOLS**3)
    for word in words:
        s = np.r_[0, 0, symbols_of(word), 0].astype(np.int64)
        np.add.at(counts, (s[:-2] << 12) | (s[1:-1] << 6) | s[2:], 1)
    n3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    seen = n3.sum(2, keepdims=True)
    return -np.log(np.where(seen > 0, (1 - share) * np.exp(-cost) + share * n3 / np.maximum(seen, 1), np.exp(-cost)))


def arcs_of(c: str, before: str) -> list[tuple[int, str, float]]:
    """What a symbol may be, after the symbol before it: model symbol, letter and cost; -1 if it vanishes."""
    if c == " ":
        return [(0, " ", 0.0), (-1, "", SPACED)]
    arcs = [(int(symbols_of(c)[0]), c, 0.0)] if c.isalpha() else [(-1, "", INSERT_SIGN if c in STANDS_FOR else INSERT)]
    arcs += [(int(symbols_of(x)[0]), x, SUBSTITUTE) for x in STANDS_FOR.get(c, "")]
    if c == before:
        arcs.append((-1, "", REPEAT))
    return arcs


def decode(token: str, cost: list[float]) -> tuple[str, float]:
    """The likeliest reading of a token, or of tokens with blanks between, and its cost; ``cost`` is flat.

    Viterbi: of all readings that end in the same two letters only the likeliest goes on.
    """
    known: dict[tuple[str, str], list[tuple[int, str, float]]] = {}
    states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    before = ""
    for c in token:
        arcs = known.get((c, before if c == before else ""))
        if arcs is None:
            arcs = known[c, before if c == before else ""] = arcs_of(c, before)
        nxt: dict[int, tuple[float, tuple | None]] = {}
        for state, (total, path) in states.items():
            for symbol, letter, extra in arcs:
                if symbol < 0:
                    key, value, node = state, total + extra, path
                elif symbol == 0 and not state & 63:  # a space after a space, or in front
                    key, value, node = state, total + extra, path
                else:
                    key = (state & 63) << 6 | symbol
                    value, node = total + extra + cost[state << 6 | symbol], (path, letter)
                old = nxt.get(key)
                if old is None or value < old[0]:
                    nxt[key] = (value, node)
        states, before = nxt, c
    best, end = math.inf, None
    for state, (total, path) in states.items():
        total += cost[state << 6] if state & 63 else 0.0
        if total < best:
            best, end = total, path
    out = []
    while end is not None:
        end, letter = end
        out.append(letter)
    return "".join(reversed(out)).strip(" "), best


#: Three or more tokens of one or two characters on end, in one line.
SPELLED = re.compile(r"(?<!\S)(?:\S{1,2}[ \t]+){2,}\S{1,2}(?!\S)")
#: Three or more single characters on end, in one line: read for themselves too, without the short words beside them.
SINGLES = re.compile(r"(?<!\S)(?:\S[ \t]+){2,}\S(?!\S)")
BLANKS = re.compile(r"[ \t]+")


def word_features(word: str) -> list[str]:
    """A word and its beginnings, as names of features."""
    return [word, *(f"{word[:n]}^" for n in BEGINNINGS if len(word) > n)]


class Model:
    """Character costs and the lexicon's weights; scores and restores texts."""

    def __init__(self, cost: np.ndarray, features: list[str] | None = None, weights: np.ndarray | None = None, scale: tuple[float, float] = (1.0, 0.0), plain: bool = False):
        self.cost, self.features, self.scale, self.plain = cost, list(features or []), scale, plain
        self.weights = np.zeros(len(self.features)) if weights is None else weights
        self.ready()

    def ready(self) -> None:
        self.flat = self.cost.ravel().tolist()
        self.place = {f: i for i, f in enumerate(self.features)}
        self.heads = {f[: BEGINNINGS[0]].removesuffix("^") for f in self.features}
        self.begins = {n: {f[:-1]: i for f, i in self.place.items() if f[-1:] == "^" and len(f) == n + 1} for n in BEGINNINGS}
        self.known: dict[str, tuple[int, ...]] = {}  # tokens and runs with features, and those without
        self.idle: set[str] = set()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k in ("cost", "features", "scale", "plain", "weights")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.ready()

    def look_up(self, word: str) -> tuple[int, ...]:
        if word[: BEGINNINGS[0]] not in self.heads:
            return ()
        found = [self.place[word]] if word in self.place else []
        for n, begins in self.begins.items():
            if len(word) > n and word[:n] in begins:
                found.append(begins[word[:n]])
        return tuple(found)

    def readings(self, token: str) -> list[tuple[str, float]]:
        """What a token may say if it may be disguised: its likeliest readings without the marks around it and with them, the likelier first."""
        low = token.lower()
        core = low.strip(EDGE)
        if core.isalpha() and low[0] not in STANDS_FOR and low[-1] not in STANDS_FOR and not DRAWN_OUT.search(core):
            return []
        return sorted((decode(form, self.flat) for form in {core, low.strip(OUTSIDE)} if suspicious(form)), key=lambda x: (x[1], x[0]))

    def run_reading(self, run: str) -> str:
        """What a run of short tokens says."""
        return decode(BLANKS.sub(" ", run.lower()), self.flat)[0]

    def word(self, token: str) -> tuple[int, ...]:
        """Lexicon features of a token, as it stands and as it reads."""
        found = self.look_up(token.lower().strip(EDGE))
        if self.plain:
            return found
        return tuple({*found, *(i for read, _ in self.readings(token) for w in read.split() for i in self.look_up(w))})

    def evidence(self, text: str) -> list[int]:
        """The distinct lexicon features of a text."""
        found: set[int] = set()
        if len(self.idle) + len(self.known) > 400_000:
            self.idle.clear()
            self.known.clear()
        pieces = set(text.split())
        if not self.plain:
            for run in SPELLED.findall(text):
                pieces.add(run)
                pieces.update(SINGLES.findall(run))
        for piece in pieces - self.idle:
            ids = self.known.get(piece)
            if ids is None:
                ids = self.word(piece) if len(piece.split(None, 1)) == 1 else tuple({i for w in self.run_reading(piece).split() for i in self.look_up(w)})
                if len(piece) <= REMEMBERED:
                    if ids:
                        self.known[piece] = ids
                    else:
                        self.idle.add(piece)
            found.update(ids)
        return sorted(found)

    def restore(self, text: str) -> str:
        """The text with disguised tokens and runs spelled out."""
        joined = SPELLED.sub(lambda m: self.run_reading(m[0]), text)
        return re.sub(r"\S+", lambda m: self.plainest(m[0]), joined)

    def plainest(self, token: str) -> str:
        """A token as it most likely reads: a reading that the lexicon knows before others, the likelier one before others."""
        reads = [r for r, _ in self.readings(token)]
        return next((r for r in reads if any(self.look_up(w) for w in r.split())), reads[0] if reads else token)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not self.features:
            return np.zeros(len(texts))
        return sigmoid(self.scale[0] * np.array([self.strength(self.evidence(t or "")) for t in texts]) + self.scale[1])

    def strength(self, ids: list[int] | np.ndarray) -> float:
        """A text's evidence in one number: its strongest feature, and a little for each more."""
        w = self.weights[np.asarray(ids, np.int64)]
        return float(w.max() + np.log1p(w.sum())) if len(w) else 0.0


def gain(yes: np.ndarray, no: np.ndarray, rate: float) -> np.ndarray:
    """Log likelihood ratio of each feature's rows against the rate of toxic rows; 0 where it is below the rate."""
    n = np.maximum(yes + no, 1)
    part = lambda k, q: np.where(k > 0, k * np.log(np.maximum(k, 1) / (n * q)), 0.0)
    return np.where(yes > n * rate, part(yes, rate) + part(no, max(1 - rate, 1e-9)), 0.0)


def pick_lexicon(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Features that explain the toxic rows: the best one of the rows still unexplained, again and again.

    Then features of like support and precision join, whose rows others explain.
    """
    yes, no = y @ x, (1 - y) @ x
    picked: list[int] = []
    open_ = np.ones(len(y), bool)
    while y[open_].any():
        part, label = x[open_], y[open_]
        value = gain(label @ part, (1 - label) @ part, max(label.mean(), 1e-3))
        best = int(np.argmax(value))
        if value[best] < ENOUGH:
            break
        picked.append(best)
        open_ &= x[:, best] == 0
    if picked:
        precise = yes >= 0.95 * (yes + no)
        picked += np.flatnonzero(precise & (yes >= max(LEAST, ALIKE * yes[picked].max()))).tolist()
    return np.unique(np.array(picked, np.int64))


def texts_of(batch: pa.RecordBatch, column: int, rows: int = 256) -> Iterator[tuple[int, int, list]]:
    for a in range(0, batch.num_rows, rows):
        b = min(a + rows, batch.num_rows)
        yield a, b, batch.column(column).slice(a, b - a).to_pylist()


def fit(docs: DataFrame, labels: DataFrame, bound: int = BOUND, modulus: int = MODULUS, held: int = HELD) -> Model:
    """Character counts over all documents; lexicon and scale from at most some ``bound`` labelled rows."""
    cost = cost_table(count_characters(docs))
    rows = cut_lineage(training_rows(docs, labels, "toxic", modulus, held, bound))

    def features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], int] = {}
        totals = [0, 0]
        for batch in batches:
            for a, _, texts in texts_of(batch, 1):
                for text, label in zip(texts, batch.column(0).slice(a, len(texts)).to_pylist(), strict=True):
                    totals[label > 0] += 1
                    for f in {f for token in set((text or "").split()) for f in word_features(token.strip(EDGE).lower())}:
                        seen[f, label > 0] = seen.get((f, label > 0), 0) + 1
        seen["", False], seen["", True] = totals
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in seen]), pa.array([y for _, y in seen]), pa.array(list(seen.values()), pa.int64())], ["feature", "toxic", "n"])

    counted = rows.select("label", "text").mapInArrow(features_of, "feature string, toxic boolean, n long")
    sums = cut_lineage(counted.groupBy("feature").agg(F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("yes"), F.sum(F.when(F.col("toxic"), 0).otherwise(F.col("n"))).alias("no")))
    total = sums.where("feature = ''").first()
    yes, no = (int(total["yes"]), int(total["no"])) if total else (0, 0)
    if not yes:
        return Model(cost)
    rate, n = yes / (yes + no), F.col("yes") + F.col("no")
    term = lambda k, q: F.when(k > 0, k * F.log(k / (n * q))).otherwise(0.0)
    value = term(F.col("yes"), rate) + term(F.col("no"), max(1 - rate, 1e-9))
    few = sums.where((F.col("feature") != "") & (F.col("yes") >= LEAST) & (F.col("yes") > n * rate * 2)).orderBy(F.desc(value), "feature").limit(LEXICON).toPandas()
    names = few["feature"].to_list()

    def evidence(model: Model) -> tuple[np.ndarray, np.ndarray]:
        """Labels, and which candidates each row has."""

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [model.evidence(t or "") for _, _, texts in texts_of(batch, 2) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["key", "label", "ids"])

        seen = rows.mapInArrow(each, "key long, label int, ids array<int>").toPandas().sort_values(["key", "label"], kind="stable")
        x = np.zeros((len(seen), len(names)), np.float32)
        for i, ids in enumerate(seen["ids"]):
            x[i, ids] = 1
        return (seen["label"] > 0).to_numpy(np.float32), x

    # words of the lexicon as rows spell them out; then the lexicon of the restored rows
    y, x = evidence(Model(cost, names, np.ones(len(names)), plain=True))
    words = [names[i] for i in pick_lexicon(x, y) if names[i][-1:] != "^"]
    cost = own_words(cost, words)
    y, x = evidence(Model(cost, names, np.ones(len(names))))
    keep = pick_lexicon(x, y)
    if not len(keep):
        return Model(cost)
    x = x[:, keep]
    weights = np.log((y @ x + 0.5) / (y.sum() + 1)) - np.log(((1 - y) @ x + 0.5) / ((1 - y).sum() + 1))
    model = Model(cost, few["feature"].iloc[keep].to_list(), np.maximum(weights, 0.1).astype(float))
    model.scale = fit_scale(np.array([model.strength(np.flatnonzero(r)) for r in x]), y.astype(float))
    return model


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD, modulus: int = MODULUS, held: int = HELD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.concatenate([model.score(texts) for _, _, texts in texts_of(batch, 1)] or [np.empty(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), modulus) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
