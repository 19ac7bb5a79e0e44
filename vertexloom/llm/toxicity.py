"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: how dense it is in words of a lexicon, how near these
stand to words of the second person, capitals, punctuation, symbols, and words
that hide letters behind other signs. The lexicon is a fixed list of insults
and the words that the learning rows show to be far more common in toxic
documents, with its beginnings of words, as insults take endings. Trees are grown by histograms on the logistic loss on three
quarters of the learning sample; on the rest, isotonic regression turns their
sum into a probability. A document that trees are grown on is measured with
words learned without its quarter, as words learned from itself would give its
label away. Learning takes a bounded sample of labelled rows:
``MAX_POSITIVE`` toxic and ``MAX_NEGATIVE`` other ids, the first in a hash
order, with one document each, weighted to stand for all.

Defined cases: a null text counts as empty; an id with several labels is toxic
if any of them says so, and of an id with several documents the one with the
least hash is learned from; labels that are null or have no id are not learned
from; with no toxic or no other document to learn from, every score is the
share of toxic labels (0 without labels); equal texts have equal scores; an
empty table gives an empty result. Whole texts are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.arrow import slices, with_columns
from vertexloom.functions.shared import materialize
from vertexloom.llm.langid import remainder

MAX_POSITIVE, MAX_NEGATIVE = 8_000, 16_000
#: A learned word is in this share of toxic documents at least and in LEAST_DOCS, and this many times the share of others.
#: So words are at most 1 / WORD_SHARE times as many as a toxic document of the sample has different ones on average.
WORD_SHARE, WORD_LIFT = 0.002, 8.0
STEM_SHARE, STEM_LIFT = 0.005, 3.0
LEAST_DOCS = 4
#: Bytes of a stem: the beginning of a longer word.
STEM = 6
TREES, DEPTH, RATE, BINS, LEAST, RIDGE = 60, 3, 0.2, 48, 20.0, 1.0

# Insults, and words of the second person in four languages.
INSULTS = (
    "idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown clowns fool fools "
    "imbecile filthy vermin ugly liar coward freak creep hate kill shut crap damn hell bastard bitch whore slut "
    "dumm dummkopf trottel arschloch abschaum widerlich versager connard imbécile ordure dégoûtant salaud nul "
    "estúpido idiota imbécil basura asqueroso patético payaso perdedor"
).split()
SECOND_PERSON = (
    "you your yours yourself u ur youre du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos "
    "tú ti tus usted ustedes vosotros vuestro"
).split()

YOU = frozenset(w.encode() for w in SECOND_PERSON)
UPPER = bytes(range(ord("A"), ord("Z") + 1))
DIGITS = b"0123456789"
SYMBOLS = b"#*$%&|<>@^~+=_\\/"
STOPS = b".,;:!?\"'()[]{}-"
BLANK = bytes.maketrans(bytes(i for i in range(128) if not chr(i).isalnum()), b" " * sum(not chr(i).isalnum() for i in range(128)))
#: Signs that stand for letters.
LEET = bytes.maketrans(b"0134578@$!|", b"oieastbasil")
HIDDEN = re.compile(rb"[a-z]+[013-578@$!|*.\-_]+(?=[a-z])[a-z013-578@$!|*.\-_]*[a-z]").findall
DROPPED = b"*.-_"
SHOUTED = re.compile(rb"\b[A-Z]{2,}\b").findall

FEATURES = (
    "log_words hits_a_word log_hits different_hits weight_a_word weight most_weight "
    "stems_a_word log_stems different_stems stem_weight you_a_word nearness capitals shouted "
    "exclaimed asked stops symbols digits hidden_a_word hidden_hits word_length hits_a_line"
).split()


class Lexicon:
    """Words and stems with their weights; insults that the sample says nothing about weigh 1."""

    def __init__(self, words: dict[bytes, float], stems: dict[bytes, float]):
        self.weights = {w.encode(): 1.0 for w in INSULTS} | words
        self.stems = stems

    def features(self, text: bytes) -> tuple[float, ...]:
        low = text.lower()
        words = low.translate(BLANK).split()
        n, size = max(1, len(words)), max(1, len(text))
        weights, stems = self.weights, self.stems
        hits = [(i, w) for i, w in enumerate(words) if w in weights]
        begun = [w for w in words if w[:STEM] in stems]
        you = [i for i, w in enumerate(words) if w in YOU]
        hidden = HIDDEN(low)
        unhidden = sum(h.translate(LEET) in weights or h.translate(LEET, DROPPED) in weights for h in hidden)
        held = [weights[w] for _, w in hits]

        def rate(signs: bytes) -> float:
            return (len(text) - len(text.translate(None, signs))) / size

        return (
            np.log1p(len(words)), len(hits) / n, np.log1p(len(hits)), len({w for _, w in hits}), sum(held) / n, sum(held), max(held, default=0.0),
            len(begun) / n, np.log1p(len(begun)), len(set(begun)), sum(stems[w[:STEM]] for w in begun) / n,
            len(you) / n, nearness([i for i, _ in hits], you), rate(UPPER), len(SHOUTED(text)) / n,
            rate(b"!"), rate(b"?"), rate(STOPS), rate(SYMBOLS), rate(DIGITS), len(hidden) / n, unhidden, size / n, len(hits) / (1 + text.count(b"\n")),
        )


def nearness(hits: list[int], you: list[int]) -> float:
    """Mean over the hits of 1 / (1 + words to the nearest second person); 0 without either."""
    if not hits or not you:
        return 0.0
    total = 0.0
    for h in hits:
        at = bisect_left(you, h)
        total += 1 / (1 + min(abs(h - y) for y in you[max(0, at - 1) : at + 1]))
    return total / len(hits)


@dataclass
class Forest:
    """Boosted trees of one depth: in a tree, node ``i`` has the children ``2 i + 1`` and ``2 i + 2``."""

    base: float
    feature: np.ndarray  # (trees, inner nodes)
    limit: np.ndarray
    leaf: np.ndarray  # (trees, leaves)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Forest:
    """Trees for the weighted logistic loss, each split chosen from histograms of gradients."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    n_features, width = x.shape[1], BINS + 1
    flat = bins + width * np.arange(n_features)
    p0 = np.clip(np.average(y, weights=w), 1e-6, 1 - 1e-6)
    base = float(np.log(p0 / (1 - p0)))
    margin = np.full(len(x), base)
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    feature, limit, leaf = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, leaves))
    for t in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (y - p), w * np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(x), np.int64)
        for k in range(inner):
            own = np.flatnonzero(node == k)
            found = _split(flat[own], g[own], h[own], w[own], n_features, width, cuts)
            if found:
                feature[t, k], at = found
                limit[t, k] = cuts[feature[t, k]][at]
            node[own] = 2 * k + 1 + (x[own, feature[t, k]] > limit[t, k])
        place = node - inner
        leaf[t] = RATE * np.bincount(place, g, leaves) / (np.bincount(place, h, leaves) + RIDGE)
        margin += leaf[t][place]
    return Forest(base, feature, limit, leaf)


def _split(flat, g, h, w, n_features, width, cuts) -> tuple[int, int] | None:
    """(feature, cut) with the largest gain, each side weighing LEAST at least."""
    if not len(flat):
        return None
    sums = [np.bincount(flat.ravel(), np.repeat(v, n_features), n_features * width).reshape(n_features, width).cumsum(axis=1) for v in (g, h, w)]
    gl, hl, wl = (s[:, :-1] for s in sums)
    gt, ht, wt = (s[:, -1:] for s in sums)
    gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
    room = np.arange(width - 1)[None, :] < np.array([len(c) for c in cuts])[:, None]
    gain[~room | (wl < LEAST) | (wt - wl < LEAST)] = -np.inf
    best = int(gain.argmax())
    at = divmod(best, width - 1)
    return at if gain[at] > 1e-9 else None


def isotonic(margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (margin, probability) of the non-decreasing least-squares fit: equal margins are one point, neighbours that fall are pooled."""
    at, place = np.unique(margin, return_inverse=True)
    weight = np.bincount(place, weights=w)
    mean = np.bincount(place, weights=w * y) / weight
    blocks: list[list[float]] = []  # mean, weight, least margin, greatest margin
    for m, v, x in zip(mean.tolist(), weight.tolist(), at.tolist(), strict=True):
        blocks.append([m, v, x, x])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, v, _, high = blocks.pop()
            last = blocks[-1]
            last[0], last[1], last[3] = (last[0] * last[1] + m * v) / (last[1] + v), last[1] + v, high
    knots = [(at, b[0]) for b in blocks for at in ((b[2], b[3]) if b[2] < b[3] else (b[2],))]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


@dataclass
class Scorer:
    """What the tasks get: a few hundred KB."""

    learned: tuple[dict[bytes, float], dict[bytes, float]]  # words, stems
    share: float
    forest: Forest | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def __post_init__(self):
        self.lexicon = Lexicon(*self.learned)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.forest is None:
            return np.full(len(texts), self.share)
        x = np.array([self.lexicon.features(t) for t in texts], float).reshape(-1, len(FEATURES))
        return np.clip(np.interp(self.forest.margin(x), *self.knots), 0.0, 1.0)


def learning_labels(labels: DataFrame) -> DataFrame:
    """Rows (doc_id, toxic, weight): the bounded sample, of ids with crc32 mod 5 other than 0."""
    fold = remainder(F.col("doc_id"), 5)
    one = labels.filter(F.col("toxic").isNotNull() & (fold != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in one.groupBy("toxic").count().collect()}
    out = None
    for value, most in ((1, MAX_POSITIVE), (0, MAX_NEGATIVE)):
        n = counts.get(value, 0)
        part = one.filter(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).withColumn("weight", F.lit(n / max(1, min(n, most))))
        out = part if out is None else out.unionByName(part)
    return out


def terms(text: bytes) -> set[bytes]:
    """The different words of a text, and its stems behind a zero byte."""
    words = {w for w in text.lower().translate(BLANK).split() if len(w) > 2}
    return words | {b"\0" + w[:STEM] for w in words if len(w) > STEM}


#: Quarters whose words a lexicon is learned from: the one in use, and for each quarter that trees are grown on the one without it.
LEARNED_FROM = {0: (1, 2, 3), 1: (2, 3), 2: (1, 3), 3: (1, 2)}
Learned = tuple[dict[bytes, float], dict[bytes, float]]


def lexicons_of(rows: DataFrame) -> dict[int, Learned]:
    """For each entry of LEARNED_FROM the words and the stems with the logarithm of how much more often toxic documents have them.

    Documents are counted by Spark, once for all lexicons, over all rows
    (text, toxic, fold) of the sample; the driver gets the terms that pass.
    """
    names = [f"{kind}{k}" for k in (1, 2, 3) for kind in ("toxic", "other")]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            sums = {n: Counter() for n in names}
            for text, y, k in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("toxic").to_pylist(), batch.column("fold").to_pylist(), strict=True):
                sums[f"{'toxic' if y else 'other'}{k}"].update(terms(text))
            words = list(set().union(*sums.values()))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *(pa.array([sums[n][w] for w in words], pa.int64()) for n in names)], names=["term", *names])

    rows = rows.filter("fold != 0")
    docs = dict.fromkeys(names, 0) | {f"{'toxic' if r['toxic'] else 'other'}{r['fold']}": r["count"] for r in rows.groupBy("toxic", "fold").count().collect()}
    sums = rows.select("text", "toxic", "fold").mapInArrow(counted, f"term binary, {', '.join(f'{n} long' for n in names)}").groupBy("term").agg(*(F.sum(n).alias(n) for n in names))
    stem, lifts = F.substring("term", 1, 1) == F.lit(b"\0"), {}
    share, least = F.when(stem, STEM_SHARE).otherwise(WORD_SHARE), F.when(stem, STEM_LIFT).otherwise(WORD_LIFT)
    for v, folds in LEARNED_FROM.items():
        n_toxic, n_other = (float(sum(docs[f"{kind}{k}"] for k in folds)) for kind in ("toxic", "other"))
        if n_toxic and n_other:
            toxic, other = (sum((F.col(f"{kind}{k}") for k in folds), F.lit(0)) for kind in ("toxic", "other"))
            lift = (toxic / F.lit(n_toxic)) / ((other + 0.5) / F.lit(n_other))
            lifts[f"lift{v}"] = F.when((toxic >= F.greatest(F.lit(LEAST_DOCS), share * n_toxic)) & (lift >= least), lift)
    found: dict[int, Learned] = {v: ({}, {}) for v in LEARNED_FROM}
    passed = sums.select("term", *(x.alias(n) for n, x in lifts.items())).dropna(how="all", subset=list(lifts)).collect() if lifts else []
    for r in passed:
        term = bytes(r["term"])
        for name in lifts:
            if r[name] is not None:
                found[int(name[4:])][term[:1] == b"\0"][term.lstrip(b"\0")] = float(np.log(r[name]))
    return found


def learn(docs: DataFrame, labels: DataFrame) -> Scorer:
    """A scorer from the labelled documents of the sample."""
    ids = learning_labels(labels).withColumnRenamed("doc_id", "_id")
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    # One document an id, chosen with partial results on the map side.
    one = own.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", F.col("toxic").cast("int").alias("toxic"), "weight")).alias("one"))
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)).cast("int").alias("fold")
    rows = materialize(one.select("one.text", "one.toxic", "one.weight", part), "toxicity-sample")
    learned = lexicons_of(rows)
    lexicons = {v: Lexicon(*x) for v, x in learned.items()}

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = [lexicons[k].features(t) for t, k in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("fold").to_pylist(), strict=True)]
            yield with_columns(batch, ["toxic", "weight", "fold"], x=pa.array(x, pa.list_(pa.float64())))

    got = rows.mapInArrow(measured, "toxic int, weight double, fold int, x array<double>").toArrow()
    y, w, fold = (got[c].to_numpy().astype(float) for c in ("toxic", "weight", "fold"))
    if not len(y) or y.min() == y.max():
        return Scorer(learned[0], float(y.mean()) if len(y) else 0.0)
    x = np.array(got["x"].to_pylist(), float)
    order = np.lexsort((*x.T, y, fold))  # the same rows give the same trees in any order of tasks
    x, y, w, fold = x[order], y[order], w[order], fold[order]
    fit, rest = fold != 0, fold == 0
    if min(y[fit].sum(), y[rest].sum()) < 1 or min((1 - y)[fit].sum(), (1 - y)[rest].sum()) < 1:
        fit = rest = np.ones(len(y), bool)
    forest = grow(x[fit], y[fit], w[fit])
    return Scorer(learned[0], float(np.average(y, weights=w)), forest, isotonic(forest.margin(x[rest]), y[rest], w[rest]))


def score(docs: DataFrame, scorer: Scorer, keep: list[str]) -> DataFrame:
    """The kept columns of ``docs``, score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = shared.value.scores([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()])
            yield with_columns(batch, keep, score=pa.array(s), predicted=pa.array((s >= 0.5).astype(np.int32)))

    columns = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"])))
    return columns.mapInArrow(scored, ", ".join([*fields, "score double, predicted int"]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out (crc32 of the id mod 5 is 0; false for a null id), score, predicted."""
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return score(docs.withColumn("held_out", held_out), learn(docs, labels), ["doc_id", "held_out"])


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents predicted to be toxic; all columns stay. Rows pass through their task, none is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = shared.value.scores([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()])
            yield batch.filter(pa.array(s < 0.5))

    return docs.mapInArrow(passed, docs.schema)
