"""Quality rules: base counts, then a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into a fixed number of buckets. Two smoothed
multinomials over the buckets, one of the trusted target and one of the raw
corpus, give each bucket a log ratio; a document's score is the mean log ratio
of its n-grams, and documents that pass the base rules are kept when the score
is not below a threshold: the one that best parts all labelled documents of
quality 1 from those of quality 0, each scored without the trusted documents of
its own fold, as a document scores higher when the target has counted it. The
raw multinomial counts every document; the target counts the trusted documents
among the first ``max_trusted`` ids in hash order, a bounded labelled sample.

Defined cases: a null or empty text has no words, fails the base rules and has
score null; labels may be missing or repeated, an id is trusted if any of its
labels says so; with no trusted document every score is 0; with no labelled
document of either quality that passes the base rules the threshold is
``THRESHOLD``; an empty table gives an empty result. Everything runs in the JVM.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vertexloom.functions.shared import materialize
from vertexloom.llm.words import WORD, words

BUCKETS = 1 << 14
MAX_TRUSTED = 20_000
#: Without labels to part.
THRESHOLD = -0.3
#: Scores are told apart to one part in so many when the threshold is sought.
STEPS = 1000
#: Parts of the trusted documents that are left out in turn.
FOLDS = 4
SMOOTHING = 1.0


def with_base_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_words`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long).

    Columns that an expression below refers to more than once are projected
    first, as a lambda would evaluate them anew for each element.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    out = docs.withColumns({"_words": words(F.col("text")), "_lines": lines})
    out = out.withColumn("_windows", window_hashes(F.col("_words")))
    out = out.withColumn("_pairs", repeated_pairs(F.col("_windows")))
    return out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": covered_words(F.col("_pairs")).cast("long"),
        }
    ).drop("_lines", "_windows", "_pairs")


def window_hashes(array: Column, width: int = 3) -> Column:
    """64-bit hashes of the windows of ``width`` words, in order."""
    firsts = F.slice(array, F.lit(1), F.greatest(F.size(array) - (width - 1), F.lit(0)))
    return F.transform(firsts, lambda w, i: F.xxhash64(w, *[F.get(array, i + k) for k in range(1, width)]))


def repeated_pairs(hashes: Column) -> Column:
    """(hash, place) in order of hash if any hash repeats, else null."""
    return F.when(
        F.size(F.array_distinct(hashes)) < F.size(hashes),
        F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p")))),
    )


def covered_words(pairs: Column, width: int = 3) -> Column:
    """Words in windows whose hash has an equal neighbour; ``pairs`` is a column, in order of hash.

    Each such place covers the words up to the next place, ``width`` at most.
    """
    near = F.filter(pairs, lambda x, i: F.coalesce(F.get(pairs, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(pairs, i + 1)["h"] == x["h"], F.lit(False)))
    places = F.sort_array(F.transform(near, lambda x: x["p"]))
    spans = F.aggregate(
        places,
        F.struct(F.lit(0).alias("n"), F.lit(-width).alias("end")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(width), p + width - acc["end"])).alias("n"), (p + width).alias("end")),
        lambda acc: acc["n"],
    )
    return F.coalesce(spans, F.lit(0))


def features(array: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of the words and word pairs of an array, in 0 to ``buckets - 1``."""
    one = F.transform(array, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    firsts = F.slice(array, F.lit(1), F.greatest(F.size(array) - 1, F.lit(0)))
    two = F.transform(firsts, lambda w, i: F.pmod(F.xxhash64(w, F.get(array, i + 1)), F.lit(buckets)).cast("int"))
    return F.concat(one, two)


def trusted_ids(labels: DataFrame, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """Ids of trusted documents (quality 1), the first ``max_trusted`` in hash order."""
    good = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.lit(True).alias("_trusted"))
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted)


def fold(doc_id: Column) -> Column:
    """Fold of an id, by its hash."""
    return F.pmod(F.xxhash64(doc_id), F.lit(FOLDS)).cast("int")


def bucket_counts(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, max_trusted: int = MAX_TRUSTED) -> tuple[list[int], list[list[int]]]:
    """Per bucket the count in all documents; per fold and bucket the count in the trusted ones.

    One pass over all texts; partial sums leave at most ``buckets`` rows a task.
    """
    ids = F.broadcast(trusted_ids(labels, max_trusted).select(F.col("doc_id").alias("_id"), fold(F.col("doc_id")).alias("_fold")))
    seen = docs.join(ids, F.col("doc_id") == F.col("_id"), "left").select(words(F.col("text")).alias("_words"), "_fold")
    counts = (
        seen.select(F.explode(features(F.col("_words"), buckets)).alias("bucket"), "_fold")
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), *(F.count(F.when(F.col("_fold") == k, 1)).alias(f"fold{k}") for k in range(FOLDS)))
        .collect()
    )
    raw, trusted = [0] * buckets, [[0] * buckets for _ in range(FOLDS)]
    for r in counts:
        raw[r["bucket"]] = r["raw"]
        for k in range(FOLDS):
            trusted[k][r["bucket"]] = r[f"fold{k}"]
    return raw, trusted


def ratios_of(raw: list[int], trusted: list[list[int]]) -> list[float]:
    """Per bucket, log of trusted over raw probability, both smoothed by ``SMOOTHING``; all 0 without trusted counts."""
    if not any(map(any, trusted)):
        return [0.0] * len(raw)
    below, above = [n + SMOOTHING for n in raw], [sum(n) + SMOOTHING for n in zip(*trusted, strict=True)]
    shift = math.log(sum(below)) - math.log(sum(above))
    return [round(math.log(t) - math.log(r) + shift, 9) for t, r in zip(above, below, strict=True)]


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, max_trusted: int = MAX_TRUSTED) -> list[float]:
    """The ratios of a corpus, from all folds."""
    return ratios_of(*bucket_counts(docs, labels, buckets, max_trusted))


def mean_ratio(found: Column, ratios: list[float], first: Column | None = None) -> Column:
    """Mean log ratio of buckets, looked up from the place ``first`` on; null without buckets."""
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    total = F.aggregate(found, F.lit(0.0), lambda acc, b: acc + F.get(table, b if first is None else b + first))
    return F.when(F.size(found) > 0, total / F.size(found))


def score(array: Column, ratios: list[float]) -> Column:
    """Mean log ratio of an array's n-grams; null without words."""
    return mean_ratio(features(array, len(ratios)), ratios)


def parting(scored: DataFrame, labels: DataFrame) -> float:
    """The threshold with the least sum of the shares of quality 0 kept and of quality 1 dropped.

    ``scored``: rows (doc_id, base_failed, apart), cheap to scan; those that
    pass the base rules count, all of them, by ``apart``. Of equal thresholds the middle of
    the widest gap between scores is taken, of equal gaps the lowest.
    """
    judged = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("quality"))
    passed = scored.filter(~F.col("base_failed")).select("doc_id", F.floor(F.col("apart") * STEPS).alias("step"))
    counts = (
        passed.join(judged, F.col("doc_id") == F.col("_id"))
        .groupBy("step")
        .agg(F.count(F.when(F.col("quality") == 0, 1)).alias("low"), F.count(F.when(F.col("quality") == 1, 1)).alias("good"))
        .orderBy("step")
        .collect()
    )
    low, good = sum(r["low"] for r in counts), sum(r["good"] for r in counts)
    if not low or not good:
        return THRESHOLD
    found, kept, dropped = [], low, 0
    for r, after in zip(counts, counts[1:], strict=False):
        kept, dropped = kept - r["low"], dropped + r["good"]
        found.append((kept * good + dropped * low, r["step"] - after["step"], (r["step"] + 1 + after["step"]) / (2 * STEPS)))
    # Keeping all, if the scores part nothing.
    found.append((low * good, 0, counts[0]["step"] / STEPS))
    return min(found)[2]


def judge_quality(docs: DataFrame, labels: DataFrame, threshold: float | None = None, buckets: int = BUCKETS, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, score and kept.

    base_failed: fewer than 50 words, or more than half of them in repeated
    windows. kept: not base_failed, and score at or above the threshold, which
    is sought among the labels if none is given; the scores are then written.
    """
    docs = docs.select("doc_id", "text")
    raw, trusted = bucket_counts(docs, labels, buckets, max_trusted)
    out = with_base_counts(docs)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumns({"base_failed": failed, "_features": features(F.col("_words"), buckets)})
    scores = {"score": mean_ratio(F.col("_features"), ratios_of(raw, trusted))}
    if threshold is None:
        others = [x for k in range(FOLDS) for x in ratios_of(raw, trusted[:k] + trusted[k + 1 :])]
        scores["apart"] = mean_ratio(F.col("_features"), others, fold(F.col("doc_id")) * buckets)
    out = out.withColumns(scores).drop("_words", "_features", "text")
    if threshold is None:
        out = materialize(out, "quality-scores")
        threshold = parting(out, labels)
    return out.drop("apart").withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= threshold, F.lit(False)))
