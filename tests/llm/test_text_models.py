import re
import zlib
from collections import Counter

import numpy as np
import pytest
from odd_rows import ODD, WORDS

from vertexloom.llm import langid, quality, toxicity

EN = "the quick brown fox jumps over the lazy dog while others sleep near this old river".split()
DE = "der schnelle braune fuchs springt über den faulen hund während andere nahe am fluss schlafen".split()


def prose(words, seed, n=60):
    rnd = np.random.default_rng(seed)
    return " ".join(rnd.choice(words, n))


def corpus():
    rows = [(20 + i, prose(EN, i), "en") for i in range(120)] + [(200 + i, prose(DE, i), "de") for i in range(120)]
    return rows + [(*r, "en")[:3] if len(r) == 2 else r for r in ODD]


def slow_costs(counts, context, byte):
    """Bits by walking from the longest context down; counts: {run: n}."""
    bits = 0.0
    for order in range(langid.ORDER, -1, -1):
        c = context[len(context) - order :]
        after = Counter()
        for run, n in counts.items():
            if run[langid.ORDER - order : langid.ORDER] == c:
                after[run[-1]] += n
        if after:
            room = sum(after.values()) + len(after)
            if byte in after:
                return bits - np.log2(after[byte] / room)
            bits -= np.log2(len(after) / room)
    return bits + 8


def test_code_lengths_equal_a_walk_through_the_tree():
    learned = {}
    for lang, text in (("x", b"abracadabra abra"), ("y", b"zzz banana")):
        data = langid.PAD + text
        counts = Counter(data[i : i + langid.ORDER + 1] for i in range(len(text)))
        keys = sorted(counts)
        learned[lang] = (np.array([int.from_bytes(k, "big") for k in keys], np.uint64), np.array([counts[k] for k in keys], float)), counts
    model = langid.Model({k: v[0] for k, v in learned.items()})
    texts = [b"abra", b"", b"banana split", "é\0".encode(), b"a" * 50, b"cad"]
    for _ in range(2):  # the second time from the table
        got = model.code_lengths(texts)
        for t, row in zip(texts, got, strict=True):
            data = langid.PAD + t
            for bits, (_, counts) in zip(row, learned.values(), strict=True):
                assert bits == pytest.approx(sum(slow_costs(counts, data[i : i + langid.ORDER], data[i + langid.ORDER]) for i in range(len(t))), rel=1e-5)


def test_long_texts_are_scored_in_parts(monkeypatch):
    runs, _ = langid.runs_of([b"abracadabra" * 9])
    keys, n = np.unique(runs, return_counts=True)
    model = langid.Model({"x": (keys, n.astype(float))})
    texts = [b"abracadabra" * 5, b"", b"b" * 33, b"cad"]
    want = model.code_lengths(texts)
    monkeypatch.setattr(langid, "CHUNK", 7)
    assert np.allclose(model.code_lengths(texts), want, rtol=1e-5)


def test_languages_held_out_and_odd_rows(spark, table):
    rows = corpus()
    docs = table(rows, extra=True)
    got = langid.identify(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    lang = {r[0]: r[2] for r in rows[:240]}
    for r in got:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.doc_id in lang:
            assert r.lang_pred == lang[r.doc_id]
        if r.doc_id in (3, 4, 5):  # null, empty, blank
            assert (r.lang_pred, r.score) == ("und", 0)
    assert langid.identify(table([])).count() == 0
    assert {r.lang_pred for r in langid.identify(table([(1, "abc", None), (None, "abc", "en"), (2, "1 2 3", "fr")])).collect()} <= {"und", "fr"}


def test_predictions_by_hand(table):
    """Whole predictions, learning included, against sums over a walk through the counts."""
    rnd = np.random.default_rng(5)
    rows = [(i, " ".join(rnd.choice(words, 6)), lang) for i, (words, lang) in enumerate([(EN, "en"), (DE, "de")] * 12)] + [(90, "der fox", None), (91, "", "en"), (92, "日本 fluss", "de"), (93, "12 34", "en")]
    counts = {}
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2 and lang:
            data = langid.PAD + text.encode()
            counts.setdefault(lang, Counter()).update(data[k : k + langid.ORDER + 1] for k in range(len(data) - langid.ORDER))
    text = {r[0]: r[1] for r in rows}
    for r in langid.identify(table(rows)).collect():
        data = langid.PAD + text[r.doc_id].encode()
        bits = {x: sum(slow_costs(c, data[k : k + langid.ORDER], data[k + langid.ORDER]) for k in range(len(data) - langid.ORDER)) for x, c in sorted(counts.items())}
        best = min(bits, key=bits.get)
        has_letter = any(c.isalpha() for c in text[r.doc_id])
        assert r.lang_pred == (best if has_letter else "und")
        assert r.score == pytest.approx(1 / sum(2 ** (bits[best] - b) for b in bits.values()) if has_letter else 0, rel=1e-3)


def test_the_sample_takes_every_language_and_is_bounded(table):
    """A language of one long text is learned however low its bound; the others give about their bound."""
    rows = [(i, "abcd " * 20, "x") for i in range(400)] + [(1000, "zyx " * 5000, "long")] + [(2000 + i, None, "none") for i in range(3)]
    docs = table(rows, files=3)
    usable = docs.filter("text IS NOT NULL")
    got = Counter(r.lang for r in langid.sample(usable, 10_000).collect())
    assert got["long"] == 1 and 50 <= got["x"] <= 150 and set(got) == {"x", "long"}
    assert Counter(r.lang for r in langid.sample(usable, 1).collect()) == {"x": 1, "long": 1}
    assert Counter(r.lang for r in langid.sample(usable, 10_000, total_bytes=1).collect()) == {"x": 1, "long": 1}
    assert langid.sample(usable).count() == 401
    full = langid.learn(docs)
    few = langid.learn(docs, max_runs=6)
    assert sum(len(r) for r, _ in few.values()) <= 6 < sum(len(r) for r, _ in full.values())
    kept = sorted((n for _, counts in full.values() for n in counts), reverse=True)[: sum(len(r) for r, _ in few.values())]
    assert sorted((n for _, counts in few.values() for n in counts), reverse=True) == kept


def test_many_languages_fit_the_worker():
    learned = {f"l{i}": (np.array([0x61626364 + i], np.uint64), np.array([2.0])) for i in range(3000)}
    model = langid.Model(learned)
    assert model.table.size <= langid.COSTS and model.code_lengths([b"abcd" * 900]).shape == (1, 3000)


def slow_base(text):
    w = WORDS.findall(text or "")
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_base_counts_and_verdicts(spark, table):
    rnd = np.random.default_rng(1)
    rows = [(i, prose(EN, i, 80)) for i in range(60)] + [(100 + i, " ".join(f"{w}{s}" for w, s in zip(prose(DE, i, 80).split(), rnd.choice(["###", "$$$", "%%%"], 80)))) for i in range(20)]
    rows += [(300 + i, "\n".join(rnd.choice(["a b", "b a b", "", " ", "a b c a b c"], 12))) for i in range(40)] + [(r[0], r[1]) for r in ODD]
    docs = table(rows, extra=True)
    labels = spark.createDataFrame([*((i, int(i < 60), 0) for i in range(0, 120, 2)), (None, 1, 0), (0, None, None), (2, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge_quality(docs, labels).collect()
    text = {}
    for i, t in rows:
        text.setdefault(i, []).append(t)
    assert len(got) == len(rows)
    for r in got:
        base = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert base in [slow_base(t) for t in text[r.doc_id]]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
        if r.doc_id is not None and not r.base_failed:
            assert r.kept == (r.doc_id < 60)
    assert quality.judge_quality(table([]), labels).count() == 0
    # Without a trusted document every score is 0.
    for r in quality.judge_quality(docs, labels.limit(0)).collect():
        assert r.score == (None if r.n_words == 0 else pytest.approx(0, abs=1e-9)) and r.kept == (not r.base_failed)


def test_quality_scores_equal_a_count_by_hand(spark, table):
    docs, labels = table([(1, "a b a"), (2, "c d"), (3, "")]), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    buckets = 64
    ratios = quality.log_ratios(docs, labels, buckets)
    seen = {r.doc_id: r.f for r in docs.select("doc_id", quality.features(quality.words(docs.text), buckets).alias("f")).collect()}
    raw, good = Counter(b for f in seen.values() for b in f), Counter(seen[1])
    assert len(seen[1]) == 5 and seen[3] == []
    for b in range(buckets):
        want = np.log((good[b] + 1) / (5 + buckets)) - np.log((raw[b] + 1) / (8 + buckets))
        assert ratios[b] == pytest.approx(want)
    got = docs.select("doc_id", quality.score(quality.words(docs.text), ratios).alias("s")).collect()
    assert {r.doc_id: r.s for r in got} == pytest.approx({i: sum(ratios[b] for b in f) / len(f) if f else None for i, f in seen.items()})


def test_quality_threshold_follows_the_labels(spark, table):
    # Of low quality are texts with some junk among good words: closer to good ones than any fixed loose bound.
    def mixed(i):
        return prose(EN, i, 78) + " " + prose([f"junk{j}" for j in range(6)], i, 4)

    docs = table([*((i, prose(EN, i, 80)) for i in range(200)), *((1000 + i, mixed(i)) for i in range(100))])
    labels = spark.createDataFrame([*((i, 1, 0) for i in range(100)), *((1000 + i, 0, 0) for i in range(50))], "doc_id long, quality int, toxic int")
    got = quality.judge_quality(docs, labels, buckets=1024).collect()
    assert not any(r.base_failed for r in got)
    loose = quality.judge_quality(docs, labels, threshold=quality.THRESHOLD, buckets=1024).collect()
    assert sum(r.kept for r in loose if r.doc_id >= 1000) > 50
    assert sum(r.kept for r in got if r.doc_id >= 1000) <= 10 and sum(r.kept for r in got if r.doc_id < 1000) >= 190


def test_parting_takes_the_middle_of_the_widest_gap_of_least_loss(spark):
    rows = [(1, False, -0.9), (2, False, -0.5), (3, False, -0.1), (4, False, 0.2), (5, True, 0.3), (6, False, None), (7, False, -2.0), (None, False, 0.0)]
    scored = spark.createDataFrame(rows, "doc_id long, base_failed boolean, apart double")
    labels = lambda *q: spark.createDataFrame([(i, x, 0) for i, x in q], "doc_id long, quality int, toxic int")
    assert quality.parting(scored, labels((1, 0), (2, 0), (3, 1), (4, 1), (5, 0), (3, 0), (None, 0))) == pytest.approx(-0.2995, abs=1e-3)
    assert quality.parting(scored, labels((1, 1), (4, 0))) == pytest.approx(-0.9, abs=1e-3)
    assert quality.parting(scored, labels((1, 0), (5, 1))) == quality.parting(scored, labels()) == quality.THRESHOLD


def test_isotonic_fit_is_the_best_non_decreasing_one():
    rnd = np.random.default_rng(4)
    margin, y, w = np.round(rnd.normal(size=60), 1), rnd.integers(0, 2, 60).astype(float), rnd.integers(1, 4, 60).astype(float)
    at, p = toxicity.isotonic(margin, y, w)
    assert (np.diff(at) > 0).all() and (np.diff(p) >= 0).all()
    values, best = slow_isotonic(margin, y, w)
    assert np.allclose(np.interp(values, at, p), best)
    few = np.array([0.0, 0.0, 1.0, 1.0, 1.0])  # a low label comes first among those of the greater margin
    assert toxicity.isotonic(few, np.array([0.0, 1, 0, 1, 1]), np.ones(5))[1] == pytest.approx([1 / 2, 2 / 3])


def test_trees_learn_an_interaction():
    rnd = np.random.default_rng(2)
    x = rnd.random((4000, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.4)).astype(float)
    forest = toxicity.grow(x[:3000], y[:3000], np.ones(3000))
    assert (((forest.margin(x[3000:]) > 0) == (y[3000:] > 0)).mean()) > 0.97


def slow_grow(x, y, w):
    """Trees by trying every cut of every feature with direct sums; a tree is a list of (feature, cut) by node, and leaves by their bits."""
    cuts = [sorted(set(np.quantile(c, np.linspace(0, 1, toxicity.BINS + 1)[1:-1]))) for c in x.T]
    p0 = sum(w * y) / sum(w)
    base = np.log(p0 / (1 - p0))
    margin, trees = [base] * len(x), []
    for _ in range(toxicity.TREES):
        p = [1 / (1 + np.exp(-m)) for m in margin]
        g, h = [wi * (yi - pi) for wi, yi, pi in zip(w, y, p)], [wi * pi * (1 - pi) for wi, pi in zip(w, p)]
        splits, leaves = {}, {}

        def value(own):
            return sum(g[i] for i in own) ** 2 / (sum(h[i] for i in own) + toxicity.RIDGE)

        def part(own, node, depth):
            if depth == toxicity.DEPTH:
                leaves[node] = toxicity.RATE * sum(g[i] for i in own) / (sum(h[i] for i in own) + toxicity.RIDGE)
                for i in own:
                    margin[i] += leaves[node]
                return
            best = (1e-9, None)
            for f, at in enumerate(cuts):
                for cut in at:
                    low, high = [i for i in own if x[i][f] <= cut], [i for i in own if x[i][f] > cut]
                    if min(sum(w[i] for i in low), sum(w[i] for i in high)) >= toxicity.LEAST:
                        gain = value(low) + value(high) - value(own)
                        if gain > best[0] + 1e-12:
                            best = (gain, (f, cut))
            splits[node] = best[1]
            low = [i for i in own if best[1] is None or x[i][best[1][0]] <= best[1][1]]
            part(low, 2 * node + 1, depth + 1)
            part([i for i in own if i not in set(low)], 2 * node + 2, depth + 1)

        part(list(range(len(x))), 0, 0)
        trees.append((splits, leaves))
    return base, trees


def slow_margin(model, row):
    base, trees = model
    for splits, leaves in trees:
        node = 0
        while node in splits:
            f, cut = splits[node] or (0, np.inf)
            node = 2 * node + 1 + (row[f] > cut)
        base += leaves[node]
    return base


def slow_isotonic(margin, y, w):
    """(margin, probability) by the max-min formula."""
    values = sorted(set(margin))
    mean = [np.average(y[margin == v], weights=w[margin == v]) for v in values]
    size = [w[margin == v].sum() for v in values]
    return values, [max(min(np.average(mean[i : j + 1], weights=size[i : j + 1]) for j in range(k, len(values))) for i in range(k + 1)) for k in range(len(values))]


def test_trees_are_those_of_direct_sums(monkeypatch):
    monkeypatch.setattr(toxicity, "TREES", 4)
    monkeypatch.setattr(toxicity, "BINS", 7)
    monkeypatch.setattr(toxicity, "LEAST", 5.0)
    rnd = np.random.default_rng(11)
    x, w = np.round(rnd.normal(size=(90, 3)), 1), rnd.integers(1, 4, 90).astype(float)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rnd.normal(size=90) > 0.3).astype(float)
    want = slow_grow(x, y, w)
    forest = toxicity.grow(x, y, w)
    assert np.allclose(forest.margin(x), [slow_margin(want, r) for r in x], atol=1e-6)


def test_the_whole_operator_by_hand(spark, table, monkeypatch):
    """Sample, words by quarters, trees, calibration and scores against a version of loops over the rows."""
    monkeypatch.setattr(toxicity, "TREES", 2)
    monkeypatch.setattr(toxicity, "BINS", 4)
    rnd = np.random.default_rng(12)
    rows = [(i, " ".join(rnd.choice(EN, 12)) + (" blorp grumfling" if i % 3 == 0 and i % 7 else " Plain you")) for i in range(160)] + [(5, "blorp a second text")]
    toxic = {i: int(i % 3 == 0) for i in range(0, 160, 1) if i % 4}
    docs = table(rows)
    labels = spark.createDataFrame([(i, 0, y) for i, y in toxic.items()], "doc_id long, quality int, toxic int")
    got = {(r.doc_id, r.score) for r in toxicity.toxicity(docs, labels).collect()}
    from pyspark.sql import functions as F

    hashes = {(r.doc_id, r.text): (r.h, r.fold) for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)).alias("fold")).collect()}
    sample = {}
    for i, t in rows:
        if i in toxic and zlib.crc32(str(i).encode()) % 5:
            sample[i] = min(sample.get(i, (hashes[i, t][0], t)), (hashes[i, t][0], t))
    sample = [(t, toxic[i], hashes[i, t][1]) for i, (_, t) in sample.items()]
    n_labels = Counter(y for i, y in toxic.items() if zlib.crc32(str(i).encode()) % 5)
    assert n_labels == Counter(y for _, y, _ in sample)  # so all weights are 1

    def lexicon(folds):
        own = [(toxicity.terms(t.encode()), y) for t, y, f in sample if f in folds]
        n = Counter(y for _, y in own)
        words, stems = {}, {}
        for term in set().union(*(s for s, _ in own)):
            a, b = sum(term in s and y for s, y in own), sum(term in s and not y for s, y in own)
            stem = term[:1] == b"\0"
            lift = (a / n[1]) / ((b + 0.5) / n[0])
            if a >= max(toxicity.LEAST_DOCS, (toxicity.STEM_SHARE if stem else toxicity.WORD_SHARE) * n[1]) and lift >= (toxicity.STEM_LIFT if stem else toxicity.WORD_LIFT):
                (stems if stem else words)[term.strip(b"\0")] = np.log(lift)
        return toxicity.Lexicon(words, stems)

    lexicons = {0: lexicon((1, 2, 3)), 1: lexicon((2, 3)), 2: lexicon((1, 3)), 3: lexicon((1, 2))}
    assert b"blorp" in lexicons[0].weights and b"grumfl" in lexicons[0].stems
    x = np.array([lexicons[f].features(t.encode()) for t, _, f in sample])
    y, fold = np.array([float(y) for _, y, _ in sample]), np.array([f for _, _, f in sample])
    model = slow_grow(x[fold != 0], y[fold != 0], np.ones((fold != 0).sum()))
    margin = np.round([slow_margin(model, r) for r in x[fold == 0]], 9)
    knots = slow_isotonic(margin, y[fold == 0], np.ones(len(margin)))
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(np.interp(slow_margin(model, lexicons[0].features(t.encode())), *knots))
    bad = [(i, s, want[i]) for i, s in got if min(abs(s - v) for v in want[i]) >= 1e-5]
    assert not bad, (len(got), bad[:5], knots)


def test_features_of_a_text():
    f = dict(zip(toxicity.FEATURES, toxicity.Lexicon({}, {b"worthl": 2.0}).features("You IDIOT! 1d10t st*pid s.t.u.p.i.d worthlessly".encode()), strict=True))
    assert f["different_hits"] == 1 and f["nearness"] == 0.5 and f["shouted"] > 0 and f["different_stems"] == 1 and f["stem_weight"] > 0
    assert f["hidden_a_word"] > 0 and f["hidden_hits"] >= 1
    assert len(toxicity.Lexicon({}, {}).features(b"")) == len(toxicity.FEATURES)


def test_toxicity_held_out_and_odd_rows(spark, table):
    rnd = np.random.default_rng(7)
    bad = ["Blorp", "grumf", "idiot"]  # the first two must be learned
    toxic = {i for i in range(600) if i % 4 == 0}
    rows = [(i, " ".join(np.where(rnd.random(40) < (0.1 if i in toxic else 0), rnd.choice(bad, 40), rnd.choice(EN, 40))) + (" grumf you" if i in toxic else "")) for i in range(600)]
    docs = table([*rows, *((None if r[0] is None else 1000 + r[0], r[1]) for r in ODD)], extra=True)
    labels = spark.createDataFrame([*((i, 1, int(i in toxic)) for i in range(500)), (None, 1, 1), (7, 1, None), (8, None, 1), (8, 0, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows) + len(ODD)
    wrong = 0
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.doc_id is not None and r.doc_id < 600:
            wrong += r.predicted != int(r.doc_id in toxic)
    assert wrong <= 6
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r.predicted for r in got)
    assert toxicity.toxicity(table([]), labels).count() == 0
    none = toxicity.toxicity(docs.limit(5), labels.limit(0)).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.0, 0)}


def test_hidden_words_pattern():
    assert toxicity.HIDDEN(b"st*pid good-bye a1b") and not re.search(rb"\d", b"plain")
