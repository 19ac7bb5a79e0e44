import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from odd_rows import ODD, WORDS
from pyspark.sql import functions as F

from vertexloom.llm import exact_dedup, rows, simhash


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def slow_fingerprint(text):
    w = WORDS.findall(ascii_lower(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(items, linked):
    """Least item reachable from each."""
    root = {x: x for x in items}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


def test_fingerprints(spark):
    for text in ["", None, "a", "A b", "a b c", "A  B\tc d", "É É é", "x " * 500, *(str(r[1]) for r in ODD[:9])]:
        assert int.from_bytes(simhash.fingerprint(text), "big") == slow_fingerprint(text)
    one = spark.createDataFrame([("Zwölf boxkämpfer",)], "t string").select(F.xxhash64("t")).first()[0]
    assert xxhash.xxh64_intdigest("Zwölf boxkämpfer".encode(), 42) == one % 2**64


@pytest.mark.parametrize("fixed", [0, (1 << 34) - 1, (1 << 50) - 1])
def test_masks_cover_every_pair_within_the_radius(fixed):
    rnd = np.random.default_rng(3)
    masks, free = simhash.cover(fixed), [i for i in range(64) if not fixed >> i & 1]
    for _ in range(3000):
        difference = sum(1 << int(b) for b in rnd.choice(free, rnd.integers(0, 4), replace=False))
        assert any(difference & m == 0 for m in masks)


def test_levels_leave_few_bits_free():
    masks = [0]
    for _ in range(3):
        masks = [m for fixed in masks for m in simhash.cover(fixed)]
    assert max(64 - m.bit_count() for m in masks) <= 8


@pytest.mark.parametrize("full, radius", [(1024, 3), (16, 3), (1024, 5)])
def test_links_keep_the_components_of_all_pairs(spark, tmp_path, full, radius):
    """With small limits the large buckets are covered again, two and three levels deep."""
    rnd = np.random.default_rng(full)
    base = [int(x) for x in rnd.integers(0, 2**63, 12)]
    fps = {0, *base}
    for b in base[:3]:
        x = b
        for _ in range(60):
            x ^= sum(1 << int(i) for i in rnd.choice(20, rnd.integers(1, 5), replace=False))
            fps.add(x)
    fps = sorted(x - 2**64 if x >= 2**63 else x for x in fps)
    near = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) % 2**64).bit_count() <= radius]
    spark.createDataFrame([(x,) for x in fps], "fp long").write.parquet(str(tmp_path / "fps"))
    found = [(r.a, r.b) for r in simhash.links(spark.read.parquet(str(tmp_path / "fps")), full, radius).collect()]
    assert roots(fps, found) == roots(fps, near)


def test_documents_and_odd_rows(table):
    rows = [*ODD, *((100 + i, f"alpha beta gamma delta {'epsilon ' * 40} w{i % 3}") for i in range(9))]
    docs = table(rows, extra=True)
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    fps = {(r[0], r[1]): slow_fingerprint(r[1]) for r in rows}
    ids = defaultdict(set)
    for (i, _), fp in fps.items():
        ids[fp].add(i)
    linked = roots(list(ids), [(a, b) for a in ids for b in ids if (a ^ b).bit_count() <= 3])
    least = defaultdict(list)
    for fp, own in ids.items():
        least[linked[fp]] += [i for i in own if i is not None]
    want = Counter((r[0], f"{fps[r[0], r[1]]:016x}", min(least[linked[fps[r[0], r[1]]]], default=None)) for r in rows)
    assert Counter(got) == want
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(c for _, _, c in {(0, linked[fps[r[0], r[1]]], min(least[linked[fps[r[0], r[1]]]], default=None)) for r in rows})


def test_empty_tables(table):
    assert simhash.near_duplicates(table([])).count() == 0 and simhash.drop_near_duplicates(table([])).count() == 0
    assert exact_dedup.exact_duplicates(table([])).count() == 0 and exact_dedup.drop_exact_duplicates(table([])).count() == 0


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_duplicates(table, digest_bytes):
    """With digests of one byte many texts collide, and the check of full bytes must tell them apart."""
    rows = [*ODD, *((200 + i, f"Text {i % 400}") for i in range(600)), (None, "text 3")]
    docs = table(rows, extra=True, files=5)
    got = exact_dedup.exact_duplicates(docs, digest_bytes, files_per_trigger=2).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[ascii_lower(r[1])].append(r[0])
    sha = {hashlib.sha256(t.encode()).hexdigest(): own for t, own in groups.items()}
    assert len(got) == len(rows)
    kept = Counter()
    for r in got:
        own = sha[r.text_sha256]
        assert r.group_size == len(own) and r.keep_id == max((i for i in own if i is not None), default=None)
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1} and set(kept) == set(sha)


def test_dropping_exact_duplicates_keeps_columns_and_unfiled_rows(spark, table):
    docs = table(ODD, extra=True)
    for df in (docs, docs.join(spark.range(1).withColumnRenamed("id", "one"), how="cross").drop("one")):
        kept = exact_dedup.drop_exact_duplicates(df)
        assert kept.columns == docs.columns
        assert Counter(ascii_lower(r.text) for r in kept.collect()) == Counter({ascii_lower(r[1]) for r in ODD})


def test_state_takes_in_later_arrivals(spark, table, tmp_path):
    path, state = str(tmp_path / "arrivals"), str(tmp_path / "state")
    for rows in ([(1, "a"), (5, "b")], [(9, "A"), (2, "c")]):
        exact_dedup.arrivals(exact_dedup.located(table(rows))).write.mode("append").parquet(path)
        groups = exact_dedup.run_stream(spark, path, state).collect()
    assert sorted((r.keep.doc_id, r.group_size) for r in groups) == [(2, 1), (5, 1), (9, 2)]


def test_frames_that_repeat_rows(spark, table):
    """Rows of one place in a file that come more than once are rows of their own, from whatever frame."""
    docs = table([(1, "same"), (2, "SAME"), (3, "other")], extra=True)
    twice = docs.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2)))).drop("n")
    joined = docs.join(spark.range(2), how="cross").drop("id")
    sampled = docs.sample(withReplacement=True, fraction=4.0, seed=1)
    for df in (twice, joined, docs.unionByName(docs), sampled, docs.filter(F.rand(3) < 2)):
        rows = df.collect()
        want = Counter(ascii_lower(r.text) for r in rows)
        got = exact_dedup.exact_duplicates(df).collect()
        sha = {hashlib.sha256(t.encode()).hexdigest(): n for t, n in want.items()}
        assert len(got) == len(rows) and all(r.group_size == sha[r.text_sha256] for r in got)
        assert Counter(r.text_sha256 for r in got if r.kept) == Counter(list(sha))
        assert Counter(ascii_lower(r.text) for r in exact_dedup.drop_exact_duplicates(df).collect()) == Counter(list(want))
        assert simhash.drop_near_duplicates(df).count() == len(want)


def test_only_scans_of_different_files_are_taken_as_they_are(spark, table):
    docs = table(ODD)
    assert rows.straight(docs) and rows.straight(docs.filter("doc_id > 1").select("doc_id", "text").alias("x"))
    path = docs.inputFiles()[0].rsplit("/", 1)[0]
    for df in (docs.union(docs), docs.sample(0.5), docs.limit(3), docs.filter(F.rand() < 0.5), spark.range(3), spark.read.parquet(path, path)):
        assert not rows.straight(df)


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_state_is_kept_between_calls(spark, table, tmp_path, digest_bytes):
    """Later documents are held against earlier ones; with short digests bytes are fetched from the earlier files."""
    state = str(tmp_path / "state")
    first = [(i, f"Text {i % 200}") for i in range(300)]
    later = [(1000 + i, f"text {i % 350}") for i in range(400)]
    exact_dedup.exact_duplicates(table(first), digest_bytes, state=state).count()
    docs = table(later)
    for _ in range(2):  # the second call brings nothing new
        got = exact_dedup.exact_duplicates(docs, digest_bytes, state=state).collect()
        size, keep = Counter(ascii_lower(t) for _, t in first + later), {}
        for i, t in first + later:
            keep[ascii_lower(t)] = max(i, keep.get(ascii_lower(t), -1))
        sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in size}
        assert Counter(r.doc_id for r in got) == Counter(i for i, _ in later)
        for r in got:
            t = sha[r.text_sha256]
            assert (r.group_size, r.keep_id, r.kept) == (size[t], keep[t], r.doc_id == keep[t])
    old = spark.createDataFrame([(1, "text 3"), (2, "new one")], "doc_id long, text string").union(spark.createDataFrame([(3, "NEW one")], "doc_id long, text string"))
    assert [r.doc_id for r in exact_dedup.drop_exact_duplicates(old, state=str(tmp_path / "state32")).collect()] and {r.doc_id for r in exact_dedup.drop_exact_duplicates(table([(5, "New One"), (6, "x")]), state=str(tmp_path / "state32")).collect()} == {5, 6}
