import zlib
from collections import Counter, defaultdict

import pytest
from odd_rows import ODD, WORDS
from pyspark.sql import functions as F

from vertexloom.llm import mixing, ordinals, sharding


def water(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by cutting and sharing again until none is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= most * sizes[s]}
        for s in full or open_:
            target[s] = most * sizes[s] if full else weight[s] * level
            left -= target[s] if full else 0
        open_ = open_ - full if full else set()
    return target


def test_targets_by_water_filling(spark):
    for sizes in ({"a": 10, "b": 1, "c": 100, "d": 7, None: 30}, {"x": 5}, {"b": 0, "a": 0}, {"é": 3, "z": 1000, "a": 4, "日": 50}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        assert got == pytest.approx(water(sizes))


def test_plan_and_mix_agree(spark, table):
    docs = table([(i, "w " * (i % 50 + 1), "en", f"s{i % 4}" if i % 9 else "s0") for i in range(600)] + ODD, extra=True)
    plan = mixing.mixing_plan(docs).collect()
    again = mixing.mixing_plan(docs.repartition(5)).collect()
    assert sorted(map(str, plan)) == sorted(map(str, again)) and len(plan) == docs.count()
    texts = Counter((r.doc_id, r.text, r.source) for r in docs.collect())
    assert Counter((r.doc_id, r.source, r.size) for r in plan) == Counter({k: n for k, n in _sized(texts).items()})
    taken, target, sizes = defaultdict(int), {}, defaultdict(int)
    for r in plan:
        assert r.taken == r.copies * r["size"] <= 2 * r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        sizes[r.source] += r["size"]
    assert target == pytest.approx(water(dict(sizes)))
    for s in ("s0", "s1", "s2", "s3"):
        assert taken[s] == pytest.approx(target[s], rel=0.15)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    want = Counter()
    for r in plan:
        want[r.doc_id, r.source] += r.copies
    assert Counter((r.doc_id, r.source) for r in mixed.collect()) == +want


def _sized(texts):
    out = Counter()
    for (i, text, source), n in texts.items():
        out[i, source, len(WORDS.findall(text or ""))] += n
    return out


@pytest.mark.parametrize("same", [False, True])
def test_rows_without_ids_and_repeated_rows_have_draws_of_their_own(table, same):
    """A third of the rows is one repeated row, and no row has an id."""
    rows = [(None, "one two" if same and i % 3 == 0 else f"w{i} x", "en", f"s{i % 3}") for i in range(3000)]
    plan = mixing.mixing_plan(table(rows, files=4)).collect()
    again = mixing.mixing_plan(table(rows, files=1)).collect()
    assert sorted(map(str, plan)) == sorted(map(str, again)) and len(plan) == len(rows)
    taken, target = Counter(), {}
    for r in plan:
        taken[r.source] += r.taken
        target[r.source] = r.target
    for s in target:
        assert taken[s] == pytest.approx(target[s], rel=0.05)
    assert mixing.mix(table(rows)).count() == sum(r.copies for r in plan)


def test_ordinals_number_equal_rows(spark, table):
    rows = [(i % 5 if i % 7 else None, "t" * (i % 2)) for i in range(400)] + [(1000 + i, "u") for i in range(50)]
    got = defaultdict(list)
    for r in ordinals.with_ordinal(table(rows, files=6), ["doc_id", "text"]).collect():
        got[r.doc_id, r.text].append(r.ordinal)
    assert {k: len(v) for k, v in got.items()} == Counter(rows)
    assert all(sorted(v) == list(range(len(v))) for v in got.values())


def test_empty_mix(table):
    assert mixing.mixing_plan(table([])).count() == 0 and mixing.mix(table([])).count() == 0


def test_draws_are_even(spark):
    u = [r.u for r in spark.range(20000).select(mixing.draw(F.col("id").cast("string"), 17).alias("u")).collect()]
    assert 0 <= min(u) and max(u) < 1 and abs(sum(u) / len(u) - 0.5) < 0.01


def test_every_row_has_a_place_in_a_shard(table):
    docs = table([(i, "x" * (i * 7919 % 400)) for i in range(3000)] + ODD, extra=True)
    rows = sharding.shard_documents(docs).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    size, places = Counter(), defaultdict(list)
    for r in rows:
        size[r.shard] += r["size"]
        places[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert set(size) == set(range(16)) and all(sorted(p) == list(range(len(p))) for p in places.values())
    rest = [n for s, n in size.items() if n < 150_000]
    assert len(rest) == 15 and max(rest) - min(rest) < 200  # one shard has the text of 150,000 bytes
    assert sharding.shard_documents(table([])).count() == 0


def test_map_versions(spark, table, tmp_path):
    docs, path = table([(i, "x" * (i % 90)) for i in range(2000)]), str(tmp_path / "map")
    sharding.SlotMap.first(64, 4).save(spark, path)
    assert sharding.shard_documents(docs, shards=4, slots=64, map_path=str(tmp_path / "new")).first().map_version == 2
    sharding.shard_documents(docs, shards=4, slots=64, map_path=path)
    second = sharding.SlotMap.load(spark, path)
    assert second.version == 2 and sharding.SlotMap.load(spark, path, 1) == sharding.SlotMap.first(64, 4)
    assert sum(a != b for a, b in zip(second.shard_of, sharding.SlotMap.first(64, 4).shard_of)) < 32
    sharding.shard_documents(docs, shards=5, slots=64, map_path=path)
    grown = sharding.SlotMap.load(spark, path)
    assert grown.version == 3 and set(grown.shard_of) == set(range(5))
    assert sharding.SlotMap.load(spark, path, 2) == second
    shrunk = grown.rebalanced([1] * 64, 3)
    assert set(shrunk.shard_of) == {0, 1, 2}


def slow_slot(spark, r, ordinal, slots):
    """The slot of one record, by Spark's hash of its literal values."""
    key = [F.lit(r.doc_id).cast("long"), F.lit(r["size"]).cast("long"), F.lit(r.text_crc32).cast("long"), F.lit(ordinal).cast("long")]
    return spark.range(1).select(F.pmod(F.xxhash64(*key), F.lit(slots))).first()[0]


def test_the_map_by_hand(spark, table, tmp_path):
    """Each row's shard is the map's for its slot, and the map's bytes per slot are those of the rows."""
    docs, path = table([(i, "y" * (i * 31 % 97)) for i in range(40)]), str(tmp_path / "map")
    rows = sharding.shard_documents(docs, shards=3, slots=16, map_path=path).collect()
    stored = sharding.SlotMap.load(spark, path)
    size = [0] * 16
    for r in rows:
        slot = slow_slot(spark, r, 0, 16)
        assert (r.virtual_slot, r.shard) == (slot, stored.shard_of[slot])
        size[slot] += r["size"]
    assert stored == sharding.SlotMap.first(16, 3).rebalanced(size, 3)
    held = [sum(n for n, s in zip(size, stored.shard_of) if s == k) for k in range(3)]
    # No move or swap between two shards brings them closer.
    for a in range(3):
        for b in range(3):
            gap = held[a] - held[b]
            for i in [i for i in range(16) if stored.shard_of[i] == a]:
                for n in [0, *(size[j] for j in range(16) if stored.shard_of[j] == b)]:
                    assert gap <= 1e-4 * sum(size) / 3 or abs(gap - 2 * (size[i] - n)) >= gap


def test_rows_without_ids_spread_over_shards(table):
    """A third of the rows is one repeated row, and no row has an id."""
    rows = [(None, "abc" if i % 3 == 0 else f"text {i}") for i in range(6000)]
    got = sharding.shard_documents(table(rows, files=4)).collect()
    size = Counter()
    for r in got:
        size[r.shard] += r["size"]
    assert len(got) == len(rows) and len(size) == 16 and max(size.values()) - min(size.values()) <= 0.005 * sum(size.values()) / 16
