"""URL filters as a sort-merge range join.

A host's labels in reverse order, each followed by a dot, are its canonical
key: ``blog.example.org`` has ``org.example.blog.``, and its prefixes at dots
are the keys of the hosts above it. A rule is the interval of a key's paths
that start with the rule's path. Each URL asks once for its own key and for
each key above it, as deep as any rule goes. Rules and questions, sorted by
key and path, meet in one sweep that keeps a stack of the rules whose
intervals are open; these are nested, so the top one is the longest. The
longest answer to a URL's questions wins.

Both sides are tables of any size. The sorted line is cut into parts at bounds
drawn from a sample of it, by key, path and row, so that a hot host or a
repeated URL is spread; a rule that is open at a bound is added to the part
behind it. A task holds its stack and nothing else.

Defined cases: a null URL or one without ``://`` has an empty host and path,
matches no rule and gets the default verdict; of matching rules the longest
text (host and path) wins, then the longer host, then block; rules repeated
with both verdicts block; without rules every page gets the default; an empty
table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.functions.arrow import slices
from vertexloom.functions.shared import materialize

Rule = tuple[str, str, str]

#: Verdict, host, path.
RULES: tuple[Rule, ...] = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: Rows of the line that are sampled for each bound, and characters of a bound's key and path.
PER_BOUND, BOUND_SIZE = 20, 256
ANSWER = "total int, host_size int, blocks boolean, rule string, verdict string"

#: After the first "://" the host runs up to "/", "?" or "#", the path up to "?" or "#".
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z in lower case, and path; both empty for null and for URLs without ``://``."""
    host = F.regexp_extract(url, URL, 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def labels_of(host: Column) -> Column:
    """A host's labels in reverse order."""
    return F.reverse(F.split(host, r"\.", -1))


def key_of(labels: Column) -> Column:
    """Labels, each followed by a dot."""
    return F.concat(F.array_join(labels, "."), F.lit("."))


def keys_above(host: Column, deepest: int) -> Column:
    """The keys of a host and of those above it, of ``deepest`` labels at most."""
    labels = labels_of(host)
    depths = F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deepest)))
    return F.transform(depths, lambda n: key_of(F.slice(labels, F.lit(1), n)))


def rule_table(spark: SparkSession, rules: DataFrame | Iterable[Rule]) -> DataFrame:
    """One row per host and path: key, path, depth and the answer that the rule gives. ``rules``: rows (verdict, host, path)."""
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "verdict string, host string, path string")
    blocks = F.col("verdict") == "block"
    one = rules.groupBy("host", "path").agg(F.max(F.struct(blocks.alias("blocks"), "verdict")).alias("v"))
    size = F.length("host")
    return materialize(
        one.select(
            key_of(labels_of(F.col("host"))).alias("key"), "path", F.size(labels_of(F.col("host"))).alias("depth"), (size + F.length("path")).alias("total"),
            size.alias("host_size"), F.col("v.blocks").alias("blocks"), F.concat("host", "path").alias("rule"), F.col("v.verdict").alias("verdict"),
        ),
        "url-rules",
    )


def bounds_of(line: DataFrame, parts: int) -> list[tuple[bytes, bytes, int]]:
    """At most ``parts - 1`` places (key, path, row), in order, that cut the line into parts of about one size."""
    share = min(1.0, parts * PER_BOUND / max(1, line.count()))
    cut = line.select(F.substring("key", 1, BOUND_SIZE).alias("key"), F.substring("path", 1, BOUND_SIZE).alias("path"), "row")
    places = sorted((r["key"].encode(), r["path"].encode(), r["row"]) for r in cut.sample(fraction=share, seed=1).toLocalIterator())
    return sorted({places[len(places) * i // parts] for i in range(1, parts)}) if places else []


def open_at(spark: SparkSession, bounds: list[tuple[bytes, bytes, int]], rules: DataFrame) -> DataFrame:
    """Rules that are open at a bound, with the part behind it: those of its key whose paths its path starts with.

    A rule from before a bound fits nothing behind it unless it fits the
    bound. There are BOUND_SIZE + 1 beginnings a bound, so their table is small.
    """
    starts = spark.createDataFrame([(i + 1, key.decode(), path.decode()) for i, (key, path, _) in enumerate(bounds)], "part int, _key string, _path string")
    begun = F.transform(F.sequence(F.lit(0), F.length("_path")), lambda n: F.substr("_path", F.lit(1), n))
    starts = starts.select("part", "_key", F.explode(begun).alias("_path"))
    return rules.join(F.broadcast(starts), (F.col("key") == F.col("_key")) & (F.col("path") == F.col("_path"))).drop("_key", "_path")


class Sweep:
    """Rules and questions of one part, in order of key and path, rules first."""

    def __init__(self):
        self.key: bytes | None = None
        self.open: list[tuple[bytes, object]] = []  # paths, each a beginning of the next, with what their rules answer

    def to(self, key: bytes, path: bytes) -> None:
        """Close the intervals that end before a place."""
        if key != self.key:
            self.key = key
            self.open.clear()
        while self.open and not path.startswith(self.open[-1][0]):
            self.open.pop()

    def rule(self, key: bytes, path: bytes, answer: object) -> None:
        self.to(key, path)
        self.open.append((path, answer))

    def meet(self, key: bytes, path: bytes) -> object | None:
        """The answer of the longest rule that fits, or None."""
        self.to(key, path)
        return self.open[-1][1] if self.open else None


def answers(line: DataFrame, bounds: list[tuple[bytes, bytes, int]], carried: DataFrame) -> DataFrame:
    """Rows (row, total, host_size, blocks, rule, verdict): for each question that some rule fits the longest such rule."""
    columns = f"key string, path string, row long, {ANSWER}, part int"
    own = [c.split()[0] for c in ANSWER.split(", ")]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            keys, paths = (batch.column(c).cast(pa.binary()).to_pylist() for c in ("key", "path"))
            part = [bisect_right(bounds, at) for at in zip(keys, paths, batch.column("row").to_pylist(), strict=True)]
            yield batch.append_column("part", pa.array(part, pa.int32()))

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, now = Sweep(), -1
        for batch in slices(batches, 4096):
            keys, paths = (batch.column(c).cast(pa.binary()).to_pylist() for c in ("key", "path"))
            rows, parts, found = batch.column("row").to_pylist(), batch.column("part").to_pylist(), []
            held = batch.select(own).to_struct_array()
            for i, (key, path, row, part) in enumerate(zip(keys, paths, rows, parts, strict=True)):
                if part != now:
                    sweep, now = Sweep(), part
                if row < 0:
                    sweep.rule(key, path, held[i].as_py())
                elif answer := sweep.meet(key, path):
                    found.append({"row": row, **answer})
            yield pa.RecordBatch.from_pylist(found, pa.schema([("row", pa.int64()), *((f.name, f.type) for f in held.type)]))

    both = line.mapInArrow(placed, columns).unionByName(carried)
    parts = len(bounds) + 1
    ordered = both.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "key", "path", "row")
    return ordered.mapInArrow(swept, f"row long, {ANSWER}")


def filter_urls(pages: DataFrame, rules: DataFrame | Iterable[Rule] = RULES, default: str = "allow", parts: int | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule (null if none fits) and verdict.

    ``rules``: a list, or a table (verdict, host, path) of any size. ``parts``
    of the sorted line: the session's shuffle partitions if not given.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    numbered = pages.select("page_id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row"))
    urls, ruled = materialize(numbered, "urls"), rule_table(spark, rules)
    deepest = ruled.agg(F.max("depth")).first()[0]
    if deepest is None:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    ruled = ruled.drop("depth").withColumn("row", F.lit(-1).cast("long"))
    asked = urls.select(F.explode(keys_above(F.col("host"), deepest)).alias("key"), "path", "row")
    line = ruled.unionByName(asked, allowMissingColumns=True).select("key", "path", "row", "total", "host_size", "blocks", "rule", "verdict")
    bounds = bounds_of(line, parts or int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = answers(line, bounds, open_at(spark, bounds, ruled))
    best = found.groupBy("row").agg(F.max(F.struct("total", "host_size", "blocks", "rule", "verdict")).alias("best"))
    return urls.join(best, "row", "left").select("page_id", "host", "path", "best.rule", F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
