"""URL filters by a sort-merge range join.

A rule (host, path) becomes the canonical key ``labels of the host reversed`` + NUL
+ path; the URLs it fits are the interval of keys that start with it. A URL is
looked up once per host ancestor that is as deep as some rule's host. Rules and
lookups are dealt into ranges of the key order by sampled splitters; a range
also gets the rules that enclose its lower splitter, so that it can be swept on
its own. The sweep reads a range in key order and keeps a stack of the active nested
rules: what does not enclose the current key is popped, and the top is the
longest match. Memory is the depth of the stack.

The longest rule wins: most characters of host and path together, then the
longer host; of rules with the same key ``block`` wins. Defined results: a null url,
or one without ``://``, has an empty host and path and no rule; a URL that no rule fits
gets the default verdict; rules with a null field are ignored; repeated URLs
are decided once and joined back to each row; empty tables give empty results
(or the default verdict everywhere); extra columns are carried through.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelens.llm.common import cut, free_name, lower_ascii, ship

ROWS_PER_RANGE = 20_000
#: Sampled keys per range that the driver sorts to find splitters, and their length.
OVERSAMPLE, KEY_CHARS = 16, 512
NUL = "\x00"


def host_of(url: Column) -> Column:
    """Lower-cased text after the first ``://`` up to ``/``, ``?``, ``#`` or the end."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _place(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit(NUL), path)


def _key(host: Column, path: Column) -> Column:
    labels = F.reverse(F.split(host, r"\."))
    return F.concat(F.array_join(labels, "."), F.lit(NUL), path)


def _lookups(urls: DataFrame, depths: list[int]) -> DataFrame:
    """(url, key) for every ancestor of the host that has a rule's depth."""
    labels = F.reverse(F.split("host", r"\."))
    keys = F.array(
        *[
            F.when(
                F.size(labels) >= d,
                F.concat(F.array_join(F.slice(labels, 1, d), "."), F.lit(NUL), F.col("path")),
            )
            for d in depths
        ]
    )
    return urls.select("url", F.explode(F.array_compact(keys)).alias("key"))


def _splitters(lookups: DataFrame, rows: int) -> list[str]:
    ranges = max(1, -(-rows // ROWS_PER_RANGE))
    step = max(1, rows // (ranges * OVERSAMPLE))
    picked = lookups.filter(F.pmod(F.xxhash64("key", "url"), F.lit(step)) == 0)
    keys = sorted(r[0] for r in picked.select(F.substring("key", 1, KEY_CHARS)).collect())
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def _ranged(df: DataFrame, splitters: list[str]) -> DataFrame:
    """Adds ``part``: the range of the key order that the key lies in."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [bisect.bisect_right(splitters, k) for k in b.column("key").to_pylist()]
            yield b.append_column("part", pa.array(parts, pa.int32()))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(deal, f"{schema}, part int")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (part, key), rules before lookups."""
    stack: list[tuple[str, str]] = []
    part = None
    for b in batches:
        urls, rules, verdicts, lengths, hosts = [], [], [], [], []
        columns = (b.column(c).to_pylist() for c in ("part", "key", "url", "rule", "verdict"))
        for p, key, url, rule, verdict in zip(*columns):
            if p != part:
                stack, part = [], p
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if rule is not None:
                if not stack or stack[-1][0] != key:  # of equal keys the first, a block, stays
                    stack.append((key, rule, verdict))
            elif stack:
                k, r, v = stack[-1]
                urls.append(url)
                rules.append(r)
                verdicts.append(v)
                lengths.append(len(k) - 1)
                hosts.append(k.index(NUL))
        yield pa.RecordBatch.from_arrays(
            [pa.array(urls, pa.string()), pa.array(rules, pa.string()), pa.array(verdicts, pa.string()),
             pa.array(lengths, pa.int32()), pa.array(hosts, pa.int32())],
            ["url", "rule", "verdict", "length", "host_chars"],
        )


def decide(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule, verdict) of every distinct URL that a rule fits.

    ``urls`` has url, host and path; ``rules`` has host, path and verdict.
    """
    clean = rules.select(
        lower_ascii(F.col("host")).alias("host"), "path", "verdict"
    ).dropna()
    keyed = cut(
        clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select(
            _key(F.col("host"), F.col("path")).alias("key"),
            F.concat("host", "path").alias("rule"), "verdict",
            F.size(F.split("host", r"\.")).alias("depth"),
        )
    )
    depths = sorted(r[0] for r in keyed.select("depth").distinct().collect())  # at most 127 labels
    lookups = _lookups(urls, depths)
    splitters = _splitters(lookups, lookups.count())
    starts = _ranged(keyed.select("key", F.lit(None).cast("string").alias("url"), "rule", "verdict"), splitters)
    spark = urls.sparkSession
    edges = spark.createDataFrame([(i + 1, s) for i, s in enumerate(splitters)], "part int, edge string")
    prefixes = edges.select(
        "part", F.explode(F.transform(F.sequence(F.lit(1), F.length("edge")), lambda n: F.substr("edge", F.lit(1), n))).alias("p")
    )
    enclosing = prefixes.join(keyed, F.col("p") == F.col("key")).select(
        "key", F.lit(None).cast("string").alias("url"), "rule", "verdict", "part"
    )
    points = _ranged(
        lookups.select("key", "url", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")),
        splitters,
    )
    rows = points.unionByName(starts).unionByName(enclosing)
    swept = (
        rows.repartitionById(len(splitters) + 1, "part")  # no two ranges share a task
        .sortWithinPartitions("part", "key", F.col("rule").isNull(), F.col("verdict").desc())
        .mapInArrow(_sweep, "url string, rule string, verdict string, length int, host_chars int")
    )
    best = F.max_by(F.struct("rule", "verdict"), F.struct("length", "host_chars")).alias("b")
    return swept.groupBy("url").agg(best).select("url", "b.rule", "b.verdict")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict (other names where taken)."""
    ship(pages.sparkSession)
    host, path, rule, verdict, of_url = free_name(pages, "host", "path", "rule", "verdict", "of_url")
    # urls that differ behind the path alone are one place, however many a site has
    known = pages.filter(F.col(url).isNotNull())
    urls = known.select(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).distinct()
    urls = urls.select(_place(F.col("host"), F.col("path")).alias("url"), "host", "path")
    decided = decide(urls, rules).select(
        F.col("url").alias(of_url), F.col("rule").alias(rule), F.col("verdict").alias(verdict)
    )
    out = pages.withColumn(host, host_of(F.col(url))).withColumn(path, path_of(F.col(url)))
    own = F.when(F.col(url).isNotNull(), _place(F.col(host), F.col(path)))
    out = out.join(decided, own == F.col(of_url), "left").drop(of_url)
    return out.withColumn(verdict, F.coalesce(F.col(verdict), F.lit(default)))
