"""URL filters by a sort-merge range join.

A host is written from its end ("www.example.com" -> "com.example.www.") with the path after it, so a rule's
host and all its subdomains are one interval of keys. Urls and rules are dealt by ranges of that key and sorted;
one sweep keeps a stack of the rules whose interval is open and judges each url by the longest that fits.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import partitions

RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
_LAST = chr(0x10FFFF)
_PER_RANGE = 64


def _lower(host: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower())


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return _lower(F.regexp_extract(_after(url), "^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """From the host's end up to ? # or the end."""
    return F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def turned(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _ranges(spark: SparkSession, keys: DataFrame, n: int) -> list[str]:
    """Bounds of n ranges of about equal rows, from a random sample of some 64 keys a range; they only set
    which task does what."""
    rows = keys.count()
    if n < 2 or not rows:
        return []
    seen = sorted(r[0] for r in keys.sample(min(1.0, _PER_RANGE * n / rows), 7).collect())
    return sorted({seen[len(seen) * i // n] for i in range(1, n)}) if seen else []


def filter_urls(spark: SparkSession, pages: DataFrame, rules: DataFrame | None = None, default: str = "allow", url: str = "url", keys: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The key columns, url, host, path, rule (null if none fits) and verdict (the rule's, else ``default``).

    rules: host (A-Z are lower-cased), path, verdict. A rule fits its host and subdomains where the path starts with its own. The
    longest rule text (host and path) wins, then the longer host, then "block". Null urls and such without ://
    have empty host and path, and no rule. Rows are judged singly, so repeated rows and null keys stay as they
    are. No rows, or no rules, are fine; very frequent urls and hosts spread over several ranges.
    """
    if rules is None:
        rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    n = partitions(spark)
    rows = pages.select(*(F.col(f"`{k}`") for k in keys), F.col(f"`{url}`").alias("url"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rows = rows.withColumn("key", F.concat(turned(F.col("host")), "path"))
    spread = F.concat("key", F.lit("\x00"), F.hex(F.xxhash64(*(F.col(f"`{k}`") for k in keys), "url")))
    rows = rows.withColumn("spread", spread)
    bounds = _ranges(spark, rows.select("spread"), n)

    @F.pandas_udf("int")
    def range_of(value: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(bounds, object), value.to_numpy(object), side="right").astype("int32"))

    rows = rows.withColumn("range", range_of("spread")).drop("spread").withColumn("kind", F.lit(1))
    rules = rules.filter("host is not null and path is not null and verdict is not null").select(_lower(F.col("host")).alias("host"), "path", "verdict")
    rules = rules.withColumn("key", turned(F.col("host")))
    rules = rules.withColumn("range", F.explode(F.sequence(range_of("key"), range_of(F.concat("key", F.lit(_LAST))))))
    rules = rules.withColumn("kind", F.lit(0))
    both = rows.unionByName(rules, allowMissingColumns=True)
    dealt = both.repartitionById(max(n, len(bounds) + 1), F.col("range")).sortWithinPartitions("range", "key", "kind")
    names = [*keys, "url", "host", "path"]
    schema = "".join(f"`{k}` {pages.schema[k].dataType.simpleString()}, " for k in keys) + "url string, host string, path string, rule string, verdict string"

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[_Open] = []
        here = None
        for batch in batches:
            kinds, ranges = batch.column("kind").to_numpy(), batch.column("range").to_numpy()
            own, paths = batch.column("key").to_pylist(), batch.column("path")
            judged = _Judged(batch.num_rows, default)
            # between two rules, and within a range, urls stand in order of key: each open host's are its first ones
            cuts = np.unique(np.concatenate([[0], np.flatnonzero(kinds == 0), np.flatnonzero(kinds == 0) + 1, 1 + np.flatnonzero(np.diff(ranges)), [batch.num_rows]]))
            for i, j in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                if ranges[i] != here:
                    stack, here = [], ranges[i]
                while stack and not own[i].startswith(stack[-1].key):
                    stack.pop()
                if not kinds[i]:
                    if not stack or stack[-1].key != own[i]:
                        stack.append(_Open(own[i], batch.column("host")[i].as_py()))
                    stack[-1].add(paths[i].as_py(), batch.column("verdict")[i].as_py())
                    continue
                while i < j:
                    while stack and not own[i].startswith(stack[-1].key):
                        stack.pop()
                    end = bisect_left(own, stack[-1].key + _LAST, i, j) if stack else j
                    judged.run(stack, paths, i, end)
                    i = end
            urls = np.flatnonzero(kinds)
            part = batch.take(pa.array(urls))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *judged.columns(urls)], [*names, "rule", "verdict"])

    return dealt.mapInArrow(sweep, schema)


class _Open:
    """A host whose interval is open, with the rules of its paths by length."""

    def __init__(self, key: str, host: str):
        self.key, self.host = key, host
        self.by_length: dict[int, dict[str, str]] = {}

    def add(self, path: str, verdict: str) -> None:
        known = self.by_length.setdefault(len(path), {})
        known[path] = verdict if known.get(path, verdict) == verdict else "block"


class _Judged:
    """For each url of a batch the longest rule that fits, a number in the list of those that fitted any."""

    def __init__(self, n: int, default: str):
        self.chosen, self.default = np.full(n, -1, np.int64), default
        self.rules: list[str] = []
        self.verdicts: list[str] = []

    def run(self, stack: list[_Open], paths: pa.Array, i: int, j: int) -> None:
        """Urls i..j, for which the same hosts are open. A length of paths at a time, the longest rules last."""
        ranked = sorted((len(entry.host) + length, len(entry.host), length, n) for n, entry in enumerate(stack) for length in entry.by_length)
        part = paths.slice(i, j - i)
        for *_, length, n in ranked:
            known = stack[n].by_length[length]
            texts = list(known)
            found = pc.index_in(pc.utf8_slice_codeunits(part, 0, length), value_set=pa.array(texts, pa.string()))
            hit = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
            if len(hit):
                used, at = np.unique(found.take(pa.array(hit)).to_numpy(), return_inverse=True)
                self.chosen[i + hit] = len(self.rules) + at
                self.rules += [stack[n].host + texts[k] for k in used.tolist()]
                self.verdicts += [known[texts[k]] for k in used.tolist()]

    def columns(self, urls: np.ndarray) -> list[pa.Array]:
        at = self.chosen[urls]
        at = pa.array(np.where(at < 0, len(self.rules), at))
        return [pa.array([*self.rules, None], pa.string()).take(at), pa.array([*self.verdicts, self.default], pa.string()).take(at)]
