"""URL filters: exact membership through a cascade of Bloom filters."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallygrid.llm.shared import reach_workers, read_table, written

#: False positive rates of the first and of later levels.
RATES = (0.01, 0.5)


@dataclass(frozen=True)
class Level:
    bits: int
    probes: int
    salt: int
    words: np.ndarray


def _hashes(key: Column, salt: int) -> list[Column]:
    return [F.xxhash64(key, F.lit(2 * salt)), F.xxhash64(key, F.lit(2 * salt + 1))]


def _size(n: int, rate: float) -> tuple[int, int]:
    bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2 / 64) * 64)
    return bits, max(1, round(bits / max(1, n) * math.log(2)) if n > 8 else round(-math.log2(rate)))


def _level(keys: DataFrame, n: int, rate: float, salt: int) -> Level:
    """A Bloom filter of ``keys`` (key): bits are set by Spark, word by word; the words come back as Arrow columns, bits / 64 at most."""
    bits, probes = _size(n, rate)
    h1, h2 = _hashes(F.col("key"), salt)
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(probes - 1)), lambda j: F.pmod(F.pmod(h1, F.lit(bits)) + j * F.pmod(h2, F.lit(bits)), F.lit(bits))))
    found = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("set")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[found["word"].to_numpy()] = found["set"].to_numpy()
    return Level(bits, probes, salt, words.view(np.uint64))


def _passes(level: Level, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    a, b, ok = h1 % level.bits, h2 % level.bits, np.ones(len(h1), bool)
    for j in range(level.probes):
        at = (a + j * b) % level.bits
        ok &= (level.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
    return ok


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = _passes(level, b.column(1).to_numpy(), b.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok))], names=["key"])

    h1, h2 = _hashes(F.col("key"), level.salt)
    return keys.select("key", h1.alias("h1"), h2.alias("h2")).mapInArrow(run, "key string")


def build_cascade(listed: DataFrame, universe: DataFrame) -> list[Level]:
    """Levels that tell for every key of ``universe`` (key, distinct) whether ``listed`` (key, distinct) has it.

    The first level encodes the listed keys, the second the keys of the universe that pass it without being listed, the third
    the listed keys that pass the second, and so on until no key passes wrongly. Which keys are listed comes from one aggregate over both
    tables; nothing is joined. The levels take about 13 bits for each listed key that occurs, whatever the universe: a
    small part of the list that the caller holds, so they may go to every task.
    """
    both = universe.select("key", F.lit(False).alias("listed"), F.lit(True).alias("there")).unionByName(listed.select("key", F.lit(True).alias("listed"), F.lit(False).alias("there")))
    flagged = written(both.groupBy("key").agg(F.max("listed").alias("listed"), F.max("there").alias("there")).filter("there").select("key", "listed"), "keys")
    members, before, levels = flagged.filter("listed").select("key"), flagged.filter("NOT listed").select("key"), []
    while n := members.count():
        levels.append(_level(members, n, RATES[min(len(levels), 1)], len(levels)))
        before, members = members, written(_passing(before, levels[-1]), "level")
    return levels


def contains(levels: list[Level], hashes: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Membership of keys given by their two hashes per level: the parity of the first level that a key fails decides."""
    n = len(hashes[0][0]) if hashes else 0
    alive, member = np.ones(n, bool), np.zeros(n, bool)
    for k, level in enumerate(levels):
        idx = np.flatnonzero(alive)
        ok = _passes(level, hashes[k][0][idx], hashes[k][1][idx])
        member[idx[~ok]] = k % 2 == 1
        alive[idx[ok]] = True
        alive[idx[~ok]] = False
    member[alive] = len(levels) % 2 == 1
    return member


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path; both empty for null or without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def candidate_keys(host: Column, path: Column, depths: list[int], lengths: list[int]) -> Column:
    """(key, host) of a URL: its last labels and the beginning of its path, in the numbers that the rules have, strongest first.

    The longest key is the strongest; of equally long ones that with the longer host. However long a URL is, it has no more keys than
    the rules have pairs of a depth and a length.
    """
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = [F.when(n >= d, F.array_join(F.slice(labels, n - d + 1, F.lit(d)), ".")) for d in depths]
    prefixes = [F.when(F.char_length(path) >= k, F.substring(path, 1, k)) for k in lengths]
    pairs = F.array_compact(F.array(*[F.when(s.isNotNull() & p.isNotNull(), F.struct(F.concat(s, p).alias("key"), s.alias("host"))) for s in suffixes for p in prefixes]))
    longer = lambda a, b: F.when(F.char_length(a["key"]) == F.char_length(b["key"]), F.char_length(b["host"]) - F.char_length(a["host"])).otherwise(F.char_length(b["key"]) - F.char_length(a["key"]))
    return F.transform(F.array_sort(F.array_distinct(pairs), longer), lambda x: x["key"])


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], otherwise: str = "allow") -> DataFrame:
    """``pages`` (page_id, url) with host, path, rule and verdict.

    ``rules`` are (verdict, host, path prefix); a rule fits its host and all subdomains. The longest rule (host and path together) wins; of equally long ones
    that with the longer host; of one rule with two verdicts ``block``, else the last by name. Keys of the rules of each verdict are held by a cascade built over all
    keys that occur in ``pages``, so that no lookup joins and none is wrong, however long the list is. A URL that no rule fits gets ``otherwise``.
    Null URLs have no host and no path; repeated rows stay; an empty table gives no rows; other columns, whatever their names, are ignored.
    """
    reach_workers(pages.sparkSession)
    rules = sorted({(v, h, p) for v, h, p in rules if not p or p[0] == "/"})  # no path begins otherwise
    depths, lengths = sorted({h.count(".") + 1 for _, h, _ in rules}), sorted({len(p) for _, _, p in rules})
    host, path = split_url(F.col("url"))
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    keyed = split.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), depths, lengths) if rules else F.array().cast("array<string>"))
    universe = written(keyed.select(F.explode("keys").alias("key")).distinct(), "universe") if rules else None
    cascades = {}
    for verdict in sorted({v for v, _, _ in rules}, key=lambda v: (v == "block", v)):  # the last one set wins
        own = pa.table({"key": sorted({h + p for v, h, p in rules if v == verdict})})
        cascades[verdict] = build_cascade(pages.sparkSession.createDataFrame(own), universe)
    depth = max([1, *map(len, cascades.values())])
    hashed = keyed.withColumn("h", F.transform("keys", lambda k: F.array(*[h for s in range(depth) for h in _hashes(k, s)])))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, counts = b.column(3), np.diff(b.column(3).offsets.to_numpy())
            h = b.column(4).flatten().flatten().to_numpy().reshape(-1, 2 * depth)
            flat, row = keys.flatten(), np.repeat(np.arange(len(counts)), counts)
            rule, verdicts = np.full(len(counts), len(flat)), np.full(len(counts), otherwise, object)
            for verdict, levels in cascades.items():
                first = np.full(len(counts), len(flat))  # keys come strongest first
                if levels:
                    hit = np.flatnonzero(contains(levels, [(h[:, 2 * k], h[:, 2 * k + 1]) for k in range(len(levels))]))
                    np.minimum.at(first, row[hit], hit)
                better = (first <= rule) & (first < len(flat))
                rule[better], verdicts[better] = first[better], verdict
            names = flat.take(pa.array(rule, mask=rule == len(flat)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), names, pa.array(list(verdicts), pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return hashed.select("page_id", "host", "path", "keys", "h").mapInArrow(look, "page_id long, host string, path string, rule string, verdict string")


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op6_cascade_verdicts(spark, sf_dir: str) -> DataFrame:
    """Every url of ``pages`` judged by five rules through Bloom filter cascades."""
    return judge(read_table(spark, sf_dir, "pages"), RULES)


OP6_SQL = r"""
WITH p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
r(verdict, h, x) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (
  SELECT p.*, r.h || r.x AS rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r.h || r.x) DESC NULLS LAST, length(r.h) DESC, r.verdict DESC) AS k
  FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, x))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
