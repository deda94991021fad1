"""Target-distribution importance resampling: word windows hashed into buckets, gains of buckets, and a noisy draw of the best documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallygrid.llm.shared import read_table, written

#: What lies between words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
#: Documents of fewer words are not drawn; of the others so many percent are.
MIN_WORDS, PERCENT = 20, 25
#: Code points that are pre-tokenised at a time, and features in one batch, about.
_PIECE, _HELD = 1 << 18, 2_000_000
#: Words of up to so many bytes have their checksums joined by table.
_SHORT = 63


@lru_cache(maxsize=1)
def _shifts() -> np.ndarray:
    """[n, k, b]: what byte k of a checksum, if it is b, turns into when n zero bytes follow."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> np.uint32(1)) ^ np.uint32(0xEDB88320), one >> np.uint32(1))
    out = [np.arange(256, dtype=np.uint32)[None, :] << np.array([0, 8, 16, 24], np.uint32)[:, None]]
    for _ in range(_SHORT + 1):
        out.append(one[out[-1] & 255] ^ (out[-1] >> np.uint32(8)))
    return np.stack(out)


def joined_crc(first: np.ndarray, second: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The crc32 of a + b from those of a and of b, where b has n bytes (``_SHORT`` + 1 at most)."""
    t, k = _shifts(), np.uint32(255)
    return t[n, 0, first & k] ^ t[n, 1, (first >> np.uint32(8)) & k] ^ t[n, 2, (first >> np.uint32(16)) & k] ^ t[n, 3, first >> np.uint32(24)] ^ second


class Windows:
    """The buckets of a text's features: its words and its pairs of neighbouring words, by their offsets."""

    def __init__(self, buckets: int = BUCKETS) -> None:
        from tokenizers import Regex, pre_tokenizers

        self.buckets = buckets
        self.split = pre_tokenizers.Split(Regex(BETWEEN), behavior="removed")
        self.seen: dict[str, tuple[int, int, int]] = {}

    def words(self, text: str) -> Iterator[list[tuple[str, tuple[int, int]]]]:
        """(word, offsets in the lower-cased text) in pieces; a piece ends where a word can't go on."""
        text = text.encode().lower().decode()  # of bytes only A-Z are lower-cased
        at = 0
        while at < len(text):
            end = min(len(text), at + _PIECE)
            while end < len(text) and (text[end] > "\x7f" or text[end].isalnum()):
                end += 1
            yield [(w, (a + at, b + at)) for w, (a, b) in self.split.pre_tokenize_str(text[at:end])]
            at = end

    def _crcs(self, word: str) -> tuple[int, int, int]:
        raw = word.encode()
        found = zlib.crc32(raw), zlib.crc32(b" " + raw), len(raw) + 1
        if len(raw) <= _SHORT:
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[word] = found
        return found

    def __call__(self, text: str) -> tuple[int, np.ndarray]:
        """(number of words, bucket of each feature)."""
        n, parts, before = 0, [], None
        for found in self.words(text):
            if not found:
                continue
            own = [self.seen.get(w) or self._crcs(w) for w, _ in found]
            offsets = [x for _, x in found]
            if before is not None:
                own.insert(0, before[0])
                offsets.insert(0, before[1])
            crcs = np.array(own, np.uint64)
            # windows of two offset pairs: the text between the words counts as one space
            first, second, many = crcs[:-1, 0].astype(np.uint32), crcs[1:, 1].astype(np.uint32), crcs[1:, 2].astype(np.int64)
            pairs = joined_crc(first, second, np.minimum(many, _SHORT + 1))
            for k in np.flatnonzero(many > _SHORT + 1):
                (a, b), (c, d) = offsets[k], offsets[k + 1]
                pairs[k] = zlib.crc32(self._slice(found, c, d), zlib.crc32(b" ", int(first[k])))
            parts += [crcs[before is not None :, 0].astype(np.uint32), pairs]
            n += len(found)
            before = own[-1], offsets[-1]
        crc = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        return n, (crc % np.uint32(self.buckets)).astype(np.uint16)

    @staticmethod
    def _slice(found: list[tuple[str, tuple[int, int]]], start: int, end: int) -> bytes:
        lo, hi = 0, len(found)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if found[mid][1][0] < start else (lo, mid)
        return found[lo][0].encode()


def window_buckets(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``texts`` (text, others) with n_words and at (the buckets of all features as 16-bit numbers) in place of text."""
    kept = [c for c in texts.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Windows(buckets)
        for batch in batches:
            own, words, at, held, first = batch.select(kept), [], [], 0, 0
            for i, text in enumerate(batch.column(batch.schema.get_field_index("text"))):
                n, found = cut(text.as_py() or "")
                words.append(n)
                at.append(found.tobytes())
                held += len(found)
                if held >= _HELD or i + 1 == len(batch):
                    yield pa.RecordBatch.from_arrays([*own.slice(first, i + 1 - first).columns, pa.array(words, pa.int64()), pa.array(at, pa.binary())], names=[*kept, "n_words", "at"])
                    words, at, held, first = [], [], 0, i + 1

    schema = texts.select(*kept, F.lit(0).cast("long").alias("n_words"), F.lit(b"").alias("at")).schema
    return texts.select(*kept, "text").mapInArrow(run, schema)


def histogram(found: DataFrame, name: str, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, ``name``): features in each bucket, of at most ``buckets`` rows a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for at in batch.column(0):
                total += np.bincount(np.frombuffer(at.as_py(), np.uint16), minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["bucket", "n"])

    return found.select("at").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias(name))


def bucket_gains(found: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket: ``buckets`` numbers come to the driver."""
    s, t = histogram(found, "s", buckets), histogram(target, "t", buckets)
    both = found.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0)
    whole = Window.partitionBy()
    d = lambda c: F.col(c).cast("double")
    both = both.withColumn("all_s", F.sum("s").over(whole)).withColumn("all_t", F.sum("t").over(whole))
    gain = F.floor(1000 * F.ln((d("t") + 1) * (d("all_s") + buckets) / ((d("s") + 1) * (d("all_t") + buckets))))
    out = np.zeros(buckets, np.int64)
    for r in both.select("bucket", gain.alias("gain")).collect():
        out[r["bucket"]] = r["gain"]
    return out


def with_weight(found: DataFrame, gains: np.ndarray) -> DataFrame:
    """``found`` (of :func:`window_buckets`) with n_features and weight, the floored mean of the gains of its features (0 without), in place of at."""
    kept = [c for c in found.columns if c != "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, weight = [], []
            for at in batch.column(len(kept)):
                own = np.frombuffer(at.as_py(), np.uint16)
                n.append(len(own))
                weight.append(int(gains[own].sum()) // max(1, len(own)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(weight, pa.int64())], names=[*kept, "n_features", "weight"])

    zero = F.lit(0).cast("long")
    return found.select(*kept, "at").mapInArrow(run, found.select(*kept, zero.alias("n_features"), zero.alias("weight")).schema)


def noise(doc_id: Column, seed: str = "7") -> Column:
    """floor(-1000 ln(-ln u)) of a number u between 0 and 1 that a hash of the id gives."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.ln(-F.ln(u))).cast("long")


def ranked(rows: DataFrame, percent: int = PERCENT, eligible: Column | None = None) -> DataFrame:
    """``rows`` (doc_id, score, n_features, row: a number of its own) with rank: 1, 2, ... of the best ``percent`` of the eligible ones by score, ties to smaller doc_id; null for all others.

    Counts of each score give the least score that is drawn; rows from there on are range-sorted, and a row's rank is its place in its range plus the rows in ranges before. No task orders more than a range;
    the scores are whole numbers between bounds that do not depend on the rows, so their counts are a small table.
    """
    ok = F.lit(True) if eligible is None else eligible
    drawn = rows.filter(ok).count() * percent // 100
    none = F.lit(None).cast("long").alias("rank")
    if not drawn:
        return rows.withColumn("rank", none)
    counts = rows.filter(ok).groupBy("score").count().withColumn("upto", F.sum("count").over(Window.orderBy(F.col("score").desc())))
    least = counts.filter(F.col("upto") >= drawn).agg(F.max("score")).first()[0]
    best = ok & (F.col("score") >= least)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features"), F.col("row")]
    dealt = rows.filter(best).repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    before = dealt.groupBy("range").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    at = dealt.join(F.broadcast(before), "range").withColumn("rank", (F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(*order))).cast("long"))
    placed = at.select(*rows.columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return placed.unionByName(rows.filter(~F.coalesce(best, F.lit(False))).withColumn("rank", none))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: str = "7") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row of documents (doc_id, text), drawn towards the texts of ``target`` (text).

    An untrained split over the text with A-Z lower-cased gives words with offsets; a feature is a word or two neighbouring ones. A bucket's gain tells how much commoner its features are in the target; a document's
    weight is the floored mean gain, its score adds noise by id, and of the documents with ``min_words`` words or more the ``percent`` with the highest scores are drawn. Texts are cut once: what
    is kept of them are 16-bit buckets.

    Null text has no words and weight 0, as has any text without words. A null doc_id hashes as an empty one and comes before others in ties; rows that repeat a doc_id are scored each, and those that tie in
    everything else share ranks out as they come. Other columns are ignored; an empty table gives no rows, an empty target has no features.
    """
    found = written(window_buckets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "buckets")
    gains = bucket_gains(found, window_buckets(target.select("text")))
    rows = with_weight(found, gains).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, "scores")
    return ranked(rows, percent, F.col("n_words") >= min_words).select("doc_id", "n_features", "weight", "score", "rank")


def op13_importance_draw(spark, sf_dir: str) -> DataFrame:
    """A quarter of ``documents`` drawn towards ``benchmark``."""
    return resample(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark").select("text"))


OP13_SQL = r"""
WITH tab AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
texts AS (SELECT row_number() OVER () AS k, doc_id, text FROM documents UNION ALL SELECT NULL, NULL, text FROM benchmark),
words AS (SELECT k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
f AS (SELECT k, unnest(w) AS feature FROM words
      UNION ALL SELECT k, w[i] || ' ' || w[i + 1] FROM (SELECT k, w, unnest(range(1, len(w))) AS i FROM words)),
each AS (SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM f)),
crc AS (SELECT feature, xor(list_reduce([4294967295] || list_transform(range(0, length(h) // 2), lambda j: ('0x' || substr(h, 2 * j + 1, 2))::BIGINT),
                                        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM each, tab),
fb AS (SELECT k, bucket FROM f JOIN crc USING (feature)),
n AS (SELECT bucket, count(k) AS s, count(*) - count(k) AS t FROM fb GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (S + 10000)::DOUBLE / ((s1 + 1)::DOUBLE * (T1 + 10000)::DOUBLE)))::BIGINT AS gain
         FROM (SELECT bucket, t, s AS s1, sum(s) OVER () AS S, sum(t) OVER () AS T1 FROM n)),
doc AS (SELECT k, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM fb JOIN gain USING (bucket) WHERE k IS NOT NULL GROUP BY k),
scored AS (SELECT w.doc_id, len(w.w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || w.doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
           FROM words w LEFT JOIN doc USING (k) WHERE w.k IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS nth, count(*) FILTER (n_words >= 20) OVER () AS eligible FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND nth <= eligible * 25 // 100 THEN nth END AS rank FROM r
"""
