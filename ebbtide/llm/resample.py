"""Importance resampling towards a target corpus: documents whose words are likelier in the target are likelier to be drawn.

Words are found by batch concatenation: the texts of a batch are joined with a separator that no word can hold, one regular
expression pass finds the words of all, `searchsorted` over the words' places gives every document its words, and n-grams that
would cross from one document into the next are masked before the counts (`bincount` by hash bucket). Every text is read once: the
buckets of its features are kept (two or four bytes a feature), and both the corpus counts and the weights come from them.

The draw is Gumbel noise from a hash of the id on top of the weight, and the highest scores; ranks are counted in score ranges with
exact totals, so no task sorts more than a range.

A null text has no words; a document without features weighs 0. A null id draws its noise as an empty string. Equal scores are
ranked by the smaller id, a null id first; rows that repeat id, score and counts take consecutive ranks. Columns beyond doc_id and text are not
read. An empty corpus gives no rows; an empty target has no counts, only the ones that smoothing adds.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from ebbtide.llm.text import slices
from ebbtide.llm.workspace import Workspace, partitions

#: Fixed values of the contract: features, buckets, share drawn, least words and the key of the noise.
NGRAMS, BUCKETS, PERCENT, LEAST_WORDS, KEY = 1, 10_000, 10, 20, "2024"
GAIN, NOISE = 1000, 4294967296.0
#: Bytes of words: digits, small letters (capitals are lowered before) and everything outside ASCII.
WORD = rb"[0-9a-z\x80-\xff]+"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Not a word byte, so no word reaches from one text into the next.
SENTINEL = b"\x00"
#: Copies of one scored row are expanded in runs of this many.
RUN = 1 << 16

FEATURES = "doc_id {id}, n_words bigint, n_features bigint, buckets binary"


def counter(buckets: int):
    """texts, n -> (buckets of all features, first feature of every text, words of every text)."""
    word, known = re.compile(WORD), {}

    def find(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = [t.encode("utf-8", "replace").translate(LOWER) for t in texts]
        joined = SENTINEL.join([*raw, b""])
        starts = np.cumsum([0, *(len(r) + 1 for r in raw)])
        spans = [(m.start(), m.group()) for m in word.finditer(joined)]
        places = np.fromiter((s for s, _ in spans), dtype=np.int64, count=len(spans))
        edges = np.searchsorted(places, starts)
        # Every distinct word of the batch is numbered and hashed once.
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for _, w in spans), dtype=np.int64, count=len(spans))
        sums = [zlib.crc32(w) for w in number]
        runs = [(np.arange(len(ids)), np.array(sums, dtype=np.int64)[ids] if sums else ids)]
        words, grams, crcs = list(number), ids, np.array(sums, dtype=np.int64)
        ends = np.repeat(edges[1:], np.diff(edges))
        for k in range(1, n):
            # A run of k + 1 words from every word that has k more in its own text.
            at = np.flatnonzero(np.arange(len(ids)) + k < ends)
            pair = grams[at] * len(words) + ids[at + k]
            distinct, back = np.unique(pair, return_inverse=True)
            crcs = np.array(
                [zlib.crc32(b" " + words[p % len(words)], int(crcs[p // len(words)])) for p in distinct.tolist()],
                dtype=np.int64,
            )
            grams = np.full(len(ids), -1)
            grams[at] = back
            runs.append((at, crcs[back]))
        at = np.concatenate([r[0] for r in runs])
        crc = np.concatenate([r[1] for r in runs])
        order = np.argsort(at, kind="stable")
        return crc[order] % buckets, np.searchsorted(at[order], edges), np.diff(edges)

    return find


def features(docs: DataFrame, ngrams: int = NGRAMS, buckets: int = BUCKETS) -> DataFrame:
    """The hash bucket of every feature of every document, as little-endian numbers."""
    width = "<u2" if buckets <= 1 << 16 else "<u4"
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = counter(buckets)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for part in slices([len(t) for t in texts]):
                found, edges, words = find(texts[part], ngrams)
                data = found.astype(width)
                rows = [data[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[part.start : part.stop],
                        pa.array(words, pa.int64()),
                        pa.array(np.diff(edges), pa.int64()),
                        pa.array(rows, pa.binary()),
                    ],
                    names=["doc_id", "n_words", "n_features", "buckets"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, FEATURES.format(id=kind))


def counts(found: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features in each bucket that has any; a task adds up its own rows first."""
    width = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for row in batch.column("buckets").to_pylist():
                total += np.bincount(np.frombuffer(row, dtype=width), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    partial = found.select("buckets").mapInArrow(run, "bucket bigint, n bigint")
    return partial.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain): log ratio of the smoothed shares in target and corpus in thousandths, one row per bucket."""
    spark = corpus.sparkSession
    whole = Window.partitionBy()
    rows = spark.range(buckets).withColumnRenamed("id", "bucket")
    for name, side in (("in_corpus", corpus), ("in_target", target)):
        rows = rows.join(side.withColumnRenamed("n", name), "bucket", "left").na.fill(0, [name])
        # One row for each bucket: the window has as many rows as there are buckets, whatever the corpus is.
        rows = rows.withColumn(f"{name}_all", F.sum(name).over(whole))
    s, s_all, t, t_all = (
        F.col(c).cast("double") for c in ("in_corpus", "in_corpus_all", "in_target", "in_target_all")
    )
    ratio = (t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets))
    return rows.select("bucket", F.floor(GAIN * F.log(ratio)).alias("gain"))


def weighed(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the sum of the gains of a document's features."""
    kind = dict(found.dtypes)["doc_id"]
    width = "<u2" if len(gain) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("buckets").to_pylist()
            weight = [int(gain[np.frombuffer(row, dtype=width)].sum()) for row in rows]
            columns = [batch.column(c) for c in ("doc_id", "n_words", "n_features")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(weight, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"]
            )

    return found.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id: Column, key: str = KEY) -> Column:
    """Gumbel noise in thousandths, from a hash of the id."""
    digest = F.sha2(F.concat(F.lit(f"{key}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint").cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(NOISE))))


def ranked(scored: DataFrame, eligible: Column, percent: int = PERCENT) -> DataFrame:
    """All rows with `rank`: 1, 2, 3... for the drawn share of the eligible rows by falling score, null for the others.

    Ranges of scores are cut at approximate quantiles, denser in the drawn share, and counted exactly; only rows of ranges that the draw
    reaches are sorted, one range a task.
    """
    spark = scored.sparkSession
    n_ranges = max(2, partitions(spark))
    share = percent / 100
    inner = [share * i / n_ranges for i in range(1, n_ranges + 1)]
    outer = [share + (1 - share) * i / n_ranges for i in range(1, n_ranges)]
    places = sorted({round(1 - p, 12) for p in inner + outer})
    rows = scored.where(eligible)
    n, cuts = rows.agg(
        F.count(F.lit(1)), F.percentile_approx("score", places, F.lit(100 * n_ranges))
    ).first()
    cuts = sorted(set(cuts or []))
    draw = percent * n // 100
    # Scores are whole numbers below 2^53, so they and the cuts are exact as doubles.
    cutter = Bucketizer(splits=[-math.inf, *map(float, cuts or [0]), math.inf], inputCol="score_", outputCol="range_")

    def ranged(df: DataFrame) -> DataFrame:
        placed = cutter.transform(df.withColumn("score_", F.col("score").cast("double")))
        return placed.drop("score_").withColumn("range_", F.col("range_").cast("int"))

    sizes = dict(ranged(rows).groupBy("range_").agg(F.count(F.lit(1))).collect())
    before, total = {}, 0
    for r in sorted(sizes, reverse=True):
        if total >= draw:
            break
        before[r], total = total, total + sizes[r]
    low = min(before, default=None)
    columns = scored.columns
    if low is None:
        return scored.withColumn("rank", F.lit(None).cast("bigint"))
    beyond = ~F.coalesce(eligible, F.lit(False)) | (F.col("range_") < low)
    undrawn = ranged(scored).where(beyond).drop("range_").withColumn("rank", F.lit(None).cast("bigint"))
    # Rows alike in everything are one row with a count until they have their ranks.
    tied = ranged(rows).where(F.col("range_") >= low).groupBy("range_", *columns).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("range_").orderBy(F.col("score").desc(), "doc_id", *columns)
    offset = F.element_at(F.create_map(*(F.lit(x) for pair in before.items() for x in pair)), F.col("range_"))
    tied = tied.withColumn("last", offset + F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.col("last") - F.col("n") + 1
    runs = tied.withColumn("begin", F.explode(F.sequence(first, F.col("last"), F.lit(RUN))))
    every = F.sequence(F.col("begin"), F.least(F.col("last"), F.col("begin") + RUN - 1))
    every = runs.withColumn("rank", F.explode(every))
    drawn = every.select(*columns, F.when(F.col("rank") <= draw, F.col("rank")).alias("rank"))
    return undrawn.unionByName(drawn)


def resampled(
    docs: DataFrame,
    target: DataFrame,
    ngrams: int = NGRAMS,
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    least: int = LEAST_WORDS,
    key: str = KEY,
) -> DataFrame:
    """Every document with n_features, weight, score and rank; the drawn documents are those with a rank."""
    work = Workspace(docs.sparkSession, "resample")
    found = work.keep(features(docs, ngrams, buckets))
    goal = features(target.select(F.lit(None).cast("bigint").alias("doc_id"), "text"), ngrams, buckets)
    table = gains(counts(found, buckets), counts(goal, buckets), buckets).collect()
    gain = np.zeros(buckets, dtype=np.int64)
    for row in table:
        gain[row["bucket"]] = row["gain"]
    score = F.col("weight") + noise(F.col("doc_id"), key)
    scored = work.keep(weighed(found, gain).withColumn("score", score))
    out = ranked(scored, F.col("n_words") >= least, percent)
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def oracle() -> str:
    """The same rows in DuckDB; CRC-32 is worked out byte by byte for the distinct words."""
    return r"""
WITH crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS entry
  FROM (SELECT unnest(range(0, 256)) AS i)),
words AS (
  SELECT 'd' AS side, doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
  UNION ALL
  SELECT 'b', NULL, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
known AS (
  SELECT w, xor(list_reduce(
      list_prepend(4294967295, list_transform(range(0, len(hex(w)) // 2),
        lambda i: ('0x' || substr(hex(w), 2 * i + 1, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, entry[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT w FROM words), crc_table),
placed AS (SELECT side, doc_id, bucket FROM words JOIN known USING (w)),
totals AS (SELECT count(*) FILTER (side = 'd') AS s_all, count(*) FILTER (side = 'b') AS t_all FROM placed),
by_bucket AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM placed GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE
    / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain FROM by_bucket, totals),
weight AS (
  SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight
  FROM placed JOIN gain USING (bucket) WHERE side = 'd' GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln(
      (('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score
  FROM documents d LEFT JOIN weight USING (doc_id)),
drawn AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank
  FROM scored WHERE n_features >= 20
  QUALIFY rank <= (SELECT 10 * count(*) // 100 FROM scored WHERE n_features >= 20))
SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN drawn USING (doc_id)
"""
