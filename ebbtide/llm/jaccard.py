"""N-gram Jaccard join by chosen paths.

Every text becomes the set of its five-word shingles (white-space words, lower case) and a MinHash sketch of it. The
join tree splits a bucket on sampled sketch places: two sets go on together where they share the sampled token. A
bucket is split again until it is small, or its members are so alike that no split would part them; then it is
compared by brute force, in blocks. Runs repeat until a pair at the threshold is met with the target recall; the misses
of sketches that agree badly, in all runs together, and those of the cheap look before the texts are counted in.

Equal word sequences are joined once, as one weighted vertex. Null, empty and white-space texts have no shingles and
link with nothing, not even with each other; each is its own class. A text of fewer than five words has one shingle of
all of them. Repeated rows are copies and link with each other. Rows with the same doc_id but other texts are other
vertices; their classes are numbered by the smallest doc_id, so they may share a number only if that id is in both.
Columns beyond doc_id and text are left alone, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ebbtide.llm.buckets import link, plausible
from ebbtide.llm.graph import components
from ebbtide.llm.text import minhash, shingles, slices
from ebbtide.llm.sieve import sieved
from ebbtide.llm.workspace import Workspace

#: Places of a sketch, places sampled at each node, and the depth beyond which buckets are compared as they are.
SKETCH, SAMPLED, DEPTH = 64, 2, 8
#: The share of the misses allowed that plausible() may have; the rest is the tree's.
CHEAP = 0.25


def runs_for(recall: float, threshold: float, sampled: int = SAMPLED, sketch: int | None = None) -> int:
    """Runs after which a pair at the threshold has met with probability `recall`, however deep the tree.

    A pair leaves a node without a common child with probability q = ((1 - t) + t q) ** sampled, at the limit. All runs
    look at one sketch: with its size given, t is the share of its places that agree, and the misses are averaged over it.
    """
    shares = [(threshold, 1.0)] if sketch is None else [(k / sketch, p) for k, p in enumerate(_agreeing(sketch, threshold))]
    misses = []
    for t, p in shares:
        q = 0.0
        for _ in range(64):
            q = ((1 - t) + t * q) ** sampled
        misses.append((q, p))
    runs = 1
    # A sketch without a place that agrees is missed by any number of runs.
    while runs < (sketch or 1 << 10) and sum(p * q**runs for q, p in misses) > 1 - recall:
        runs += 1
    return runs


def _agreeing(sketch: int, threshold: float) -> list[float]:
    """The probabilities of 0, 1, ... places that agree, of a pair at the threshold."""
    return [math.comb(sketch, k) * threshold**k * (1 - threshold) ** (sketch - k) for k in range(sketch + 1)]


def least_places(recall: float, threshold: float, sketch: int = SKETCH) -> int:
    """The most places that all but 1 - recall of the pairs at the threshold agree at."""
    below = 0.0
    for k, p in enumerate(_agreeing(sketch, threshold)):
        below += p
        if below > 1 - recall:
            return k
    return sketch


def digest(text: str) -> str | None:
    """The name of a text's word sequence; None without words."""
    words = text.lower().translate(_WHITE).split(" ")
    words = " ".join(w for w in words if w)
    return hashlib.blake2b(words.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest() if words else None


_WHITE = {9: " ", 10: " ", 11: " ", 12: " ", 13: " "}


def sketches(docs: DataFrame, words: int = 5, row: str | None = None) -> DataFrame:
    """(doc_id, check, row, digest, sketch): check tells texts of one doc_id apart, row is the column so named, or null."""
    schema = "doc_id bigint, check bigint, row bigint, digest string, sketch array<int>"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).to_pylist()
            for part in slices([len(t) for t in texts]):
                own = texts[part]
                sketch = minhash(*shingles(own, words), SKETCH).view(np.int32)
                flat = pa.array(sketch.ravel())
                places = pa.array(np.arange(len(own) + 1, dtype=np.int32) * SKETCH)
                size = part.stop - part.start
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.start, size),
                        batch.column(1).slice(part.start, size),
                        batch.column(2).slice(part.start, size),
                        pa.array([digest(t) for t in own], pa.string()),
                        pa.ListArray.from_arrays(places, flat),
                    ],
                    names=["doc_id", "check", "row", "digest", "sketch"],
                )

    text = F.coalesce("text", F.lit(""))
    own = (F.lit(None) if row is None else F.col(row)).cast("bigint").alias("row")
    picked = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64(text).alias("check"), own, text.alias("text"))
    return picked.mapInArrow(task, schema)


def tree(vertices: DataFrame, work: Workspace, runs: int, small: int, same: float = 0.5) -> DataFrame:
    """(bucket, id) of the leaves: buckets small enough, or alike enough, to be compared.

    vertices has (id, sketch). Per level, two passes: count each child, then send on what is still large. The leaves of a level
    are written before the next one: every task of a stage reports the metrics of all its plan to the driver, so one stage
    over all levels would cost the driver the square of their number.
    """

    def child(node, place) -> F.Column:
        return F.xxhash64(node, place, F.col("sketch")[place])

    # Each run samples its own places, so that no two runs look at the same token.
    places = np.random.default_rng(11).permutation(SKETCH)[: min(SKETCH, runs * SAMPLED)]
    roots = F.explode(F.array(*(F.struct(F.lit(0).cast("bigint").alias("node"), F.lit(int(p)).alias("place")) for p in places)))
    level = vertices.select("id", "sketch", roots.alias("step")).select(
        "id", F.col("step.node").alias("node"), "step.place", child(F.col("step.node"), F.col("step.place")).alias("bucket")
    )
    leaves = []
    for depth in range(DEPTH):
        if depth:
            level = work.keep(level)
        counts = work.keep(
            level.groupBy("node", "place", "bucket").agg(F.count("*").alias("n")).where("n > 1")
        )
        if depth:
            # A node whose members mostly stay together at the sampled places isn't worth splitting.
            whole = level.groupBy("node", "place").agg(F.count("*").alias("all"))
            likeness = (
                counts.groupBy("node", "place")
                .agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("square"))
                .join(whole, ["node", "place"])
                .groupBy("node")
                .agg(F.avg(F.col("square") / F.col("all") / F.col("all")).alias("likeness"))
                .where(F.col("likeness") >= same)
                .select("node")
            )
            likeness = work.keep(likeness)
            counts = counts.join(likeness, "node", "left_anti")
        last = depth == DEPTH - 1
        ends = F.lit(True) if last else F.col("n") <= small
        found = level.join(counts.where(ends).select("bucket"), "bucket", "left_semi").select("bucket", "id")
        if depth:
            found = found.union(level.join(likeness, "node", "left_semi").select(F.col("node").alias("bucket"), "id"))
        leaves.append(work.write(found))
        if last:
            break
        more = level.join(counts.where(~ends).select("bucket"), "bucket", "left_semi").select(F.col("bucket").alias("node"), "id")
        more = work.keep(more)
        if more.isEmpty():
            break
        places = F.explode(
            F.array(*(F.pmod(F.xxhash64(F.lit(k), "node"), F.lit(SKETCH)).cast("int") for k in range(SAMPLED)))
        )
        # Two equal draws are one place.
        level = (
            more.join(vertices.select("id", "sketch"), "id")
            .select("id", "node", "sketch", places.alias("place"))
            .select("id", "node", "place", child(F.col("node"), F.col("place")).alias("bucket"))
            .distinct()
        )
    return work.spark.read.schema(found.schema).parquet(*leaves).distinct()


def alike_sketches(least: float):
    """Whether sketches agree at enough places; the last field of the rows."""

    def alike(a: list[tuple], b: list[tuple]) -> np.ndarray:
        x, y = np.array([r[-1] for r in a]), np.array([r[-1] for r in b])
        agree = np.zeros((len(a), len(b)), dtype=np.int16)
        for k in range(x.shape[1]):
            agree += x[:, k, None] == y[None, :, k]
        return agree >= least * x.shape[1]

    return alike


def alike_sets(threshold: float, words: int = 5):
    """Whether the Jaccard similarity of two texts reaches the threshold; the last field of the rows."""

    def sets(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        return shingles([r[-1] for r in rows], words)

    def alike(a: list[tuple], b: list[tuple]) -> np.ndarray:
        one = a is b
        left, at = sets(a)
        right, to = (left, at) if one else sets(b)
        sizes, others = np.diff(at), np.diff(to)
        shared = np.zeros((len(a), len(b)), dtype=np.float32)
        if len(a) * len(b) <= 4:
            for i in range(len(a)):
                for j in range(len(b)):
                    both = np.concatenate((left[at[i] : at[i + 1]], right[to[j] : to[j + 1]]))
                    shared[i, j] = len(both) - len(np.unique(both))
        else:
            common = _repeated(left) if one else np.intersect1d(left, right)
            rows, cols = np.repeat(np.arange(len(a)), sizes), np.repeat(np.arange(len(b)), others)
            # Slices of the shared shingles bound the memory; float32 counts are exact below 2 ** 24.
            for start in range(0, len(common), 4096):
                names = common[start : start + 4096]
                x = _incidence(left, rows, names, len(a))
                shared += x @ (x if one else _incidence(right, cols, names, len(b))).T
        union = sizes[:, None] + others[None, :] - shared.astype(np.float64)
        return shared >= threshold * union - 1e-9

    return alike


def _repeated(values: np.ndarray) -> np.ndarray:
    names, counts = np.unique(values, return_counts=True)
    return names[counts > 1]


def _incidence(values: np.ndarray, rows: np.ndarray, names: np.ndarray, n: int) -> np.ndarray:
    at = np.minimum(np.searchsorted(names, values), len(names) - 1)
    hit = names[at] == values
    out = np.zeros((n, len(names)), dtype=np.float32)
    out[rows[hit], at[hit]] = 1
    return out


def jaccard_join(
    docs: DataFrame, threshold: float = 0.8, words: int = 5, recall: float = 0.9999, small: int = 64
) -> DataFrame:
    """(doc_id, check, class_id, n_links) of every row of docs (doc_id, text).

    Two rows are linked when the Jaccard similarity of their shingle sets reaches the threshold; n_links counts the
    other rows linked directly, class_id is the smallest doc_id reachable by links, the row's own included.
    """
    return grouped(docs, threshold, words, recall, small).select("doc_id", "check", "class_id", "n_links")


def grouped(
    docs: DataFrame,
    threshold: float = 0.8,
    words: int = 5,
    recall: float = 0.9999,
    small: int = 64,
    row: str | None = None,
) -> DataFrame:
    """(doc_id, check, row, root, class_id, n_links) of every row of docs: root names its class, null without words.

    Unlike class_id, no two classes share a root, whatever the doc_ids are. row: the column so named, or null.
    """
    work = Workspace(docs.sparkSession, "jaccard")
    rows = work.keep(sketches(docs, words, row))
    # A null id comes last: a copy that has an id names the class.
    first = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "check")
    vertices = rows.where("digest IS NOT NULL").groupBy("digest").agg(
        F.count("*").alias("weight"), F.min(first).alias("first"), F.any_value("sketch").alias("sketch")
    )
    # The numbers are drawn once, when the table is written.
    vertices = work.keep(
        vertices.select(F.monotonically_increasing_id().alias("id"), "digest", "weight", "first.doc_id", "first.check", "sketch")
    )
    slim = vertices.select("id", "sketch")
    # The tree and the cheap look share the misses allowed.
    runs = runs_for(1 - (1 - CHEAP) * (1 - recall), threshold, sketch=SKETCH)
    members = work.keep(tree(slim, work, runs, small))
    # Texts are fetched only for those whose sketch agrees with another one's.
    least = least_places(1 - CHEAP * (1 - recall), threshold)
    members = work.keep(plausible(members, slim, ["sketch"], alike_sketches(least / SKETCH), keep=work.keep))
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64(text).alias("check"), text.alias("text"))
    known = vertices.select("id", "weight", "doc_id", "check").join(members.select("id").distinct(), "id", "left_semi")
    known = work.keep(known)
    # Only texts that may be among those wanted are shuffled, copies of one row once a task.
    texts = sieved(texts, F.col("check"), known.select("check"), "__may").where("__may")
    # Keys without nulls, so that the join takes the partitioning of the step before.
    key = [F.col("doc_id").isNull().alias("missing"), F.coalesce("doc_id", F.lit(0)).alias("own"), "check"]
    texts = texts.select(*key, "text").dropDuplicates(["missing", "own", "check"])
    payload = known.select("id", "weight", *key).join(texts, ["missing", "own", "check"]).select("id", "weight", "text")
    found = work.keep(link(members, payload, ["text"], alike_sets(threshold, words), keep=work.keep))
    roots = components(found.select(F.col("id").alias("u"), F.col("root").alias("v")), work)
    links = found.groupBy("id").agg(F.sum("n").alias("links"))
    classes = (
        vertices.select("id", "digest", "weight", F.col("doc_id").alias("first"))
        .join(links, "id", "left")
        .join(roots, "id", "left")
        .withColumn("root", F.coalesce("root", "id"))
    )
    # Written once, as are the keys of `keep_one`: every use in a plan is a set of tasks more that report to the driver.
    classes = work.keep(classes)
    least = classes.groupBy("root").agg(F.min("first").alias("class_id"))
    classes = classes.join(least, "root").select(
        "digest", "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")
    )
    return rows.select("doc_id", "check", "row", "digest").join(classes, "digest", "left").select(
        "doc_id",
        "check",
        "row",
        "root",
        F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay: of each class one row, that with the smallest doc_id (of copies of it, any one).

    Null ids come last; of several texts with that doc_id, the one with the smallest hash stays. The columns of docs are
    left as they are. Rows without words all stay, but for repeats of one doc_id and text; a null doc_id repeats none.

    Rows that surely stay go through in place. Only those that may be dropped or repeated, by a bitmap over the hashes of id and
    text, are shuffled with their texts, and told apart exactly.
    """
    work = Workspace(docs.sparkSession, "keep-one")
    found = grouped(docs, **options)
    missing, bare = F.col("doc_id").isNull(), F.col("root").isNull()
    # One row per id and text; what has no words is a class of its own.
    keys = work.keep(found.groupBy("root", "doc_id", "check").agg(F.count("*").alias("n")))
    alone = (F.when(bare, F.col(c)).alias(f"own_{c}") for c in ("doc_id", "check"))
    first = keys.groupBy("root", *alone).agg(F.min(F.struct(missing.alias("missing"), "doc_id", "check")).alias("first"))
    stays = first.select(F.col("first.doc_id"), F.col("first.check"), F.lit(True).alias("stays"))
    same = [F.col(f"k.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ("doc_id", "check")]
    judged = keys.alias("k").join(stays.alias("s"), same, "left").select("k.*", "stays")
    touched = judged.where(F.col("stays").isNull() | ((F.col("n") > 1) & ~(bare & missing)))
    touched = work.keep(touched.select("doc_id", "check", F.xxhash64("doc_id", "check").alias("hash"), "stays"))
    plain = F.coalesce(F.col("text"), F.lit(""))
    given = docs.withColumns(
        {
            "__missing": F.col("doc_id").isNull(),
            "__id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)),
            "__check": F.xxhash64(plain),
        }
    )
    own = F.when(F.col("__missing"), None).otherwise(F.col("__id"))
    marked = sieved(given, F.xxhash64(own, "__check"), touched.select("hash"), "__may")
    # What has neither id nor words is never a repeat.
    free = ~F.col("__may") | (F.col("__missing") & (F.btrim(plain, F.lit(" \t\n\x0b\f\r")) == ""))
    key = ["__missing", "__id", "__check"]
    looked = marked.where(~free).dropDuplicates(key)
    gone = touched.where("stays IS NULL").select(
        F.col("doc_id").isNull().alias(key[0]), F.coalesce("doc_id", F.lit(0)).alias(key[1]), F.col("check").alias(key[2])
    )
    looked = looked.join(gone, key, "left_anti")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return marked.where(free).select(*columns).unionByName(looked.select(*columns))
