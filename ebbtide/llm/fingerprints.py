"""Document fingerprints by a randomised edit embedding.

A walk reads a text from its first to its last character. At every step it writes the character that it is on and moves on or
stays, by a random bit that depends on the step and the character alone. All texts share these bits, so texts a few
edits apart fall into step again after each edit, and edit distance becomes Hamming distance between the walks. A
fingerprint samples the walk at 128 places, drawn once for all texts: a place is a chain of steps, of which the last within
the walk counts, so short and long texts are both sampled over their whole length and equal lengths share all places.
A sample is eight bits of a hash of the four characters there.

`near` verifies: two fingerprints are as alike as the share of equal samples. `bands` hashes sampled groups of samples;
near_duplicates compares the texts that share a band.

A null text is an empty one, whose fingerprint is all zeros; its likeness to another empty text is 1. Equal texts have equal
fingerprints. Documents with one doc_id are ordered by their texts, null ids come last. A table of one document has itself
as its next document; an empty table gives no rows. Columns beyond doc_id and text are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ebbtide.llm.buckets import link
from ebbtide.llm.graph import components
from ebbtide.llm.text import mix, slices
from ebbtide.llm.workspace import Workspace, partitions

#: Samples of a fingerprint, and the characters hashed in each.
SAMPLES, WINDOW = 128, 4
#: The random bits repeat after so many steps, and characters share them modulo so many.
PERIOD = 256


def dwell(seed: int = 17) -> np.ndarray:
    """How many steps a walk stays on a character, by step (modulo PERIOD) and character (modulo PERIOD)."""
    bits = np.random.default_rng(seed).integers(0, 2, (PERIOD, PERIOD)).astype(bool)
    bits[0] = True  # bounds the stay by one period
    out = np.zeros((PERIOD, PERIOD), dtype=np.int32)
    ahead = np.ones(PERIOD, dtype=np.int32)
    for step in reversed(range(PERIOD)):
        ahead = np.where(bits[step], 1, ahead + 1)
        out[step] = ahead
    return out


def places(longest: int, seed: int = 29) -> list[np.ndarray]:
    """For each sample the chain of steps; the next link of a chain from p is uniform in 1 / (p + 1), as records are."""
    out = []
    for k in range(SAMPLES):
        draw = np.random.default_rng([seed, k])
        chain = [0]
        while chain[-1] < longest:
            chain.append(int((chain[-1] + 1) / max(draw.random(), 1e-12)))
        out.append(np.array(chain, dtype=np.int64))
    return out


class Embedding:
    def __init__(self):
        self.stay = dwell()
        self.flat = self.stay.ravel()
        self.rows = self.stay.tolist()
        self.chains, self.longest = [], 0

    def _walk_one(self, codes: np.ndarray) -> np.ndarray:
        """The step at which each character is entered, and the length of the walk."""
        rows, step, out = self.rows, 0, [0]
        for c in (codes & 255).astype(np.uint8).tobytes():
            step += rows[step & 255][c]
            out.append(step)
        return np.array(out, dtype=np.int64)

    def _walk_many(self, codes: list[np.ndarray]) -> list[np.ndarray]:
        """The same for texts of about one length, character by character over all of them."""
        n = max(map(len, codes))
        chars = np.zeros((n, len(codes)), dtype=np.int32)
        for k, c in enumerate(codes):
            chars[: len(c), k] = c & 255
        steps = np.zeros((n + 1, len(codes)), dtype=np.int32)
        for i in range(n):
            at = (steps[i] & 255) << 8
            at |= chars[i]
            np.add(steps[i], self.flat[at], out=steps[i + 1])
        across = np.ascontiguousarray(steps.T)
        return [across[k, : len(c) + 1] for k, c in enumerate(codes)]

    def samples(self, texts: list[str]) -> np.ndarray:
        """One row of SAMPLES bytes for each text."""
        codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64) for t in texts]
        order = sorted((i for i in range(len(texts)) if len(codes[i])), key=lambda i: len(codes[i]))
        out = np.zeros((len(texts), SAMPLES), dtype=np.uint8)
        start = 0
        while start < len(order):
            # Texts at most a quarter longer than the shortest, two million characters together.
            least, stop = len(codes[order[start]]), start + 1
            while stop < len(order) and len(codes[order[stop]]) <= least * 1.25 + 16 and (stop - start) * len(codes[order[stop]]) < 2_000_000:
                stop += 1
            group = order[start:stop]
            many = len(group) >= 40
            walks = self._walk_many([codes[i] for i in group]) if many else None
            for k, i in enumerate(group):
                out[i] = self._sample(codes[i], walks[k] if many else self._walk_one(codes[i]))
            start = stop
        return out

    def _sample(self, codes: np.ndarray, steps: np.ndarray) -> np.ndarray:
        length = int(steps[-1])
        if length > self.longest:
            self.longest = 2 * length
            self.chains = places(self.longest)
            # Chains side by side, padded beyond any walk, to look up all samples at once.
            self.table = np.full((SAMPLES, max(map(len, self.chains))), np.iinfo(np.int64).max)
            for k, chain in enumerate(self.chains):
                self.table[k, : len(chain)] = chain
        place = self.table[np.arange(SAMPLES), (self.table < length).sum(axis=1) - 1]
        at = np.searchsorted(steps, place, side="right") - 1
        padded = np.concatenate((codes, np.zeros(WINDOW, dtype=np.int64))).astype(np.uint64)
        total = np.zeros(SAMPLES, dtype=np.uint64)
        for k in range(WINDOW):
            total = mix(total * np.uint64(0x100000001B3) + padded[at + k] + np.uint64(1))
        return (total >> np.uint64(56)).astype(np.uint8)


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal samples, row by row."""
    return (a == b).mean(axis=1)


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) in runs of descending doc_id, each run followed by the first row of the next (ahead = 1).

    Runs are ranges of doc_id, one per partition, so a row and its next meet without a global sort. What the driver
    gets is two numbers a range.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"), key.alias("key"))
    cuts = rows.approxQuantile("key", [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    cuts = sorted({int(c) for c in cuts or []})
    run = F.lit(0)
    if cuts:
        listed = F.array(*(F.lit(c).cast("bigint") for c in cuts))
        run = F.size(F.filter(listed, lambda c: c > F.col("key")))
    rows = rows.withColumn("run", run)
    firsts = {r["run"]: r["first"] for r in rows.groupBy("run").agg(F.max("key").alias("first")).collect()}
    if not firsts:
        return rows.select("doc_id", "text", "key", "run", F.lit(0).alias("ahead")).limit(0)
    order = sorted(firsts)
    before = F.create_map(*(F.lit(x) for i, r in enumerate(order) for x in (r, order[i - 1])))
    first = F.create_map(*(F.lit(x) for r in order for x in (r, firsts[r])))
    own = F.struct("run", F.lit(0).alias("ahead"))
    ahead = F.struct(before[F.col("run")].alias("run"), F.lit(1).alias("ahead"))
    to = F.when(F.col("key") == first[F.col("run")], F.array(own, ahead)).otherwise(F.array(own))
    rows = rows.withColumn("to", F.explode(to)).select("doc_id", "text", "key", "to.run", "to.ahead")
    return rows.repartitionById(max(order) + 1, F.col("run")).sortWithinPartitions("ahead", F.desc("key"), "text")


SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last half replaced by the start of the next document."""
    names = [f.split(" ")[0] for f in SCHEMA.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedding = Embedding()

        def out(rows: list[tuple], texts: list[str]) -> pa.RecordBatch:
            """rows have one text each; texts has one more, the next of the last."""
            edited = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for t, after in zip(texts, texts[1:])]
            own, other = embedding.samples(texts), embedding.samples(edited)
            columns = [
                pa.array([r for r in rows], pa.int64()),
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
                pa.array([x.tobytes().hex() for x in own[:-1]]),
                pa.array([x.tobytes().hex() for x in other]),
                pa.array(near(own[:-1], other)),
                pa.array(near(own[:-1], own[1:])),
            ]
            return pa.RecordBatch.from_arrays(columns, names=names)

        ids, texts, over = [], [], False
        for batch in batches:
            listed, found, flags = (batch.column(i).to_pylist() for i in (0, 1, 4))
            for part in slices([len(t) for t in found], 4_000_000):
                for who, text, ahead in zip(listed[part], found[part], flags[part]):
                    if over:
                        continue
                    texts.append(text)
                    if ahead:
                        # The first row of the next run closes this one; copies of it aren't needed.
                        over = True
                    else:
                        ids.append(who)
                if len(texts) > 1:
                    n = len(texts) - 1
                    yield out(ids[:n], texts)
                    ids, texts = ids[n:], texts[n:]

    return with_next(docs).mapInArrow(task, SCHEMA)


def embedded(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every row; no neighbours are needed for it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedding = Embedding()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in slices([len(t) for t in texts], 4_000_000):
                found = [x.tobytes().hex() for x in embedding.samples(texts[part])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.start, len(found)), pa.array(found)], names=["doc_id", "fingerprint"]
                )

    picked = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    return picked.mapInArrow(task, "doc_id bigint, fingerprint string")


def bands(width: int, count: int, seed: int = 41) -> list[list[int]]:
    """The places of `count` bands of `width` sampled places each."""
    draw = np.random.default_rng(seed)
    return [sorted(draw.choice(SAMPLES, width, replace=False).tolist()) for _ in range(count)]


def near_duplicates(docs: DataFrame, threshold: float = 0.7, width: int = 4, count: int = 24) -> DataFrame:
    """(doc_id, class_id, n_links): rows whose fingerprints share a band and agree in `threshold` of the samples.

    A pair at 0.7 misses all 24 bands of 4 samples with probability 0.002. Equal fingerprints are one weighted vertex.
    """
    work = Workspace(docs.sparkSession, "fingerprints")
    rows = work.keep(embedded(docs))
    vertices = rows.groupBy("fingerprint").agg(F.count("*").alias("weight"), F.min("doc_id").alias("first"))
    vertices = work.keep(vertices.withColumn("id", F.monotonically_increasing_id()))
    parts = [
        F.xxhash64(F.lit(i), *(F.substring("fingerprint", 2 * p + 1, 2) for p in band)) for i, band in enumerate(bands(width, count))
    ]
    members = work.keep(vertices.select("id", F.explode(F.array(*parts)).alias("bucket")))

    def alike(a: list[tuple], b: list[tuple]) -> np.ndarray:
        x, y = (np.array([list(bytes.fromhex(r[-1])) for r in rows], dtype=np.uint8) for rows in (a, b))
        agree = np.zeros((len(a), len(b)), dtype=np.int16)
        for k in range(SAMPLES):
            agree += x[:, k, None] == y[None, :, k]
        return agree >= threshold * SAMPLES

    found = work.keep(link(members, vertices.select("id", "weight", "fingerprint"), ["fingerprint"], alike))
    roots = components(found.select(F.col("id").alias("u"), F.col("root").alias("v")), work)
    links = found.groupBy("id").agg(F.sum("n").alias("links"))
    classes = vertices.join(links, "id", "left").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = classes.groupBy("root").agg(F.min("first").alias("class_id"))
    classes = classes.join(least, "root").select(
        "fingerprint", "class_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")
    )
    return rows.join(classes, "fingerprint").select("doc_id", "class_id", "n_links")
