"""Near-duplicate vectors by spherical caps.

A vector is turned by a structured random rotation (signs and Hadamard steps) and cut into two blocks. Every block has a
book of random unit directions; a filter is one direction of each book, so two small books make millions of filters.
A vector joins all filters whose cap it lies in, found by list decoding: only directions that can reach the cap with
the best of the other book are paired. This is repeated with independent rotations and books, because a single code
leaves some vectors without a filter. Vectors that share a filter are compared by their exact cosine in double
precision.

The number of filters follows the number of rows, so that a filter holds a few unrelated vectors at any size. The cap is
set so that a vector lies in `caps` of them on average, or lower: so low that a pair at the threshold shares a filter in some
rotation with probability `recall`. That is found by drawing pairs at the threshold for the very size of the books, since
larger books need more filters a vector for the same recall. Most vectors that share a filter aren't alike; those that are
too far from all others by their components in one byte each, less all that rounding can do, go no further.

Null and zero vectors, and those with null or non-finite components, link with nothing and are their own components.
Vectors of other lengths never meet. Equal vectors are joined once, as one weighted vertex. Repeated rows are copies.
Columns beyond vec_id and embedding are left alone. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ebbtide.llm.buckets import link, plausible
from ebbtide.llm.graph import components
from ebbtide.llm.text import mix
from ebbtide.llm.workspace import Workspace

#: Books that a filter is made of, and independent rotations with books of their own.
BLOCKS, TURNS = 2, 8


def cap_height(dim: int, share: float) -> float:
    """The cosine that a random direction exceeds with probability `share`, for a uniform unit vector."""
    x = np.linspace(-1, 1, 200_001)
    density = np.maximum(1 - x * x, 0) ** max((dim - 3) / 2, 0)
    tail = np.cumsum(density[::-1])
    return float(x[::-1][np.searchsorted(tail, share * tail[-1])])


def padded(dim: int) -> int:
    """The length that a rotation gives vectors of length dim."""
    return max(BLOCKS, 1 << max(0, dim - 1).bit_length())


def random_books(draw: np.random.Generator, size: int, book: int) -> np.ndarray:
    books = draw.normal(size=(BLOCKS, book, size // BLOCKS))
    return books / np.linalg.norm(books, axis=2, keepdims=True).clip(1e-300)


def meeting_cap(size: int, book: int, threshold: float, recall: float, pairs: int = 4096, top: int = 128) -> float:
    """The cap at which a pair at the threshold shares a filter in one of the turns with probability `recall`.

    Of drawn pairs, each has a highest cap at which it shares a filter; only the `top` directions nearest to the pair are
    looked at in each book, which can only lower the cap. A margin covers the error of the draw.
    """
    draw = np.random.default_rng([6, size, book])
    missed = 0.95 * (1 - recall) ** (1 / TURNS)
    highest = []
    for _ in range(0, pairs, 256):
        books = random_books(draw, size, book)
        u, w = draw.normal(size=(2, 256, size))
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        w -= (w * u).sum(axis=1, keepdims=True) * u
        w /= np.linalg.norm(w, axis=1, keepdims=True).clip(1e-300)
        v = threshold * u + np.sqrt(max(0.0, 1 - threshold**2)) * w
        scores = []
        for x, y, own in zip(np.split(u, BLOCKS, axis=1), np.split(v, BLOCKS, axis=1), books):
            a, b = x @ own.T, y @ own.T
            near = np.argpartition(-(a + b), min(top, book) - 1, axis=1)[:, :top]
            scores.append([np.take_along_axis(z, near, axis=1) for z in (a, b)])
        (a, b), (c, d) = scores
        both = np.minimum(a[:, :, None] + c[:, None, :], b[:, :, None] + d[:, None, :])
        highest.append(both.max(axis=(1, 2)))
    return float(np.quantile(np.concatenate(highest), missed))


def heights(dims: list[int], book: int, caps: float, threshold: float, recall: float) -> dict[int, float]:
    """The cap for each padded length: that of `caps` filters a vector, or the lower one that the recall needs."""
    out = {}
    for size in {padded(d) for d in dims}:
        plain = cap_height(size, min(0.5, caps / TURNS / book**BLOCKS)) * np.sqrt(BLOCKS)
        out[size] = min(float(plain), meeting_cap(size, book, threshold, recall))
    return out


class Codes:
    """One rotation with its two books and cap, for vectors of one length."""

    def __init__(self, dim: int, book: int, cap: float, turn: int):
        draw = np.random.default_rng([5, dim, turn])
        self.size = padded(dim)
        self.signs = draw.choice([-1.0, 1.0], (3, self.size))
        self.books = random_books(draw, self.size, book)
        self.book = book
        self.cap = cap

    def rotate(self, x: np.ndarray) -> np.ndarray:
        y = np.zeros((len(x), self.size))
        y[:, : x.shape[1]] = x
        for signs in self.signs:
            y = y * signs
            step = 1
            while step < self.size:
                z = y.reshape(len(y), -1, 2, step)
                y = np.stack((z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]), axis=2).reshape(len(y), -1)
                step *= 2
            y /= np.sqrt(self.size)
        return y

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """The filters of every row: all whose direction is within the cap."""
        parts = self.rotate(x).reshape(len(x), BLOCKS, -1)
        left, right = (parts[:, k] @ self.books[k].T for k in range(BLOCKS))
        out = []
        for a, b in zip(left, right):
            # Only directions that reach the cap with the best of the other book can be in a filter.
            near, far = np.flatnonzero(a >= self.cap - b.max()), np.flatnonzero(b >= self.cap - a.max())
            i, j = np.nonzero(a[near][:, None] + b[far] >= self.cap)
            out.append(near[i].astype(np.uint64) * np.uint64(self.book) + far[j].astype(np.uint64))
        return out


def unit(vectors: list) -> tuple[np.ndarray, list[np.ndarray]]:
    """(which vectors can link, those as unit vectors in double precision)."""
    good, out = [], []
    for i, v in enumerate(vectors):
        if v is None or not len(v) or any(x is None for x in v):
            continue
        x = np.array(v, dtype=np.float64)
        if np.isfinite(x).all() and x.any():
            x = x / np.abs(x).max()
            good.append(i)
            out.append(x / np.linalg.norm(x))
    return np.array(good, dtype=np.int64), out


def digests(vectors: DataFrame) -> DataFrame:
    """(vec_id, digest): equal vectors have equal digests; null where a vector can't link."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [None] * batch.num_rows
            listed = batch.column(1).to_pylist()
            for i in unit(listed)[0]:
                # Adding zero makes -0.0 and 0.0 one.
                raw = (np.array(listed[i], dtype=np.float64) + 0.0).tobytes()
                names[i] = hashlib.blake2b(raw, digest_size=16).hexdigest()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string())], names=["vec_id", "embedding", "digest"]
            )

    picked = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>"))
    return picked.mapInArrow(task, "vec_id bigint, embedding array<double>, digest string")


def filters(vertices: DataFrame, book: int, caps: dict[int, float]) -> DataFrame:
    """(bucket, id): every filter that a vector exceeds; caps by padded length."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[tuple[int, int], Codes] = {}
        for batch in batches:
            names = batch.column(0).to_numpy()
            _, rows = unit(batch.column(1).to_pylist())
            by_length: dict[int, list[int]] = {}
            for i, row in enumerate(rows):
                by_length.setdefault(len(row), []).append(i)
            for dim, at in by_length.items():
                for start in range(0, len(at), 1024):
                    some = at[start : start + 1024]
                    x = np.array([rows[i] for i in some])
                    for turn in range(TURNS):
                        code = codes.get((dim, turn)) or codes.setdefault((dim, turn), Codes(dim, book, caps[padded(dim)], turn))
                        found = code.decode(x)
                        salt = np.uint64((dim * TURNS + turn) * 0x9E3779B97F4A7C15 % (1 << 64))
                        bucket = mix(np.concatenate(found) + salt).view(np.int64)
                        who = np.repeat(names[some], [len(f) for f in found])
                        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(who)], names=["bucket", "id"])

    return vertices.select("id", "embedding").mapInArrow(task, "bucket bigint, id bigint")


def coarse(vertices: DataFrame) -> DataFrame:
    """(id, bytes): the components of the unit vector as 127ths, rounded."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, rows = unit(batch.column(1).to_pylist())
            near = pa.array([np.rint(127 * x).astype(np.int8) for x in rows], pa.list_(pa.int8()))
            yield pa.RecordBatch.from_arrays([batch.column(0), near], names=["id", "bytes"])

    # Every vertex has a unit vector, so rows and ids match.
    return vertices.select("id", "embedding").mapInArrow(task, "id bigint, bytes array<tinyint>")


def alike_bytes(threshold: float):
    """Whether vectors may reach the threshold, by their rounded components; no pair that does is left out."""

    def alike(a: list[tuple], b: list[tuple]) -> np.ndarray:
        x, y = (np.array([r[-1] for r in rows], dtype=np.float64) / 127 for rows in (a, b))
        off = 0.5 / 127 * np.sqrt(x.shape[1])
        return x @ y.T >= threshold - 2 * off - off * off - 1e-9

    return alike


def alike_vectors(threshold: float):
    def matrix(rows: list[tuple]) -> np.ndarray:
        x = np.array([r[-1] for r in rows], dtype=np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def alike(a: list[tuple], b: list[tuple]) -> np.ndarray:
        return matrix(a) @ matrix(b).T >= threshold

    return alike


def cap_join(
    vectors: DataFrame, threshold: float = 0.9, caps: float = 56.0, per_row: float = 16.0, recall: float = 0.9999
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding).

    caps: the filters that a vector joins on average at least; more find more pairs. per_row: filters for each vector.
    recall: the share of the pairs at the threshold that are found, whatever the number of rows.
    """
    work = Workspace(vectors.sparkSession, "caps")
    rows = work.keep(digests(vectors))
    vertices = work.keep(
        rows.where("digest IS NOT NULL")
        .groupBy("digest")
        .agg(F.count("*").alias("weight"), F.min("vec_id").alias("first"), F.any_value("embedding").alias("embedding"))
        .withColumn("id", F.monotonically_increasing_id())
    )
    book = max(8, round((per_row / TURNS * max(1, vertices.count())) ** (1 / BLOCKS)))
    # One length for each power of two.
    steps = F.ceil(F.log2(F.size("embedding").cast("double"))).cast("int")
    dims = [1 << r["k"] for r in vertices.select(steps.alias("k")).distinct().collect()]
    members = work.keep(filters(vertices, book, heights(dims, book, caps, threshold, recall)))
    members = work.keep(plausible(members, work.keep(coarse(vertices)), ["bytes"], alike_bytes(threshold)))
    found = work.keep(link(members, vertices.select("id", "weight", "embedding"), ["embedding"], alike_vectors(threshold)))
    roots = components(found.select(F.col("id").alias("u"), F.col("root").alias("v")), work)
    links = found.groupBy("id").agg(F.sum("n").alias("links"))
    classes = vertices.drop("embedding").join(links, "id", "left").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = classes.join(least, "root").select(
        "digest", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")
    )
    out = rows.select("vec_id", "digest").join(classes, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
