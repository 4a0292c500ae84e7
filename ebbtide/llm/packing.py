"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents are cut into pieces of at most `capacity` tokens; full pieces are sequences of their own. The others are dealt
into blocks of bounded size. Several islands evolve packings of each block: crossover injects whole well-filled
bins of one parent into the other, drops the bins that hold the same documents twice, and puts the displaced
documents back by best fit. Between epochs the best packing of every island moves to the next island of its block. Bins of the
best packing that are not filled well enough are dissolved, and their documents go to the next round of fewer blocks,
so the loss at block borders fades.

A null text is an empty one: just the end token. Repeated rows are packed each on its own. Columns beyond doc_id and text
are left alone. An empty table gives no rows.
"""

from __future__ import annotations

import json
import random
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ebbtide.llm.workspace import Workspace, partitions

#: Pieces of a block, islands of a block, epochs, packings of an island, and crossings in an epoch.
BLOCK, ISLANDS, EPOCHS, POPULATION, CROSSINGS = 8192, 2, 2, 4, 12
#: Bins filled less are dissolved between rounds; rounds at most.
FULL, ROUNDS = 0.999, 4
END = 2


def vocabulary(path: str | None) -> str:
    import public_tokenizers

    return path or public_tokenizers.path("byte_bpe_50k.json")


def encoding(path: str | None = None):
    """The merges of a byte-level tokenizer file in tiktoken, which gives the same ids several times faster."""
    import public_tokenizers
    import tiktoken
    import tiktoken.registry

    path = vocabulary(path)
    known = tiktoken.registry.ENCODINGS
    if path not in known:
        with open(path, encoding="utf-8") as file:
            listed = json.load(file)["model"]["vocab"]
        # Byte-level files write a byte that can't be printed as the next free character from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        special = "<|endoftext|>"
        ranks = {bytes(letters[c] for c in token): rank for token, rank in listed.items() if token != special}
        known[path] = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return known[path]


def encoder(path: str | None = None):
    """text -> ids, as the tokenizers library gives them for the file without added special tokens."""
    fast, slow = encoding(path), []

    def encode(text: str) -> np.ndarray:
        if "<|endoftext|>" in text:
            # Only the library itself reads this string as one token.
            if not slow:
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_file(vocabulary(path)))
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return fast.encode_to_numpy(text, disallowed_special=())

    return encode


PIECES = "uid bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, capacity: int = 1024, path: str | None = None) -> DataFrame:
    """The pieces of every document; the first may be shorter, all others of a cut document are full.

    uid is unique but differs from run to run; read it from a written table.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 36
        encode = encoder(path)
        for batch in batches:
            rows = []
            for who, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py()), np.uint32(END)).astype("<u4")
                start = 0
                for number, stop in enumerate(range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)):
                    rows.append((uid, who, number, start, stop - start, zlib.crc32(ids[start:stop].tobytes())))
                    start, uid = stop, uid + 1
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = zip(*rows) if rows else [()] * 6
            names = [f.split(" ")[0] for f in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    picked = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    return picked.mapInArrow(task, PIECES)


class Packing:
    """Bins of item numbers; every item is in one bin."""

    def __init__(self, sizes: list[int], capacity: int, bins: list[list[int]] | None = None):
        self.sizes, self.capacity = sizes, capacity
        self.bins = bins or []
        self.loads = [sum(sizes[i] for i in b) for b in self.bins]

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then fuller ones: many full bins and few poor ones are easier to improve."""
        return -len(self.bins), sum((x / self.capacity) ** 2 for x in self.loads)

    def best_fit(self, items: list[int]) -> None:
        """Put items, in the order given, where they leave the least room."""
        rooms = sorted((self.capacity - x, b) for b, x in enumerate(self.loads))
        for i in items:
            size = self.sizes[i]
            at = bisect_left(rooms, (size, -1))
            if at == len(rooms):
                room, b = self.capacity, len(self.bins)
                self.bins.append([])
                self.loads.append(0)
            else:
                room, b = rooms.pop(at)
            self.bins[b].append(i)
            self.loads[b] += size
            if room > size:
                insort(rooms, (room - size, b))

    def cross(self, other: Packing, draw: random.Random) -> Packing:
        """A child: whole well-filled bins of other among those of self, displaced items by best fit."""
        share = draw.uniform(0.1, 0.5)
        ranked = sorted(range(len(other.bins)), key=lambda b: (-other.loads[b], draw.random()))
        chosen = [other.bins[b] for b in ranked[: max(1, int(len(ranked) * share))]]
        taken = {i for b in chosen for i in b}
        kept, displaced = [list(b) for b in chosen], []
        for b in self.bins:
            if taken.isdisjoint(b):
                kept.append(list(b))
            else:
                displaced += [i for i in b if i not in taken]
        # Some of the worst bins are opened too, so that their items can move.
        child = Packing(self.sizes, self.capacity, kept)
        worst = sorted(range(len(kept)), key=lambda b: child.loads[b])[: 1 + len(kept) // 50]
        for b in sorted(worst, reverse=True):
            displaced += child.bins.pop(b)
            child.loads.pop(b)
        displaced.sort(key=lambda i: (-self.sizes[i], draw.random()))
        child.best_fit(displaced)
        return child

    def flat(self) -> list[int]:
        out = [0] * len(self.sizes)
        for b, items in enumerate(self.bins):
            for i in items:
                out[i] = b
        return out

    @classmethod
    def read(cls, sizes: list[int], capacity: int, flat: list[int]) -> Packing:
        bins: list[list[int]] = [[] for _ in range(max(flat) + 1)]
        for i, b in enumerate(flat):
            bins[b].append(i)
        return cls(sizes, capacity, bins)


def evolve(sizes: list[int], capacity: int, population: list[list[int]], seed: int) -> list[list[int]]:
    """One epoch of an island, best packing first; an empty population is begun by best-fit decreasing with noise."""
    draw = random.Random(seed)
    herd = [Packing.read(sizes, capacity, flat) for flat in population]
    while len(herd) < POPULATION:
        noise = 0.0 if not herd else 0.05 * len(herd)
        fresh = Packing(sizes, capacity)
        fresh.best_fit(sorted(range(len(sizes)), key=lambda i: -sizes[i] * (1 + noise * draw.random())))
        herd.append(fresh)
    bound = -(-sum(sizes) // capacity)
    herd.sort(key=Packing.fitness, reverse=True)
    for _ in range(CROSSINGS):
        if len(herd[0].bins) == bound:
            break
        a, b = draw.sample(range(len(herd)), 2)
        herd.append(herd[min(a, b)].cross(herd[max(a, b)], draw))
        herd.sort(key=Packing.fitness, reverse=True)
        herd = herd[:POPULATION]
    return [p.flat() for p in herd[:POPULATION]]


ISLAND = "block bigint, island int, uids array<bigint>, sizes array<int>, population array<array<int>>"


def epoch(islands: DataFrame, capacity: int, number: int) -> DataFrame:
    """Evolve every island (a row of ISLAND)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, island, uids, sizes, population in zip(*(batch.column(i) for i in range(5))):
                listed = sizes.as_py()
                seed = hash((block.as_py(), island.as_py(), number))
                herd = evolve(listed, capacity, population.as_py(), seed)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block.as_py()], pa.int64()),
                        pa.array([island.as_py()], pa.int32()),
                        pa.array([uids.as_py()], pa.list_(pa.int64())),
                        pa.array([listed], pa.list_(pa.int32())),
                        pa.array([herd], pa.list_(pa.list_(pa.int32()))),
                    ],
                    names=["block", "island", "uids", "sizes", "population"],
                )

    n = partitions(islands.sparkSession)
    return islands.repartition(n, "block", "island").mapInArrow(task, ISLAND)


def pack(items: DataFrame, work: Workspace, capacity: int = 1024) -> DataFrame:
    """(uid, sequence_id, offset) of items (uid, length), all of at most `capacity` tokens."""
    done = []
    for round_ in range(ROUNDS):
        n = items.count()
        if not n:
            break
        blocks = -(-n // BLOCK)
        last = blocks == 1 or round_ == ROUNDS - 1
        # Blocks are dealt anew each round, by hashes that have nothing to do with the last round's.
        dealt = items.select("uid", F.col("length").cast("int").alias("length"), F.pmod(F.xxhash64(F.lit(round_), "uid"), F.lit(blocks)).alias("block"))
        grouped = dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("length", "uid")), False).alias("items"))
        islands = grouped.select(
            "block",
            F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"),
            F.col("items.uid").alias("uids"),
            F.col("items.length").alias("sizes"),
            F.array().cast("array<array<int>>").alias("population"),
        )
        for number in range(EPOCHS):
            islands = work.keep(epoch(islands, capacity, number))
            if number < EPOCHS - 1:
                elites = islands.select("block", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("population")[0].alias("elite"))
                # The newcomer takes the place of the worst.
                islands = islands.join(elites, ["block", "island"]).select(
                    "block", "island", "uids", "sizes", F.concat(F.slice("population", 1, POPULATION - 1), F.array("elite")).alias("population")
                )
        best = F.col("population")[0]
        rank = F.struct(F.array_max(best).alias("bins"), F.col("island").alias("island"))
        chosen = islands.groupBy("block").agg(F.min_by(F.struct("uids", "sizes", best.alias("bins")), rank).alias("best"))
        rows = chosen.select("block", F.explode(F.arrays_zip("best.uids", "best.sizes", "best.bins")).alias("row"))
        rows = rows.select("block", F.col("row.uids").alias("uid"), F.col("row.sizes").alias("length"), F.col("row.bins").alias("bin"))
        loads = rows.groupBy("block", "bin").agg(
            F.sum("length").alias("load"), F.sort_array(F.collect_list(F.struct("length", "uid")), False).alias("items")
        )
        loads = work.keep(loads)
        keep = F.lit(True) if last else F.col("load") >= FULL * capacity
        number = F.lit(round_ + 1).cast("bigint") * F.lit(1 << 52) + F.col("block") * F.lit(1 << 16) + F.col("bin")
        start = F.aggregate(F.slice("items", 1, F.col("at")), F.lit(0), lambda total, x: total + x["length"])
        full = loads.where(keep).select(number.alias("sequence_id"), "items", F.posexplode("items").alias("at", "item"))
        done.append(full.select("item.uid", "sequence_id", start.cast("bigint").alias("offset")))
        if last:
            break
        items = work.keep(loads.where(~keep).select(F.explode("items").alias("item")).select("item.uid", "item.length"))
    out = items.select("uid", F.lit(0).cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")).limit(0)
    for part in done:
        out = out.union(part)
    return out


def packed(docs: DataFrame, capacity: int = 1024, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of docs (doc_id, text)."""
    work = Workspace(docs.sparkSession, "packing")
    cut = work.keep(pieces(docs, capacity, path))
    whole = cut.where(F.col("length") == capacity)
    parts = cut.where(F.col("length") < capacity)
    # Numbers from 2 ** 60 on belong to full pieces.
    alone = whole.select(*whole.columns, (F.col("uid") + F.lit(1 << 60)).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    placed = parts.join(pack(parts.select("uid", "length"), work, capacity), "uid")
    return alone.union(placed.select(*alone.columns)).drop("uid")
