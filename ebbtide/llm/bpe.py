"""Byte-pair encoding and decoding of whole texts with reuse of content-defined chunks.

A rolling hash over the bytes of a text cuts it into chunks, so equal passages of different documents fall into equal chunks.
Chunks are counted by their digest first. A chunk that is met twice or more is encoded once for the whole table and its ids go
once to every task that puts documents with it together; the stretches between such chunks travel compressed and are encoded
there. Documents whose least shared chunk is the same, copies above all, go to the same task, or to as many as their bytes fill, so
few tasks ask for a chunk. A document without shared chunks is encoded where it is read, so its text crosses no shuffle. Which
chunks may be shared is asked of a Bloom filter of bounded size: a false alarm only sends a chunk the longer way.

The ids of the chunks of a document side by side are wrong around the joins, where a cut went through a word. They are repaired by
re-encoding: whatever the ids are, a place between a visible character and ASCII white space is an edge of the pre-tokenizer,
in the chunk as in the whole text. From the last such edge before a join to the first after it the bytes are encoded
anew, the window growing until its two ends agree with token edges of the chunks at its sides; windows that meet are one. Outside the
windows the chunk's ids are those of the whole text, so the result is exactly what encoding the whole text gives.

A null text is an empty one, with no ids. The string of the special token gives its one id. Repeated rows are rows of their
own. Only the columns of `keep` are read and returned beside the ids; other columns, whatever their names, are left
alone. A kept column may not be called like the result (ValueError). An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ebbtide.llm.packing import encoding, vocabulary
from ebbtide.llm.text import mix, slices
from ebbtide.llm.workspace import Workspace, partitions

#: Bytes that the rolling hash sees, and chunk sizes: a cut at one place of 2 ** CUT_BITS, never below LEAST or above MOST bytes.
REACH, CUT_BITS, LEAST, MOST = 32, 9, 128, 8192
#: Bits of the filter of shared chunks: thirty-two for each, within these bounds, and four places looked at.
LEAST_BITS, MOST_BITS, PROBES = 1 << 20, 1 << 27, 4
SPECIAL = "<|endoftext|>"
#: Bytes of text, and tokens, that a task works on at a time, or one longer text.
AT_ONCE, TOKENS_AT_ONCE = 1 << 22, 1 << 20

_gear = mix(np.arange(1, 257, dtype=np.uint64))
_space = np.zeros(256, dtype=bool)
_space[[9, 10, 11, 12, 13, 32]] = True
#: White space outside ASCII in UTF-8; a place behind one of these is no certain edge.
WIDE_SPACE = re.compile(
    rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8f\xa8\xa9\xaf]|\xe2\x81[\x9f\xa0]|\xe3\x80\x80|\xef\xbb\xbf"
)


def cuts(data: bytes, edges: list[int]) -> list[list[int]]:
    """Per stretch of text, edges[i] to edges[i + 1], its ends and the places where it is cut between them.

    The stretches of many texts are hashed in one go. The hash of the last REACH bytes says where to cut, between characters and
    never nearer to the last cut than LEAST, so no hash that counts reaches into the stretch before; after MOST bytes a cut is forced.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    rolled, reach = _gear[raw], 1
    while reach < REACH:
        # The hash of twice as many bytes is that of the later half plus the earlier one's, shifted.
        rolled[reach:] = rolled[reach:] + (rolled[:-reach] << np.uint64(reach))
        reach *= 2
    whole = (raw & 0xC0) != 0x80
    chosen = np.flatnonzero((rolled[:-1] >> np.uint64(31)) % np.uint64(1 << CUT_BITS) == 0) + 1
    chosen = chosen[whole[chosen]]
    bounds = np.searchsorted(chosen, edges)
    places = chosen.tolist()
    out = []
    for start, end, low, high in zip(edges, edges[1:], bounds, bounds[1:]):
        found, last = [start], start
        for place in [*places[low:high], end]:
            while place - last > MOST:
                last += MOST
                while not whole[last]:
                    last -= 1
                found.append(last)
            if place - last >= LEAST and place < end:
                found.append(place)
                last = place
        out.append([*found, end])
    return out


def chunked(texts: list[str | None]) -> Iterator[list[bytes | None]]:
    """The chunks of each text; None stands for the special token."""
    for part in slices([len(t or "") for t in texts]):
        # One stretch more than special tokens in a text.
        stretches = [(t or "").encode("utf-8", "replace").split(SPECIAL.encode()) for t in texts[part]]
        flat = [s for own in stretches for s in own]
        data = b"".join(flat)
        found = iter(cuts(data, np.cumsum([0, *map(len, flat)]).tolist()) if data else [[0]] * len(flat))
        for own in stretches:
            out: list[bytes | None] = []
            for i in range(len(own)):
                if i:
                    out.append(None)
                places = next(found)
                out += [data[a:b] for a, b in zip(places, places[1:]) if a < b]
            yield out


def chunks(text: str) -> list[bytes | None]:
    return next(chunked([text]))


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def slot(name: bytes) -> int:
    """The signed 64-bit number by which a chunk is counted."""
    return int.from_bytes(name[:8], "little", signed=True)


class Coder:
    """Encodes bytes and repairs joins with one vocabulary."""

    def __init__(self, path: str | None = None):
        self.merges = encoding(path)
        self.special = self.merges.max_token_value + 1
        self.bytes_of = [self.merges.decode_single_token_bytes(i) for i in range(self.special)] + [SPECIAL.encode()]
        self.sizes = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.width = "<u2" if len(self.bytes_of) <= 1 << 16 else "<u4"

    def encode(self, data: bytes) -> np.ndarray:
        """The ids of a stretch of text; the string of the special token has its one id."""
        out: list[np.ndarray] = []
        for i, part in enumerate(data.split(SPECIAL.encode())):
            if i:
                out.append(np.array([self.special], dtype=np.uint32))
            out.append(self.merges.encode_to_numpy(part.decode("utf-8"), disallowed_special=()))
        return out[0] if len(out) == 1 else np.concatenate(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all tokens, gathered at once."""
        ids = np.asarray(ids, dtype=np.int64)
        sizes = self.sizes[ids]
        shift = self.begins[ids] - (np.cumsum(sizes) - sizes)
        return self.flat[np.repeat(shift, sizes) + np.arange(sizes.sum())].tobytes()

    def pack(self, ids: np.ndarray) -> bytes:
        return zstandard.compress(ids.astype(self.width).tobytes(), 1)

    def unpack(self, data: bytes) -> np.ndarray:
        return np.frombuffer(zstandard.decompress(data), dtype=self.width).astype(np.uint32)

    def joined(self, parts: list[np.ndarray]) -> np.ndarray:
        """The ids of the whole text from those of its chunks, in order."""
        parts = [p for p in parts if len(p)]
        if len(parts) < 2:
            return parts[0] if parts else np.zeros(0, dtype=np.uint32)
        ids = np.concatenate(parts).astype(np.uint32)
        data = self.decode(ids)
        ends = np.cumsum(self.sizes[ids])
        starts = np.concatenate(([0], ends))  # token i begins at starts[i]; the last entry is the end of the text
        joins = ends[np.cumsum([len(p) for p in parts[:-1]]) - 1]
        edges = certain_edges(data)
        edges = np.concatenate(([0], edges, [len(data)]))
        # An edge counts where a token of the chunk ends there too.
        at = np.searchsorted(starts, edges)
        edges = edges[starts[at] == edges]
        low = edges[np.searchsorted(edges, joins, side="right") - 1]
        high = edges[np.searchsorted(edges, joins, side="left")]
        windows: list[list[int]] = []
        for a, b in zip(low.tolist(), high.tolist()):
            if a == b:
                continue  # the cut was an edge itself
            if windows and a < windows[-1][1]:
                windows[-1][1] = max(b, windows[-1][1])
            else:
                windows.append([a, b])
        if not windows:
            return ids
        out, done = [], 0
        for a, b in windows:
            first, after = np.searchsorted(starts, [a, b])
            out += [ids[done:first], self.encode(data[a:b])]
            done = after
        return np.concatenate([*out, ids[done:]]).astype(np.uint32)

    def merged(self, parts: list[np.ndarray | None]) -> np.ndarray:
        """The same where None stands for a special token, across which nothing is joined."""
        out, run = [], []
        for part in [*parts, None]:
            if part is None:
                out += [self.joined(run), np.array([self.special], dtype=np.uint32)]
                run = []
            else:
                run.append(part)
        return np.concatenate(out[:-1])


def certain_edges(data: bytes) -> np.ndarray:
    """Places between a visible character and ASCII white space: every way of reading the text cuts there."""
    raw = np.frombuffer(data, dtype=np.uint8)
    space = _space[raw]
    visible = (raw > 32) & (raw != 127)
    for found in WIDE_SPACE.finditer(data):
        visible[found.end() - 1] = False
    return np.flatnonzero(space[1:] & visible[:-1]) + 1


def coder(path: str | None, made: dict) -> Coder:
    if path not in made:
        made[path] = Coder(path)
    return made[path]


def in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches with at most AT_ONCE bytes of text, so that a task's memory does not follow the rows of a batch."""
    for batch in batches:
        for part in slices(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist(), AT_ONCE):
            yield batch.slice(part.start, part.stop - part.start)


def counted(docs: DataFrame) -> DataFrame:
    """(slot, n): how often each chunk occurs; a batch adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            found = [slot(digest(c)) for parts in chunked(batch.column("text").to_pylist()) for c in parts if c]
            values, n = np.unique(np.array(found, dtype=np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n.astype(np.int64))], names=["slot", "n"])

    partial = docs.select("text").mapInArrow(run, "slot bigint, n bigint")
    return partial.groupBy("slot").agg(F.sum("n").alias("n"))


def bitmap(shared: DataFrame) -> np.ndarray:
    """PROBES bits for every shared chunk, in at least LEAST_BITS and at most MOST_BITS (16 MB) whatever the table is.

    With 32 bits a chunk or more, one chunk of 5,000 that nobody shares is a false alarm.
    """
    size = LEAST_BITS
    n = shared.count()
    while size < min(32 * n, MOST_BITS):
        size *= 2
    low = F.col("slot").bitwiseAND(0xFFFFFFFF)
    high = F.shiftrightunsigned("slot", 32).bitwiseOR(1)
    bits = shared.select(F.explode(F.array(*((low + i * high).bitwiseAND(size - 1) for i in range(PROBES)))).alias("bit"))
    bit = F.col("bit")
    words = bits.groupBy(F.shiftright(bit, 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.bitwiseAND(63).cast("int"))).alias("bits")
    )
    found = words.toArrow()
    out = np.zeros(size // 64, dtype=np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def is_set(bits: np.ndarray, number: int) -> bool:
    """Whether the chunk with this slot may be shared."""
    low, high, last = number & 0xFFFFFFFF, (number >> 32) & 0xFFFFFFFF | 1, 64 * len(bits) - 1
    for _ in range(PROBES):
        place = low & last
        if not int(bits[place >> 6]) >> (place & 63) & 1:
            return False
        low += high
    return True


def encoded(
    docs: DataFrame, path: str | None = None, keep: list[str] | None = None, into: str = "ids", back: str | None = None
) -> DataFrame:
    """The kept columns and the token ids (array of int) of every document's whole text.

    back: the name of a column with the text that `decoded` gives for these ids, which the task that has them decodes at once; so
    they need not go to a second Python worker.
    """
    spark = docs.sparkSession
    keep = ["doc_id"] if keep is None else keep
    for name in {into, back} & set(keep):
        raise ValueError(f"a kept column is called {name}")
    if into == back:
        raise ValueError(f"two columns would be called {into}")
    path = vocabulary(path)
    work = Workspace(spark, "bpe")
    rows = docs.select(F.struct(*keep).alias("kept"), F.coalesce("text", F.lit("")).alias("text"))
    kept = rows.schema["kept"].dataType.simpleString()
    shared = work.keep(counted(rows).where("n > 1").select("slot"))
    bits = bitmap(shared)
    # Written: its row numbers hold only as long as nobody computes them again.
    open_rows = _placed(work.keep(_pieces(rows, bits, kept)))
    whole = _alone(rows, bits, path, kept, back is not None)
    dealt = _encoded_once(rows, _wanted(open_rows), bits, path)
    out = whole.unionByName(_assembled(open_rows, dealt, path, kept, back is not None))
    return out.select("kept.*", F.col("ids").alias(into), *([F.col("text").alias(back)] if back else []))


def _may_be_shared(bits: np.ndarray, parts: list[bytes | None]) -> list[bytes | None]:
    """The digests of the chunks that may be shared, None for the others."""
    names = [digest(p) if p else None for p in parts]
    return [n if n and is_set(bits, slot(n)) else None for n in names]


def _alone(rows: DataFrame, bits: np.ndarray, path: str, kept: str, back: bool) -> DataFrame:
    """The ids of the documents that share no chunk, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict = {}
        for batch in in_parts(batches):
            use = coder(path, made)
            at, ids = [], []
            texts = batch.column("text").to_pylist()
            for i, parts in enumerate(chunked(texts)):
                if not any(_may_be_shared(bits, parts)):
                    at.append(i)
                    ids.append(use.encode(texts[i].encode("utf-8", "replace")))
            yield _ids_batch(use, batch, at, ids, back)

    return rows.mapInArrow(run, _ids_schema(kept, back))


def _ids_schema(kept: str, back: bool) -> str:
    return f"kept {kept}, ids array<int>" + (", text string" if back else "")


def _ids_batch(use: Coder, batch: pa.RecordBatch, at: list[int], ids: list[np.ndarray], back: bool) -> pa.RecordBatch:
    """The rows of a batch at some places with their ids and, if asked for, the text that these decode to."""
    offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    flat = np.concatenate([*ids, np.zeros(0, dtype=np.uint32)]).astype(np.int32)
    columns = {"kept": batch.column("kept").take(pa.array(at, pa.int32())), "ids": pa.ListArray.from_arrays(offsets, flat)}
    if back:
        columns["text"] = pa.array([use.decode(x).decode("utf-8", "replace") for x in ids], pa.string())
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _pieces(rows: DataFrame, bits: np.ndarray, kept: str) -> DataFrame:
    """The documents that may share chunks, a row each.

    names: the digests of the shared chunks side by side; turns: for each piece in order 0, a shared chunk, or the bytes of a
    stretch between; own: those stretches side by side, compressed. lead: the least slot of the shared chunks, size: all bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in in_parts(batches):
            out: list[list] = [[], [], [], [], [], [], []]
            for i, parts in enumerate(chunked(batch.column("text").to_pylist())):
                names = _may_be_shared(bits, parts)
                if not any(names):
                    continue
                number += 1
                size, turns, own = 0, [], []
                for part, name in zip(parts, names):
                    part = SPECIAL.encode() if part is None else part
                    size += len(part)
                    if name:
                        turns.append(0)
                        continue
                    if turns and turns[-1]:
                        turns[-1] += len(part)
                    else:
                        turns.append(len(part))
                    own.append(part)
                shared = [n for n in names if n]
                row = (
                    number,
                    min(map(slot, shared)),
                    size,
                    i,
                    b"".join(shared),
                    np.array(turns, dtype="<i8").tobytes(),
                    zstandard.compress(b"".join(own), 3) if own else b"",
                )
                for column, value in zip(out, row):
                    column.append(value)
            columns = [pa.array(x, pa.int64()) for x in out[:3]]
            columns += [batch.column("kept").take(pa.array(out[3], pa.int32()))]
            columns += [pa.array(x, pa.binary()) for x in out[4:]]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "lead", "size", "kept", "names", "turns", "own"])

    return rows.mapInArrow(
        run, f"row bigint, lead bigint, size bigint, kept {kept}, names binary, turns binary, own binary"
    )


def _placed(pieces: DataFrame) -> DataFrame:
    """The pieces with a salt, the number of the task that puts the document together.

    Documents with one lead go together unless their bytes are more than a task's share of all; then they are spread over as many
    tasks as shares. At most as many leads as tasks can have more than a share, which bounds what is broadcast.
    """
    n = partitions(pieces.sparkSession)
    total = pieces.agg(F.sum("size")).first()[0] or 1
    heavy = pieces.groupBy("lead").agg(F.sum("size").alias("bytes")).where(F.col("bytes") * n > total)
    heavy = heavy.select("lead", F.ceil(F.col("bytes") * n / total).alias("spread"))
    turn = F.pmod(F.xxhash64("row"), F.coalesce("spread", F.lit(1)))
    salt = F.pmod(F.xxhash64("lead", turn), F.lit(n)).cast("int")
    return pieces.join(F.broadcast(heavy), "lead", "left").select("kept", "names", "turns", "own", salt.alias("salt"))


def _wanted(pieces: DataFrame) -> DataFrame:
    """(digest, salt): which tasks need the ids of which shared chunks; a batch asks once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {
                (names[at : at + 16], salt)
                for names, salt in zip(batch.column("names").to_pylist(), batch.column("salt").to_pylist())
                for at in range(0, len(names), 16)
            }
            digests, salts = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests, pa.binary()), pa.array(salts, pa.int32())], names=["digest", "salt"]
            )

    return pieces.select("names", "salt").mapInArrow(run, "digest binary, salt int")


def _encoded_once(rows: DataFrame, places: DataFrame, bits: np.ndarray, path: str) -> DataFrame:
    """(digest, salt, ids): the ids of every chunk that may be shared, at the places (digest, salt) that want them.

    One copy of each text crosses the shuffle from a batch and meets the places of the chunk; the chunk is encoded once and its ids
    are dealt from there, once to each place however often that is asked for.
    """

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            found: dict[bytes, bytes] = {}
            for parts in chunked(batch.column("text").to_pylist()):
                found |= {name: part for name, part in zip(_may_be_shared(bits, parts), parts) if name}
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())],
                names=["digest", "chunk"],
            )

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict = {}
        last, ids, dealt = None, b"", None
        for batch in batches:
            use = coder(path, made)
            out: list[list] = [[], [], []]
            columns = [batch.column(c).to_pylist() for c in ("digest", "salt", "chunk")]
            for name, salt, chunk in zip(*columns):
                if name != last:
                    # Rows with the text come before the places.
                    last, ids, dealt = name, use.pack(use.encode(chunk)), None
                elif chunk is None and salt != dealt:
                    dealt = salt
                    for column, value in zip(out, (name, salt, ids)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.binary()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())],
                names=["digest", "salt", "ids"],
            )

    found = rows.select("text").mapInArrow(texts, "digest binary, chunk binary")
    found = found.select("digest", F.lit(-1).alias("salt"), "chunk")
    found = found.unionByName(places.select("digest", "salt", F.lit(None).cast("binary").alias("chunk")))
    found = found.repartition(partitions(rows.sparkSession), "digest").sortWithinPartitions("digest", "salt")
    return found.mapInArrow(once, "digest binary, salt int, ids binary")


def _assembled(pieces: DataFrame, dealt: DataFrame, path: str, kept: str, back: bool) -> DataFrame:
    """One row per document from its pieces, joins repaired.

    A task gets the ids of its chunks first, each once, and keeps them compressed: never more than the documents of the task hold.
    """
    n = partitions(pieces.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict = {}
        known: dict[bytes, bytes] = {}

        def whole(use: Coder, names: bytes, turns: bytes, own: bytes) -> np.ndarray:
            data, done, used = zstandard.decompress(own) if own else b"", 0, 0
            split: list[np.ndarray | None] = []
            for turn in np.frombuffer(turns, dtype="<i8").tolist():
                if turn:
                    part = use.encode(data[done : done + turn])
                    done += turn
                else:
                    part = use.unpack(known[names[used : used + 16]])
                    used += 16
                for k, stretch in enumerate(np.split(part, np.flatnonzero(part == use.special))):
                    if k:
                        split.append(None)
                        stretch = stretch[1:]
                    split.append(stretch)
            return use.merged(split)

        for batch in batches:
            use = coder(path, made)
            at, ids, held = [], [], 0
            columns = [batch.column(c).to_pylist() for c in ("names", "turns", "own")]
            for i, (names, turns, own) in enumerate(zip(*columns)):
                if turns is None:
                    known[names] = own
                    continue
                at.append(i)
                ids.append(whole(use, names, turns, own))
                held += len(ids[-1])
                if held > TOKENS_AT_ONCE:
                    yield _ids_batch(use, batch, at, ids, back)
                    at, ids, held = [], [], 0
            if at:
                yield _ids_batch(use, batch, at, ids, back)

    chunks_of = dealt.select(
        F.lit(None).cast(kept).alias("kept"),
        F.col("digest").alias("names"),
        F.lit(None).cast("binary").alias("turns"),
        F.col("ids").alias("own"),
        "salt",
    )
    both = chunks_of.unionByName(pieces).repartitionById(n, F.col("salt"))
    first = both.sortWithinPartitions(F.col("turns").isNotNull())
    return first.drop("salt").mapInArrow(run, _ids_schema(kept, back))


def decoded(
    df: DataFrame, path: str | None = None, keep: list[str] | None = None, ids: str = "ids", into: str = "text"
) -> DataFrame:
    """The kept columns and the text of the ids; bytes that are no UTF-8 become the replacement character. Null ids: an empty text."""
    keep = ["doc_id"] if keep is None else keep
    if into in keep:
        raise ValueError(f"a kept column is called {into}")
    path = vocabulary(path)
    rows = df.select(F.struct(*keep).alias("kept"), F.col(ids).alias("ids"))
    kept = rows.schema["kept"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict = {}
        for batch in batches:
            use = coder(path, made)
            sizes = pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_pylist()
            for part in slices(sizes, TOKENS_AT_ONCE):
                some = batch.slice(part.start, part.stop - part.start)
                column = some.column("ids")
                # A null list has no values of its own between its offsets.
                flat, ends = column.values.to_numpy(), column.offsets.to_numpy()
                texts = [use.decode(flat[a:b]).decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([some.column("kept"), pa.array(texts, pa.string())], names=["kept", "text"])

    return rows.mapInArrow(run, f"kept {kept}, text string").select("kept.*", F.col("text").alias(into))
