"""Toxicity by a convolutional text classifier in numpy.

Words are hashed into embeddings; filters of several widths run over the whole text, each keeps its largest response, and a
logistic layer turns the responses into a score. Long texts cost no more memory than a slice of words: maxima of
slices that overlap by the widest filter are the maxima of the whole.

Training takes every labelled row. Three quarters, by hash of the id, train the network; the rest calibrate it: one logistic map of
the logit for all texts, and for each language the threshold with the best F1 there, where 0.7 is kept if nothing is better. The
rows are dealt into parts by hash of the id. In an epoch each part trains from the common network, and the parts' networks are
averaged word by word by Spark; what comes to the driver is one network, however many rows there are. Sums of whole numbers make
the average the same for any partitions. Scores depend on the text alone.

A null text is an empty one; a text without words has the score of no response at all. Repeated rows score alike. Columns
beyond doc_id and text (and lang, for thresholds) are left alone; a null language has the threshold of all. Without labels,
or with one label only, the score is that label's share, 0 without any. An empty table gives no rows.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ebbtide.llm.text import PUNCTUATION, slices, word_hashes

#: Hashed words, size of an embedding, and filters for each width.
BUCKETS, SIZE, FILTERS, WIDTHS = 1 << 16, 12, 12, (1, 2, 3)
#: A word in fewer training texts is read as unknown; so is this share of the words of a batch, drawn anew each time.
SEEN, DROPPED = 4, 0.15
PAD = WIDTHS[-1] - 1


@dataclass
class Model:
    embedding: np.ndarray
    kernels: list[np.ndarray]
    biases: list[np.ndarray]
    output: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    constant: float | None = None
    #: Response of a filter at a word, per place within the filter; made on first use.
    tables: list[list[np.ndarray]] | None = None

    @classmethod
    def fresh(cls, seed: int = 13) -> Model:
        draw = np.random.default_rng(seed)
        embedding = draw.normal(0, 0.1, (BUCKETS + 1, SIZE)).astype(np.float32)
        embedding[BUCKETS] = 0
        kernels = [draw.normal(0, 1 / np.sqrt(w * SIZE), (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
        biases = [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS]
        output = draw.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        return cls(embedding, kernels, biases, output, 0.0)

    def responses(self, words: np.ndarray) -> np.ndarray:
        """The largest response of every filter to one text, at least zero."""
        if self.tables is None:
            self.tables = [[self.embedding @ k[j] for j in range(w)] for w, k in zip(WIDTHS, self.kernels)]
        out = np.zeros(FILTERS * len(WIDTHS), dtype=np.float32)
        words = np.concatenate((words, np.full(PAD, BUCKETS, dtype=np.int64)))
        for start in range(0, max(0, len(words) - PAD), 50_000):
            part = words[start : start + 50_000 + PAD]
            for n, w in enumerate(WIDTHS):
                total = sum(t[part[j : len(part) - PAD + j]] for j, t in enumerate(self.tables[n]))
                at = slice(n * FILTERS, (n + 1) * FILTERS)
                out[at] = np.maximum(out[at], total.max(axis=0) + self.biases[n])
        return out

    def logit(self, words: np.ndarray) -> float:
        return float(self.responses(words) @ self.output + self.bias)

    def score(self, logits: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(logits), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -60, 60)))

    def rejects(self, lang: Column | None, score: Column) -> Column:
        """Whether a score reaches the threshold of its language."""
        least = F.lit(self.thresholds.get("", 0.7))
        for name, value in self.thresholds.items():
            if name and lang is not None:
                least = F.when(lang == name, F.lit(value)).otherwise(least)
        return score >= least


def words_of(texts: list[str]) -> list[np.ndarray]:
    """The bucket of every word of every text."""
    hashes, offsets = word_hashes(texts, PUNCTUATION)
    buckets = (hashes >> np.uint64(20)).astype(np.int64) % BUCKETS
    return [buckets[a:b] for a, b in zip(offsets, offsets[1:])]


def bounded(column: pa.Array) -> Iterator[list[np.ndarray]]:
    """The words of the texts of a column (null: none), a bounded stretch of texts at a time: hashing takes many times their size."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for part in slices(sizes):
        yield words_of([t or "" for t in column[part].to_pylist()])


def _batch(model: Model, texts: list[np.ndarray]):
    """(largest responses, where they are) of a batch of texts of any lengths."""
    pads = np.full(PAD, BUCKETS, dtype=np.int64)
    words = np.concatenate([x for t in texts for x in (t, pads)] + [pads])
    ends = np.cumsum([len(t) + PAD for t in texts])
    starts = np.concatenate(([0], ends[:-1]))
    vectors = model.embedding[words]
    n = len(words) - PAD
    tops, places = [], []
    for w, kernel, bias in zip(WIDTHS, model.kernels, model.biases):
        total = sum(vectors[j : n + j] @ kernel[j] for j in range(w)) + bias
        at = np.array([a + total[a : max(b - PAD, a + 1)].argmax(axis=0) for a, b in zip(starts, ends)])
        tops.append(np.maximum(total[at, np.arange(FILTERS)], 0))
        places.append(at)
    return words, np.concatenate(tops, axis=1), places


#: Epochs, rows of a part, and words that a task has in memory at a time.
EPOCHS, PART_ROWS, MOST_WORDS = 6, 8_000, 2_000_000
#: Whole units of the averaged numbers.
UNIT = 1 << 24


def begun(counts: np.ndarray, share: float) -> tuple[Model, list[np.ndarray], np.ndarray]:
    """(network, squares of Adagrad, words too rare to tell) from the texts of either label that hold each word."""
    model = Model.fresh()
    # The first number of a word starts at how far its toxic texts exceed chance, in deviations, so the filters need
    # not find the telling words by luck.
    model.embedding[:, 0], rare = _excess(counts, share)
    model.embedding[rare] = 0
    # The output's bias is an array here, to be stepped like the rest.
    memory = [np.full_like(x, 1e-4) for x in (model.embedding, *model.kernels, *model.biases, model.output)]
    return model, [*memory, np.array([1e-6], dtype=np.float32)], rare


def epoch(
    model: Model,
    memory: list[np.ndarray],
    rare: np.ndarray,
    texts: list[np.ndarray],
    labels: np.ndarray,
    draw: np.random.Generator,
    rate: float = 0.05,
    size: int = 32,
) -> np.ndarray:
    """Adagrad on the logistic loss, once over the texts; only the words at the largest responses get gradients. The words changed."""
    rest = 1 + 2 * len(WIDTHS)
    changed = []

    def step(value: np.ndarray, square: np.ndarray, slope: np.ndarray) -> None:
        square += slope * slope
        value -= rate * slope / np.sqrt(square)

    # Texts of like length share a batch, batches come in random order.
    order = np.argsort([len(t) + draw.random() * 50 for t in texts])
    groups, words = [], 0
    for i in order:
        # A batch of long texts is cut short, to bound its memory.
        if not groups or len(groups[-1]) == size or words + len(texts[i]) > 100_000:
            groups.append([])
            words = 0
        groups[-1].append(i)
        words += len(texts[i])
    for g in draw.permutation(len(groups)):
        at = np.array(groups[g])
        some = [np.where(draw.random(len(texts[i])) < DROPPED, np.int64(BUCKETS), texts[i]) for i in at]
        words, top, places = _batch(model, [_peaks(model, t) for t in some])
        wrong = 1 / (1 + np.exp(-(top @ model.output + model.bias))) - labels[at]
        wrong = (wrong / len(at)).astype(np.float32)
        back = wrong[:, None] * model.output[None, :] * (top > 0)
        step(model.output, memory[rest], top.T @ wrong)
        memory[-1] += float(wrong.sum()) ** 2
        model.bias -= rate * float(wrong.sum()) / np.sqrt(float(memory[-1][0]))
        names, slopes = [], []
        for n, w in enumerate(WIDTHS):
            part = back[:, n * FILTERS : (n + 1) * FILTERS]
            slope = np.zeros_like(model.kernels[n])
            for j in range(w):
                seen = words[places[n] + j]
                vectors = model.embedding[seen]
                slope[j] = np.einsum("bf,bfd->df", part, vectors)
                names.append(seen.ravel())
                slopes.append((part[:, :, None] * model.kernels[n][j].T[None]).reshape(-1, SIZE))
            step(model.biases[n], memory[1 + len(WIDTHS) + n], part.sum(axis=0))
            step(model.kernels[n], memory[1 + n], slope)
        names, inverse = np.unique(np.concatenate(names), return_inverse=True)
        total = np.zeros((len(names), SIZE), dtype=np.float32)
        np.add.at(total, inverse, np.concatenate(slopes))
        total[rare[names]] = 0
        changed.append(names)
        memory[0][names] += total * total
        model.embedding[names] -= rate * total / np.sqrt(memory[0][names])
    return np.unique(np.concatenate(changed)) if changed else np.zeros(0, dtype=np.int64)


def _peaks(model: Model, words: np.ndarray, most: int = 50_000) -> np.ndarray:
    """A long text cut down to the words at the largest response of each filter, in slices; others as they are."""
    if len(words) <= 2 * most:
        return words
    gap, found = np.full(PAD, BUCKETS, dtype=np.int64), []
    for start in range(0, len(words), most):
        seen, _, places = _batch(model, [words[start : start + most + PAD]])
        # A run of the widest filter at each peak, apart from the next.
        found += [np.concatenate((seen[at : at + PAD + 1], gap)) for at in np.unique(np.concatenate(places))]
    return np.concatenate(found)


def _excess(counts: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """(excess of toxic texts of each word, which words are too rare to tell)."""
    both = counts.sum(axis=0)
    chance = both * share
    rare = both < SEEN
    rare[BUCKETS] = True
    return np.clip((counts[1] - chance) / np.sqrt(chance + 1) / 8, -1, 2), rare


#: Toxic calibration rows that a language needs for a threshold of its own.
SUPPORT = 10


def calibrate(
    model: Model, logits: np.ndarray, labels: np.ndarray, langs: list[str | None], odds: float = 1.0, counts: np.ndarray | None = None
) -> None:
    """A logistic map by Newton steps with a small ridge, then a threshold for each language and for all.

    counts: the rows that each logit stands for, one by default; odds: the odds of toxic among all labelled texts, over those of the sample. F1 counts each row for as many as it stands
    for. A language with fewer than SUPPORT toxic rows has the threshold of all.
    """
    a, b = 1.0, 0.0
    n = np.ones(len(logits)) if counts is None else counts
    x = np.clip(logits, -30, 30)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -60, 60)))
        w = n * (p * (1 - p) + 1e-6)
        slope = np.array([(n * (p - labels) * x).sum() + 0.01 * (a - 1), (n * (p - labels)).sum() + 0.01 * b])
        curve = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        move = np.linalg.solve(curve, slope)
        move *= min(1.0, 2.0 / max(np.abs(move).max(), 1e-9))
        a, b = a - move[0], b - move[1]
    model.scale, model.shift = float(max(a, 0.05)), float(b + np.log(odds))
    score = model.score(logits)
    for name in ["", *sorted({x for x in langs if x})]:
        mine = np.array([not name or x == name for x in langs])
        s, y, k = score[mine], labels[mine], n[mine]
        toxic = k[y == 1].sum()
        if name and toxic < SUPPORT:
            model.thresholds[name] = model.thresholds[""]
            continue
        stands = k * np.where(y == 1, 1.0, 1 / odds)
        best, least = -1.0, 0.7
        for t in sorted(np.linspace(0.05, 0.95, 91).round(2), key=lambda t: abs(t - 0.7)):
            hit = (s >= t) & (y == 1)
            f1 = 2 * k[hit].sum() / max(1e-300, stands[s >= t].sum() + toxic)
            if f1 > best + 1e-9:
                best, least = f1, float(t)
        model.thresholds[name] = least


def hashed(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, toxic, lang, words) of the documents in known (doc_id, toxic): a row an id, that whose words hash lowest."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", lang.alias("lang"), F.coalesce("text", F.lit("")).alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.astype("<u2").tobytes() for part in bounded(batch.column(2)) for x in part]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.binary())], names=["doc_id", "lang", "words"])

    # Words are a third of their texts, so they are hashed before they are shuffled.
    rows = texts.mapInArrow(task, "doc_id bigint, lang string, words binary").join(known, "doc_id")
    first = F.min(F.struct(F.xxhash64("words").alias("hash"), "words", "lang", "toxic")).alias("row")
    return rows.groupBy("doc_id").agg(first).select("doc_id", "row.toxic", "row.lang", "row.words")


def sampled(docs: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """`hashed` of `most` toxic ids and twice as many others, by hash, for trials; `learned` takes all."""
    rank = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = known.where("toxic = 1").orderBy(*rank).limit(most).union(known.where("toxic = 0").orderBy(*rank).limit(2 * most))
    return hashed(docs, some)


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from all documents in labels (doc_id, toxic). Of several labels for one doc_id the larger counts, of several texts one."""
    known = labels.where("toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(4)) == 3
    parts = max(1, -(-known.count() // PART_ROWS))
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(parts)).cast("int")
    # Dealt and put in order once: a filter keeps both.
    rows = hashed(docs, known).select("doc_id", "toxic", "lang", "words", held.alias("held"), part.alias("part"))
    rows = rows.repartition(parts, "part").sortWithinPartitions("part", F.xxhash64("doc_id"), "doc_id").persist(StorageLevel.DISK_ONLY)
    sizes = {(r["toxic"], r["held"]): r["n"] for r in rows.groupBy("toxic", "held").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    share = sum(n for (y, _), n in sizes.items() if y == 1) / total if total else 0.0
    if share in (0.0, 1.0):
        rows.unpersist()
        model = Model.fresh()
        model.constant = share
        return model
    apart = len(sizes) == 4
    used = rows.where("NOT held") if apart else rows
    n = sum(n for (_, h), n in sizes.items() if not (apart and h))
    model = trained(used, sum(m for (y, h), m in sizes.items() if y == 1 and not (apart and h)) / n)

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.logit(np.frombuffer(w, dtype="<u2").astype(np.int64)) for w in batch.column(2).to_pylist()]
            place = np.rint(np.clip(np.array(found, dtype=np.float64).reshape(-1), -30, 30) * 256).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(place)], names=["toxic", "lang", "place"])

    # All rows in counts: at most 15,361 places a label and language.
    tested = (rows.where("held") if apart else rows).select("toxic", "lang", "words").mapInArrow(logits, "toxic int, lang string, place int")
    found = tested.groupBy("toxic", "lang", "place").agg(F.count("*").alias("n")).orderBy("place", "toxic", "lang").toArrow()
    rows.unpersist()
    places, marks, counts = (found.column(k).to_numpy().astype(np.float64) for k in ("place", "toxic", "n"))
    calibrate(model, places / 256, marks, found.column("lang").to_pylist(), counts=counts)
    return model


def _flat(model: Model, memory: list[np.ndarray]) -> np.ndarray:
    """What is averaged besides the words: numbers and squares, in rows as wide as a word and its squares."""
    bias = np.array([model.bias])
    every = np.concatenate([x.ravel() for x in (*model.kernels, *model.biases, model.output, bias, *memory[1:])])
    return np.append(every, np.zeros(-len(every) % (2 * SIZE))).reshape(-1, 2 * SIZE)


def _unflat(model: Model, memory: list[np.ndarray], rows: np.ndarray) -> None:
    rest = rows.ravel()
    for x in (*model.kernels, *model.biases, model.output):
        x[...], rest = rest[: x.size].reshape(x.shape), rest[x.size :]
    model.bias, rest = float(rest[0]), rest[1:]
    for x in memory[1:]:
        x[...], rest = rest[: x.size].reshape(x.shape), rest[x.size :]


def trained(rows: DataFrame, share: float) -> Model:
    """A network from all rows (part, toxic, words), in order of their parts, the given share toxic."""

    def words(column: pa.Array) -> list[np.ndarray]:
        return [np.frombuffer(w, dtype="<u2").astype(np.int64) for w in column.to_pylist()]

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS + 1), dtype=np.int64)
        for batch in batches:
            for t, y in zip(words(batch.column(1)), batch.column(0).to_pylist()):
                counts[y, np.unique(t)] += 1
        y, word = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(word), pa.array(counts[y, word])], names=["toxic", "word", "n"])

    counts = np.zeros((2, BUCKETS + 1))
    held = rows.select("toxic", "words").mapInArrow(holders, "toxic bigint, word bigint, n bigint")
    # As Arrow columns: a Python object for each of 131,072 counts takes the driver many times their size.
    found = held.groupBy("toxic", "word").agg(F.sum("n").alias("n")).toArrow()
    counts[found.column("toxic").to_numpy(), found.column("word").to_numpy()] = found.column("n").to_numpy()
    model, memory, rare = begun(counts, share)

    dealt = rows.select("part", "toxic", "words")
    columns = [f"c{i}" for i in range(2 * SIZE)]
    for turn in range(EPOCHS):
        start = (model, memory, rare)

        def task(batches: Iterator[pa.RecordBatch], start: tuple = start, turn: int = turn) -> Iterator[pa.RecordBatch]:
            def result() -> pa.RecordBatch:
                names = np.flatnonzero(changed)
                table = np.concatenate((np.concatenate((model.embedding[names], memory[0][names]), axis=1), _flat(model, memory)))
                names = np.concatenate((names, BUCKETS + 1 + np.arange(len(table) - len(names))))
                units = np.rint(table.astype(np.float64) * UNIT).astype(np.int64)
                return pa.RecordBatch.from_arrays([pa.array(names), *[pa.array(c) for c in units.T]], names=["name", *columns])

            def train() -> None:
                if texts:
                    changed[epoch(model, memory, rare, texts, np.array(marks, dtype=np.float32), draw)] = True
                texts.clear(), marks.clear()

            now, held, texts, marks = None, 0, [], []
            for batch in batches:
                for number, y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), words(batch.column(2))):
                    if number != now or held + len(t) > MOST_WORDS:
                        train()
                        held = 0
                    if number != now:
                        if now is not None:
                            yield result()
                        now, (model, memory, rare) = number, copy.deepcopy(start)
                        changed, draw = np.zeros(BUCKETS + 1, dtype=bool), np.random.default_rng([19, turn, number])
                    texts.append(t)
                    marks.append(y)
                    held += len(t)
            if now is not None:
                train()
                yield result()

        each = dealt.mapInArrow(task, "name bigint, " + ", ".join(f"{c} bigint" for c in columns))
        # A word is averaged over the parts that changed it.
        mean = each.groupBy("name").agg(*[(F.sum(c) / F.count("*") / UNIT).alias(c) for c in columns]).toArrow()
        names = mean.column("name").to_numpy()
        table = np.stack([mean.column(c).to_numpy() for c in columns], axis=1)[np.argsort(names)]
        names = np.sort(names)
        at = names <= BUCKETS
        model.embedding[names[at]], memory[0][names[at]] = table[at, :SIZE], np.maximum(table[at, SIZE:], 1e-4)
        _unflat(model, memory, table[~at])
        memory[1:] = [np.maximum(x, 1e-6) for x in memory[1:]]
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column toxicity; every other column stays as it is."""
    names = docs.columns
    at = names.index("text")
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logits = np.array([model.logit(w) for part in bounded(batch.column(at)) for w in part])
            score = pa.array(model.score(logits.reshape(-1)), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, score], names=[*names, "toxicity"])

    schema = T.StructType([*docs.schema.fields, T.StructField("toxicity", T.DoubleType())])
    return docs.mapInArrow(task, schema)
