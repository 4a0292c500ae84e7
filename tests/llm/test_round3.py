"""BPE chunk reuse, importance resampling and the filter audit against plain versions and edge cases."""

import hashlib
import math
import random
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.llm import audit, bpe, queries, resample, toxicity

DOCS = "doc_id bigint, text string, source string"


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary(None))


def hard_texts(n=120):
    draw = random.Random(5)
    letters = [*"ab  \n\t\r'sretlmvd1 ,.é 　中  \x85😀x0\x7f​﻿", bpe.SPECIAL, "  \n\n", " 've"]
    texts = ["".join(draw.choice(letters) for _ in range(draw.choice([0, 1, 5, 300, 1500]))) for _ in range(n)]
    return texts + ["a" * 20_000, "中" * 9_000, " " * 9_000, "\n" * 5_000, "word " * 6_000, bpe.SPECIAL * 3]


def test_joined_chunks_are_the_ids_of_the_whole_text():
    use, plain = bpe.Coder(), library()
    for text in hard_texts():
        parts = bpe.chunks(text)
        assert b"".join(p or bpe.SPECIAL.encode() for p in parts).decode() == text
        ids = use.merged([p and use.encode(p) for p in parts]).tolist()
        assert ids == plain.encode(text, add_special_tokens=False).ids
        assert use.decode(ids).decode() == text


def test_chunks_are_cut_by_content():
    draw = random.Random(1)
    body = "".join(draw.choice("abcdefgh ") for _ in range(20_000))
    one, other = set(bpe.chunks("x" * 777 + body)), set(bpe.chunks("another start " + body))
    assert len(one & other) > 0.8 * len(one)
    assert max(map(len, one)) <= bpe.MOST and len(bpe.chunks("a" * 50_000)) > 5


def test_bpe_against_the_library(spark):
    plain = library()
    passage = "".join(random.Random(2).choices("abc def ghi\n", k=6_000))
    texts = [*hard_texts(30), None, "", passage, "Before. " + passage + " after.", passage, passage]
    rows = [(None if i == 3 else i % 30, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string").repartition(3)
    out = bpe.encoded(docs)
    found = sorted((r.doc_id is None, r.doc_id or 0, list(r.ids)) for r in out.collect())
    wanted = sorted((i is None, i or 0, plain.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows)
    assert found == wanted
    back = bpe.decoded(out, keep=["doc_id"]).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((i or 0, t or "") for i, t, _ in rows)
    with pytest.raises(ValueError):
        bpe.encoded(docs, keep=["doc_id", "ids"])
    assert bpe.encoded(docs, keep=["ids"], into="tokens").columns == ["ids", "tokens"]
    assert bpe.encoded(docs.where("false")).collect() == []
    both = bpe.encoded(docs, into="tokens", back="again").select("doc_id", "tokens", "again").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, list(r.tokens)) for r in both) == wanted
    assert sorted((r.doc_id or 0, r.again) for r in both) == sorted((i or 0, t or "") for i, t, _ in rows)
    with pytest.raises(ValueError):
        bpe.encoded(docs, back="ids")


def test_shared_chunks_are_encoded_once(spark):
    passage = "".join(random.Random(3).choices("abcdef ghi\n", k=8_000))
    docs = spark.createDataFrame([(i, f"{i} " + passage) for i in range(8)], "doc_id bigint, text string").repartition(4)
    counted = bpe.counted(docs)
    shared = counted.where("n > 1")
    bits, names = bpe.bitmap(shared.select("slot")), set()
    for row in docs.collect():
        names |= {d for d in bpe._may_be_shared(bits, bpe.chunks(row.text)) if d}
    places = spark.createDataFrame([(d, salt) for d in names for salt in (0, 1)], "digest binary, salt int")
    once = bpe._encoded_once(docs, places, bits, bpe.vocabulary(None)).collect()
    assert len(names) >= shared.count() > 5
    assert sorted((bytes(r.digest), r.salt) for r in once) == sorted((d, salt) for d in names for salt in (0, 1))


def test_op11_against_the_library(spark, sf):
    plain = library()
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    wanted = {}
    for r in rows:
        ids = plain.encode(r.text or "", add_special_tokens=False).ids
        text = plain.decode(ids, skip_special_tokens=False)
        wanted[r.doc_id] = (
            len(ids),
            hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(text.encode()).hexdigest(),
        )
    found = queries.op11_bpe(spark, sf).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found} == wanted and len(found) == len(rows)


def test_few_leads_share_a_task_and_a_busy_one_is_spread(spark):
    rows = [(i, 7 if i % 3 == 0 else i, 1000, (i,), b"", b"", b"") for i in range(3_000)]
    schema = "row bigint, lead bigint, size bigint, kept struct<doc_id: bigint>, names binary, turns binary, own binary"
    placed = bpe._placed(spark.createDataFrame(rows, schema)).select("kept.doc_id", "salt").collect()
    n = bpe.partitions(spark)
    assert len(placed) == 3_000 and {r.salt for r in placed} <= set(range(n))
    busy = [r.salt for r in placed if r.doc_id % 3 == 0]
    assert len(set(busy)) > 1 and max(map(busy.count, set(busy))) < len(busy)


def test_filter_of_shared_chunks_has_few_false_alarms(spark):
    slots = [bpe.slot(bpe.digest(str(i).encode())) for i in range(60_000)]
    bits = bpe.bitmap(spark.createDataFrame([(s,) for s in slots[:40_000]], "slot bigint"))
    assert all(bpe.is_set(bits, s) for s in slots[:40_000])
    assert sum(bpe.is_set(bits, s) for s in slots[40_000:]) < 40


# --- the toxicity sample


def test_toxicity_sample_has_a_row_an_id(spark):
    rows = [(i % 4, f"text number {i}", "en") for i in range(4_000)] + [(None, "none", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(5)
    known = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(None, 1)], "doc_id bigint, toxic int")
    found = toxicity.sampled(docs, known, most=30).collect()
    assert sorted(r.doc_id for r in found) == [0, 1, 2, 3] and all(r.toxic == r.doc_id % 2 for r in found)
    again = toxicity.sampled(docs.repartition(3), known, most=30).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))


def test_toxicity_trains_on_every_labelled_row(spark, monkeypatch):
    """20,000 toxic rows: the sample took 6,000 of a label. A word that a few rows hold is known, whichever rows they are."""
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    docs = spark.range(30_000).selectExpr(
        "id AS doc_id", "concat(if(id % 3 < 2, 'awful stuff ', 'kind stuff '), 'only', int(id / 4)) AS text", "'en' AS lang"
    )
    marks = docs.selectExpr("doc_id", "int(doc_id % 3 < 2) AS toxic")
    trained, seen = toxicity.trained, []

    def watched(rows, share):
        seen.append((rows.count(), round(share, 2)))
        return trained(rows, share)

    monkeypatch.setattr(toxicity, "trained", watched)
    model = toxicity.learned(docs, marks)
    assert 22_000 < seen[0][0] < 23_000 and seen[0][1] == 0.67
    scores = {r.doc_id: r.toxicity for r in toxicity.scored(docs.where("doc_id < 300"), model).collect()}
    assert all((scores[i] > 0.5) == (i % 3 < 2) for i in scores)
    # The calibration counts all held rows too: a map of the logit to the true share.
    assert abs(sum(scores.values()) / len(scores) - 2 / 3) < 0.05
    again = toxicity.learned(docs.repartition(7), marks)
    assert (again.embedding == model.embedding).all() and again.thresholds == model.thresholds and again.scale == model.scale


def test_toxicity_hashes_a_bounded_stretch_of_texts_at_a_time(spark, monkeypatch):
    """Training hashed all texts of a batch in one go, which took forty times their size: over a GB for 10,000 texts."""
    plain = toxicity.words_of

    def watched(texts):
        assert len(texts) == 1 or sum(len(t.encode()) for t in texts) <= 1 << 20
        return plain(texts)

    monkeypatch.setattr(toxicity, "words_of", watched)
    text = "CASE WHEN id % 7 = 0 THEN NULL WHEN id = 1 THEN repeat('a b ', 400000) ELSE repeat(concat('w', id, ' é '), 500) END"
    docs = spark.range(900).selectExpr("id AS doc_id", f"{text} AS text").coalesce(1)
    words = {r.doc_id: plain([r.text or ""])[0] for r in docs.collect()}
    found = toxicity.hashed(docs, docs.selectExpr("doc_id", "int(doc_id % 2) AS toxic")).collect()
    assert {r.doc_id: r.words for r in found} == {i: w.astype("<u2").tobytes() for i, w in words.items()}
    model = toxicity.Model.fresh()
    scores = {r.doc_id: r.toxicity for r in toxicity.scored(docs, model).select("doc_id", "toxicity").collect()}
    assert all(abs(scores[i] - model.score(np.array([model.logit(w)]))[0]) < 1e-9 for i, w in words.items())


def test_long_texts_are_cut_to_their_peaks():
    model = toxicity.Model.fresh()
    words = np.random.default_rng(5).integers(0, toxicity.BUCKETS, 120_000)
    short = toxicity._peaks(model, words, 5_000)
    assert len(short) < 10_000 and (toxicity._batch(model, [short])[1] == toxicity._batch(model, [words])[1]).all()


# --- resampling


def plain_words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        c = c.lower() if "A" <= c <= "Z" else c
        if c >= "\x80" or "0" <= c <= "9" or "a" <= c <= "z":
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def plain_features(text, n):
    words = plain_words(text)
    return [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def plain_resampled(rows, target, n, buckets, percent, least):
    def count(texts):
        total = [0] * buckets
        for text in texts:
            for f in plain_features(text, n):
                total[zlib.crc32(f.encode()) % buckets] += 1
        return total

    s, t = count(x for _, x in rows), count(target)
    gain = [
        math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets))))
        for b in range(buckets)
    ]
    out = []
    for doc_id, text in rows:
        found = plain_features(text, n)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found)
        name = "" if doc_id is None else doc_id
        h = int(hashlib.sha256(f"2024:{name}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(found), weight, score, None, len(plain_words(text))])
    eligible = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for rank, row in enumerate(eligible[: percent * len(eligible) // 100], 1):
        row[4] = rank
    return out


def key(row):
    return tuple((v is not None, v or 0) for v in row)


@pytest.mark.parametrize("n", [1, 3])
def test_resampling_against_a_plain_version(spark, n):
    draw = random.Random(7)
    known = [*"abcdefgh", "Straße", "ÉA", "x1", "中文"]
    rows = []
    for i in range(160):
        text = "".join(draw.choice(known) + draw.choice([" ", ", ", "\x00", "\n"]) for _ in range(draw.choice([0, 3, 6, 40])))
        rows.append((i, text))
    rows += [(None, "a b c a b"), (500, None), (501, ""), (502, "a " * 30_000)]
    rows += [(7, rows[7][1])] * 3 + [(900, "a b c d e a")] * 70
    target = ["a b c", None, "é a x1 a", ""]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("rank", F.lit("x")).repartition(3)
    docs = docs.withColumn("score", F.lit(1)).withColumn("buckets", F.lit(1)).withColumn("range_", F.lit(1))
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    found = resample.resampled(docs, goal, ngrams=n, buckets=97, percent=50, least=4)
    wanted = plain_resampled(rows, target, n, 97, 50, 4)
    assert sorted(map(key, found.collect())) == sorted(key(r[:5]) for r in wanted)


def test_resampling_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    none = docs.where("false")
    assert resample.resampled(none, docs).collect() == []
    found = resample.resampled(docs, none, least=1, percent=100).collect()
    assert {(r.doc_id, r.n_features, r.rank) for r in found} == {(1, 2, 1), (2, 0, None)}


def test_sequences_do_not_cross_documents():
    found, edges, words = resample.counter(1 << 20)(["a b", "c", "", "d e f"], 2)
    grams = [["a", "b", "a b"], ["c"], [], ["d", "e", "f", "d e", "e f"]]
    for i, wanted in enumerate(grams):
        assert sorted(found[edges[i] : edges[i + 1]]) == sorted(zlib.crc32(g.encode()) % (1 << 20) for g in wanted)
    assert list(words) == [2, 1, 0, 3]


# --- filter audit


def plain_audit(rows, labels):
    def words(text):
        return [w for w in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]

    failed = []
    for doc_id, text, _ in rows:
        text = text or ""
        w = words(text)
        copy = doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows)
        capitals = sum("A" <= c <= "Z" for c in text)
        checks = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * capitals > 2 * len(text), any(c in "#$%&*|" for c in text), copy)
        failed.append({x for x, bad in zip("ABCDE", checks) if bad})
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    out = {}
    for part in {s or "" for _, _, s in rows}:
        own = [(r[0], f) for r, f in zip(rows, failed) if (r[2] or "") == part]
        shares = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                here = [i for i, f in left if x in f]
                gone = len([1 for i, f in own if x in f]) - len(here)
                left = [(i, f) for i, f in left if x not in f]
                shares[x] += len(here)
                out[part, order, step] = [
                    len(left), len(here), gone, sum(f == {x} for _, f in own),
                    sum(i in good for i in here), sum(i in toxic for i in here),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shares[order[step - 1]])
    return out


def test_audit_against_a_plain_version(spark):
    draw = random.Random(11)
    long = " ".join(f"w{i}" for i in range(300))
    texts = [long, long + " A" * 20, "w " * 250, long + " #", "x", "", None, "\x0b \x0c", long + "\x1cA é" * 30, "UP " * 300]
    rows = [(i, draw.choice(texts), draw.choice(["a", "b", None, ""])) for i in range(60)]
    rows += [(None, long, "a"), (None, long, "b"), (3, rows[3][1], "b"), (3, rows[3][1], "b"), (70, "z " * 40_000, "c")]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in range(0, 60, 2)]
    labels += [(4, 1, 0), (None, 1, 1), (999, 1, 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("mask", F.lit(1)).withColumn("n", F.lit("x")).repartition(3)
    docs = docs.withColumn("digest", F.lit(0)).withColumn("good", F.lit(0)).withColumn("part", F.lit("q"))
    given = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    found = audit.audit(docs, given).collect()
    assert {(r.part, r.filter_order, r.step): list(r[3:]) for r in found} == plain_audit(rows, labels)
    assert len(found) == 600 * 4
    assert audit.audit(docs.where("false"), given).collect() == []
    assert audit.audit(docs, given.where("false")).agg(F.sum("good_lost")).first()[0] == 0


def test_audit_reads_texts_once_and_shuffles_none(spark, sf):
    docs = queries.table(spark, sf, "documents")
    plan = audit.masked(docs)._jdf.queryExecution().toString()
    assert "text" not in plan.split("== Physical Plan ==")[1]


# --- what the review asked of older operators


def mixture(spark, n, seed, shares):
    import numpy as np

    draw = np.random.default_rng(seed)
    p = draw.dirichlet([0.15 * len(shares) * s for s in shares], n)
    tokens = draw.integers(1, 400, n)
    rows = spark.createDataFrame([(int(t), [float(x) for x in row]) for t, row in zip(tokens, p)], "tokens bigint, p array<double>")
    return rows.repartition(3).persist(), tokens.astype(float), p


def test_mixing_reaches_a_far_target_with_held_rates(spark):
    import numpy as np

    from ebbtide.llm import mixing

    rows, tokens, p = mixture(spark, 3000, 4, [0.02, 0.4, 0.4, 0.18])
    targets = np.array([0.5, 0.3, 0.02, 0.18])
    found = mixing.fit(rows, targets)
    rate = np.maximum(0, 1 - p @ found.multipliers)
    sums = (p * (tokens * rate)[:, None]).sum(axis=0)
    assert (rate == 0).mean() > 0.1 and found.distance <= 1e-6
    assert np.abs(sums / tokens.sum() - targets).max() <= 1e-6
    # Rates of this form that meet the targets are the nearest to 1 that do (the conditions of a convex problem). Any other
    # rates that meet them are farther off.
    draw, cost = np.random.default_rng(1), (tokens * (rate - 1) ** 2).sum()
    a = (p * tokens[:, None]).T
    for _ in range(20):
        move = draw.normal(size=len(rate)) * (rate > 0)
        move -= (p * (rate > 0)[:, None]) @ np.linalg.pinv(a @ (p * (rate > 0)[:, None])) @ (a @ move)
        other = rate + move * (rate[rate > 0].min() / np.abs(move).max())
        assert other.min() >= 0 and np.abs(a @ (other - rate)).max() < 1e-6 * tokens.sum()
        assert (tokens * (other - 1) ** 2).sum() >= cost - 1e-9 * cost


def test_mixing_that_may_drop_nothing_finds_a_total(spark):
    import numpy as np

    from ebbtide.llm import mixing

    rows, tokens, p = mixture(spark, 2000, 5, [0.1, 0.5, 0.2, 0.2])
    targets = np.array([0.4, 0.2, 0.2, 0.2])
    found = mixing.fit(rows, targets, least=1.0)
    rate = np.maximum(1, 1 - p @ found.multipliers)
    sums = (p * (tokens * rate)[:, None]).sum(axis=0)
    assert found.distance <= 1e-6 and np.abs(sums / sums.sum() - targets).max() <= 1e-6


CLASHES = ["blob", "spans", "tokens", "p", "rate", "copies", "distance", "toxicity", "copy", "id", "check", "row", "words", "digest"]


def test_stages_leave_columns_with_their_own_names_alone(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.withColumns({name: F.concat(F.lit(name), F.col("doc_id").cast("string")) for name in CLASHES})
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, sf)
        assert out.columns == docs.columns
        wrong = F.lit(False)
        for c in CLASHES:
            wrong = wrong | (F.col(c) != F.concat(F.lit(c), F.col("doc_id").cast("string")))
        assert out.where(wrong).isEmpty() and not out.isEmpty(), name


def test_sieve_never_loses_a_match(spark):
    from ebbtide.llm.sieve import sieved

    wanted = spark.range(0, 5000, 7).select(F.xxhash64("id").alias("h"))
    rows = spark.range(5000).withColumn("__x", F.lit(1))
    out = sieved(rows, F.xxhash64("id"), wanted, "__may")
    assert out.where("id % 7 = 0 AND NOT __may").isEmpty() and out.count() == 5000
    assert out.where("__may").count() < 715 + 200
    assert sieved(rows, F.xxhash64("id"), wanted.where("false"), "__may").where("__may").isEmpty()
