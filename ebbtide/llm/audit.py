"""How document filters overlap: what each of them removes at each place of every order in which they can be applied.

Every document gets a mask of the filters that it fails. Documents are counted by part and mask, so at most 32 mask cells
stand for a part, whatever its size. Each cell folds across the literal array of orders (`transform` over the orders,
`aggregate` over the steps of one), which gives 600 structs weighted with the cell's counts; the cells of a part are merged by
elementwise sums. Texts cross no shuffle: only masks, ids and SHA-256 digests do.

A null text is an empty one, a null part an empty string. A null id is never a copy, makes no other row one and has no
label. Rows that repeat an id and its text are counted one by one; none of them has a smaller id, so they are copies only of rows that
have one. Of several labels for one id, any 1 counts. Columns beyond those named are not read. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

from ebbtide.llm.workspace import Workspace

#: The filters, in the order of their bits in a mask.
FILTERS = "ABCDE"
LEAST_WORDS, MOST_CAPITALS_PERCENT, LEAST_DISTINCT_PERCENT = 200, 2, 50
SPACES = " \t\n\x0b\f\r"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
STEP = "struct<" + ",".join(f"{name}:bigint" for name in COUNTS) + ">"
BITS = {letter: 1 << i for i, letter in enumerate(FILTERS)}
ORDERS = ["".join(order) for order in permutations(FILTERS)]


def own_mask(text: Column) -> Column:
    """The bits of the filters that look at one text alone (A to D)."""
    clean = F.btrim(text, F.lit(SPACES))
    words = F.split(clean, r"[\x20\x09-\x0D]+")
    # An empty text splits into one empty string.
    empty = (clean == "").cast("int")
    n, distinct = F.size(words) - empty, F.size(F.array_distinct(words)) - empty
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    failed = {
        "A": n < LEAST_WORDS,
        "B": 100 * distinct < LEAST_DISTINCT_PERCENT * n,
        "C": 100 * capitals > MOST_CAPITALS_PERCENT * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }
    return sum((F.when(fails, BITS[k]).otherwise(0) for k, fails in failed.items()), F.lit(0))


def masked(docs: DataFrame, part: str = "source") -> DataFrame:
    """(doc_id, part, mask, n): how many rows of an id have a mask."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        own_mask(text).alias("own"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    rows = rows.groupBy("digest", "doc_id", "part", "own").agg(F.count(F.lit(1)).alias("n"))
    rows = Workspace(docs.sparkSession, "audit").keep(rows)
    # Joined by digest and id, so the copies of one text are spread over all tasks.
    first = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    first = first.withColumn("first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    found = rows.join(first, ["digest", "doc_id"], "left")
    mask = F.col("own") + F.when(copy, BITS["E"]).otherwise(0)
    return found.groupBy("doc_id", "part", mask.alias("mask")).agg(F.sum("n").alias("n"))


def cells(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): rows, rows labelled good and rows labelled toxic of every mask cell."""
    of = labels.where(F.col("doc_id").isNotNull() & ((F.col("quality") == 1) | (F.col("toxic") == 1)))
    of = of.groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic"),
    )
    n = F.col("n")
    found = masked(docs, part).join(of, "doc_id", "left")
    return found.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        *(F.sum(F.coalesce(n * F.col(name), F.lit(0))).alias(name) for name in ("good", "toxic")),
    )


def folded(cell: Column, order: Column) -> Column:
    """What happens to a cell at each step of one order: an array of STEP."""

    def step(state: Column, bit: Column) -> Column:
        fails = cell["mask"].bitwiseAND(bit) != 0
        here = fails & ~state["gone"]

        def when(condition: Column, count: Column) -> Column:
            return F.when(condition, count).otherwise(F.lit(0).cast("bigint"))

        done = F.struct(
            when(~fails & ~state["gone"], cell["n"]).alias("kept"),
            when(here, cell["n"]).alias("removed"),
            when(fails & state["gone"], cell["n"]).alias("redundant"),
            when(cell["mask"] == bit, cell["n"]).alias("unique_fails"),
            when(here, cell["good"]).alias("good_lost"),
            when(here, cell["toxic"]).alias("toxic_lost"),
        )
        return F.struct(
            (state["gone"] | fails).alias("gone"), F.concat(state["steps"], F.array(done)).alias("steps")
        )

    start = F.struct(F.lit(False).alias("gone"), F.array().cast(f"array<{STEP}>").alias("steps"))
    return F.aggregate(order, start, step, lambda state: state["steps"])


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct(*((x[name] + y[name]).alias(name) for name in COUNTS)))


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """One row per part, order of the filters and step: rows kept, removed, redundant, failing this filter only, labelled rows
    lost here, and what the step's filter removes in all orders together."""
    bits = F.array(*(F.array(*(F.lit(BITS[letter]) for letter in order)) for order in ORDERS))
    names = F.array(*map(F.lit, ORDERS))
    zero = F.array_repeat(F.struct(*(F.lit(0).cast("bigint").alias(name) for name in COUNTS)), 5 * len(ORDERS))

    def fold(cell: Column) -> Column:
        return F.flatten(F.transform(bits, lambda order: folded(cell, order)))

    # At most 32 cells a part.
    grouped = cells(docs, labels, part).groupBy("part").agg(
        F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")
    )
    total = F.aggregate("cells", zero, lambda sums, cell: added(sums, fold(cell)))
    found = grouped.select("part", total.alias("steps")).select("part", F.posexplode("steps").alias("at", "did"))
    order = F.element_at(names, (F.col("at") / 5).cast("int") + 1)
    step = (F.col("at") % 5 + 1).cast("int")
    found = found.select("part", order.alias("filter_order"), step.alias("step"), "did.*")
    letter = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    found = found.withColumn("letter", letter)
    share = found.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return found.join(share, ["part", "letter"]).select("part", "filter_order", "step", *COUNTS, "shapley")


def oracle() -> str:
    """The same rows in DuckDB, from the mask of each document and a join of masks with steps."""
    return r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
firsts AS (SELECT body, min(doc_id) AS first_id FROM texts GROUP BY body),
labelled AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
fails AS (
  SELECT t.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
    (CASE WHEN len(words) < 200 THEN 'A' ELSE '' END)
    || (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * (length(t.body) - length(regexp_replace(t.body, '[A-Z]', '', 'g'))) > 2 * length(t.body)
        THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(t.body, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN t.doc_id > f.first_id THEN 'E' ELSE '' END) AS failed
  FROM texts t JOIN firsts f ON t.body = f.body LEFT JOIN labelled l ON t.doc_id = l.doc_id),
counted AS (
  SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY part, failed),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, s.step, filter_order[s.step] AS x, filter_order[1:s.step - 1] AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step) s),
each AS (
  SELECT c.part, s.filter_order, s.step, s.x, c.n, c.good, c.toxic, c.failed,
    contains(c.failed, s.x) AS here,
    len(list_filter(string_split(s.before, ''), lambda y: y <> '' AND contains(c.failed, y))) > 0 AS gone
  FROM counted c, steps s),
summed AS (
  SELECT part, filter_order, step, x,
    sum(CASE WHEN NOT here AND NOT gone THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN here AND NOT gone THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN here AND gone THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failed = x THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN here AND NOT gone THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN here AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM each GROUP BY part, filter_order, step, x)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
  redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM summed
"""
