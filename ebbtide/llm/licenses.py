"""License scans in DataFrame operations alone: MinHash bands over overlapping text windows, then exact containment.

Words are runs of a-z and 0-9 in the lower-cased text. The five-word shingles of the templates are looked up exactly, and a
document with a shingle of a template is a candidate for it, so every match is found. Every window of 16 words, begun at
every eighth word, has the MinHash of its shingles in 64 bands of one row; a window and a window of a template that agree
in a band make the template a candidate too. Bands alone would miss: a shingle may lie in one window only, as one of 12,
and a notice of that one shingle is then missed with probability (11/12) ** 64, or 0.4 per cent. A band can only agree
where one of the template's shingles stands, so the bands, worked out for those windows alone, add nothing to the lookup
and take nothing from it. Candidates are verified by the exact share of the template's shingles in the text.

Null and empty texts, and texts of fewer than five words, match nothing and give no rows. Repeated rows give their matches
each. Columns beyond doc_id and text are left alone. An empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ebbtide.llm.workspace import Workspace

SHINGLE, WINDOW, STRIDE, BANDS = 5, 16, 8, 64

# Notices as they are commonly written.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files, to deal in the Software without restriction",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met",
}


def let(value: Column, use) -> Column:
    """use(value), with value worked out once per row even inside lambdas."""
    return F.transform(F.array(value), use)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def shingle_hashes(listed: Column) -> Column:
    """The hash of the shingle at every word but the last four."""
    return F.when(
        F.size(listed) >= SHINGLE,
        F.transform(F.sequence(F.lit(0), F.size(listed) - SHINGLE), lambda i: F.xxhash64(*(listed[i + k] for k in range(SHINGLE)))),
    )


def band_values(hashes: Column) -> Column:
    """(band, value) of a window's shingle hashes: the smallest under each of the hash functions."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda b: F.struct(b.alias("band"), F.array_min(F.transform(hashes, lambda h: F.xxhash64(b, h))).alias("value")),
    )


def banded(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, band, value) of every window of rows (keys, hashes, starts)."""
    width = WINDOW - SHINGLE + 1
    cut = rows.select(*keys, F.explode("starts").alias("start"), "hashes")
    cut = cut.select(*keys, F.slice("hashes", F.col("start") + 1, width).alias("part"))
    return cut.select(*keys, F.explode(band_values(F.col("part"))).alias("b")).select(*keys, "b.band", "b.value").distinct()


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """(doc_id, license, found, containment, first_word, last_word) of every match in docs (doc_id, text).

    containment: the share of the template's distinct shingles in the text, at least `threshold`; found: their number;
    first_word and last_word: the words from the first to the end of the last of them.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "licenses")
    listed = spark.createDataFrame(sorted(templates.items()), "license string, text string")
    known = listed.select("license", let(words(F.col("text")), shingle_hashes).alias("hashes")).where("hashes IS NOT NULL")
    every = known.select(F.explode("hashes").alias("h")).distinct()
    # The templates are a fixed list, and so are their shingles and bands.
    telling = sorted(r["h"] for r in every.collect())
    text = F.coalesce("text", F.lit(""))
    hashed = docs.select(F.col("doc_id").cast("bigint"), let(words(text), shingle_hashes).alias("hashes"))
    some = F.exists("hashes", lambda h: h.isin(telling))
    near = work.keep(hashed.where(some).withColumn("row", F.monotonically_increasing_id()))
    hits = F.filter(F.transform("hashes", lambda h, i: F.struct(i.alias("at"), h.alias("h"))), lambda x: x["h"].isin(telling))
    near = work.keep(near.withColumn("hits", hits))
    # The windows in which a telling shingle stands: the one begun last before it, and those before that reach it.
    width = WINDOW - SHINGLE + 1
    last = lambda x: x["at"] - x["at"] % STRIDE
    reach = F.transform("hits", lambda x: F.filter(F.sequence(F.greatest(last(x) - width, F.lit(0)), last(x)), lambda s: (s % STRIDE == 0) & (s + width > x["at"])))
    covering = F.array_distinct(F.flatten(reach))
    ours = banded(near.select("row", "hashes", covering.alias("starts")), "row")
    theirs = banded(known.withColumn("starts", F.sequence(F.lit(0), F.size("hashes") - 1)), "license")
    agreed = ours.join(F.broadcast(theirs), ["band", "value"]).select("row", "license")
    # Bands can miss a located shingle; it makes its templates candidates by itself.
    owners = known.select("license", F.explode("hashes").alias("h")).distinct()
    located = near.select("row", F.explode(F.array_distinct("hits.h")).alias("h")).join(F.broadcast(owners), "h").select("row", "license")
    candidates = agreed.union(located).distinct()
    wanted = known.select("license", F.array_distinct("hashes").alias("wanted"))
    pairs = near.drop("hashes").join(candidates, "row").join(F.broadcast(wanted), "license")
    mine = F.filter("hits", lambda x: F.array_contains(F.col("wanted"), x["h"]))
    checked = pairs.withColumn("mine", mine).withColumn("found", F.size(F.array_distinct(F.col("mine.h"))))
    checked = checked.withColumn("containment", F.col("found") / F.size("wanted")).where(F.col("containment") >= threshold)
    return checked.select(
        "doc_id",
        "license",
        "found",
        "containment",
        F.array_min(F.col("mine.at")).alias("first_word"),
        (F.array_max(F.col("mine.at")) + SHINGLE).alias("last_word"),
    )


def oracle(templates: dict[str, str] = TEMPLATES, threshold: float = 0.8) -> str:
    """The matches by brute force, as DuckDB SQL over documents."""
    rows = []
    for name, text in sorted(templates.items()):
        listed = [w for w in re.split("[^a-z0-9]+", text.lower()) if w]
        for gram in dict.fromkeys(" ".join(listed[i : i + SHINGLE]) for i in range(len(listed) - SHINGLE + 1)):
            rows.append(f"('{name}', '{gram}')")
    return f"""
WITH template(license, gram) AS (VALUES {", ".join(rows)}),
sized AS (SELECT license, count(*) AS n FROM template GROUP BY license),
listed AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents
),
grams AS (
  SELECT doc_id, i - 1 AS place, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - {SHINGLE - 2})) AS i FROM listed WHERE len(w) >= {SHINGLE})
)
SELECT doc_id, license, count(DISTINCT gram)::INTEGER AS found,
       count(DISTINCT gram)::DOUBLE / n AS containment,
       min(place)::INTEGER AS first_word, (max(place) + {SHINGLE})::INTEGER AS last_word
FROM grams JOIN template USING (gram) JOIN sized USING (license)
GROUP BY doc_id, license, n HAVING count(DISTINCT gram)::DOUBLE / n >= {threshold}
"""
