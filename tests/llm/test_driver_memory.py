"""What comes to the driver stays small, however many levels, tasks or words there are."""

import numpy as np

from ebbtide.llm import graph, jaccard, toxicity
from ebbtide.llm.workspace import Workspace


def test_leaves_of_all_levels_are_read_in_one_scan(spark):
    draw = np.random.default_rng(5)
    alike = draw.integers(0, 1 << 30, jaccard.SKETCH).tolist()
    rows = [(i, alike) for i in range(40)] + [(i, draw.integers(0, 1 << 30, jaccard.SKETCH).tolist()) for i in range(40, 60)]
    vertices = spark.createDataFrame(rows, "id bigint, sketch array<int>")
    work = Workspace(spark, "test-tree")
    found = jaccard.tree(work.keep(vertices), work, runs=3, small=8)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # A union of the levels is one stage whose tasks each report the metrics of all of them to the driver.
    assert "Union" not in plan and "Join" not in plan and plan.count("Relation") == 1
    leaves = [(r["bucket"], r["id"]) for r in found.collect()]
    assert len(leaves) == len(set(leaves))
    buckets = {}
    for bucket, who in leaves:
        buckets.setdefault(bucket, set()).add(who)
    # All that are alike meet; those that share nothing meet nobody.
    assert buckets and all(b == set(range(40)) for b in buckets.values())


def test_training_counts_words_without_a_row_object_each(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    texts = [(i, "en", " ".join(words[i * 7 % 300 : i * 7 % 300 + 100]) + (" awful" if i % 3 == 0 else "")) for i in range(80)]
    docs = spark.createDataFrame(texts, "doc_id bigint, lang string, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(80)], "doc_id bigint, toxic int")
    sizes, collect = [], type(docs).collect

    def seen(self):
        out = collect(self)
        sizes.append(len(out))
        return out

    monkeypatch.setattr(type(docs), "collect", seen)
    model = toxicity.learned(docs, labels)
    assert model.constant is None and set(model.thresholds) == {"", "en"}
    assert max(sizes) <= 4


def tables_read(monkeypatch) -> list[int]:
    """For each table written from now on, how many scans its plan holds."""
    found, write = [], Workspace.write

    def seen(self, df):
        found.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation"))
        return write(self, df)

    monkeypatch.setattr(Workspace, "write", seen)
    return found


def test_a_step_of_components_reads_its_edges_a_few_times_only(spark, monkeypatch):
    # A path, a star, a loop, a repeated edge and a ring.
    edges = [(i, i + 1) for i in range(20, 32)] + [(50, i) for i in range(51, 70)] + [(80, 80), (91, 90), (91, 90)]
    edges += [(100 + i, 100 + (i + 1) % 5) for i in range(5)]
    work = Workspace(spark, "test-components")
    rows = work.keep(spark.createDataFrame(edges, "u bigint, v bigint"))
    scans = tables_read(monkeypatch)
    found = {r["id"]: r["root"] for r in graph.components(rows, work).collect()}
    expected = {i: 20 for i in range(21, 33)} | {i: 50 for i in range(51, 70)} | {91: 90} | {i: 100 for i in range(101, 105)}
    assert found == expected
    # Sixteen when the step was one plan, each scan with tasks that report the metrics of the whole plan.
    assert max(scans) <= 4


def test_keep_one_reads_its_classes_a_few_times_only(spark, monkeypatch):
    base = " ".join(f"w{i}" for i in range(80))
    rows = [(3, base), (1, base + " end"), (1, base + " end"), (2, base), (7, "other words that nobody else has here"), (8, ""), (None, " ")]
    docs = Workspace(spark, "test-keep").keep(spark.createDataFrame(rows, "doc_id bigint, text string"))
    scans = tables_read(monkeypatch)
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in jaccard.keep_one(docs).collect())
    assert kept == [(False, 1, base + " end"), (False, 7, rows[4][1]), (False, 8, ""), (True, 0, " ")]
    assert max(scans) <= 5, scans
