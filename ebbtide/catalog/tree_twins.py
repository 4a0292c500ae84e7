"""DuckDB twins of the queries over fitted trees: the whole fit again, level by level, in SQL.

Trees are nodes (t, path): path 1 is the root, 2 p and 2 p + 1 are the children of p. `at<l>` holds the node of every row of every tree
after l levels, `best<l>` the splits made on level l, `stat<l>` the totals of the nodes that begin there.
"""

from __future__ import annotations

from itertools import product

from ebbtide.catalog.oracles import (
    ACCURACY,
    BATCH,
    CATEGORICAL_LEVELS,
    F1,
    FEATURES,
    NUMERICS,
    PASSTHROUGH,
    PRECISION,
    RECALL,
    SCORED,
    SUBS,
    SWEEP,
    auc_sql,
    confusion,
    r,
    u,
)

UNIT = "1048576.0::double"
NAMES = [*PASSTHROUGH, *NUMERICS, *(f"{n}_{v}" for n, levels in CATEGORICAL_LEVELS.items() for v in levels)]
WIDTH = len(NAMES)
POISSON = [0.367879, 0.735759, 0.919699, 0.981012, 0.99634, 0.999406]
BINS = 32


def numbers() -> str:
    """The model inputs as a list."""
    parts = [f"{n}::double" for n in [*PASSTHROUGH, *NUMERICS]]
    parts += [f"({n} = '{v}')::int::double" for n, levels in CATEGORICAL_LEVELS.items() for v in levels]
    return "[" + ", ".join(parts) + "]"


def name_list() -> str:
    return "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"


def uniform(key: str, field: str) -> str:
    return f"(('0x'||substr(md5({key}||{field}),1,8))::bigint / 4294967296.0::double)"


def split_rows() -> str:
    draw = u("split42", "id")
    return f"""{FEATURES},
numbered AS (SELECT customerID AS id, Churn::int AS label, {numbers()} AS x FROM features),
split_rows AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {draw}, id)
    <= round(count(*) OVER (PARTITION BY label) * 0.2) AS is_test FROM numbered)"""


def binned(p: str, training: str, folds: int, bins: int = BINS) -> str:
    """Rows to learn from with their folds, and the bins of all rows."""
    return f"""
{p}train AS (SELECT id, label, ((row_number() OVER (PARTITION BY label ORDER BY {u('fold42', 'id')}, id) - 1)
    % {folds})::int AS fold FROM split_rows WHERE {training}),
{p}long AS (SELECT id, {training} AS learnt, f, x[f + 1] AS v FROM split_rows, unnest(range({WIDTH})) AS g(f)),
{p}tied AS (SELECT f, v, count(*) AS n FROM {p}long WHERE learnt GROUP BY f, v),
{p}placed AS (SELECT f, v, (sum(n) OVER (PARTITION BY f ORDER BY v) - n) * {bins} // sum(n) OVER (PARTITION BY f) AS slot
  FROM {p}tied),
{p}edges AS (SELECT f, max(v) AS edge, row_number() OVER (PARTITION BY f ORDER BY max(v)) - 1 AS bin
  FROM {p}placed GROUP BY f, slot),
{p}bins AS (SELECT l.id, l.f, count(e.edge) AS bin FROM {p}long l LEFT JOIN {p}edges e
  ON e.f = l.f AND e.edge < l.v GROUP BY l.id, l.f)"""


def real(x: str) -> str:
    return f"({x}::double/{UNIT})"


def term(a: str, b: str, ridge: float) -> str:
    return f"{real(a)}*{real(a)}/({real(b)}+{ridge}::double)"


def splits(p: str, name: str, at: str, nodes: str, spec: dict) -> str:
    """`best` of the nodes (t, path) of a table: histograms, running sums, the best allowed split."""
    ridge, leaf, weight = spec["ridge"], spec["min_leaf"], spec["min_weight"]
    limits = [f"ln >= {leaf}", f"n - ln >= {leaf}", "ln > 0", "n - ln > 0"]
    limits += [f"{real(x)} >= {weight}::double" for x in ("lb", "(b-lb)")]
    limits += [f"{real(x)}+{ridge}::double > 0" for x in ("lb", "(b-lb)")]
    gain = f"({term('la', 'lb', ridge)}+{term('(a-la)', '(b-lb)', ridge)})-{term('a', 'b', ridge)}"
    return f"""
{name}rows AS (SELECT t, path, id, a, b FROM {at} JOIN {spec['members']} USING (t, id)),
{name}cells AS (SELECT t, path, f FROM {nodes}),
{name}wide AS (SELECT t, path, f, id, a, b FROM {name}rows JOIN {name}cells USING (t, path)),
{name}hist AS (SELECT t, path, f, bin, sum(a) AS a, sum(b) AS b, count(*) AS n
  FROM {name}wide JOIN {p}bins USING (id, f) GROUP BY t, path, f, bin),
{name}cum AS (SELECT t, path, f, bin, sum(a) OVER w AS la, sum(b) OVER w AS lb, sum(n) OVER w AS ln,
    sum(a) OVER v AS a, sum(b) OVER v AS b, sum(n) OVER v AS n FROM {name}hist
  WINDOW w AS (PARTITION BY t, path, f ORDER BY bin), v AS (PARTITION BY t, path, f)),
{name} AS (SELECT t, path, f, bin, gain FROM (
    SELECT t, path, f, bin, {gain} AS gain FROM {name}cum WHERE {' AND '.join(limits)})
  WHERE gain > 1e-9 QUALIFY row_number() OVER (PARTITION BY t, path ORDER BY gain DESC, f, bin) = 1)"""


def moved(p: str, new: str, at: str, best: str) -> str:
    return f"""
{new} AS (SELECT a.t, a.id, CASE WHEN s.f IS NULL THEN a.path WHEN c.bin <= s.bin THEN 2*a.path
    ELSE 2*a.path + 1 END AS path FROM {at} a LEFT JOIN {best} s USING (t, path)
  LEFT JOIN {p}bins c ON c.id = a.id AND c.f = s.f)"""


def totals(name: str, at: str, members: str, nodes: str = "true") -> str:
    return f"""
{name} AS (SELECT t, path, sum(a) AS a, sum(b) AS b, count(*) AS n FROM {at} JOIN {members} USING (t, id)
  WHERE {nodes} GROUP BY t, path)"""


def by_levels(p: str, q: str, start: str, depth: int, spec: dict) -> str:
    """Grow all trees of `spec['members']` level by level; `spec['features']` is SQL over (t, path) for (t, path, f)."""
    least = max(spec["min_split"], 2 * spec["min_leaf"])
    parts = [f"\n{q}at0 AS ({start})"]
    for level in range(depth):
        at, stat = f"{q}at{level}", f"{q}stat{level}"
        parts.append(totals(stat, at, spec["members"], f"path >= {2 ** level}"))
        parts.append(f"\n{q}open{level} AS ({spec['features'].format(nodes=f'(SELECT t, path FROM {stat} WHERE n >= {least})')})")
        parts.append(splits(p, f"{q}best{level}", at, f"{q}open{level}", spec))
        parts.append(moved(p, f"{q}at{level + 1}", at, f"{q}best{level}"))
    parts.append(totals(f"{q}stat{depth}", f"{q}at{depth}", spec["members"], f"path >= {2 ** depth}"))
    parts.append(
        f"\n{q}nodes AS ("
        + " UNION ALL ".join(f"SELECT {d} AS depth, * FROM {q}stat{d}" for d in range(depth + 1))
        + ")"
    )
    parts.append(
        f"\n{q}made AS ("
        + " UNION ALL ".join(f"SELECT {d} AS depth, * FROM {q}best{d}" for d in range(depth))
        + ")"
    )
    return ",".join(parts)


# --- the forest -----------------------------------------------------------------------------------


def forest(p: str, training: str, grid: dict, folds: int) -> str:
    """All fits of a forest's grid: `<p>nodes`, `<p>made`, `<p>at<l>`; tree t of run t // trees, the last run on all rows."""
    trees, depth = max(grid["n_estimators"]), max(grid["max_depth"])
    copies = "+".join(f"(u >= {edge})::int" for edge in POISSON)
    drawn = (
        "SELECT t, path, f FROM {nodes}, unnest(range(" + str(WIDTH) + ")) AS g(f) QUALIFY row_number() OVER "
        f"(PARTITION BY t, path ORDER BY md5((t % {trees})||':'||path||':'||f)) <= {int(WIDTH ** 0.5)}"
    )
    spec = {
        "ridge": 0.0,
        "min_leaf": grid["min_samples_leaf"][0],
        "min_split": grid["min_samples_split"][0],
        "min_weight": 0.0,
        "members": f"{p}members",
        "features": drawn,
    }
    return f"""{binned(p, training, folds)},
{p}runs AS (SELECT run, CASE WHEN run < {folds} THEN run ELSE -1 END AS out FROM unnest(range({folds + 1})) AS g(run)),
{p}weights AS (SELECT run, out, round_even(count(*)::double / (2*count(*) FILTER (label = 0)) * {UNIT}, 0)::bigint AS low,
    round_even(count(*)::double / (2*count(*) FILTER (label = 1)) * {UNIT}, 0)::bigint AS high
  FROM {p}runs JOIN {p}train ON fold <> out GROUP BY run, out),
{p}drawn AS (SELECT id, label, fold, tree, {copies} AS k FROM (SELECT *, {uniform('id', "':boot'||tree")} AS u
  FROM {p}train, unnest(range({trees})) AS g(tree))),
{p}members AS (SELECT run*{trees} + tree AS t, id, (k * CASE WHEN label = 1 THEN high ELSE low END) * label AS a,
    k * CASE WHEN label = 1 THEN high ELSE low END AS b
  FROM {p}drawn JOIN {p}weights ON fold <> out WHERE k > 0),
{by_levels(p, p, f"SELECT t, id, 1::bigint AS path FROM split_rows, unnest(range({(folds + 1) * trees})) AS g(t)", depth, spec)}"""


def forest_scores(p: str, grid: dict, folds: int) -> str:
    """(run, candidate, id, p) of all candidates."""
    trees = max(grid["n_estimators"])
    parts = []
    candidates = [(n, d) for n in grid["n_estimators"] for d in grid["max_depth"]]
    for i, (n, d) in enumerate(candidates):
        parts.append(
            f"SELECT {i} AS candidate, t // {trees} AS run, id, sum({real('a')}/{real('b')} ORDER BY t) / {n} AS p "
            f"FROM {p}at{d} JOIN {p}nodes USING (t, path) WHERE t % {trees} < {n} GROUP BY t // {trees}, id"
        )
    return f"{p}scores AS ({' UNION ALL '.join(parts)})"


def chosen(p: str, folds: int) -> str:
    """The best candidate by the mean AUC of the folds, and its scores on all rows."""
    return f"""
{p}held AS (SELECT candidate, fold, s.p, label FROM {p}scores s JOIN {p}train USING (id) WHERE s.run = fold),
{p}areas AS ({auc_sql(f'{p}held', 'candidate, fold')}),
{p}best_one AS (SELECT candidate FROM {p}areas GROUP BY candidate ORDER BY round(avg(auc), 12) DESC, candidate LIMIT 1),
{p}final AS (SELECT id, s.p, label, is_test FROM {p}scores s JOIN {p}best_one USING (candidate)
  JOIN split_rows USING (id) WHERE run = {folds})"""


def measures(model: str, p: str) -> str:
    """(model, split, metric, value) of the chosen candidate on its training and test rows."""
    rows = f"(SELECT label, p, CASE WHEN is_test THEN 'test' ELSE 'train' END AS part FROM {p}final)"
    metrics = {
        "accuracy": ACCURACY, "precision": PRECISION, "recall": RECALL, "f1_score": F1, "roc_auc": "auc",
        "n_samples": "(tp+fp+fn+tn)::double", "churn_rate": "(tp+fn)::double/(tp+fp+fn+tn)", "threshold": "0.5::double",
    }
    long = " UNION ALL ".join(
        f"SELECT '{model}' AS model, part AS split, '{name}' AS metric, {r(sql, 4)} AS value FROM {p}measured"
        for name, sql in metrics.items()
    )
    return f"""
{p}counts AS (SELECT part, {confusion('p >= 0.5')} FROM {rows} GROUP BY part),
{p}area AS ({auc_sql(rows, 'part')}),
{p}measured AS (SELECT * FROM {p}counts JOIN {p}area USING (part)),
{p}metrics AS ({long})"""


# --- boosted trees ------------------------------------------------------------------------------------


def boosted(p: str, grid: dict, folds: int) -> str:
    """All fits of a boosted grid that differs in the number of trees only: `<p>scores`, from margins tree by tree."""
    trees, leaves = max(grid["n_estimators"]), grid.get("num_leaves", [None])[0]
    rate, keep = grid["learning_rate"][0], grid["subsample"][0]
    positive = float(grid.get("scale_pos_weight", [1])[0])
    balanced = grid.get("class_weight", [None])[0] == "balanced"
    low, high = ("count(*)::double / (2*count(*) FILTER (label = 0))", "count(*)::double / (2*count(*) FILTER (label = 1))")
    low, high = (low, high) if balanced else ("1.0::double", f"{positive}::double")
    base = "0.0::double" if leaves is None else f"ln(pos*high/(neg*low))"
    spec = {"ridge": 1.0, "min_weight": 1.0, "min_leaf": 1, "min_split": 2}
    if leaves is not None:
        spec = {"ridge": 0.0, "min_weight": 0.001, "min_leaf": 20, "min_split": 2}
    out = [
        f"""{binned(p, 'NOT is_test', folds)},
{p}runs AS (SELECT run, CASE WHEN run < {folds} THEN run ELSE -1 END AS out FROM unnest(range({folds + 1})) AS g(run)),
{p}weights AS (SELECT *, {base} AS base FROM (SELECT run, out, {low} AS low, {high} AS high,
    count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
  FROM {p}runs JOIN {p}train ON fold <> out GROUP BY run, out)),
{p}margin0 AS (SELECT run AS t, id, base AS m FROM {p}weights, split_rows)"""
    ]
    share = grid.get("colsample_bytree", [1.0])[0]
    take = WIDTH if share >= 1 else max(1, int(WIDTH * share + 0.5))
    for k in range(trees):
        q = f"{p}k{k}"
        weight = "CASE WHEN label = 1 THEN high ELSE low END"
        out.append(
            f"""
{q}members AS (SELECT t, id, floor(w*(pr-label)*{UNIT}+0.5)::bigint AS a, floor(w*pr*(1-pr)*{UNIT}+0.5)::bigint AS b
  FROM (SELECT t, tr.id, label, {weight} AS w, 1/(1+exp(-m)) AS pr FROM {p}margin{k} JOIN {p}weights ON run = t
    JOIN {p}train tr ON tr.id = {p}margin{k}.id AND fold <> out WHERE {uniform('tr.id', f"':sub{k}'")} < {keep})),
{q}cols AS (SELECT f FROM unnest(range({WIDTH})) AS g(f) QUALIFY row_number() OVER (ORDER BY md5('columns{k}:'||f)) <= {take})"""
        )
        own = {**spec, "members": f"{q}members", "features": f"SELECT t, path, f FROM {{nodes}}, {q}cols"}
        start = f"SELECT run AS t, id, 1::bigint AS path FROM {p}runs, split_rows"
        if leaves is None:
            depth = grid["max_depth"][0]
            out.append("\n" + by_levels(p, q, start, depth, own))
            end, nodes = f"{q}at{depth}", f"{q}nodes"
        else:
            out.append(by_leaves(p, q, start, leaves, own))
            end, nodes = f"{q}at{leaves - 1}", f"{q}nodes"
        value = f"(-{rate}::double*{real('a')})/({real('b')}+{spec['ridge']}::double)"
        out.append(
            f"\n{p}margin{k + 1} AS (SELECT t, id, m + {value} AS m FROM {p}margin{k} "
            f"JOIN {end} USING (t, id) JOIN {nodes} USING (t, path))"
        )
    parts = [
        f"SELECT {i} AS candidate, t AS run, id, 1/(1+exp(-m)) AS p FROM {p}margin{n}"
        for i, n in enumerate(grid["n_estimators"])
    ]
    out.append(f"\n{p}scores AS ({' UNION ALL '.join(parts)})")
    return ",".join(out)


def by_leaves(p: str, q: str, start: str, leaves: int, spec: dict) -> str:
    """One split a step and tree: of all leaves the one with the largest gain."""
    least = max(spec["min_split"], 2 * spec["min_leaf"])
    parts = [f"\n{q}at0 AS ({start})"]
    known = None
    for step in range(leaves - 1):
        at = f"{q}at{step}"
        fresh = "path = 1" if not step else f"(t, path // 2) IN (SELECT t, path FROM {q}pick{step - 1})"
        parts.append(totals(f"{q}new{step}", at, spec["members"], fresh))
        open_ = spec["features"].format(nodes=f"(SELECT t, path FROM {q}new{step} WHERE n >= {least})")
        parts.append(f"\n{q}open{step} AS ({open_})")
        parts.append(splits(p, f"{q}found{step}", at, f"{q}open{step}", spec))
        older = f" UNION ALL SELECT * FROM {known} WHERE (t, path) NOT IN (SELECT t, path FROM {q}pick{step - 1})" if known else ""
        known = f"{q}known{step}"
        parts.append(f"\n{known} AS (SELECT * FROM {q}found{step}{older})")
        parts.append(
            f"\n{q}pick{step} AS (SELECT * FROM {known} QUALIFY row_number() OVER "
            "(PARTITION BY t ORDER BY gain DESC, path) = 1)"
        )
        parts.append(moved(p, f"{q}at{step + 1}", at, f"{q}pick{step}"))
    parts.append(totals(f"{q}nodes", f"{q}at{leaves - 1}", spec["members"]))
    return ",".join(parts)


# --- whole grids ---------------------------------------------------------------------------------------
#
# All fits of a grid grow together in one recursion, a split of every tree a step: t = fit * (folds + 1) + run, the last run on all rows.
# What differs between fits are columns of `<p>params`.

WHOLE_BINS = 64
DEEPEST = 30


def whole_fits(grid: dict, shared: tuple[str, ...]) -> tuple[list[dict], list[tuple[dict, int]]]:
    """The fits that a grid needs, those of most trees and the deepest ones, and every candidate with its fit."""
    own = [name for name in grid if name not in shared]
    fits = [dict(zip(own, values)) for values in product(*(grid[name] for name in own))]
    candidates = [dict(zip(grid, values)) for values in product(*grid.values())]
    return fits, [(c, fits.index({name: c[name] for name in own})) for c in candidates]


def values_table(rows: list[tuple], names: str) -> str:
    return f"(SELECT * FROM (VALUES {', '.join(str(row) for row in rows)}) AS v({names}))"


def whole_runs(p: str, folds: int) -> str:
    """`<p>weights`: params of each fit and run with what its class weights are."""
    low, high = ("count(*)::double / (2*count(*) FILTER (label = 0))", "count(*)::double / (2*count(*) FILTER (label = 1))")
    return f"""
{p}runs AS (SELECT run::int AS run, CASE WHEN run < {folds} THEN run ELSE -1 END AS out FROM unnest(range({folds + 1})) AS g(run)),
{p}sizes AS (SELECT run, out, {low} AS low, {high} AS high, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
  FROM {p}runs JOIN {p}train ON fold <> out GROUP BY run, out)"""


def whole_step(p: str, members: str, columns: str, best_first: bool) -> str:
    """CTEs of one step from `state` (t, id, path, step) with `params` of t: totals `tot` of the leaves and the splits `pick` made."""
    limits = ["ln >= min_leaf", "n - ln >= min_leaf", "ln > 0", "n - ln > 0"]
    limits += [f"{real(x)} >= min_weight" for x in ("lb", "(b-lb)")] + [f"{real(x)}+ridge > 0" for x in ("lb", "(b-lb)")]

    def part(a: str, b: str) -> str:
        return f"{real(a)}*{real(a)}/({real(b)}+ridge)"

    gain = f"({part('la', 'lb')}+{part('(a-la)', '(b-lb)')})-{part('a', 'b')}"
    one = "QUALIFY row_number() OVER (PARTITION BY t ORDER BY gain DESC, path) = 1" if best_first else ""
    return f"""mem AS MATERIALIZED ({members}),
tot AS MATERIALIZED (SELECT t, path, any_value(step) AS step, sum(a)::bigint AS a, sum(b)::bigint AS b, count(*) AS n FROM mem GROUP BY t, path),
leaves AS (SELECT tot.t, path, tot.step FROM tot JOIN {p}params q ON q.t = tot.t
  WHERE tot.step < q.steps AND path < (1::bigint << q.depth) AND n >= greatest(q.min_split, 2 * q.min_leaf)),
cells AS ({columns}),
hist AS (SELECT t, path, f, bin, sum(a)::bigint AS a, sum(b)::bigint AS b, count(*) AS n FROM mem JOIN cells USING (t, path)
  JOIN {p}bins USING (id, f) GROUP BY t, path, f, bin),
cum AS (SELECT t, path, f, bin, sum(a) OVER w AS la, sum(b) OVER w AS lb, sum(n) OVER w AS ln,
    sum(a) OVER v AS a, sum(b) OVER v AS b, sum(n) OVER v AS n FROM hist
  WINDOW w AS (PARTITION BY t, path, f ORDER BY bin), v AS (PARTITION BY t, path, f)),
found AS (SELECT t, path, f, bin, gain FROM (SELECT cum.*, {gain} AS gain FROM cum JOIN {p}params q USING (t) WHERE {' AND '.join(limits)})
  WHERE gain > 1e-9 QUALIFY row_number() OVER (PARTITION BY t, path ORDER BY gain DESC, f, bin) = 1),
pick AS (SELECT * FROM found {one})"""


MOVED = "CASE WHEN s.f IS NULL THEN g.path WHEN c.bin <= s.bin THEN 2*g.path ELSE 2*g.path + 1 END"


def whole_boosted(p: str, grid: dict, folds: int, bins: int = WHOLE_BINS) -> str:
    """`<p>scores` (run, candidate, id, p) of a whole grid of boosted trees, from margins kept at the numbers of trees asked for."""
    fits, candidates = whole_fits(grid, ("n_estimators",))
    counts, leafwise = sorted(set(grid["n_estimators"])), "num_leaves" in grid
    rows = []
    for i, fit in enumerate(fits):
        depth, share = fit["max_depth"], fit.get("colsample_bytree", 1.0)
        rows.append((
            i, int(fit.get("class_weight") == "balanced"), float(fit.get("scale_pos_weight", 1)), float(fit["learning_rate"]), float(fit["subsample"]),
            depth if depth and depth > 0 else DEEPEST, fit["num_leaves"] - 1 if leafwise else depth, WIDTH if share >= 1 else max(1, int(WIDTH * share + 0.5)),
        ))
    ridge, weight, leaf = ("0.0", "0.001", 20) if leafwise else ("1.0", "1.0", 1)
    base = "ln(pos*high/(neg*low))" if leafwise else "0.0::double"
    steps = max(row[6] for row in rows)
    members = f"""SELECT t, id, path, step, floor(w*(pr-label)*{UNIT}+0.5)::bigint AS a, floor(w*pr*(1-pr)*{UNIT}+0.5)::bigint AS b
  FROM (SELECT g.t, g.id, g.path, g.step, label, CASE WHEN label = 1 THEN high ELSE low END AS w, 1/(1+exp(-m)) AS pr
    FROM state g JOIN {p}params q ON q.t = g.t JOIN {p}train tr ON tr.id = g.id AND fold <> out
    WHERE {uniform('g.id', "':sub'||g.tree")} < keep)"""
    columns = f"""SELECT leaves.t, path, f FROM leaves JOIN {p}params q ON q.t = leaves.t JOIN {p}cols k ON place <= take
  AND k.tree = (SELECT max(tree) FROM state)"""
    value = f"(-rate*{real('n.a')})/({real('n.b')}+ridge)"
    ended = f"g.step = {steps}"
    grown = f"g.m + {value}"
    out = [
        binned(p, "NOT is_test", folds, bins),
        whole_runs(p, folds),
        f"""
{p}params AS (SELECT (fit * {folds + 1} + run)::int AS t, fit, run, out, rate, keep, depth, steps, take, low, high, {base} AS base,
    {ridge}::double AS ridge, {weight}::double AS min_weight, {leaf} AS min_leaf, 2 AS min_split
  FROM (SELECT v.*, run, out, pos, neg, CASE WHEN balanced = 1 THEN low ELSE 1.0::double END AS low,
    CASE WHEN balanced = 1 THEN high * positive ELSE positive::double END AS high
    FROM {values_table(rows, 'fit, balanced, positive, rate, keep, depth, steps, take')} v, {p}sizes))""",
        f"""
{p}cols AS (SELECT tree, f, row_number() OVER (PARTITION BY tree ORDER BY md5('columns'||tree||':'||f)) AS place
  FROM unnest(range({max(counts)})) AS h(tree), unnest(range({WIDTH})) AS g(f))""",
        f"""
{p}grown(t, id, path, tree, step, m, kept) USING KEY (t, id) AS (
  SELECT t, id, 1::bigint, 0, 0, base, []::double[] FROM {p}params, split_rows
  UNION
  (WITH state AS MATERIALIZED (SELECT * FROM {p}grown WHERE tree < {max(counts)}), {whole_step(p, members, columns, leafwise)}
  SELECT g.t, g.id, CASE WHEN {ended} THEN 1 ELSE {MOVED} END, CASE WHEN {ended} THEN g.tree + 1 ELSE g.tree END,
    CASE WHEN {ended} THEN 0 ELSE g.step + 1 END, CASE WHEN {ended} THEN {grown} ELSE g.m END,
    CASE WHEN {ended} AND g.tree + 1 IN ({', '.join(map(str, counts))}) THEN list_append(g.kept, {grown}) ELSE g.kept END
  FROM state g JOIN {p}params q ON q.t = g.t JOIN tot n ON n.t = g.t AND n.path = g.path
  LEFT JOIN pick s ON s.t = g.t AND s.path = g.path LEFT JOIN {p}bins c ON c.id = g.id AND c.f = s.f))""",
    ]
    places = [(i, at, counts.index(c["n_estimators"]) + 1) for i, (c, at) in enumerate(candidates)]
    out.append(
        f"\n{p}scores AS (SELECT candidate, run, id, 1/(1+exp(-kept[place])) AS p FROM {p}grown JOIN {p}params USING (t) "
        f"JOIN {values_table(places, 'candidate, fit, place')} USING (fit))"
    )
    return ",".join(out)


def whole_forest(p: str, grid: dict, folds: int, bins: int = WHOLE_BINS) -> str:
    """`<p>scores` of a whole grid of forests; a row keeps its values at the depths asked for."""
    fits, candidates = whole_fits(grid, ("n_estimators", "max_depth"))
    counts, trees = sorted(set(grid["n_estimators"])), max(grid["n_estimators"])
    depths = sorted({d or DEEPEST for d in grid["max_depth"]})
    per_node = {"sqrt": int(WIDTH**0.5), "log2": max(1, len(bin(WIDTH)) - 3)}
    rows = [
        (i, int(f["class_weight"] == "balanced"), f["min_samples_split"], f["min_samples_leaf"], per_node[f["max_features"]])
        for i, f in enumerate(fits)
    ]
    copies = "+".join(f"(u >= {edge})::int" for edge in POISSON)
    members = f"SELECT g.t, g.id, g.path, g.step, a, b FROM state g JOIN {p}members USING (t, id)"
    columns = f"""SELECT leaves.t, path, f FROM leaves JOIN {p}params q ON q.t = leaves.t, unnest(range({WIDTH})) AS h(f)
  QUALIFY row_number() OVER (PARTITION BY leaves.t, path ORDER BY md5(tree||':'||path||':'||f)) <= per_node"""
    value = f"{real('n.a')}/{real('n.b')}"
    out = [
        binned(p, "NOT is_test", folds, bins),
        whole_runs(p, folds),
        f"""
{p}params AS (SELECT ((fit * {folds + 1} + run) * {trees} + tree)::int AS t, tree::int AS tree, fit, run, out, {max(depths)} AS depth, {max(depths)} AS steps, min_split,
    min_leaf, per_node, round_even(CASE WHEN balanced = 1 THEN low ELSE 1 END * {UNIT}, 0)::bigint AS low,
    round_even(CASE WHEN balanced = 1 THEN high ELSE 1 END * {UNIT}, 0)::bigint AS high, 0.0::double AS ridge, 0.0::double AS min_weight
  FROM {values_table(rows, 'fit, balanced, min_split, min_leaf, per_node')} v, {p}sizes, unnest(range({trees})) AS g(tree)),
{p}drawn AS (SELECT id, label, fold, tree, {copies} AS k FROM (SELECT *, {uniform('id', "':boot'||tree")} AS u
  FROM {p}train, unnest(range({trees})) AS g(tree))),
{p}members AS (SELECT t, id, (k * CASE WHEN label = 1 THEN high ELSE low END) * label AS a, k * CASE WHEN label = 1 THEN high ELSE low END AS b
  FROM {p}drawn JOIN {p}params USING (tree) WHERE fold <> out AND k > 0)""",
        f"""
{p}grown(t, id, path, step, kept) USING KEY (t, id) AS (
  SELECT t, id, 1::bigint, 0, []::double[] FROM {p}params, split_rows
  UNION
  (WITH state AS MATERIALIZED (SELECT * FROM {p}grown WHERE step <= {max(depths)}), {whole_step(p, members, columns, False)}
  SELECT g.t, g.id, {MOVED}, g.step + 1, CASE WHEN g.step IN ({', '.join(map(str, depths))}) THEN list_append(g.kept, {value}) ELSE g.kept END
  FROM state g JOIN tot n ON n.t = g.t AND n.path = g.path
  LEFT JOIN pick s ON s.t = g.t AND s.path = g.path LEFT JOIN {p}bins c ON c.id = g.id AND c.f = s.f))""",
    ]
    places = [(i, at, c["n_estimators"], depths.index(c["max_depth"] or DEEPEST) + 1) for i, (c, at) in enumerate(candidates)]
    out.append(
        f"\n{p}scores AS (SELECT candidate, run, id, sum(kept[place] ORDER BY tree) / any_value(count) AS p FROM {p}grown "
        f"JOIN {p}params USING (t) JOIN {values_table(places, 'candidate, fit, count, place')} USING (fit) WHERE tree < count "
        "GROUP BY candidate, run, id)"
    )
    return ",".join(out)


def whole_metrics(grids: dict[str, dict], bins: int = WHOLE_BINS) -> str:
    """Metrics of the best model of each family's whole grid."""
    parts = {
        "random_forest": ("wg", whole_forest("wg", grids["random_forest"], 5, bins), 5),
        "boosted_a": ("wa", whole_boosted("wa", grids["boosted_a"], 3, bins), 3),
        "boosted_b": ("wb", whole_boosted("wb", grids["boosted_b"], 3, bins), 3),
    }
    text = split_rows()
    for name, (p, fits, folds) in parts.items():
        text += "," + search_metrics(name, p, fits, folds)
    every = " UNION ALL ".join(f"SELECT * FROM {p}metrics" for p, _, _ in parts.values())
    return f"WITH RECURSIVE {text}, metrics AS ({every})"


# The grids of the schema.
WHOLE_GRIDS = {
    "random_forest": {
        "n_estimators": [100, 200, 300], "max_depth": [None, 10, 20, 30], "min_samples_split": [2, 5, 10], "min_samples_leaf": [1, 2, 4],
        "max_features": ["sqrt", "log2"], "class_weight": ["balanced", None],
    },
    "boosted_a": {
        "n_estimators": [100, 200, 300], "max_depth": [3, 5, 7], "learning_rate": [0.01, 0.05, 0.1], "subsample": [0.7, 0.85, 1.0],
        "colsample_bytree": [0.7, 0.85, 1.0], "scale_pos_weight": [1, 2, 3],
    },
    "boosted_b": {
        "n_estimators": [100, 200, 300], "max_depth": [-1, 10, 20], "learning_rate": [0.01, 0.05, 0.1], "num_leaves": [31, 63, 127],
        "subsample": [0.7, 0.85, 1.0], "class_weight": ["balanced", None],
    },
}

# --- the registered fits ----------------------------------------------------------------------------------

# The same grids as in the catalog.
FOREST = {
    "n_estimators": [4, 8], "max_depth": [3, 5], "min_samples_split": [4], "min_samples_leaf": [2],
    "max_features": ["sqrt"], "class_weight": ["balanced"],
}
BOOSTED_A = {
    "n_estimators": [2, 3], "max_depth": [3], "learning_rate": [0.3], "subsample": [0.85], "colsample_bytree": [0.7],
    "scale_pos_weight": [2],
}
BOOSTED_B = {
    "n_estimators": [1, 2], "num_leaves": [4], "max_depth": [-1], "learning_rate": [0.3], "subsample": [0.85],
    "class_weight": ["balanced"],
}
FIXED = {**FOREST, "n_estimators": [8], "max_depth": [5]}
TREES, DEPTH = 8, 5

# One fit on all training rows: run 1 of "folds" that leave nothing in for run 0.
FIT = f"{split_rows()},{forest('f', 'NOT is_test', FIXED, 1)},\n{forest_scores('f', FIXED, 1)}"
OWN = f"t // {TREES} = 1"


def routed(name: str, start: str, value: str) -> str:
    """Rows (t, path, ...) walked down the fitted forest by their values; `value` is the number that split m looks at."""
    parts = [f"{name}0 AS ({start})"]
    for level in range(DEPTH):
        parts.append(
            f"{name}{level + 1} AS (SELECT a.* REPLACE (CASE WHEN m.f IS NULL THEN a.path "
            f"WHEN {value} <= e.edge THEN 2*a.path ELSE 2*a.path + 1 END AS path) FROM {name}{level} a "
            f"LEFT JOIN fmade m USING (t, path) LEFT JOIN fedges e ON e.f = m.f AND e.bin = m.bin)"
        )
    return ",\n".join(parts)


def search_metrics(model: str, p: str, fits: str, folds: int) -> str:
    return f"{fits},{chosen(p, folds)},{measures(model, p)}"


def model_metrics(*names: str) -> str:
    parts = {
        "random_forest": ("g", f"{forest('g', 'NOT is_test', FOREST, 5)},\n{forest_scores('g', FOREST, 5)}", 5),
        "boosted_a": ("a", boosted("a", BOOSTED_A, 3), 3),
        "boosted_b": ("b", boosted("b", BOOSTED_B, 3), 3),
    }
    text = split_rows()
    for name in names:
        p, fits, folds = parts[name]
        text += "," + search_metrics(name, p, fits, folds)
    every = " UNION ALL ".join(f"SELECT * FROM {parts[name][0]}metrics" for name in names)
    return f"WITH {text}, metrics AS ({every})"


def cross_validated() -> str:
    metrics = {"accuracy": ACCURACY, "precision": PRECISION, "recall": RECALL, "f1_score": F1, "roc_auc": "auc"}
    long = " UNION ALL ".join(f"SELECT '{n}' AS metric, {r(sql, 4)} AS value FROM measured" for n, sql in metrics.items())
    return f"""WITH {split_rows()},{forest('c', 'true', FIXED, 5)},
{forest_scores('c', FIXED, 5)},
held AS (SELECT fold, s.p, label FROM cscores s JOIN ctrain USING (id) WHERE s.run = fold),
counts AS (SELECT fold, {confusion('p >= 0.5')} FROM held GROUP BY fold), areas AS ({auc_sql('held', 'fold')}),
measured AS (SELECT * FROM counts JOIN areas USING (fold)), long AS ({long})
SELECT metric, {r('avg(value)', 4)} AS mean, {r('stddev_pop(value)', 4)} AS std FROM long GROUP BY metric"""


def importance() -> str:
    return f"""WITH {FIT},
gains AS (SELECT t, f, sum(gain) AS gain FROM fmade WHERE {OWN} GROUP BY t, f),
shares AS (SELECT t, f, gain / sum(gain) OVER (PARTITION BY t) AS share FROM gains),
summed AS (SELECT f, sum(share) / (SELECT count(DISTINCT t) FROM gains) AS part FROM shares GROUP BY f)
SELECT n.name AS feature, {r('coalesce(part, 0::double)', 9)} AS importance
FROM (SELECT unnest({name_list()}) AS name, unnest(range({WIDTH})) AS f) n LEFT JOIN summed USING (f)"""


def batch() -> str:
    return (
        f"WITH {FIT},\nscored AS (SELECT raw.*, (Churn='Yes')::int AS label, s.p FROM raw JOIN fscores s "
        f"ON s.id = raw.customerID AND s.run = 1){BATCH[len(SCORED):]} SELECT * FROM batch"
    )


def whatif() -> str:
    again = FEATURES[len(SUBS):]
    for name in ("filled", "typed", "features"):
        again = again.replace(f"{name} AS (", f"{name}_2 AS (").replace(f"FROM {name})", f"FROM {name}_2)")
    again = again.replace("FROM raw)", "FROM swept)")
    points = ", ".join(f"({i}, {c!r}::double)" for i, c in enumerate(SWEEP))
    start = f"SELECT id, point, charge, x, t, 1::bigint AS path FROM wide, unnest(range({TREES}, {2 * TREES})) AS g(t)"
    return f"""WITH {FIT},
swept AS (SELECT raw.* REPLACE (c.charge AS MonthlyCharges, customerID||'#'||c.point AS customerID) FROM raw
  CROSS JOIN (VALUES {points}) AS c(point, charge)){again},
wide AS (SELECT customerID AS id, split_part(customerID, '#', 2)::int AS point, MonthlyCharges AS charge, {numbers()} AS x
  FROM features_2),
{routed('w', start, 'a.x[m.f + 1]')},
scored AS (SELECT id, point, any_value(charge) AS charge, sum({real('n.a')}/{real('n.b')} ORDER BY w{DEPTH}.t) / {TREES} AS p
  FROM w{DEPTH} JOIN fnodes n USING (t, path) GROUP BY id, point)
SELECT point, {r('min(charge)', 6)} AS charge, {r('avg(p)*100', 4)} AS mean_probability_pct FROM scored GROUP BY point"""


def permuted() -> str:
    start = (
        f"SELECT id, label, repeat, c.f, x, nb[c.f + 1] AS other, t, 1::bigint AS path FROM shifted, unnest(range({WIDTH})) "
        f"AS c(f), unnest(range({TREES}, {2 * TREES})) AS g(t)"
    )
    return f"""WITH {FIT},
rows AS (SELECT id, label, x, rep.i AS repeat, md5(id||':shift42:'||rep.i) AS place FROM split_rows
  CROSS JOIN unnest(range(10)) AS rep(i) WHERE is_test),
shifted AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nb FROM rows
  WINDOW w AS (PARTITION BY repeat ORDER BY place, id)),
{routed('v', start, 'CASE WHEN m.f = a.f THEN a.other ELSE a.x[m.f + 1] END')},
rescored AS (SELECT v{DEPTH}.f, repeat, id, any_value(label) AS label,
    sum({real('n.a')}/{real('n.b')} ORDER BY v{DEPTH}.t) / {TREES} AS p
  FROM v{DEPTH} JOIN fnodes n USING (t, path) GROUP BY v{DEPTH}.f, repeat, id),
areas AS ({auc_sql('rescored', 'f, repeat')}),
area AS ({auc_sql(f'(SELECT s.p, label FROM fscores s JOIN split_rows USING (id) WHERE is_test AND run = 1)')}),
drops AS (SELECT {name_list()}[f + 1] AS feature, area.auc - areas.auc AS d FROM areas, area)
SELECT feature, {r('avg(d)', 6)} AS importance_mean, {r('stddev_pop(d)', 6)} AS importance_std
FROM drops GROUP BY feature ORDER BY importance_mean DESC, feature LIMIT 20"""


def attribution() -> str:
    """Exact Shapley values from the masks of rows and background rows over the leaves."""
    mask = (
        "SELECT {id}, t, leaf, sum(CASE WHEN ok THEN 1::bigint << bit ELSE 0 END)::bigint AS mask FROM ("
        "SELECT {id}, t, leaf, bit, bool_and(CASE WHEN goes_right THEN x[f + 1] > edge ELSE x[f + 1] <= edge END) AS ok "
        "FROM {rows}, tests GROUP BY {id}, t, leaf, bit) GROUP BY {id}, t, leaf"
    )
    return f"""WITH {FIT},
leaves AS (SELECT t, path AS leaf, depth, {real('a')}/{real('b')}/{TREES} AS value FROM fnodes
  WHERE {OWN} AND (t, path) NOT IN (SELECT t, path FROM fmade)),
steps AS (SELECT l.t, l.leaf, m.f, e.edge, ((l.leaf >> (l.depth - m.depth - 1)::int) & 1) = 1 AS goes_right
  FROM leaves l JOIN fmade m ON m.t = l.t AND m.depth < l.depth AND m.path = l.leaf >> (l.depth - m.depth)::int
  JOIN fedges e ON e.f = m.f AND e.bin = m.bin),
bits AS (SELECT t, leaf, f, (row_number() OVER (PARTITION BY t, leaf ORDER BY f) - 1)::int AS bit
  FROM (SELECT DISTINCT t, leaf, f FROM steps)),
sizes AS (SELECT t, leaf, count(*) AS features FROM bits GROUP BY t, leaf),
tests AS (SELECT s.*, b.bit FROM steps s JOIN bits b USING (t, leaf, f)),
ground AS (SELECT id, x FROM split_rows WHERE NOT is_test ORDER BY md5(id||':sample43') LIMIT 100),
asked AS (SELECT id, x FROM split_rows WHERE is_test),
masks AS ({mask.format(id='id', rows='asked')}),
others AS (SELECT t, leaf, mask AS mask_z, count(*) AS n FROM ({mask.format(id='id', rows='ground')}) GROUP BY ALL),
pairs AS (SELECT t, leaf, mask, mask & ~mask_z AS mine, mask_z & ~mask AS theirs, value*n/100 AS worth,
    bit_count(mask & ~mask_z)::int AS p, bit_count(mask_z & ~mask)::int AS q
  FROM (SELECT DISTINCT t, leaf, mask FROM masks) JOIN others USING (t, leaf) JOIN leaves USING (t, leaf) JOIN sizes USING (t, leaf)
  WHERE mask | mask_z = (1::bigint << features::int) - 1),
parts AS (SELECT t, leaf, mask, f, sum(CASE WHEN (mine >> bit) & 1 = 1
      THEN worth*factorial(greatest(p-1, 0))::double*factorial(q)::double/factorial(p+q)::double
    WHEN (theirs >> bit) & 1 = 1 THEN -worth*factorial(p)::double*factorial(greatest(q-1, 0))::double/factorial(p+q)::double END) AS part
  FROM pairs JOIN bits USING (t, leaf) GROUP BY t, leaf, mask, f),
gained AS (SELECT id, f, sum(part) AS phi FROM masks JOIN parts USING (t, leaf, mask) GROUP BY id, f)
SELECT asked.id AS customerID, {name_list()}[c.f + 1] AS feature, {r('x[c.f + 1]', 6)} AS feature_value,
  {r('coalesce(phi, 0)', 9)} AS phi FROM asked CROSS JOIN unnest(range({WIDTH})) AS c(f) LEFT JOIN gained g ON g.id = asked.id AND g.f = c.f
UNION ALL SELECT id, 'base value', NULL, {r('(SELECT avg(s.p) FROM fscores s JOIN ground USING (id) WHERE run = 1)', 9)} FROM asked"""


def node_listing() -> str:
    """The node table of the fitted forest by paths."""
    return f"""WITH {FIT}
SELECT (n.t - {TREES})::int AS tree, n.path, n.depth::int AS depth, n.n, {name_list()}[m.f + 1] AS feature, e.edge AS cut,
  {r('m.gain', 6)} AS gain, {r(f"{real('n.a')}/{real('n.b')}", 9)} AS value
FROM fnodes n LEFT JOIN fmade m USING (t, path) LEFT JOIN fedges e ON e.f = m.f AND e.bin = m.bin WHERE n.{OWN}"""


TREE_ORACLES = {
    "rf_metrics": model_metrics("random_forest") + " SELECT * FROM metrics",
    "gbt_metrics": model_metrics("boosted_a", "boosted_b") + " SELECT * FROM metrics",
    "model_comparison": whole_metrics(WHOLE_GRIDS)
    + " SELECT model, value AS roc_auc FROM metrics WHERE split = 'test' AND metric = 'roc_auc' ORDER BY roc_auc DESC, model",
    "cv_summary": cross_validated(),
    "rf_importance": importance(),
    "model_scores": batch(),
    "model_whatif": whatif(),
    "permutation_importance": permuted(),
    "tree_attribution": attribution(),
    "tree_nodes": node_listing(),
}
