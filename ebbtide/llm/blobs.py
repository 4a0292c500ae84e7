"""Secret scans with an incremental ledger of blobs, in DataFrame operations alone.

Every historical version of every path is named by the SHA-256 of its text. A ledger folder holds which (blob, rule,
rule version) have been scanned, and what was found. A scan takes only the pairs that the ledger lacks, adds them, and joins
the findings of all blobs back to all paths and versions. Findings are written before the scans that they belong to, so
an interrupted scan is repeated and its findings, being sets, don't count twice.

A null text is an empty one. Repeated rows each get their findings. Columns beyond those named are left alone. An empty
table gives no rows. Positions count code points; the end is exclusive.
"""

from __future__ import annotations

import uuid

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ebbtide.llm.sieve import sieved
from ebbtide.llm.workspace import Workspace


@dataclass(frozen=True)
class Rule:
    """What to look for. least: the length that `group` must have, else the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1


# The three base rules.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    # Runs are maximal either way; the length inside the pattern spares the short ones.
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: What this library looks for besides.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE

#: Marks the borders of matches; a text's own such character is read as its neighbour, which no rule knows either.
MARK, OTHER = "\ue000", "\ue001"
SCHEMA = "blob string, kind string, version int, start bigint, end bigint"


def blob(text: Column | str = "text") -> Column:
    return F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256)


def matches(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, kind, version, start, end) of texts (blob, text, kinds), where kinds lists the rules to apply.

    A match is cut out between marks; what lies before it gives its place.
    """
    plain = F.translate("text", MARK, OTHER)
    marked = F.array(
        *(
            F.when(
                F.array_contains("kinds", r.kind) & F.col("plain").rlike(r.pattern),
                F.struct(
                    F.lit(r.kind).alias("kind"),
                    F.lit(r.version).alias("version"),
                    F.split(F.regexp_replace("plain", r.pattern, f"{MARK}$0{MARK}"), MARK, -1).alias("pieces"),
                ),
            )
            for r in rules
        )
    )
    found = texts.select("blob", "kinds", plain.alias("plain")).select("blob", F.explode(marked).alias("hit")).where("hit IS NOT NULL")
    pieces = found.select("blob", "hit.kind", "hit.version", F.posexplode("hit.pieces").alias("at", "piece"))
    before = Window.partitionBy("blob", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("start", F.coalesce(F.sum(F.length("piece").cast("bigint")).over(before), F.lit(0)))
    enough = F.lit(False)
    for r in rules:
        part = F.regexp_extract("piece", r.pattern, r.group) if r.group else F.col("piece")
        enough = enough | ((F.col("kind") == r.kind) & (F.length(part) >= r.least))
    return placed.where("at % 2 = 1").where(enough).select(
        "blob", "kind", "version", "start", (F.col("start") + F.length("piece")).alias("end")
    )


def _ledger(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _once(history: DataFrame, ledger: str) -> DataFrame:
    """One row of each blob. Only texts that may be repeated are shuffled: those whose hash is met twice."""
    folder = f"{ledger}/repeats-{uuid.uuid4().hex}"
    hashed = F.xxhash64("blob")
    history.select(hashed.alias("hash")).groupBy("hash").count().where("count > 1").select("hash").write.parquet(folder)
    repeats = history.sparkSession.read.schema("hash bigint").parquet(folder)
    marked = sieved(history, hashed, repeats, "__may")
    again = marked.where("__may").dropDuplicates(["blob"])
    return marked.where("NOT __may").unionByName(again).drop("__may")


def scan(history: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Bring the ledger up to date with history (blob, text); returns (blob, kind, start, end) of the rules given."""
    spark = history.sparkSession
    kinds = F.explode(F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules)))
    seen = _ledger(spark, f"{ledger}/scans", "blob string, kind string, version int")
    if seen is None:
        todo = _once(history, ledger).withColumn("kinds", F.array(*(F.lit(r.kind) for r in rules)))
    else:
        pairs = history.select("blob").distinct().select("blob", kinds.alias("rule")).select("blob", "rule.*")
        fresh = pairs.join(seen, ["blob", "kind", "version"], "left_anti")
        fresh = fresh.groupBy("blob").agg(F.collect_set("kind").alias("kinds"))
        # The texts of blobs that are known stay where they are.
        todo = history.join(fresh, "blob").dropDuplicates(["blob"])
    todo = todo.select("blob", "text", "kinds")
    matches(todo, rules).write.mode("append").parquet(f"{ledger}/findings")
    if seen is None:
        fresh = history.select("blob").distinct().withColumn("kinds", F.array(*(F.lit(r.kind) for r in rules)))
    versions = F.create_map(*(F.lit(x) for r in rules for x in (r.kind, r.version)))
    scans = fresh.select("blob", F.explode("kinds").alias("kind")).withColumn("version", versions[F.col("kind")])
    scans.write.mode("append").parquet(f"{ledger}/scans")
    found = spark.read.schema(SCHEMA).parquet(f"{ledger}/findings")
    return found.where(versions[F.col("kind")] == F.col("version")).distinct().drop("version")


def by_blob(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans): the findings of a blob by start, then kind as listed."""
    order = F.array_position(F.array(*(F.lit(r.kind) for r in rules)), F.col("kind")).cast("int")
    span = F.struct("start", order.alias("order"), "kind", "end")
    return found.groupBy("blob").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def secrets(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The columns of docs and blob, spans (array, empty without findings) for every row of docs (text, ...).

    Every row is a path at a version. Without a ledger a new one is begun. Columns of docs that are called blob or spans give way to
    the results.
    """
    work = Workspace(docs.sparkSession, "secrets")
    versions = docs.withColumn("__blob", blob())
    texts = versions.select(F.col("__blob").alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    found = work.keep(by_blob(scan(texts, ledger or f"{work.root}/ledger", rules), rules))
    none = F.array().cast(found.schema["spans"].dataType)
    hashes = work.keep(found.select(F.xxhash64("blob").alias("hash")))
    # A text moves only where its blob may have findings.
    marked = sieved(versions, F.xxhash64("__blob"), hashes, "__may")
    columns = [F.col(f"`{c}`") for c in docs.columns if c not in ("blob", "spans")]
    clear = marked.where("NOT __may").select(*columns, F.col("__blob").alias("blob"), none.alias("spans"))
    hit = marked.where("__may").select(*columns, F.col("__blob").alias("__hit"))
    joined = hit.join(found, F.col("__hit") == found["blob"], "left")
    spans = F.coalesce(found["spans"], none)
    return clear.unionByName(joined.select(*columns, F.col("__hit").alias("blob"), spans.alias("spans")))


def masked(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every finding replaced by the mark; overlapping ones are replaced together."""

    def step(state, s):
        new = s["start"] >= state["at"]
        # An overlapping finding only moves the end.
        part = F.concat(state["out"], F.substring(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int")), F.lit(mark))
        return F.struct(F.when(new, part).otherwise(state["out"]).alias("out"), F.greatest(state["at"], s["end"]).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))
    done = F.aggregate(spans, start, step)
    rest = F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) > 0, rest).otherwise(text)
