"""The named queries of this subpackage, and DuckDB twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ebbtide.llm import (
    audit,
    blobs,
    bpe,
    caps,
    fingerprints,
    jaccard,
    licenses,
    mixing,
    packing,
    resample,
    sharding,
    toxicity,
    urls,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents"), shards=8)
    return found.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def held_out() -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    return toxicity.learned(docs, table(spark, sf_dir, "labels").where(~held_out()))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(spark, docs, sf_dir)
    scored = toxicity.scored(docs.select("doc_id", "text", "lang"), model)
    return scored.select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.7).cast("int").alias("predicted"),
        model.rejects(F.col("lang"), F.col("toxicity")).alias("rejected"),
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = mixing.mixed(docs, labels, keep=["doc_id"])
    shares = [F.col("p")[i].alias(f"p_{name}") for i, name in enumerate(mixing.TARGETS)]
    return found.select("doc_id", "tokens", *shares, "rate", "copies", "distance")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op8_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.cap_join(table(spark, sf_dir, "embeddings"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = blobs.secrets(docs).drop("text")

    def of(kinds: list[str]):
        return F.filter("spans", lambda s: s["kind"].isin(kinds))

    base = of([r.kind for r in blobs.BASE])
    return found.select(
        "doc_id",
        *(F.size(of([r.kind])).cast("bigint").alias(f"n_{r.kind}") for r in blobs.BASE),
        F.sha2(blobs.listed(base), 256).alias("base_sha256"),
        blobs.listed(F.col("spans")).alias("spans"),
    )


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = bpe.encoded(table(spark, sf_dir, "documents"), back="text")
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return back.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2(F.col("text"), 256).alias("decoded_sha256"),
    )


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_packing": op2_packing,
    "op3_license_scans": op3_license_scans,
    "op4_sharding": op4_sharding,
    "op5_toxicity": op5_toxicity,
    "op6_mixing": op6_mixing,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_spherical_caps": op8_spherical_caps,
    "op9_secret_scans": op9_secret_scans,
    "op10_url_filters": op10_url_filters,
    "op11_bpe": op11_bpe,
    "op12_resampling": op12_resampling,
    "op13_filter_audit": op13_filter_audit,
}
ORACLES: dict[str, str] = {
    "op3_license_scans": licenses.oracle(),
    "op12_resampling": resample.oracle(),
    "op13_filter_audit": audit.oracle(),
}
