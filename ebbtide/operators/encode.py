"""One-hot encoding, standard scaling and column alignment.

Fitting is an aggregate, applying is one narrow projection. ``ml_stages`` gives the
same encoding as Spark ML stages, for use in a ``Pipeline``.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.ml import Transformer
from pyspark.ml.feature import (
    OneHotEncoder,
    SQLTransformer,
    StringIndexer,
    VectorAssembler,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide import schema as S

UNKNOWN = "Unknown"


@dataclass(frozen=True)
class Encoding:
    """What is learned from the training rows: column order, mean and sigma, levels."""

    passthrough: list[str]
    means: dict[str, float]
    sigmas: dict[str, float]
    levels: dict[str, list[str]]
    feature_columns: list[str] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Encoding:
        return Encoding(**json.loads(text))


def fill_unknown(df: DataFrame) -> DataFrame:
    """Null categoricals become the level "Unknown"; engineered ones are never null."""
    present = [
        f.name for f in df.schema.fields if f.name in S.CATEGORICAL_COLUMNS and f.nullable
    ]
    return df.fillna(UNKNOWN, subset=present) if present else df


def feature_inputs(df: DataFrame, exclude: tuple[str, ...] = (S.ID, S.TARGET, S.LABEL)) -> list[str]:
    return [name for name in df.columns if name not in exclude]


def fit_encoding(df: DataFrame, inputs: list[str] | None = None) -> Encoding:
    """Learn levels, means and population sigmas from ``df``.

    Two aggregates; what reaches the driver is one row of moments and the levels, which
    are as many as the encoded columns that the caller asks for.
    """
    inputs = feature_inputs(df) if inputs is None else inputs
    categoricals = [name for name in S.CATEGORICAL_COLUMNS if name in inputs]
    numerics = [name for name in S.NUMERIC_COLUMNS if name in inputs]
    passthrough = [name for name in inputs if name not in categoricals and name not in numerics]
    df = df.transform(fill_unknown)

    moments = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.avg(name).alias(f"mean_{name}") for name in numerics],
        *[F.stddev_pop(name).alias(f"sigma_{name}") for name in numerics],
    ).first()

    levels: dict[str, list[str]] = {name: [] for name in categoricals}
    if categoricals:
        pairs = [
            F.struct(F.lit(name).alias("name"), F.col(name).alias("level")) for name in categoricals
        ]
        for row in df.select(F.inline(F.array(*pairs))).distinct().collect():
            levels[row["name"]].append(row["level"])
    # The order of the JVM, which compares UTF-16 units.
    levels = {name: sorted(found, key=lambda v: v.encode("utf-16-be")) for name, found in levels.items()}

    columns = passthrough + numerics
    columns += [f"{name}_{level}" for name in categoricals for level in levels[name]]
    return Encoding(
        passthrough=passthrough,
        means={name: moments[f"mean_{name}"] for name in numerics},
        # A constant column is divided by 1.
        sigmas={name: moments[f"sigma_{name}"] or 1.0 for name in numerics},
        levels=levels,
        feature_columns=columns,
    )


def encoded_columns(df: DataFrame, encoding: Encoding) -> dict[str, Column]:
    """Every encoded column by name, in order: pass-through, scaled, one-hot.

    A pass-through column that the input lacks is 0.
    """
    columns = {
        name: F.col(name).cast("double") if name in df.columns else F.lit(0.0) for name in encoding.passthrough
    }
    for name, mean in encoding.means.items():
        columns[name] = (F.col(name).cast("double") - F.lit(mean)) / F.lit(encoding.sigmas[name])
    for name, levels in encoding.levels.items():
        value = F.coalesce(F.col(name), F.lit(UNKNOWN))
        for level in levels:
            columns[f"{name}_{level}"] = (value == level).cast("double")
    return columns


def apply_encoding(df: DataFrame, encoding: Encoding, keep: list[str] | None = None) -> DataFrame:
    """One projection: the ``keep`` columns, then the encoded columns in order.

    A level that was not seen in training gives zeros in all its columns.
    """
    encoded = encoded_columns(df, encoding)
    return df.select(*(keep or []), *[column.alias(name) for name, column in encoded.items()])


def encode_and_scale(
    df: DataFrame, encoding: Encoding | None = None, keep: list[str] | None = None
) -> tuple[DataFrame, Encoding]:
    """Fit when no encoding is given, then apply."""
    if encoding is None:
        encoding = fit_encoding(df, feature_inputs(df, (S.ID, S.TARGET, S.LABEL, *(keep or []))))
    return apply_encoding(df, encoding, keep), encoding


def align_columns(df: DataFrame, feature_columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """Exactly the given columns in the given order: absent ones are 0, others are dropped."""
    columns = [
        F.col(f"`{name}`").cast("double").alias(name) if name in df.columns else F.lit(0.0).alias(name)
        for name in feature_columns
    ]
    return df.select(*(keep or []), *columns)


def _level_table(spark: SparkSession, levels: dict[str, list[str]]) -> DataFrame:
    """The levels as a table, one column each, shorter columns repeating their first level."""
    rows = max(map(len, levels.values()))
    columns = [found + found[:1] * (rows - len(found)) for found in levels.values()]
    return spark.createDataFrame(list(zip(*columns)), list(levels))


def ml_stages(encoding: Encoding) -> list[Transformer]:
    """The encoding as fitted ML stages that produce the vector ``features``.

    The stages are fitted on the table of levels, so they take no pass over the data.
    Spark's own StandardScaler is not used: it divides by the sample sigma and maps a
    constant column to 0.
    """
    stages: list[Transformer] = []
    slots = [f"{name}__slots" for name in encoding.levels]
    if encoding.levels:
        codes = [f"{name}__code" for name in encoding.levels]
        levels = _level_table(SparkSession.active(), encoding.levels)
        indexer = StringIndexer(
            inputCols=list(encoding.levels),
            outputCols=codes,
            stringOrderType="alphabetAsc",
            handleInvalid="keep",
        ).fit(levels)
        # "keep" puts unseen levels in one extra slot; dropLast removes just that slot.
        one_hot = OneHotEncoder(inputCols=codes, outputCols=slots, dropLast=True)
        stages += [indexer, one_hot.fit(indexer.transform(levels))]
    scaled = [
        f"(({name}) - ({mean!r}D)) / ({encoding.sigmas[name]!r}D) AS {name}__scaled"
        for name, mean in encoding.means.items()
    ]
    if scaled:
        stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(scaled)} FROM __THIS__"))
    inputs = encoding.passthrough + [f"{name}__scaled" for name in encoding.means] + slots
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"))
    return stages
