"""Preprocessing for training and for scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ebbtide import schema as S
from ebbtide.operators.clean import clean_data, convert_types, with_label
from ebbtide.operators.encode import (
    Encoding,
    align_columns,
    apply_encoding,
    feature_inputs,
    fill_unknown,
    fit_encoding,
)
from ebbtide.operators.features import engineer_features
from ebbtide.sources.customers import save_processed


def prepare_training(raw: DataFrame) -> DataFrame:
    """Clean, type, label and engineer: id, label and the model inputs by name."""
    return (
        clean_data(raw)
        .transform(convert_types)
        .transform(engineer_features)
        .transform(with_label)
        .transform(fill_unknown)
    )


def prepare_scoring(raw: DataFrame) -> DataFrame:
    """The same row by row: no row is dropped and nothing is shuffled."""
    return (
        clean_data(raw, dedupe=False, drop_null_target=False)
        .transform(convert_types)
        .transform(engineer_features)
        .drop(S.TARGET)
        .transform(fill_unknown)
    )


def run_preprocessing(
    raw: DataFrame, encoding: Encoding | None = None, output: str | None = None
) -> tuple[DataFrame, Encoding]:
    """(encoded table with id and label, encoding); fits when no encoding is given.

    With ``output`` the feature columns are also written as parquet and CSV.
    """
    prepared = prepare_training(raw)
    if encoding is None:
        encoding = fit_encoding(prepared, feature_inputs(prepared))
    encoded = apply_encoding(prepared, encoding, [S.ID, S.LABEL])
    if output is not None:
        save_processed(encoded.drop(S.ID, S.LABEL), output)
    return encoded, encoding


def preprocess_input(raw: DataFrame, encoding: Encoding) -> DataFrame:
    """Encoded rows for scoring, aligned to the training columns, with the id if there is one."""
    keep = [S.ID] if S.ID in raw.columns else []
    encoded = apply_encoding(prepare_scoring(raw), encoding, keep)
    return align_columns(encoded, encoding.feature_columns, keep)
