"""Composed audits: precomputed predictions (F14) and train-then-audit (F15)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairspark.functions.numeric import r6
from fairspark.operators import fairness as fair
from fairspark.session import materialise, stored


def full_audit(
    df: DataFrame,
    attributes: Sequence[str],
    score_col: str = "y_pred",
    include_subgroups: bool = True,
) -> DataFrame:
    """All metrics, the report, intersectional subgroups and accuracy as typed rows.

    ``section`` tells what a row is: ``metric`` (per attribute and metric),
    ``report`` (per attribute), ``subgroup`` (per intersection) or ``accuracy``.
    The decisions are scanned and shuffled once into the cell table, which is written to
    the checkpoint folder and read by all sections.
    """
    cells = materialise(fair.cell_sums(df, attributes, score_col))
    long = fair.long_cells(cells, attributes)
    results = fair.default_suite().compute_all(long, written=True)
    report = fair.bias_report(results)
    null = F.lit(None)

    def rows(section, source, subject, detail, value, count, ok):
        return source.select(
            F.lit(section).alias("section"), subject.alias("subject"), detail.cast("string").alias("detail"),
            value.cast("double").alias("value"), count.cast("bigint").alias("n"), ok.cast("boolean").alias("ok"),
        )

    c = F.col
    out = rows("metric", results, c("attribute"), c("metric"), c("gap"), c("n_groups"), c("is_fair"))
    out = out.unionByName(rows("report", report, c("attribute"), c("recommendation"), c("worst_gap"), c("n_findings"), ~c("is_biased")))
    if include_subgroups and len(attributes) >= 2:
        sub = fair.intersectional_from_cells(cells, attributes)
        out = out.unionByName(rows("subgroup", sub, c("subgroup"), c("reason"), c("positive_rate"), c("sample_size"), null))
        out = out.unionByName(rows("subgroup_accuracy", sub, c("subgroup"), c("reason"), c("accuracy"), c("sample_size"), null))
    total = cells.agg(F.sum("n").alias("n"), r6(F.sum("correct") / F.sum("n")).alias("accuracy"))
    return out.unionByName(rows("accuracy", total, F.lit("overall"), null, c("accuracy"), c("n"), null))


def train_and_audit(
    df: DataFrame,
    features: Sequence[str],
    attributes: Sequence[str],
    id_col: str,
    kind: str = "logistic_regression",
    test_fraction: float = 0.2,
    seed: int = 42,
) -> DataFrame:
    """Stratified split, train, predict the test rows, audit them.

    The split is a stable function of the row id; it is written once to the shared scratch area
    with the columns that training and audit need, because training reads it several times.
    """
    from fairspark.operators import models
    from fairspark.operators.prepare import stratified_split

    marked = stratified_split(df, "y_true", id_col, test_fraction, seed)
    split = stored(marked.select(*dict.fromkeys(["y_true", *features, *attributes]), "is_test"), "split")
    model = models.train(split.where(~F.col("is_test")), features, kind, written=True)
    # The audit reads the scored rows once, into its cell table.
    return full_audit(models.score(model, split.where("is_test"), features), attributes)
