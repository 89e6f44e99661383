"""Models and user-defined surfaces over orders joined with customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from fairspark.functions import sql_surface
from fairspark.functions.ordering import attach_row, row_index
from fairspark.operators import models
from fairspark.operators.prepare import stratified_split
from fairspark.plans import audit, views
from fairspark.plans.views import table
from fairspark.session import stored

FEATURES = ["f_quantity", "f_discount", "f_tax", "f_price"]


def _line_table(spark, sf):
    """Line items with features and a label that depends on them."""
    line, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    price = F.col("l_extendedprice") / F.lit(100000.0)
    return line.join(orders, line.l_orderkey == orders.o_orderkey).select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("row_id"),
        (price * (1 - F.col("l_discount")) + F.col("l_tax") > 0.45).cast("double").alias("y_true"),
        (F.col("l_quantity") / 50.0).alias("f_quantity"), (F.col("l_discount") * 10).alias("f_discount"),
        (F.col("l_tax") * 10).alias("f_tax"), price.alias("f_price"), "o_orderpriority", "l_linestatus",
    )


def _split(spark, sf):
    """Label, features and test flag of every line item, written once: training and scoring read them many times."""
    lines = _line_table(spark, sf).select("row_id", "y_true", *FEATURES)
    split = stratified_split(lines, "y_true", "row_id", once=True)
    return stored(split.select("y_true", *FEATURES, "is_test"), "split", models.ROWS_PER_FILE)


def f15(spark, sf):
    return audit.train_and_audit(_line_table(spark, sf), FEATURES, ["o_orderpriority", "l_linestatus"], "row_id")


def u1(spark, sf):
    model = models.LinearModel([1.5, -0.5, 0.25, 2.0], -1.75)
    scored = models.score_with(model, _line_table(spark, sf), FEATURES, ["row_id", "y_true"])
    return scored.select("row_id", "y_true", "y_pred", F.bround("y_prob", 6).alias("y_prob"))


def u2(spark, sf):
    split = _split(spark, sf)
    train, test = split.where(~F.col("is_test")), split.where("is_test")
    model = models.train(train, FEATURES, written=True)
    return models.train_test_accuracy(models.score(model, train, FEATURES), models.score(model, test, FEATURES))


#: Kinds with the settings that differ from the operator's own: none, the registered query trains each kind in full.
KINDS = {"logistic_regression": {}, "random_forest": {}, "gradient_boosting": {}, "svm": {}}


def u2_kinds(spark, sf):
    """Each kind of model fitted on the training rows: sizes, and whether it beats the larger class on the test rows."""
    split = _split(spark, sf)
    train, test = split.where(~F.col("is_test")), split.where("is_test")
    fitted = models.train_kinds(train, FEATURES, KINDS)
    scored = test.select("y_true", *FEATURES)
    for kind, model in fitted.items():
        scored = models.score(model, scored, FEATURES).drop("y_prob").withColumnRenamed("y_pred", kind)
    larger = F.greatest(F.avg("y_true"), 1 - F.avg("y_true"))
    right = [(F.avg((F.col(kind) == F.col("y_true")).cast("double")) > larger).alias(kind) for kind in KINDS]
    judged = scored.agg(F.count("*").alias("n_test"), *right)
    rows = judged.unpivot(["n_test"], list(KINDS), "kind", "beats_majority").select("kind", "n_test", "beats_majority")
    return attach_row(rows, train.agg(F.count("*").alias("n_train")))


def u3(spark, sf):
    df = _line_table(spark, sf)
    out = models.feature_importance(models.train(df, FEATURES), df, FEATURES)
    return out.select("feature", F.bround("importance", 4).alias("importance"), "importance_rank")


def u4(spark, sf):
    split = _split(spark, sf)
    model = models.train(split.where(~F.col("is_test")), FEATURES, written=True)
    return models.evaluate(models.score(model, split.where("is_test"), FEATURES))


def u5(spark, sf):
    """A user's metric: share of wrong decisions among the selected rows."""
    wrong = F.avg(F.when(F.col("y_pred") == 1, 1 - F.col("y_true")))
    metric = models.GroupMetric("false_discovery_rate", F.coalesce(wrong, F.lit(0.0)), 0.05)
    return metric.compute_for_all(views.decisions(spark, sf), views.ATTRIBUTES)


def u7(spark, sf):
    """Scalar and table functions from SQL: distances along the way between two embeddings."""
    sql_surface.register(spark)
    views.pairs(spark, sf).createOrReplaceTempView("fs_pairs")
    return spark.sql(
        """SELECT pair_id, step, bround(share * d, 6) AS distance, fs_bias_level(share * d) AS level, fs_bias_score(share * d) AS score
        FROM (SELECT pair_id, fs_cosine_distance(emb_a, emb_b) AS d FROM fs_pairs), LATERAL fs_steps(4)"""
    )


def u7_windows(spark, sf):
    """Row counts per sliding window through the table function."""
    sql_surface.register(spark)
    new = views.drift_long(spark, sf).where("side = 'new'")
    row_index(new, ["feature"], ["seq"], "rn").createOrReplaceTempView("fs_numbered")
    return spark.sql(
        "SELECT feature, window_id, count(*) AS n_rows FROM fs_numbered, LATERAL fs_window_ids(rn, 100, 50) GROUP BY feature, window_id"
    )


QUERIES = {
    "f15_train_and_audit": f15,
    "u1_batch_scoring": u1,
    "u2_train_classifier": u2,
    "u2_model_kinds": u2_kinds,
    "u3_feature_importance": u3,
    "u4_evaluate": u4,
    "u5_user_metric": u5,
    "u7_sql_functions": u7,
    "u7_window_function": u7_windows,
}
