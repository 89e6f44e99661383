"""The registered query over all kinds of models, on rows of its own."""

import numpy as np
import pandas as pd
import pytest

from fairspark.operators import models
from fairspark.plans import models_queries


class Asked(Exception):
    """Ends the query where it would fit."""


def test_every_kind_is_trained_in_full(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    line = {"l_orderkey": np.arange(300), "l_partkey": 1, "l_suppkey": 1, "l_linenumber": 1, "l_linestatus": "O"}
    numbers = {"l_quantity": rng.integers(1, 51, 300) * 1.0, "l_discount": rng.integers(0, 11, 300) / 100}
    priced = {"l_tax": rng.integers(0, 9, 300) / 100, "l_extendedprice": rng.integers(900, 95_000, 300) * 1.0}
    pd.DataFrame({**line, **numbers, **priced}).to_parquet(tmp_path / "lineitem.parquet")
    pd.DataFrame({"o_orderkey": np.arange(300), "o_orderpriority": "1-URGENT"}).to_parquet(tmp_path / "orders.parquet")

    def asked(rows, features, kinds):
        raise Asked(rows.count(), {kind: models.classifier(kind, 240, **settings) for kind, settings in kinds.items()})

    monkeypatch.setattr(models, "train_kinds", asked)
    with pytest.raises(Asked) as caught:
        models_queries.u2_kinds(spark, str(tmp_path))
    n_train, kinds = caught.value.args
    assert n_train == 240 and sorted(kinds) == ["gradient_boosting", "logistic_regression", "random_forest", "svm"]
    assert kinds["random_forest"].getNumTrees() == 100 and kinds["random_forest"].getSubsamplingRate() == 1
    assert (kinds["gradient_boosting"].getMaxIter(), kinds["gradient_boosting"].getMaxDepth()) == (100, 6)
    assert kinds["logistic_regression"].getMaxIter() == 1000 and kinds["svm"].getMaxIter() == 100
