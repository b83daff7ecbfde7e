"""The forest against a walk over its stored nodes, and over layouts of its input."""

from __future__ import annotations

import random

import numpy as np
import pytest

from fixweave.operators import model

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = []
    for i in range(400):
        a, b, c, d = rng.randrange(2), rng.randrange(40), rng.random(), rng.randrange(3)
        data.append((i, a, b, c, d, int((a and b > 11) or (c > 0.8 and rng.random() < 0.9))))
    return spark.createDataFrame(data, "id int, a int, b int, c double, d int, label int").cache()


@pytest.fixture(scope="module")
def fitted(rows):
    return model.train_forest(rows, FEATURES, num_trees=15, max_depth=6, key=["id"], partitions=3)


def stored_trees(spark, fitted, folder):
    """Nodes by tree and id, as the model is written to disk."""
    fitted.stages[-1].write().save(folder)
    trees: dict[int, dict[int, object]] = {}
    for row in spark.read.parquet(f"{folder}/data").collect():
        trees.setdefault(row["treeID"], {})[row["nodeData"]["id"]] = row["nodeData"]
    return trees


def leaf(tree, values):
    node = tree[0]
    while node["leftChild"] >= 0:
        split = node["split"]
        assert split["numCategories"] == -1
        left = values[split["featureIndex"]] <= split["leftCategoriesOrThreshold"][0]
        node = tree[node["leftChild"] if left else node["rightChild"]]
    return node


def test_predictions_and_importances_by_hand(spark, rows, fitted, tmp_path):
    trees = stored_trees(spark, fitted, str(tmp_path / "forest"))
    assert len(trees) == 15
    for row in model.predict(fitted, rows).collect():
        votes = sum(np.array(s) / sum(s) for s in (leaf(t, [row[f] for f in FEATURES])["impurityStats"] for t in trees.values()))
        assert row["prediction"] == float(np.argmax(votes))
    total = np.zeros(len(FEATURES))
    for tree in trees.values():
        own = np.zeros(len(FEATURES))
        for node in tree.values():
            if node["leftChild"] >= 0:
                own[node["split"]["featureIndex"]] += node["gain"] * sum(node["impurityStats"])
        total += own / own.sum() if own.sum() else own
    expected = dict(zip(FEATURES, total / total.sum()))
    found = model.feature_importance(spark, fitted, FEATURES).collect()
    assert {r["feature"]: pytest.approx(r["importance"], rel=1e-9) for r in found} == expected
    assert [r["importance"] for r in found] == pytest.approx(sorted(expected.values(), reverse=True))


def test_the_forest_does_not_depend_on_the_layout_of_its_rows(rows, fitted):
    again = [
        model.train_forest(df, FEATURES, num_trees=15, max_depth=6, key=["id"], partitions=3)
        for df in (rows.repartition(1), rows.repartition(7), rows.orderBy("c"))
    ]
    trees = fitted.stages[-1].toDebugString.split("\n", 1)[1]
    assert all(m.stages[-1].toDebugString.split("\n", 1)[1] == trees for m in again)


def test_the_forest_beats_the_larger_class(rows, fitted):
    share = rows.where("label = 1").count() / rows.count()
    assert model.accuracy(model.predict(fitted, rows)).first()[0] > max(share, 1 - share) + 0.1
