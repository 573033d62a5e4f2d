"""The forest and the boosting rounds run whole: all trees, all rounds until patience ends."""

import random

import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.sql import functions as F

from clickloom import catalog
from clickloom.catalog import models as C
from clickloom.plans import models as M

catalog.load()


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [(d, a, int(a == d % 3), "train" if d % 5 else "valid", float(rng.random() + (a == d % 3)), float(a)) for d in range(90) for a in range(3)]
    return spark.createDataFrame(data, "display_id long, ad_id long, clicked int, part string, x double, y double").cache()


def settings(monkeypatch, kind, name, rows):
    """The parameters of the fits that a query makes, which are not carried out."""
    seen = []

    class Stop(Exception):
        pass

    def fit(self, df, params=None):
        seen.append({p.name: v for p, v in self.extractParamMap().items()})
        raise Stop

    wide = rows.withColumns({c: F.lit(1.0) for c in C.FEATURES})
    monkeypatch.setattr(C, "training_rows", lambda v: wide)
    monkeypatch.setattr(kind, "fit", fit)
    with pytest.raises(Stop):
        catalog.QUERIES[name](rows.sparkSession, "/nowhere")
    return seen


def test_the_forest_query_grows_the_published_trees(monkeypatch, rows):
    """Eight trees of depth 4 before."""
    asked = []
    whole = M.forest_scores
    monkeypatch.setattr(M, "forest_scores", lambda *a, **k: asked.append(k.get("trees", M.FOREST["numTrees"])) or whole(*a, **k))
    got = settings(monkeypatch, RandomForestClassifier, "mdl_forest", rows)
    assert asked == [1000] and (got[0]["maxDepth"], got[0]["numTrees"], got[0]["subsamplingRate"]) == (15, 1000, 0.75)


def test_many_rows_grow_fewer_trees_at_once(monkeypatch, rows):
    asked = []
    monkeypatch.setattr(M, "ROW_TREES", 0)
    monkeypatch.setattr(M, "TREES_AT_ONCE", 2)

    def make(**params):
        asked.append(params["numTrees"])
        return M.forest(["x", "y"], **{"maxDepth": 2, **params})

    assert M.forest_scores(rows, rows, make, ["display_id"], trees=5).count() == 270 and asked[2:] == [2, 2, 1]


def test_the_rounds_query_fits_the_published_rounds(monkeypatch, rows):
    """At most 40 of depth 3 before, ended by a tolerance after two."""
    got = settings(monkeypatch, GBTClassifier, "mdl_rounds_by_cv", rows)
    assert {(g["maxIter"], g["maxDepth"], g["stepSize"], "validationIndicatorCol" in g) for g in got} == {(200, 14, 0.07, False)}


def test_parts_of_a_forest_are_one_forest(rows):
    """All trees vote, each part with its own seed, and no table of votes but the last is left."""
    seeds = []

    def make(**params):
        seeds.append((params["numTrees"], params["seed"]))
        return M.forest(["x", "y"], **{"maxDepth": 3, **params})

    got = M.forest_scores(rows, rows, make, ["display_id", "ad_id", "clicked"], trees=7, at_once=3, seed=5)
    assert seeds[2:] == [(3, 5), (3, 6), (1, 7)]
    parts = [M.score(make(numTrees=n, seed=s).fit(rows), rows, ["display_id", "ad_id"], f"p{s}") for n, s in seeds[2:]]
    want = parts[0].join(parts[1], ["display_id", "ad_id"]).join(parts[2], ["display_id", "ad_id"])
    mean = {(r["display_id"], r["ad_id"]): (3 * r["p5"] + 3 * r["p6"] + r["p7"]) / 7 for r in want.collect()}
    assert got.count() == 270 and all(r["prob"] == pytest.approx(mean[r["display_id"], r["ad_id"]]) for r in got.collect())


@pytest.mark.parametrize("patience", [2, 50])
def test_rounds_come_out_the_same_in_any_blocks(rows, patience):
    def run(at_once):
        return M.rounds_by_cv(
            rows, "display_id", "ad_id", lambda: M.boosting(["x", "y"], maxIter=9, maxDepth=3, stepSize=0.3), folds=3,
            patience=patience, at_once=at_once,
        ).collect()

    whole, cut = run(9), run(2)
    assert [r["round"] for r in whole] == [r["round"] for r in cut] == list(range(1, len(whole) + 1))
    assert len(whole) == 9 if patience == 50 else len(whole) < 9
    for a, b in zip(whole, cut, strict=True):
        assert tuple(a)[1:4] == pytest.approx(tuple(b)[1:4]) and tuple(a)[4:] == tuple(b)[4:]
