"""Registered queries against their SQL on the smallest tables, and properties of the models."""

import os
import random

import duckdb
import pytest

import __spark_entry__ as entry
from terrace.operators import ml
from terrace.operators import shots as s
from terrace.sources.projections import ev

SF = "/root/testdata/sf0.001"
OWN = {k: q for c in entry.CATALOGUES for k, q in c.queries.items()}
SQL = {k: q for c in entry.CATALOGUES for k, q in c.sql.items()}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are elsewhere")


def comparable(value):
    return None if value is None else round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = OWN[name](spark, SF)
    rel = duck.sql(SQL[name])
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    got = sorted((tuple(comparable(r[n]) for n in names) for r in df.collect()), key=str)
    at = [rel.columns.index(n) for n in names]
    assert got == sorted((tuple(comparable(r[i]) for i in at) for r in rel.fetchall()), key=str)


def test_every_query_has_a_name_of_its_own():
    assert sum(len(c.queries) for c in entry.CATALOGUES) == len(OWN) and set(SQL) <= set(OWN)


@pytest.mark.parametrize("name", ["worst_goals", "worst_misses"])
def test_worst_shots_are_ranked_by_the_loss_that_is_shown(spark, tmp_path, name):
    """SQL's ORDER BY loss means its rounded column, so that mirrored places, whose losses differ in the last bit, tie and go by match and event."""
    rng = random.Random(name)
    k, value, places = (0, 101.5, [at for j in range(6, 18) for at in (j, 800 - j)]) if name == "worst_goals" else (97, 1.5, [400 + j for j in range(-12, 13)])
    numbers = [n for at in places for n in rng.sample([n for n in range(at * pow(17, -1, 801) % 801, 10**6, 801) if n % 20], 3)]
    duck = duckdb.connect()
    duck.execute(f"CREATE TABLE events AS SELECT n AS event_id, TIMESTAMP '2024-01-01 00:00:11' AS ts, n AS user_id, 'purchase' AS event_type, {value}::DOUBLE AS value, 'k: {k}' AS props FROM (SELECT unnest({numbers}::BIGINT[]) AS n)")
    duck.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    assert [tuple(r) for r in OWN[name](spark, str(tmp_path)).collect()] == duck.execute(SQL[name]).fetchall()


def test_models(spark):
    rows = s.dataset(ev(spark, SF)).persist()
    folds = ml.grouped_folds(rows, 3)
    assert folds.count() == rows.select("match_id").distinct().count() and folds.select("fold").distinct().count() <= 3
    model = ml.fit(rows, "logreg_distance")
    near, far = (ml.predict_xg(spark.createDataFrame([(120.0 - d, 40.0, 99.0)], "x double, y double, distance double"), model).first()["p"] for d in (5, 40))
    assert 0 < far < 1 and 0 < near < 1 and near != far  # the distance comes from the place, not from the row
    oof = ml.nested_cv(rows, "constant_rate", 3)
    assert oof.count() == rows.count() and oof.select("fold", "p").distinct().count() <= 3
    by_tournament = ml.nested_cv(rows, "constant_rate", scheme="competition")
    assert by_tournament.count() == rows.count() and by_tournament.select("fold").distinct().count() == rows.select("competition_id", "season_id").distinct().count()


def test_parameters_are_selected_inside_each_fold(spark, monkeypatch):
    rows = s.dataset(ev(spark, SF)).persist()
    seen = []
    select = ml.select

    def watched(train, *args):
        seen.append({r["match_id"] for r in train.select("match_id").distinct().collect()})
        return select(train, *args)

    monkeypatch.setattr(ml, "select", watched)
    monkeypatch.setitem(ml.GRIDS, "logreg_all", [{"strength": 1e-6}, {"strength": 1.0}])
    oof = ml.nested_cv(rows, "logreg_all", 2)
    tested = {r["fold"]: set(r["m"]) for r in oof.groupBy("fold").agg({"match_id": "collect_set"}).toDF("fold", "m").collect()}
    assert len(seen) == 2 and all(not seen[f] & tested[f] for f in tested)
    assert {r["params"] for r in oof.select("params").distinct().collect()} <= {'{"strength": 1e-06}', '{"strength": 1.0}'}


def test_every_grid_fits(spark):
    rows = s.dataset(s.dense_freeze_frames(ev(spark, SF))).persist()
    for name, params in (("gbt", {"depth": 2, "leaf": 5, "rounds": 2}), ("mlp", {"hidden": [4, 3], "iterations": 3}), ("logreg_all", {"strength": 1.0})):
        model = ml.fit(rows, name, params, freeze=True)
        assert 0 < model.transform(rows).selectExpr("avg(p)").first()[0] < 1 and {"ff_gk_distance"} <= set(model.scaler.columns)


def test_a_column_that_is_constant_within_matches_can_be_important(spark):
    made = spark.range(2000).selectExpr("id AS idx", "id % 20 AS match_id", "CAST(id % 20 < 10 AS INT) AS is_goal", "CAST(id % 20 < 10 AS DOUBLE) AS distance", "CAST(0 AS INT) AS fold")
    model = ml.fit(made, "logreg_distance")
    dealt = ml.shuffled(made, "distance", 1)
    assert dealt.count() == 2000 and dealt.agg({"distance": "sum"}).first()[0] == 1000 and dealt.columns == made.columns
    assert 800 < dealt.where("distance = is_goal").count() < 1200
    assert ml.permutation_importance(model, made, ("distance",), repeats=2).first()["increase"] > 0.5


def test_models_read_written_shots(spark):
    """Models go over the shots many times: none of these passes may sort the events anew."""
    from terrace.plans import score_queries

    assert "Window" not in score_queries._dataset(spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_rounds_of_one_kind_of_tree_are_one_fit(spark, monkeypatch):
    rows = s.dataset(ev(spark, SF)).persist()
    grid = [{"depth": d, "leaf": 5, "rounds": r} for d in (2, 3) for r in (2, 5)]
    fitted, fit = [], ml.Prepared.fitted
    monkeypatch.setattr(ml.Prepared, "fitted", lambda self, params, seed=42: fitted.append(params["rounds"]) or fit(self, params, seed))
    chosen = ml.select(rows, "gbt", grid, 2)
    assert fitted == [5] * 4
    # Each fitted by itself, as a plain loop.
    folded, losses = rows.join(ml.grouped_folds(rows, 2), "match_id").persist(), []
    for params in grid:
        of = [ml.metrics.score_all(ml.fit_with(folded.where(f"fold <> {k}"), "gbt", params).transform(folded.where(f"fold = {k}")).withColumn("y", ml.F.col("is_goal"))).first()["log_loss"] for k in (0, 1)]
        losses.append(sum(of) / 2)
    assert chosen == grid[losses.index(min(losses))]
