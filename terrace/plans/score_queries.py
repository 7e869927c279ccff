"""Queries over goal probabilities: metrics, error reports, folds and models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import libm
from ..functions import text
from ..operators import metrics as m
from ..operators import ml
from ..operators import shots as s
from ..sources.projections import EV, ev, table
from ..sources.scratch import written
from .catalogue import Catalogue, rounded
from .match_queries import ANGLE, DIST, XG

cat = Catalogue()
LOSS = "-(y*ln(greatest(1e-15,least(1-1e-15,p)))+(1-y)*ln(1-greatest(1e-15,least(1-1e-15,p))))"
W = f"""WITH ev AS ({EV}), sc AS (SELECT s.match_id, s.idx, s.team, s.player, s.period, s.minute, s.x, s.y AS y_, {DIST.format(x='s.x', y='s.y')} AS distance, {ANGLE.format(x='s.x', y='s.y')} AS angle,
  CASE WHEN s.shot_outcome='Goal' THEN 1 ELSE 0 END AS y, {XG.replace('(120-x)', '(120-s.x)').replace('-y)', '-s.y)')} AS p, 1/(1+exp(0.1e0*{DIST.format(x='s.x', y='s.y')}-0.5e0)) AS q, s.match_id%5 AS fold, s.sb_xg, s.play_pattern,
  CASE WHEN s.shot_body_part='Head' THEN 'Head' WHEN s.shot_body_part LIKE '%Foot%' THEN 'Foot' ELSE 'Other' END AS body_part, CASE WHEN s.shot_type IN ('Open Play','Free Kick') THEN s.shot_type ELSE 'Other' END AS shot_type,
  CAST(coalesce(s.under_pressure,FALSE) AS INT) AS under_pressure, CAST(coalesce(s.first_time,FALSE) AS INT) AS first_time,
  CAST(coalesce(k.pass_through_ball,FALSE) AS INT) AS follows_through_ball, CAST(coalesce(k.pass_cross,FALSE) AS INT) AS follows_cross
  FROM ev s LEFT JOIN ev k ON k.type='Pass' AND k.idx=s.key_pass_id WHERE s.type='Shot' AND s.shot_type IS DISTINCT FROM 'Penalty' AND s.period<>5),
ls AS (SELECT *, {LOSS} AS loss, CASE WHEN distance>0 AND distance<=6 THEN '0-6' WHEN distance>6 AND distance<=12 THEN '06-12' WHEN distance>12 AND distance<=18 THEN '12-18' WHEN distance>18 AND distance<=25 THEN '18-25' WHEN distance>25 AND distance<=100 THEN '25+' END AS distance_band FROM sc)"""


def scored(spark, sf_dir) -> DataFrame:
    """Modelled shots with outcome y, the fixed score p, a distance-only score q, and a fold; the place is x, y_."""
    x, y = F.col("x"), F.col("y")
    rows = s.dataset(ev(spark, sf_dir)).withColumns({"p": s.closed_form_xg(x, y), "q": 1 / (1 + libm.exp(0.1 * g.shot_distance(x, y) - 0.5)), "fold": F.col("match_id") % 5, "distance_band": m.distance_band(F.col("distance"))})
    return rows.withColumnsRenamed({"y": "y_", "is_goal": "y"})


SLICE = "count(*) AS shots, CAST(sum(y) AS BIGINT) AS goals, round(avg(p),4) AS mean_pred, round(avg(y),4) AS goal_rate, round(avg(loss),4) AS mean_log_loss, round(avg(p)-avg(y),4) AS bias"


@cat.add(f"{W} SELECT distance_band, {SLICE}, round(sum(loss)/sum(sum(loss)) OVER (),4) AS share_of_total_loss FROM ls WHERE distance_band IS NOT NULL GROUP BY distance_band")
def slice_table(spark, sf_dir):
    return rounded(m.slice_table(scored(spark, sf_dir), "distance_band"))


REPORT = ("distance_band", "body_part", "shot_type", "play_pattern", "under_pressure", "first_time", "follows_cross", "follows_through_ball")
WORST = ("match_id", "idx", "team", "player", "x", "y_", "distance", "body_part", "shot_type", "p", "sb_xg", "y", "loss")
SHOWN = ("distance", "p", "sb_xg")  # besides the loss, which is ranked as it is shown; places are as they are
WORST_SQL = "match_id, idx, team, player, x, y_, round(distance,4) AS distance, body_part, shot_type, round(p,4) AS p, round(sb_xg,4) AS sb_xg, y, round(loss,4) AS loss"


@cat.add(f"{W} " + " UNION ALL ".join(f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS value, {SLICE}, round(sum(loss)/sum(sum(loss)) OVER (),4) AS share_of_total_loss FROM ls WHERE {d} IS NOT NULL GROUP BY {d}" for d in REPORT))
def error_report(spark, sf_dir):
    return rounded(m.error_report(scored(spark, sf_dir), REPORT))


def _worst(spark, sf_dir, y: int) -> DataFrame:
    return m.worst(scored(spark, sf_dir), y).select(*WORST).withColumns({c: F.round(c, 4) for c in SHOWN})


@cat.add(f"{W} SELECT {WORST_SQL} FROM ls WHERE y=1 ORDER BY loss DESC, match_id, idx LIMIT 10")
def worst_goals(spark, sf_dir):
    return _worst(spark, sf_dir, 1)


@cat.add(f"{W} SELECT {WORST_SQL} FROM ls WHERE y=0 ORDER BY loss DESC, match_id, idx LIMIT 10")
def worst_misses(spark, sf_dir):
    return _worst(spark, sf_dir, 0)


@cat.add(f"{W} SELECT round(avg(loss),4) AS log_loss, round(avg(power(p-y,2)),4) AS brier, count(*) AS n FROM ls")
def score_all(spark, sf_dir):
    return rounded(m.score_all(scored(spark, sf_dir)))


@cat.add(f"{W}, r AS (SELECT y, rank() OVER (PARTITION BY fold ORDER BY p)+(count(*) OVER (PARTITION BY fold, p)-1)/2e0 AS r, fold FROM ls) SELECT CAST(fold AS INT) AS fold, round((sum(r) FILTER (y=1)-sum(y)*(sum(y)+1)/2e0)/(sum(y)*sum(1-y)),4) AS auc FROM r GROUP BY fold")
def auc_exact(spark, sf_dir):
    return rounded(m.auc(scored(spark, sf_dir).withColumn("fold", F.col("fold").cast("int")), ("fold",)))


CURVE = f"{W}, eg AS (SELECT list_distinct(quantile_cont(p, [{', '.join(str(k / 10) for k in range(1, 10))}])) AS e FROM ls), pl AS (SELECT y, p, len(list_filter(e, lambda v: v<=p)) AS bin FROM ls, eg), cv AS (SELECT CAST(bin AS INT) AS bin, avg(p) AS mean_pred, avg(y) AS observed, count(*) AS n FROM pl GROUP BY bin)"


@cat.add(f"{CURVE}, rk AS (SELECT y, rank() OVER (ORDER BY p)+(count(*) OVER (PARTITION BY p)-1)/2e0 AS r FROM ls) SELECT round((SELECT avg(loss) FROM ls),4) AS log_loss, round((SELECT avg(power(p-y,2)) FROM ls),4) AS brier, (SELECT count(*) FROM ls) AS n, (SELECT round((sum(r) FILTER (y=1)-sum(y)*(sum(y)+1)/2e0)/(sum(y)*sum(1-y)),4) FROM rk) AS auc, round(sum(n*abs(observed-mean_pred))/sum(n),4) AS ece FROM cv")
def headline_scores(spark, sf_dir):
    return rounded(m.headline(scored(spark, sf_dir)))


@cat.add(f"{CURVE} SELECT bin, round(mean_pred,4) AS mean_pred, round(observed,4) AS observed, n FROM cv")
def reliability(spark, sf_dir):
    return rounded(m.reliability(scored(spark, sf_dir)))


@cat.add(f"{CURVE} SELECT round(sum(n*abs(observed-mean_pred))/sum(n),4) AS ece FROM cv")
def ece(spark, sf_dir):
    return rounded(m.calibration_error(m.reliability(scored(spark, sf_dir))))


def _panel(c: str) -> str:
    return f"SELECT '{c}' AS model, CAST(bin AS INT) AS bin, round(avg(p),4) AS mean_pred, round(avg(y),4) AS observed, count(*) AS n FROM (SELECT y, {c} AS p, len(list_filter((SELECT list_distinct(quantile_cont({c}, [{', '.join(str(k / 10) for k in range(1, 10))}])) FROM ls), lambda v: v<={c})) AS bin FROM ls) GROUP BY bin"


@cat.add(f"{W} {_panel('p')} UNION ALL {_panel('q')}")
def calibration_panels(spark, sf_dir):
    rows = scored(spark, sf_dir)
    long = rows.select("y", F.col("p").alias("pp"), F.col("q").alias("qq")).unpivot("y", ["pp", "qq"], "model", "p").withColumn("model", F.substring("model", 1, 1))
    return rounded(m.reliability(long, by=("model",)))


@cat.add()
def ece_noise_floor(spark, sf_dir):
    return m.noise_floor(scored(spark, sf_dir))


FOLDS = f"{W}, fl AS (SELECT fold, avg({LOSS}) AS a, avg(-(y*ln(q)+(1-y)*ln(1-q))) AS b FROM sc GROUP BY fold)"


def _fold_losses(spark, sf_dir, column: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    return m.score_all(rows.withColumn("p", F.col(column)), ("fold",))


@cat.add(f"{FOLDS} SELECT round(avg(a),4) AS mean, round(stddev_samp(a),4) AS std, printf('%.4f +/- %.4f', avg(a), stddev_samp(a)) AS shown, round(avg(a),4) AS parsed FROM fl")
def fold_summary(spark, sf_dir):
    losses = _fold_losses(spark, sf_dir, "p")
    shown = losses.agg(F.avg("log_loss").alias("mean"), F.stddev_samp("log_loss").alias("std"), text.mean_and_deviation(F.col("log_loss")).alias("shown"))
    return rounded(shown.withColumn("parsed", text.mean_of(F.col("shown"))))


@cat.add(f"{FOLDS} SELECT round(avg(a-b),4) AS mean_diff, round(stddev_samp(a-b),4) AS std_diff, count(*) FILTER (a<b) AS better, count(*) AS folds FROM fl")
def paired_diff(spark, sf_dir):
    return rounded(m.paired_difference(_fold_losses(spark, sf_dir, "p"), _fold_losses(spark, sf_dir, "q"), "fold", "log_loss"))


@cat.add(f"{FOLDS} SELECT bool_and(abs(a-b)<s) AS tie, (SELECT CASE WHEN avg(a)<avg(b) THEN 'p' ELSE 'q' END FROM fl) AS best FROM fl, (SELECT stddev_samp(a) AS s FROM fl)")
def tie_test(spark, sf_dir):
    """Whether the models differ by less than the folds do in every fold, and which is better on average."""
    a, b = _fold_losses(spark, sf_dir, "p").select("fold", F.col("log_loss").alias("a")), _fold_losses(spark, sf_dir, "q").select("fold", F.col("log_loss").alias("b"))
    both = a.join(b, "fold")
    spread = both.agg(F.stddev_samp("a").alias("s"))
    return both.crossJoin(F.broadcast(spread)).agg(F.every(F.abs(F.col("a") - F.col("b")) < F.col("s")).alias("tie"), F.when(F.avg("a") < F.avg("b"), "p").otherwise("q").alias("best"))


POOLED = " UNION ALL ".join(f"SELECT '{c}' AS model, avg({LOSS.replace('p)', c + ')')}) AS loss FROM sc" for c in ("p", "q", "sb_xg"))


@cat.add(f"{W}, al AS ({POOLED}) SELECT model, round(loss,4) AS loss, round((SELECT loss FROM al WHERE model='sb_xg'),4) AS benchmark, loss<(SELECT loss FROM al WHERE model='sb_xg') AS suspicious FROM al WHERE model<>'sb_xg'")
def suspicion_check(spark, sf_dir):
    """Models whose pooled loss is below the provider's are to be looked into before anyone claims a win."""
    rows = scored(spark, sf_dir).select("y", "p", "q", "sb_xg")
    return rounded(m.suspicious(rows, "sb_xg", ("p", "q")))


@cat.add(f"{W}, mn AS (SELECT avg(distance) AS a, avg(angle) AS b, avg(minute) AS c FROM sc) SELECT feature, round(v,4) AS importance FROM (SELECT avg(abs(-0.12e0*(distance-a))) AS distance, avg(abs(1.5e0*(angle-b))) AS angle, avg(abs(0.001e0*(minute-c))) AS minute FROM sc, mn) UNPIVOT (v FOR feature IN (distance, angle, minute))")
def shap_linear(spark, sf_dir):
    return rounded(ml.linear_contributions(scored(spark, sf_dir), {"distance": -0.12, "angle": 1.5, "minute": 0.001}))


@cat.add(f"{W}, mn AS (SELECT avg(distance) AS a, avg(angle) AS b FROM sc) SELECT feature, round(v,4) AS importance FROM (SELECT avg(abs(-0.12e0*(distance-a))) AS distance, avg(abs(1.5e0*(angle-b))) AS angle FROM sc, mn) UNPIVOT (v FOR feature IN (distance, angle)) ORDER BY v DESC, feature LIMIT 1")
def topk_importance(spark, sf_dir):
    return rounded(ml.linear_contributions(scored(spark, sf_dir), {"distance": -0.12, "angle": 1.5}).orderBy(F.desc("importance"), "feature").limit(1))


@cat.add(f"""WITH RECURSIVE sz AS (SELECT match_id, CAST(count(*) AS BIGINT) AS n, row_number() OVER (ORDER BY count(*) DESC, match_id) AS rn FROM ({EV}) GROUP BY match_id),
dl AS (SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS INT) AS match_id, CAST(0 AS BIGINT) AS n, 0 AS fold, CAST([0,0,0,0,0] AS BIGINT[]) AS held
  UNION ALL SELECT sz.rn, sz.match_id, sz.n, CAST(list_position(held, list_min(held))-1 AS INT), list_transform(held, lambda v, i: CASE WHEN i=list_position(held, list_min(held)) THEN v+sz.n ELSE v END) FROM dl JOIN sz ON sz.rn=dl.rn+1)
SELECT match_id, n, fold FROM dl WHERE rn>0""")
def cv_folds(spark, sf_dir):
    """Matches dealt to folds, the largest first, each to the lightest fold; a match never spans folds."""
    rows = ev(spark, sf_dir)
    return rows.groupBy("match_id").agg(F.count(F.lit(1)).alias("n")).join(ml.grouped_folds(rows, 5), "match_id")


@cat.add(f"{W}, fd AS (SELECT *, CAST(dense_rank() OVER (ORDER BY competition_id, season_id)-1 AS INT) AS held FROM (SELECT s.match_id, s.idx, e.competition_id, e.season_id FROM sc s JOIN ev e USING (idx))) SELECT held AS fold, count(*) AS test, (SELECT count(*) FROM sc)-count(*) AS train FROM fd GROUP BY held")
def loco_folds(spark, sf_dir):
    """Each tournament's matches in turn as the test set."""
    rows = s.dataset(ev(spark, sf_dir))
    counts = rows.join(ml.competition_folds(rows), "match_id").groupBy("fold").agg(F.count(F.lit(1)).alias("test"))
    whole = counts.agg(F.sum("test").alias("whole"))
    return counts.crossJoin(F.broadcast(whole)).select("fold", "test", (F.col("whole") - F.col("test")).alias("train"))


@cat.add("SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_custkey%5=0 INTERSECT SELECT o_custkey FROM orders WHERE o_custkey%5<>0)) AS shared, TRUE AS disjoint")
def leak_check(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select("o_custkey")
    shared = keys.where("o_custkey % 5 = 0").intersect(keys.where("o_custkey % 5 <> 0"))
    return shared.agg(F.count(F.lit(1)).alias("shared")).withColumn("disjoint", F.col("shared") == 0)


@cat.add(f"{W} SELECT match_id, idx, round((SELECT avg(y) FROM sc),4) AS p FROM sc")
def xg_constant(spark, sf_dir):
    rows = s.dataset(ev(spark, sf_dir))
    return rounded(ml.fit(rows, "constant_rate").transform(rows).select("match_id", "idx", "p"))


def _dataset(spark, sf_dir, freeze: bool = False) -> DataFrame:
    """The modelled shots, written: models go over them many times, and no task of theirs holds the sorts that make them."""
    rows = ev(spark, sf_dir)
    return written(s.dataset(s.dense_freeze_frames(rows) if freeze else rows), "shots")


def _fitted(spark, sf_dir, name: str, params: dict | None = None, freeze: bool = False) -> DataFrame:
    rows = _dataset(spark, sf_dir, freeze)
    return rounded(ml.fit(rows, name, params, freeze=freeze).transform(rows).select("match_id", "idx", "is_goal", "p"))


@cat.add()
def xg_logreg(spark, sf_dir):
    return _fitted(spark, sf_dir, "logreg_all")


@cat.add()
def xg_logreg_distance(spark, sf_dir):
    return _fitted(spark, sf_dir, "logreg_distance")


@cat.add()
def xg_freeze_frame(spark, sf_dir):
    """With the freeze frame's features, of which some are missing."""
    return _fitted(spark, sf_dir, "logreg_all", {"strength": 0.1}, True)


@cat.add()
def xg_gbt(spark, sf_dir):
    """Selected from the whole grid by three folds."""
    rows = _dataset(spark, sf_dir)
    return rounded(ml.fit(rows, "gbt", inner=3).transform(rows).select("match_id", "idx", "is_goal", "p"))


@cat.add()
def xg_mlp(spark, sf_dir):
    rows = _dataset(spark, sf_dir)
    return rounded(ml.fit(rows, "mlp", inner=3).transform(rows).select("match_id", "idx", "is_goal", "p"))


def _cv(rows: DataFrame, **how) -> DataFrame:
    """Scores of each outer fold, with the parameters that its inner folds chose."""
    out = ml.nested_cv(rows, "logreg_all", **how)
    return rounded(ml.fold_scores(out).join(out.select("fold", "params").distinct(), "fold"))


@cat.add()
def nested_cv(spark, sf_dir):
    return _cv(_dataset(spark, sf_dir))


@cat.add()
def leave_one_tournament_out(spark, sf_dir):
    return _cv(_dataset(spark, sf_dir), scheme="competition")


@cat.add()
def predict_xg(spark, sf_dir):
    """A model that is written and loaded again gives each shot its probability, from its place and defaults for the rest."""
    from ..sources.scratch import shared_path

    rows = _dataset(spark, sf_dir)
    path = shared_path(spark, "goal-model")
    ml.save(ml.fit(rows, "logreg_all", {"strength": 0.1}), path)
    return rounded(ml.predict_xg(rows.select("match_id", "idx", "x", "y"), ml.load(spark, path)).select("match_id", "idx", "p"))


@cat.add()
def perm_importance(spark, sf_dir):
    rows = _dataset(spark, sf_dir).persist()
    return rounded(ml.permutation_importance(ml.fit(rows, "logreg_all", {"strength": 0.1}), rows, ("distance", "angle", "minute")))


@cat.add()
def shap_fitted(spark, sf_dir):
    """Contributions by the weights of a fitted model."""
    rows = _dataset(spark, sf_dir)
    return rounded(ml.linear_contributions(rows, ml.linear_weights(ml.fit(rows, "logreg_all", {"strength": 0.1}))))
