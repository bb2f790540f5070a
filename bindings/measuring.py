"""Scalers, metrics, ensembles, and metric series."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import query
from bindings.tables import DIGITS, MEASURED_EVENTS, PREDICTIONS, measured_events, metrics_sql, predictions, rounded, table
from solvane.operators import metrics, ranking, scaling, series
from solvane.operators.clean import present


@query("a1_mean_and_std", f"with {MEASURED_EVENTS} select round(avg(pce), 6) as mean, round(stddev_pop(pce), 6) as std from measured where not isnan(pce)")
def a1(spark, folder):
    return rounded(scaling.mean_and_std(measured_events(spark, folder), "pce"))


@query(
    "a3_profile",
    f"""with {MEASURED_EVENTS} select count(*) as rows, count(*) filter (where pce is not null and not isnan(pce)) as measured,
    count(distinct event_type) as types, count(distinct user_id) as users, count(*) filter (where event_type = 'click') as clicks from measured""",
)
def a3(spark, folder):
    return measured_events(spark, folder).agg(
        F.count("*").alias("rows"), F.count_if(present("pce")).alias("measured"), F.count_distinct("event_type").alias("types"),
        F.count_distinct("user_id").alias("users"), F.count_if(F.col("event_type") == "click").alias("clicks"),
    )


@query("a4_metrics_by_phase", f"with {PREDICTIONS} select phase, {metrics_sql('measured', 'predicted')} from predictions group by phase")
def a4(spark, folder):
    return rounded(metrics.metrics_by(predictions(spark, folder), ["phase"]), DIGITS)


@query("a4_metrics_by_phase_and_fold", f"with {PREDICTIONS} select phase, fold, {metrics_sql('measured', 'predicted')} from predictions group by phase, fold")
def a4_fold(spark, folder):
    return rounded(metrics.metrics_by(predictions(spark, folder), ["phase", "fold"]), DIGITS)


@query(
    "a5_accuracy",
    "select l_linenumber, round(avg((l_returnflag = case when l_quantity < 17 then 'A' when l_quantity < 34 then 'N' else 'R' end)::int::double), 6) as accuracy from lineitem group by 1",
)
def a5(spark, folder):
    guess = F.when(F.col("l_quantity") < 17, "A").when(F.col("l_quantity") < 34, "N").otherwise("R")
    return rounded(table(spark, folder, "lineitem").groupBy("l_linenumber").agg(metrics.accuracy("l_returnflag", guess)))


def model_predictions(spark, folder):
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", F.col("value").alias("measured"))
    models = events.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(2))))
    guess = F.col("measured") * (0.9 + F.col("model") * 0.05) + F.col("user_id") % 7
    return models.select(F.col("event_id").alias("row_id"), "event_type", "model", "measured", guess.alias("predicted"))


MODEL_PREDICTIONS = """models as (
  select event_id as row_id, event_type, model, value as measured, value * (0.9::double + model * 0.05::double) + user_id % 7 as predicted
  from events, (select unnest([0, 1, 2]) as model))"""


@query(
    "a6_ensemble",
    f"""with {MODEL_PREDICTIONS},
    single as (select avg(mse) as mean_mse from (select model, avg((measured - predicted) * (measured - predicted)) as mse from models group by model)),
    means as (select row_id, any_value(measured) as measured, avg(predicted) as predicted from models group by row_id)
    select {metrics_sql('measured', 'predicted')}, (select round(mean_mse, 6) from single) as mean_mse from means""",
)
def a6(spark, folder):
    return rounded(metrics.ensemble_metrics(model_predictions(spark, folder)), DIGITS)


@query(
    "a6_ensemble_by_type",
    f"""with {MODEL_PREDICTIONS},
    single as (select event_type, avg(mse) as mean_mse from (select event_type, model, avg((measured - predicted) * (measured - predicted)) as mse from models group by 1, 2) group by 1),
    means as (select event_type, row_id, any_value(measured) as measured, avg(predicted) as predicted from models group by 1, 2)
    select event_type, {metrics_sql('measured', 'predicted')}, round(any_value(mean_mse), 6) as mean_mse from means join single using (event_type) group by event_type""",
)
def a6_type(spark, folder):
    return rounded(metrics.ensemble_metrics(model_predictions(spark, folder), groups=["event_type"]), DIGITS)


@query(
    "a7_fold_summary",
    f"""with {PREDICTIONS}, s as (select epoch as trial, phase, fold, avg((measured - predicted) * (measured - predicted)) as score from predictions group by 1, 2, 3)
    select trial, phase, round(avg(score), 5) as mean, round(stddev_pop(score), 5) as std, round(var_pop(score), 4) as var, count(*) as folds from s group by 1, 2""",
)
def a7(spark, folder):
    scored = metrics.metrics_by(predictions(spark, folder).withColumnRenamed("epoch", "trial"), ["trial", "phase", "fold"])
    return rounded(metrics.fold_summary(scored, ["trial", "phase"], "mse"), {"mean": 5, "std": 5, "var": 4})


@query(
    "a10_dimension_statistics",
    """with l as (select unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as dim from embeddings)
    select dim::int as dim, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std from l group by dim""",
)
def a10_statistics(spark, folder):
    return rounded(scaling.dimension_statistics(table(spark, folder, "embeddings"), "embedding"))


@query(
    "a10_standardise_vectors",
    """with l as (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as dim from embeddings),
    s as (select dim, avg(v) as mean, stddev_pop(v) as std from l group by dim)
    select vec_id, l.dim::int as dim, round((v - mean) / std, 5) + 0.0 as value from l join s on l.dim = s.dim""",
)
def a10(spark, folder):
    scaled = scaling.standardise_vectors(table(spark, folder, "embeddings"), "embedding", "scaled")
    return rounded(scaled.select("vec_id", F.posexplode("scaled").alias("dim", "value")), 5)


@query(
    "a10_scale_columns",
    """with s as (select avg(l_quantity) as qm, stddev_pop(l_quantity) as qs, avg(l_tax) as tm, stddev_pop(l_tax) as ts from lineitem)
    select l_returnflag, round(sum(abs((l_quantity - qm) / qs)), 5) as quantity, round(sum(abs((l_tax - tm) / ts)), 5) as tax from lineitem, s group by 1""",
)
def a10_columns(spark, folder):
    scaled = scaling.scale_columns(table(spark, folder, "lineitem").select("l_returnflag", "l_quantity", "l_tax"), ["l_quantity", "l_tax"])
    return rounded(scaled.groupBy("l_returnflag").agg(F.sum(F.abs("l_quantity")).alias("quantity"), F.sum(F.abs("l_tax")).alias("tax")), 5)


CORRELATED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "a11_correlation_matrix",
    " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 2) + 0.0 as corr from lineitem" for a in CORRELATED for b in CORRELATED),
)
def a11(spark, folder):
    matrix = metrics.correlation_matrix(table(spark, folder, "lineitem"), CORRELATED)
    return matrix.withColumn("corr", F.col("corr") + 0.0)


@query(
    "a12_regression_line",
    f"""with {PREDICTIONS} select phase, round(regr_slope(predicted, measured), 6) as slope, round(regr_intercept(predicted, measured), 6) as intercept,
    round(corr(predicted, measured), 6) as r,
    round(sqrt((1 - corr(predicted, measured) ** 2) * var_pop(predicted) / var_pop(measured) / (count(*) - 2)), 6) as stderr
    from predictions group by phase""",
)
def a12(spark, folder):
    return rounded(predictions(spark, folder).groupBy("phase").agg(*metrics.regression_line("measured", "predicted")))


@query(
    "a13_axis_range",
    f"with {PREDICTIONS} select round(least(min(measured), min(predicted)), 6) as low, round(greatest(max(measured), max(predicted)), 6) as high from predictions",
)
def a13(spark, folder):
    return rounded(predictions(spark, folder).agg(*metrics.axis_range("measured", "predicted")))


SCORES = f"{PREDICTIONS}, z as (select *, (measured - 30) / 20 as y, (predicted - 30) / 20 as p from predictions)"
INVERSE = scaling.Scaler(30.0, 20.0).inverse


def scores(spark, folder):
    z = scaling.Scaler(30.0, 20.0).forward
    return predictions(spark, folder).withColumns({"y": z("measured"), "p": z("predicted")})


@query(
    "a14_batch_metrics",
    f"""with {SCORES} select epoch, batch, round(avg(((y * 20 + 30) - (p * 20 + 30)) ** 2), 5) as mse, round(avg(abs((y * 20 + 30) - (p * 20 + 30))), 6) as mae,
    round(avg((y - p) ** 2), 6) as loss_z, count(*) as count from z group by 1, 2""",
)
def a14(spark, folder):
    return rounded(metrics.batch_metrics(scores(spark, folder), ["epoch", "batch"], "y", "p", INVERSE), DIGITS)


@query(
    "a15_epoch_metrics",
    f"with {SCORES} select phase, epoch, round(avg((y - p) ** 2), 6) as loss, {metrics_sql('(y * 20 + 30)', '(p * 20 + 30)')} from z group by 1, 2",
)
def a15(spark, folder):
    return rounded(metrics.epoch_metrics(scores(spark, folder), ["phase", "epoch"], "y", "p", INVERSE), DIGITS)


@query(
    "a16_mean_of_batch_accuracies",
    """with b as (select l_linenumber, l_orderkey % 50 as batch, avg((l_returnflag = case when l_discount < 0.04 then 'A' else 'N' end)::int::double) as a from lineitem group by 1, 2)
    select l_linenumber, round(avg(a), 6) as accuracy, count(*) as batches from b group by 1""",
)
def a16(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_linenumber", "l_returnflag", (F.col("l_orderkey") % 50).alias("batch"), F.when(F.col("l_discount") < 0.04, "A").otherwise("N").alias("guess")
    )
    return rounded(metrics.mean_of_batch_accuracies(lines, "l_linenumber", "batch", "l_returnflag", "guess"))


# Metric series: the trial is the user, the epoch the position of the event.
LOG = "log as (select user_id as trial, row_number() over (partition by user_id order by event_id) - 1 as epoch, value from events)"


def metric_log(spark, folder):
    events = table(spark, folder, "events").select(F.col("user_id").alias("trial"), "event_id", "value")
    return ranking.series_position(events, "trial", ["event_id"], "epoch").drop("event_id")


@query("w5_series_position", f"with {LOG} select trial, epoch, value from log")
def series_position(spark, folder):
    return metric_log(spark, folder)


def stopping_sql(patience: int, min_delta: float, sign: int) -> str:
    return f"""with recursive {LOG},
    scan as (
      select trial, 0::bigint as epoch, {sign} * value as best, 0::bigint as best_epoch, null::bigint as stop_epoch from log where epoch = 0
      union all
      select s.trial, l.epoch,
             case when s.stop_epoch is null and {sign} * l.value + {min_delta} < s.best then {sign} * l.value else s.best end,
             case when s.stop_epoch is null and {sign} * l.value + {min_delta} < s.best then l.epoch else s.best_epoch end,
             case when s.stop_epoch is not null then s.stop_epoch
                  when not ({sign} * l.value + {min_delta} < s.best) and l.epoch - s.best_epoch >= {patience} then l.epoch end
      from scan s join log l on l.trial = s.trial and l.epoch = s.epoch + 1)
    select trial, {sign} * arg_max(best, epoch) as score, arg_max(best_epoch, epoch) as best_epoch, max(stop_epoch) as stop_epoch from scan group by trial"""


@query("w5_early_stopping", stopping_sql(8, 0.0, 1))
def w5(spark, folder):
    return series.early_stopping(metric_log(spark, folder), "trial", "epoch", "value", 8)


@query("w5_early_stopping_min_delta", stopping_sql(10, 5.0, 1))
def w5_delta(spark, folder):
    return series.early_stopping(metric_log(spark, folder), "trial", "epoch", "value", 10, 5.0)


@query("w5_early_stopping_maximise", stopping_sql(6, 1.0, -1))
def w5_max(spark, folder):
    return series.early_stopping(metric_log(spark, folder), "trial", "epoch", "value", 6, 1.0, "max")


@query("w5_last_value", f"with {LOG} select trial, arg_max(value, epoch) as score, null::bigint as best_epoch, null::bigint as stop_epoch from log group by trial")
def w5_last(spark, folder):
    return series.early_stopping(metric_log(spark, folder), "trial", "epoch", "value", 0)


@query(
    "w6_best_checkpoint",
    f"""with {LOG}, r as (select *, row_number() over (partition by trial order by value, epoch) as nth from log),
    l as (select trial, max(epoch) as last_epoch, arg_max(value, epoch) as last_value from log group by trial)
    select trial, epoch as best_epoch, value as best_value, last_epoch, last_value from r join l using (trial) where nth = 1""",
)
def w6(spark, folder):
    return series.best_checkpoint(metric_log(spark, folder), "trial", "epoch", "value")


@query(
    "f4_inverse_callable",
    f"with {SCORES} select phase, round(avg((y - p) ** 2), 6) as loss, {metrics_sql('exp(y)', 'exp(p)')} from z group by phase",
)
def f4(spark, folder):
    return rounded(metrics.epoch_metrics(scores(spark, folder), ["phase"], "y", "p", lambda column: F.exp(column)), DIGITS)
