"""Fits of a straight line through MLlib, whose results SQL can work out in closed form."""

from __future__ import annotations

from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from bindings import query
from bindings.splitting import fold_sql, ranked_sql
from bindings.tables import DIGITS, metrics_sql, rounded, table, uniform_sql
from solvane.operators import models, split, study, trials
from solvane.operators.scaling import fit_scaler
from solvane.operators.trials import sample_parameters
from solvane.sources import sinks
from solvane.storage import scratch_path, stage


def event_line(spark, folder, x=None):
    x = F.col("user_id") % 10 if x is None else x
    events = table(spark, folder, "events").select(F.col("event_id").alias("id"), F.col("value").alias("measured"), F.array(x.cast("double")).alias("x"))
    return models.as_vector(events, "x")


def line():
    return LinearRegression(labelCol="measured", predictionCol="predicted")


EVENTS = "ev as (select event_id as id, (user_id % 10)::double as x, value as y from events)"
PHASED = f"""{EVENTS}, ranked as ({ranked_sql('ev', 'id', 200, ', x, y')}),
phased as (select *, case when rk < n - 400 then 'train' when rk < n - 200 then 'val' else 'test' end as ml_phase from ranked)"""
FITTED = "fitted as (select regr_slope(y, x) as slope, regr_intercept(y, x) as intercept from phased where ml_phase = 'train')"


def phased_events(spark, folder):
    return stage(split.split_by_size(event_line(spark, folder), "id", [None, 200, 200], 200).drop("x"))


@query(
    "m5_line_trial",
    f"""with {PHASED}, {FITTED}, scored as (select ml_phase, y, slope * x + intercept as p from phased, fitted),
    m as (select ml_phase, {metrics_sql('y', 'p')} from scored group by ml_phase)
    select *, (select mse from m where ml_phase = 'val') as objective from m""",
)
def m5_line(spark, folder):
    _, measured = models.run_trial(line(), phased_events(spark, folder))
    return rounded(measured.withColumn("objective", F.lit(models.objective_value(measured))), {**DIGITS, "objective": 5})


@query(
    "m6_line_cross_validation",
    f"""with {PHASED}, tv as (select id, x, y from phased where ml_phase <> 'test'), f as ({fold_sql('tv', 'id', 3, 'id')}),
    rows as (select tv.*, fold from tv join f using (id)), k as (select unnest([0, 1, 2]) as model),
    fits as (select model, regr_slope(y, x) as slope, regr_intercept(y, x) as intercept from rows, k where fold <> model group by model),
    own as (select id, model, y, slope * x + intercept as p, case when fold = model then 'test' else 'train' end as part from rows, fits),
    scores as (select model, part, avg((y - p) ** 2) as s from own group by 1, 2),
    other as (select id, model, y, slope * x + intercept as p from phased, fits where ml_phase = 'test'),
    own_rows as (select id, any_value(y) as y, avg(p) as p, avg((y - p) ** 2) as sq from own group by id),
    other_rows as (select id, any_value(y) as y, avg(p) as p, avg((y - p) ** 2) as sq from other group by id)
    select part, round(avg(s), 5) as mean, round(stddev_pop(s), 5) as spread from scores group by part
    union all select 'ensemble train', round(avg(sq), 5), round(avg((y - p) ** 2), 5) from own_rows
    union all select 'ensemble test', round(avg(sq), 5), round(avg((y - p) ** 2), 5) from other_rows""",
)
def m6_line(spark, folder):
    data = phased_events(spark, folder)
    train = stage(split.with_fold(data.filter("ml_phase <> 'test'"), "id", 3, None))
    _, summary, ensemble = models.run_cv_trial(line(), train, "id", 3, extra={"test": data.filter("ml_phase = 'test'")})
    folds = summary.select(F.col("phase").alias("part"), "mean", F.col("std").alias("spread"))
    whole = ensemble.select(F.concat(F.lit("ensemble "), "data").alias("part"), F.col("mean_mse").alias("mean"), F.col("mse").alias("spread"))
    return rounded(folds.unionByName(whole), 5)


@query(
    "m3_line_grid_search",
    f"""with {EVENTS}, f as ({fold_sql('ev', 'id', 3, "('0x' || substr(md5('0:' || id::varchar), 1, 8))::bigint, id")}),
    rows as (select ev.*, fold from ev join f using (id)), k as (select unnest([0, 1, 2]) as model),
    fits as (select model, regr_slope(y, x) as a, regr_intercept(y, x) as b, sum(x * y) / sum(x * x) as c from rows, k where fold <> model group by model),
    errors as (select model, avg((y - a * x - b) ** 2) as with_b, avg((y - c * x) ** 2) as without_b from rows join fits on fold = model group by model)
    select true as intercept, round(avg(with_b), 5) as mse from errors union all select false, round(avg(without_b), 5) from errors""",
)
def m3_line(spark, folder):
    data = stage(split.with_fold(event_line(spark, folder), "id", 3, 0).drop("x"))
    grid = {"fitIntercept": [True, False]}
    search = models.grid_search(line(), grid, data, folds=3)
    rows = [(point["fitIntercept"], float(mse)) for point, mse in models.grid_scores(search, grid)]
    return rounded(spark.createDataFrame(rows, "intercept boolean, mse double"), 5)


@query(
    "m7_line_retrained",
    f"""with {PHASED}, fitted as (select regr_slope(y, x) as slope, regr_intercept(y, x) as intercept from phased where ml_phase <> 'test'),
    scored as (select case when ml_phase = 'test' then 'test set' else 'training set' end as phase, y, slope * x + intercept as p from phased, fitted),
    s as (select avg(y) as mean, stddev_pop(y) as std from phased where ml_phase = 'train')
    select phase, {metrics_sql('y', 'p')}, round(sum((p - mean) / std), 4) as total from scored, s group by phase""",
)
def m7_line(spark, folder):
    data = phased_events(spark, folder)
    _, scored, measured = models.retrain_best(lambda _: line(), {}, data, with_val=True)
    path = scratch_path(spark, "retrained")
    sinks.write_predictions(scored, f"{path}/predictions", fit_scaler(data.filter("ml_phase = 'train'"), "measured"))
    sinks.write_metrics(measured, f"{path}/metrics")
    stored = spark.read.option("header", True).schema(measured.schema).csv(f"{path}/metrics")
    totals = spark.read.parquet(f"{path}/predictions").groupBy("phase").agg(F.sum("Predicted PCE").alias("total"))
    return rounded(stored.join(totals, "phase"), {**DIGITS, "total": 4})


@query(
    "m8_line_on_second_data_set",
    f"""with {PHASED}, {FITTED}, other as (select c_custkey as cid, (c_custkey % 10)::double as x, c_acctbal / 20 as y from customer),
    r as ({ranked_sql('other', 'cid', 200, ', x, y')}),
    scored as (select case when rk < n - 40 then 'train' when rk < n - 20 then 'val' else 'test' end as ml_phase, y, slope * x + intercept as p from r, fitted)
    select ml_phase, {metrics_sql('y', 'p')} from scored group by ml_phase""",
)
def m8_line(spark, folder):
    model, _ = models.run_trial(line(), phased_events(spark, folder))
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 20).alias("measured"), F.array((F.col("c_custkey") % 10).cast("double")).alias("x")
    )
    other = split.split_by_size(models.as_vector(customers, "x"), "id", [None, 20, 20], 200)
    return rounded(models.apply_to(model, other), DIGITS)


def _choice(name: str, n: int) -> str:
    return f"floor({uniform_sql(f'1:{name}', 'r_regionkey')} * {n})::int"


@query(
    "m9_line_trials",
    f"""with e as (select event_id as id, (user_id % 10)::double as x0, (event_id % 17)::double as x1, value as y from events),
    ranked as ({ranked_sql('e', 'id', 200, ', x0, x1, y')}),
    phased as (select *, case when rk < n - 400 then 'train' when rk < n - 200 then 'val' else 'test' end as ml_phase from ranked),
    fitted as (select regr_slope(y, x0) as a0, regr_intercept(y, x0) as b0, regr_slope(y, x1) as a1, regr_intercept(y, x1) as b1 from phased where ml_phase = 'train'),
    v as (select avg((y - a0 * x0 - b0) ** 2) as m0, avg((y - a1 * x1 - b1) ** 2) as m1 from phased, fitted where ml_phase = 'val'),
    t as (select r_regionkey::bigint as number, {_choice('column', 2)} as which, {_choice('level', 3)} as level from region)
    select 'lines' as study, number, case when level = 0 then 'FAIL' else 'COMPLETE' end as state,
      case when level = 0 then null when which = 0 then round(m0, 5) else round(m1, 5) end as value from t, v""",
)
def m9_line(spark, folder):
    x = {"user": F.col("user_id") % 10, "event": F.col("event_id") % 17}
    space = {"column": {"type": "categorical", "choices": list(x)}, "level": {"type": "int", "low": 0, "high": 2}}
    sampled = sample_parameters(table(spark, folder, "region").select(F.col("r_regionkey").alias("number")), "number", space, 1)
    data = {name: split.split_by_size(event_line(spark, folder, column), "id", [None, 200, 200], 200).drop("x") for name, column in x.items()}

    def objective(row):
        if row["level"] == 0:
            raise ValueError("no fit at level 0")
        return models.objective_value(models.run_trial(line(), data[row["column"]])[1])

    found = study.run_trials(spark, sampled, objective, "lines", n_jobs=3)
    return rounded(found.select("study", "number", "state", "value"), 5)


@query(
    "a9_best_of_study",
    f"""with t as (select event_id as number, value, case when event_type in ('click', 'purchase') then 'COMPLETE' else 'FAIL' end as state from events)
    select number, value, state from t where state = 'COMPLETE' order by value, number limit 1""",
)
def best_of_study(spark, folder):
    state = F.when(F.col("event_type").isin("click", "purchase"), "COMPLETE").otherwise("FAIL")
    return trials.best_trial(table(spark, folder, "events").select(F.col("event_id").alias("number"), "value", state.alias("state")))
