"""Trial tables: sampling, counts, best trials."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import query
from bindings.tables import TRIALS, rounded, table, trial_table, uniform_sql
from solvane.operators import trials


def u(name: str) -> str:
    return uniform_sql(f"3:{name}", "p_partkey")


# Every part number is a trial number.
def numbers(spark, folder):
    return table(spark, folder, "part").select(F.col("p_partkey").alias("number"))


SCALARS = {
    "trees": {"type": "int", "low": 40, "high": 90},
    "depth": {"type": "int", "low": 4, "high": 28, "step": 3},
    "units": {"type": "int", "low": 6, "high": 300, "log": True},
    "share": {"type": "categorical", "choices": [0.2, 0.4, 0.7]},
    "order": {"type": "categorical", "choices": ["even", "odd"]},
    "rate": {"type": "loguniform", "low": 1e-3, "high": 1.0},
    "decay": {"type": "float", "low": 0.002, "high": 0.5, "log": True},
    "blend": {"type": "float", "low": 0.0, "high": 3.0, "step": 0.5},
    "skip": {"type": "uniform", "low": 0.0, "high": 0.8},
    "grid": {"type": "discrete_uniform", "low": 0.25, "high": 1.75, "q": 0.5},
    "goal": "mae",
}

SCALARS_SQL = f"""select p_partkey as number, (40 + floor({u('trees')} * 51))::bigint as trees,
    (4 + 3 * floor({u('depth')} * 9))::bigint as depth,
    least(greatest(floor(exp(ln(5.5) + {u('units')} * (ln(300.5) - ln(5.5))) + 0.5), 6), 300)::bigint as units,
    ([0.2, 0.4, 0.7])[floor({u('share')} * 3)::int + 1]::double as share,
    (['even', 'odd'])[floor({u('order')} * 2)::int + 1] as "order",
    round(exp(ln(0.001) + {u('rate')} * (ln(1.0) - ln(0.001))), 8) as rate,
    round(exp(ln(0.002) + {u('decay')} * (ln(0.5) - ln(0.002))), 8) as decay,
    round(0.5::double * floor({u('blend')} * 7), 6) as blend, round({u('skip')} * 0.8::double, 6) as skip,
    round(0.25::double + 0.5::double * floor({u('grid')} * 4), 6) as grid, 'mae' as goal from part"""


@query("h1_scalar_parameters", SCALARS_SQL)
def h1(spark, folder):
    return rounded(trials.sample_parameters(numbers(spark, folder), "number", SCALARS, 3), {"rate": 8, "decay": 8})


LISTS = {
    "depth": {"type": "int", "low": 2, "high": 5},
    "taper": {"type": "int", "low": 20, "high": 60, "length": 3, "direction": "decreasing"},
    "climb": {"type": "int", "low": 5, "high": 19, "length": 2, "direction": "increasing"},
    "flat": {"type": "int", "low": 30, "high": 33, "length": 2, "direction": "constant"},
    "led": {"type": "int", "low": 100, "high": 140, "length": 2, "starting_value": "depth"},
    "given": {"values": [9, 2], "length": 5},
    "per_layer": {"values": [11, 6, 5], "length": "depth"},
}


def below(high: str, name: str) -> str:
    return f"(20 + floor({u(name)} * ({high} - 20 + 1)))"


@query(
    "h2_list_parameters",
    f"""with a as (select p_partkey, (2 + floor({u('depth')} * 4))::bigint as depth, {below('60', 'taper_0')} as w0, 5 + floor({u('climb_0')} * 15) as g0,
      (30 + floor({u('flat_0')} * 4))::bigint as s0, (100 + floor({u('led_1')} * 41))::bigint as t1 from part),
    b as (select *, {below('w0', 'taper_1')} as w1, g0 + floor({u('climb_1')} * (19 - g0 + 1)) as g1 from a),
    c as (select *, {below('w1', 'taper_2')} as w2 from b)
    select p_partkey as number, depth, concat_ws(',', w0::bigint, w1::bigint, w2::bigint) as taper, concat_ws(',', g0::bigint, g1::bigint) as climb,
      concat_ws(',', s0, s0) as flat, concat_ws(',', depth, t1) as led, '9,2,2,2,2' as given,
      '11,6' || repeat(',5', (depth - 2)::int) as per_layer from c""",
)
def h2(spark, folder):
    sampled = trials.sample_parameters(numbers(spark, folder), "number", LISTS, 3)
    lists = [n for n in LISTS if n != "depth"]
    return sampled.select("number", "depth", *[F.array_join(F.col(n).cast("array<string>"), ",").alias(n) for n in lists])


JOB = {
    "bits": {"type": "categorical", "choices": [64, 192, 320]},
    "reach": {"type": "categorical", "choices": [1, 4]},
    "batch": 77,
    "shrink": {"type": "loguniform", "low": 1e-4, "high": 1e-1},
}


@query(
    "h3_trial_table",
    f"""select p_partkey as number, ([64, 192, 320])[floor({u('bits')} * 3)::int + 1] as bits, ([1, 4])[floor({u('reach')} * 2)::int + 1] as reach, 77 as batch,
    round(exp(ln(0.0001) + {u('shrink')} * (ln(0.1) - ln(0.0001))), 9) as shrink from part""",
)
def h3(spark, folder):
    return rounded(trials.sample_parameters(numbers(spark, folder), "number", JOB, 3), 9)


STATE_SQL = """count(*) as "all", count(*) filter (where state = 'RUNNING') as running, count(*) filter (where state = 'COMPLETE') as completed,
    count(*) filter (where state = 'PRUNED') as pruned, count(*) filter (where state = 'FAIL') as failed"""


@query("a8_state_counts", f"with {TRIALS} select study, {STATE_SQL} from trials group by study")
def a8(spark, folder):
    return trial_table(spark, folder).groupBy("study").agg(*trials.state_counts())


def best_sql(order: str) -> str:
    return f"with {TRIALS}, r as (select *, row_number() over (partition by study order by value {order}, number) as nth from trials where state = 'COMPLETE') select study, number, state, value from r where nth = 1"


@query("a9_best_trial_minimise", best_sql("asc"))
def a9(spark, folder):
    return trials.best_trial(trial_table(spark, folder), "minimize", ("study",))


@query("a9_best_trial_maximise", best_sql("desc"))
def a9_max(spark, folder):
    return trials.best_trial(trial_table(spark, folder), "maximize", ("study",))


@query(
    "s8_study_summaries",
    f"with {TRIALS} select study, count(*) as trials, min(value) filter (where state = 'COMPLETE') as best_value from trials group by study",
)
def s8(spark, folder):
    return trials.study_summaries(trial_table(spark, folder))


@query("s8_resume_count", f"with {TRIALS} select count(*) as previous, count(*) + 20 - 1 as total from trials where study = 'study-3'")
def s8_resume(spark, folder):
    recorded = trial_table(spark, folder)
    previous = trials.previous_trials(recorded, "study-3")
    found = recorded.filter("study = 'study-3'").agg(F.count("*").alias("previous"))
    return found.withColumn("total", F.lit(trials.total_trials(20, previous)).cast("bigint"))
