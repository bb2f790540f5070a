"""Fits on features of whole tables. Forests of many trees have no SQL, their rows are only counted; the fits at the end have."""

from __future__ import annotations

from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import functions as F

from bindings import query
from bindings.graphs import GRAPHS, hash_rounds_sql, nodes_and_edges
from bindings.kernels import vectors
from bindings.splitting import fold_sql
from bindings.tables import hash_sql, rounded, table
from solvane.functions import kernels
from solvane.functions.arrays import dense_bits
from solvane.operators import binning, fingerprint, graph, linear, metrics, models, split, study, trials
from solvane.operators.trials import sample_parameters
from solvane.sources import sinks
from solvane.operators.scaling import fit_scaler
from solvane.storage import cut, scratch_path, stage

FOREST = {"n_estimators": 8, "max_depth": 6, "min_samples_leaf": 2, "max_features": 0.5, "bootstrap": True, "random_state": 1}


def order_fingerprints(spark, folder, n_bits=64):
    """Fingerprint bits of each order's graph beside its price. The bits are kept for the passes over them, and widened in each."""
    nodes, edges = nodes_and_edges(spark, folder)
    bits = fingerprint.fingerprints(nodes, edges, n_bits=n_bits, radius=1).withColumnRenamed("graph_id", "id")
    price = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1000).alias("measured"))
    joined = cut(price.join(bits, "id")).withColumn("dense", dense_bits("bits", n_bits))
    return models.as_vector(joined, "dense").select("id", "measured", "features")


def event_features(spark, folder):
    kinds = F.array(*[(F.col("event_type") == k).cast("double") for k in ("click", "error", "purchase", "signup", "view")], (F.col("user_id") % 10).cast("double"))
    events = table(spark, folder, "events").select(F.col("event_id").alias("id"), F.col("value").alias("measured"), kinds.alias("dense"))
    return models.as_vector(events, "dense").select("id", "measured", "features")


@query("m1_forest_regression")
def m1(spark, folder):
    data = cut(split.split_by_size(order_fingerprints(spark, folder), "id", [None, 100, 100], 200))
    _, scored = models.run_trial(models.forest_regressor(FOREST), data)
    return scored


@query("m2_forest_classification")
def m2(spark, folder):
    binned = binning.with_balanced_bin(event_features(spark, folder), "measured", 4)
    data = cut(split.hold_out(binned, "id", 0.2, 0).filter("bin is not null"))  # values outside of all bins have no class
    model = models.forest_classifier(FOREST).fit(data.filter("ml_phase = 'train'"))
    return model.transform(data).groupBy("ml_phase").agg(metrics.accuracy("bin", "predicted"))


@query("m2_classification_over_bins_and_fingerprints")
def m2_over(spark, folder):
    nodes, edges = nodes_and_edges(spark, folder)
    # Dealt by graph once: all steps of a round stay in that deal.
    nodes, edges = graph.dealt(stage(nodes.drop("h"), "nodes"), stage(edges, "edges"))
    price = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1000).alias("pce"))

    def run(bits, setting):
        # Kept for the passes over the ids, which would work the fingerprints out anew each.
        joined = cut(price.join(bits.withColumnRenamed("graph_id", "id"), "id")).withColumn("dense", dense_bits("bits", setting["n_bits"]))
        return models.classify_bins(models.as_vector(joined, "dense").select("id", "pce", "features"), "id", "pce", [2, 4], 1000, FOREST)

    return models.over_fingerprints(nodes, edges, [{"n_bits": 16, "radius": 1}, {"n_bits": 32, "radius": 1}], run)


@query("m3_grid_search")
def m3(spark, folder):
    data = cut(split.with_fold(event_features(spark, folder), "id", 3, 0))
    grid = {"maxDepth": [2, 4], "minInstancesPerNode": [1, 20]}
    estimator = DecisionTreeRegressor(labelCol="measured", predictionCol="predicted", seed=0)
    search = models.grid_search(estimator, grid, data, folds=3)
    rows = [(point["maxDepth"], point["minInstancesPerNode"], float(mse)) for point, mse in models.grid_scores(search, grid)]
    return spark.createDataFrame(rows, "max_depth int, min_samples_leaf int, mse double")


@query("m4_kernel_regression")
def m4(spark, folder):
    data = cut(split.split_by_size(vectors(spark, folder), "vec_id", [None, 50, 100], 4))
    fitted = models.KernelRegression(kernels.combined(0.7, 0.5, 0.4), ["words", "phys"], landmarks=32).fit(data.filter("ml_phase = 'train'"), "vec_id", "label")
    return metrics.metrics_by(fitted.transform(data, "vec_id"), ["ml_phase"], "label", "predicted")


@query("m5_trial")
def m5(spark, folder):
    data = cut(split.split_by_size(event_features(spark, folder), "id", [None, 200, 200], 200))
    _, scored = models.run_trial(LinearRegression(labelCol="measured", predictionCol="predicted"), data)
    return scored.withColumn("objective", F.lit(models.objective_value(scored)))


@query("m6_cross_validated_trial")
def m6(spark, folder):
    data = split.split_by_size(event_features(spark, folder), "id", [None, 0, 300], 200)
    train = cut(split.with_fold(data.filter("ml_phase <> 'test'"), "id", 3, None))
    _, summary, ensemble = models.run_cv_trial(models.forest_regressor(FOREST), train, "id", 3, extra={"test": data.filter("ml_phase = 'test'")})
    return summary.select(F.col("phase").alias("part"), "mean", "std").unionByName(ensemble.select(F.concat(F.lit("ensemble "), "data").alias("part"), F.col("mean_mse").alias("mean"), F.col("mse").alias("std")))


@query("m7_retrain_best")
def m7(spark, folder):
    data = cut(split.split_by_size(event_features(spark, folder), "id", [None, 200, 200], 200))
    done = spark.createDataFrame([(0, "COMPLETE", 9.0, 2), (1, "COMPLETE", 3.0, 4), (2, "FAIL", None, 6)], "number int, state string, value double, max_depth int")
    best = trials.best_trial(done).first()
    _, scored, measured = models.retrain_best(lambda p: models.forest_regressor({**FOREST, **p}), {"max_depth": best["max_depth"]}, data, with_val=True)
    path = scratch_path(spark, "retrained")
    sinks.write_predictions(scored, f"{path}/predictions", fit_scaler(data.filter("ml_phase = 'train'"), "measured"), inverse=True)
    sinks.write_metrics(measured, f"{path}/metrics")
    return spark.read.option("header", True).schema(measured.schema).csv(f"{path}/metrics")


@query("m8_apply_to_second_data_set")
def m8(spark, folder):
    data = cut(split.split_by_size(event_features(spark, folder), "id", [None, 200, 200], 200))
    model, _ = models.run_trial(models.forest_regressor(FOREST), data)
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 20).alias("measured"),
        F.array(*[(F.col("c_mktsegment") == s).cast("double") for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")], (F.col("c_custkey") % 10).cast("double")).alias("dense"),
    )
    other = split.split_by_size(models.as_vector(customers, "dense"), "id", [None, 20, 20], 200)
    return models.apply_to(model, other)


@query("m9_trial_fan_out")
def m9(spark, folder):
    data = cut(split.split_by_size(event_features(spark, folder), "id", [None, 200, 200], 200))
    space = {"reg": {"type": "loguniform", "low": 1e-4, "high": 1.0}, "depth": {"type": "int", "low": 0, "high": 3}}
    sampled = sample_parameters(table(spark, folder, "region").select(F.col("r_regionkey").alias("number")), "number", space, 1)

    def objective(row):
        if row["depth"] == 0:
            raise ValueError("no tree of depth 0")
        estimator = LinearRegression(labelCol="measured", predictionCol="predicted", regParam=row["reg"])
        return models.objective_value(models.run_trial(estimator, data)[1])

    return study.run_trials(spark, sampled, objective, "fan-out", n_jobs=3).drop("datetime_start", "datetime_complete")


# Fits that SQL can follow: a tree of one split over 2048 bits, one landmark, a line with a penalty.
BITS = 2048
PRICED = f"""with {GRAPHS}, {hash_rounds_sql(2)},
bits as materialized (select graph_id, (label % {BITS})::int as bit from h0 union select graph_id, (label % {BITS})::int from h1 union select graph_id, (label % {BITS})::int from h2),
priced as materialized (select o_orderkey as id, (o_totalprice / 1000)::double as y from orders where o_orderkey in (select graph_id from bits))"""


def sparse_fingerprints(spark, folder):
    """Fingerprints of radius 2 of each order's graph as sparse vectors, beside its price, written once for the passes over it."""
    bits = fingerprint.fingerprints(*nodes_and_edges(spark, folder), n_bits=BITS, radius=2, hashed=True).withColumnRenamed("graph_id", "id")
    price = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1000).cast("double").alias("measured"))
    return stage(models.bit_vectors(price.join(bits, "id"), "bits", BITS).select("id", "measured", "features"), "sparse")


STUMP = {"n_estimators": 1, "max_depth": 1, "max_features": "all", "bootstrap": False, "max_samples": 1.0}


@query(
    "m1_one_split",
    f"""{PRICED}, whole as (select count(*) as n, sum(y) as s from priced),
    sides as (select bit, count(*) as n1, sum(y) as s1 from bits join priced on id = graph_id group by bit),
    best as (select bit, s1 / n1 as yes, (s - s1) / (n - n1) as no from sides, whole where n1 < n order by s1 * s1 / n1 + (s - s1) * (s - s1) / (n - n1) desc, bit limit 1)
    select id, round(case when exists (select 1 from bits b where b.graph_id = id and b.bit = best.bit) then yes else no end, 6) as predicted from priced, best""",
)
def m1_one_split(spark, folder):
    data = sparse_fingerprints(spark, folder)
    fitted = models.forest_regressor(STUMP).fit(data)
    return fitted.transform(data).select("id", F.round("predicted", 6).alias("predicted"))


@query(
    "m2_one_split",
    f"""{PRICED}, middle as (select list(y order by y)[(count(*) - 1) // 2 + 1] as m from priced),
    classed as materialized (select id, (y > m)::int as c from priced, middle),
    whole as (select count(*) as n, sum(c) as c1 from classed),
    sides as (select bit, count(*) as n1, sum(c) as c11 from bits join classed on id = graph_id group by bit),
    best as (select bit, n1, n - n1 as n0, c11, c1 - c11 as c01 from sides, whole where n1 < n
      order by (c11 * c11 + (n1 - c11) * (n1 - c11)) / n1::double + ((c1 - c11) * (c1 - c11) + (n - n1 - c1 + c11) * (n - n1 - c1 + c11)) / (n - n1)::double desc, bit limit 1)
    select id, (case when exists (select 1 from bits b where b.graph_id = id and b.bit = best.bit) then 2 * c11 > n1 else 2 * c01 > n0 end)::int as predicted from classed, best""",
)
def m2_one_split(spark, folder):
    data = binning.with_balanced_bin(sparse_fingerprints(spark, folder), "measured", 2)
    fitted = models.forest_classifier(STUMP).fit(data)
    return fitted.transform(data).select("id", F.col("predicted").cast("int").alias("predicted"))


@query(
    "m4_one_landmark",
    f"""with l as (select embedding as lm from embeddings order by {hash_sql(3, 'vec_id')}, vec_id limit 1),
    k as (select vec_id, label, exp(-0.5 * list_sum(list_transform(list_zip(embedding, lm), lambda p: (p[1]::double - p[2]::double) ** 2))) as k from embeddings, l),
    f as (select regr_slope(label, k) as a, regr_intercept(label, k) as b from k)
    select vec_id, round(a * k + b, 5) as predicted from k, f""",
)
def m4_one_landmark(spark, folder):
    data = stage(vectors(spark, folder), "vectors")
    fitted = models.NystromRegression(kernels.physical(0.5), ["phys"], landmarks=1, reg=0.0, seed=3).fit(data, "vec_id", "label")
    return fitted.transform(data, "vec_id").select("vec_id", F.round("predicted", 5).alias("predicted"))


REGS = [0.0, 0.5, 4.0]


@query(
    "m6_ridge_folds",
    f"""with ev as (select event_id as id, (user_id % 10)::double as x, value as y from events), f as ({fold_sql('ev', 'id', 3, "('0x' || substr(md5('0:' || id::varchar), 1, 8))::bigint, id")}),
    rows as (select ev.*, fold from ev join f using (id)), k as (select unnest([0, 1, 2]) as model), r as (select unnest([{', '.join(map(str, REGS))}])::double as reg),
    fits as (select model, reg, covar_pop(y, x) / (var_pop(x) + reg) as a, avg(y) - avg(x) * covar_pop(y, x) / (var_pop(x) + reg) as b from rows, k, r where fold <> model group by model, reg)
    select reg, model as fold, round(avg((y - a * x - b) ** 2) filter (where fold <> model), 5) as train_mse, round(avg((y - a * x - b) ** 2) filter (where fold = model), 5) as test_mse
    from rows, fits group by reg, model""",
)
def m6_ridge(spark, folder):
    events = table(spark, folder, "events").select(F.col("event_id").alias("id"), F.col("value").alias("measured"), F.array((F.col("user_id") % 10).cast("double")).alias("x"))
    folded = split.with_fold(events, "id", 3, 0)
    return rounded(linear.cross_validated_ridge(folded, "x", "measured", "fold", REGS), {"train_mse": 5, "test_mse": 5})
