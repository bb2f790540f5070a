"""Kernels of all embeddings against one prototype per label."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import query
from bindings.tables import hash_sql, rounded, table
from solvane.functions import kernels
from solvane.functions.arrays import pack_bits, positive_positions
from solvane.operators import kernel, scaling, split
from solvane.plans.features import prepare_features

FEATURES = ["words", "phys"]

PAIRS = """v as (select vec_id, label, unnest(embedding)::double as value, generate_subscripts(embedding, 1) - 1 as dim from embeddings),
p as (select label as y_id, dim, avg(value) as value from v group by 1, 2),
pairs as (
  select v.vec_id as x_id, p.y_id, sum((v.value > 0 and p.value > 0)::int) as shared, sum((v.value > 0 or p.value > 0)::int) as either,
         sum((v.value - p.value) ** 2) as distance
  from v join p on v.dim = p.dim group by 1, 2),
k as (select *, case when either > 0 then shared / either else 0.0 end as t from pairs)"""


def vectors(spark, folder):
    """Packed sign bits and the numbers of each embedding."""
    e = F.col("embedding")
    phys = F.transform(e, lambda v: v.cast("double"))
    return table(spark, folder, "embeddings").select("vec_id", "label", pack_bits(positive_positions(e), 64).alias("words"), phys.alias("phys"))


def prototypes(spark, folder):
    """The mean embedding of each label, with the same features."""
    long = table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("dim", "value"))
    means = long.groupBy("label", "dim").agg(F.avg(F.col("value").cast("double")).alias("value"))
    # One entry per vector position, so the list is as long as one vector.
    listed = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("dim", "value"))).alias("_m"))
    mean = listed.select("label", F.transform("_m", lambda m: m["value"]).alias("mean"))
    return mean.select("label", pack_bits(positive_positions("mean"), 64).alias("words"), F.col("mean").alias("phys"))


def matrix(spark, folder, name, **params):
    function = kernels.resolve_kernel(name, **params)
    return rounded(kernel.kernel_matrix(vectors(spark, folder), "vec_id", prototypes(spark, folder), "label", function, FEATURES))


@query("k1_tanimoto", f"with {PAIRS} select x_id, y_id, round(t, 6) as k from k")
def k1(spark, folder):
    return matrix(spark, folder, "tanimoto")


@query("k2_structural_kernel", f"with {PAIRS} select x_id, y_id, round(exp(-0.7 * (1 - t)), 6) as k from k")
def k2(spark, folder):
    return matrix(spark, folder, "rbf_kernel_phys_and_struct", gamma_structural=0.7)


@query("k3_physical_kernel", f"with {PAIRS} select x_id, y_id, round(exp(-2.5 * distance), 6) as k from k")
def k3(spark, folder):
    return matrix(spark, folder, "rbf_kernel_phys_and_struct", gamma_physical=2.5)


@query("k4_weighted_kernel", f"with {PAIRS} select x_id, y_id, round(0.4 * exp(-0.7 * (1 - t)) + 0.6 * exp(-2.5 * distance), 6) as k from k")
def k4(spark, folder):
    return matrix(spark, folder, "rbf_kernel_phys_and_struct", gamma_structural=0.7, gamma_physical=2.5, alpha=0.4)


@query("k4_product_kernel", f"with {PAIRS} select x_id, y_id, round(exp(-0.7 * (1 - t) - 2.5 * distance), 6) as k from k")
def k4_product(spark, folder):
    return matrix(spark, folder, "rbf_kernel_phys_and_struct", gamma_structural=0.7, gamma_physical=2.5)


K5 = f"""with r as (select vec_id, embedding, row_number() over (order by {hash_sql(0, 'vec_id')}, vec_id) - 1 as rk, count(*) over () as n from embeddings),
    v as (select unnest(embedding)::double as value, generate_subscripts(embedding, 1) as dim from r where rk < n - 100),
    d as (select dim, avg(value) as m, stddev_pop(value) as s from v group by dim),
    s as (select list(m order by dim) as ms, list(s order by dim) as ss from d)
    select vec_id, len(list_filter(embedding, lambda v: v > 0))::int as set_bits, list_transform(embedding, lambda v, i: round((v::double - ms[i]) / ss[i], 5) + 0.0) as scaled from r, s"""


@query("k5_prepare_features", K5)
def k5(spark, folder):
    """Every position of the vectors by mean and deviation of the train rows, and the bits, both ready for kernels."""
    found = table(spark, folder, "embeddings").select("vec_id", positive_positions("embedding").alias("bits"), "embedding")
    phased = split.split_by_size(found, "vec_id", [None, 0, 100], 0)
    features, _ = prepare_features(phased, "vec_id", "bits", 64, "embedding", fit_on=phased.filter("ml_phase = 'train'"))
    set_bits = F.aggregate("words", F.lit(0), lambda n, w: n + F.bit_count(w))
    return features.select("vec_id", set_bits.alias("set_bits"), F.transform("phys", lambda v: F.round(v, 5) + F.lit(0.0)).alias("scaled"))


@query("k5_prepare_all_features", K5)
def k5_all(spark, folder):
    """The same features, scaled by the operator for vectors alone."""
    vectors = table(spark, folder, "embeddings").select("vec_id", positive_positions("embedding").alias("bits"), "embedding")
    phased = split.split_by_size(vectors, "vec_id", [None, 0, 100], 0)
    scaled = scaling.standardise_vectors(phased, "embedding", "scaled", phased.filter("ml_phase = 'train'"))
    return scaled.select("vec_id", F.size("bits").alias("set_bits"), F.transform("scaled", lambda v: F.round(v, 5) + F.lit(0.0)).alias("scaled"))


@query("k6_kernel_score", f"with {PAIRS} select x_id, round(sum((y_id - 4) * (0.4 * exp(-0.7 * (1 - t)) + 0.6 * exp(-2.5 * distance))) + 0.25, 6) + 0.0 as predicted from k group by x_id")
def k6(spark, folder):
    support = prototypes(spark, folder).withColumn("coefficient", F.col("label") - 4.0)
    function = kernels.combined(0.7, 2.5, 0.4)
    return rounded(kernel.kernel_score(vectors(spark, folder), "vec_id", support, "label", "coefficient", 0.25, function, FEATURES))


@query("f3_kernel_by_callable", f"with {PAIRS} select x_id, y_id, round(1 / (1 + distance), 6) as k from k")
def f3(spark, folder):
    return matrix(spark, folder, lambda x, y: 1 / (1 + kernels.squared_distance(x["phys"], y["phys"])))
