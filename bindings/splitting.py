"""Splits, samples and bins."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import query
from bindings.tables import MEASURED_EVENTS, hash_sql, measured_events, metrics_sql, rounded, table, uniform_sql, DIGITS
from solvane.operators import binning, clean, split
from solvane.plans import datasets, regression
from solvane.sources.tables import load_dataset


def ranked_sql(source: str, row_id: str, seed: int, extra: str = "") -> str:
    return f"select {row_id}{extra}, row_number() over (order by {hash_sql(seed, row_id)}, {row_id}) - 1 as rk, count(*) over () as n from {source}"


def _events(spark, folder, *columns):
    return table(spark, folder, "events").select("event_id", *columns)


LINE_STUDY = f"""with lines as (select l_orderkey, sum(l_extendedprice * (1 - l_discount)) / 1000 as x from lineitem group by 1),
cleaned as (select o_orderkey as id, x, o_totalprice / 1000 as y from orders join lines on l_orderkey = o_orderkey where o_totalprice / 1000 >= 20),
ranked as ({ranked_sql('cleaned', 'id', 7, ', x, y')}),
phased as (select *, case when rk < n - 200 then 'train' when rk < n - 100 then 'val' else 'test' end as ml_phase from ranked),
fitted as (select avg(y) as mean, stddev_pop(y) as std, regr_slope(y, x) as slope, regr_intercept(y, x) as intercept from phased where ml_phase = 'train'),
scored as (
  select ml_phase, ((y - mean) / std) * std + mean as measured,
         (x * (slope / std) + (intercept - mean) / std) * std + mean as predicted
  from phased, fitted)
select ml_phase, {metrics_sql('measured', 'predicted')} from scored group by ml_phase"""


@query("flagship_line_study", LINE_STUDY)
def flagship(spark, folder):
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg((F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 1000).alias("x"))
    orders = table(spark, folder, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("y"))
    joined = orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("id"), "x", "y")
    return rounded(regression.line_study(joined, "id", "x", "y", 20.0, [None, 100, 100], 7), DIGITS)


@query(
    "sp1_split_by_size",
    f"with r as ({ranked_sql('events', 'event_id', 200)}) select event_id, case when rk < n - 500 then 'train' when rk < n - 200 then 'val' else 'test' end as ml_phase from r",
)
def sp1(spark, folder):
    return split.split_by_size(_events(spark, folder), "event_id", [None, 300, 200], 200)


@query(
    "sp2_split_by_column",
    "select o_orderkey, phase from (select o_orderkey, case o_orderstatus when 'F' then 'train' when 'O' then 'val' when 'P' then 'test' end as phase from orders) where phase is not null",
)
def sp2(spark, folder):
    phase = F.when(F.col("o_orderstatus") == "F", "train").when(F.col("o_orderstatus") == "O", "val").when(F.col("o_orderstatus") == "P", "test")
    orders = table(spark, folder, "orders").select("o_orderkey", phase.alias("phase"))
    train, val, test = split.split_by_column(orders, "phase")
    return train.unionByName(val).unionByName(test)


@query("p6_equality_split", "select event_id, value from events where event_type = 'click'")
def p6(spark, folder):
    phase = F.when(F.col("event_type") == "click", "train").otherwise("test")
    events = table(spark, folder, "events").select("event_id", "value", phase.alias("ml_phase"))
    return split.split_by_column(events)[0].drop("ml_phase")


@query(
    "sp3_random_subset",
    f"""with c as (select event_id, value from events where value >= 5 and (value >= 60 or {uniform_sql(100, 'event_id')} >= 0.3)),
    r as ({ranked_sql('c', 'event_id', 100, ', value')})
    select event_id, value, case when rk < 400 then 'train' when rk < 500 then 'val' else 'test' end as ml_phase from r where rk < 650""",
)
def sp3(spark, folder):
    thinning = {"threshold": 60.0, "skip": 0.3}
    return datasets.cleaned_and_random(_events(spark, folder, "value"), "event_id", "value", [400, 100, 150], 5.0, thinning, 100)


def stratified_sql(source: str, row_id: str, value: str, size: int, step: float, seed: int, name: str) -> str:
    """CTEs ``<name>`` (sample) and ``<name>_rest`` over a source with (row_id, value)."""
    return f"""{name}_b as (select *, coalesce(case when {value} > 0 then ceil({value} / {step}::double) - 1 end, -1)::bigint as bin from {source}),
{name}_c as (select bin, count(*) as c, sum(count(*)) over () as n from {name}_b group by bin),
{name}_q as (select bin, ({size} * c) // n + case when row_number() over (order by ({size} * c) % n desc, bin) <= {size} - sum(({size} * c) // n) over () then 1 else 0 end as quota from {name}_c),
{name}_r as (select b.* exclude (bin), row_number() over (partition by b.bin order by {hash_sql(seed, row_id)}, {row_id}) as rk, quota from {name}_b b join {name}_q q on b.bin = q.bin),
{name} as (select * exclude (rk, quota) from {name}_r where rk <= quota),
{name}_rest as (select * exclude (rk, quota) from {name}_r where rk > quota)"""


@query("sp4_stratified_sample", f"with e as (select event_id, value from events), {stratified_sql('e', 'event_id', 'value', 777, 20.0, 0, 's')} select event_id, value from s")
def sp4(spark, folder):
    sample, _ = split.stratified_sample(_events(spark, folder, "value"), "event_id", "value", 777, 20.0)
    return sample


@query(
    "sp4_stratified_rest",
    f"""with e as (select event_id, value from events), {stratified_sql('e', 'event_id', 'value', 333, 50.0, 3, 's')}
    select event_id, value, (case when value > 0 then ceil(value / 50.0::double) - 1 end)::int as bin from s_rest""",
)
def sp4_rest(spark, folder):
    _, rest = split.stratified_sample(_events(spark, folder, "value"), "event_id", "value", 333, 50.0, 3, add_bin=True)
    return rest


CASCADE = f"""{stratified_sql('e', 'event_id', 'value', 400, 20.0, 0, 'a')},
{stratified_sql('a_rest', 'event_id', 'value', 150, 20.0, 0, 'b')},
{stratified_sql('b_rest', 'event_id', 'value', 150, 20.0, 0, 'c')}
select event_id, value, 'train' as ml_phase from a union all select event_id, value, 'val' from b union all select event_id, value, 'test' from c"""


@query("sp5_stratified_cascade", f"with e as (select event_id, value from events), {CASCADE}")
def sp5(spark, folder):
    return split.stratified_split(_events(spark, folder, "value"), "event_id", "value", [400, 150, 150], 20.0)


@query(
    "sp6_cleaned_and_stratified",
    f"with e as (select event_id, value from events where value >= 2 and (value >= 50 or {uniform_sql(0, 'event_id')} >= 0.3)), {CASCADE}",
)
def sp6(spark, folder):
    thinning = {"threshold": 50.0, "skip": 0.3}
    return datasets.cleaned_and_stratified(_events(spark, folder, "value"), "event_id", "value", [400, 150, 150], 2.0, thinning, 20.0)


def fold_sql(source: str, row_id: str, k: int, order: str) -> str:
    """Fold of each row when the order is cut into k stretches, the first n%k one longer."""
    return f"""select {row_id}, (case when rk < (n % {k}) * (n // {k} + 1) then rk // (n // {k} + 1)
      else (rk - (n % {k}) * (n // {k} + 1)) // (n // {k}) + n % {k} end)::int as fold
    from (select {row_id}, row_number() over (order by {order}) - 1 as rk, count(*) over () as n from {source})"""


@query(
    "sp7_fold_columns",
    f"with f as ({fold_sql('events', 'event_id', 5, hash_sql(200, 'event_id') + ', event_id')}) select event_id, "
    + ", ".join(f"case when fold = {i} then 'test' else 'train' end as ml_phase_fold_{i}" for i in range(5))
    + " from f",
)
def sp7(spark, folder):
    return datasets.with_folds(_events(spark, folder), "event_id")


@query(
    "sp8_fold_roles",
    f"""with f as ({fold_sql('part', 'p_partkey', 3, hash_sql(42, 'p_partkey') + ', p_partkey')}), k as (select unnest([0, 1, 2]) as fold)
    select p_partkey, k.fold, case when f.fold = k.fold then 'val' else 'train' end as role from f, k""",
)
def sp8(spark, folder):
    return split.fold_roles(table(spark, folder, "part"), "p_partkey", 3, 42)


@query("sp8_unshuffled_folds", fold_sql("part", "p_partkey", 7, "p_partkey"))
def sp8_unshuffled(spark, folder):
    return split.with_fold(table(spark, folder, "part").select("p_partkey"), "p_partkey", 7, None)


@query("sp9_hold_out", f"with r as ({ranked_sql('orders', 'o_orderkey', 9)}) select o_orderkey, case when rk < ceil(0.2 * n) then 'val' else 'train' end as ml_phase from r")
def sp9(spark, folder):
    return split.hold_out(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey", 0.2, 8)


@query("sp10_merge_train_val", "select event_id, value from events where event_type in ('click', 'view')")
def sp10(spark, folder):
    events = _events(spark, folder, "value", "event_type")
    train, val = (events.filter(F.col("event_type") == t).drop("event_type") for t in ("click", "view"))
    return split.merge_train_val(train, val)


@query(
    "sp11_shuffled_batches",
    f"with r as (select event_id, value, rk // 250 as batch_id from ({ranked_sql('events', 'event_id', 5, ', value')})) select batch_id, count(*) as rows, round(avg(value), 6) as mean from r group by 1",
)
def sp11(spark, folder):
    batches = split.with_batch(_events(spark, folder, "value"), "event_id", 250, 5)
    return rounded(batches.groupBy("batch_id").agg(F.count("*").alias("rows"), F.avg("value").alias("mean")))


@query("sp11_ordered_batches", "select o_orderkey, (row_number() over (order by o_orderkey) - 1) // 64 as batch_id from orders")
def sp11_ordered(spark, folder):
    return split.with_batch(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey", 64, None)


@query(
    "j2_complement",
    "with g as (select distinct o_custkey from orders where o_orderstatus = 'F') select c_custkey, c_acctbal from customer where c_custkey not in (select o_custkey from g)",
)
def j2(spark, folder):
    buyers = table(spark, folder, "orders").filter(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return split.complement(table(spark, folder, "customer").select("c_custkey", "c_acctbal"), buyers, "c_custkey")


@query(
    "s7_dataset",
    f"""with r as ({ranked_sql('part', 'p_partkey', 200, ', p_name, p_retailprice')}),
    p as (select *, case when rk < n - 60 then 'train' when rk < n - 30 then 'val' else 'test' end as ml_phase from r),
    s as (select avg(p_retailprice) as mean, stddev_pop(p_retailprice) as std from p where ml_phase = 'train')
    select p_partkey, p_name, ml_phase, round((p_retailprice - mean) / std, 6) + 0.0 as p_retailprice_transformed from p, s""",
)
def s7(spark, folder):
    spec = {"src": f"{folder}/part.parquet", "x_column": ["p_name"], "y_column": ["p_retailprice"], "split": [None, 30, 30]}
    data = load_dataset(spark, spec, "p_partkey")
    scaled = data.table.select("p_partkey", data.x_column, data.phase, data.scaler.forward(data.y_column).alias("p_retailprice_transformed"))
    return rounded(scaled)


@query("b1_equal_width_bin", f"with {MEASURED_EVENTS} select event_id, (case when pce > 0 and not isnan(pce) then ceil(pce / 0.2::double) - 1 end)::int as bin from measured")
def b1(spark, folder):
    return measured_events(spark, folder).select("event_id", binning.equal_width_bin("pce", 0.2).alias("bin"))


EDGES = """v as (select event_id, value, row_number() over (order by value, event_id) - 1 as rk, count(*) over () as n from events),
edges as (select k, case when k = 0 then 0.0 else value end as edge from (select unnest(generate_series(0, 8)) as k) join v on rk = ((n - 1) * k) // 8)"""


@query("b2_quantile_bin", f"with {EDGES} select event_id, (select max(k) from edges where edge < value)::int as bin from events")
def b2(spark, folder):
    return binning.with_balanced_bin(_events(spark, folder, "value"), "value", 8).select("event_id", "bin")


@query("b2_quantile_edges", f"with {EDGES} select k::int as k, edge::double as edge from edges")
def b2_edges(spark, folder):
    events = table(spark, folder, "events")
    edges = binning.quantile_edges(events, "value", 8)
    return events.agg(F.array(*[F.lit(e) for e in edges]).alias("e")).select(F.posexplode("e").alias("k", "edge"))


@query("b3_bin_counts", f"with {EDGES}, b as (select (select max(k) from edges where edge < value)::int as bin from events) select bin, count(*) as count from b group by bin")
def b3(spark, folder):
    return binning.bin_counts(binning.with_balanced_bin(_events(spark, folder, "value"), "value", 8))


@query("b4_grid_counts", "select floor(l_quantity / 5)::bigint as x_cell, floor(l_extendedprice / 10000)::bigint as y_cell, count(*) as count from lineitem group by 1, 2")
def b4(spark, folder):
    return binning.grid_counts(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice", 5.0, 10000.0)
