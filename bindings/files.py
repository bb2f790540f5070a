"""Files written from the given tables and read back through every source and sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import query
from bindings.tables import MOLECULES, PREDICTIONS, TRIALS, metrics_sql, molecules, predictions, rounded, table, trial_table, DIGITS
from solvane.operators.metrics import metrics_by
from solvane.operators.scaling import Scaler
from solvane.sources import records, sinks, tables
from solvane.storage import scratch_path


@query("s1_csv_scan", f"with {MOLECULES} select id, smiles as \"SMILES_str\", pce from molecules")
def s1(spark, folder):
    path = scratch_path(spark, "molecules")
    sinks.write_csv(molecules(spark, folder).withColumnRenamed("smiles", "SMILES_str"), path)
    return tables.read_csv(spark, path, tables.MOLECULE_SCHEMA)


@query("s1_csv_inferred", "select c_custkey, c_name, c_acctbal from customer")
def s1_inferred(spark, folder):
    path = scratch_path(spark, "customers")
    sinks.write_csv(table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    return tables.read_csv(spark, path).withColumn("c_custkey", F.col("c_custkey").cast("bigint"))


@query(
    "s2_polymer_scan",
    """select p_partkey as id, p_name || ' é' as nickname, p_brand as refno, p_retailprice as pcemax, p_retailprice / 2 as pceave, p_size::double as voc,
    p_size * 2.0::double as jsc, 1.0::double as ff, 2.0::double as mw, 3.0::double as mn, 4.0::double as pdi, p_type as monomer, 5.0::double as neghomo,
    case when p_size > 25 then p_size::double end as neglumo, 7.5::double as bandgap, 'ü' || p_name as smiles from part""",
)
def s2(spark, folder):
    path = scratch_path(spark, "polymers")
    p = table(spark, folder, "part")
    wide = p.select(
        F.col("p_partkey").alias("No"), F.concat("p_name", F.lit(" é")).alias("Nickname (ß)"), F.col("p_brand").alias("Ref. No."), F.col("p_retailprice").alias("PCE max"),
        (F.col("p_retailprice") / 2).alias("PCE ave"), F.col("p_size").cast("double").alias("Voc"), (F.col("p_size") * 2.0).alias("Jsc"), F.lit(1.0).alias("FF"),
        F.lit(2.0).alias("Mw"), F.lit(3.0).alias("Mn"), F.lit(4.0).alias("PDI"), F.col("p_type").alias("Monomer"), F.lit(5.0).alias("-HOMO"),
        F.when(F.col("p_size") > 25, F.col("p_size").cast("double")).alias("-LUMO"), F.lit(7.5).alias("Gap"), F.concat(F.lit("ü"), "p_name").alias("SMILES"),
    )
    wide.write.option("header", True).option("sep", "\t").option("encoding", "ISO-8859-1").csv(path)
    return tables.read_polymers(spark, path)


def record_text():
    """One order as a record of several lines with 0 to 2 conformers."""
    conformer = lambda i: F.concat_ws("\n", F.concat(F.lit("Conformer "), i.cast("string")), F.lit("2"), F.lit("C 0 0 0"), F.lit("S 0 0 1"), *[F.lit(f"dft {n}") for n in range(4)])
    count = (F.col("o_orderkey") % 3).cast("int")
    conformers = F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), conformer)).otherwise(F.array().cast("array<string>"))
    homo = F.when(F.col("o_orderkey") % 5 == 0, F.lit("nan")).otherwise(F.lit("-5.1"))
    fields = F.concat_ws(",", F.concat(F.lit("doi-"), F.col("o_orderkey").cast("string")), F.lit("KEY"), F.lit("bulk"), F.col("o_orderpriority"), F.col("o_orderstatus"),
                         homo, F.lit("-3.2"), F.lit("1.9"), F.lit("1.8"), F.col("o_totalprice").cast("string"), F.lit("0.8"), F.lit("9.1"), F.lit("0.6"))
    smiles = F.concat(F.lit("C"), F.col("o_orderkey").cast("string"))
    return F.concat_ws("\n", smiles, F.concat(F.lit("InChI=1S/"), F.col("o_orderkey").cast("string")), fields, F.concat(smiles, F.lit("p")), count.cast("string"), F.array_join(conformers, "\n"))


def write_records(spark, folder, path):
    # A record without conformers ends with its count line, not with an empty line.
    table(spark, folder, "orders").select(F.rtrim(record_text(), F.lit("\n")).alias("value")).write.text(path)


@query(
    "s3_record_scan",
    """select 'C' || o_orderkey as smiles, 'InChI=1S/' || o_orderkey as inchi, 'doi-' || o_orderkey as doi, o_orderpriority as architecture, o_orderstatus as complement,
    case when o_orderkey % 5 = 0 then null else -5.1::double end as homo, o_totalprice as pce, 0.6::double as fillfactor, 'C' || o_orderkey || 'p' as prunedsmiles,
    (o_orderkey % 3)::int as numberconformers, true as unfilled from orders""",
)
def s3(spark, folder):
    path = scratch_path(spark, "records")
    write_records(spark, folder, path)
    found = records.read_records(spark, path)
    return found.select("smiles", "inchi", "doi", "architecture", "complement", F.nanvl("homo", F.lit(None)).alias("homo"), "pce", "fillfactor", "prunedsmiles", "numberconformers", F.col("conformers").isNull().alias("unfilled"))


@query("s4_indexed_csv", "select event_id as row_id, value from events")
def s4(spark, folder):
    path = scratch_path(spark, "indexed")
    sinks.write_csv(table(spark, folder, "events").select(F.col("event_id").alias("_c"), "value"), path)
    return tables.read_indexed_csv(spark, path, "n bigint, value double")


@query("s5_optional_input", "select s_suppkey as row_id, s_acctbal as value from supplier union all select c_custkey, c_acctbal from customer")
def s5(spark, folder):
    first, second, absent = (scratch_path(spark, n) for n in ("first", "second", "absent"))
    schema = "n bigint, value double"
    sinks.write_csv(table(spark, folder, "supplier").select("s_suppkey", "s_acctbal"), first)
    sinks.write_csv(table(spark, folder, "customer").select("c_custkey", "c_acctbal"), second)
    alone = tables.read_all(spark, first, absent, schema)
    return tables.read_all(spark, first, second, schema).join(alone.limit(0).select("row_id"), "row_id", "left_anti")


@query("ks1_csv_sink", "select event_id, event_type, value from events where value >= 50")
def ks1(spark, folder):
    path = scratch_path(spark, "events")
    sinks.write_csv(table(spark, folder, "events").select("event_id", "event_type", "value").filter("value >= 50"), path)
    return tables.read_csv(spark, path, "event_id bigint, event_type string, value double")


SCALER = Scaler(30.0, 20.0)


@query(
    "ks2_prediction_sink",
    f"""with {PREDICTIONS} select phase, count(*) as rows, round(sum((measured - 30) / 20), 4) as measured, round(sum((predicted - 30) / 20), 4) as predicted from predictions group by phase""",
)
def ks2(spark, folder):
    path = scratch_path(spark, "predictions")
    sinks.write_predictions(predictions(spark, folder), path, SCALER)
    stored = spark.read.parquet(path)
    return rounded(stored.groupBy("phase").agg(F.count("*").alias("rows"), F.sum("Measured PCE").alias("measured"), F.sum("Predicted PCE").alias("predicted")), 4)


@query("ks2_prediction_sink_inverse", f"with {PREDICTIONS} select phase, count(*) as rows, round(sum(measured), 4) as measured, round(sum(predicted), 4) as predicted from predictions group by phase")
def ks2_inverse(spark, folder):
    path = scratch_path(spark, "predictions")
    sinks.write_predictions(predictions(spark, folder), path, SCALER, inverse=True)
    stored = spark.read.parquet(path)
    return rounded(stored.groupBy("phase").agg(F.count("*").alias("rows"), F.sum("Measured PCE").alias("measured"), F.sum("Predicted PCE").alias("predicted")), 4)


@query("ks3_metrics_sink", f"with {PREDICTIONS} select phase, {metrics_sql('measured', 'predicted')} from predictions group by phase")
def ks3(spark, folder):
    path = scratch_path(spark, "metrics")
    sinks.write_metrics(metrics_by(predictions(spark, folder), ["phase"]), path)
    return rounded(tables.read_csv(spark, path, "phase string, mse double, rmse double, R2 double, r double, mae double, count bigint"), DIGITS)


@query("ks4_trial_sink", f"with {TRIALS} select study, number, state, value from trials")
def ks4(spark, folder):
    path = scratch_path(spark, "trials")
    recorded = trial_table(spark, folder)
    for half in (0, 1):
        sinks.append_trials(recorded.filter(F.col("number") % 2 == half), path)
    return spark.read.parquet(path).select("study", "number", "state", "value")


@query("ks5_metric_log_sink", "select (user_id % 20)::int as trial, (event_id % 3)::int as fold, event_id as epoch, value as val_loss from events")
def ks5(spark, folder):
    path = scratch_path(spark, "metric-log")
    log = table(spark, folder, "events").select(
        (F.col("user_id") % 20).cast("int").alias("trial"), (F.col("event_id") % 3).cast("int").alias("fold"), F.col("event_id").alias("epoch"), F.col("value").alias("val_loss")
    )
    sinks.append_metric_log(log, path)
    return spark.read.parquet(path).select("trial", "fold", "epoch", "val_loss")
