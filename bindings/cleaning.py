"""Filters, projections, the cleaning chain, and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import query
from bindings.tables import DOCUMENT_WORDS, MEASURED_EVENTS, MOLECULES, VALID, document_words, measured_events, molecules, rounded, table, uniform_sql
from solvane.functions.arrays import cast_elements
from solvane.functions.smiles import heavy_atoms, looks_valid
from solvane.operators import clean, scaling, vocab
from solvane.plans.datasets import valid_molecules
from solvane.sources.tables import append
from solvane.storage import cut


@query("p1_drop_incomplete", f"with {MEASURED_EVENTS} select event_id, user_id, pce from measured where pce is not null and not isnan(pce)")
def p1(spark, folder):
    return clean.drop_incomplete(measured_events(spark, folder).select("event_id", "user_id", "pce"), ["user_id", "pce"])


@query("p2_at_least", f"with {MEASURED_EVENTS} select event_id, pce from measured where pce >= 100 and not isnan(pce)")
def p2(spark, folder):
    return clean.at_least(measured_events(spark, folder).select("event_id", "pce"), "pce", 100.0)


@query(
    "p2_threshold_counts",
    f"""with {MEASURED_EVENTS}, t as (select coalesce(pce >= 100 and not isnan(pce), false) as kept from measured)
    select count(*) as total, count(*) filter (where kept) as kept, count(*) filter (where not kept) as removed from t""",
)
def p2_counts(spark, folder):
    return clean.threshold_counts(measured_events(spark, folder), "pce", 100.0)


@query(
    "p3_thin_out_below",
    f"with {MEASURED_EVENTS} select event_id, pce from measured where (pce >= 40 and not isnan(pce)) or {uniform_sql(11, 'event_id')} >= 0.3",
)
def p3(spark, folder):
    return clean.thin_out_below(measured_events(spark, folder).select("event_id", "pce"), "event_id", "pce", 40.0, 0.3, seed=11)


@query("p4_keep_valid", f"with {VALID} select id, smiles, pce from checked where valid")
def p4(spark, folder):
    return clean.keep_valid(molecules(spark, folder), looks_valid("smiles"))


@query(
    "p4_validity_profile",
    f"""with {VALID} select count(*) filter (where valid) as valid, count(*) filter (where not valid) as invalid,
    max(length(smiles)) filter (where valid)::int as max_length,
    max(len(regexp_extract_all(smiles, '\\[[^\\[\\]]+\\]|Br|Cl|B|C|N|O|P|S|F|I|b|c|n|o|p|s'))) filter (where valid)::int as max_atoms from checked""",
)
def p4_profile(spark, folder):
    return clean.validity_profile(molecules(spark, folder), "smiles", looks_valid("smiles"), heavy_atoms("smiles"))


@query("p4_valid_of_first", f"with {VALID}, n as (select *, row_number() over (order by id) as nth from checked) select id, smiles, pce from n where valid and nth <= 9000")
def p4_first(spark, folder):
    return valid_molecules(molecules(spark, folder), "id", looks_valid("smiles"), 9000)


@query(
    "p5_rows_between",
    "with n as (select event_id, value, row_number() over (order by event_id) - 1 as nth from events) select event_id, value from n where nth >= 500 and nth < 8000",
)
def p5(spark, folder):
    return clean.rows_between(table(spark, folder, "events").select("event_id", "value"), ["event_id"], 500, 8000)


@query("u3_first_rows", "select o_orderkey, o_totalprice from orders order by o_orderkey limit 1000")
def u3(spark, folder):
    return clean.rows_between(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 0, 1000)


LANGUAGE_VOCABULARY = """vocabulary as (select distinct token from tokens where lang = 'en'),
bad as (select distinct doc_id from tokens where token not in (select token from vocabulary)),
flagged as (
  select doc_id, case when doc_id % 9 = 0 then 'nan'::double else n_chars::double end as target,
         doc_id not in (select doc_id from bad) as known
  from docs)"""


def _known_words(spark, folder):
    docs = document_words(spark, folder)
    target = F.when(F.col("doc_id") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("n_chars").cast("double"))
    english = docs.filter(F.col("lang") == "en")
    vocabulary = cut(vocab.token_rows(english, "doc_id", "tokens").select("token").distinct().withColumn("idx", F.lit(0)))
    return docs.select("doc_id", "tokens", target.alias("target")), vocabulary


@query("p7_known_and_measured", f"with {DOCUMENT_WORDS}, {LANGUAGE_VOCABULARY} select doc_id, target from flagged where known and not isnan(target)")
def p7(spark, folder):
    docs, vocabulary = _known_words(spark, folder)
    return clean.known_and_measured(docs, "doc_id", "tokens", "target", vocabulary).select("doc_id", "target")


@query(
    "p7_known_and_measured_counts",
    f"""with {DOCUMENT_WORDS}, {LANGUAGE_VOCABULARY} select count(*) filter (where known) as known,
    count(*) filter (where not isnan(target)) as measured, count(*) filter (where known and not isnan(target)) as both from flagged""",
)
def p7_counts(spark, folder):
    docs, vocabulary = _known_words(spark, folder)
    return clean.known_and_measured_counts(docs, "doc_id", "tokens", "target", vocabulary)


@query(
    "p8_clean_chain",
    f"""with {VALID}, n as (select *, row_number() over (order by id) - 1 as nth from checked)
    select id, smiles, pce from n
    where nth >= 200 and nth < 14000 and valid and pce >= 1.0 and (pce >= 4.0 or {uniform_sql(5, 'id')} >= 0.3)""",
)
def p8(spark, folder):
    return clean.clean(
        molecules(spark, folder), "id", "pce", looks_valid("smiles"), min_row=200, max_row=14000,
        threshold_skip=1.0, threshold_downsampling=4.0, threshold_percentage=0.3, seed=5,
    )


@query("p9_project_x", f"with {MOLECULES} select id, smiles from molecules")
def p9(spark, folder):
    return molecules(spark, folder).select("id", "smiles")


SCALED = "s as (select avg(value) as mean, stddev_pop(value) as std from events)"


@query("p10_standard_score", f"with {SCALED} select event_id, round((value - mean) / std, 6) + 0.0 as value_transformed from events, s")
def p10(spark, folder):
    events = table(spark, folder, "events").select("event_id", "value")
    scaler = scaling.fit_scaler(events, "value")
    return rounded(events.select("event_id", scaler.forward("value").alias("value_transformed")))


@query("p11_inverse_score", f"with {SCALED} select event_id, round(((value * 0.9 - mean) / std) * std + mean, 6) as predicted from events, s")
def p11(spark, folder):
    events = table(spark, folder, "events").select("event_id", "value")
    scaler = scaling.fit_scaler(events, "value")
    scored = events.withColumn("z", scaler.forward(F.col("value") * 0.9))
    return rounded(scored.select("event_id", scaler.inverse("z").alias("predicted")))


@query("p12_nan_to_zero", f"with {MEASURED_EVENTS} select event_id, event_type, case when pce is null or isnan(pce) then 0 else pce end as pce from measured")
def p12(spark, folder):
    return clean.nan_to_zero(measured_events(spark, folder), ["pce"], ["user_id"])


@query("p13_literal_phase", "select c_custkey, 'train' as ml_phase from customer")
def p13(spark, folder):
    return clean.with_phase(table(spark, folder, "customer").select("c_custkey"), "train")


@query("p14_cast_elements", "select vec_id, list_sum(list_transform(embedding, lambda v: trunc(v * 100)::int))::bigint as total from embeddings")
def p14(spark, folder):
    vectors = table(spark, folder, "embeddings").select("vec_id", F.transform("embedding", lambda v: v * F.lit(100.0).cast("float")).alias("v"))
    whole = vectors.withColumn("v", cast_elements("v", "int"))
    return whole.select("vec_id", F.aggregate("v", F.lit(0).cast("bigint"), lambda t, i: t + i).alias("total"))


@query(
    "u1_union_phases",
    """select o_orderkey, 'train' as ml_phase from orders where o_orderstatus = 'F' union all
    select o_orderkey, 'val' from orders where o_orderstatus = 'O' union all select o_orderkey, 'test' from orders where o_orderstatus = 'P'""",
)
def u1(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    parts = [clean.with_phase(orders.filter(F.col("o_orderstatus") == s), p) for s, p in (("F", "train"), ("O", "val"), ("P", "test"))]
    return append(append(parts[0], parts[1]), parts[2]).drop("o_orderstatus")


@query("u2_append", "select s_suppkey as key, s_acctbal as value from supplier union all select c_custkey, c_acctbal from customer")
def u2(spark, folder):
    suppliers = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("value"))
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("value"))
    return append(suppliers, customers)


@query("a2_token_maxima", "select max(length(p_name))::int as max_length, max(len(string_split(p_name, ' ')))::int as max_tokens from part")
def a2(spark, folder):
    return table(spark, folder, "part").agg(F.max(F.length("p_name")).alias("max_length"), F.max(F.size(F.split("p_name", " "))).alias("max_tokens"))
