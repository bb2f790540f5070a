"""The given tables in the roles the operators need, in Spark and, as CTE text, in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def hash_sql(seed, row_id: str) -> str:
    return f"('0x' || substr(md5('{seed}:' || ({row_id})::varchar), 1, 8))::bigint"


def uniform_sql(seed, row_id: str) -> str:
    return f"({hash_sql(seed, row_id)} / 4294967296.0)"


# Targets with missing values: events with nulls and NaN put in.
def measured_events(spark: SparkSession, folder: str) -> DataFrame:
    missing = F.when(F.col("event_id") % 7 == 0, F.lit(None)).when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return table(spark, folder, "events").select("event_id", "user_id", "event_type", missing.cast("double").alias("pce"))


MEASURED_EVENTS = """measured as (
  select event_id, user_id, event_type,
         case when event_id % 7 = 0 then null when event_id % 11 = 0 then 'nan'::double else value end as pce
  from events)"""


# Molecule strings: one per order, spelled from its columns; some are not closed.
def molecules(spark: SparkSession, folder: str) -> DataFrame:
    core = F.when(F.col("o_orderstatus") == "F", "c1ccsc1").when(F.col("o_orderstatus") == "O", "C1=Cc2ccoc2[SiH2]1").otherwise("[se]1cccc1")
    first = F.substring("o_orderpriority", 1, 1)
    side = (
        F.when(first == "1", "-c1cncs1").when(first == "2", "N(C)C(=O)").when(first == "3", "C(=O)OC").when(first == "4", "c3cc[nH]c3").otherwise(
            F.when(F.col("o_custkey") % 3 == 0, "C(C").when(F.col("o_custkey") % 3 == 1, "C4CC").otherwise("Cl")
        )
    )
    tail = F.expr("repeat('C', cast(o_custkey % 7 as int))")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(core, side, tail).alias("smiles"), (F.col("o_totalprice") / 50000.0).alias("pce")
    )


MOLECULES = """molecules as (
  select o_orderkey as id,
         (case when o_orderstatus = 'F' then 'c1ccsc1' when o_orderstatus = 'O' then 'C1=Cc2ccoc2[SiH2]1' else '[se]1cccc1' end)
         || (case substr(o_orderpriority, 1, 1) when '1' then '-c1cncs1' when '2' then 'N(C)C(=O)' when '3' then 'C(=O)OC'
             when '4' then 'c3cc[nH]c3'
             else case when o_custkey % 3 = 0 then 'C(C' when o_custkey % 3 = 1 then 'C4CC' else 'Cl' end end)
         || repeat('C', (o_custkey % 7)::int) as smiles,
         o_totalprice / 50000.0 as pce
  from orders)"""

ATOMS_SQL = r"'\[[^\[\]]+\]|Br|Cl|B|C|N|O|P|S|F|I|b|c|n|o|p|s'"

# Lexical validity of a SMILES string, by counting marks instead of folding over them.
VALID = (
    MOLECULES
    + r""", marks as (
  select id, unnest(regexp_extract_all(smiles, '[()]')) as mark, generate_subscripts(regexp_extract_all(smiles, '[()]'), 1) as nth
  from molecules),
depths as (select id, nth, sum(case when mark = '(' then 1 else -1 end) over (partition by id order by nth) as depth from marks),
branches as (select id, min(depth) as least, arg_max(depth, nth) as final from depths group by id),
numbers as (
  select id, unnest(regexp_extract_all(regexp_replace(smiles, '\[[^\[\]]*\]', '', 'g'), '%[0-9]{2}|[0-9]')) as number from molecules),
rings as (select id, bool_or(n % 2 = 1) as open from (select id, number, count(*) as n from numbers group by id, number) group by id),
checked as (
  select m.*, regexp_full_match(smiles, '(' || """
    + ATOMS_SQL
    + r""" || '|[-=#$:/\\.~()]|%[0-9]{2}|[0-9])+')
         and coalesce(b.least, 0) >= 0 and coalesce(b.final, 0) = 0 and not coalesce(r.open, false) as valid
  from molecules m left join branches b using (id) left join rings r using (id))"""
)


# Measured values beside predictions, in thousands.
def predictions(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linenumber")
    parts = table(spark, folder, "part").select("p_partkey", "p_retailprice")
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    phase = F.when(F.col("l_returnflag") == "A", "train").when(F.col("l_returnflag") == "N", "val").otherwise("test")
    return joined.select(
        phase.alias("phase"),
        F.pmod("l_orderkey", F.lit(5)).cast("int").alias("fold"),
        F.col("l_linenumber").alias("epoch"),
        F.pmod("l_orderkey", F.lit(97)).cast("int").alias("batch"),
        (F.col("l_extendedprice") / 1000.0).alias("measured"),
        (F.col("l_quantity") * F.col("p_retailprice") / 1000.0).alias("predicted"),
    )


PREDICTIONS = """predictions as (
  select case l_returnflag when 'A' then 'train' when 'N' then 'val' else 'test' end as phase,
         (l_orderkey % 5)::int as fold, l_linenumber as epoch, (l_orderkey % 97)::int as batch,
         l_extendedprice / 1000.0 as measured, l_quantity * p_retailprice / 1000.0 as predicted
  from lineitem join part on l_partkey = p_partkey)"""


def metrics_sql(y: str, p: str) -> str:
    """The six metrics, each rounded, as a select list."""
    error = f"({y} - {p})"
    return f"""round(avg({error} * {error}), 5) as mse, round(sqrt(avg({error} * {error})), 5) as rmse,
       round(1 - avg({error} * {error}) / var_pop({y}), 6) + 0.0 as "R2",
       round(covar_pop({y}, {p}) / nullif(stddev_pop({y}) * stddev_pop({p}), 0), 6) + 0.0 as r,
       round(avg(abs({error})), 6) as mae, count({y})::bigint as count"""


DIGITS = {"mse": 5, "rmse": 5, "R2": 6, "r": 6, "mae": 6}


def rounded(df: DataFrame, digits: int | dict[str, int] = 6) -> DataFrame:
    """Round double columns so that the order of summation does not show."""
    columns = []
    for field in df.schema:
        if field.dataType.simpleString() == "double":
            places = digits if isinstance(digits, int) else digits.get(field.name, 6)
            columns.append(F.round(F.col(f"`{field.name}`"), places).alias(field.name))
        else:
            columns.append(F.col(f"`{field.name}`"))
    return df.select(*columns)


# Words of a text, as tokens.
def words(text: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def document_words(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, lang, n_chars, tokens)"""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "n_chars", "text")
    return docs.select("doc_id", "lang", "n_chars", words("text").alias("tokens"))


DOCUMENT_WORDS = r"""docs as (select doc_id, lang, n_chars, regexp_extract_all(lower(text), '\p{L}+') as tokens from documents),
tokens as (select doc_id, lang, unnest(tokens) as token, generate_subscripts(tokens, 1) - 1 as pos from docs)"""


# Trials and metric logs from events.
def trial_table(spark: SparkSession, folder: str) -> DataFrame:
    state = F.when(F.col("event_type") == "error", "FAIL").when(F.col("event_type") == "view", "RUNNING").when(F.col("event_type") == "signup", "PRUNED").otherwise("COMPLETE")
    return table(spark, folder, "events").select(
        F.concat(F.lit("study-"), (F.col("user_id") % 12).cast("string")).alias("study"),
        F.col("event_id").alias("number"),
        state.alias("state"),
        "value",
    )


TRIALS = """trials as (
  select 'study-' || (user_id % 12)::varchar as study, event_id as number,
         case event_type when 'error' then 'FAIL' when 'view' then 'RUNNING' when 'signup' then 'PRUNED' else 'COMPLETE' end as state,
         value
  from events)"""
