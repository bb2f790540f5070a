"""Dictionaries, sequences, and array and string functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import query
from bindings.tables import ATOMS_SQL, DOCUMENT_WORDS, MOLECULES, VALID, document_words, molecules, rounded, table, words
from solvane.functions import arrays, smiles
from solvane.functions.callables import resolve, row_featuriser
from solvane.operators import vocab
from solvane.plans.datasets import extended_dictionary
from solvane.storage import cut
from solvane.sources.vocabularies import NODE_TYPES, node_token, vocabulary

FIRST_SEEN = """first as (select token, min((doc_id, pos)) as met from tokens group by token),
vocabulary as (select token, row_number() over (order by met) - 1 as idx from first)"""

ENGLISH = """first as (select token, min((doc_id, pos)) as met from tokens where lang = 'en' group by token),
vocabulary as (select token, row_number() over (order by met) - 1 as idx from first)"""


def _tokens(spark, folder, language=None):
    return vocab.token_rows(_docs(spark, folder, language), "doc_id", "tokens")


def _docs(spark, folder, language=None):
    docs = document_words(spark, folder)
    return docs if language is None else docs.filter(F.col("lang") == language)


@query("w1_build_vocabulary", f"with {DOCUMENT_WORDS}, {FIRST_SEEN} select token, idx from vocabulary")
def w1(spark, folder):
    return vocab.build_vocabulary(_docs(spark, folder), "doc_id", "tokens")


@query(
    "w2_extend_vocabulary",
    f"""with {DOCUMENT_WORDS}, {ENGLISH},
    new as (select token, min((doc_id, pos)) as met from tokens where lang = 'de' and token not in (select token from vocabulary) group by token)
    select token, idx from vocabulary union all
    select token, row_number() over (order by met) - 1 + (select count(*) from vocabulary) from new""",
)
def w2(spark, folder):
    known = vocab.build_vocabulary(_docs(spark, folder, "en"), "doc_id", "tokens")
    return extended_dictionary(known, _docs(spark, folder, "de"), "doc_id", "tokens")


@query(
    "w2_extend_with_zero",
    f"""with {DOCUMENT_WORDS}, {ENGLISH}
    select token, idx from vocabulary union all select distinct token, 0::bigint from tokens where lang = 'fr' and token not in (select token from vocabulary)""",
)
def w2_zero(spark, folder):
    known = vocab.build_vocabulary(_docs(spark, folder, "en"), "doc_id", "tokens")
    return vocab.extend_vocabulary(known, vocab.first_seen(_docs(spark, folder, "fr"), "doc_id", "tokens"), zero_for_new=True)


@query(
    "w3_encode_sequences",
    f"""with {DOCUMENT_WORDS}, {ENGLISH},
    e as (select doc_id, string_agg(coalesce(idx, -1)::varchar, ',' order by pos) as ids, count(*) as length from tokens t left join vocabulary v on t.token = v.token group by doc_id)
    select d.doc_id, coalesce(e.ids, '') as ids, coalesce(e.length, 0)::int as length from docs d left join e on d.doc_id = e.doc_id""",
)
def w3(spark, folder):
    known = vocab.build_vocabulary(_docs(spark, folder, "en"), "doc_id", "tokens")
    encoded = vocab.encode_sequences(document_words(spark, folder), "doc_id", "tokens", known)
    return encoded.select("doc_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), F.size("ids").alias("length"))


@query(
    "w3_encode_strict",
    f"""with {DOCUMENT_WORDS}, {FIRST_SEEN} select doc_id, sum(idx)::bigint as total from tokens join vocabulary using (token) group by doc_id""",
)
def w3_strict(spark, folder):
    known = vocab.build_vocabulary(_docs(spark, folder), "doc_id", "tokens")
    encoded = vocab.encode_rows(_tokens(spark, folder), "token", known, strict=True)
    return encoded.groupBy("doc_id").agg(F.sum("idx").alias("total"))


PART_WORDS = "w as (select p_partkey, p_brand, unnest(string_split(p_name, ' ')) as token, generate_subscripts(string_split(p_name, ' '), 1) - 1 as pos from part)"


@query(
    "j1_dictionary_lookup",
    f"""with {PART_WORDS}, f as (select token, min((p_partkey, pos)) as met from w where p_brand in ('Brand#1', 'Brand#2') group by token),
    v as (select token, row_number() over (order by met) - 1 as idx from f)
    select p_partkey, string_agg(coalesce(idx, -1)::varchar, ',' order by pos) as ids from w left join v using (token) group by p_partkey""",
)
def j1(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_brand", F.split("p_name", " ").alias("tokens"))
    known = vocab.build_vocabulary(parts.filter(F.col("p_brand").isin("Brand#1", "Brand#2")), "p_partkey", "tokens")
    encoded = vocab.encode_sequences(parts, "p_partkey", "tokens", known)
    return encoded.select("p_partkey", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("w4_vocabulary_difference", f"with {DOCUMENT_WORDS} select distinct token from tokens where lang = 'fr' and token not in (select token from tokens where lang = 'en')")
def w4(spark, folder):
    return vocab.vocabulary_difference(_tokens(spark, folder, "fr").select("token").distinct(), _tokens(spark, folder, "en").select("token").distinct())


@query(
    "w4_rows_with_unknown",
    f"with {DOCUMENT_WORDS}, v as (select distinct token from tokens where lang = 'en') select distinct doc_id from tokens where lang <> 'en' and token not in (select token from v)",
)
def w4_rows(spark, folder):
    known = cut(_tokens(spark, folder, "en").select("token").distinct().withColumn("idx", F.lit(0)))
    return vocab.rows_with_unknown(document_words(spark, folder).filter(F.col("lang") != "en"), "doc_id", "tokens", known)


@query("w7_sorted_ends", "select least(l_partkey, l_suppkey) as low, greatest(l_partkey, l_suppkey) as high, count(*) as n from lineitem group by 1, 2")
def w7(spark, folder):
    lines = table(spark, folder, "lineitem").select(F.least("l_partkey", "l_suppkey").alias("low"), F.greatest("l_partkey", "l_suppkey").alias("high"))
    return lines.groupBy("low", "high").agg(F.count("*").alias("n"))


# Atoms of the molecule strings
ATOMS = (
    MOLECULES
    + f""", tokens as (select id, unnest(regexp_extract_all(smiles, {ATOMS_SQL})) as token, generate_subscripts(regexp_extract_all(smiles, {ATOMS_SQL}), 1) - 1 as pos from molecules),
raw as (select *, regexp_extract(token, '^\\[?[0-9]*([A-Z][a-z]?|[a-z][a-z]?)', 1) as symbol_text from tokens),
atoms as (select id, pos, token, upper(substr(symbol_text, 1, 1)) || substr(symbol_text, 2) as symbol, regexp_matches(symbol_text, '^[a-z]') as aromatic from raw)"""
)


def atoms(spark, folder):
    exploded = vocab.token_rows(molecules(spark, folder).select("id", smiles.atom_tokens("smiles").alias("tokens")), "id", "tokens")
    symbol = smiles.raw_symbol(F.col("token"))
    return exploded.select("id", "pos", "token", F.concat(F.upper(F.substring(symbol, 1, 1)), F.substring(symbol, 2, 1)).alias("symbol"), smiles.is_aromatic(F.col("token")).alias("aromatic"))


@query("q7_atom_tokens", f"with {ATOMS} select id, pos::int as pos, token, symbol, aromatic from atoms")
def q7(spark, folder):
    return atoms(spark, folder)


@query("q7_element_counts", f"with {ATOMS} select id, count(*) filter (where symbol = 'C')::int as carbons, count(*) filter (where symbol = 'S')::int as sulphurs, count(*)::int as atoms from atoms group by id")
def q7_counts(spark, folder):
    return molecules(spark, folder).select(
        "id", smiles.element_count("smiles", "C").alias("carbons"), smiles.element_count("smiles", "S").alias("sulphurs"), smiles.heavy_atoms("smiles").alias("atoms")
    )


@query("q7_lexical_checks", f"with {VALID} select id, valid from checked")
def q7_valid(spark, folder):
    return molecules(spark, folder).select("id", smiles.looks_valid("smiles").alias("valid"))


_VALUES = ", ".join(f"('{node_token(t)}', {i})" for i, t in enumerate(NODE_TYPES))


@query(
    "s6_static_vocabulary",
    f"""with {ATOMS}, v as (select * from (values {_VALUES}) as t(token, idx))
    select id, pos::int as pos, coalesce(v.idx, -1)::int as idx from atoms left join v on v.token = symbol || case when aromatic then '|aromatic' else '' end""",
)
def s6(spark, folder):
    label = F.when(F.col("aromatic"), F.concat("symbol", F.lit("|aromatic"))).otherwise(F.col("symbol"))
    labelled = atoms(spark, folder).withColumn("label", label)
    return vocab.encode_rows(labelled, "label", vocabulary(spark, "HOPV15", "node")).select("id", "pos", "idx")


_ONE_HOT = " || ".join(f"(symbol = '{s}')::int::varchar" for s in arrays.ATOM_SYMBOLS)


@query(
    "q2_one_hot",
    f"""with {ATOMS} select id, pos::int as pos, {_ONE_HOT}
    || (symbol not in ({', '.join(repr(s) for s in arrays.ATOM_SYMBOLS)}))::int::varchar || aromatic::int::varchar as features from atoms""",
)
def q2(spark, folder):
    features = arrays.one_hot("symbol", F.col("aromatic"))
    return atoms(spark, folder).select("id", "pos", F.array_join(features.cast("array<string>"), "").alias("features"))


@query("q3_bit_columns", "select vec_id, " + ", ".join(f"(embedding[{i + 1}] > 0)::int as fp{i}" for i in range(64)) + " from embeddings")
def q3(spark, folder):
    bits = table(spark, folder, "embeddings").withColumn("bits", arrays.positive_positions("embedding"))
    return bits.select("vec_id", *[c.alias(n) for n, c in arrays.bit_columns("bits", 64).items()])


@query(
    "q4_concatenate_features",
    "select vec_id, (len(embedding) + 2)::int as width, round(list_sum(list_transform(embedding, lambda v: (v > 0)::int::double)) + label + vec_id, 6) as total from embeddings",
)
def q4(spark, folder):
    vectors = table(spark, folder, "embeddings").withColumn("bits", arrays.positive_positions("embedding"))
    joined = F.concat(arrays.dense_bits("bits", 64), F.array(F.col("label").cast("double"), F.col("vec_id").cast("double")))
    wide = vectors.select("vec_id", joined.alias("features"))
    return rounded(wide.select("vec_id", F.size("features").alias("width"), F.aggregate("features", F.lit(0.0), lambda t, v: t + v).alias("total")))


@query("q5_featurise_distinct", "select p_partkey, p_name, len(string_split(p_name, ' '))::int as n_tokens, length(p_name)::int as n_chars from part")
def q5(spark, folder):
    def featurise(names):
        return names.select("p_name", F.size(F.split("p_name", " ")).alias("n_tokens"), F.length("p_name").alias("n_chars"))

    return vocab.featurise_distinct(table(spark, folder, "part").select("p_partkey", "p_name"), "p_name", featurise, ["n_tokens", "n_chars"])


@query("q6_length", "select doc_id, length(text)::int as length from documents")
def q6(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.length("text").alias("length"))


@query(
    "q8_math",
    """select event_id, round(exp(-0.01 * (value - 50) * (value - 50)), 6) as rbf, round(sqrt(value), 6) as root, ceil(value / 0.2::double)::bigint as up from events""",
)
def q8(spark, folder):
    v = F.col("value")
    return rounded(table(spark, folder, "events").select("event_id", F.exp(-0.01 * (v - 50) * (v - 50)).alias("rbf"), F.sqrt(v).alias("root"), F.ceil(v / 0.2).alias("up")))


@query("f1_name_or_callable", "select p_partkey, upper(p_name) as x, p_retailprice * 2 as y from part")
def f1(spark, folder):
    parts = table(spark, folder, "part")
    return parts.select(resolve(parts, "p_partkey"), resolve(parts, lambda d: F.upper(d["p_name"])).alias("x"), resolve(parts, F.col("p_retailprice") * 2).alias("y"))


@query("f2_row_featuriser", "select p_partkey, list_sum(list_transform(string_split(p_name, ' '), lambda w: length(w)))::bigint as total from part")
def f2(spark, folder):
    word_lengths = row_featuriser(lambda name: [len(w) for w in name.split(" ")])

    def featurise(names):
        return names.withColumn("lengths", word_lengths("p_name"))

    parts = vocab.featurise_distinct(table(spark, folder, "part").select("p_partkey", "p_name"), "p_name", featurise, ["lengths"])
    return parts.select("p_partkey", F.aggregate("lengths", F.lit(0).cast("bigint"), lambda t, v: t + v).alias("total"))


@query("q5_distinct_texts", f"with {DOCUMENT_WORDS} select doc_id, len(tokens)::int as words, len(list_distinct(tokens))::int as different from docs")
def q5_texts(spark, folder):
    def featurise(texts):
        tokens = words("text")
        return texts.select("text", F.size(tokens).alias("words"), F.size(F.array_distinct(tokens)).alias("different"))

    return vocab.featurise_distinct(table(spark, folder, "documents").select("doc_id", "text"), "text", featurise, ["words", "different"]).drop("text")
