"""The operators of this package bound to the given tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


OP8 = """
with d as (
    select doc_id, source, coalesce(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')), 0)::bigint as size,
           ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as place
    from documents
), s as (
    select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as k from d group by source
), w as (
    select *, 2 * source_size::double as cap, [3.0, 1.0, 2.0][((k - 1) % 3) + 1]::double as weight from s
), l as (
    select *, cap / weight as stop,
        (1.5 * sum(source_size) over () - (sum(cap) over (order by cap / weight, k) - cap)) / (sum(weight) over () - (sum(weight) over (order by cap / weight, k) - weight)) as level
    from w
), t as (
    select source, source_size, least(cap, (select arg_min(level, stop) from l where stop >= level) * weight) as target from l
), u as (
    select d.doc_id, d.size, t.source_size, t.target, sum(d.size) over (partition by d.source order by d.place, d.size rows unbounded preceding) - d.size + d.size / 2.0 as middle
    from d join t on d.source is not distinct from t.source
)
select doc_id, size, source_size, target, (size * ((middle < target)::int + (middle + source_size < target)::int))::bigint as taken from u
"""


@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from solvane.llm.token_counts import count_tokens

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_file("byte_bpe_50k.json"))


@query("op4_bpe_round_trip")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from solvane.llm.bpe_words import encode_and_decode

    coded = encode_and_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_file("byte_bpe_50k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op9_token_files")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from solvane.llm.token_files import read_token_files, write_token_files
    from solvane.storage import scratch_path

    folder = scratch_path(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_file("word_bpe_49k.json"), folder, end_id=1)
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op7_document_fingerprints")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from solvane.llm.fingerprints import fingerprints

    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2 = """
with recursive v as materialized (
    select vec_id, label, embedding::double[] as x, sqrt(list_dot_product(embedding::double[], embedding::double[])) as length from embeddings
    where vec_id is not null and label is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding) and len(list_filter(embedding, lambda x: x <> 0)) > 0
), l as materialized (
    select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and len(a.x) = len(b.x) and a.vec_id <> b.vec_id
    where case when len(a.x) = len(b.x) then list_dot_product(a.x, b.x) / (a.length * b.length) end >= 0.93
), r(node, root) as (
    select vec_id, vec_id from v union select l.b, r.root from r join l on l.a = r.node
), c as (
    select node, min(root) as root from r group by node
), n as (
    select a, count(*) as n from l group by a
)
select vec_id, coalesce(n, 0)::bigint as n_links, coalesce(root, vec_id)::bigint as component_id, coalesce(vec_id = coalesce(root, vec_id), false) as kept
from embeddings left join c on vec_id = c.node left join n on vec_id = n.a
"""


@query("op2_embedding_links", OP2)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from solvane.llm.vector_links import link_vectors

    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.93)


@query("op6_simhash_near_duplicates")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from solvane.llm.simhash import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, most=3)


@query("op10_main_text")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from solvane.llm.extraction import extract

    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str):
    from solvane.llm.quality import fit, grades_of

    return fit(docs, grades_of(spark.read.parquet(f"{sf_dir}/labels.parquet")), grades=3)


@query("op5_quality_classifier")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from solvane.llm.quality import rate

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rate(docs, quality_model(spark, docs, sf_dir))


@query("op8_curriculum_mix", OP8)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from solvane.llm.curriculum import in_order, plan
    from solvane.storage import stage

    planned = plan(spark.read.parquet(f"{sf_dir}/documents.parquet"), carry=["doc_id"])
    planned = stage(planned, "plan")  # whole, with every copy's place, whatever columns are returned
    return in_order(planned).select("row.doc_id", "size", "source_size", "target", "taken")


@query("op3_balanced_shards")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from solvane.llm.shards import balanced_shards

    return balanced_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=24)


def lloyd_sql(rounds: int = 4) -> str:
    """Rounds of Lloyd's method as one table of choices (``a``) and one of entries (``b``) for each round."""
    steps = []
    for turn in range(rounds + 1):
        steps.append(f"""a{turn} as materialized (
    select r, m.p, any_value(m.x) as x, min((list_dot_product(m.x, m.x) - 2 * list_dot_product(m.x, b.x) + list_dot_product(b.x, b.x), e)) as near
    from m join b{turn} b on m.p = b.p group by r, m.p
)""")
        if turn < rounds:
            steps.append(f"""c{turn} as (
    select p, near[2] as e, unnest(generate_series(1, len(x))) as i, unnest(x)::bigint as y from a{turn}
), s{turn} as (
    select p, e, i, sum(y)::bigint as s, count(*)::bigint as n from c{turn} group by p, e, i
), t{turn} as (
    select p, e, list(((s - ((s % n) + n) % n) // n)::double order by i) as x from s{turn} group by p, e
), b{turn + 1} as materialized (
    select b.p, b.e, coalesce(t.x, b.x) as x from b{turn} b left join t{turn} t on b.p = t.p and b.e = t.e
)""")
    return f"""
with k as materialized (
    select row_number() over () as r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)) as x from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)
), m as materialized (
    select r, p, x[p * (len(x) // 4) + 1 : (p + 1) * (len(x) // 4)] as x from k, range(4) parts(p)
), f as (
    select r, row_number() over (order by vec_id nulls last, x) - 1 as e from k qualify e < 256
), b0 as materialized (
    select p, e, x from m join f using (r)
), {", ".join(steps)}, w as (
    select p, e, unnest(generate_series(1, len(x))) as i, unnest(x)::bigint as y from b{rounds}
), h as (
    select sha256(string_agg(y::varchar, ',' order by p, e, i)) as h from w
), g as (
    select r, string_agg(format('{{:02x}}', near[2]), '' order by p) as code, sum(near[1])::bigint as error from a{rounds} group by r
)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, h as codebooks_sha256 from k join g using (r), h
"""


@query("op11_vector_codes", lloyd_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from solvane.llm.codebooks import code_vectors

    return code_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP13 = """
with d as (
    select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as terms
    from documents
), c as (
    select count(*)::bigint as nn, sum(len(terms))::bigint as ll from d where len(terms) > 0
), i as (
    select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from benchmark
), p as (
    select r, doc_id, term, count(*)::bigint as tf, any_value(n)::bigint as n from (select r, doc_id, len(terms) as n, unnest(terms) as term from d)
    where term in (select term from i) group by r, doc_id, term
), w as (
    select term, floor(1000 * ln((2 * any_value(nn) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from p, c group by term
), s as (
    select item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))))::bigint as score
    from i join p using (term) join w using (term), c group by item_id, r, doc_id
), k as (
    select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls last)::int as rank, doc_id, score from s where score > 0
)
select * from k where rank <= 10
"""


@query("op13_ranked_search", OP13)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from solvane.llm.lexical import build_index, search

    index = build_index(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op12_language_model_scores")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from solvane.llm.scoring import score_texts

    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
