"""Graphs: one per order, nodes its line numbers, with chain, ring and same-label edges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from bindings import query
from bindings.tables import ATOMS_SQL, VALID, molecules, rounded, table
from solvane.functions.arrays import shift_and_pad
from solvane.operators import fingerprint, graph, vocab
from solvane.operators.ranking import global_rank
from solvane.plans.datasets import with_fingerprints
from solvane.storage import cut, deal, stage

GRAPHS = """base as materialized (
  select l_orderkey as graph_id, l_linenumber, min(l_returnflag || l_linestatus) as label, avg(l_quantity) as h0, avg(l_tax) as h1
  from lineitem group by 1, 2),
nodes as materialized (select graph_id, (row_number() over (partition by graph_id order by l_linenumber) - 1)::int as node_id, label, h0, h1 from base),
around as materialized (
  select graph_id, node_id, label, count(*) over (partition by graph_id) as n,
         lead(label, 2) over (partition by graph_id order by node_id) as second from nodes),
bonds as materialized (
  select graph_id, node_id as src, (node_id + 1)::int as dst, 'S' as bond from around where node_id + 1 < n
  union all select graph_id, node_id, 0, 'R' from around where node_id + 1 = n and n >= 3
  union all select graph_id, node_id, node_id + 2, 'D' from around where second = label),
edges as materialized (select graph_id, src, dst, bond from bonds union all select graph_id, dst, src, bond from bonds)"""


def nodes_and_edges(spark, folder):
    """Node and edge tables: an order's lines by number. Windows run along the lines of an order; none of them lists it."""
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("graph_id"), "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("label"), "l_quantity", "l_tax"
    )
    # Dealt by order once: the grouping and the windows need no other shuffle, and share one sort.
    lines = deal(lines, lines.count(), "graph_id").groupBy("graph_id", "l_linenumber")
    lines = lines.agg(F.min("label").alias("label"), F.array(F.avg("l_quantity"), F.avg("l_tax")).alias("h"))
    along = Window.partitionBy("graph_id").orderBy("l_linenumber")
    around = lines.select(
        "graph_id",
        (F.row_number().over(along) - 1).alias("node_id"),
        "label",
        "h",
        F.lead("l_linenumber").over(along).isNull().alias("last"),
        F.lead("label", 2).over(along).alias("second"),
    )
    node = F.col("node_id")

    def bond(condition, dst, name):
        return F.when(condition, F.struct(node.alias("src"), dst.alias("dst"), F.lit(name).alias("bond")))

    bonds = F.array(
        bond(~F.col("last"), node + 1, "S"),
        bond(F.col("last") & (node >= 2), F.lit(0), "R"),
        bond(F.col("second") == F.col("label"), node + 2, "D"),
    )
    # The outer form keeps Spark from working out the bonds a second time in a filter.
    listed = around.select("graph_id", F.inline_outer(F.filter(bonds, lambda b: b.isNotNull()))).filter("src is not null")
    return around.select("graph_id", "node_id", "label", "h"), graph.mirror_edges(listed)


def round_sql(labels: str, edges: str, name: str, short: bool) -> str:
    """One relabelling round as a CTE ``name`` over (graph_id, node_id, label)."""
    text = "n.label || '(' || coalesce(l.around, '') || ')'"
    return f"""{name}_counts as materialized (
  select e.graph_id, e.src, o.label || '/' || e.bond as k, count(*) as c
  from {edges} e join {labels} o on o.graph_id = e.graph_id and o.node_id = e.dst group by 1, 2, 3),
{name}_lists as materialized (select graph_id, src, string_agg(k || '*' || c::varchar, ',' order by k) as around from {name}_counts group by 1, 2),
{name} as materialized (
  select n.graph_id, n.node_id, {f'md5({text})' if short else text} as label
  from {labels} n left join {name}_lists l on l.graph_id = n.graph_id and l.src = n.node_id)"""


def edge_round_sql(labels: str, edges: str, name: str, short: bool) -> str:
    text = "least(a.label, b.label) || '~' || greatest(a.label, b.label) || '/' || e.bond"
    return f"""{name} as materialized (
  select e.graph_id, e.src, e.dst, {f'md5({text})' if short else text} as bond
  from {edges} e join {labels} a on a.graph_id = e.graph_id and a.node_id = e.src join {labels} b on b.graph_id = e.graph_id and b.node_id = e.dst)"""


ROUND1 = f"with {GRAPHS}, {round_sql('nodes', 'edges', 'r1', False)}"
ROUND2 = f"with {GRAPHS}, {round_sql('nodes', 'edges', 'r1', True)}, {edge_round_sql('nodes', 'edges', 'e1', True)}, {round_sql('r1', 'e1', 'r2', True)}"

BFS = """adjacent as (select graph_id, src, list(dst order by dst) as near from (select distinct graph_id, src, dst from edges) group by 1, 2),
walk as (
  select graph_id, 0 as turn, [0] as seen from nodes where node_id = 0
  union all
  select w.graph_id, w.turn + 1, list_concat(w.seen, list_filter(coalesce(a.near, []::int[]), lambda x: not list_contains(w.seen, x)))
  from walk w left join adjacent a on a.graph_id = w.graph_id and a.src = w.seen[w.turn + 1] where w.turn < len(w.seen)),
walked as (
  select graph_id, unnest(seen) as node_id, generate_subscripts(seen, 1) - 1 as position from walk where turn = len(seen))"""


@query("g1_nodes", f"with {GRAPHS} select graph_id, node_id, label from nodes")
def g1_nodes(spark, folder):
    return nodes_and_edges(spark, folder)[0].drop("h")


@query("g1_edges", f"with {GRAPHS} select graph_id, src, dst, bond from edges")
def g1_edges(spark, folder):
    return nodes_and_edges(spark, folder)[1]


@query("g2_bfs_order", f"with recursive {GRAPHS}, {BFS} select graph_id, node_id, position from walked")
def g2(spark, folder):
    nodes, edges = nodes_and_edges(spark, folder)
    return graph.bfs_order(nodes, edges)


@query("g3_fragments_radius_1", f"{ROUND1} select graph_id, node_id, label from r1")
def g3(spark, folder):
    nodes, edges = nodes_and_edges(spark, folder)
    return graph.fragments(nodes, edges, 1)[1]


@query("g3_fragments_radius_2", f"{ROUND2} select graph_id, node_id, label from r2")
def g3_two(spark, folder):
    nodes, edges = nodes_and_edges(spark, folder)
    return graph.fragments(nodes, edges, 2, short=True)[2]


@query("g4_relabel_edges", f"with {GRAPHS}, {edge_round_sql('nodes', 'edges', 'e1', False)} select graph_id, src, dst, bond from e1")
def g4(spark, folder):
    return graph.relabel_edges(*nodes_and_edges(spark, folder))


FREQUENT = "vocabulary as (select label as token, row_number() over (order by n desc, label) - 1 as idx from (select label, count(*) as n from r1 group by 1 having count(*) >= 5))"


@query(
    "g5_fragment_sequence",
    f"with recursive {ROUND1.removeprefix('with ')}, {BFS}, {FREQUENT} select w.graph_id, w.position, coalesce(v.idx, -1)::int as idx from walked w join r1 using (graph_id, node_id) left join vocabulary v on v.token = r1.label",
)
def g5(spark, folder):
    nodes, edges = (stage(t, n) for t, n in zip(nodes_and_edges(spark, folder), ("nodes", "edges")))
    labels = stage(graph.fragments(nodes, edges, 1)[1], "labels")
    frequent = graph.label_statistics(labels).filter("nodes >= 5").select(F.col("label").alias("token"), (-F.col("nodes")).alias("less"))
    known = global_rank(frequent, ["less", "token"], "idx").select("token", "idx")
    return graph.fragment_sequence(nodes, edges, 1, known, labels=labels)


LABELS = "v as (select label, row_number() over (order by label) - 1 as idx from (select distinct label from nodes))"


def _label_vocabulary(nodes):
    return global_rank(nodes.select(F.col("label").alias("token")).distinct(), ["token"], "idx")


@query("g6_node_sequence", f"with {GRAPHS}, {LABELS} select graph_id, string_agg(idx::varchar, ',' order by node_id) as ids from nodes join v using (label) group by graph_id")
def g6(spark, folder):
    nodes, _ = nodes_and_edges(spark, folder)
    sequences = graph.as_arrays(graph.node_sequence(nodes, _label_vocabulary(nodes)))
    return sequences.select("graph_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query(
    "q1_shift_and_pad",
    f"with {GRAPHS}, {LABELS} select graph_id, string_agg((idx + 1)::varchar, ',' order by node_id) || repeat(',0', (9 - count(*))::int) as ids from nodes join v using (label) group by graph_id",
)
def q1(spark, folder):
    nodes, _ = nodes_and_edges(spark, folder)
    sequences = graph.as_arrays(graph.node_sequence(nodes, _label_vocabulary(nodes)))
    return sequences.select("graph_id", F.array_join(shift_and_pad("ids", 9, "graph_id").cast("array<string>"), ",").alias("ids"))


def bits_sql(n_bits: int, rounds: list[str]) -> str:
    fold = f"(('0x' || substr(md5(label), 1, 8))::bigint % {n_bits})::int"
    return "bits as (" + " union ".join(f"select graph_id, {fold} as bit from {r}" for r in rounds) + ")"


@query("g7_fingerprints", f"{ROUND1}, {bits_sql(256, ['nodes', 'r1'])} select graph_id, string_agg(bit::varchar, ',' order by bit) as bits from bits group by graph_id")
def g7(spark, folder):
    nodes, edges = nodes_and_edges(spark, folder)
    found = fingerprint.fingerprints(nodes, edges, n_bits=256, radius=1)
    return found.select("graph_id", F.array_join(F.col("bits").cast("array<string>"), ",").alias("bits"))


@query(
    "g7_fingerprints_without_bonds",
    f"with {GRAPHS}, plain as (select graph_id, src, dst, '' as bond from edges), {round_sql('nodes', 'plain', 'r1', False)}, {bits_sql(128, ['nodes', 'r1'])} select graph_id, string_agg(bit::varchar, ',' order by bit) as bits from bits group by graph_id",
)
def g7_plain(spark, folder):
    nodes, edges = nodes_and_edges(spark, folder)
    found = fingerprint.fingerprints(nodes, edges, n_bits=128, radius=1, use_bond_types=False)
    return found.select("graph_id", F.array_join(F.col("bits").cast("array<string>"), ",").alias("bits"))


@query(
    "g7_fingerprint_columns",
    f"{ROUND1}, {bits_sql(32, ['nodes', 'r1'])} select o_orderkey, "
    + ", ".join(f"coalesce(max((bit = {i})::int), 0)::int as fp{i}" for i in range(32))
    + " from orders left join bits on graph_id = o_orderkey group by o_orderkey",
)
def g7_columns(spark, folder):
    nodes, edges = nodes_and_edges(spark, folder)
    return with_fingerprints(table(spark, folder, "orders").select("o_orderkey"), "o_orderkey", nodes, edges, 32, 1)


def hashed_sql(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 15))::bigint"


def hash_rounds_sql(radius: int, name: str = "h", marks: str | None = None) -> str:
    """Rounds ``name``0 to ``name``radius of hashed labels; neighbourhoods are sums within 60 bits."""
    parts = [f"{name}0 as materialized (select graph_id, node_id, {hashed_sql('label')} as label from nodes)"]
    for r in range(1, radius + 1):
        old, bonds = f"{name}{r - 1}", "edges" if r == 1 else f"{name}e{r - 1}"
        mark = f" || coalesce((select any_value(mark) from {marks} m where m.graph_id = n.graph_id and m.node_id = n.node_id), '')" if marks and r == 1 else ""
        new = "n.label::varchar || '(' || coalesce(s.total, 0)::varchar || ')'" + mark
        ends = "least(a.label, b.label)::varchar || '~' || greatest(a.label, b.label)::varchar || '/' || e.bond"
        parts.append(
            f"""{name}s{r} as materialized (select e.graph_id, e.src, (sum({hashed_sql("o.label::varchar || '/' || e.bond")})::hugeint % 1152921504606846976)::bigint as total
  from {bonds} e join {old} o on o.graph_id = e.graph_id and o.node_id = e.dst group by 1, 2),
{name}{r} as materialized (select n.graph_id, n.node_id, {hashed_sql(new)} as label from {old} n left join {name}s{r} s on s.graph_id = n.graph_id and s.src = n.node_id),
{name}e{r} as materialized (select e.graph_id, e.src, e.dst, {hashed_sql(ends)}::varchar as bond
  from {bonds} e join {old} a on a.graph_id = e.graph_id and a.node_id = e.src join {old} b on b.graph_id = e.graph_id and b.node_id = e.dst)"""
        )
    return ", ".join(parts)


def hashed_bits_sql(n_bits: int, rounds: list[str]) -> str:
    every = " union ".join(f"select graph_id, (label % {n_bits})::int as bit from {r}" for r in rounds)
    return f"bits as ({every}) select graph_id, string_agg(bit::varchar, ',' order by bit) as bits from bits group by graph_id"


def _bits(found):
    return found.select("graph_id", F.array_join(F.col("bits").cast("array<string>"), ",").alias("bits"))


@query("g3_hashed_fragments_radius_3", f"with {GRAPHS}, {hash_rounds_sql(3)} select graph_id, node_id, label from h3")
def g3_hashed(spark, folder):
    return graph.fragment_hashes(*nodes_and_edges(spark, folder), 3)[3]


@query("g7_fingerprints_radius_2", f"with {GRAPHS}, {hash_rounds_sql(2)}, {hashed_bits_sql(2048, ['h0', 'h1', 'h2'])}")
def g7_two(spark, folder):
    return _bits(fingerprint.fingerprints(*nodes_and_edges(spark, folder), n_bits=2048, radius=2, hashed=True))


@query("g7_fingerprints_radius_3", f"with {GRAPHS}, {hash_rounds_sql(3)}, {hashed_bits_sql(2048, ['h0', 'h1', 'h2', 'h3'])}")
def g7_three(spark, folder):
    return _bits(fingerprint.fingerprints(*nodes_and_edges(spark, folder), n_bits=2048, radius=3, hashed=True))


CHIRAL = f"""{hash_rounds_sql(2)},
sides as materialized (
  select e.graph_id, e.src, e.dst, o.label from edges e join h2 o on o.graph_id = e.graph_id and o.node_id = e.dst where e.src % 3 <> 0),
centres as materialized (select graph_id, src from sides group by 1, 2 having count(*) in (3, 4) and count(distinct label) = count(*)),
turned as materialized (
  select c.graph_id, c.src, count(b.dst) as n from centres c join sides a using (graph_id, src)
  left join sides b on b.graph_id = a.graph_id and b.src = a.src and b.dst > a.dst and b.label < a.label group by 1, 2),
marks as materialized (select graph_id, src as node_id, case when (src % 3 = 1) = (n % 2 = 0) then '+' else '-' end as mark from turned)"""


@query("g7_fingerprints_with_chirality", f"with {GRAPHS}, {CHIRAL}, {hash_rounds_sql(2, 'c', 'marks')}, {hashed_bits_sql(2048, ['c0', 'c1', 'c2'])}")
def g7_chiral(spark, folder):
    """Every third node is left-handed, every third right-handed."""
    nodes, edges = nodes_and_edges(spark, folder)
    hand = F.when(F.col("node_id") % 3 == 1, 1).when(F.col("node_id") % 3 == 2, -1).otherwise(0)
    return _bits(fingerprint.fingerprints(nodes.withColumn("chirality", hand), edges, n_bits=2048, radius=2, use_chirality=True))


# Graphs of the molecule strings: the tokens of all strings are walked together, a token a turn.
SMILES_WALK = (
    VALID
    + f""", texts as materialized (select id, regexp_extract_all(smiles, {ATOMS_SQL} || '|[-=#$:/\\\\.~()]|%[0-9]{{2}}|[0-9]') as t, regexp_extract_all(smiles, {ATOMS_SQL}) as a from checked where valid),
turns as (
  select id, 0 as i, -1 as last, 0 as next, '' as bond, []::int[] as stack, []::struct(r int, a int, b varchar)[] as rings, null::int as src, null::int as dst, null::varchar as made from texts
  union all
  select id, i + 1, case when atom then next when tok = ')' then stack[-1] when tok = '.' then -1 else last end, next + atom::int,
         case when atom or num is not null or tok in ('(', ')', '.') then '' else tok end,
         case when tok = '(' then list_append(stack, last) when tok = ')' then stack[:-2] else stack end,
         case when num is null then rings when met is not null then list_filter(rings, lambda x: x.r <> num) else list_append(rings, {{'r': num, 'a': last, 'b': bond}}) end,
         case when atom and last >= 0 then last when met is not null then met.a end, case when atom and last >= 0 then next when met is not null then last end,
         case when atom and last >= 0 then bond when met is not null then coalesce(nullif(met.b, ''), bond) end
  from (select *, (list_filter(rings, lambda x: x.r = num))[1] as met from (
    select u.*, x.t[i + 1] as tok, regexp_full_match(x.t[i + 1], {ATOMS_SQL}) as atom,
           case when regexp_full_match(x.t[i + 1], '%[0-9]{{2}}|[0-9]') then replace(x.t[i + 1], '%', '')::int end as num
    from turns u join texts x using (id) where i < len(x.t)))),
atoms as materialized (
  select id as graph_id, node_id, upper(substr(s, 1, 1)) || substr(s, 2) || case when regexp_matches(s, '^[a-z]') then '|aromatic' else '' end as label
  from (select id, (nth - 1)::int as node_id, regexp_extract(token, '^\\[?[0-9]*([A-Z][a-z]?|[a-z][a-z]?)', 1) as s from (select id, unnest(a) as token, generate_subscripts(a, 1) as nth from texts))),
plain as (
  select t.id as graph_id, src, dst, case when made = '' then case when p.label like '%|aromatic' and q.label like '%|aromatic' then ':' else '-' end when made in ('/', '\\') then '-' else made end as bond
  from turns t join atoms p on p.graph_id = t.id and p.node_id = src join atoms q on q.graph_id = t.id and q.node_id = dst)"""
)


@query("g1_nodes_from_smiles", f"with recursive {SMILES_WALK} select graph_id, node_id, label from atoms")
def g1_nodes_from_smiles(spark, folder):
    return graph.graphs_from_smiles(molecules(spark, folder), "id", "smiles")[0]


@query("g1_edges_from_smiles", f"with recursive {SMILES_WALK} select graph_id, src, dst, bond from plain union all select graph_id, dst, src, bond from plain")
def g1_edges_from_smiles(spark, folder):
    return graph.graphs_from_smiles(molecules(spark, folder), "id", "smiles")[1]


def _spread(features):
    return rounded(features.select(*[c for c in features.columns if c != "h"], F.col("h")[0].alias("h0"), F.col("h")[1].alias("h1")))


@query(
    "g8_mean_of_neighbours",
    f"""with {GRAPHS}, m as (
      select e.graph_id, e.dst as node_id, avg(n.h0) as h0, avg(n.h1) as h1 from edges e join nodes n on n.graph_id = e.graph_id and n.node_id = e.src group by 1, 2)
    select n.graph_id, n.node_id, round(coalesce(m.h0, 0.0), 6) as h0, round(coalesce(m.h1, 0.0), 6) as h1 from nodes n left join m on m.graph_id = n.graph_id and m.node_id = n.node_id""",
)
def g8(spark, folder):
    nodes, edges = nodes_and_edges(spark, folder)
    return _spread(graph.mean_of_neighbours(nodes, edges, 2))


@query("g9_mean_of_nodes", f"with {GRAPHS} select graph_id, round(avg(h0), 6) as h0, round(avg(h1), 6) as h1, count(*) as nodes from nodes group by graph_id")
def g9(spark, folder):
    return _spread(graph.mean_of_nodes(nodes_and_edges(spark, folder)[0], 2))


@query(
    "g10_batch_graphs",
    f"""with {GRAPHS}, i as (select graph_id, node_id, row_number() over (order by graph_id, node_id) - 1 as global_id from nodes)
    select a.global_id as global_src, b.global_id as global_dst, e.bond from edges e
    join i a on a.graph_id = e.graph_id and a.node_id = e.src join i b on b.graph_id = e.graph_id and b.node_id = e.dst""",
)
def g10(spark, folder):
    return graph.batch_graphs(*nodes_and_edges(spark, folder))[1].select("global_src", "global_dst", "bond")


@query("g11_self_loops", f"with {GRAPHS} select graph_id, src, dst, bond from edges union all select graph_id, node_id, node_id, 'self' from nodes")
def g11(spark, folder):
    return graph.add_self_loops(*nodes_and_edges(spark, folder))


@query("g12_label_statistics", f"{ROUND1} select label, count(*) as nodes, count(distinct graph_id) as graphs from r1 group by label")
def g12(spark, folder):
    nodes, edges = nodes_and_edges(spark, folder)
    return graph.label_statistics(graph.fragments(nodes, edges, 1)[1])
