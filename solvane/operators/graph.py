"""Molecular graphs as tables.

``nodes(graph_id, node_id, label)`` and ``edges(graph_id, src, dst, bond)``,
edges stored in both directions.  All graphs advance together: a round is a join
and an aggregation keyed by (graph, node), never one task per graph.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from solvane.functions import rounds, smiles
from solvane.operators.ranking import global_rank
from solvane.operators.vocab import encode_rows
from solvane.storage import TASK_ROWS, cut, deal, stage

GRAPH = "graph_id"
# Graphs with up to this many edge rows are walked within one row; larger ones level by level.
ROW_EDGES = 512
# Graphs of up to this many nodes and edges together are relabelled by hashes where they lie; larger ones take part in joins.
GRAPH_ROWS = 65_536
# Bits of a hashed label; sums of them are taken within this many bits.
HASH_BITS = 60
BOND_COLUMNS = (("src", IntegerType()), ("dst", IntegerType()), ("bond", StringType()))


def node_label(symbol: Column, aromatic: Column) -> Column:
    """Symbol, marked if aromatic."""
    return F.when(aromatic, F.concat(symbol, F.lit("|aromatic"))).otherwise(symbol)


def mirror_edges(bonds: DataFrame) -> DataFrame:
    """Both directions of each bond ``(graph_id, src, dst, bond)``, written in one pass."""
    there = F.struct("src", "dst", "bond")
    back = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "bond")
    return bonds.select(GRAPH, F.inline(F.array(there, back)))


def add_self_loops(nodes: DataFrame, edges: DataFrame, bond: str = "self") -> DataFrame:
    loops = nodes.select(GRAPH, F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.lit(bond).alias("bond"))
    return edges.select(GRAPH, "src", "dst", "bond").unionByName(loops)


def batch_graphs(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One disjoint graph: dense node numbers over all graphs in (graph, node) order."""
    numbered = global_rank(nodes, [GRAPH, "node_id"], "global_id")
    source = numbered.select(GRAPH, F.col("node_id").alias("src"), F.col("global_id").alias("global_src"))
    target = numbered.select(GRAPH, F.col("node_id").alias("dst"), F.col("global_id").alias("global_dst"))
    return numbered, edges.join(source, [GRAPH, "src"]).join(target, [GRAPH, "dst"])


def graphs_from_smiles(df: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the atoms that SMILES strings write down, ``graph_id`` being the id.

    Strings that are not lexically valid have no graph, and neither have null
    ones.  Hydrogens are nodes where they are written as atoms of their own.
    """
    valid = df.filter(smiles.looks_valid(text)).select(F.col(id_col).alias(GRAPH), F.col(text).alias("_text"))
    listed = valid.select(GRAPH, F.posexplode(smiles.atom_tokens("_text")).alias("node_id", "_token"))
    nodes = listed.select(GRAPH, "node_id", node_label(smiles.atom_symbol(F.col("_token")), smiles.is_aromatic(F.col("_token"))).alias("label"))
    bonds = valid.mapInArrow(_bonds, StructType([valid.schema[GRAPH], *(StructField(n, k) for n, k in BOND_COLUMNS)]))
    return nodes, mirror_edges(bonds)


def _bonds(batches):
    for batch in batches:
        found = [(row, *bond) for row, text in enumerate(batch.column("_text").to_pylist()) for bond in smiles.bonds(text)]
        rows, src, dst, bond = zip(*found) if found else ((), (), (), ())
        ids = batch.column(GRAPH).take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, pa.array(src, pa.int32()), pa.array(dst, pa.int32()), pa.array(bond, pa.string())], [GRAPH, "src", "dst", "bond"])


# Values of nodes brought to edges and back -----------------------------------
#
# Both are laid under each other and met in windows keyed by (graph, node). Tables that are dealt by graph, as
# counted rows are, meet where they lie, in as many tasks as they come in; a join would deal them anew each time.


def with_node(nodes: DataFrame, edges: DataFrame, end: str, column: str, name: str) -> DataFrame:
    """``edges`` with ``column`` of the node at ``end`` as ``name``, in the rows that an inner join gives."""
    held = nodes.select(GRAPH, F.col("node_id").alias("_at"), F.struct(F.col(column).alias("v")).alias("_node")).filter("_at is not null")
    asked = edges.withColumn("_at", F.col(end)).filter("_at is not null")
    both = held.unionByName(asked, allowMissingColumns=True).filter(F.col(GRAPH).isNotNull())
    met = both.withColumn("_nodes", F.collect_list("_node").over(Window.partitionBy(GRAPH, "_at"))).filter("_node is null")
    return met.select(*edges.columns, F.explode("_nodes").alias("_v")).select(*edges.columns, F.col("_v.v").alias(name))


def beside(nodes: DataFrame, found: DataFrame, column: str) -> DataFrame:
    """``nodes`` with ``column`` of ``found``, which has a row for a (graph, node) at most, or null: the rows of a left join."""
    kept = nodes.withColumn("_own", F.lit(True))
    known = found.select(GRAPH, "node_id", column).filter(F.col(GRAPH).isNotNull() & F.col("node_id").isNotNull())
    own = Window.partitionBy(GRAPH, "node_id")
    met = kept.unionByName(known, allowMissingColumns=True).withColumn(column, F.first(column, ignorenulls=True).over(own))
    kinds = {f.name: f.dataType for f in nodes.schema}
    return met.filter("_own").select(*(F.col(c).cast(kinds[c]).alias(c) for c in nodes.columns), column)


def dealt(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written tables, dealt by graph to tasks by their counted rows, unless a graph is too large for a task."""
    largest = edges.groupBy(GRAPH).count().agg(F.max("count")).first()[0] or 0
    if largest > TASK_ROWS:
        return nodes, edges
    rows = max(nodes.count(), edges.count())
    return deal(nodes, rows, GRAPH), deal(edges, rows, GRAPH)


# Weisfeiler-Lehman labels ----------------------------------------------------


def _neighbourhoods(nodes: DataFrame, edges: DataFrame, bond: str = "bond") -> DataFrame:
    """(graph, node, around): the sorted neighbour labels with bonds, equal ones counted.

    Equal neighbours are counted before they are listed, so a node with very
    many neighbours is reduced on the map side.
    """
    around = with_node(nodes, edges.select(GRAPH, "src", "dst", bond), "dst", "label", "_other")
    counted = around.groupBy(GRAPH, "src", "_other", bond).agg(F.count("*").alias("_n"))
    entry = F.struct(F.concat_ws("/", "_other", F.col(bond).cast("string")).alias("k"), "_n")
    listed = counted.groupBy(GRAPH, F.col("src").alias("node_id")).agg(F.sort_array(F.collect_list(entry)).alias("_list"))
    return listed.withColumn("around", F.array_join(F.transform("_list", lambda e: F.concat(e["k"], F.lit("*"), e["_n"].cast("string"))), ",")).drop("_list")


def relabel(nodes: DataFrame, edges: DataFrame, bond: str = "bond") -> DataFrame:
    """One round: each label becomes the label with its neighbourhood, as text."""
    around = _neighbourhoods(nodes, edges, bond)
    text = F.concat(F.col("label"), F.lit("("), F.coalesce("around", F.lit("")), F.lit(")"))
    return beside(nodes.select(GRAPH, "node_id", "label"), around, "around").select(GRAPH, "node_id", text.alias("label"))


def relabel_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose bond is the sorted pair of end labels with the old bond."""
    joined = with_node(nodes, with_node(nodes, edges, "src", "label", "_a"), "dst", "label", "_b")
    text = F.concat(F.least("_a", "_b"), F.lit("~"), F.greatest("_a", "_b"), F.lit("/"), F.col("bond").cast("string"))
    return joined.select(GRAPH, "src", "dst", text.alias("bond"))


def fragments(nodes: DataFrame, edges: DataFrame, radius: int, short: bool = False) -> list[DataFrame]:
    """Node labels after rounds 0..radius, each as (graph_id, node_id, label).

    A label spells the neighbourhood; with ``short`` it is replaced by its md5
    after each round, which keeps later rounds narrow.  Edges are relabelled
    between rounds.  A node without edges keeps an empty neighbourhood.  What a
    round hands to the next one is written, so that its plan does not grow.
    """
    rounds = [nodes.select(GRAPH, "node_id", F.col("label").cast("string").alias("label"))]
    written = rounds[0], edges
    for step in range(radius):
        current = rounds[-1]
        labelled = relabel(current, edges)
        if short:
            labelled = labelled.withColumn("label", F.md5("label"))
        if step + 1 < radius:
            # Not from the dealt tables: Spark 4.1 loses rows where a dealt table is met twice in unions and its exchange is reused.
            edges = relabel_edges(*written)
            if short:
                edges = edges.withColumn("bond", F.md5("bond"))
            written = stage(labelled, "labels"), stage(edges, "bonds")
            labelled, edges = dealt(*written)
        rounds.append(labelled)
    if radius > 1:
        # Nor may a caller's join reuse the exchanges of the last round, for the same reason.
        rounds[-1] = stage(rounds[-1], "labels")
    return rounds


def hashed_label(text: Column) -> Column:
    """60 bits of the text's md5 as a number."""
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def _joined(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def fragment_hashes(nodes: DataFrame, edges: DataFrame, radius: int, marks: DataFrame | None = None, chiral: bool = False) -> list[DataFrame]:
    """Hashed node labels after rounds 0..radius, each as (graph_id, node_id, label).

    A neighbourhood is the sum of its members' hashes, so that no neighbour list
    is ever made.  Edges are relabelled between rounds.  ``marks`` (graph_id,
    node_id, mark) go into the labels of round 1; with ``chiral`` they are those of
    :func:`chiral_marks` by the labels of the last round without them.

    The rounds of a graph of up to GRAPH_ROWS rows are worked out where it lies, in one pass; larger graphs, and those in
    which a node comes twice, take part in joins, a node with any number of neighbours being pre-aggregated.
    """
    if marks is not None:
        return _hashed_by_joins(nodes, edges, radius, marks)
    rows, others = hashed_rows(nodes, edges, radius, chiral)
    kind = nodes.schema["node_id"].dataType
    found = [
        rows.select(GRAPH, F.inline(F.arrays_zip("_nodes", f"_l{i}"))).select(GRAPH, F.col("_nodes").cast(kind).alias("node_id"), F.col(f"_l{i}").alias("label"))
        for i in range(radius + 1)
    ]
    return found if others is None else [a.unionByName(b) for a, b in zip(found, others, strict=True)]


def hashed_rows(nodes: DataFrame, edges: DataFrame, radius: int, chiral: bool = False) -> tuple[DataFrame, list[DataFrame] | None]:
    """(a row per graph with the lists ``_nodes`` and, after round i, ``_li``, all rounds of the other graphs or None).

    Nodes and edges are laid under each other and meet in a window by graph, which tables dealt by graph pass
    where they lie; the result is written.
    """
    hand = F.when(F.col("chirality") > 0, 1).when(F.col("chirality") < 0, -1).otherwise(0) if chiral else F.lit(0)
    held = nodes.select(GRAPH, F.col("node_id").alias("src"), F.col("label").cast("string").alias("text"), F.lit(True).alias("_own"), hand.alias("_hand"))
    bonds = edges.select(GRAPH, "src", "dst", F.col("bond").cast("string").alias("text"), F.lit(False).alias("_own"), F.lit(0).alias("_hand"))
    bonds = bonds.filter(F.col(GRAPH).isNotNull() & F.col("src").isNotNull())
    own = Window.partitionBy(GRAPH).orderBy(GRAPH)
    # All rows of a graph are equal in this order, so that each gets their whole number.
    flat = held.unionByName(bonds, allowMissingColumns=True).withColumns({"_k": F.row_number().over(own), "_n": F.count("*").over(own)})
    flat = flat.withColumn("dst", F.col("dst").cast(flat.schema["src"].dataType))
    lists = [("_nodes", ArrayType(flat.schema["src"].dataType)), *((f"_l{i}", ArrayType(LongType())) for i in range(radius + 1))]
    plain = [StructField(n, flat.schema[n].dataType) for n in (GRAPH, "src", "dst", "text", "_own", "_hand")]
    schema = StructType([*plain, *(StructField(n, k) for n, k in lists), StructField("_whole", BooleanType())])
    arrow, limit = to_arrow_schema(schema), GRAPH_ROWS
    done = stage(flat.mapInArrow(lambda batches: rounds.walked(batches, limit, radius, chiral, arrow), schema), "rounds")
    rest = done.filter("_whole is null")
    rows = done.filter("_whole").select(GRAPH, *(n for n, _ in lists))
    if rest.isEmpty():
        return rows, None
    kind = nodes.schema["node_id"].dataType
    nodes = rest.filter("_own").select(GRAPH, F.col("src").cast(kind).alias("node_id"), F.col("text").alias("label"), F.col("_hand").alias("chirality"))
    edges = rest.filter("not _own").select(GRAPH, "src", "dst", F.col("text").alias("bond"))
    found = _hashed_by_joins(nodes, edges, radius)
    return rows, _hashed_by_joins(nodes, edges, radius, chiral_marks(nodes, edges, found[-1])) if chiral and radius else found


def _hashed_by_joins(nodes: DataFrame, edges: DataFrame, radius: int, marks: DataFrame | None = None) -> list[DataFrame]:
    current = nodes.select(GRAPH, "node_id", hashed_label(F.col("label").cast("string")).alias("label"))
    edges = edges.select(GRAPH, "src", "dst", F.col("bond").cast("string").alias("bond"))
    found, half = [current], F.lit(1 << HASH_BITS // 2).cast("bigint")
    for step in range(radius):
        other = current.select(GRAPH, F.col("node_id").alias("dst"), F.col("label").alias("_b"))
        around = edges.join(other, [GRAPH, "dst"])
        met = around.select(GRAPH, F.col("src").alias("node_id"), hashed_label(_joined(F.col("_b"), "/", F.col("bond"))).alias("_h"))
        sums = met.groupBy(GRAPH, "node_id").agg(F.sum(F.shiftright("_h", HASH_BITS // 2)).alias("_high"), F.sum(F.col("_h") % half).alias("_low"))
        total = ((F.col("_high") % half) * half + F.col("_low") % (half * half)) % (half * half)
        labelled = current.join(sums.select(GRAPH, "node_id", total.alias("_s")), [GRAPH, "node_id"], "left")
        text = _joined(F.col("label"), "(", F.coalesce("_s", F.lit(0)), ")")
        if step == 0 and marks is not None:
            labelled = labelled.join(marks, [GRAPH, "node_id"], "left")
            text = F.concat(text, F.coalesce("mark", F.lit("")))
        labelled = labelled.select(GRAPH, "node_id", hashed_label(text).alias("label"))
        if step + 1 < radius:
            own = current.select(GRAPH, F.col("node_id").alias("src"), F.col("label").alias("_a"))
            ends = _joined(F.least("_a", "_b"), "~", F.greatest("_a", "_b"), "/", F.col("bond"))
            edges = stage(around.join(own, [GRAPH, "src"]).select(GRAPH, "src", "dst", hashed_label(ends).cast("string").alias("bond")), "bonds")
            labelled = stage(labelled, "labels")
        found.append(labelled)
        current = labelled
    return found


def chiral_marks(nodes: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(graph_id, node_id, mark): the handedness of nodes with ``chirality`` 1 or -1, whatever the order of their neighbours.

    ``chirality`` counts by the neighbours in the order of ``dst``.  Turned into
    the order of the neighbours' ``labels`` its sign changes with each
    exchange.  Nodes without three or four neighbours of different labels have
    no mark.
    """
    centres = nodes.filter("chirality <> 0").select(GRAPH, F.col("node_id").alias("src"), "chirality")
    others = labels.select(GRAPH, F.col("node_id").alias("dst"), F.col("label").alias("_other"))
    around = edges.select(GRAPH, "src", "dst").join(centres, [GRAPH, "src"])
    degrees = around.groupBy(GRAPH, "src").agg(F.count("*").alias("_n")).filter("_n between 3 and 4")
    around = around.join(degrees.select(GRAPH, "src"), [GRAPH, "src"], "left_semi").join(others, [GRAPH, "dst"])
    listed = around.groupBy(GRAPH, "src", "chirality").agg(F.sort_array(F.collect_list(F.struct("dst", "_other"))).alias("_e"))  # four at most
    listed = listed.withColumn("_l", F.transform("_e", lambda e: e["_other"])).filter(F.size(F.array_distinct("_l")) == F.size("_l"))
    exchanges = sum((F.coalesce(F.get("_l", i) > F.get("_l", j), F.lit(False)).cast("int") for i in range(4) for j in range(i + 1, 4)), F.lit(0))
    left = (F.col("chirality") > 0) == (exchanges % 2 == 0)
    return listed.select(GRAPH, F.col("src").alias("node_id"), F.when(left, "+").otherwise("-").alias("mark"))


def label_statistics(labels: DataFrame) -> DataFrame:
    """Nodes and graphs per label."""
    per_graph = labels.groupBy("label", GRAPH).agg(F.count("*").alias("n"))
    return per_graph.groupBy("label").agg(F.sum("n").alias("nodes"), F.count("*").alias("graphs"))


# Breadth-first order ---------------------------------------------------------


def bfs_order(nodes: DataFrame, edges: DataFrame, start: int = 0, order: str = "dst", row_edges: int = ROW_EDGES) -> DataFrame:
    """(graph_id, node_id, position): breadth-first from node ``start``, neighbours in ``order``.

    Only nodes that the start node reaches are visited; edges are followed from src to dst.  A graph small enough to
    be one row is walked by a fold over its neighbour lists; the others are
    walked by a loop over levels in which all graphs take part.
    """
    sizes = edges.groupBy(GRAPH).agg(F.count("*").alias("_n"))
    large = sizes.filter(F.col("_n") > row_edges).select(GRAPH)
    if large.isEmpty():
        return _bfs_within_row(nodes, edges, start, order)
    large = cut(large)
    small = _bfs_within_row(nodes.join(large, GRAPH, "left_anti"), edges.join(large, GRAPH, "left_anti"), start, order)
    walked = _bfs_by_level(nodes.join(large, GRAPH, "left_semi"), edges.join(large, GRAPH, "left_semi"), start, order)
    return small.unionByName(walked)


def _bfs_within_row(nodes: DataFrame, edges: DataFrame, start: int, order: str) -> DataFrame:
    kind = nodes.schema["node_id"].dataType.simpleString()
    first = F.lit(start).cast(kind)
    entry = F.struct("src", F.col(order).alias("_o"), "dst")
    listed = edges.select(GRAPH, entry.alias("_e")).groupBy(GRAPH).agg(F.sort_array(F.collect_list("_e")).alias("_edges"))
    # Graphs without any edge still have their start node.
    starts = nodes.filter(F.col("node_id") == first).select(GRAPH)
    rows = starts.join(listed, GRAPH, "left").withColumn("_edges", F.coalesce("_edges", F.array()))
    sources = F.array_distinct(F.transform("_edges", lambda e: e["src"]))
    lists = F.transform(sources, lambda s: F.transform(F.filter("_edges", lambda e: e["src"] == s), lambda e: e["dst"]))
    met = F.size(F.array_distinct(F.transform("_edges", lambda e: e["dst"])))  # nodes that edges of either direction can reach
    rows = rows.select(GRAPH, F.map_from_arrays(sources, lists).alias("_lists"), met.alias("_met"))

    def visit(seen: Column, turn: Column) -> Column:
        met = F.coalesce(F.try_element_at(F.col("_lists"), F.get(seen, turn)), F.array().cast(f"array<{kind}>"))
        return F.when(turn < F.size(seen), F.concat(seen, F.array_except(met, seen))).otherwise(seen)

    turns = F.sequence(F.lit(0), F.col("_met"))
    seen = F.aggregate(turns, F.array(first), visit)
    return rows.select(GRAPH, F.posexplode(seen).alias("position", "node_id")).select(GRAPH, "node_id", F.col("position").cast("bigint").alias("position"))


def _bfs_by_level(nodes: DataFrame, edges: DataFrame, start: int, order: str) -> DataFrame:
    """Each level ranks its new nodes by (rank of the first parent, neighbour order) over all graphs."""
    kind = nodes.schema["node_id"].dataType.simpleString()
    moves = cut(edges.select(GRAPH, "src", "dst", F.col(order).alias("_o")))
    frontier = nodes.filter(F.col("node_id") == F.lit(start).cast(kind)).select(GRAPH, "node_id").withColumn("_rank", F.lit(0).cast("bigint"))
    frontier = cut(frontier.withColumn("_level", F.lit(0)))
    levels, seen, level = [frontier], frontier.select(GRAPH, "node_id"), 0
    while not levels[-1].isEmpty():
        level += 1
        step = moves.join(levels[-1].withColumnRenamed("node_id", "src"), [GRAPH, "src"])
        met = step.groupBy(GRAPH, F.col("dst").alias("node_id")).agg(F.min(F.struct("_rank", "_o")).alias("_by"))
        new = met.join(seen, [GRAPH, "node_id"], "left_anti")
        new = new.select(GRAPH, "node_id", F.col("_by._rank").alias("_parent"), F.col("_by._o").alias("_o"))
        ranked = global_rank(new, [GRAPH, "_parent", "_o", "node_id"], "_rank").select(GRAPH, "node_id", "_rank")
        levels.append(cut(ranked.withColumn("_level", F.lit(level))))
        seen = seen.unionByName(levels[-1].select(GRAPH, "node_id"))
    visited = levels[0]
    for later in levels[1:]:
        visited = visited.unionByName(later)
    ranked = global_rank(visited, [GRAPH, "_level", "_rank"], "_at")
    starts = ranked.groupBy(GRAPH).agg(F.min("_at").alias("_from"))
    return ranked.join(starts, GRAPH).select(GRAPH, "node_id", (F.col("_at") - F.col("_from")).alias("position"))


def fragment_sequence(nodes: DataFrame, edges: DataFrame, radius: int, vocabulary: DataFrame, start: int = 0, labels: DataFrame | None = None) -> DataFrame:
    """(graph_id, position, idx): fragment ids in breadth-first order, -1 for unknown fragments.

    ``labels`` saves the relabelling where its result is already at hand.
    """
    if labels is None:
        labels = fragments(nodes, edges, radius)[radius]
    placed = bfs_order(nodes, edges, start).join(labels, [GRAPH, "node_id"])
    return encode_rows(placed, "label", vocabulary).select(GRAPH, "position", "idx")


def node_sequence(nodes: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(graph_id, position, idx): node labels in node order."""
    return encode_rows(nodes, "label", vocabulary).select(GRAPH, F.col("node_id").alias("position"), "idx")


def as_arrays(sequence: DataFrame) -> DataFrame:
    """(graph_id, ids): one array per graph, for graphs that fit into a row."""
    listed = sequence.groupBy(GRAPH).agg(F.sort_array(F.collect_list(F.struct("position", "idx"))).alias("_s"))
    return listed.select(GRAPH, F.transform("_s", lambda e: e["idx"]).alias("ids"))


# Message passing without weights ---------------------------------------------


def _mean_vector(vector: str, width: int) -> Column:
    return F.array(*[F.avg(F.col(vector)[i]) for i in range(width)])


def mean_of_neighbours(features: DataFrame, edges: DataFrame, width: int, vector: str = "h") -> DataFrame:
    """New vector of each node: the mean over its in-neighbours, zeros if there are none."""
    sent = with_node(features, edges.select(GRAPH, "src", "dst"), "src", vector, vector)
    received = sent.groupBy(GRAPH, F.col("dst").alias("node_id")).agg(_mean_vector(vector, width).alias("_new"))
    zeros = F.array(*[F.lit(0.0)] * width)
    joined = beside(features.select(GRAPH, "node_id"), received, "_new")
    return joined.select(GRAPH, "node_id", F.coalesce("_new", zeros).alias(vector))


def mean_of_nodes(features: DataFrame, width: int, vector: str = "h") -> DataFrame:
    """Read-out: the mean node vector of each graph."""
    return features.groupBy(GRAPH).agg(_mean_vector(vector, width).alias(vector), F.count("*").alias("nodes"))
