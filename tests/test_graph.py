import random
import re
import time

import pytest
from pyspark.sql import functions as F

from bindings.graphs import nodes_and_edges
from solvane.operators import fingerprint, graph, vocab
from solvane.sources import vocabularies


def random_graphs(spark, seed=4):
    """Several graphs with loops and loose parts, and one star whose centre holds a third of all edges."""
    draw = random.Random(seed)
    nodes, bonds = [], []
    for g in range(12):
        n = draw.randrange(1, 14)
        nodes += [(g, i, draw.choice("CNO")) for i in range(n)]
        pairs = {(draw.randrange(n), draw.randrange(n)) for _ in range(n)}
        bonds += [(g, a, b, draw.choice("12")) for a, b in pairs if a < b]
    nodes += [(99, i, "C") for i in range(60)]
    bonds += [(99, 0, i, "1") for i in range(1, 60)]
    node_table = spark.createDataFrame(nodes, "graph_id bigint, node_id int, label string").repartition(3)
    bond_table = spark.createDataFrame(bonds, "graph_id bigint, src int, dst int, bond string").repartition(3)
    return nodes, bonds, node_table, graph.mirror_edges(bond_table)


def neighbours(bonds):
    around = {}
    for g, a, b, bond in bonds:
        around.setdefault((g, a), []).append((b, bond))
        around.setdefault((g, b), []).append((a, bond))
    return around


def queue_bfs(nodes, bonds):
    around, order = neighbours(bonds), {}
    for g in {n[0] for n in nodes}:
        seen = [0]
        for node in seen:
            seen += [b for b in sorted({b for b, _ in around.get((g, node), [])}) if b not in seen]
        order.update({(g, node): i for i, node in enumerate(seen)})
    return order


@pytest.mark.parametrize("row_edges", [graph.ROW_EDGES, 30, 0])
def test_bfs_matches_a_queue(spark, row_edges):
    nodes, bonds, node_table, edges = random_graphs(spark)
    found = graph.bfs_order(node_table, edges, row_edges=row_edges).collect()
    expected = queue_bfs(nodes, bonds)
    if row_edges == 0:
        # Without any edge a graph is always small enough.
        assert len(found) == len(expected)
    assert {(r["graph_id"], r["node_id"]): r["position"] for r in found} == expected


@pytest.mark.parametrize("row_edges", [graph.ROW_EDGES, 0])
def test_bfs_follows_directed_edges(spark, row_edges):
    nodes = spark.createDataFrame([(1, i) for i in range(7)], "graph_id bigint, node_id int")
    edges = spark.createDataFrame([(1, 0, 1), (1, 0, 2), (1, 0, 3), (1, 3, 4), (1, 4, 5)], "graph_id bigint, src int, dst int")
    found = graph.bfs_order(nodes, edges, row_edges=row_edges).collect()
    assert sorted((r.position, r.node_id) for r in found) == [(i, i) for i in range(6)]


def test_orders_may_have_any_line_number(spark, tmp_path):
    rows = [(1, 1, "A", "F"), (1, 5, "N", "O"), (1, 12, "A", "F"), (1, 12, "R", "F"), (2, 40, "AB", "CD")]
    lines = spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_returnflag string, l_linestatus string")
    lines.withColumn("l_quantity", F.lit(2.0)).withColumn("l_tax", F.lit(0.5)).write.parquet(str(tmp_path / "lineitem.parquet"))
    nodes, edges = nodes_and_edges(spark, str(tmp_path))
    assert sorted((r.graph_id, r.node_id, r.label) for r in nodes.collect()) == [(1, 0, "AF"), (1, 1, "NO"), (1, 2, "AF"), (2, 0, "ABCD")]
    bonds = [(0, 1, "S"), (1, 2, "S"), (2, 0, "R"), (0, 2, "D")]
    assert sorted((r.src, r.dst, r.bond) for r in edges.collect()) == sorted(bonds + [(b, a, name) for a, b, name in bonds])


def test_relabelling_matches_nested_tuples(spark):
    nodes, bonds, node_table, edges = random_graphs(spark)
    around = neighbours(bonds)
    labels = {(g, i): s for g, i, s in nodes}
    bond_of = {}
    for g, a, b, bond in bonds:
        bond_of[(g, a, b)] = bond_of[(g, b, a)] = bond
    expected = labels
    for step in range(2):
        new = {key: (expected[key], tuple(sorted((expected[(key[0], j)], bond_of[(*key, j)]) for j, _ in around.get(key, [])))) for key in expected}
        bond_of = {(g, a, b): (tuple(sorted((expected[(g, a)], expected[(g, b)]))), bond) for (g, a, b), bond in bond_of.items()}
        expected = new
    for short in (False, True):
        found = {(r["graph_id"], r["node_id"]): r["label"] for r in graph.fragments(node_table, edges, 2, short)[2].collect()}
        # The spelling differs, but the same nodes must share a label.
        pairs = {(expected[key], found[key]) for key in expected}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def benzene(spark):
    """Six aromatic carbons with one hydrogen each, labelled by node type and bond ids."""
    nodes = [(1, i, "C|aromatic") for i in range(6)] + [(1, 6 + i, "H") for i in range(6)]
    bonds = [(1, i, (i + 1) % 6, "AROMATIC") for i in range(6)] + [(1, i, 6 + i, "SINGLE") for i in range(6)]
    node_table = vocab.encode_rows(spark.createDataFrame(nodes, "graph_id bigint, node_id int, label string"), "label", vocabularies.vocabulary(spark, "CEP25000", "node"))
    bond_table = vocab.encode_rows(spark.createDataFrame(bonds, "graph_id bigint, src int, dst int, bond string"), "bond", vocabularies.vocabulary(spark, "CEP25000", "bond"))
    nodes = node_table.select("graph_id", "node_id", F.col("idx").cast("string").alias("label"))
    return nodes, graph.mirror_edges(bond_table.select("graph_id", "src", "dst", F.col("idx").alias("bond")))


def test_known_fragments_of_a_molecule(spark):
    nodes, edges = benzene(spark)
    known = vocabularies.vocabulary(spark, "CEP25000", "fragment")
    sequence = graph.as_arrays(graph.fragment_sequence(nodes, edges, 1, known)).first()["ids"]
    # An aromatic CH is fragment 4, its hydrogen fragment 17. Breadth-first from atom 0.
    assert sequence == [4, 4, 4, 17, 4, 17, 4, 17, 4, 17, 17, 17]
    bonds = vocab.encode_rows(graph.relabel_edges(nodes, edges), "bond", vocabularies.vocabulary(spark, "CEP25000", "edge"))
    assert {r["idx"]: r["count"] for r in bonds.groupBy("idx").count().collect()} == {4: 12, 6: 12}


def test_unknown_fragments_are_minus_one(spark):
    _, _, nodes, edges = random_graphs(spark)
    labels = graph.fragments(nodes, edges, 1)[1].select(F.col("node_id").alias("pos"), F.col("label").alias("token"), "graph_id")
    known = vocab.numbered(vocab.first_seen_rows(labels.filter("graph_id < 6"), "graph_id", "pos", "token"))
    sequence = graph.fragment_sequence(nodes, edges, 1, known)
    seen = {r["token"] for r in known.collect()}
    wanted = {(r["graph_id"], r["pos"]): r["token"] in seen for r in labels.collect()}
    placed = graph.bfs_order(nodes, edges).join(sequence, ["graph_id", "position"]).collect()
    assert all((r["idx"] >= 0) == wanted[(r["graph_id"], r["node_id"])] for r in placed)


def test_fixed_vocabularies(spark):
    sizes = lambda d: {r["name"]: r["count"] for r in vocabularies.vocabulary(spark, d).groupBy("name").count().collect()}
    assert sizes("CEP25000") == {"node": 8, "bond": 3, "fragment": 56, "edge": 18}
    assert sizes("HOPV15") == {"node": 12, "bond": 4, "fragment": 150, "edge": 40}
    assert sizes("OSAKA") == {"node": 17}
    for data in ("CEP25000", "HOPV15", "OSAKA"):
        rows = vocabularies.vocabulary_rows(data)
        assert len({(n, t) for n, t, _ in rows}) == len(rows)
    with pytest.raises(ValueError):
        vocabularies.vocabulary(spark, "other")


def test_message_passing(spark):
    nodes = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [3.0, 2.0]), (1, 2, [5.0, 4.0]), (2, 0, [7.0, 7.0])], "graph_id bigint, node_id int, h array<double>")
    edges = spark.createDataFrame([(1, 0, 1, "s"), (1, 2, 1, "s"), (1, 1, 0, "s")], "graph_id bigint, src int, dst int, bond string")
    new = {(r["graph_id"], r["node_id"]): r["h"] for r in graph.mean_of_neighbours(nodes, edges, 2).collect()}
    assert new == {(1, 0): [3.0, 2.0], (1, 1): [3.0, 2.0], (1, 2): [0.0, 0.0], (2, 0): [0.0, 0.0]}
    read = {r["graph_id"]: r["h"] for r in graph.mean_of_nodes(nodes, 2).collect()}
    assert read == {1: [3.0, 2.0], 2: [7.0, 7.0]}


def test_batched_ids_are_dense(spark):
    nodes, _, node_table, edges = random_graphs(spark)
    numbered, joined = graph.batch_graphs(node_table, edges)
    assert sorted(r["global_id"] for r in numbered.collect()) == list(range(len(nodes)))
    assert joined.count() == edges.count()


def test_fingerprints(spark):
    _, _, nodes, edges = random_graphs(spark)
    found = fingerprint.fingerprints(nodes, edges, n_bits=64, radius=2)
    assert all(r["bits"] == sorted(set(r["bits"])) and 0 <= min(r["bits"]) and max(r["bits"]) < 64 for r in found.collect())
    plain = fingerprint.fingerprints(nodes, edges.withColumn("bond", F.lit("9")), n_bits=64, radius=2, use_bond_types=False)
    same = fingerprint.fingerprints(nodes, edges, n_bits=64, radius=2, use_bond_types=False)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, same.collect()))
    with pytest.raises(ValueError):
        fingerprint.fingerprints(nodes, edges, kind="other")
    wide = fingerprint.add_fingerprint_columns(nodes.select("graph_id").distinct(), found, "graph_id", 64)
    assert len(wide.columns) == 65 and set(wide.drop("graph_id").first()) <= {0, 1}


def scans_and_exchanges(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.count("FileScan"), text.count("Exchange ")


def test_plans_do_not_grow_with_the_radius(spark, tmp_path):
    ring = [(1, i, (i + 1) % 6, "S") for i in range(6)]
    spark.createDataFrame([(1, i, "C") for i in range(6)], "graph_id bigint, node_id bigint, label string").write.parquet(f"{tmp_path}/nodes")
    graph.mirror_edges(spark.createDataFrame(ring, "graph_id bigint, src bigint, dst bigint, bond string")).write.parquet(f"{tmp_path}/edges")
    nodes, edges = spark.read.parquet(f"{tmp_path}/nodes"), spark.read.parquet(f"{tmp_path}/edges")
    for last in (lambda r: graph.fragments(nodes, edges, r, short=True)[r], lambda r: graph.fragment_hashes(nodes, edges, r)[r]):
        counts = [scans_and_exchanges(last(r)) for r in range(2, 6)]
        assert len(set(counts)) == 1 and counts[0][0] <= 4, counts


def test_hashed_fragments_tell_apart_what_spelled_ones_do(spark):
    draw = random.Random(5)
    nodes, bonds = [], []
    for g in range(30):
        n = draw.randint(1, 9)
        nodes += [(g, i, draw.choice("CNO")) for i in range(n)]
        bonds += [(g, i, draw.randrange(i), draw.choice("SD")) for i in range(1, n)]
    nodes = spark.createDataFrame(nodes, "graph_id bigint, node_id bigint, label string")
    edges = graph.mirror_edges(spark.createDataFrame(bonds, "graph_id bigint, src bigint, dst bigint, bond string"))
    spelled = graph.fragments(nodes, edges, 3)
    hashed = graph.fragment_hashes(nodes, edges, 3)
    for r in range(4):
        pairs = spelled[r].join(hashed[r].withColumnRenamed("label", "hash"), ["graph_id", "node_id"]).select("label", "hash").distinct().collect()
        assert len(pairs) == len({p["label"] for p in pairs}) == len({p["hash"] for p in pairs})


def test_a_star_of_many_leaves(spark):
    leaves = 100_000
    nodes = spark.range(leaves + 1).selectExpr("1L as graph_id", "id as node_id", "if(id = 0, 'Fe', concat('C', id % 1000)) as label")
    edges = graph.mirror_edges(spark.range(1, leaves + 1).selectExpr("1L as graph_id", "0L as src", "id as dst", "'S' as bond"))
    found = graph.fragment_hashes(nodes, edges, 2)[2]
    assert found.count() == leaves + 1 and found.select("label").distinct().count() == 1001


def hands(spark, hand, turned=False):
    """A centre with four different neighbours, one of them longer; ``turned`` numbers two neighbours the other way round."""
    names = ["N", "O", "F", "C"]
    if turned:
        names[1], names[2] = names[2], names[1]
    nodes = [(1, 0, "C", hand)] + [(1, i + 1, n, 0) for i, n in enumerate(names)] + [(1, 5, "C", 0)]
    bonds = [(1, 0, i, "S") for i in range(1, 5)] + [(1, 4, 5, "S")]
    nodes = spark.createDataFrame(nodes, "graph_id bigint, node_id bigint, label string, chirality int")
    return nodes, graph.mirror_edges(spark.createDataFrame(bonds, "graph_id bigint, src bigint, dst bigint, bond string"))


def test_chirality_tells_mirrored_centres_apart(spark):
    def bits(*args, **options):
        return fingerprint.fingerprints(*hands(spark, *args), hashed=True, **options).first()["bits"]

    assert bits(1) == bits(-1) == bits(1, True)
    chiral = {hand: bits(hand, use_chirality=True) for hand in (1, -1, 0)}
    assert len({tuple(b) for b in chiral.values()}) == 3 and chiral[0] == bits(1)
    assert bits(-1, True, use_chirality=True) == chiral[1]  # the same molecule, written down in another order


def test_centres_with_equal_neighbours_have_no_hand(spark):
    nodes, edges = hands(spark, 1)
    same = nodes.withColumn("label", F.when(F.col("node_id") == 2, "N").otherwise(F.col("label")))
    assert graph.chiral_marks(same, edges, graph.fragment_hashes(same, edges, 2)[2]).count() == 0


MOLECULES = ["C", "CC(=O)O", "c1ccccc1", "C1=CC=CC=C1", "c1ccc2ccccc2c1", "CC(C)(C(F)(Cl)Br)N", "C%12CC%12", "C1CC1C1CC1", "[nH]1cccc1-c1cc[se]c1", "C/C=C\\C", "[Na+].[Cl-]", "C=1CCCCC1", "N#CC(=O)[SiH2]c1ncsc1", "C(C)(C)", "O=C1C=CC(=O)c2ccccc12"]


def plain_graph(text):
    """Atoms and bonds token by token, as a reader of the grammar would."""
    atoms, bonds, stack, rings, last, bond = [], [], [], {}, None, ""
    for token in re.findall(r"\[[^\[\]]+\]|Br|Cl|%\d\d|.", text):
        if token == "(":
            stack.append(last)
        elif token == ")":
            last = stack.pop()
        elif token == ".":
            last = None
        elif re.fullmatch(r"%\d\d|\d", token):
            number = int(token.strip("%"))
            if number in rings:
                other, written = rings.pop(number)
                bonds.append((other, last, written or bond))
            else:
                rings[number] = (last, bond)
            bond = ""
        elif token in "-=#$:/\\~":
            bond = token
        else:
            symbol = re.match(r"\[?\d*([A-Z][a-z]?|[a-z][a-z]?)", token)[1]
            atoms.append((symbol.capitalize(), symbol[0].islower()))
            if last is not None:
                bonds.append((last, len(atoms) - 1, bond))
            last, bond = len(atoms) - 1, ""
    plain = [(a, b, (":" if atoms[a][1] and atoms[b][1] else "-") if not k else "-" if k in "/\\" else k) for a, b, k in bonds]
    return [s + "|aromatic" * aromatic for s, aromatic in atoms], sorted(plain + [(b, a, k) for a, b, k in plain])


def test_graphs_from_strings(spark):
    df = spark.createDataFrame([*enumerate(MOLECULES), (100, "C(C"), (101, None), (102, "C1CC"), (103, "hello")], "id int, text string")
    nodes, edges = graph.graphs_from_smiles(df, "id", "text")
    found_nodes, found_edges = {}, {}
    for r in nodes.orderBy("graph_id", "node_id").collect():
        found_nodes.setdefault(r["graph_id"], []).append(r["label"])
    for r in edges.collect():
        found_edges.setdefault(r["graph_id"], []).append((r["src"], r["dst"], r["bond"]))
    for i, text in enumerate(MOLECULES):
        labels, bonds = plain_graph(text)
        assert found_nodes[i] == labels and sorted(found_edges.get(i, [])) == bonds, text
    assert max(found_nodes) < 100
    order = {r["node_id"]: r["position"] for r in graph.bfs_order(nodes, edges).filter("graph_id = 4").collect()}
    assert len(order) == 10


def test_equal_molecules_have_equal_fingerprints(spark):
    df = spark.createDataFrame([(1, "CC(=O)O"), (2, "OC(C)=O"), (3, "CC(O)O")], "id int, text string")
    found = {r["graph_id"]: r["bits"] for r in fingerprint.fingerprints(*graph.graphs_from_smiles(df, "id", "text"), hashed=True).collect()}
    assert found[1] == found[2] != found[3]


def test_reading_a_string_grows_with_its_length(spark):
    """Long chains were once searched for aromatic atoms again for each of their bonds."""
    df = spark.createDataFrame([(i, "c1ccccc1" + "C" * 1200) for i in range(40)], "id int, text string")
    started = time.monotonic()
    assert graph.graphs_from_smiles(df, "id", "text")[1].count() == 40 * 2 * (1200 + 6)
    assert time.monotonic() - started < 30


def test_tasks_grow_in_number_with_the_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("solvane.storage.TASK_ROWS", 10)
    rows = [(g, n, "A" if n % 2 else "N", "F", 1.0 * n, 0.1) for g in range(60) for n in range(1, 6)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_quantity double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    nodes, edges = nodes_and_edges(spark, str(tmp_path))
    assert nodes.count() == 300 and nodes.rdd.getNumPartitions() == edges.rdd.getNumPartitions() == 30
    assert graph.add_self_loops(nodes, edges).filter("src = dst").count() == 300


def test_values_of_nodes_meet_edges_in_the_rows_of_joins(spark):
    nodes = spark.createDataFrame([(1, 0, "C"), (1, 0, "N"), (1, 1, None), (2, 0, "O"), (None, 0, "S"), (3, None, "P")], "graph_id bigint, node_id int, label string")
    edges = spark.createDataFrame([(1, 0, 1, "1"), (1, 1, 0, "1"), (1, 1, 0, "1"), (2, 0, 5, "1"), (None, 0, 0, "1"), (3, None, None, "2")], "graph_id bigint, src int, dst int, bond string")
    told = nodes.select("graph_id", F.col("node_id").alias("dst"), F.col("label").alias("found"))
    joined = edges.join(told, ["graph_id", "dst"]).select("graph_id", "src", "dst", "bond", "found")
    assert sorted(map(str, graph.with_node(nodes, edges, "dst", "label", "found").collect())) == sorted(map(str, joined.collect()))
    found = spark.createDataFrame([(1, 0, "x"), (1, 1, None), (4, 0, "y"), (None, 0, "z"), (3, None, "w")], "graph_id bigint, node_id int, told string")
    met = graph.beside(nodes, found, "told")
    assert sorted(map(str, met.collect())) == sorted(map(str, nodes.join(found, ["graph_id", "node_id"], "left").collect()))
    assert met.dtypes == [*nodes.dtypes, ("told", "string")]


@pytest.mark.parametrize("work", [graph.relabel, lambda n, e: graph.mean_of_neighbours(n.withColumn("h", F.array(F.lit(1.0))), e, 1)])
def test_dealt_graphs_are_not_dealt_again(spark, work):
    """A join by (graph, node) would deal them to the fixed number of shuffle partitions, whatever their rows."""
    _, _, nodes, edges = random_graphs(spark)
    done = work(nodes.repartition(7, "graph_id"), edges.repartition(7, "graph_id"))
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_walks_stay_in_the_deal_of_their_graphs(spark):
    """Lists of edges meet their start nodes where they lie, so that a task's share does not grow with the table."""
    _, _, nodes, edges = random_graphs(spark)
    done = graph._bfs_within_row(nodes.repartition(7, "graph_id"), edges.repartition(7, "graph_id"), 0, "dst")
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def odd_graphs(spark):
    """Random graphs with null ids, labels and bonds, ends without a node, an edge that comes twice, and a node that comes twice."""
    draw = random.Random(9)
    nodes, edges = [(None, 0, "C", 1), (None, 0, "N", 0), (50, None, "C", 1), (60, 0, "C", 1), (60, 0, "N", 1), (60, 1, "O", 0)], []
    edges += [(None, 0, 0, "1"), (50, None, 0, "1"), (60, 0, 1, "1"), (60, 1, 0, "1"), (70, 0, 1, "1")]
    for g in range(25):
        n = draw.randrange(1, 9)
        nodes += [(g, i, draw.choice(["C", "N", "O", "F", "S", None] if g % 5 == 0 else "CNOFS"), draw.choice((-1, 0, 1, None))) for i in range(n)]
        pairs = [(draw.randrange(n), draw.randrange(n + (g % 4 == 0))) for _ in range(2 * n)]
        edges += [(g, a, b, k) for a, b in pairs for k in [draw.choice(["1", "2", None] if g % 6 == 0 else "12")] for a, b in ((a, b), (b, a))]
    return (
        spark.createDataFrame(nodes, "graph_id bigint, node_id int, label string, chirality int").repartition(3),
        spark.createDataFrame(edges, "graph_id bigint, src bigint, dst bigint, bond string").repartition(3),
    )


@pytest.mark.parametrize(("limit", "chunk"), [(65_536, 1 << 17), (65_536, 5), (20, 1 << 17), (0, 1 << 17)])
def test_hashed_rounds_within_graphs_equal_those_by_joins(spark, monkeypatch, limit, chunk):
    monkeypatch.setattr(graph, "GRAPH_ROWS", limit)
    if chunk < 100:
        monkeypatch.setattr("solvane.functions.rounds.CHUNK", chunk)
    nodes, edges = odd_graphs(spark)
    plain = graph._hashed_by_joins(nodes, edges, 3)
    marked = graph._hashed_by_joins(nodes, edges, 3, graph.chiral_marks(nodes, edges, plain[-1]))
    for wanted, found in ((plain, graph.fragment_hashes(nodes, edges, 3)), (marked, graph.fragment_hashes(nodes, edges, 3, chiral=True))):
        for a, b in zip(wanted, found, strict=True):
            assert a.dtypes == b.dtypes and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    for chiral in (False, True):
        bits = fingerprint.fingerprint_bits(nodes, edges, 64, 2, use_chirality=chiral, hashed=True).groupBy("graph_id").agg(F.sort_array(F.collect_list("bit")).alias("bits"))
        whole = fingerprint.fingerprints(nodes, edges, n_bits=64, radius=2, use_chirality=chiral, hashed=True)
        assert sorted(map(str, bits.collect())) == sorted(map(str, whole.collect()))


def test_hashed_rounds_are_worked_out_where_graphs_lie(spark):
    """Each round once joined edges with labels twice and dealt both to the fixed number of shuffle partitions."""
    _, _, nodes, edges = random_graphs(spark)
    for found in (graph.fragment_hashes(nodes, edges, 3)[3], fingerprint.fingerprints(nodes, edges, n_bits=64, hashed=True)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan


def test_sums_of_hashes_are_exact(spark):
    """Halves of a hash were once taken by a division of doubles, which rounds hashes near the next multiple up."""
    from solvane.operators.graph import HASH_BITS

    values = [(1 << 60) - 1, (3 << 30) + (1 << 59) + (1 << 30) - 1]
    half = spark.createDataFrame([(v,) for v in values], "_h bigint").select(F.shiftright("_h", HASH_BITS // 2).alias("v"))
    assert [r["v"] for r in half.collect()] == [v >> 30 for v in values]
