import bindings
from bindings import models as forests
from solvane.operators import fingerprint, graph, models

bindings.load_all()


def test_a_value_outside_of_all_bins_has_no_class(spark, tmp_path):
    kinds = ["click", "error", "purchase", "signup", "view"]
    rows = [(i, i % 13, kinds[i % 5], None if i == 7 else float(i // 10)) for i in range(300)]  # ten are 0, one is null
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    found = {r["ml_phase"]: r["accuracy"] for r in bindings.QUERIES["m2_forest_classification"](spark, str(tmp_path)).collect()}
    assert set(found) == {"train", "val"}
    assert all(0 <= accuracy <= 1 for accuracy in found.values())


def orders_and_lines(spark, folder):
    lines = [(g, n, "ANR"[(g + n) % 3], "FO"[n % 2], 1.0 * n, 0.1) for g in range(40) for n in range(1, 2 + g % 6)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_quantity double, l_tax double").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(g, 1000.0 * (g % 7)) for g in range(45)], "o_orderkey long, o_totalprice double").write.parquet(f"{folder}/orders.parquet")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_passes_over_fingerprints_do_not_work_them_out_again(spark, tmp_path, monkeypatch):
    """Splits by rank pass several times over the ids, and each pass once relabelled all graphs."""
    orders_and_lines(spark, str(tmp_path))
    data = forests.order_fingerprints(spark, str(tmp_path))
    assert data.count() == 40
    assert "Window" not in plan_of(data) and "Join" not in plan_of(data)


def test_bins_of_each_setting_do_not_work_its_fingerprints_out_again(spark, tmp_path, monkeypatch):
    orders_and_lines(spark, str(tmp_path))
    met = []
    monkeypatch.setattr(models, "classify_bins", lambda df, *args: met.append(plan_of(df)) or df.groupBy().count())
    assert [r["count"] for r in bindings.QUERIES["m2_classification_over_bins_and_fingerprints"](spark, str(tmp_path)).collect()] == [40, 40]
    assert len(met) == 2 and not any("Window" in plan or "Join" in plan for plan in met)


def test_settings_of_other_widths_share_their_labels(spark, monkeypatch):
    nodes = spark.createDataFrame([(g, n, "CNO"[(g * n) % 3] if g < 9 else None) for g in range(10) for n in range(4)], "graph_id long, node_id int, label string")
    edges = graph.mirror_edges(spark.createDataFrame([(g, n, n + 1, "1") for g in range(10) for n in range(g % 4)], "graph_id long, src int, dst int, bond string"))
    settings = [{"n_bits": 8, "radius": 1}, {"n_bits": 32, "radius": 1}, {"n_bits": 32, "radius": 0}, {"n_bits": 16, "radius": 1, "hashed": True}, {"n_bits": 16, "radius": 1, "use_bond_types": False}]
    expected = {(r["graph_id"], i): r["bits"] for i, s in enumerate(settings) for r in fingerprint.fingerprints(nodes, edges, **s).collect()}
    rounds, relabel = [], graph.relabel
    monkeypatch.setattr(graph, "relabel", lambda *args: rounds.append(1) or relabel(*args))
    found = {}

    def run(bits, setting):
        found.update({(r["graph_id"], settings.index(setting)): r["bits"] for r in bits.collect()})
        return bits.groupBy().count()

    both = models.over_fingerprints(nodes, edges, settings[:2], run)
    assert len(rounds) == 1 and sorted(map(tuple, both.collect())) == [(10, 8, 1), (10, 32, 1)]
    for setting in settings[2:]:
        models.over_fingerprints(nodes, edges, [setting], run)
    assert found == expected
