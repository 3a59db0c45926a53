from plumbline.run import check_conformance
from plumbline.sources.spec_files import read_spec
from tests.core.mill import COLUMNS, TYPES, item


def test_walk_of_a_self_reference(spark, tmp_path):
    """A chain of 9 levels over two tables and two links; a loop that no root leads to stays unreached."""
    keys = (("plots", "plot_id", "PK", None), ("trees", "tree_id", "PK", None), ("trees", "plot_id", "FK", "plots"), ("trees", "parent_tree", "FK", "trees"))
    dictionary = [item(t, f, "words", role=k, points_to=p) for t, f, k, p in keys]
    reach = [{"table_name": t, "attribute_name": a, "how": h} for t, a, h in (("plots", None, "root"), ("trees", "plot_id", "from_parent"), ("trees", "parent_tree", "from_child"))]
    trees = [(f"T{k}", None if k < 8 else "P", f"T{k - 1}" if k else None) for k in range(9)] + [("A", None, "B"), ("B", None, "A")]
    data = {"plots": ([("P",)], "plot_id string"), "trees": (trees, "tree_id string, plot_id string, parent_tree string")}
    tables = {}
    for t, (x, schema) in data.items():
        spark.createDataFrame(x, schema).write.parquet(str(tmp_path / t))
        tables[t] = spark.read.parquet(str(tmp_path / t))
    for how in ("from_child", "from_parent"):
        if how == "from_parent":  # the same chain downwards: the plot holds its first tree
            reach[2] = reach[2] | {"how": how}
            down = spark.createDataFrame([(t, "P" if t == "T0" else None, p) for t, _, p in trees], data["trees"][1])
            down.write.parquet(str(tmp_path / "down"))
            tables["trees"] = spark.read.parquet(str(tmp_path / "down"))
        run = check_conformance(spark, read_spec(dictionary, columns=COLUMNS, types=TYPES, reach=reach), tables, rules=["record_unreachable"])
        assert [(r.n_checked, r.n_unchecked) for r in run.results.collect() if r.table_name == "trees"] == [(9, 2)]
