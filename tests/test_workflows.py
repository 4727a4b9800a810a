"""Files, configurations, SQL functions, running ids and tables of results."""

import pytest

from vectorloom.functions import sql
from vectorloom.operators import distances, graph, regression
from vectorloom.plans import config, workflow_queries
from vectorloom.sources import tables


def test_write_file_replaces(spark, tmp_path):
    path = str(tmp_path / "a__b__c.parquet")
    tables.write_file(spark.range(3), path)
    tables.write_file(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["a__b__c.parquet"]
    found = tables.named_pairs(spark, path).first()
    assert (found.name_a, found.name_b, found.dataset) == ("a", "b", "c")


def test_clean_deletes_matches_alone(spark, tmp_path):
    for name in ("x1", "x2", "y1"):
        (tmp_path / name).mkdir()
    assert [p.rsplit("/", 1)[1] for p in tables.clean(spark, f"{tmp_path}/x*")] == ["x1", "x2"]
    assert [p.name for p in tmp_path.iterdir()] == ["y1"]
    assert tables.clean(spark, f"{tmp_path}/none*") == []


def test_failures_and_card(spark, tmp_path):
    checked = spark.createDataFrame([("a", True, None), ("b", False, "X")], "path string, ok boolean, error string")
    assert tables.write_failures(checked, str(tmp_path / "f")) == 1
    assert spark.read.json(str(tmp_path / "f")).first()["path"] == "b"
    found = spark.createDataFrame([("train", ["m0", "m1"]), ("test", ["m0"])], "split string, models array<string>")
    card = tables.dataset_card("Vectors", found)
    assert card.count("config_name") == 2 and "    path: test/m0/part-*.parquet" in card and "| train | 2 |" in card
    assert tables.not_uploaded(found, found.where("split = 'test'")).count() == 2


def test_tsne_goes_through_all_iterations(spark, monkeypatch):
    given = []

    def embed(df, key, vector, n, **options):
        given.append(options)
        return df.selectExpr(f"{key}", "array(0.0D, 0.0D) components")

    monkeypatch.setitem(workflow_queries.reduce.REDUCTIONS, "tsne", embed)
    assert workflow_queries.tsne(spark, "/root/testdata/sf0.001").first().n == 500
    assert given == [{}]


def test_split_is_a_partition_and_near_the_share(spark):
    found = tables.split_rows(spark.range(5000), "id").groupBy("split").count().collect()
    sizes = {r["split"]: r["count"] for r in found}
    assert sum(sizes.values()) == 5000 and abs(sizes["train"] - 4000) < 120


def test_config():
    base = {"a": {"b": 1, "c": [1, 2]}, "d": "x"}
    assert config.compose(base, {"a": {"c": [3]}}, {"d": None}) == {"a": {"b": 1, "c": [3]}, "d": None}
    assert config.override("a.b=2.5") == {"a": {"b": 2.5}} and config.override("a=text=1") == {"a": "text=1"}
    assert [(c["a"]["b"], c["d"]) for c in config.sweep(base, {"a.b": [5, 6], "d": ["p", "q"]})] == [(5, "p"), (5, "q"), (6, "p"), (6, "q")]
    assert base["a"]["b"] == 1
    for wrong in ("nothing", "a..b=1", "=1"):
        with pytest.raises(ValueError):
            config.override(wrong)


def test_config_files_and_unknown_task(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"task": "none", "metric": "m", "table": "t"}')
    with pytest.raises(ValueError, match="unknown tasks none"):
        config.run({"t": spark.range(1)}, [config.load(str(tmp_path / "c.json"))])


def test_sql_functions_of_edge_cases(spark):
    assert sql.register(spark) == list(sql.FUNCTIONS)
    row = spark.sql("select vl_cosine(array(0D, 0D), array(1D, 1D)) a, vl_norm(array()) b, vl_distance(array(0D, 3D), array(4D, 0D)) c, vl_dot(null, array(1D)) d").first()
    assert (row.a, row.b, row.c, row.d) == (None, 0.0, 5.0, None)


def test_row_ids_with_ties_and_empty(spark):
    df = spark.range(1000).selectExpr("id as k", "cast(id % 7 as int) as o")
    found = graph.row_ids(df, "o").orderBy("id").collect()
    assert [r["id"] for r in found] == list(range(1000))
    assert [r["o"] for r in found] == sorted(r["o"] for r in found)
    assert graph.row_ids(df.where("false"), "o").count() == 0


def test_latex_has_joint_rows(spark):
    rows = [("a", "y", "is_treatment", 1.5, 0.5, 3.0, 0.004, 0.5, 2.5, 0.2, 40, 30, 2.0), ("a", "y", "joint:arch_family", None, None, 4.25, 0.03, None, None, 0.2, 40, 30, 2.0)]
    lines = regression.latex_table(spark.createDataFrame(rows, regression.RESULT)).split("\n")
    assert lines[2] == "a & y & 1.5000*** & (0.5000) & 40 \\\\"
    assert lines[3] == " & $F$, arch family & 4.2500** & [0.0300] & 40 \\\\"


def test_sinkhorn_raises_instead_of_sampling(spark):
    df = spark.range(30).selectExpr("id", "array(cast(id as float)) as v")
    with pytest.raises(ValueError, match="more than 20 rows"):
        distances.sinkhorn(df, df, "id", "v", limit=20)
    assert distances.sinkhorn(df, df, "id", "v", max_points=20) >= 0
