import duckdb
import pytest
from pyspark.sql import functions as F

from loomgraph.functions.conditions import condition, hyperkey
from loomgraph.operators import changes, patterns, select
from loomgraph.plans import catalogue
from loomgraph.sources import files
from loomgraph.sources.star import Graph

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["attr_gt", "attr_ne_missing", "edge_members_all", "pit_orders_at", "p_two_hop", "p_optional", "edge_hyperkey", "reachability", "update_and_delete"])
def test_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns)
    found = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in found.fetchall()), key=repr)
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=repr) == want


@pytest.fixture(scope="session")
def stooges(spark):
    person = lambda i, label, born, **more: ("g", i, label, "Person", "active", ["stooge"], f'{{"born": "{born}", "order": {more.get("order", 1)}}}', None, None)
    nodes = [person("moe", "Moe Howard", "1897-06-19"), person("larry", "Larry Fine", "1902-10-05", order=2), person("curly", "Curly Howard", "1903-10-22", order=3), person("shemp", "Shemp Howard", "1895-03-11", order=3), ("g", "three", "Three Stooges", "Group", "active", [], '{"medium": ["film", "stage"], "formed": 1925, "odd": "10"}', None, None)]
    n = spark.createDataFrame(nodes, "hypergraph_id string, id string, label string, type string, status string, tags array<string>, attributes string, valid_from string, valid_to string")
    m = lambda *ids: [(x, k) for k, x in enumerate(ids)]
    edges = [("g", "original", "has-member", "hub", "active", ["classic"], '{"era": "classic"}', m("three", "moe", "larry", "curly"), "1932-01-01", "1946-12-31 23:59:59"), ("g", "shemp", "has-member", "hub", "active", [], '{"era": "shemp"}', m("three", "moe", "larry", "shemp"), "1947-01-01", "1955-11-22 23:59:59"), ("g", "siblings", "sibling", "symmetric", "active", [], "{}", m("moe", "shemp", "curly"), None, None), ("g", "gone", "sibling", "symmetric", "archived", [], "{}", m("moe", "larry"), None, None)]
    e = spark.createDataFrame(edges, "hypergraph_id string, id string, relation string, flavor string, status string, tags array<string>, attributes string, members array<struct<node_id: string, seq: int>>, valid_from string, valid_to string")
    typed = lambda d: d.withColumns({"attributes": F.parse_json("attributes"), "valid_from": F.col("valid_from").cast("timestamp"), "valid_to": F.col("valid_to").cast("timestamp")})
    return Graph(typed(n), typed(e))


def ids(df, column="id"):
    return sorted(r[column] for r in df.select(column).collect())


def test_conditions_by_kind(stooges):
    n = stooges.nodes
    assert ids(n.where(condition({"medium": "film"}))) == ["three"]
    assert ids(n.where(condition({"odd": {"$gt": 5}}))) == []
    assert ids(n.where(condition({"attributes.born": {"$lt": "1900-01-01"}}))) == ["moe", "shemp"]
    assert ids(n.where(condition({"order": {"$ne": 3}}))) == ["larry", "moe", "three"]
    assert ids(n.where(condition({"label": {"$regex": "^cur", "$options": "i"}}))) == ["curly"]
    assert ids(n.where(condition({"order": {"$in": [None, 1]}}))) == ["moe", "three"]
    with pytest.raises(ValueError):
        condition({"a": {"$near": 1}})


def test_edges_by_time_status_and_members(stooges):
    e = stooges.edges
    assert ids(select.matched(e, relation="has-member", at="1940-06-01")) == ["original"]
    assert ids(select.matched(e, relation="has-member", at="1946-12-31 23:59:59")) == ["original"]
    assert ids(select.matched(e, nodes=["moe", "curly"])) == ["original", "siblings"]
    assert ids(select.matched(e, status=None, nodes="larry", relation="sibling")) == ["gone"]


def test_patterns(stooges):
    b = patterns.node_pattern(stooges, None, "p", type="Person")
    out = patterns.optional(b, lambda x: patterns.edge_pattern(stooges, x, "s", ["?p"], relation="sibling"))
    assert sorted((r["p"], r["s"]) for r in out.collect()) == [("curly", "siblings"), ("larry", None), ("moe", "siblings"), ("shemp", "siblings")]
    two = patterns.edge_pattern(stooges, None, "e", ["?x", "?y"], relation="sibling")
    assert two.count() == 6
    members = patterns.edge_pattern(stooges, None, "e", ["three", "?m"], relation="has-member", at="1940-01-01")
    assert ids(members, "m") == ["curly", "larry", "moe"]


def test_inference(spark, stooges):
    inv = changes.inverse_edges(stooges.edges, spark.createDataFrame([("has-member", "member-of")], "relation string, inverse string"))
    r = inv.where("id = 'original_inv'").first()
    assert r["relation"] == "member-of" and [m["node_id"] for m in r["members"]] == ["curly", "larry", "moe", "three"]
    m = Graph(stooges.nodes, select.matched(stooges.edges, relation="has-member")).membership
    assert ids(changes.reachable(m, "three"), "node_id") == ["curly", "larry", "moe", "shemp", "three"]
    assert ids(changes.reachable(m, "three", max_depth=0), "node_id") == ["three"]


def test_published_key(spark):
    members = F.array(*map(F.lit, ["person:moe", "group:three-stooges", "person:larry", "person:curly-joe"]))
    assert spark.range(1).select(hyperkey(F.lit("hg-alpha"), F.lit(" Has-Member "), members)).first()[0] == "097828c60c64b39fc0e0ad83f2f0bea7"


def test_export_and_import(spark, stooges, tmp_path):
    files.export(stooges, "g", str(tmp_path))
    (tmp_path / "nodes" / "bad.json").write_text("{not json\n")
    back, counts = files.load(spark, "copy", str(tmp_path), stooges)
    assert tuple(counts.first()) == (5, 4, 1)
    assert ids(select.matched(back.nodes, hypergraph_id="copy", where={"formed": 1925})) == ["three"]
    assert back.edges.where("id = 'original'").first()["members"][3]["node_id"] == "curly"


def test_logical_graphs(stooges):
    assert select.scoped(stooges.nodes, "all", {"all": ["part", "all"], "part": ["g", "missing"]}).count() == 5
