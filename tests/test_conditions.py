"""Kinds, negations and defaults of conditions; keys of any alphabet."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F
from test_graph import ids, stooges  # noqa: F401

from loomgraph.functions.conditions import condition, hyperkey
from loomgraph.operators import select


def test_status_in_where_replaces_the_default(stooges):  # noqa: F811
    e = stooges.edges
    assert ids(select.matched(e, where={"status": "archived"})) == ["gone"]
    assert ids(select.matched(e, where={"status": {"$in": ["archived", "active"]}}, relation="sibling")) == ["gone", "siblings"]
    assert ids(select.matched(e, relation="sibling")) == ["siblings"]


def test_denied_members_are_in_no_place(stooges):  # noqa: F811
    e = stooges.edges
    assert ids(select.matched(e, where={"members.node_id": {"$ne": "larry"}})) == ["siblings"]
    assert ids(select.matched(e, where={"members.node_id": {"$nin": ["larry", "nobody"]}})) == ["siblings"]
    assert ids(select.matched(e, where={"members.node_id": {"$not": {"$regex": "^curl"}}})) == ["shemp"]
    assert ids(select.matched(e, where={"members": {"node_id": {"$ne": "curly", "$in": ["larry"]}}})) == ["shemp"]


def test_values_by_kind(spark):
    rows = [("a", '{"flag": true, "size": 10, "neg": -5, "list": ["x1", "y"]}'), ("b", '{"flag": false, "size": "10", "neg": 3, "list": [1, 11]}'), ("c", '{"flag": [true], "neg": "7"}')]
    d = spark.createDataFrame(rows, "id string, attributes string").withColumn("attributes", F.parse_json("attributes"))
    got = lambda doc: ids(d.where(condition(doc)))
    assert got({"flag": True}) == ["a", "c"] and got({"flag": {"$ne": True}}) == ["b"]
    assert got({"size": {"$regex": "^1"}}) == ["b"] and got({"list": {"$regex": "^x"}}) == ["a"]
    assert got({"size": {"$mod": [5, 0]}}) == ["a"] and got({"neg": {"$mod": [4, -1]}}) == ["a"]
    for bad in ({"$or": []}, {"$and": []}, {"$nor": []}, {"size": {"$all": []}}):
        with pytest.raises(ValueError):
            condition(bad)


def test_columns_that_edges_lack_are_missing(stooges):  # noqa: F811
    assert ids(select.matched(stooges.edges, where={"type": "Person"})) == []
    assert len(ids(select.matched(stooges.edges, where={"type": {"$ne": "Person"}}))) == 3


def test_keys_of_any_alphabet(spark):
    rows = [("g", "  Knows\t\n", ["b", "a"]), ("gé", "　Kennt ", ["é", "z", "ab\"c\\"]), ("g", "likes", ["𝄞", "日本", "a/b\u007f"])]
    d = spark.createDataFrame(rows, "g string, r string, m array<string>")
    got = [r[0] for r in d.select(hyperkey(F.col("g"), F.col("r"), F.col("m"))).collect()]
    want = [json.dumps({"graph": g, "members": sorted(m), "relation": r.lower().strip()}, sort_keys=True, separators=(",", ":")) for g, r, m in rows]
    assert got == [hashlib.sha256(w.encode()).hexdigest()[:32] for w in want]


def test_lists_are_looked_up_at_once(spark):
    rows = [("a", '{"n": 3, "s": "x", "z": -0.0}'), ("b", '{"n": "3", "s": ["q", "x"]}'), ("c", '{"n": [7, 40], "s": null}'), ("d", '{"n": 2.5, "s": true}'), (None, '{"n": 12}')]
    d = spark.createDataFrame(rows, "id string, attributes string").withColumn("attributes", F.parse_json("attributes"))
    many = [f"k{i}" for i in range(60)]
    lists = {"id": [["a", "c"], [*many, "b"], ["a", None], []], "n": [[3, 2.5], [*range(20, 80)], ["3", 12], [*many, 3, "3"], [None]], "s": [["x"], ["x", True], [None, "q"], [{"$regex": "^x"}, *many]], "z": [[0, *range(2, 30)], [0.0]]}
    for field, some in lists.items():
        for values in some:
            for op in ("$in", "$nin"):
                each = F.lit(False)
                for v in values:
                    each = each | condition({field: v})
                want = {repr(r) for r in d.where(each if op == "$in" else ~each).collect()}
                assert {repr(r) for r in d.where(condition({field: {op: values}})).collect()} == want, (field, op, values)
    # a list's values don't stand in the plan one by one, each with its own computation of the column
    shown = d.where(condition({"id": {"$in": many}}))._jdf.queryExecution().optimizedPlan().toString()
    assert "INSET" in shown and " OR " not in shown.upper()
