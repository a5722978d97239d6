"""Calls that stand as rows are counted as rows: no method holds them in an array."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph
from lodestone.plans import store_queries  # noqa: F401  registers its queries
from lodestone.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_edges_count_rows_as_arrays(spark):
    call = "struct<signature:string,resolutionMode:string,orderIndex:int>"
    kind = f"ord int, classFqn string, methodName string, parameterTypes array<string>, returnType string, invocations array<{call}>, siblingMethods array<struct<methodName:string,parameterTypes:array<string>,returnType:string,invocations:array<{call}>>>"
    made = [("a.A::m() ->  void", "EXACT", 0), ("a.A::m() -> void", "EXACT", 1), ("a.A::s(int,  int) -> int", "EXACT", 2), ("a.A::m() -> void", "UNRESOLVED", 3), ("q.Q::no() -> void", "EXACT", 4)]
    again = [("a.A::s(int,int) -> int", "EXACT", 0)]
    rows = lambda own: [(0, "a.A", "m", [], "void", own, [("s", ["int", "int"], "int", [made[0]])]), (1, "a.A", "m", [], "void", again if own else [], [])]
    want = sorted(map(tuple, graph.edges(graph.flatten_vertices(spark.createDataFrame(rows(made), kind), "ord")).collect()))
    calls = spark.createDataFrame([(0, s, m) for s, m, _ in made] + [(1, s, m) for s, m, _ in again], "method int, signature string, resolutionMode string")
    got = sorted(map(tuple, graph.edges(graph.flatten_vertices(spark.createDataFrame(rows([]), kind), "ord"), calls).collect()))
    assert got == want and len(got) == 3  # what the second of two equal methods calls counts in neither


@pytest.mark.parametrize("name", ["call_graph_adjacency", "call_graph_checks", "call_graph_dense", "call_graph_edges", "call_graph_payload", "stored_graph"])
def test_no_method_holds_its_calls(spark, monkeypatch, name):
    seen, whole = [], graph.flatten_vertices
    monkeypatch.setattr(graph, "flatten_vertices", lambda methods, order: seen.append(methods) or whole(methods, order))
    QUERIES[name](spark, SF)
    assert [m.agg(F.max(F.size("invocations"))).first()[0] for m in seen] == [0]
