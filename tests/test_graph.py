"""Graph operators: lists, sort orders, flatten round trip, reports."""

from tessera.operators import graph
from tessera.sources import fixtures as fx

from .conftest import SF001, SF01


def test_field_to_papers_list_and_order(spark):
    r, s = fx.graph(spark, SF001)
    rows = graph.field_to_papers(r, s, with_list=True, sort=True).collect()
    assert len(rows) == 30
    counts = [x.n_papers for x in rows]
    assert counts == sorted(counts, reverse=True)
    assert all(x.n_papers == len(x.PaperIds) and x.PaperIds == sorted(x.PaperIds) for x in rows)
    assert [x.ResearchFieldId for x in rows if x.n_papers == 0] == ["F100", "F101", "F102", "F103", "F104"]


def test_explode_equals_flat(spark):
    r, s = fx.graph(spark, SF001)
    lists = graph.field_to_papers(r, s, with_list=True)
    a = sorted(map(tuple, graph.explode_field_papers(lists, r).collect()))
    b = sorted(map(tuple, graph.field_paper_rows(r, s).collect()))
    assert a == b


def test_resources_by_class_sorted(spark):
    r, _ = fx.graph(spark, SF001)
    ids = [x.id for x in graph.resources_by_class(r, "Paper", sort=True).collect()]
    assert "Custom_ID" not in ids and ids == sorted(ids, key=lambda i: int(i[1:]))


def test_doi_counts(spark):
    r, s = fx.graph(spark, SF01)
    dois = graph.paper_doi(graph.resources_by_class(r, "Paper"), s)
    got = {x.n_doi: x["count"] for x in dois.groupBy("n_doi").count().collect()}
    assert got == {0: 1500, 1: 13200, 2: 300}


def test_field_to_contributions_with_list(spark):
    r, s = fx.graph(spark, SF001)
    flat = graph.field_paper_rows(r, s)
    out = graph.field_to_contributions(graph.field_to_papers(r, s), flat, s, with_list=True).collect()
    assert all(x.n_contributions == len(x.Contributions) for x in out)
    assert sum(x.n_contributions == 0 for x in out) == 5


def test_papers_without_title(spark):
    res = spark.createDataFrame([("R1", "t", ["Paper"])], "id string, label string, classes array<string>")
    ids = spark.createDataFrame([("R1",), ("R2",)], "PaperId string")
    assert [x.PaperId for x in graph.papers_without_title(ids, res).collect()] == ["R2"]


def test_document_graph_has_five_empty_fields(spark):
    r, s = fx.document_graph(spark, SF01)
    rows = graph.field_to_papers(r, s).collect()
    assert len(rows) == 25 and sum(x.n_papers == 0 for x in rows) == 5
    assert sum(x.n_papers for x in rows) == 1000


def test_last_title_of_a_repeated_id(spark):
    resources = spark.createDataFrame([("R1", "first", ["Paper"], 1), ("R1", "last", ["Paper"], 2)],
                                      "id string, label string, classes array<string>, seen int")
    statements = spark.createDataFrame([("R1", "P30", "field", "F1", "f")],
                                       "subject_id string, predicate_id string, predicate_label string, object_id string, object_label string")
    got = graph.field_paper_rows(resources, statements, order_col="seen").collect()
    assert [(r.PaperId, r.PaperTitle) for r in got] == [("R1", "last")]


def test_last_title_by_source_order(spark, scratch):
    from tessera.sources import graph_snapshot

    rows = [("R1", "zebra", ["Paper"]), ("R2", "only", ["Paper"]), ("R1", "apple", ["Paper"])]
    schema = "id string, label string, classes array<string>"
    for i in range(3):  # three files, in the order of their names; R1 ends with the title of the last
        said = rows if i < 2 else [("R1", "mango", ["Paper"])]
        spark.createDataFrame(said, schema).coalesce(1).write.mode("append").parquet(f"{scratch}/r/part={i}")
    flat = spark.createDataFrame([("R1", "P30", "f", "F1", "x"), ("R2", "P30", "f", "F1", "x")],
                                 "subject_id string, predicate_id string, predicate_label string, object_id string, object_label string")
    for name, last in (("r/part=0", "apple"), ("r", "mango")):
        resources = graph_snapshot.read_resources(spark, f"{scratch}/{name}", ordered=True)
        for parts in (1, 4):
            got = graph.field_paper_rows(resources.repartition(parts), flat, order_col="ord")
            assert sorted((r.PaperId, r.PaperTitle) for r in got.collect()) == [("R1", last), ("R2", "only")]
    assert {r.PaperTitle for r in graph.field_paper_rows(resources, flat).collect()} == {"zebra", "only"}
