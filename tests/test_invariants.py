"""Re-partitioning the input changes no result."""
from tessera.operators import curate, graph, score
from tessera.operators.common import keep_last
from tessera.sources import fixtures as fx

from .conftest import SF001


def _same(a, b):
    return sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_partitioning_does_not_change_results(spark):
    rows = fx.text_rows(spark, SF001)
    for parts in (1, 7):
        moved = rows.repartition(parts)
        assert _same(curate.finalize(rows), curate.finalize(moved))
        assert _same(keep_last(rows, ["PredicateLabel"]), keep_last(moved, ["PredicateLabel"]))
    preds = fx.predictions(spark, SF001)
    assert _same(score.metrics(score.score_rows(preds)),
                 score.metrics(score.score_rows(preds.repartition(5))))
    r, s = fx.graph(spark, SF001)
    assert _same(graph.field_to_papers(r, s), graph.field_to_papers(r.repartition(3), s.repartition(9)))
