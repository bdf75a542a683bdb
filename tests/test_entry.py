"""Driver contract: entry smoke run, registry/oracle consistency, oracle comparison."""
import pytest

import __spark_entry__ as entry
from tessera.operators.flatmap import flat_map
from tessera.plans.queries import REGISTRY
from tessera.plans.verify import compare

from .conftest import SF01


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["ResearchFieldId", "ResearchFieldLabel", "n_papers"]
    assert df.count() == 30


def test_oracle_keys_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(REGISTRY) <= set(entry.queries())
    rows_only = set(REGISTRY) - set(entry.oracle_sql())
    assert rows_only == {"answer_span_regex", "token_positions_subword"}


def test_flat_map_result_shapes(spark):
    df = spark.createDataFrame([("a b",), ("z",), (None,)], "item string")

    def fn(x, mode):
        if x is None:
            return None
        return x.split(" ") if mode == "list" else x

    lst = sorted(map(tuple, flat_map(df, fn, "item", "string", "list").collect()), key=str)
    assert lst == sorted([("a b", "a"), ("a b", "b"), ("z", "z"), (None, None)], key=str)
    chars = flat_map(df.filter("item = 'a b'"), fn, "item", "string", "str").collect()
    assert [r.value for r in chars] == ["a", " ", "b"]


@pytest.mark.parametrize("chunk", [0, 1, 2])
def test_queries_match_oracle(spark, chunk):
    names = sorted(REGISTRY)
    part = names[chunk::3]
    rep = compare(spark, SF01, part, verbose=False)
    bad = {k: v for k, v in rep.items()
           if v.get("cols_match") is False or v.get("values_match") is False
           or ("oracle_rows" in v and v["oracle_rows"] != v["rows"])}
    assert not bad, bad


def test_flat_map_keeps_integers(spark):
    df = spark.createDataFrame([(9007199254740993,), (None,), (5,)], "item long")
    got = {r.item: r.value for r in flat_map(df, lambda x: repr(x).split(), "item", "string").collect()}
    assert got == {9007199254740993: "9007199254740993", None: "None", 5: "5"}
    many = flat_map(df, lambda x: range(7), "item", "long", chunk_rows=3).collect()
    assert len(many) == 21
