"""Physical-plan properties the operators rely on at scale."""
import contextlib
import io
import re

from pyspark.sql import functions as F

from tessera.operators import graph, split, titles
from tessera.operators.common import keep_last, repeated_keys
from tessera.sources import fixtures as fx

from .conftest import SF001


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_keep_last_combines_before_shuffle_and_survives_hot_key(spark):
    hot = spark.range(0, 30000).select(F.col("id").alias("ord"),
                                        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"),
                                        F.repeat(F.lit("abstract "), 50).alias("abstract"))
    plan = _plan(repeated_keys(hot, ["k"]))
    assert "partial_count" in plan and "partial_max" in plan
    assert plan.index("partial_count") > plan.index("Exchange")  # partial step sits below the exchange
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "abstract" not in plan
    out = keep_last(hot, ["k"])
    assert out.filter("k = 0").first().ord == 29997
    # the rows stay where they are: no exchange but that of the small published table
    plan = _plan(out)
    assert "SortAggregate" not in plan and "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_finalize_shuffles_no_abstract(spark):
    from tessera.operators import curate

    source = fx.text_rows(spark, SF001)
    rows = spark.createDataFrame(source.collect(), source.schema)
    plan = _plan(curate.finalize(rows))
    assert "SortAggregate" not in plan and "hashpartitioning" not in plan


def test_predicate_filter_reaches_parquet_scan(spark, scratch):
    _, statements = fx.graph(spark, SF001)
    statements.write.parquet(scratch + "/st")
    st = spark.read.parquet(scratch + "/st")
    papers = spark.createDataFrame([("R1",)], "id string")
    plan = _plan(graph.statements_for(st, papers, "P30"))
    assert "EqualTo(predicate_id,P30)" in plan


def test_field_counts_are_hash_aggregated(spark):
    r, s = fx.graph(spark, SF001)
    plan = _plan(graph.field_to_papers(r, s))
    assert "HashAggregate" in plan and "lineitem" not in plan  # unused statement branches pruned


def test_split_ranks_inside_buckets(spark):
    import re

    df = spark.range(0, 100).select(F.col("id").alias("ord"), F.concat(F.lit("p"), F.col("id") % 2).alias("PredicateLabel"),
                                    F.repeat(F.lit("abstract "), 50).alias("abstract"))
    plan = _plan(split.predicate_cuts(df))
    # row_number runs per (predicate, hash bucket), never over a whole predicate
    assert re.search(r"row_number\(\) windowspecdefinition\(PredicateLabel#\d+L?, _b#", plan)
    assert "abstract" not in plan
    plan = _plan(split.stratified_split(df))  # the rows are compared with the cuts where they lie
    assert "hashpartitioning" not in plan and "Window" not in plan


def test_model_inputs_read_their_sources_once(spark):
    from tessera.plans.queries import REGISTRY

    for name in ("model_inputs", "model_inputs_cased"):
        plan = _plan(REGISTRY[name](spark, SF001))
        assert "documents.parquet" not in plan and "InMemoryRelation" not in plan and "split(" not in plan
        assert plan.count("Scan parquet") <= 15


def test_title_join_has_no_cartesian_product(spark):
    q = fx.title_queries(spark, SF001).select(F.lower("PaperTitle").alias("qkey"))
    b = fx.bibliography(spark, SF001).select("bib_id", F.lower("title").alias("bkey"))
    plan = _plan(titles.title_candidates(q, b))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_title_pairs_are_not_broadcast(spark):
    """Their size is guessed from the compressed input: gigabytes would pass through the driver."""
    q = fx.title_queries(spark, SF001).select(F.lower("PaperTitle").alias("qkey"))
    bib = fx.bibliography(spark, SF001).withColumn("bkey", F.lower("title"))
    keys = q.distinct()
    recs = bib.groupBy("bkey", "source").agg(F.max(F.struct("rank", "bib_id", "doi")).alias("last"),
                                             F.min(F.struct("rank", "bib_id")).alias("first"))
    for df in (titles.title_candidates(q, bib), titles.deciding_hits(keys, recs, fuzzy=False), titles.deciding_hits(keys, recs)):
        joins = re.findall(r"\) (\w+)\nLeft keys \[1\]: \[(qkey|bkey)#", _plan(df))
        assert {"qkey", "bkey"} == {key for _, key in joins} and {"SortMergeJoin"} == {kind for kind, _ in joins}, joins
