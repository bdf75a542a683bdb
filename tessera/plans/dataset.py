"""

Each function is one stage of the original flow and returns a lazy DataFrame; ``build``
chains them and, given a folder, publishes every stage as Parquet: later stages read the
files instead of recomputing the lineage, and a restarted build goes on after the last stage
that was finished.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import curate, graph, split, titles
from ..sources import stage_io

VERSION = "1"  # of the stages' rows: finished stages of another version are made anew


def fields_and_papers(resources: DataFrame, statements: DataFrame):
    """Stage 1: papers per research field, and the flat field/paper/title rows."""
    return (graph.field_to_papers(resources, statements),
            graph.field_paper_rows(resources, statements))


def contributions_and_statements(flat: DataFrame, statements: DataFrame) -> DataFrame:
    """Stage 2: field/paper rows -> contributions -> (predicate, object) statement rows."""
    return graph.contribution_statements(graph.paper_contributions(flat, statements), statements)


def with_abstracts(rows: DataFrame, bibliography: DataFrame, fuzzy: bool = True,
                   flat: DataFrame | None = None) -> DataFrame:
    """Stage 3: attach PaperAbstract by title (distinct titles resolved once, from the
    field/paper rows if given: the statement rows are many times as many)."""
    return titles.attach_abstracts(rows, bibliography, fuzzy=fuzzy, titles_in=flat)


def final_dataset(rows: DataFrame, pos: DataFrame | None = None,
                  order_cols=("PaperId", "Contribution", "PredicateLabel", "ObjectLabel")
                  ) -> DataFrame:
    """Stage 4: finalize.  Rows get a deterministic ``ord`` (a hash of their content: the
    graph carries no row order) for the keep-last step."""
    # a NULL hashes as its own value, never like the neighbouring column's content
    ordered = rows.withColumn("ord", F.xxhash64(*[x for c in order_cols for x in (F.col(c).isNull(), F.col(c))]))
    return curate.finalize(ordered, pos)


def spans_and_split(final: DataFrame, seed: int = 42) -> DataFrame:
    """Stage 5: stratified split and answer spans."""
    return split.qa_rows(split.stratified_split(final, seed=seed),
                         keep=("ord", "PaperAbstract", "PredicateLabel", "ObjectLabel", "split"))


def training_rows(final: DataFrame, seed: int = 42) -> DataFrame:
    """Stage 5 with the four question variants of each row."""
    return split.question_variants(spans_and_split(final, seed))


def write_training_sets(variants: DataFrame, path: str) -> DataFrame:
    """Write the training sets; the number of rows per question word and split."""
    stage_io.write_training(
        variants.select("ord", F.col("PaperAbstract").alias("context"), "question",
                        F.col("ObjectLabel").alias("answer"),
                        F.col("StartIndex").cast("int").alias("answer_start"),
                        F.col("EndIndex").cast("int").alias("answer_end"),
                        "question_word", "split"), path)
    return stage_io.read_training(variants.sparkSession, path).groupBy("question_word", "split").agg(F.count("*").alias("n"))


def build(resources: DataFrame, statements: DataFrame, bibliography: DataFrame,
          out: str | None = None, pos: DataFrame | None = None, fuzzy: bool = True,
          order_col: str | None = None, seed: int = 42) -> DataFrame:
    """All stages; with ``out`` every stage is written under it and read back, and the
    training sets land in ``out/training`` partitioned by question word and split.

    A build into the same ``out`` resumes: a stage that an earlier run finished from the same
    inputs (by content) and options is read, not made again.  ``order_col`` of ``resources``
    tells which title of a repeated id is the last."""
    spark = resources.sparkSession
    if out:
        given = [resources, statements, bibliography, *([] if pos is None else [pos])]
        facts = [VERSION, str(pos is not None), str(fuzzy), str(order_col), str(seed), *map(stage_io.content_digest, given)]
        inputs = hashlib.sha256("\n".join(facts).encode()).hexdigest()

    def stage(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        return stage_io.resumable_stage(spark, f"{out}/{name}", inputs, make) if out else make()

    if out:
        stage("field_papers", lambda: graph.field_to_papers(resources, statements))
    flat = stage("field_papers_flat", lambda: graph.field_paper_rows(resources, statements, order_col))
    said = stage("statement_rows", lambda: contributions_and_statements(flat, statements))
    rows = stage("statements_with_abstract", lambda: with_abstracts(said, bibliography, fuzzy, flat))
    final = stage("final_dataset", lambda: final_dataset(rows, pos))
    asked = stage("qa_rows", lambda: spans_and_split(final, seed))
    variants = split.question_variants(asked)
    if out:
        stage("training_sets", lambda: write_training_sets(variants, f"{out}/training"))
    return variants


def score_predictions(predictions: DataFrame, out: str, strict_reference: bool = True) -> DataFrame:
    """Scoring stage: per-row evaluation table (CSV) and the metrics record (JSON)."""
    from ..operators import score

    scored = score.score_rows(predictions, strict_reference=strict_reference)
    metrics = score.rounded_metrics(score.metrics(scored))
    stage_io.write_eval(scored, f"{out}/eval")
    stage_io.write_metrics(metrics, f"{out}/metrics")
    return metrics


def main(argv: list[str] | None = None, spark=None) -> None:
    """Command line (for spark-submit):

    ``build --resources R --statements S --bibliography B --out O [--nested] [--pos P]``
    ``score --predictions P --out O [--fixed]``"""
    import argparse

    from pyspark.sql import SparkSession

    from ..sources import graph_snapshot

    ap = argparse.ArgumentParser(prog="tessera.plans.dataset")
    sub = ap.add_subparsers(dest="cmd", required=True)
    b = sub.add_parser("build")
    b.add_argument("--resources", required=True)
    b.add_argument("--statements", required=True)
    b.add_argument("--bibliography", required=True)
    b.add_argument("--out", required=True)
    b.add_argument("--format", default="parquet")
    b.add_argument("--nested", action="store_true")
    b.add_argument("--pos")
    b.add_argument("--exact-titles", action="store_true")
    s = sub.add_parser("score")
    s.add_argument("--predictions", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--fixed", action="store_true", help="count every non-empty prediction")
    args = ap.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    if args.cmd == "build":
        ordered = args.format == "parquet"
        resources = graph_snapshot.read_resources(spark, args.resources, args.format, ordered)
        statements = graph_snapshot.read_statements(spark, args.statements, args.format,
                                                    nested=args.nested)
        bib = spark.read.parquet(args.bibliography)
        pos = spark.read.parquet(args.pos) if args.pos else None
        build(resources, statements, bib, out=args.out, pos=pos, fuzzy=not args.exact_titles,
              order_col="ord" if ordered else None)
    else:
        preds = spark.read.parquet(args.predictions)
        score_predictions(preds, args.out, strict_reference=not args.fixed)


if __name__ == "__main__":
    main()
