"""Registered queries: one per operator group of the inventory, each ``(spark, sf_dir) ->
DataFrame`` over the whole derived fixtures.  List-valued results are rendered as text
(``array_join``) so they compare across engines."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sanitize_abstract
from ..operators import curate, graph, qa, score, split, stats, tagger, titles
from ..operators.flatmap import flat_map
from ..session import checkpoint_dir
from ..sources import fixtures as fx
from ..sources import stage_io
from ..sources.tables import read_table
from ..sources.token_index import with_token_index

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def _classes_text(df: DataFrame) -> DataFrame:
    return df.withColumn("classes", F.array_join("classes", "|"))


# ---------------------------------------------------------------- graph (A, B, C1-C6, D1-D7, G)
@register("all_resources")
def all_resources(spark, sf):
    resources, _ = fx.graph(spark, sf)
    return _classes_text(graph.all_resources(resources))


@register("resources_by_class")
def resources_by_class(spark, sf):
    resources, _ = fx.graph(spark, sf)
    return _classes_text(graph.resources_by_class(resources, fx.CLASS_PAPER))


@register("statements_by_subject")
def statements_by_subject(spark, sf):
    resources, statements = fx.graph(spark, sf)
    papers = graph.resources_by_class(resources, fx.CLASS_PAPER)
    return graph.statements_for(statements, papers, fx.P_DOI)


@register("field_to_papers")
def field_to_papers(spark, sf):
    resources, statements = fx.graph(spark, sf)
    return graph.field_to_papers(resources, statements)


@register("field_to_papers_docs")
def field_to_papers_docs(spark, sf):
    resources, statements = fx.document_graph(spark, sf)
    return graph.field_to_papers(resources, statements)


@register("field_papers_flat")
def field_papers_flat(spark, sf):
    resources, statements = fx.graph(spark, sf)
    return graph.field_paper_rows(resources, statements)


@register("field_papers_last_title")
def field_papers_last_title(spark, sf):
    _, statements = fx.graph(spark, sf)
    return graph.field_paper_rows(fx.paper_records(spark, sf), statements, order_col="ord")


def _contribs(spark, sf):
    resources, statements = fx.graph(spark, sf)
    flat = graph.field_paper_rows(resources, statements)
    return resources, statements, flat


@register("paper_contributions")
def paper_contributions(spark, sf):
    _, statements, flat = _contribs(spark, sf)
    return graph.paper_contributions(flat, statements)


@register("papers_without_contribution")
def papers_without_contribution(spark, sf):
    _, statements, flat = _contribs(spark, sf)
    return graph.papers_without_contribution(flat, statements)


@register("contribution_statements")
def contribution_statements(spark, sf):
    _, statements, flat = _contribs(spark, sf)
    return graph.contribution_statements(graph.paper_contributions(flat, statements), statements)


@register("contributions_without_statement")
def contributions_without_statement(spark, sf):
    _, statements, flat = _contribs(spark, sf)
    return graph.contributions_without_statement(graph.paper_contributions(flat, statements),
                                                 statements)


@register("field_to_contributions")
def field_to_contributions(spark, sf):
    resources, statements, flat = _contribs(spark, sf)
    fields = graph.field_to_papers(resources, statements)
    return graph.field_to_contributions(fields, flat, statements)


@register("paper_doi")
def paper_doi(spark, sf):
    resources, statements = fx.graph(spark, sf)
    return graph.paper_doi(graph.resources_by_class(resources, fx.CLASS_PAPER), statements)


# ------------------------------------------------------------- curation

_ROW_COLS = ["ord", "PaperId", "PredicateLabel", "ObjectLabel"]


@register("prune_rows")
def prune_rows(spark, sf):
    return curate.prune_rows(fx.text_rows(spark, sf)).select(*_ROW_COLS)


@register("dedupe_keep_last")
def dedupe_keep_last(spark, sf):
    return curate.dedupe_keep_last(fx.repeated_keys(spark, sf), ["user_id", "event_type"])


@register("dedupe_text_rows")
def dedupe_text_rows(spark, sf):
    return curate.dedupe_keep_last(fx.text_rows(spark, sf).select(*_ROW_COLS))


@register("object_in_abstract")
def object_in_abstract(spark, sf):
    return curate.flag_object_in_abstract(fx.text_rows(spark, sf)).select("ord", "ObjectInAbstract")


@register("keep_contained")
def keep_contained(spark, sf):
    rows = curate.flag_object_in_abstract(fx.text_rows(spark, sf))
    return curate.keep_contained(rows).select(*_ROW_COLS)


@register("object_word_in_abstract")
def object_word_in_abstract(spark, sf):
    return fx.text_rows(spark, sf).select(
        "ord", curate.object_word_in_abstract("ObjectLabel", "PaperAbstract").alias(
            "ObjectWordInAbstract"))


@register("categorize")
def categorize(spark, sf):
    return curate.categorize(fx.text_rows(spark, sf)).select("ord", "Category")


@register("categorize_graph")
def categorize_graph(spark, sf):
    _, statements = fx.graph(spark, sf)
    rows = statements.select(F.col("predicate_label").alias("PredicateLabel"),
                             F.col("object_label").alias("ObjectLabel"))
    return curate.categorize(rows)


@register("categorize_tagged")
def categorize_tagged(spark, sf):
    model = tagger.train(fx.labelled_tokens(spark, sf))
    rows = fx.part_objects(spark, sf)
    pos = tagger.lexicon(model, curate.pos_tokens(rows, strict_reference=False))
    strict = tagger.lexicon(model, curate.pos_tokens(rows))
    return curate.categorize(curate.categorize(rows, pos, strict_reference=False), strict, out="StrictCategory")


def _final(spark, sf):
    return curate.finalize(fx.text_rows(spark, sf))


@register("finalize")
def finalize(spark, sf):
    return _final(spark, sf).select(*_ROW_COLS, "ObjectInAbstract", "Category")


# ----------------------------------------------------- split
def _split(spark, sf):
    return split.stratified_split(fx.text_rows(spark, sf))


@register("answer_span")
def answer_span(spark, sf):
    return split.qa_rows(fx.text_rows(spark, sf)).select(
        "ord", "StartIndex", "EndIndex")


@register("answer_span_regex")
def answer_span_regex(spark, sf):
    rows = fx.text_rows(spark, sf)
    return split.qa_rows(rows, literal=False).select("ord", "StartIndex", "EndIndex")


@register("stratified_split")
def stratified_split(spark, sf):
    return _split(spark, sf).select("ord", "PredicateLabel", "split")


@register("split_sizes")
def split_sizes(spark, sf):
    return split.split_sizes(_split(spark, sf))


@register("question_variants")
def question_variants(spark, sf):
    return split.question_variants(_split(spark, sf)).select(
        "ord", "question_word", "question", "split")


# ------------------------------------------------------------ model inputs
def _variants(spark, sf):
    rows = split.qa_rows(_split(spark, sf), keep=("ord", "PaperAbstract", "PredicateLabel", "ObjectLabel", "split"))
    return split.question_variants(rows)


def _inputs(spark, sf):
    return qa.model_inputs(_variants(spark, sf), "what", cased=False)


@register("model_inputs")
def model_inputs(spark, sf):
    return _inputs(spark, sf).select("ord", "split", "context", "question",
                                     F.col("answer.answer").alias("answer"),
                                     "answer.answer_start", "answer.answer_end")


@register("model_inputs_cased")
def model_inputs_cased(spark, sf):
    """The cased branch, another question word, and limits that cut."""
    rows = qa.model_inputs(_variants(spark, sf), "", cased=True, train_limit=300, eval_limit=40)
    return rows.select("ord", "split", "context", "question", F.col("answer.answer").alias("answer"),
                       "answer.answer_start", "answer.answer_end")


@register("token_positions")
def token_positions(spark, sf):
    return qa.token_positions(_inputs(spark, sf), max_tokens=510).select(
        "ord", "split", "start_position", "end_position", "truncated")


@register("token_positions_subword")
def token_positions_subword(spark, sf):
    """Positions in the tokens of a public subword vocabulary."""
    return qa.indexed_token_positions(with_token_index(_inputs(spark, sf)), max_tokens=510).select(
        "ord", "split", "start_position", "end_position", "truncated")


@register("best_span")
def best_span(spark, sf):
    span = qa.best_span("start_logits", "end_logits", "tokens")
    return fx.score_arrays(spark, sf).select(
        "ord", span["start"].alias("span_start"), span["end"].alias("span_end"),
        span["text"].alias("answer"))


# ------------------------------------------------------------------ scoring
@register("score_rows")
def score_rows(spark, sf):
    return score.score_rows(fx.predictions(spark, sf))


@register("score_metrics_fixed")
def score_metrics_fixed(spark, sf):
    return score.metrics(score.score_rows(fx.predictions(spark, sf), strict_reference=False))


@register("metrics_record")
def metrics_record(spark, sf):
    return score.rounded_metrics(score.metrics(score.score_rows(fx.predictions(spark, sf))))


@register("score_metrics")
def score_metrics(spark, sf):
    return score.metrics(score.score_rows(fx.predictions(spark, sf)))


# ------------------------------------------------------------------------ stats
@register("dataset_stats")
def dataset_stats(spark, sf):
    return stats.general_stats(_final(spark, sf))


@register("category_share")
def category_share(spark, sf):
    return stats.category_share(_final(spark, sf))


@register("category_share_shown")
def category_share_shown(spark, sf):
    return stats.category_share(_final(spark, sf), decimals=2)


# --------------------------------------------------------------------- text clean-up (H6)
@register("sanitize_text")
def sanitize_text(spark, sf):
    return read_table(spark, sf, "pages").select("page_id", sanitize_abstract("html").alias("text"))


# ---------------------------------------------------------------------------- flat map
def _words(title):
    return None if title is None else title.split(" ")


@register("flat_map")
def flat_map_words(spark, sf):
    resources, _ = fx.graph(spark, sf)
    papers = graph.resources_by_class(resources, fx.CLASS_PAPER)
    return flat_map(papers.select(F.col("label").alias("item")), _words, "item", "string")


# ------------------------------------------------------------ titles


def _title_inputs(spark, sf):
    rows = fx.title_queries(spark, sf)
    bib = fx.bibliography(spark, sf)
    return rows, bib


@register("title_candidates")
def title_candidates(spark, sf):
    rows, bib = _title_inputs(spark, sf)
    return titles.title_candidates(rows.select(F.lower("PaperTitle").alias("qkey")),
                                   bib.select("bib_id", F.lower("title").alias("bkey")))


@register("title_match")
def title_match(spark, sf):
    rows, bib = _title_inputs(spark, sf)
    return titles.title_match(rows.select(F.lower("PaperTitle").alias("qkey")), bib)


@register("attach_abstract")
def attach_abstract(spark, sf):
    rows, bib = _title_inputs(spark, sf)
    return titles.attach_abstracts(rows, bib)


@register("attach_abstract_exact")
def attach_abstract_exact(spark, sf):
    rows, bib = _title_inputs(spark, sf)
    return titles.attach_abstracts(rows, bib, fuzzy=False)


@register("failed_lookups")
def failed_lookups(spark, sf):
    rows, _ = _title_inputs(spark, sf)
    return titles.failed_lookups(rows)


@register("abstract_by_doi")
def abstract_by_doi(spark, sf):
    dois = read_table(spark, sf, "part").select(
        F.concat(F.lit("10.7777/"), F.col("p_partkey")).alias("doi"))
    return titles.abstract_by_doi(dois, fx.bibliography(spark, sf))


# ------------------------------------------------------------------- stage files
def _stage_path(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("csv_round_trip")
def csv_round_trip(spark, sf):
    """Whole texts, line feeds and quotes included, and a list column out to CSV and in again."""
    docs = read_table(spark, sf, "documents")
    rows = docs.select(F.col("doc_id").alias("PaperId"), F.col("text").alias("PaperAbstract"),
                       F.array("lang", F.concat(F.lit("it's "), F.col("source"))).alias("Tags"))
    path = _stage_path(spark, "csv")
    stage_io.export_csv(rows, path)
    return stage_io.import_csv(spark, path, rows.schema).withColumn("Tags", F.array_join("Tags", "|"))


@register("csv_missing_values")
def csv_missing_values(spark, sf):
    """Spellings of a missing value in labels become NULL on import, labels that hold one don't."""
    part = read_table(spark, sf, "part").select("p_partkey", "p_name")
    k = F.col("p_partkey") % 5
    label = (F.when(k == 0, "NA").when(k == 1, "nan").when(k == 2, F.concat(F.lit("NA "), F.col("p_name")))
             .when(k == 3, "").otherwise(F.col("p_name")))
    rows = part.select(F.col("p_partkey").alias("PaperId"), label.alias("PaperTitle"))
    path = _stage_path(spark, "csv")
    stage_io.export_csv(rows, path)
    return stage_io.import_csv(spark, path, rows.schema, coerce_missing=True)


@register("training_round_trip")
def training_round_trip(spark, sf):
    """The training sets of every question word written by word and split, and read again."""
    rows = _variants(spark, sf).select(
        "ord", F.col("PaperAbstract").alias("context"), "question", F.col("ObjectLabel").alias("answer"),
        F.col("StartIndex").alias("answer_start"), F.col("EndIndex").alias("answer_end"), "question_word", "split")
    path = _stage_path(spark, "training")
    stage_io.write_training(rows, path)
    return stage_io.read_training(spark, path).select(*rows.columns)


@register("eval_round_trip")
def eval_round_trip(spark, sf):
    """The per-row evaluation table as a file, and read again; an empty prediction is NULL there."""
    path = _stage_path(spark, "eval")
    stage_io.write_eval(score.score_rows(fx.predictions(spark, sf)), path)
    return stage_io.read_eval(spark, path)
