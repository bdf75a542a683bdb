"""Graph operators: resources and statements -> research field / paper / contribution /
statement rows.

The per-subject service calls of the original become set operations: one semi join per
predicate instead of one request per subject, grouped aggregates instead of Python dicts.
Relations stay flat; list-valued columns are only built on request (``with_list``) because
a hot research field would otherwise become one huge row built by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.fixtures import CLASS_FIELD, CLASS_PAPER, P_CONTRIBUTION, P_DOI, P_FIELD, SENTINEL_ID


def _numeric_suffix(c: str = "id") -> F.Column:
    # "R123" -> 123; a malformed id raises under ANSI, as int() did.
    return F.substring(F.col(c), 2, 2147483647).cast("bigint")


def all_resources(resources: DataFrame, sort: bool = False) -> DataFrame:
    """Every resource as (id, label, classes); ``sort`` orders by id."""
    out = resources.select("id", "label", "classes")
    return out.orderBy("id") if sort else out


def resources_by_class(resources: DataFrame, cls: str, exclude=(SENTINEL_ID,),
                       sort: bool = False) -> DataFrame:
    """Resources of one class without the sentinel ids; ``sort`` orders by the
    number after the first character."""
    out = (resources.filter(F.array_contains("classes", cls) & ~F.col("id").isin(*exclude))
           .select("id", "label", "classes"))
    return out.orderBy(_numeric_suffix("id")) if sort else out


def statements_for(statements: DataFrame, subjects: DataFrame, predicate_id: str | None = None,
                   subject_col: str = "id") -> DataFrame:
    """The statements whose subject is in ``subjects``, optionally of one
    predicate (the predicate filter is pushed into the statement scan)."""
    s = statements if predicate_id is None else statements.filter(F.col("predicate_id") == predicate_id)
    keys = subjects.select(F.col(subject_col).alias("subject_id"))
    return s.join(keys, "subject_id", "left_semi")


def _field_edges(resources: DataFrame, statements: DataFrame) -> DataFrame:
    papers = resources_by_class(resources, CLASS_PAPER)
    return statements_for(statements, papers, P_FIELD)


def field_to_papers(resources: DataFrame, statements: DataFrame, with_list: bool = False,
                    sort: bool = False) -> DataFrame:
    """Per research field its label, number of papers (a paper listed twice
    counts twice) and, with ``with_list``, the sorted list of paper ids; fields without
    papers are added with 0 (and an empty list).

    ``with_list`` reproduces the original's list column for export: it builds one array per
    field, so its size is bounded by the largest field.  The at-scale form of the same
    relation is ``field_paper_rows`` (one row per field and paper)."""
    edges = _field_edges(resources, statements)
    fields = resources_by_class(resources, CLASS_FIELD)
    # Fields and edges meet in ONE aggregation (no anti join recomputing the edges): field
    # rows carry no paper, so a field without edges ends with 0 papers and its own label;
    # otherwise the label comes from the edges (the smallest, deterministically).
    if with_list:
        rows = (edges.select(F.col("object_id").alias("fid"), F.col("object_label").alias("lab"),
                             F.col("subject_id").alias("pid"), F.lit(True).alias("is_edge"))
                .unionByName(fields.select(F.col("id").alias("fid"), F.col("label").alias("lab"),
                                           F.lit(None).cast("string").alias("pid"),
                                           F.lit(False).alias("is_edge"))))
        extra = [F.sort_array(F.collect_list("pid")).alias("PaperIds")]
        n = F.count("pid")
    else:
        # Count per (field, label) first: a hash aggregate with map-side combine over all
        # edges; the final aggregate sees one row per field and label.
        rows = (edges.groupBy(F.col("object_id").alias("fid"), F.col("object_label").alias("lab"))
                .agg(F.count("*").alias("n"), F.lit(True).alias("is_edge"))
                .unionByName(fields.select(F.col("id").alias("fid"), F.col("label").alias("lab"),
                                           F.lit(0).cast("bigint").alias("n"),
                                           F.lit(False).alias("is_edge"))))
        extra = []
        n = F.sum("n")
    out = rows.groupBy(F.col("fid").alias("ResearchFieldId")).agg(
        F.coalesce(F.min(F.when(F.col("is_edge"), F.col("lab"))), F.min("lab"))
        .alias("ResearchFieldLabel"),
        n.alias("n_papers"), *extra)
    if sort:
        out = out.orderBy(F.desc("n_papers"), _numeric_suffix("ResearchFieldId"))
    return out


def _titles(resources: DataFrame, order_col: str | None) -> DataFrame:
    """One title per id, also if the id occurs twice: the last by ``order_col``, or (the
    snapshot has no order of its own) the greatest title."""
    last = F.max("label") if order_col is None else F.max_by("label", order_col)
    return resources.groupBy(F.col("id").alias("PaperId")).agg(last.alias("PaperTitle"))


def field_paper_rows(resources: DataFrame, statements: DataFrame, order_col: str | None = None) -> DataFrame:
    """Flat (ResearchFieldId, ResearchFieldLabel, PaperId, PaperTitle), one row per
    field edge of a paper; papers without a title are dropped (see ``papers_without_title``)."""
    edges = statements.filter(F.col("predicate_id") == P_FIELD)
    papers = F.array_contains("classes", CLASS_PAPER) & (F.col("id") != SENTINEL_ID)
    titles = _titles(resources.filter(papers), order_col)
    return (edges.select(F.col("object_id").alias("ResearchFieldId"),
                         F.col("object_label").alias("ResearchFieldLabel"),
                         F.col("subject_id").alias("PaperId"))
            .join(titles, "PaperId")
            .select("ResearchFieldId", "ResearchFieldLabel", "PaperId", "PaperTitle"))


def explode_field_papers(field_papers: DataFrame, resources: DataFrame, order_col: str | None = None) -> DataFrame:
    """G4/C3/A7 on the list form: explode ``PaperIds`` (empty lists vanish) and attach titles."""
    titles = _titles(resources, order_col)
    return (field_papers.select("ResearchFieldId", "ResearchFieldLabel",
                                F.explode("PaperIds").alias("PaperId"))
            .join(titles, "PaperId")
            .select("ResearchFieldId", "ResearchFieldLabel", "PaperId", "PaperTitle"))


def papers_without_title(field_papers_flat_ids: DataFrame, resources: DataFrame) -> DataFrame:
    """Report for C3: mapped paper ids that have no title."""
    return (field_papers_flat_ids.select("PaperId").distinct()
            .join(resources.select(F.col("id").alias("PaperId")), "PaperId", "left_anti"))


def _paper_contribution_pairs(statements: DataFrame) -> DataFrame:
    # The SET of contributions of a paper.
    return (statements.filter(F.col("predicate_id") == P_CONTRIBUTION)
            .select(F.col("subject_id").alias("PaperId"), F.col("object_id").alias("Contribution"))
            .distinct())


def paper_contributions(flat: DataFrame, statements: DataFrame) -> DataFrame:
    """Each field-paper row repeated once per distinct contribution of the
    paper; papers without contributions are dropped."""
    return flat.join(_paper_contribution_pairs(statements), "PaperId").select(
        *flat.columns, "Contribution")


def papers_without_contribution(flat: DataFrame, statements: DataFrame) -> DataFrame:
    """Report for C4: distinct papers of ``flat`` without any contribution."""
    edges = statements.filter(F.col("predicate_id") == P_CONTRIBUTION).select(
        F.col("subject_id").alias("PaperId"))
    return flat.select("PaperId").distinct().join(edges, "PaperId", "left_anti")


def contribution_statements(contribs: DataFrame, statements: DataFrame) -> DataFrame:
    """Each contribution row repeated once per statement of the contribution
    (duplicates kept) with its predicate and object labels."""
    s = statements.select(F.col("subject_id").alias("Contribution"),
                          F.col("predicate_label").alias("PredicateLabel"),
                          F.col("object_label").alias("ObjectLabel"))
    return contribs.join(s, "Contribution").select(*contribs.columns, "PredicateLabel",
                                                   "ObjectLabel")


def contributions_without_statement(contribs: DataFrame, statements: DataFrame) -> DataFrame:
    """Report for C5: distinct contributions without any statement."""
    return (contribs.select("Contribution").distinct()
            .join(statements.select(F.col("subject_id").alias("Contribution")), "Contribution",
                  "left_anti"))


def field_to_contributions(fields: DataFrame, flat: DataFrame, statements: DataFrame,
                           with_list: bool = False, sort: bool = False) -> DataFrame:
    """Per field the number (and, on request, the set) of distinct
    contributions over its papers; fields with none are kept at 0.  As for
    ``field_to_papers``, ``with_list`` is an export form bounded by the largest field."""
    pairs = (flat.select("ResearchFieldId", "PaperId").distinct()
             .join(_paper_contribution_pairs(statements), "PaperId")
             .select("ResearchFieldId", "Contribution").distinct())
    aggs = [F.count("*").alias("n_contributions")]
    if with_list:
        aggs.append(F.sort_array(F.collect_list("Contribution")).alias("Contributions"))
    per_field = pairs.groupBy("ResearchFieldId").agg(*aggs)
    out = (fields.select("ResearchFieldId", "ResearchFieldLabel")
           .join(per_field, "ResearchFieldId", "left")
           .withColumn("n_contributions", F.coalesce("n_contributions", F.lit(0).cast("bigint"))))
    if with_list:
        out = out.withColumn("Contributions", F.coalesce(
            "Contributions", F.array().cast("array<string>")))
    if sort:
        out = out.orderBy(F.desc("n_contributions"), _numeric_suffix("ResearchFieldId"))
    return out


def paper_doi(papers: DataFrame, statements: DataFrame) -> DataFrame:
    """Per paper its DOI (the smallest when several, NULL when none) and the number of
    distinct DOIs."""
    dois = (statements.filter(F.col("predicate_id") == P_DOI)
            .groupBy(F.col("subject_id").alias("PaperId"))
            .agg(F.min("object_label").alias("doi"),
                 F.count_distinct("object_label").alias("n_doi")))
    return (papers.select(F.col("id").alias("PaperId"))
            .join(dois, "PaperId", "left")
            .withColumn("n_doi", F.coalesce("n_doi", F.lit(0).cast("bigint"))))
