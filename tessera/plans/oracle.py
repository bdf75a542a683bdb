"""Oracle SQL (DuckDB dialect) for the registered queries.

Each string is self-contained over the driver's views (region, nation, ... conversations):
the fixture tables are re-derived in CTEs, written independently of the Spark code."""

from __future__ import annotations

from ..functions.text import PY_WHITESPACE_CLASS, PY_WHITESPACE_CODEPOINTS

ORACLE: dict[str, str] = {}

# ------------------------------------------------------------------------- fixture CTEs
G_CTE = """
resources AS (
  SELECT 'F' || n_nationkey AS id, n_name AS label, ['ResearchField'] AS classes FROM nation
  UNION ALL SELECT 'F' || (r_regionkey + 100), r_name, ['ResearchField'] FROM region
  UNION ALL SELECT 'R' || o_orderkey, o_orderpriority || ' order ' || o_orderkey, ['Paper'] FROM orders
  UNION ALL SELECT 'Custom_ID', 'custom', ['Paper']
),
g_lines AS (
  SELECT 'C' || l_orderkey || '_' || l_linenumber AS c, l_partkey, p_name, s_nationkey, n_name,
         l_shipdate, l_quantity, l_returnflag
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation ON s_nationkey = n_nationkey
  WHERE l_linenumber <> 7
),
statements AS (
  SELECT 'R' || o_orderkey AS subject_id, 'P30' AS predicate_id,
         'has research field' AS predicate_label, 'F' || n_nationkey AS object_id,
         n_name AS object_label
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  UNION ALL
  SELECT 'R' || l_orderkey, 'P31', 'contribution', 'C' || l_orderkey || '_' || l_linenumber,
         'Contribution ' || l_orderkey || '_' || l_linenumber FROM lineitem
  UNION ALL
  SELECT 'R' || o_orderkey, 'P26', 'doi', 'LP26_R' || o_orderkey, '10.5555/' || o_orderkey
  FROM orders WHERE o_orderkey % 10 <> 0
  UNION ALL
  SELECT 'R' || o_orderkey, 'P26', 'doi', 'LP26_R' || o_orderkey || 'b', '10.5555/' || o_orderkey || 'b'
  FROM orders WHERE o_orderkey % 50 = 1
  UNION ALL SELECT c, 'P32', 'has research problem', 'P' || l_partkey, p_name FROM g_lines
  UNION ALL SELECT c, 'P33', 'has location', 'N' || s_nationkey, n_name FROM g_lines
  UNION ALL SELECT c, 'P34', 'publication year', 'LP34_' || c, CAST(year(l_shipdate) AS VARCHAR) FROM g_lines
  UNION ALL SELECT c, 'P35', 'sample size', 'LP35_' || c,
                   CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ' units' FROM g_lines
  UNION ALL SELECT c, 'P36', 'return flag', 'LP36_' || c, l_returnflag FROM g_lines
),
papers AS (
  SELECT id, label, classes FROM resources WHERE list_contains(classes, 'Paper') AND id <> 'Custom_ID'
),
fields AS (
  SELECT id, label FROM resources WHERE list_contains(classes, 'ResearchField') AND id <> 'Custom_ID'
),
field_edges AS (
  SELECT * FROM statements WHERE predicate_id = 'P30' AND subject_id IN (SELECT id FROM papers)
),
field_papers AS (
  SELECT object_id AS ResearchFieldId, min(object_label) AS ResearchFieldLabel,
         count(*) AS n_papers FROM field_edges GROUP BY object_id
  UNION ALL
  SELECT id, label, CAST(0 AS BIGINT) FROM fields
  WHERE id NOT IN (SELECT object_id FROM field_edges)
),
flat AS (
  SELECT e.object_id AS ResearchFieldId, e.object_label AS ResearchFieldLabel,
         e.subject_id AS PaperId, p.label AS PaperTitle
  FROM field_edges e JOIN papers p ON p.id = e.subject_id
),
paper_contrib AS (
  SELECT DISTINCT subject_id AS PaperId, object_id AS Contribution FROM statements
  WHERE predicate_id = 'P31'
),
contribs AS (
  SELECT f.*, pc.Contribution FROM flat f JOIN paper_contrib pc USING (PaperId)
)
"""


def with_g(select: str) -> str:
    return "WITH " + G_CTE + select


ORACLE["all_resources"] = with_g(
    "SELECT id, label, array_to_string(classes, '|') AS classes FROM resources")
ORACLE["resources_by_class"] = with_g(
    "SELECT id, label, array_to_string(classes, '|') AS classes FROM papers")
ORACLE["statements_by_subject"] = with_g(
    "SELECT * FROM statements WHERE predicate_id = 'P26' AND subject_id IN (SELECT id FROM papers)")
ORACLE["field_to_papers"] = with_g("SELECT * FROM field_papers")
ORACLE["field_papers_flat"] = with_g("SELECT * FROM flat")
ORACLE["field_papers_last_title"] = with_g("""
, records AS (
  SELECT 'R' || l_orderkey AS id, 'Part ' || l_partkey || ' in ' || l_returnflag AS title, n
  FROM (SELECT l_orderkey, l_partkey, l_returnflag, row_number() OVER () AS n FROM lineitem)
)
, last_title AS (SELECT id, arg_max(title, n) AS PaperTitle FROM records GROUP BY id)
SELECT s.object_id AS ResearchFieldId, s.object_label AS ResearchFieldLabel, s.subject_id AS PaperId, PaperTitle
FROM statements s JOIN last_title ON s.subject_id = id WHERE s.predicate_id = 'P30'""")
ORACLE["paper_contributions"] = with_g("SELECT * FROM contribs")
ORACLE["papers_without_contribution"] = with_g(
    "SELECT DISTINCT PaperId FROM flat WHERE PaperId NOT IN "
    "(SELECT subject_id FROM statements WHERE predicate_id = 'P31')")
ORACLE["contribution_statements"] = with_g(
    "SELECT c.*, s.predicate_label AS PredicateLabel, s.object_label AS ObjectLabel "
    "FROM contribs c JOIN statements s ON s.subject_id = c.Contribution")
ORACLE["contributions_without_statement"] = with_g(
    "SELECT DISTINCT Contribution FROM contribs WHERE Contribution NOT IN "
    "(SELECT subject_id FROM statements)")
ORACLE["field_to_contributions"] = with_g("""
SELECT fp.ResearchFieldId, fp.ResearchFieldLabel, coalesce(n.n, 0) AS n_contributions
FROM field_papers fp LEFT JOIN (
  SELECT f.ResearchFieldId, count(DISTINCT pc.Contribution) AS n
  FROM flat f JOIN paper_contrib pc USING (PaperId) GROUP BY f.ResearchFieldId
) n USING (ResearchFieldId)""")
ORACLE["paper_doi"] = with_g("""
SELECT p.id AS PaperId, d.doi, coalesce(d.n_doi, 0) AS n_doi
FROM papers p LEFT JOIN (
  SELECT subject_id, min(object_label) AS doi, count(DISTINCT object_label) AS n_doi
  FROM statements WHERE predicate_id = 'P26' GROUP BY subject_id
) d ON d.subject_id = p.id""")


# ------------------------------------------------------------------ text helpers (DuckDB SQL)

WS = "(" + " || ".join(f"chr({c})" for c in PY_WHITESPACE_CODEPOINTS) + ")"
W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"
TOKEN_RE = W + "+|[^\\p{L}\\p{N}_" + PY_WHITESPACE_CLASS[1:-1] + "]"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def ntok(x: str) -> str:
    return f"CAST(len(string_split({x}, ' ')) AS INTEGER)"


def span_pattern(label: str) -> str:
    """Python \\b(label)\\b with the label literal, re-expressed without look-arounds:
    the boundary class needed on each side depends on the label's first/last character."""
    lit = f"'\\Q' || replace({label}, '\\E', '\\E\\\\E\\Q') || '\\E'"
    pre = (f"CASE WHEN regexp_matches({label}, '^{W}') THEN '((?:.*?{NW})??)' "
           f"ELSE '(.*?{W})' END")
    post = (f"CASE WHEN regexp_matches({label}, '{W}$') THEN '(?:{NW}|$)' "
            f"ELSE '{W}' END")
    return f"('(?is)^' || {pre} || '(?:' || {lit} || ')' || {post})"


def span_start(label: str, text: str) -> str:
    first_word = f"regexp_extract({text}, '(?s)^({NW}*){W}', 1)"
    return (f"CAST(CASE WHEN {label} IS NULL OR {text} IS NULL THEN NULL "
            f"WHEN {label} = '' THEN CASE WHEN regexp_matches({text}, '{W}') "
            f"THEN length({first_word}) END "
            f"WHEN regexp_matches({text}, {span_pattern(label)}) "
            f"THEN length(regexp_extract({text}, {span_pattern(label)}, 1)) END AS INTEGER)")


def word_flag(label: str, text: str) -> str:
    return (f"CASE WHEN {label} IS NULL OR {text} IS NULL THEN NULL "
            f"WHEN {label} = '' THEN regexp_matches({text}, '{W}') "
            f"ELSE regexp_matches({text}, {span_pattern(label)}) END")


def token_at(text: str, pos: str, max_tokens: int | None = None) -> str:
    idx = f"len(regexp_extract_all(substr({text}, 1, {pos} + 1), '{TOKEN_RE}')) - 1"
    cap = f" AND {idx} < {max_tokens}" if max_tokens is not None else ""
    return (f"CASE WHEN {pos} >= 0 AND {pos} < length({text}) AND NOT regexp_matches("
            f"substr({text}, {pos} + 1, 1), '^{PY_WHITESPACE_CLASS}'){cap} THEN {idx} END")


def category(label: str, pred: str) -> str:
    lab = strip(f"coalesce({label}, 'nan')")
    val = f"TRY_CAST({lab} AS DECIMAL(38,0))"
    shape = (f"replace(regexp_replace(regexp_replace({lab}, '^-+', ''), '^([^.]*)[.]', '\\1'), "
             f"',', '')")
    return f"""CASE
  WHEN lower({strip(pred)}) = 'has research problem' THEN 'research problem'
  WHEN regexp_full_match({lab}, '[0-9]+') AND {val} >= 1000 AND {val} < 2100 THEN 'year/date'
  WHEN starts_with({lab}, 'http') THEN 'url'
  WHEN lower({pred}) IN ('country, city, location, continent', 'has location', 'study location',
                         'countries') THEN 'location'
  WHEN regexp_full_match({shape}, '[0-9]+') THEN 'number'
  WHEN regexp_full_match({lab}, '[A-Z]+') THEN 'acronym'
  WHEN len(string_split({lab}, ' ')) < 5 THEN 'unknown'
  ELSE 'sentence' END"""


def prune_keep(label: str) -> str:
    raw = f"coalesce({label}, 'nan')"
    return (f"NOT (length({strip(raw)}) < 3 OR coalesce(regexp_full_match({raw}, '[0-9]+') "
            f"AND TRY_CAST({raw} AS DECIMAL(38,0)) < 999, false))")


T_CTE = f"""
t_docs AS (SELECT doc_id, text, lang || '/' || source AS pred FROM documents),
t_own AS (
  SELECT doc_id * 2 AS ord, doc_id AS PaperId, pred AS PredicateLabel,
         CASE WHEN doc_id % 7 <= 1 THEN words[spot] WHEN doc_id % 7 = 2 THEN translate(words[spot], 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')
              WHEN doc_id % 7 = 3 THEN array_to_string(words[spot:spot + 2], ' ')
              WHEN doc_id % 7 = 4 THEN array_to_string(words[spot:spot + 5], ' ')
              WHEN doc_id % 7 = 5 THEN 'http://' || words[spot]
              ELSE CAST(length(text) AS VARCHAR) END AS ObjectLabel, text AS PaperAbstract
  FROM (SELECT *, doc_id * 7919 % len(words) + 1 AS spot
        FROM (SELECT *, string_split(text, ' ') AS words FROM t_docs))
),
t_rows AS (
  SELECT * FROM t_own
  UNION ALL
  SELECT d.doc_id * 2 + 1, d.doc_id, d.pred, string_split(n.text, ' ')[1], d.text
  FROM t_docs d LEFT JOIN documents n ON n.doc_id = d.doc_id + 1
),
t_final AS (
  SELECT *, true AS ObjectInAbstract, {category('ObjectLabel', 'PredicateLabel')} AS Category
  FROM (
    SELECT *, row_number() OVER (PARTITION BY PaperId, PredicateLabel, ObjectLabel
                                 ORDER BY ord DESC) AS rn
    FROM t_rows WHERE {prune_keep('ObjectLabel')}
  ) WHERE rn = 1 AND contains(lower(PaperAbstract), lower(ObjectLabel))
),
t_qa AS (
  SELECT ord, PaperAbstract, PredicateLabel, ObjectLabel,
         {span_start('ObjectLabel', 'PaperAbstract')} AS StartIndex
  FROM t_rows
),
t_split AS (
  SELECT ord, PaperAbstract, PredicateLabel, ObjectLabel, StartIndex,
         CAST(StartIndex + length(ObjectLabel) AS INTEGER) AS EndIndex,
         CASE WHEN n < 10 OR rn <= round_even(0.74::DOUBLE * n, 0) THEN 'training'
              ELSE 'evaluation' END AS split
  FROM (
    SELECT *, count(*) OVER (PARTITION BY PredicateLabel) AS n,
           row_number() OVER (PARTITION BY PredicateLabel ORDER BY md5('42|' || ord), ord) AS rn
    FROM t_qa WHERE PredicateLabel IS NOT NULL
  )
),
t_inputs_all AS (
  SELECT ord, split, lower({strip('PaperAbstract')}) AS context,
         lower({strip("'what ' || PredicateLabel || ' ?'")}) AS question,
         lower({strip('ObjectLabel')}) AS answer, StartIndex AS answer_start, EndIndex AS answer_end
  FROM t_split WHERE StartIndex IS NOT NULL AND EndIndex IS NOT NULL
),
t_inputs AS (
  SELECT * FROM t_inputs_all WHERE split = 'training'
  UNION ALL
  SELECT * EXCLUDE (r) FROM (
    SELECT *, row_number() OVER (ORDER BY ord) AS r FROM t_inputs_all WHERE split = 'evaluation'
  ) WHERE r <= (SELECT count(*) FROM t_inputs_all WHERE split = 'training')
)
"""


def with_t(select: str) -> str:
    return "WITH " + T_CTE + select


ORACLE["prune_rows"] = with_t(
    f"SELECT ord, PaperId, PredicateLabel, ObjectLabel FROM t_rows WHERE {prune_keep('ObjectLabel')}")
ORACLE["dedupe_keep_last"] = """
SELECT ord, event_id, user_id, event_type, value FROM (
  SELECT event_id AS ord, *, row_number() OVER (PARTITION BY user_id, event_type
                                                ORDER BY event_id DESC) AS rn
  FROM events) WHERE rn = 1"""
ORACLE["dedupe_text_rows"] = with_t("""
SELECT ord, PaperId, PredicateLabel, ObjectLabel FROM (
  SELECT *, row_number() OVER (PARTITION BY PaperId, PredicateLabel, ObjectLabel
                               ORDER BY ord DESC) AS rn FROM t_rows) WHERE rn = 1""")
ORACLE["object_in_abstract"] = with_t(
    "SELECT ord, contains(lower(PaperAbstract), lower(ObjectLabel)) AS ObjectInAbstract FROM t_rows")
ORACLE["keep_contained"] = with_t(
    "SELECT ord, PaperId, PredicateLabel, ObjectLabel FROM t_rows "
    "WHERE contains(lower(PaperAbstract), lower(ObjectLabel))")
ORACLE["object_word_in_abstract"] = with_t(
    f"SELECT ord, {word_flag('ObjectLabel', 'PaperAbstract')} AS ObjectWordInAbstract FROM t_rows")
ORACLE["categorize"] = with_t(
    f"SELECT ord, {category('ObjectLabel', 'PredicateLabel')} AS Category FROM t_rows")
ORACLE["categorize_graph"] = with_g(
    f", cat AS (SELECT predicate_label AS PredicateLabel, object_label AS ObjectLabel FROM statements) "
    f"SELECT PredicateLabel, ObjectLabel, {category('ObjectLabel', 'PredicateLabel')} AS Category FROM cat")
ORACLE["categorize_tagged"] = """
WITH objects AS (
  SELECT p_partkey AS ord, p_brand AS PredicateLabel,
         CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN split_part(p_name, ' ', 1) WHEN 2 THEN split_part(p_name, ' ', 2)
              WHEN 3 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) ELSE lower(p_type) END AS ObjectLabel
  FROM part),
labelled AS (
  SELECT split_part(p_name, ' ', 1) AS w, 'ADJ' AS pos FROM part
  UNION ALL SELECT split_part(p_name, ' ', 2), 'NOUN' FROM part),
facts AS (
  SELECT 9 AS strength, w AS key, pos FROM labelled
  UNION ALL SELECT k, right(w, k), pos FROM labelled, range(0, 4) r(k)),
best AS (
  SELECT strength, key, pos FROM (SELECT strength, key, pos, count(*) AS n FROM facts GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY strength, key ORDER BY n DESC, pos) = 1),
asked AS (
  SELECT DISTINCT unnest([ObjectLabel, split_part(ObjectLabel, ' ', 2), right(ObjectLabel, 1)]) AS token FROM objects),
tags AS (
  SELECT token, arg_max(pos, strength) AS pos FROM asked JOIN best
    ON (strength = 9 AND key = token) OR (strength < 9 AND key = right(token, strength)) GROUP BY token)
SELECT o.*,
  CASE WHEN ObjectLabel NOT LIKE '% %' THEN CASE w.pos WHEN 'ADJ' THEN 'adj' ELSE 'noun' END
       ELSE CASE p.pos WHEN 'ADJ' THEN 'adj phrase' ELSE 'noun phrase' END END AS Category,
  CASE WHEN ObjectLabel NOT LIKE '% %' THEN CASE w.pos WHEN 'ADJ' THEN 'adj' ELSE 'noun' END
       ELSE CASE c.pos WHEN 'ADJ' THEN 'adj phrase' ELSE 'noun phrase' END END AS StrictCategory
FROM objects o JOIN tags w ON w.token = ObjectLabel JOIN tags p ON p.token = split_part(ObjectLabel, ' ', 2)
     JOIN tags c ON c.token = right(ObjectLabel, 1)"""
ORACLE["finalize"] = with_t(
    "SELECT ord, PaperId, PredicateLabel, ObjectLabel, ObjectInAbstract, Category FROM t_final")
ORACLE["answer_span"] = with_t(
    "SELECT ord, StartIndex, CAST(StartIndex + length(ObjectLabel) AS INTEGER) AS EndIndex FROM t_qa")
ORACLE["stratified_split"] = with_t("SELECT ord, PredicateLabel, split FROM t_split")
ORACLE["split_sizes"] = with_t("SELECT split, count(*) AS n FROM t_split GROUP BY split")
ORACLE["question_variants"] = with_t("""
SELECT s.ord, w.question_word, w.question_word || ' ' || s.PredicateLabel || ' ?' AS question, s.split
FROM t_split s CROSS JOIN (VALUES ('what'), ('which'), ('how'), ('')) w(question_word)""")
ORACLE["model_inputs"] = with_t("SELECT * FROM t_inputs")
ORACLE["model_inputs_cased"] = with_t(f"""
, cased AS (
  SELECT ord, split, PaperAbstract AS context,
         upper(left({strip("' ' || PredicateLabel || ' ?'")}, 1)) ||
         lower(substr({strip("' ' || PredicateLabel || ' ?'")}, 2)) AS question,
         {strip('ObjectLabel')} AS answer, StartIndex AS answer_start, EndIndex AS answer_end,
         row_number() OVER (PARTITION BY split ORDER BY ord) AS r
  FROM t_split WHERE StartIndex IS NOT NULL AND EndIndex IS NOT NULL
)
SELECT * EXCLUDE (r) FROM cased WHERE r <= CASE split WHEN 'training' THEN 300 ELSE 40 END""")
ORACLE["token_positions"] = with_t(f"""
SELECT ord, split,
  CAST(coalesce({token_at('context', 'answer_start', 510)}, 1000) AS INTEGER) AS start_position,
  CAST(coalesce({token_at('context', 'answer_end', 510)},
                {token_at('context', 'answer_end - 1', 510)}, 1000) AS INTEGER) AS end_position,
  ({token_at('context', 'answer_start', 510)}) IS NULL OR
  coalesce({token_at('context', 'answer_end', 510)},
           {token_at('context', 'answer_end - 1', 510)}) IS NULL AS truncated
FROM t_inputs""")
ORACLE["dataset_stats"] = with_t(f"""
, agg AS (
  SELECT count(*)::DOUBLE AS m0, count(DISTINCT Category)::DOUBLE AS m1,
         count(DISTINCT PredicateLabel)::DOUBLE AS m2,
         avg({ntok('PredicateLabel')}) AS m3, avg({ntok('ObjectLabel')}) AS m4,
         avg({ntok('PaperAbstract')}) AS m5,
         (count(*) FILTER (WHERE {ntok('PaperAbstract')} > 510))::DOUBLE AS m6
  FROM t_final)
SELECT 'number_of_rows' AS Measurement, m0 AS Value FROM agg
UNION ALL SELECT 'number_of_unique_categories', m1 FROM agg
UNION ALL SELECT 'number_of_unique_predicate_labels', m2 FROM agg
UNION ALL SELECT 'avg_tokens_of_predicate_labels', m3 FROM agg
UNION ALL SELECT 'avg_tokens_of_object_labels', m4 FROM agg
UNION ALL SELECT 'avg_tokens_of_abstracts', m5 FROM agg
UNION ALL SELECT 'number_of_abstracts_over_510_token(not unique)', m6 FROM agg""")
ORACLE["category_share"] = with_t("""
SELECT Category AS category, count(*) / (SELECT count(*) FROM t_final) * 100 AS percentage_of_data
FROM t_final GROUP BY Category""")

ORACLE["category_share_shown"] = with_t("""
SELECT Category AS category,
       round(count(*) / (SELECT count(*) FROM t_final) * 100, 2) AS percentage_of_data
FROM t_final GROUP BY Category""")

E_CTE = f"""
e_raw AS (
  SELECT p_partkey AS ord, p_name || ' ' || p_type AS abstract, 'what ' || p_brand || ' ?' AS question,
         p_name AS answer,
         CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN p_name || '.'
              WHEN 2 THEN 'the ' || p_name || ' item' WHEN 3 THEN '' ELSE upper(p_name) END AS pred_raw
  FROM part
),
e_norm AS (
  SELECT *, lower({strip('answer')}) AS target, lower({strip('pred_raw')}) AS predict_answer FROM e_raw
),
e_clean AS (
  SELECT *, right(predict_answer, 1) IN ('.', ',', ';', ':', '-', ')', '(', '_', '+') AS marked,
         CASE WHEN right(predict_answer, 1) IN ('.', ',', ';', ':', '-', ')', '(', '_', '+')
              THEN {strip('left(predict_answer, length(predict_answer) - 1)')}
              ELSE predict_answer END AS clean
  FROM e_norm
),
e_scored AS (
  SELECT ord, abstract, question, answer, predict_answer, target,
         predict_answer = '' AS no_answer,
         contains(predict_answer, target) AS containment_match,
         clean = target AS exact_match,
         {ntok('target')} AS expected_tokens,
         CAST(CASE WHEN predict_answer <> '' AND marked THEN {ntok('clean')} ELSE 0 END AS INTEGER)
           AS predicted_tokens,
         CAST(CASE WHEN clean = target THEN {ntok('target')} ELSE 0 END AS INTEGER) AS correct_exact_tokens,
         CAST(CASE WHEN contains(predict_answer, target) THEN {ntok('target')} ELSE 0 END AS INTEGER)
           AS correct_containment_tokens
  FROM e_clean
)
"""
ORACLE["score_rows"] = "WITH " + E_CTE + "SELECT * FROM e_scored"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN NULL ELSE {a} / {b} END"


def _prf(correct: str) -> list[str]:
    r, p = _ratio(correct, "expected"), _ratio(correct, "predicted")
    f = f"CASE WHEN ({r}) + ({p}) = 0 THEN NULL ELSE (2.0 * ({r}) * ({p})) / (({r}) + ({p})) END"
    return [f"CASE WHEN {correct} = 0 THEN 0.0 ELSE {x} END" for x in (r, p, f)]


_re, _pe, _fe = _prf("correct_exact")
_rc, _pc, _fc = _prf("correct_containment")
ORACLE["score_metrics"] = "WITH " + E_CTE + f"""
, s AS (
  SELECT count(*) AS n, count(*) FILTER (WHERE exact_match) AS exact,
         count(*) FILTER (WHERE containment_match) AS contained,
         count(*) FILTER (WHERE no_answer) AS empty,
         CAST(sum(expected_tokens) AS BIGINT) AS expected,
         CAST(sum(predicted_tokens) AS BIGINT) AS predicted,
         CAST(sum(correct_exact_tokens) AS BIGINT) AS correct_exact,
         CAST(sum(correct_containment_tokens) AS BIGINT) AS correct_containment
  FROM e_scored)
SELECT {_ratio('exact', 'n')} AS accuracy, {_ratio('contained', 'n')} AS containment,
       {_ratio('empty', 'n')} AS no_answer,
       {_re} AS recall_exact, {_pe} AS precision_exact, {_fe} AS f1_score_exact,
       {_rc} AS recall_containment, {_pc} AS precision_containment, {_fc} AS f1_score_containment
FROM s"""
_shown = lambda x: f"CAST(round_even(CAST({x} AS DECIMAL(38,20)), 3) AS DOUBLE) * 100"
ORACLE["metrics_record"] = (
    "SELECT " + ", ".join(f'{_shown(c)} AS "{c.replace("no_answer", "no answer")}"' for c in (
        "accuracy", "containment", "no_answer", "recall_exact", "precision_exact", "f1_score_exact",
        "recall_containment", "precision_containment", "f1_score_containment"))
    + f" FROM ({ORACLE['score_metrics']})")
ORACLE["score_metrics_fixed"] = ORACLE["score_metrics"].replace("predict_answer <> '' AND marked", "predict_answer <> ''")
ORACLE["best_span"] = """
SELECT vec_id AS ord, CAST(s AS INTEGER) AS span_start, CAST(e AS INTEGER) AS span_end,
       array_to_string(list_slice(toks, s + 1, e + 1), ' ') AS answer
FROM (
  SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS s,
         list_position(list_reverse(embedding), list_max(embedding)) - 1 AS e,
         list_transform(range(len(embedding)), lambda i: 't' || i) AS toks
  FROM embeddings)"""
ORACLE["sanitize_text"] = f"""
SELECT page_id, trim(regexp_replace(regexp_replace(nullif(html, ''), '</?jats:[a-zA-Z0-9_]*>', ' ', 'g'),
                                   '{PY_WHITESPACE_CLASS}+', ' ', 'g'), ' ') AS text
FROM pages"""
ORACLE["flat_map"] = with_g(
    "SELECT label AS item, unnest(string_split(label, ' ')) AS value FROM papers")


# -------------------------------------------------------------------------- titles (P)
def sanitize(x: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(nullif({x}, ''), '</?jats:[a-zA-Z0-9_]*>', ' ', 'g'), "
            f"'{PY_WHITESPACE_CLASS}+', ' ', 'g'), ' ')")


P_CTE = f"""
p_q AS (
  SELECT 'R' || p_partkey AS PaperId,
         CASE WHEN p_partkey % 11 <> 10
              THEN p_name || ' ' || p_brand || ' ' || p_type || ' study ' || p_partkey END AS PaperTitle
  FROM part
),
p_t AS (SELECT p_partkey, p_name || ' ' || p_brand || ' ' || p_type || ' study ' || p_partkey AS t FROM part),
p_bib AS (
  SELECT p_partkey AS bib_id,
         CASE p_partkey % 5 WHEN 0 THEN t WHEN 1 THEN upper(t)
              WHEN 2 THEN substr(t, 1, length(t) // 2) || substr(t, length(t) // 2 + 2)
              WHEN 3 THEN substr(t, 1, length(t) // 2) END AS title,
         '10.7777/' || p_partkey AS doi,
         CASE WHEN p_partkey % 7 = 0 THEN NULL
              WHEN p_partkey % 3 = 0 THEN '<jats:p>' || d.text || '</jats:p>' ELSE d.text END AS abstract,
         CAST(p_partkey % 2 + 1 AS INTEGER) AS source, CAST(p_partkey % 97 AS INTEGER) AS rank
  FROM p_t LEFT JOIN documents d ON d.doc_id = p_partkey // 2
  WHERE p_partkey % 5 <> 4
),
q AS (SELECT DISTINCT lower(PaperTitle) AS qkey FROM p_q WHERE PaperTitle IS NOT NULL AND PaperTitle <> ''),
b AS (SELECT bib_id, lower(title) AS bkey FROM p_bib WHERE title IS NOT NULL AND title <> ''),
doi_1 AS (
  SELECT doi, {sanitize('abstract')} AS a FROM (
    SELECT doi, abstract, row_number() OVER (PARTITION BY doi ORDER BY rank, bib_id) AS rn
    FROM p_bib WHERE source = 1 AND doi IS NOT NULL) WHERE rn = 1
),
doi_2 AS (
  SELECT doi, {sanitize('abstract')} AS a FROM (
    SELECT doi, abstract, row_number() OVER (PARTITION BY doi ORDER BY rank, bib_id) AS rn
    FROM p_bib WHERE source = 2 AND doi IS NOT NULL) WHERE rn = 1
),
exact_hits AS (SELECT q.qkey, p.* FROM q JOIN p_bib p ON q.qkey = lower(p.title)),
s1 AS (
  SELECT qkey, doi AS doi1 FROM (
    SELECT qkey, doi, row_number() OVER (PARTITION BY qkey ORDER BY rank DESC, bib_id DESC) AS rn
    FROM exact_hits WHERE source = 1) WHERE rn = 1
),
s2 AS (
  SELECT qkey, {sanitize('abstract')} AS abstract2 FROM (
    SELECT qkey, abstract, row_number() OVER (PARTITION BY qkey ORDER BY rank, bib_id) AS rn
    FROM exact_hits WHERE source = 2) WHERE rn = 1
),
resolved AS (
  SELECT q.qkey, s1.doi1,
         CASE WHEN doi_1.a IS NOT NULL AND doi_1.a <> '' THEN doi_1.a ELSE s2.abstract2 END AS abstract
  FROM q LEFT JOIN s1 USING (qkey) LEFT JOIN doi_1 ON doi_1.doi = s1.doi1 LEFT JOIN s2 USING (qkey)
)
"""


def with_p(select: str) -> str:
    return "WITH " + P_CTE + select


ORACLE["title_candidates"] = with_p("""
, qc AS (SELECT qkey, list_transform(range(32), lambda i: len(list_filter(string_split(qkey, ''),
                lambda ch: unicode(ch) % 32 = i))) AS ca FROM q),
bc AS (SELECT bib_id, bkey, list_transform(range(32), lambda i: len(list_filter(string_split(bkey, ''),
                lambda ch: unicode(ch) % 32 = i))) AS cb FROM b)
SELECT qkey, bib_id, true AS exact FROM q JOIN b ON qkey = bkey
UNION ALL
SELECT qkey, bib_id, false AS exact FROM qc JOIN bc
  ON qkey <> bkey AND length(qkey) >= 5 AND length(bkey) >= 5
 AND 400 * least(length(qkey), length(bkey)) > 181 * (length(qkey) + length(bkey))
 AND (list_max(ca) > 127 OR list_max(cb) > 127
      OR 400 * list_sum(list_transform(list_zip(ca, cb), lambda p: least(p[1], p[2])))
         > 181 * (length(qkey) + length(bkey)))
 AND levenshtein(qkey, bkey) * 200 < 19 * (length(qkey) + length(bkey))""")
ORACLE["attach_abstract_exact"] = with_p("""
SELECT p.PaperId, p.PaperTitle, r.abstract AS PaperAbstract
FROM p_q p LEFT JOIN resolved r ON r.qkey = lower(p.PaperTitle)""")
# The title score over all pairs of distinct titles, as its definition says it: the longest common
# block (the first of them in one title, then in the other), then the same left and right of it.
# ``runs`` holds the equal stretches of each diagonal, ``walk`` the parts still to compare; k is the
# length of the block that cut a part off.  Accepted pairs have fewer than 19 T / 200 edits; the
# titles are below 200 characters, so no character is junk.
FUZZY_CTE = f"""
, near AS MATERIALIZED (
  SELECT row_number() OVER () AS p, qkey, bkey, length(qkey) AS la, length(bkey) AS lb
  FROM q JOIN (SELECT DISTINCT bkey FROM b) ON qkey <> bkey
   AND 400 * least(length(qkey), length(bkey)) > 181 * (length(qkey) + length(bkey))
   AND 200 * levenshtein(qkey, bkey) < 19 * (length(qkey) + length(bkey))
),
a_chars AS (SELECT p, generate_subscripts(string_split(qkey, ''), 1) AS i, unnest(string_split(qkey, '')) AS ch FROM near),
b_chars AS (SELECT p, generate_subscripts(string_split(bkey, ''), 1) AS j, unnest(string_split(bkey, '')) AS ch FROM near),
cells AS (
  SELECT p, i - j AS d, i, i - row_number() OVER (PARTITION BY p, i - j ORDER BY i) AS stretch
  FROM a_chars JOIN b_chars USING (p, ch)
),
runs AS MATERIALIZED (SELECT p, min(i) - 1 AS i, min(i) - 1 - d AS j, count(*) AS n FROM cells GROUP BY p, d, stretch),
walk AS (
  SELECT p, 0::BIGINT AS alo, la::BIGINT AS ahi, 0::BIGINT AS blo, lb::BIGINT AS bhi, 0::BIGINT AS k FROM near
  UNION ALL
  SELECT p, CASE WHEN side = 0 THEN alo ELSE m.n - m.i END, CASE WHEN side = 0 THEN -m.i ELSE ahi END,
         CASE WHEN side = 0 THEN blo ELSE m.n - m.j END, CASE WHEN side = 0 THEN -m.j ELSE bhi END,
         CASE WHEN side = 0 THEN m.n ELSE 0 END
  FROM (
    SELECT p, alo, ahi, blo, bhi, max({{'n': n, 'i': -i, 'j': -j}}) AS m
    FROM (
      SELECT p, alo, ahi, blo, bhi, i + s AS i, j + s AS j, e - s AS n
      FROM (SELECT w.p, alo, ahi, blo, bhi, i, j, greatest(0, alo - i, blo - j) AS s, least(n, ahi - i, bhi - j) AS e
            FROM walk w JOIN runs r ON w.p = r.p)
      WHERE e > s)
    GROUP BY p, alo, ahi, blo, bhi) CROSS JOIN (VALUES (0), (1)) sides(side)
),
accepted AS (
  SELECT q.qkey, b.bib_id, true AS exact FROM q JOIN b ON qkey = bkey
  UNION ALL
  SELECT near.qkey, b.bib_id, false
  FROM near JOIN (SELECT p, sum(k) AS m FROM walk GROUP BY p) USING (p) JOIN b USING (bkey)
  WHERE round_even(100 * (2.0::DOUBLE * m / (la + lb)), 0) > 90
),
hits AS (SELECT * FROM accepted JOIN p_bib USING (bib_id)),
one AS (
  SELECT qkey, doi AS doi1 FROM (
    SELECT qkey, doi, row_number() OVER (PARTITION BY qkey ORDER BY rank DESC, bib_id DESC) AS rn
    FROM hits WHERE source = 1) WHERE rn = 1
),
two AS (
  SELECT qkey, {sanitize('abstract')} AS abstract2 FROM (
    SELECT qkey, abstract, row_number() OVER (PARTITION BY qkey ORDER BY exact DESC, rank, bib_id) AS rn
    FROM hits WHERE source = 2) WHERE rn = 1
),
matched AS (
  SELECT q.qkey, one.doi1,
         CASE WHEN doi_1.a IS NOT NULL AND doi_1.a <> '' THEN doi_1.a ELSE two.abstract2 END AS abstract
  FROM q LEFT JOIN one USING (qkey) LEFT JOIN doi_1 ON doi_1.doi = one.doi1 LEFT JOIN two USING (qkey)
)
"""
ORACLE["title_match"] = "WITH RECURSIVE " + P_CTE + FUZZY_CTE + "SELECT * FROM matched"
ORACLE["attach_abstract"] = "WITH RECURSIVE " + P_CTE + FUZZY_CTE + """
SELECT p.PaperId, p.PaperTitle, r.abstract AS PaperAbstract
FROM p_q p LEFT JOIN matched r ON r.qkey = lower(p.PaperTitle)"""
ORACLE["failed_lookups"] = with_p("SELECT DISTINCT PaperId AS Id FROM p_q WHERE PaperTitle IS NULL")
ORACLE["abstract_by_doi"] = with_p("""
SELECT d.doi, CASE WHEN doi_1.a IS NOT NULL AND doi_1.a <> '' THEN doi_1.a ELSE doi_2.a END AS abstract
FROM (SELECT DISTINCT '10.7777/' || p_partkey AS doi FROM part) d
LEFT JOIN doi_1 USING (doi) LEFT JOIN doi_2 USING (doi)""")


ORACLE["field_to_papers_docs"] = """
WITH d AS (
  SELECT doc_id, TRY_CAST(regexp_extract(source, '^src([0-9]+)$', 1) AS INTEGER) AS fk FROM documents
),
edges AS (
  SELECT 'F' || n_nationkey AS fid, n_name AS lab FROM d JOIN nation ON fk = n_nationkey
)
SELECT fid AS ResearchFieldId, min(lab) AS ResearchFieldLabel, count(*) AS n_papers
FROM edges GROUP BY fid
UNION ALL
SELECT 'F' || n_nationkey, n_name, CAST(0 AS BIGINT) FROM nation
WHERE 'F' || n_nationkey NOT IN (SELECT fid FROM edges)"""

# -------------------------------------------------------------------- stage files
ORACLE["csv_round_trip"] = """
SELECT doc_id AS PaperId, nullif(text, '') AS PaperAbstract, lang || '|it''s ' || source AS Tags FROM documents"""
ORACLE["csv_missing_values"] = """
SELECT p_partkey AS PaperId, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 'NA ' || p_name
       WHEN 3 THEN NULL ELSE p_name END AS PaperTitle FROM part"""
ORACLE["training_round_trip"] = with_t("""
SELECT s.ord, s.PaperAbstract AS context, w.question_word || ' ' || s.PredicateLabel || ' ?' AS question,
       s.ObjectLabel AS answer, s.StartIndex AS answer_start, s.EndIndex AS answer_end, w.question_word, s.split
FROM t_split s CROSS JOIN (VALUES ('what'), ('which'), ('how'), ('')) w(question_word)""")
ORACLE["eval_round_trip"] = "WITH " + E_CTE + """
SELECT abstract, question, answer, nullif(predict_answer, '') AS predict_answer, exact_match, containment_match
FROM e_scored"""
