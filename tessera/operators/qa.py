"""Model-input preparation, answer-span -> token alignment and span choice from scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import token_index_at
from ..functions.text import capitalize, py_strip
from .common import head_by, publish
from .split import EVALUATION, TRAINING

# --- fixed values ---------------------------------------------------------------------------
MISSING_TOKEN = 1000
# ---------------------------------------------------------------------------------------------


def normalize_for_model(df: DataFrame, cased: bool, context: str = "context",
                        question: str = "question", answer: str = "answer") -> DataFrame:
    """H4: answer stripped; uncased models get context and question stripped+lowered and the
    answer lowered; cased models get the question stripped+capitalised.  Offsets are not
    shifted (stripping a context that starts with whitespace moves the text)."""
    out = df.withColumn(answer, py_strip(answer))
    if cased:
        return out.withColumn(question, capitalize(py_strip(question)))
    return (out.withColumn(context, F.lower(py_strip(context)))
            .withColumn(question, F.lower(py_strip(question)))
            .withColumn(answer, F.lower(answer)))


def model_inputs(df: DataFrame, question_word: str, cased: bool, train_limit: int | None = None,
                 eval_limit: int | None = None, strict_reference: bool = True,
                 ord_col: str = "ord") -> DataFrame:
    """get_data: rows of one question word -> (split, context, question, answer struct).

    Input columns: ord, split, question_word, PaperAbstract, question, ObjectLabel,
    StartIndex, EndIndex.  Rows without a span are dropped (B9); ``train_limit`` /
    ``eval_limit`` keep the first rows by ``ord`` (F6; None or 0 = all).  As in the
    original, the default evaluation limit is the training-set size (``strict_reference``);
    ``False`` makes it the evaluation-set size."""
    rows = (df.filter(F.col("question_word") == question_word)
            .select(ord_col, "split", F.col("PaperAbstract").alias("context"), "question",
                    F.col("ObjectLabel").alias("answer"), "StartIndex", "EndIndex"))
    rows = normalize_for_model(rows, cased)
    rows = rows.filter(F.col("StartIndex").isNotNull() & F.col("EndIndex").isNotNull())
    rows = rows.select(ord_col, "split", "context", "question", F.struct(
        F.col("answer").alias("answer"), F.col("StartIndex").cast("int").alias("answer_start"),
        F.col("EndIndex").cast("int").alias("answer_end")).alias("answer"))
    # Spans and questions are computed once: the limits, and whatever follows, read them back.
    rows = publish(rows.filter(F.col("split").isin(TRAINING, EVALUATION)), "model-inputs")
    sizes = {r["split"]: r["n"] for r in rows.groupBy("split").agg(F.count("*").alias("n")).collect()}  # two rows at most
    n_train = sizes.get(TRAINING, 0)
    limits = {TRAINING: train_limit or None, EVALUATION: eval_limit or (n_train if strict_reference else None)}
    cut = {name: n for name, n in limits.items() if n is not None and n < sizes.get(name, 0)}
    if not cut:
        return rows
    whole = rows.filter(~F.col("split").isin(list(cut)))
    for name, n in cut.items():
        whole = whole.unionByName(head_by(rows.filter(F.col("split") == name), n, ord_col))
    return whole


def token_positions(df: DataFrame, context: str = "context", start: Column | None = None,
                    end: Column | None = None, max_tokens: int | None = None,
                    missing: int = MISSING_TOKEN, offsets: DataFrame | None = None,
                    key: str = "ord") -> DataFrame:
    """Token index of the answer start (token containing char ``start``) and end (token
    containing char ``end``, else char ``end - 1``); ``missing`` when none (beyond the text
    or beyond ``max_tokens``), with a ``truncated`` flag.

    ``offsets`` are the tokens of any tokenizer: (``key``, token, start, end), one row per
    token, numbered from 0, with the characters from ``start`` up to ``end`` (excluded) of
    the row's context; of several tokens over a character the first counts.  Without it the
    tokens are those of the regex tokenizer."""
    start = start if start is not None else F.col("answer.answer_start")
    end = end if end is not None else F.col("answer.answer_end")
    if offsets is not None:
        return _offset_positions(df, start, end, max_tokens, missing, offsets, key)
    s = token_index_at(F.col(context), start, max_tokens)
    e = F.coalesce(token_index_at(F.col(context), end, max_tokens),
                   token_index_at(F.col(context), end - 1, max_tokens))
    return (df.withColumn("start_position", F.coalesce(s, F.lit(missing)))
            .withColumn("end_position", F.coalesce(e, F.lit(missing)))
            .withColumn("truncated", s.isNull() | e.isNull()))


def indexed_token_positions(df: DataFrame, start: Column | None = None, end: Column | None = None,
                            max_tokens: int | None = None, missing: int = MISSING_TOKEN,
                            starts: str = "token_starts", ends: str = "token_ends") -> DataFrame:
    """C10 over an index of token offsets held by each row (two arrays, see
    ``token_index.with_token_index``): the same columns as ``token_positions``, by looking up the
    first token that holds the character; nothing is tokenised again and nothing is shuffled."""
    start = start if start is not None else F.col("answer.answer_start")
    end = end if end is not None else F.col("answer.answer_end")

    def at(pos: Column) -> Column:
        holds = F.zip_with(starts, ends, lambda s, e: (s <= pos) & (pos < e))
        token = F.array_position(holds, F.lit(True)) - 1
        inside = token >= 0 if max_tokens is None else (token >= 0) & (token < max_tokens)
        return F.when(inside, token.cast("int"))

    s, e = at(start), F.coalesce(at(end), at(end - 1))
    return (df.withColumn("start_position", F.coalesce(s, F.lit(missing)))
            .withColumn("end_position", F.coalesce(e, F.lit(missing)))
            .withColumn("truncated", s.isNull() | e.isNull()))


def _offset_positions(df: DataFrame, start: Column, end: Column, max_tokens: int | None, missing: int,
                      offsets: DataFrame, key: str) -> DataFrame:
    tokens = offsets.select(F.col(key).alias("_key"), F.col("token").cast("int").alias("_token"),
                            F.col("start").alias("_from"), F.col("end").alias("_to"))
    if max_tokens is not None:
        tokens = tokens.filter(F.col("_token") < max_tokens)
    asked = df.withColumns({"_start": start, "_end": end})

    def over(pos: Column) -> Column:
        return (F.col("_from") <= pos) & (pos < F.col("_to"))

    s, e, before = over(F.col("_start")), over(F.col("_end")), over(F.col("_end") - 1)
    found = (asked.select(F.col(key).alias("_key"), "_start", "_end").distinct()
             .join(tokens, "_key").filter(s | e | before)
             .groupBy("_key", F.col("_start").alias("_s"), F.col("_end").alias("_e"))
             .agg(F.min(F.when(s, F.col("_token"))).alias("_first"),
                  F.coalesce(F.min(F.when(e, F.col("_token"))), F.min(F.when(before, F.col("_token")))).alias("_last")))
    same = ((F.col(key) == F.col("_key")) & F.col("_start").eqNullSafe(F.col("_s"))
            & F.col("_end").eqNullSafe(F.col("_e")))
    return asked.join(found, same, "left").select(
        *df.columns, F.coalesce("_first", F.lit(missing)).alias("start_position"),
        F.coalesce("_last", F.lit(missing)).alias("end_position"),
        (F.col("_first").isNull() | F.col("_last").isNull()).alias("truncated"))


def best_span(start_scores, end_scores, tokens) -> Column:
    """K1: s = first argmax of the start scores, e = of the end scores, chosen independently;
    the answer is tokens[s..e] joined by spaces, empty when e < s."""
    st = F.col(start_scores) if isinstance(start_scores, str) else start_scores
    en = F.col(end_scores) if isinstance(end_scores, str) else end_scores
    tk = F.col(tokens) if isinstance(tokens, str) else tokens
    s = (F.array_position(st, F.array_max(st)) - 1).cast("int")
    e = (F.array_position(en, F.array_max(en)) - 1).cast("int")
    answer = F.array_join(F.slice(tk, s + 1, F.greatest(e - s + 1, F.lit(0))), " ")
    return F.struct(s.alias("start"), e.alias("end"), answer.alias("text"))
