import pytest
"""Model inputs, token alignment and span choice."""
from pyspark.sql import functions as F

from tessera.operators import qa


def test_alignment_cases(spark):
    ctx = "The big dog. Runs fast"
    rows = [(ctx, 4, 7),    # "big": end 7 is a space -> falls back to end-1 -> token 1
            (ctx, 8, 11),   # "dog": end 11 is '.' -> the '.' token (3) is returned
            (ctx, 13, 17),  # "Runs"
            (ctx, 18, 22),  # "fast": end beyond the text -> end-1
            (ctx, 30, 35),  # beyond the text -> 1000
            ("a " * 600, 1100, 1101)]  # token 550 > max_tokens -> 1000
    df = spark.createDataFrame(rows, "context string, s int, e int")
    out = qa.token_positions(df, start=F.col("s"), end=F.col("e"), max_tokens=510).collect()
    got = [(r.start_position, r.end_position, r.truncated) for r in out]
    assert got == [(1, 1, False), (2, 3, False), (4, 4, False), (5, 5, False),
                   (1000, 1000, True), (1000, 1000, True)]


def test_best_span(spark):
    df = spark.createDataFrame([([0.1, 0.9, 0.2, 0.9], [0.0, 0.1, 0.5, 0.2], ["a", "b", "c", "d"]),
                                ([0.0, 0.1, 0.9], [0.9, 0.1, 0.0], ["x", "y", "z"])],
                               "s array<float>, e array<float>, t array<string>")
    got = [tuple(r[0]) for r in df.select(qa.best_span("s", "e", "t")).collect()]
    assert got == [(1, 2, "b c"), (2, 0, "")]


def _variant_rows(spark):
    rows = [(1, "training", "what", "  Ctx ONE  ", "what P ?", "  Ans ", 2, 5),
            (2, "training", "what", "ctx two", "what P ?", "x", None, None),
            (3, "evaluation", "what", "ctx three", "what P ?", "y", 0, 1),
            (4, "evaluation", "what", "ctx four", "what P ?", "z", 0, 1),
            (5, "training", "how", "other", "how P ?", "w", 0, 1)]
    return spark.createDataFrame(rows, "ord long, split string, question_word string, PaperAbstract string, "
                                       "question string, ObjectLabel string, StartIndex int, EndIndex int")


def test_model_inputs_uncased_and_limits(spark):
    out = qa.model_inputs(_variant_rows(spark), "what", cased=False)
    rows = sorted(out.collect())
    # null span dropped; eval limited to the training size (1 row) by default
    assert [r.ord for r in rows] == [1, 3]
    r = rows[0]
    assert (r.context, r.question, r.answer.answer) == ("ctx one", "what p ?", "ans")
    fixed = qa.model_inputs(_variant_rows(spark), "what", cased=False, strict_reference=False)
    assert sorted(r.ord for r in fixed.collect()) == [1, 3, 4]
    limited = qa.model_inputs(_variant_rows(spark), "what", cased=False, eval_limit=2)
    assert sorted(r.ord for r in limited.collect()) == [1, 3, 4]


def test_model_inputs_cased(spark):
    out = qa.model_inputs(_variant_rows(spark), "what", cased=True, strict_reference=False)
    r = sorted(out.collect())[0]
    assert (r.context, r.question, r.answer.answer) == ("  Ctx ONE  ", "What p ?", "Ans")


@pytest.mark.parametrize("n", [0, 1, 2, 1234, 4999, 5000, 6000])
def test_head_by(spark, n):
    from tessera.operators.common import head_by

    values = [(i * 7919) % 100003 - 50000 for i in range(4990)] + [2**62 + i for i in range(5)] + [-2**62 - i for i in range(5)]
    df = spark.createDataFrame([(v,) for v in values], "ord long").repartition(5)
    assert sorted(r.ord for r in head_by(df, n).collect()) == sorted(values)[:n]


def test_token_positions_by_offsets(spark):
    # "unbelievable story": un ##believ ##able story; (0, 0) is a special token over nothing
    df = spark.createDataFrame([(1, "unbelievable story", 2, 12), (1, "unbelievable story", 13, 18),
                                (1, "unbelievable story", 4, None), (2, "a row without tokens", 0, 1),
                                (None, "no key", 0, 2)], "ord long, context string, s int, e int")
    tokens = [(1, 0, 0, 0), (1, 1, 0, 2), (1, 2, 2, 8), (1, 3, 8, 12), (1, 4, 13, 18), (None, 0, 0, 9)]
    offsets = spark.createDataFrame(tokens, "ord long, token int, start int, end int")
    at = lambda **k: sorted((r.ord or 0, r.s, r.start_position, r.end_position, r.truncated)
                            for r in qa.token_positions(df, start=F.col("s"), end=F.col("e"), offsets=offsets, **k).collect())
    m = qa.MISSING_TOKEN
    # char 12 is a space: the token of char 11; char 18 is past the end: that of char 17
    assert at() == [(0, 0, m, m, True), (1, 2, 2, 3, False), (1, 4, 2, m, True), (1, 13, 4, 4, False), (2, 0, m, m, True)]
    assert at(max_tokens=3) == [(0, 0, m, m, True), (1, 2, 2, m, True), (1, 4, 2, m, True), (1, 13, m, m, True), (2, 0, m, m, True)]
    out = qa.token_positions(df, start=F.col("s"), end=F.col("e"), offsets=offsets)
    assert out.columns == qa.token_positions(df, start=F.col("s"), end=F.col("e")).columns


def test_positions_in_subword_tokens(spark):
    from tokenizers import Tokenizer

    from tessera.plans.queries import REGISTRY, _inputs
    from tessera.sources.token_index import vocabulary_path, with_token_index

    from .conftest import SF001

    tokenizer = Tokenizer.from_file(vocabulary_path())

    def by_hand(text, start, end, most):
        offsets = tokenizer.encode(text, add_special_tokens=False).offsets

        def at(pos):
            return next((i for i, (a, b) in enumerate(offsets) if a <= pos < b and i < most), None)

        s, e = at(start), at(end)
        e = at(end - 1) if e is None else e
        return (qa.MISSING_TOKEN if s is None else s, qa.MISSING_TOKEN if e is None else e, s is None or e is None)

    inputs = {r.ord: r for r in _inputs(spark, SF001).collect()}
    got = REGISTRY["token_positions_subword"](spark, SF001).collect()
    assert len(got) == len(inputs) > 50
    for r in got:
        row = inputs[r.ord]
        assert (r.start_position, r.end_position, r.truncated) == by_hand(
            row.context, row.answer.answer_start, row.answer.answer_end, 510)
    odd = spark.createDataFrame([(1, None, 0, 1), (2, "", 0, 1), (3, "日本語 naïve 🙂 x", 11, 12), (4, "a b", None, None)],
                                "ord int, context string, s int, e int")
    out = {r.ord: r for r in qa.indexed_token_positions(with_token_index(odd), F.col("s"), F.col("e")).collect()}
    assert out[1].truncated and out[2].truncated and out[4].truncated
    assert (out[3].start_position, out[3].end_position, out[3].truncated) == by_hand("日本語 naïve 🙂 x", 11, 12, 10**6)


def test_token_index_asks_the_library_for_new_words_only():
    import random

    from tessera.sources.token_index import Offsets, vocabulary_path

    rnd = random.Random(4)
    pool = [*"abXYZ'\u2019s!?<|>019\u00e9\u0301\u00df\u0130\u03a3\u00a0\ufb01\u4e2d\U0001f642 \u2003\u0085\x1c\x0b\t\n  .,-",
            "<|endoftext|>", "'re ", "don't", "running ", " \u0301"]
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 30))) for _ in range(2000)]
    for keep in (300, 10**6):
        offsets = Offsets(vocabulary_path(), keep)
        assert offsets.by_word
        for i in range(0, len(texts), 100):
            for t, got in zip(texts[i:], offsets.of(texts[i:i + 100])):
                assert got.tolist() == offsets.direct(t).tolist(), t
        assert len(offsets.words) <= keep
    asked = []
    whole = offsets.direct
    offsets.direct = lambda t: asked.append(t) or whole(t)
    assert [x.tolist() for x in offsets.of(texts)] == [whole(t).tolist() for t in texts]
    offsets.of(["unseen words", "words unseen"])
    assert asked[0] == "" and sorted(asked[1].split()) == ["unseen", "words"] and len(asked) == 2
