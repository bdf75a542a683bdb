"""Stage I/O round trips (A4-A6, A8) and the incremental streaming stage."""
import json
import os

from pyspark.sql import functions as F

from tessera.operators import curate, score
from tessera.sources import stage_io as io
from tessera.streaming.incremental import stream_stage


def test_parquet_stage_round_trip(spark, scratch):
    df = spark.createDataFrame([("F1", "x", 2, ["R1", "R2"]), ("F2", "y", 0, [])], io.FIELD_PAPERS_SCHEMA)
    io.write_stage(df, scratch + "/fp")
    back = io.read_stage(spark, scratch + "/fp", io.FIELD_PAPERS_SCHEMA)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_csv_export_import_with_list_literals(spark, scratch):
    df = spark.createDataFrame([("F1", "a, \"quoted\"\nlabel", 2, ["R1", "R2"]), ("F2", "y", 0, [])],
                               io.FIELD_PAPERS_SCHEMA)
    io.export_csv(df, scratch + "/csv")
    text = "".join(open(os.path.join(scratch, "csv", f)).read()
                   for f in os.listdir(scratch + "/csv") if f.endswith(".csv"))
    assert "['R1', 'R2']" in text
    back = io.import_csv(spark, scratch + "/csv", io.FIELD_PAPERS_SCHEMA)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_training_json_partitioned(spark, scratch):
    rows = [(1, "c", "what p ?", "a", 0, 1, "what", "training"),
            (2, "c", " p ?", "a", 0, 1, "", "evaluation")]
    df = spark.createDataFrame(rows, io.TRAINING_SCHEMA)
    io.write_training(df, scratch + "/tr")
    folders = set(os.listdir(scratch + "/tr"))
    assert "question_word=what" in folders and len([f for f in folders if f.startswith("question_word=")]) == 2
    back = io.read_training(spark, scratch + "/tr", "what").collect()
    assert [(r.ord, r.split) for r in back] == [(1, "training")]


def test_training_sets_are_written_compressed_and_unsorted(spark, scratch):
    text = "a long text that stands in every set \u00e9 \n " * 200
    words, key = ["", "what", "which", "how"], "spark.sql.maxConcurrentOutputFileWriters"
    rows = [(i, f"{i} {text}" if i % 9 else None, "q ?", "a", 0, 1, words[i % 4], ["training", "evaluation"][i % 8 // 4])
            for i in range(200)]
    df = spark.createDataFrame(rows, io.TRAINING_SCHEMA).coalesce(2)
    before = spark.conf.get(key)
    io.write_training(df, scratch + "/tr")
    assert spark.conf.get(key) == before
    files = [os.path.join(d, f) for d, _, names in os.walk(scratch + "/tr") for f in names if f.startswith("part-")]
    assert len(files) == 16 and all(f.endswith(".json.gz") for f in files)  # 2 tasks, 4 words, 2 splits
    assert sum(map(os.path.getsize, files)) * 10 < sum(len(r[1] or "") for r in rows)
    assert sorted(map(tuple, io.read_training(spark, scratch + "/tr").collect())) == sorted(rows)


def test_legacy_training_file(spark, scratch):
    doc = {"training_set": [["ctx", "what p ?", "ans", 3, 6]],
           "evaluation_set": [["ctx2", "what q ?", "b", None, None], ["c3", "q", "x", 0, 1]]}
    os.makedirs(scratch + "/legacy")
    with open(scratch + "/legacy/train_and_evaluation_set_what.json", "w") as f:
        json.dump(doc, f)
    rows = sorted(map(tuple, io.read_legacy_training(spark, scratch + "/legacy").collect()))
    assert rows == [("evaluation", "c3", "q", "x", 0, 1), ("evaluation", "ctx2", "what q ?", "b", None, None),
                    ("training", "ctx", "what p ?", "ans", 3, 6)]


def test_eval_and_metrics_sinks(spark, scratch):
    df = spark.createDataFrame([("ab", "q", "x", "x.")], "abstract string, question string, answer string, "
                                                          "predict_answer string")
    scored = score.score_rows(df)
    io.write_eval(scored, scratch + "/eval")
    io.write_metrics(score.metrics(scored), scratch + "/metrics")
    assert spark.read.option("header", True).csv(scratch + "/eval").count() == 1
    assert spark.read.json(scratch + "/metrics").first().accuracy == 1.0


def test_stream_stage_equals_batch(spark, scratch):
    rows = [(i, "p", lab, "text with " + (lab or "")) for i, lab in
            enumerate(["word", "ab", None, "999", "longer label", "12"])]
    df = spark.createDataFrame(rows, "ord long, PredicateLabel string, ObjectLabel string, PaperAbstract string")
    df.limit(3).write.parquet(scratch + "/in/part1")
    df.subtract(df.limit(3)).write.parquet(scratch + "/in/part2")
    schema = df.schema
    q = stream_stage(spark, scratch + "/in/*", schema, curate.prune_rows, scratch + "/out",
                     scratch + "/ckpt")
    q.awaitTermination(120)
    got = sorted(r.ord for r in spark.read.parquet(scratch + "/out").collect())
    assert got == sorted(r.ord for r in curate.prune_rows(df).collect())


def test_graph_snapshot_nested_and_partitioned(spark, scratch):
    from tessera.operators import graph
    from tessera.sources import fixtures as fx
    from tessera.sources import graph_snapshot as gs

    from .conftest import SF001

    resources, statements = fx.graph(spark, SF001)
    nested = statements.select(F.struct(F.col("subject_id").alias("id")).alias("subject"),
                               F.struct(F.col("predicate_id").alias("id"),
                                        F.col("predicate_label").alias("label")).alias("predicate"),
                               F.struct(F.col("object_id").alias("id"),
                                        F.col("object_label").alias("label")).alias("object"))
    nested.write.json(scratch + "/nested")
    flat = gs.read_statements(spark, scratch + "/nested", fmt="json", nested=True)
    assert sorted(map(tuple, flat.collect())) == sorted(map(tuple, statements.collect()))
    gs.write_statements(flat, scratch + "/part")
    assert "predicate_id=P30" in os.listdir(scratch + "/part")
    st = gs.read_statements(spark, scratch + "/part")
    resources.write.parquet(scratch + "/res")
    res = gs.read_resources(spark, scratch + "/res")
    a = sorted(map(tuple, graph.field_to_papers(res, st).collect()))
    b = sorted(map(tuple, graph.field_to_papers(resources, statements).collect()))
    assert a == b
    ids = [r.id for r in graph.all_resources(res, sort=True).collect()]
    assert ids == sorted(ids)


def test_csv_missing_value_coercion_is_opt_in(spark, scratch):
    schema = "ResearchFieldId string, ResearchFieldLabel string, PaperId string, PaperTitle string"
    df = spark.createDataFrame([("F1", "NA", "R1", "nan"), ("F2", "x", "R2", "t")], schema)
    io.export_csv(df, scratch + "/na")
    plain = sorted(map(tuple, io.import_csv(spark, scratch + "/na", schema).collect()))
    assert plain[0] == ("F1", "NA", "R1", "nan")
    coerced = sorted(map(tuple, io.import_csv(spark, scratch + "/na", schema, coerce_missing=True).collect()))
    assert coerced[0] == ("F1", None, "R1", None)


def test_stream_metrics_equals_batch(spark, scratch):
    from tessera.sources.fixtures import predictions
    from tessera.streaming.incremental import stream_metrics

    from .conftest import SF001

    preds = predictions(spark, SF001)
    preds.filter("ord < 100").write.parquet(scratch + "/p/a")
    preds.filter("ord >= 100").write.parquet(scratch + "/p/b")
    q = stream_metrics(spark, scratch + "/p/*", preds.schema, scratch + "/m", scratch + "/mc")
    q.awaitTermination(180)
    got = spark.read.json(scratch + "/m").first().asDict()
    want = score.metrics(score.score_rows(preds)).first().asDict()
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_training_sets_of_all_question_words(spark, scratch):
    rows = [(i, "c", "q", "a", 0, 1, w, s) for i, (w, s) in enumerate(
        (w, s) for w in ("what", "which", "how", "") for s in ("training", "evaluation"))]
    df = spark.createDataFrame(rows, io.TRAINING_SCHEMA)
    io.write_training(df, scratch + "/words")
    back = io.read_training(spark, scratch + "/words").select(*df.columns)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    for w in ("what", "which", "how", ""):
        assert {r.question_word for r in io.read_training(spark, scratch + "/words", w).collect()} == {w}
        assert io.read_training(spark, scratch + "/words", w).count() == 2


AWKWARD = ["a, \"quoted\"\nlabel", "\n\n\n", "", None, "x" * 400 + "\n" + "\"y\"" * 9, "\r\nmid\r\n", "plain", "\"",
           "back\\slash \\\" quote", "[\"a\", 1]", "], \"training_set\": [[", "üñî\n漢字 😀", "a\\", "tab\tand ]"]


def _small_ranges(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))


def test_csv_file_read_by_many_tasks(spark, scratch):
    """One file with quotes and line feeds, cut at any byte: the rows of the one-task reader."""
    from tessera.sources.records import csv_quotes, read_records

    rows = [(i, AWKWARD[i % len(AWKWARD)], AWKWARD[(i * 5 + i // 14) % len(AWKWARD)]) for i in range(84)]
    schema = "id long, a string, b string"
    df = spark.createDataFrame(rows, schema).coalesce(1).sortWithinPartitions("id")
    io.export_csv(df, scratch + "/one")
    whole = (spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"')
             .csv(scratch + "/one"))
    want = sorted(map(tuple, whole.collect()))
    assert len(want) == 84
    try:
        for size in (211, 1 << 27):
            _small_ranges(spark, size)
            back = io.import_csv(spark, scratch + "/one", schema)
            assert sorted(map(tuple, back.collect())) == want, size
        _small_ranges(spark, 211)
        records = read_records(spark, scratch + "/one", "\n", csv_quotes)
        assert records.select("start").distinct().count() > 20
        order = [r.text.split(",")[0] for r in records.orderBy("start", "no").collect()]
        assert order == ["id", *map(str, range(84))]
    finally:
        _small_ranges(spark, 1 << 27)


def test_csv_odd_files(spark, scratch):
    """Empty files, a header alone, carriage returns, blank lines, no line feed at the end, and a
    quote that never closes."""
    os.makedirs(scratch + "/odd")
    texts = {"a": "", "b": "x,y\n", "c": "x,y\r\n1,\"p\nq\"\r\n\r\n2,r", "d": "x,y\n3,\"open\n4,z\n"}
    for name, text in texts.items():
        with open(f"{scratch}/odd/{name}.csv", "w", newline="") as f:
            f.write(text)
    try:
        for size in (7, 1 << 27):
            _small_ranges(spark, size)
            got = {r.x: r.y for r in io.import_csv(spark, scratch + "/odd", "x int, y string").collect()}
            assert set(got) == {1, 2, 3} and got[1] == "p\nq" and got[2] == "r" and got[3].startswith("open\n4,z")
    finally:
        _small_ranges(spark, 1 << 27)


def test_legacy_object_read_by_many_tasks(spark, scratch):
    from tessera.sources.records import json_quotes, read_records

    def row(i):
        return [AWKWARD[i % len(AWKWARD)], f"what {i} ?", AWKWARD[(i * 3) % len(AWKWARD)], i if i % 4 else None, i + 1.0]

    sets = {"training_set": [row(i) for i in range(30)], "other": [["n", "q", "a", 0, 1]],
            "evaluation_set": [row(i) for i in range(30, 40)]}
    os.makedirs(scratch + "/legacy")
    for name, doc, kw in (("line", sets, {}), ("tall", sets, {"indent": 1, "ensure_ascii": False}),
                          ("turned", {k: sets[k] for k in reversed(sets)}, {"separators": (",", ":")}),
                          ("none", {"training_set": [], "evaluation_set": []}, {}), ("half", {"evaluation_set": [row(1)]}, {})):
        with open(f"{scratch}/legacy/{name}.json", "w") as f:
            json.dump(doc, f, **kw)
    once = [(s, r[0], r[1], r[2], r[3], int(r[4])) for s, k in (("training", "training_set"), ("evaluation", "evaluation_set"))
            for r in sets[k]]
    r = row(1)
    want = sorted(once * 3 + [("evaluation", r[0], r[1], r[2], r[3], int(r[4]))], key=str)
    try:
        for size in (499, 1 << 27):
            _small_ranges(spark, size)
            got = sorted(map(tuple, io.read_legacy_training(spark, scratch + "/legacy").collect()), key=str)
            assert got == want, size
        _small_ranges(spark, 499)
        records = read_records(spark, scratch + "/legacy/line.json", "]", json_quotes)
        assert records.select("start").distinct().count() > 5
    finally:
        _small_ranges(spark, 1 << 27)
