"""Derived input tables (FIXTURES.md) built with DataFrame operations over the driver tables.

Every fixture grows with the tables it is derived from; nothing here is a literal dataset
except the single 'Custom_ID' sentinel resource that the class scan must drop.

* ``graph``        G: resources + statements of a scholarly graph, from the TPC-H tables
* ``text_rows``    T: (PaperId, PredicateLabel, ObjectLabel, PaperAbstract) rows, from documents
* ``repeated_keys`` D: events with an explicit order column
* ``title_queries`` / ``bibliography``  P: query titles and a bibliographic table, from part
* ``predictions``  E: gold answers and model predictions, from part
* ``score_arrays`` L: start/end score arrays and tokens, from embeddings
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import space_token
from .tables import read_in_order, read_table

# --- fixed values: graph vocabulary ---------------------------------------------------------
CLASS_PAPER = "Paper"
CLASS_FIELD = "ResearchField"
SENTINEL_ID = "Custom_ID"
P_FIELD, P_CONTRIBUTION, P_DOI = "P30", "P31", "P26"
L_FIELD, L_CONTRIBUTION, L_DOI = "has research field", "contribution", "doi"
ATTRIBUTE_PREDICATES = (
    ("P32", "has research problem"),
    ("P33", "has location"),
    ("P34", "publication year"),
    ("P35", "sample size"),
    ("P36", "return flag"),
)
# ---------------------------------------------------------------------------------------------


def _s(*parts) -> F.Column:
    return F.concat(*[p if isinstance(p, F.Column) else F.lit(p) for p in parts])


def labelled_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(token, pos): the words of the part names, which are an adjective and a noun each."""
    words = F.split("p_name", " ")
    return read_table(spark, sf_dir, "part").select(F.explode(F.array(
        F.struct(F.get(words, 0).alias("token"), F.lit("ADJ").alias("pos")),
        F.struct(F.get(words, 1).alias("token"), F.lit("NOUN").alias("pos")))).alias("t")).select("t.*")


def part_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, PredicateLabel, ObjectLabel) per part: its name, one of its words, its words the other
    way round, or its type in lower case (a word that no part name has)."""
    words, r = F.split("p_name", " "), F.col("p_partkey") % 5
    return read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ord"), F.col("p_brand").alias("PredicateLabel"),
        F.when(r == 0, F.col("p_name")).when(r == 1, F.get(words, 0)).when(r == 2, F.get(words, 1))
        .when(r == 3, _s(F.get(words, 1), " ", F.get(words, 0))).otherwise(F.lower("p_type")).alias("ObjectLabel"))


def paper_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """resources[id, label, classes, ord] with repeated ids: every line of an order is a record
    of its paper, with a title of its own, in the order of the table's files."""
    lines = read_in_order(spark, f"{sf_dir.rstrip('/')}/lineitem.parquet")
    return lines.select(_s("R", F.col("l_orderkey")).alias("id"),
                        _s("Part ", F.col("l_partkey"), " in ", F.col("l_returnflag")).alias("label"),
                        F.array(F.lit(CLASS_PAPER)).alias("classes"), "ord")


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(resources[id, label, classes], statements[subject_id, predicate_id, predicate_label,
    object_id, object_label])."""
    t = lambda name: read_table(spark, sf_dir, name)
    nation = t("nation").select("n_nationkey", "n_name")
    region = t("region").select("r_regionkey", "r_name")
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customer = t("customer").select("c_custkey", "c_nationkey")
    lineitem = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                    "l_quantity", "l_returnflag", "l_shipdate")
    part = t("part").select("p_partkey", "p_name")
    supplier = t("supplier").select("s_suppkey", "s_nationkey")

    field = F.array(F.lit(CLASS_FIELD))
    paper = F.array(F.lit(CLASS_PAPER))
    resources = (
        nation.select(_s("F", F.col("n_nationkey")).alias("id"), F.col("n_name").alias("label"),
                      field.alias("classes"))
        .unionByName(region.select(_s("F", F.col("r_regionkey") + 100).alias("id"),
                                   F.col("r_name").alias("label"), field.alias("classes")))
        .unionByName(orders.select(_s("R", F.col("o_orderkey")).alias("id"),
                                   _s(F.col("o_orderpriority"), " order ",
                                      F.col("o_orderkey")).alias("label"),
                                   paper.alias("classes")))
        .unionByName(spark.range(1).select(F.lit(SENTINEL_ID).alias("id"),
                                           F.lit("custom").alias("label"),
                                           paper.alias("classes")))
    )

    def stmt(subject, pid, plabel, oid, olabel):
        return [subject.alias("subject_id"), F.lit(pid).alias("predicate_id"),
                F.lit(plabel).alias("predicate_label"), oid.alias("object_id"),
                olabel.alias("object_label")]

    order_id = _s("R", F.col("o_orderkey"))
    p30 = (orders.join(customer, orders.o_custkey == customer.c_custkey)
           .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
           .select(*stmt(order_id, P_FIELD, L_FIELD,
                         _s("F", F.col("n_nationkey")), F.col("n_name"))))
    contrib = _s("C", F.col("l_orderkey"), "_", F.col("l_linenumber"))
    p31 = lineitem.select(*stmt(_s("R", F.col("l_orderkey")), P_CONTRIBUTION, L_CONTRIBUTION,
                                contrib, _s("Contribution ", F.col("l_orderkey"), "_",
                                            F.col("l_linenumber"))))
    doi = _s("10.5555/", F.col("o_orderkey"))
    p26 = (orders.filter(F.col("o_orderkey") % 10 != 0)
           .select(*stmt(order_id, P_DOI, L_DOI, _s("LP26_", order_id), doi))
           .unionByName(orders.filter(F.col("o_orderkey") % 50 == 1)
                        .select(*stmt(order_id, P_DOI, L_DOI, _s("LP26_", order_id, "b"),
                                      _s(doi, "b")))))
    # One branch per attribute predicate, each with a literal predicate id: a filter on
    # predicate_id then removes whole branches (and their joins) at planning time.
    lines = lineitem.filter(F.col("l_linenumber") != 7)
    (p32, l32), (p33, l33), (p34, l34), (p35, l35), (p36, l36) = ATTRIBUTE_PREDICATES
    lit_id = lambda pid: _s("L" + pid + "_", contrib)
    attrs = [
        lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(*stmt(contrib, p32, l32, _s("P", F.col("l_partkey")), F.col("p_name"))),
        lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(*stmt(contrib, p33, l33, _s("N", F.col("s_nationkey")), F.col("n_name"))),
        lines.select(*stmt(contrib, p34, l34, lit_id(p34), F.year("l_shipdate").cast("string"))),
        lines.select(*stmt(contrib, p35, l35, lit_id(p35),
                           _s(F.col("l_quantity").cast("int").cast("string"), " units"))),
        lines.select(*stmt(contrib, p36, l36, lit_id(p36), F.col("l_returnflag"))),
    ]
    statements = p30.unionByName(p31).unionByName(p26)
    for a in attrs:
        statements = statements.unionByName(a)
    return resources, statements


def document_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """F: nations are research fields, documents are papers, and a document belongs to the
    nation numbered in its ``source`` (src0, src1, ...); nations without documents stay
    empty."""
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    field_key = F.regexp_extract("source", r"^src([0-9]+)$", 1).try_cast("int")
    resources = (
        nation.select(_s("F", F.col("n_nationkey")).alias("id"), F.col("n_name").alias("label"),
                      F.array(F.lit(CLASS_FIELD)).alias("classes"))
        .unionByName(docs.select(_s("D", F.col("doc_id")).alias("id"),
                                 _s(F.col("lang"), " document ", F.col("doc_id")).alias("label"),
                                 F.array(F.lit(CLASS_PAPER)).alias("classes"))))
    statements = (docs.withColumn("fk", field_key)
                  .join(nation, F.col("fk") == F.col("n_nationkey"))
                  .select(_s("D", F.col("doc_id")).alias("subject_id"),
                          F.lit(P_FIELD).alias("predicate_id"), F.lit(L_FIELD).alias("predicate_label"),
                          _s("F", F.col("n_nationkey")).alias("object_id"),
                          F.col("n_name").alias("object_label")))
    return resources, statements


def _own_label() -> F.Column:
    """A label from anywhere in the text (word number ``doc_id * 7919`` modulo the number of
    space-separated words), in seven shapes by ``doc_id % 7``: 0-1 the word, 2 the word
    with a-z in upper case, 3 and 4 up to three and six words from there, 5 a link, 6 the text's length."""
    words = F.split("text", " ", -1)
    at = (F.pmod(F.col("doc_id") * 7919, F.size(words).cast("bigint")) + 1).cast("int")
    word = F.element_at(words, at)
    k = F.pmod("doc_id", F.lit(7))
    return (F.when(k <= 1, word).when(k == 2, F.translate(word, ascii_lowercase, ascii_uppercase))
            .when(k == 3, F.array_join(F.slice(words, at, 3), " "))
            .when(k == 4, F.array_join(F.slice(words, at, 6), " "))
            .when(k == 5, _s("http://", word))
            .otherwise(F.char_length("text").cast("string")))


def text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T: two rows per document (a label from its own text, see ``_own_label``, and the first
    word of the next document); ``ord`` is unique and gives the row order."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    nxt = docs.select((F.col("doc_id") - 1).alias("doc_id"), space_token(F.col("text"), 0).alias("next_label"))
    both = docs.withColumn("own_label", _own_label()).join(nxt, "doc_id", "left")
    rows = F.explode(F.array(
        F.struct((F.col("doc_id") * 2).alias("ord"), F.col("own_label").alias("ObjectLabel")),
        F.struct((F.col("doc_id") * 2 + 1).alias("ord"), F.col("next_label").alias("ObjectLabel"))))
    return (both.select(F.col("doc_id").alias("PaperId"), _s(F.col("lang"), "/", F.col("source")).alias("PredicateLabel"),
                        F.col("text").alias("PaperAbstract"), rows.alias("r"))
            .select("r.ord", "PaperId", "PredicateLabel", "r.ObjectLabel", "PaperAbstract"))


def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D: events, ``ord = event_id``; keys (user_id, event_type) repeat."""
    return (read_table(spark, sf_dir, "events")
            .select(F.col("event_id").alias("ord"), "event_id", "user_id", "event_type", "value"))


def _part_title() -> F.Column:
    return _s(F.col("p_name"), " ", F.col("p_brand"), " ", F.col("p_type"), " study ",
              F.col("p_partkey"))


def title_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P queries: one paper row per part; every 11th paper has no title."""
    part = read_table(spark, sf_dir, "part")
    return part.select(_s("R", F.col("p_partkey")).alias("PaperId"),
                       F.when(F.col("p_partkey") % 11 != 10, _part_title()).alias("PaperTitle"))


def bibliography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P bibliography: the part title changed by ``p_partkey % 5`` (0 as is, 1 upper case,
    2 one character removed, 3 second half removed, 4 absent), its DOI, an abstract taken
    from document ``p_partkey div 2`` (NULL every 7th, wrapped in markup every 3rd), source
    1 or 2 and a rank."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    t = _part_title()
    half = F.floor(F.char_length(t) / 2).cast("int")
    k = F.col("p_partkey") % 5
    title = (F.when(k == 0, t).when(k == 1, F.upper(t))
             .when(k == 2, F.concat(F.substring(t, F.lit(1), half),
                                    F.substring(t, half + 2, F.lit(2147483647))))
             .when(k == 3, F.substring(t, F.lit(1), half)))
    text = F.col("text")
    abstract = (F.when(F.col("p_partkey") % 7 == 0, F.lit(None).cast("string"))
                .when(F.col("p_partkey") % 3 == 0, _s("<jats:p>", text, "</jats:p>"))
                .otherwise(text))
    return (part.filter(k != 4)
            # two parts per document: the abstracts come from the whole documents table
            .join(docs, F.col("doc_id") == (F.col("p_partkey") / 2).cast("bigint"), "left")
            .select(F.col("p_partkey").alias("bib_id"), title.alias("title"),
                    _s("10.7777/", F.col("p_partkey")).alias("doi"), abstract.alias("abstract"),
                    (F.col("p_partkey") % 2 + 1).cast("int").alias("source"),
                    (F.col("p_partkey") % 97).cast("int").alias("rank")))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E: gold answer = part name; prediction by ``p_partkey % 5``: 0 equal, 1 with a
    trailing '.', 2 'the <name> item', 3 empty, 4 upper case."""
    part = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 5
    name = F.col("p_name")
    pred = (F.when(k == 0, name).when(k == 1, _s(name, "."))
            .when(k == 2, _s("the ", name, " item")).when(k == 3, F.lit(""))
            .otherwise(F.upper(name)))
    return part.select(F.col("p_partkey").alias("ord"),
                       _s(name, " ", F.col("p_type")).alias("abstract"),
                       _s("what ", F.col("p_brand"), " ?").alias("question"),
                       name.alias("answer"), pred.alias("predict_answer"))


def score_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L: start scores = the embedding, end scores = it reversed, tokens t0..t{n-1}."""
    emb = read_table(spark, sf_dir, "embeddings")
    return emb.select(
        F.col("vec_id").alias("ord"), F.col("embedding").alias("start_logits"),
        F.reverse("embedding").alias("end_logits"),
        F.transform(F.sequence(F.lit(0), F.size("embedding") - 1),
                    lambda i: F.concat(F.lit("t"), i.cast("string"))).alias("tokens"))
