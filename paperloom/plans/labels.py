"""Labelled fields over planted lines: checks, votes, resolution, search results, manifests and training pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import dataset as D
from ..operators import labelling as L
from ..operators import merge
from ..operators import results as R
from .bindings import documents, sql_fold, sql_padded, table, with_archive
from .canonical import line_words
from .registry import query


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of twenty lines with their words, and a field for each third line, some of them faulty."""
    rows = line_words(spark, sf_dir).where("pos < 20")
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1
    rows = rows.withColumn("order", order.cast("int")).withColumn("id", F.concat(F.lit("l"), "pos"))
    word = lambda w: F.struct(F.concat(F.col("id"), F.lit("_"), w.ord).alias("id"), F.col("id").alias("line_id"), F.lit(0).alias("page_index"), (F.col("order") * 100 + w.ord).cast("int").alias("order"), w.text.alias("text"), F.lit(True).alias("has_space_after"), w.box.alias("bbox"))
    rows = rows.withColumn("words", F.transform("words", word))
    line = F.struct("id", F.lit(0).alias("page_index"), "order", F.col("line").alias("text"), F.lit(None).cast("string").alias("ocr_text"), F.array("x0", "y0", "x1", "y1").alias("bbox"), F.transform("words", lambda w: w.id).alias("word_ids"))
    turn = F.col("pos") % 9
    label = F.when(turn == 0, "DOC_SUBJECT").when(turn == 3, "SIGNER_ROLE").when((turn == 6) & (F.col("doc_id") % 4 == 0), "NO_LABEL").when(turn == 6, "SIGNER_NAME")
    ids = F.array(F.when((F.col("doc_id") % 5 == 0) & (turn == 3), F.lit("gone")).otherwise(F.col("id")))
    field = F.when(label.isNotNull(), F.struct(F.concat(F.lit("x"), "pos").alias("field_id"), label.alias("label"), F.lit(0).alias("page_index"), ids.alias("line_ids"), F.lit(None).cast("array<string>").alias("word_ids"), F.lit("").alias("text"), F.lit(None).cast("string").alias("normalized_value"), F.lit(0.5).alias("confidence")))
    own = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("l"), "words", field.alias("f")))).alias("x"))
    return own.select("doc_id", F.transform("x", lambda k: k.l).alias("lines"), F.flatten(F.transform("x", lambda k: k.words)).alias("words"), F.filter(F.transform("x", lambda k: k.f), lambda f: f.isNotNull()).alias("fields"), F.lit(None).cast(f"array<{L.RELATION}>").alias("relations"))


_MARKED = "SELECT doc_id, pos, CASE WHEN pos % 9 = 0 THEN 'DOC_SUBJECT' WHEN pos % 9 = 3 THEN 'SIGNER_ROLE' WHEN pos % 9 = 6 AND doc_id % 4 = 0 THEN 'NO_LABEL' WHEN pos % 9 = 6 THEN 'SIGNER_NAME' END AS label, doc_id % 5 = 0 AND pos % 9 = 3 AS gone FROM lines WHERE pos < 20"


@query(with_archive(f"SELECT doc_id, errors, CASE WHEN errors > 0 THEN 0 ELSE fields END AS fields FROM (SELECT doc_id, count(*) FILTER (label = 'NO_LABEL' OR (label IS NOT NULL AND gone)) AS errors, count(label) AS fields FROM ({_MARKED}) GROUP BY doc_id)"))
def k14_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of each document's labels, and the fields that are taken: none where there is any error."""
    return L.validated(labelled_documents(spark, sf_dir)).select("doc_id", F.size("errors").cast("long").alias("errors"), F.size("valid_fields").cast("long").alias("fields"))


@query(with_archive(f"SELECT doc_id, count(*)::BIGINT AS fields, sum(n)::BIGINT AS words FROM (SELECT m.doc_id, m.pos, least(40, len(list_filter(string_split(l.line, ' '), lambda w: w <> ''))) AS n FROM ({_MARKED}) m JOIN lines l ON l.doc_id = m.doc_id AND l.pos = m.pos WHERE m.label IS NOT NULL AND m.label <> 'NO_LABEL' AND NOT m.gone) WHERE n > 0 GROUP BY doc_id"))
def c15_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a document with the words that their lines give."""
    box = lambda f: F.struct(*[f[c].alias(c) for c in ("field_id", "label", "page_index", "line_ids", "word_ids")], F.lit(None).cast("array<double>").alias("bbox"))
    page = F.array(F.struct(F.lit(0).alias("page_index"), F.lit(595.0).alias("width"), F.lit(842.0).alias("height")))
    docs = labelled_documents(spark, sf_dir).select("doc_id", F.transform("fields", box).alias("fields"), "words", "lines", page.alias("pages"))
    found = L.resolved(docs, "fields", "words", "lines", "pages").select("doc_id", F.inline("resolved"))
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("fields"), F.sum(F.size("word_ids")).alias("words"))


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three labellers' fields for each turn: two agree but for white space, the third on even turns only."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.left("text", F.lit(30)).alias("t"), F.explode(F.array(*map(F.lit, ("m1", "m2", "m3")))).alias("model"))
    text = F.when(F.col("model") == "m2", F.concat(F.lit("  "), "t", F.lit("\n"))).when((F.col("model") == "m3") & (F.col("turn") % 2 == 1), F.concat(F.lit("z "), "t")).otherwise(F.col("t"))
    label = F.concat(F.lit("T"), F.lpad(F.col("turn").cast("string"), 4, "0"))
    none = F.lit(None)
    return c.select("conv_id", "model", F.concat(F.lit("f"), "turn").alias("field_id"), label.alias("label"), F.lit(0).alias("page_index"), none.cast("array<string>").alias("word_ids"), none.cast("array<string>").alias("line_ids"), text.alias("text"), none.cast("string").alias("normalized_value"), none.cast("double").alias("confidence"))


@query("SELECT conv_id, 'T' || lpad(turn::VARCHAR, 4, '0') AS label, CASE WHEN turn % 2 = 0 THEN 3 ELSE 2 END::BIGINT AS votes, CASE WHEN turn % 2 = 0 THEN 1.0 ELSE 0.6667 END::DOUBLE AS confidence, CASE WHEN turn % 2 = 0 THEN 'auto_consensus' ELSE 'needs_review' END AS review_status FROM conversations")
def c11_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that two of three labellers agree on."""
    fields = _votes(spark, sf_dir)
    relations = fields.select("conv_id", "model", F.lit("t").alias("type"), F.col("field_id").alias("from_field_id"), F.col("field_id").alias("to_field_id"))
    return L.consensus(fields, relations, key="conv_id")[0].select("conv_id", "label", "votes", "confidence", "review_status")


@query(f"""WITH q AS (SELECT doc_id, {sql_padded('text')} AS t, {sql_padded("'licensed under'")} AS q, source, lang, text FROM documents WHERE length(trim(text)) >= 12),
m AS (SELECT *, ((length(t) - length(replace(t, q, ''))) // length(q))::BIGINT AS matches FROM q)
SELECT doc_id AS chunk_id, matches AS match_count, matches::DOUBLE AS score, source AS dossier_title FROM m WHERE matches > 0""")
def c01_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of scored chunks with their document and dossier; an exact one counts its phrase, and goes without it."""
    d = documents(spark, sf_dir)
    box = F.array(*map(F.lit, (0.0, 0.0, 600.0, 800.0)))
    chunks = d.select(F.col("doc_id").alias("chunk_id"), "doc_id", F.lit(1).alias("page"), "text", box.alias("box"), F.lit("body").alias("chunk_type"))
    docs = d.select("doc_id", "dossier_id", "file_name", F.concat(F.lit("files/"), "file_name").alias("file_path"), "subject")
    dossiers = d.select("dossier_id").distinct().withColumn("title", F.col("dossier_id"))
    scores = d.select(F.col("doc_id").alias("chunk_id"), F.lit(0.5).alias("score")).unionByName(d.select(F.col("doc_id").alias("chunk_id"), F.lit(0.7).alias("score")))
    found = R.results(scores, chunks, docs, dossiers, kind="exact", query="licensed under")
    return found.select("chunk_id", "match_count", "score", "dossier_title")


@query("SELECT lang || '/' || lpad((doc_id % 97)::VARCHAR, 3, '0') || '-' || doc_id || '.pdf' AS relative_pdf_path, substr(sha1(lang || '/' || lpad((doc_id % 97)::VARCHAR, 3, '0') || '-' || doc_id || '.pdf'), 1, 16) AS doc_id, lang AS subdir, 'pending' AS ocr FROM documents")
def a19_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of files below a folder: identity, split, folder, state and the places of what is made of each."""
    d = documents(spark, sf_dir)
    paths = d.select(F.concat("fonds", F.lit("/"), F.lpad((F.col("doc_id") % 97).cast("string"), 3, "0"), F.lit("-"), "doc_id", F.lit(".pdf")).alias("path"))
    return D.manifest(paths, "path", "/in", "/project").select("relative_pdf_path", "doc_id", "subdir", F.col("status.ocr").alias("ocr"))


@query("SELECT doc_id, 'predicted' AS status, 'kie_vi_official_v3' AS schema, CASE WHEN doc_id % 2 = 0 THEN 'rules' ELSE 'unknown' END AS source, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS n FROM documents")
def a25_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical documents with their annotation in place, what is missing filled in, through JSON and back."""
    field = F.array(F.struct(F.lit("DOC_SUBJECT").alias("label"), F.element_at(F.split("text", "\n"), 1).alias("text")))
    rows = table(spark, sf_dir, "documents").withColumn("fields", F.when(F.col("doc_id") % 2 == 0, field)).withColumn("by", F.when(F.col("doc_id") % 2 == 0, "rules"))
    made = D.enriched(rows.select("doc_id", F.to_json(F.struct("doc_id", "lang")).alias("canonical"), F.to_json(F.struct(F.col("by").alias("source"), F.col("fields").alias("field_instances"))).alias("annotation")), "canonical", "annotation")
    part = lambda p: F.get_json_object("enriched", f"$.annotations.{p}")
    return made.select("doc_id", part("status").alias("status"), part("schema").alias("schema"), part("source").alias("source"), F.size(F.from_json(part("field_instances"), "array<string>")).alias("n"))


@query("SELECT 'train:q:' || item_id AS query_id, 'train:d:' || item_id AS doc_id, 'query: ' || trim(split_part(text, '.', 1)) AS query, 'passage: ' || trim(split_part(text, '.', 2)) AS positive FROM benchmark WHERE trim(split_part(text, '.', 1)) <> '' AND trim(split_part(text, '.', 2)) <> ''")
def a27_first_of_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with the first of their contexts; incomplete rows are left out."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.element_at(F.split("text", "[.]"), 1).alias("question"), F.filter(F.slice(F.split("text", "[.]"), 2, 1), lambda c: F.trim(c) != "").alias("context_list"), F.array("item_id").alias("cid"))
    return D.first_contexts(rows, "train").select("query_id", "doc_id", "query", "positive")


@query("WITH r AS (SELECT b.item_id, min(l.doc_id) AS doc_id FROM benchmark b JOIN labels l ON l.doc_id % 10 = b.item_id % 10 AND l.quality = 1 GROUP BY b.item_id) SELECT 'kho:' || r.item_id AS query_id, 'kho:' || r.doc_id AS positive_doc_id, length(d.text)::BIGINT AS n FROM r JOIN documents d ON d.doc_id = r.doc_id WHERE trim(d.text) <> ''")
def c17_first_relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query with the first of its relevant documents, if that is in the corpus."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"))
    corpus = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("passage"))
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", (F.col("doc_id") % 10).alias("d"))
    qrels = queries.select("query_id", (F.col("query_id").cast("long") % 10).alias("d")).join(good, "d").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_set("doc_id")), lambda x: x.cast("string")).alias("doc_ids"))
    return D.archive_pairs(queries, corpus, qrels).select("query_id", "positive_doc_id", (F.length("positive") - 9).cast("long").alias("n"))


@query()
def g20_quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of three groups of sources by quota, filled up from the rest."""
    source = F.when(F.col("doc_id") % 10 == 0, "zalo").when(F.col("doc_id") % 10 < 3, "yuitc").otherwise(F.concat(F.lit("vnmteb:"), "lang"))
    pairs = table(spark, sf_dir, "documents").select(source.alias("source"), F.col("doc_id").cast("string").alias("query_id"))
    return D.quota_sample(pairs, 100).select("query_id", "source")


@query(with_archive(f"SELECT doc_id, 'New ' || subject AS subject, CASE WHEN doc_id % 2 = 0 THEN 'An' ELSE '' END AS signer, {sql_fold("'New ' || subject")} AS folded FROM docs WHERE doc_id % 3 = 0 AND trim(subject) <> ''"))
def k09_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with edited fields, their annotation and metadata chunk made anew, others left as they are."""
    d = documents(spark, sf_dir).where("trim(subject) <> ''").select("doc_id", F.col("subject"), F.lit("old").alias("signer"), F.lit("").alias("doc_type"), F.lit(None).cast("string").alias("annotation"))
    edits = d.where("doc_id % 3 = 0").select("doc_id", F.concat(F.lit("New "), "subject").alias("subject"), F.when(F.col("doc_id") % 2 == 0, "An").otherwise("").alias("signer"))
    state = merge.edited(d, edits, ["subject", "signer"], "doc_id")
    return state.where("edited").select("doc_id", "subject", "signer", T.fold("subject").alias("folded"))
