"""Manifests of files, documents with annotations, and pairs of queries and passages for training."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H
from .batches import per_row

#: Fixed value: what the digests that deal files to splits begin with.
SPLIT_SEED = "hd36-kie"
#: Shares of the sample for each group of sources; the last group takes what is left.
QUOTAS = (("zalo", 0.20), ("yuitc", 0.45), ("vnmteb", None))


def manifest(files: DataFrame, path: str, input_root: str, project_root: str) -> DataFrame:
    """An entry for each file: doc_id, relative_pdf_path, source_pdf_path, split, subdir, status and artifacts.

    A file in the root itself has a blank subdir.  All states are pending, and artifacts name where they will be.
    """
    rel = F.regexp_replace(F.col(path), r"\\", "/")
    folder = F.when(F.contains(rel, F.lit("/")), F.substring_index(rel, "/", 1)).otherwise("")
    stem = F.regexp_replace(rel, r"\.[^./]*$", "")
    place = lambda kind, end: F.concat(F.lit(f"{project_root}/{kind}/"), F.col("stem"), F.lit(end))
    rows = files.select(rel.alias("relative_pdf_path"), folder.alias("subdir"), stem.alias("stem"), H.stable_id(rel).alias("doc_id"), H.seeded_split(rel, SPLIT_SEED).alias("split"))
    artifacts = F.struct(
        place("ocr_pdf", "_ocr.pdf").alias("ocr_pdf"), place("ocr_pdf", "_ocr.pdf.json").alias("canonical_json"), place("corrected", "_ocr.pdf").alias("corrected_ocr_pdf"), place("corrected", "_ocr.pdf.json").alias("corrected_canonical_json"),
        F.concat(F.lit(f"{project_root}/label_input/"), "doc_id", F.lit(".json")).alias("label_input_json"), F.concat(F.lit(f"{project_root}/ground_truth/"), "doc_id", F.lit(".json")).alias("ground_truth_json"),
    )
    status = F.struct(F.lit("pending").alias("ocr"), F.lit("pending").alias("ground_truth"))
    return rows.select("doc_id", "relative_pdf_path", F.concat(F.lit(f"{input_root}/"), "relative_pdf_path").alias("source_pdf_path"), "split", "subdir", status.alias("status"), artifacts.alias("artifacts"))


def with_annotation(canonical: str | None, annotation: str | None) -> str:
    """A JSON document with an annotation as its block, in place of any it has; what the annotation lacks takes its usual value."""
    given = json.loads(annotation or "{}")
    usual = {"schema": "kie_vi_official_v3", "source": "unknown", "status": "predicted", "selected_pages": [], "field_instances": [], "relations": []}
    block = {k: given.get(k, v) if k != "status" else v for k, v in usual.items()}
    if given.get("postprocess"):
        block["postprocess"] = given["postprocess"]
    return json.dumps(json.loads(canonical or "{}") | {"annotations": block}, ensure_ascii=False)


def enriched(docs: DataFrame, canonical: str, annotation: str) -> DataFrame:
    """``docs`` with ``enriched``: the JSON in ``canonical`` with that in ``annotation`` in place."""
    return per_row(docs, lambda c, a: (with_annotation(c, a),), "enriched string", canonical, annotation)


def prefixed(kind: str, text: Column) -> Column:
    """A query or passage with its prefix, once."""
    plain = F.trim(text)
    return F.when(F.startswith(plain, F.lit(f"{kind}:")), plain).otherwise(F.concat(F.lit(f"{kind}: "), plain))


def first_contexts(rows: DataFrame, split: str, limit: int | None = None) -> DataFrame:
    """(source, query_id, doc_id, query, positive) of rows (qid, question, context_list, cid): the first of each list.

    Rows without a question, context or id go; of those that stay the first ``limit`` by qid are taken, if that is given.
    """
    question, context, cid = F.trim("question"), F.get("context_list", F.lit(0)), F.get("cid", F.lit(0))
    whole = rows.where((F.coalesce(question, F.lit("")) != "") & (F.coalesce(context, F.lit("")) != "") & cid.isNotNull())
    whole = whole.orderBy("qid").limit(limit) if limit else whole
    name = lambda mark, c: F.concat(F.lit(f"{split}:{mark}:"), c.cast("string"))
    return whole.select(F.lit("yuitc").alias("source"), name("q", F.col("qid")).alias("query_id"), name("d", cid).alias("doc_id"), prefixed("query", question).alias("query"), prefixed("passage", context).alias("positive"))


def archive_pairs(queries: DataFrame, corpus: DataFrame, qrels: DataFrame) -> DataFrame:
    """(source, query_id, query, positive_doc_id, positive): each query with the first of its relevant documents (query_id, doc_ids).

    Queries without one, or whose first is not in the corpus or blank, go.
    """
    first = qrels.select("query_id", F.get("doc_ids", F.lit(0)).alias("doc_id"))
    both = queries.join(first, "query_id").join(corpus.where(F.trim("passage") != ""), "doc_id")
    mark = lambda c: F.concat(F.lit("kho:"), c)
    return both.select(F.lit("kho").alias("source"), mark("query_id").alias("query_id"), "query", mark("doc_id").alias("positive_doc_id"), F.concat(F.lit("passage: "), "passage").alias("positive"))


def quota_sample(pairs: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """``count`` of ``pairs`` (source, query_id): a quota of each group of sources, what is missing filled from the others.

    The order within a group is that of a seeded hash, so a sample is the same whatever the layout.  A pair of fewer than
    ``count`` comes once; each group's choice is a top k, which sorts no more than its quota in a task.
    """
    turn = F.xxhash64(F.lit(seed), "source", "query_id")
    rows = pairs.withColumn("turn__", turn)
    first = [int(count * share) for _, share in QUOTAS[:-1]]
    chosen = None
    for (group, _), quota in zip(QUOTAS, [*first, count - sum(first)], strict=True):
        own = rows.where((F.col("source") == group) | F.startswith("source", F.lit(f"{group}:"))).orderBy("turn__", "query_id").limit(quota)
        chosen = own if chosen is None else chosen.unionByName(own)
    # The quotas' pairs come first; then all others in their order, as many as are missing.
    rest = rows.orderBy("turn__", "query_id").limit(2 * count).join(F.broadcast(chosen.select("source", "query_id")), ["source", "query_id"], "left_anti")
    both = chosen.withColumn("late__", F.lit(0)).unionByName(rest.withColumn("late__", F.lit(1)).select(*chosen.columns, "late__"))
    return both.orderBy("late__", "turn__", "query_id").limit(count).select(*pairs.columns)
