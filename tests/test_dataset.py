"""Manifests, annotated documents, training pairs, search results and edited documents, worked by hand."""

from __future__ import annotations

import hashlib
import json

from paperloom.operators import dataset as D
from paperloom.operators import merge
from paperloom.operators import results as R


def test_manifest(spark):
    rows = {r.relative_pdf_path: r for r in D.manifest(spark.createDataFrame([("a\\b.c/x.pdf",), ("y.pdf",)], "path string"), "path", "/in", "/p").collect()}
    x, y = rows["a/b.c/x.pdf"], rows["y.pdf"]
    assert (x.subdir, y.subdir, x.doc_id, x.source_pdf_path) == ("a", "", hashlib.sha1(b"a/b.c/x.pdf").hexdigest()[:16], "/in/a/b.c/x.pdf")
    assert x.artifacts.canonical_json == "/p/ocr_pdf/a/b.c/x_ocr.pdf.json" and y.artifacts.label_input_json == f"/p/label_input/{y.doc_id}.json" and y.status.ocr == "pending"
    ratio = int(hashlib.sha1(b"hd36-kie:y.pdf").hexdigest()[:12], 16) / (16**12 - 1)
    assert y.split == ("train" if ratio < 0.8 else "val" if ratio < 0.9 else "test")


def test_annotated_documents():
    made = json.loads(D.with_annotation('{"n": "5", "m": 5, "annotations": {"old": 1}}', '{"source": "x", "field_instances": [{"label": "é"}], "status": "no", "postprocess": {"a": 1}}'))
    assert made == {"n": "5", "m": 5, "annotations": {"schema": "kie_vi_official_v3", "source": "x", "status": "predicted", "selected_pages": [], "field_instances": [{"label": "é"}], "relations": [], "postprocess": {"a": 1}}}
    assert json.loads(D.with_annotation(None, None))["annotations"]["source"] == "unknown"


def test_pairs(spark):
    rows = spark.createDataFrame([(3, " Hỏi? ", ["c1", "c2"], [7]), (1, "q", ["c"], [8]), (2, "", ["c"], [9]), (4, "q", [], [1]), (5, "q", ["c"], None)], "qid int, question string, context_list array<string>, cid array<int>")
    assert sorted((r.query_id, r.doc_id, r.query, r.positive) for r in D.first_contexts(rows, "test").collect()) == [("test:q:1", "test:d:8", "query: q", "passage: c"), ("test:q:3", "test:d:7", "query: Hỏi?", "passage: c1")]
    assert D.first_contexts(rows, "test", 1).first().query_id == "test:q:1"
    queries = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "query_id string, query string")
    corpus = spark.createDataFrame([("1", "one"), ("2", " ")], "doc_id string, passage string")
    qrels = spark.createDataFrame([("a", ["1", "2"]), ("b", ["2"]), ("c", ["9", "1"])], "query_id string, doc_ids array<string>")
    assert [tuple(r) for r in D.archive_pairs(queries, corpus, qrels).collect()] == [("kho", "kho:a", "x", "kho:1", "passage: one")]


def test_quota_sample(spark):
    rows = [("zalo", f"z{i}") for i in range(50)] + [("yuitc", f"y{i}") for i in range(50)] + [(f"vnmteb:{i % 3}", f"v{i}") for i in range(50)]
    frame = spark.createDataFrame(rows, "source string, query_id string")
    taken = {n: [r.query_id for r in D.quota_sample(frame.repartition(n), 40).collect()] for n in (1, 5)}
    assert sorted(taken[1]) == sorted(taken[5]) and [sum(q[0] == g for q in taken[1]) for g in "zyv"] == [8, 18, 14]
    few = D.quota_sample(frame.where("source <> 'yuitc'"), 40).collect()  # the missing quota is filled from the others
    assert len(few) == len({r.query_id for r in few}) == 40 and D.quota_sample(frame.limit(0), 5).count() == 0


def test_results(spark):
    box = [0.0, 0.0, 100.0, 10.0]
    chunks = spark.createDataFrame([(1, "d1", 1, " quyết định mới, Quyet Dinh ", box, None), (2, "d1", 1, "short", box, "body"), (3, "d2", 1, "không có gì ở đây", box, "body"), (4, "d1", 1, "quyết định trong siêu dữ liệu", box, "metadata"), (5, "gone", 1, "quyết định mồ côi ở đây", box, "body")], "chunk_id int, doc_id string, page int, text string, box array<double>, chunk_type string")
    docs = spark.createDataFrame([("d1", "s1", "f1"), ("d2", "none", "f2")], "doc_id string, dossier_id string, file_path string")
    dossiers = spark.createDataFrame([("s1", "Hồ sơ")], "dossier_id string, title string")
    scores = spark.createDataFrame([(1, 0.2), (1, 0.9), (2, 1.0), (3, 0.5), (4, 0.1), (5, 0.1), (9, 1.0)], "chunk_id int, score double")
    plain = {r.chunk_id: (r.score, r.dossier_title, r.match_count) for r in R.results(scores, chunks, docs, dossiers).collect()}
    assert plain == {1: (0.9, "Hồ sơ", 0), 3: (0.5, None, 0), 4: (0.1, "Hồ sơ", 0)}
    exact = {r.chunk_id: (r.score, r.match_count) for r in R.results(scores, chunks, docs, dossiers, "exact", "quyet dinh", only="body").collect()}
    assert exact == {1: (2.0, 2)}
    words = spark.createDataFrame([("f1", 1, [("quyet", [0.0, 0.0, 9.0, 9.0]), ("dinh", [10.0, 0.0, 19.0, 9.0])])], "file_path string, page int, words array<struct<token:string,box:array<double>>>")
    boxed = R.results(scores, chunks, docs, dossiers, "exact", "quyet dinh", only="body", words=words).first()
    assert (boxed.match_count, boxed.score, boxed.match_boxes) == (1, 1.0, [[0.0, 0.0, 19.0, 9.0]])
    assert {r.chunk_id for r in R.results(scores, chunks, docs, dossiers, "fuzzy", "quyett dinh").collect()} == {1, 4}


def test_edited_documents(spark):
    old = json.dumps({"field_instances": [{"label": "SUBJECT", "text": "old", "page_index": 2, "score": 0.5}, {"label": "OTHER", "text": "o"}]})
    docs = spark.createDataFrame([(1, "old", "s", old), (2, "old", "s", "{broken"), (3, "old", "s", old)], "doc_id int, subject string, signer string, annotation string")
    edits = spark.createDataFrame([(1, "new", None), (2, "new", "An")], "doc_id int, subject string, signer string")
    found = {r.doc_id: r for r in merge.edited(docs, edits, ["subject", "signer"], "doc_id").collect()}
    first = json.loads(found[1].annotation)["field_instances"]
    assert (found[1].subject, found[1].signer) == ("new", "") and [(f["label"], f["text"], f.get("page_index")) for f in first] == [("SUBJECT", "new", 2), ("OTHER", "o", None)]
    assert [(f["label"], f["text"], f["source"]) for f in json.loads(found[2].annotation)["field_instances"]] == [("SUBJECT", "new", "user_edit"), ("SIGNER", "An", "user_edit")]
    assert not found[3].edited and found[3].annotation == old and found[3].signer == "s"
