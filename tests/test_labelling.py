"""Checks of labels, votes of labellers, words of fields, worked by hand."""

from __future__ import annotations

from paperloom.operators import labelling as L


def _line(i, order, text, words=(), page=0, bbox=None, ocr=None):
    return {"id": i, "page_index": page, "order": order, "text": text, "ocr_text": ocr, "bbox": bbox or [0.0, 20.0 * order, 100.0, 20.0 * order + 12], "word_ids": list(words)}


def _word(i, line, order, text, page=0, space=True, bbox=None):
    return {"id": i, "line_id": line, "page_index": page, "order": order, "text": text, "has_space_after": space, "bbox": bbox or [10.0 * order, 0.0, 10.0 * order + 8, 10.0]}


def _field(i, label, lines=(), words=(), text="", page=None, value=None, confidence=None, **more):
    return {"field_id": i, "label": label, "line_ids": list(lines), "word_ids": list(words), "text": text, "page_index": page, "normalized_value": value, "confidence": confidence, **more}


def _link(a, b, kind="signed_by", confidence=None):
    return {"relation_id": None, "type": kind, "from_field_id": a, "to_field_id": b, "confidence": confidence}


LINES = [_line("l1", 0, "Số: 12", ["w1", "w2"]), _line("l2", 1, "-QĐ/TU", ["w3"]), _line("l3", 2, "Kính gửi: Sở", ["w4", "w5"]), _line("l4", 3, "CHỦ TỊCH", ["w6"]), _line("l5", 4, "Nguyễn An", ["w7", "w8"]), _line("l6", 0, "trang hai", ["w9"], page=1), _line("l7", 5, "noi nhan: x"), _line("l8", 6, "a @ b")]
WORDS = [
    _word("w1", "l1", 0, "Số:"), _word("w2", "l1", 1, "12"), _word("w3", "l2", 2, "-QĐ/TU"), _word("w4", "l3", 3, "Kính gửi:"), _word("w5", "l3", 4, "Sở"), _word("w6", "l4", 5, "CHỦ TỊCH"), _word("w7", "l5", 6, "Nguyễn"),
    _word("w8", "l5", 7, "An"), _word("w9", "l6", 0, "trang", page=1),
]


def _check(fields, relations=()):
    return L.checked(fields, list(relations), LINES, WORDS)


def test_valid_labels():
    fields = [_field("a", " doc_number_symbol ", ["l2", "l1"]), _field("b", "SIGNER_ROLE", words=["w6"]), _field("c", "SIGNER_NAME", ["l5"], text="Nguyễn  An", confidence=0.5), _field("d", "DOC_TYPE", ["nowhere"])]
    errors, warnings, out, links = _check(fields, [_link("b", "c", confidence=1.0)])
    assert errors == warnings == []
    assert [(f["field_id"], f["label"], f["line_ids"], f["word_ids"], f["text"], f["page_index"]) for f in out] == [
        ("f1", "DOC_NUMBER_SYMBOL", ["l1", "l2"], ["w1", "w2", "w3"], "Số: 12\n-QĐ/TU", 0), ("f2", "SIGNER_ROLE", ["l4"], ["w6"], "CHỦ TỊCH", 0), ("f3", "SIGNER_NAME", ["l5"], ["w7", "w8"], "Nguyễn  An", 0),
    ]
    assert out[0]["normalized_value"] == "Số: 12 -QĐ/TU" and links == [{"relation_id": "r1", "type": "signed_by", "from_field_id": "f2", "to_field_id": "f3", "confidence": 1.0}]


def test_labels_that_are_rejected():
    bad = {
        "unknown label": [_field("a", "X", ["l1"])], "used twice": [_field("a", "DOC_SUBJECT", ["l1"]), _field("a", "DOC_SUBJECT", ["l3"])], "unknown line_ids": [_field("a", "DOC_SUBJECT", ["l99"])], "unknown word_ids": [_field("a", "DOC_SUBJECT", words=["w99"])],
        "neither": [_field("a", "DOC_SUBJECT")], "ambiguous": [_field("a", "SIGNER_NAME", ["l5"], text="An")], "outside the lines": [_field("a", "DOC_SUBJECT", ["l1"], ["w5"])], "several pages": [_field("a", "DOC_SUBJECT", ["l1", "l6"])],
        "instead of": [_field("a", "DOC_SUBJECT", ["l1"], page=1)], "out of range": [_field("a", "DOC_SUBJECT", ["l1"], confidence=1.5)], "neighbours": [_field("a", "DOC_NUMBER_SYMBOL", ["l1", "l4"])], "that is no symbol": [_field("a", "DOC_NUMBER_SYMBOL", ["l5", "l7"])], "is no symbol": [_field("a", "DOC_NUMBER_SYMBOL", ["l7", "l8"])],
    }
    for why, fields in bad.items():
        errors, _, out, _ = _check(fields)
        assert len(errors) == 1 and why in errors[0] and out == [], (why, errors)
    role, name = _field("b", "SIGNER_ROLE", words=["w6"]), _field("c", "SIGNER_NAME", words=["w7"])
    for link in (_link("c", "b"), _link("b", "x"), _link("b", "c", "other"), _link("b", "c", confidence=-1.0)):
        errors, _, out, links = _check([role, name], [link])
        assert len(errors) == 1 and out == links == []


def test_warnings_of_labels():
    _, warnings, out, _ = _check([_field("a", "ADDRESSEE", ["l3"], ["w5"], text="Sở"), _field("b", "DOC_SUBJECT", words=["w5", "w4"])])
    assert len(out) == 2 and [w.split()[0] for w in warnings] == ["anchor", "overlap"]
    assert L.checked(None, None, None, None) == ([], [], [], [])


def test_validated_documents(spark):
    rows = [(1, [_field("a", "DOC_SUBJECT", ["l3"])], [], LINES, WORDS), (2, [_field("a", "NO")], None, None, None)]
    frame = spark.createDataFrame(rows, f"doc_id int, fields array<{L.FIELD}>, relations array<{L.RELATION}>, lines array<{L.LINE}>, words array<{L.WORD}>")
    first, second = L.validated(frame).orderBy("doc_id").collect()
    assert first.valid_fields[0].text == "Kính gửi: Sở" and not first.errors and second.errors and second.valid_fields == []


def test_consensus(spark):
    rows = [
        (1, "m1", "x", "DOC_SUBJECT", 0, ["w1"], [], "Về  việc A", None, 0.5), (1, "m2", "y", "doc_subject", 0, ["w1", "w2"], [], "VE VIEC A", None, 0.5), (1, "m3", "z", "DOC_SUBJECT", 0, [], [], "khác", None, 0.9),
        (1, "m1", "n", "SIGNER_NAME", 1, [], [], "An", None, None), (1, "m2", "n", "SIGNER_NAME", 1, [], [], "Ân", None, None), (1, "m3", "n", "SIGNER_NAME", 1, [], [], "an", None, 0.1), (2, "m1", "a", "SECRECY_MARK", 0, [], [], "mật", None, None),
    ]
    fields = spark.createDataFrame(rows, "doc_id int, model string, field_id string, label string, page_index int, word_ids array<string>, line_ids array<string>, text string, normalized_value string, confidence double")
    relations = spark.createDataFrame([(1, "m1", "t", "x", "n"), (1, "m2", "t", "y", "n"), (1, "m3", "t", "z", "n"), (1, "m3", "t", "z", "gone")], "doc_id int, model string, type string, from_field_id string, to_field_id string")
    out, links, lost = L.consensus(fields, relations)
    found = {(r.doc_id, r.field_id): (r.label, r.text, r.votes, r.confidence, r.review_status, r.supporting) for r in out.collect()}
    assert found[1, "f1"] == ("doc_subject", "VE VIEC A", 2, 0.6667, "needs_review", ["m1", "m2"])
    assert found[1, "f2"] == ("SIGNER_NAME", "an", 3, 1.0, "auto_consensus", ["m1", "m2", "m3"]) and found[2, "f1"][:3] == ("SECRECY_MARK", "mật", 1) and len(found) == 3
    assert {r.normalized_value for r in out.where("doc_id = 2").collect()} == {"MẬT"}
    assert [(r.doc_id, r.relation_id, r.from_field_id, r.to_field_id, r.confidence) for r in links.collect()] == [(1, "r1", "f1", "f2", 0.6667)]
    assert sorted((r.doc_id, r.kind, r.votes) for r in lost.collect()) == [(1, "field", 1), (1, "relation", 1)]


def test_resolved_words(spark):
    field = lambda **f: {"field_id": "f", "label": "DOC_SUBJECT", "page_index": 0, "line_ids": None, "word_ids": None, "bbox": None, **f}
    fields = [field(word_ids=["w1", "gone", "w1"]), field(bbox=[0.0, 0.0, 18.0, 10.0]), field(bbox=[0.0, 0.0, 18.0, 10.0], page_index=9, line_ids=["l3"]), field(label="NO", word_ids=["w1"]), field(), field(word_ids=["w9"], page_index=None), field(bbox=[0.0, 0.0, 900.0, 30.0])]
    schema = f"fields array<struct<field_id:string,label:string,page_index:int,line_ids:array<string>,word_ids:array<string>,bbox:array<double>>>, words array<{L.WORD}>, lines array<{L.LINE}>, pages array<struct<page_index:int,width:double,height:double>>"
    (r,) = L.resolved(spark.createDataFrame([(fields, WORDS, LINES, [(0, 100.0, 400.0)])], schema), "fields", "words", "lines", "pages").collect()
    assert [(x.word_ids, x.source, round(x.coverage, 3), x.page_index) for x in r.resolved] == [
        (["w1"], "word_ids", 0.333, 0), (["w1", "w2"], "bbox_overlap", 1.0, 0), (["w4", "w5"], "line_ids_fallback", 1.0, 9), (["w9"], "word_ids", 1.0, 1), ([f"w{i}" for i in range(1, 9)], "bbox_overlap", 1.0, 0),
    ]
