"""The registered queries against their SQL or brute force, and the pipeline stage by stage."""

from __future__ import annotations

import zlib
from collections import Counter

import corpus_pipeline
import duckdb
import pyarrow.parquet as pq
import pytest
from paperloom.llm import decontaminate, quality, queries, simhash
from paperloom.llm.common import stage

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    cursor = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    found = queries.queries()[name](spark, SF_DIR)
    assert sorted(names) == sorted(found.columns)
    assert Counter(tuple(r) for r in found.select(*names).collect()) == Counter(cursor.fetchall())


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


def test_leaks_against_brute_force(spark):
    docs = pq.read_table(f"{SF_DIR}/documents.parquet").to_pylist()
    items = pq.read_table(f"{SF_DIR}/benchmark.parquet").to_pylist()
    shingles = {i["item_id"]: decontaminate.shingles(decontaminate.words(i["text"])) for i in items}
    wanted = set()
    for d in docs:
        have = decontaminate.shingles(decontaminate.words(d["text"]))
        wanted |= {(d["doc_id"], i) for i, s in shingles.items() if len(s & have) >= 0.95 * len(s)}
    found = {(r.doc_id, r.item_id) for r in queries.op1_benchmark_leaks(spark, SF_DIR).collect()}
    assert wanted and wanted <= found and len(found - wanted) <= 1


def test_held_out_quality(spark):
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF_DIR}/labels.parquet").to_pylist()}
    rows = queries.op6_quality_scores(spark, SF_DIR).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert good and bad and sum(a > b for a in good for b in bad) > 0.9 * len(good) * len(bad)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, step in corpus_pipeline.STAGES:
        out = stage(step(spark, docs, SF_DIR), "test")
        kept[name] = out
        if name != "bpe_encoding":
            assert out.columns == columns and out.dtypes == docs.dtypes
            docs = out
    rows = {name: {r.doc_id: r.text for r in out.collect()} for name, out in kept.items() if name != "bpe_encoding"}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    model = quality.trained(spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    assert rows["quality_classifier"] == {i: t for i, t in texts.items() if model.score(quality.features(t)[None])[0] >= quality.CUT}
    assert rows["line_dedup"].keys() == rows["quality_classifier"].keys()
    # Brute force of the near-duplicates: the exact similarity of all pairs of five-word shingle sets.
    sets = {i: frozenset(simhash.shingle_set(t, simhash._Hashes())[1].tolist()) for i, t in rows["line_dedup"].items()}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and (a == b or a and b and 5 * len(a & b) >= 4 * (len(a) + len(b) - len(a & b))):
                x, y = sorted((find(i), find(j)))
                top[y] = x
    assert set(rows["simhash_near_dedup"]) == {find(i) for i in sets}
    leaked = {r.doc_id for r in decontaminate.leaks(kept["simhash_near_dedup"], spark.read.parquet(f"{SF_DIR}/benchmark.parquet")).collect()}
    assert set(rows["decontamination"]) == set(rows["simhash_near_dedup"]) - leaked
    assert {r.doc_id for r in kept["bpe_encoding"].collect()} == set(rows["decontamination"])
    assert corpus_pipeline.run(spark, SF_DIR).count() == len(rows["decontamination"])


def test_stages_take_odd_documents(spark):
    """Nulls in any column, empty and very long texts, repeated rows, and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "w " * 60000, "en", "s", 120000), (4, "a b c", None, "s", 5), (4, "a b c", None, "s", 5), (None, "some other words here", "en", None, 21)]
    docs = spark.createDataFrame(odd, schema)
    for name, step in corpus_pipeline.STAGES:
        for rows in (docs, docs.limit(0)):
            out = step(spark, rows, SF_DIR)
            found = out.collect()
            assert (name == "bpe_encoding" or out.columns == docs.columns) and len(found) <= rows.count()
            if name in ("line_dedup", "decontamination", "bpe_encoding"):
                assert len(found) == rows.count()
