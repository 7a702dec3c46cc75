"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from paperloom.plans import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def _plain(v):
    return round(v, 7) if isinstance(v, float) else str(v) if hasattr(v, "isoformat") else v


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(_plain(v) for v in r) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF_DIR)
    assert len(set(found.columns)) == len(found.columns)
    rows = [tuple(r) for r in found.select(*sorted(found.columns)).collect()]
    if name not in catalog.ORACLES:
        assert rows
        return
    cursor = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    wanted = [tuple(r[i] for i in order) for r in cursor.fetchall()]
    assert sorted(names) == sorted(found.columns)
    plain = lambda data: sorted((tuple(_plain(v) for v in r) for r in data), key=str)
    assert len(rows) == len(wanted)
    for a, b in zip(plain(rows), plain(wanted), strict=True):
        assert a == b


def _same(spark, tmp_path, name, rows):
    """A query against its SQL over documents (doc_id, text) made for it."""
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    found = catalog.QUERIES[name](spark, folder)
    wanted = con.execute(f"SELECT {', '.join(found.columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(wanted)


def test_instance_ids_of_over_a_thousand_copies(spark, tmp_path):
    _same(spark, tmp_path, "g01_instance_ids", [(i, "a") for i in range(1015)] + [(2000, "b")])


def test_sentence_case_of_characters_with_several_capitals(spark, tmp_path):
    odd = [c for c in map(chr, range(0x100, 0x10000)) if not 0xD800 <= ord(c) < 0xE000 and (len(c.upper()) > 1 or len(c.lower()) > 1)]
    _same(spark, tmp_path, "h17_sentence_case", list(enumerate([f"{c}aß {c}" for c in (*odd, "ß", "ẞ", "Σ", "é", "x")] + ["ΑΣ", "ΑΣ. ΒΣ\nΣ", "İİ", "", "Ssa"])))


def test_mojibake_of_all_characters(spark, tmp_path):
    texts = ["ÄAU, ÖL", "ÄÅÂÃ", "Äau Äau", "â Î", "Ġœ – „ß“", "ɐ 中 😀", "CAFÉ »", "plain", "é", ""]
    _same(spark, tmp_path, "h20_mojibake", [(2 * i + k, t) for i, t in enumerate(texts) for k in range(2)])
