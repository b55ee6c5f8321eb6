"""The registered queries on the smallest tables: the SQL's rows where there is SQL, else whole and well-formed results."""

import os

import duckdb
import pytest

from presswork.llm import queries
from presswork.session import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted("|".join(plain(r[c]) for c in columns) for r in df.collect())
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    assert got == sorted("|".join(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in found.fetchall())


COLUMNS = {
    "op3": "doc_id size text_crc32 law shard slot grown_shard", "op4": "doc_id n_bytes n_tokens over_limit", "op5": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op6": "doc_id start n_tokens ids_crc32", "op7": "page_id url text n_chars", "op9": "doc_id held_out score predicted", "op10": "doc_id n_shingles component_id kept", "op13": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
}


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql()) - {"op2_pigeonhole_decontamination"}))
def test_a_row_for_each_row(spark, name):
    of = "pages" if name.startswith("op7_") else "documents"
    df = queries.queries()[name](spark, SF)
    assert df.columns[: len(COLUMNS[name.split("_")[0]].split())] == COLUMNS[name.split("_")[0]].split()
    key = df.columns[0]
    assert sorted(r[0] for r in df.select(key).collect()) == sorted(r[0] for r in table(spark, SF, of).select(key).collect())


def test_equal_texts_lie_in_one_shard(spark):
    df = queries.queries()["op3_histogram_sort_sharding"](spark, "/root/testdata/sf0.01")
    size = sum(r["size"] for r in df.select("size").collect()) / 16
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    parted = df.join(docs, "doc_id").groupBy("text").agg({"size": "sum", "shard": "max"}).join(df.join(docs, "doc_id").groupBy("text").agg({"shard": "min"}), "text").where("`max(shard)` <> `min(shard)`").collect()
    assert all(r["sum(size)"] > 0.02 * size for r in parted)
