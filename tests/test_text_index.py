"""The indexed search against a scan, and how much of the table it reads."""

import random

import pytest
from pyspark.sql import functions as F

from presswork.operators.search import contains_ci
from presswork.sources import text_index

WORDS = ["Alpha", "beta", "ÄRGER", "naïve", "日本語", "x", "gamma delta", "%_", "İstanbul", "end."]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(WORDS, k=5)), rng.choice([None, "", "title " + str(i)])) for i in range(300)] + [(None, "needle", None), (5, None, None), (7, "the needle in the hay", "x"), (7, "the needle in the hay", "x")]
    df = spark.createDataFrame(rows, "id long, body string, title string").repartition(3)
    path = str(tmp_path_factory.mktemp("index") / "i")
    text_index.build(df, path, ("body", "title"), "id", block_rows=8, part_blocks=3)
    return df, path


@pytest.mark.parametrize("q", ["needle", "ALPHA", "ärger", "日本", "日", "x", "", "title 29", "gamma delta", "nowhere", "%_ ", "istanbul", "a b", "ta ä"])
@pytest.mark.parametrize("named", [0, 1000])
def test_same_rows_as_a_scan(spark, stored, q, named):
    df, path = stored
    want = df.where(contains_ci("body", q) | contains_ci("title", q)).collect()
    got = text_index.search(spark, path, q, ("body", "title"), part_blocks=3, named=named).select("id", "body", "title").collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_few_files_are_read(spark, stored):
    _, path = stored
    every = spark.read.parquet(f"{path}/rows").select(F.input_file_name()).distinct().count()
    rows = text_index.search(spark, path, "hay", ("body", "title"), part_blocks=3)
    scans = rows.select(F.input_file_name().alias("f")).distinct().count()
    assert every >= 6 and scans == 1
    assert "EqualTo(block_no," in rows._jdf.queryExecution().executedPlan().toString()
    assert text_index.blocks_of(spark, path, "nowhere").count() == 0 and text_index.blocks_of(spark, path, "ab") is None


@pytest.mark.parametrize("q", ["needle", "ALPHA", "title 29", "nowhere"])
def test_folders_do_not_grow_with_the_table(spark, stored, tmp_path, monkeypatch, q):
    df, _ = stored
    monkeypatch.setattr(text_index, "PARTS", 4)
    text_index.build(df, str(tmp_path / "i"), ("body", "title"), "id", block_rows=8, part_blocks=1)
    assert len(list((tmp_path / "i" / "rows").glob("part_no=*"))) <= 4
    want = df.where(contains_ci("body", q) | contains_ci("title", q)).collect()
    got = text_index.search(spark, str(tmp_path / "i"), q, ("body", "title"), part_blocks=1).select("id", "body", "title").collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_lists_of_many_blocks(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(text_index, "GROUP", 3)
    monkeypatch.setattr(text_index, "PAIRS", 5)
    blocks, texts = [0, 0, 1, 2, 3, 4, 4, 7, 7], ["abc", "abcd", None, "bcd", "abc", "", "xyzabc", "abc", "long enough to be cut"]
    batch = pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(texts)], names=["block", "t0"])
    got = [(r["gram"], 3 * r["group"] + b) for out in text_index._of_blocks(iter([batch])) for r in out.to_pylist() for b in r["blocks"]]
    want = {(int(g), b) for b, t in zip(blocks, texts, strict=True) if t for g in text_index.grams(t.encode())}
    assert len(got) == len(set(got)) and set(got) == want
