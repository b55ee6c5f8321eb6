"""Token counts and token files against the library."""

import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from presswork.llm import token_counts, token_files  # noqa: E402

PARTS = ["a", "The", "'s", "'Re", "'re", "'", "r", "e", " ", "  ", "\n", "\t", "1", "23", ".", "!", ",", "É", "日本", "<|endoftext|>", "<|end", "word", "ing", " ing", "İ", "Σ", "😀", "́", "...", "I'll", "_", "x\xa0y", "\x1c", "ß", "\r\n", "　"]


def texts(n, longest, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, longest))) for _ in range(n)]


@pytest.fixture(scope="module")
def bpe():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    return token_counts.PrefixCounter(path), lambda t: len(library.encode(t, add_special_tokens=False).ids)


def test_every_prefix(bpe):
    counter, count = bpe
    for t in texts(500, 12, 1):
        want = [count(t[:p]) for p in range(len(t) + 1)]
        assert counter.total(t) == want[-1]
        assert counter.prefixes(t).tolist() == want
        for limit in range(6):
            assert counter.longest_prefix(t, limit) == max(p for p, n in enumerate(want) if n <= limit)


def test_long_pieces(bpe):
    counter, count = bpe
    for t in ["a" * 3000, " " * 500 + "x", "-" * 700, "ab1" * 400, "\n" * 90]:
        assert counter.total(t) == count(t)


def test_kept_pieces_are_bounded_by_bytes(bpe, monkeypatch):
    (counter, _), rng = bpe, random.Random(1)
    monkeypatch.setattr(token_counts, "PIECE_BYTES", 1 << 20)
    for _ in range(12):  # runs of letters that are each one piece
        counter.steps_of("".join(rng.choices("abcdefgh", k=60_000)))
    assert sum(map(len, counter.pieces)) <= 4 * 60_000


def test_count_rows(spark, bpe):
    _, count = bpe
    rows = [(i, t) for i, t in enumerate([None, "", "word " * 3000, *texts(40, 30, 2)])] + [(None, "x"), (1, "y"), (1, "y")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_tokens int")
    got = token_counts.token_counts(df, public_tokenizers.path("byte_bpe_50k.json"), limit=50, prefixes=True).collect()
    key = lambda i, t: (-1 if i is None else i, len((t or "").encode()), count(t or ""))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == sorted(key(i, t) for i, t in rows)
    for r in got:
        assert r["over_limit"] == (r["n_tokens"] > 50) and r["prefix_tokens"][-1] == r["n_tokens"]
        assert r["fit_chars"] == max(p for p, n in enumerate(r["prefix_tokens"]) if n <= 50)
    assert token_counts.token_counts(df.where("false"), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_encoder():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, encoder = Tokenizer.from_file(path), token_files.Encoder(path)
    made = texts(3000, 14, 3)
    for t, ids in zip(made, encoder.encode(made), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_token_files(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [(i * 3, t) for i, t in enumerate([None, "", "Word, word.\nWORD " * 400, *texts(60, 40, 4)])] + [(None, "first"), (6, "twice"), (6, "twice")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, before int").repartition(5)
    got = token_files.tokenise_to_files(df, path, 2, str(tmp_path / "ids"), file_bytes=1000).orderBy("start").collect()
    start, order = 0, sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""))
    assert len(got) == len(rows)
    for (i, t), r in zip(order, got, strict=True):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    assert [r["ids"] for r in token_files.read_tokens(spark, str(tmp_path / "ids"), [0]).collect()] == [[2]]
    assert token_files.tokenise_to_files(df.where("false"), path, 2).count() == 0


def test_stored_steps_answer_questions(spark, bpe):
    counter, count = bpe
    rows = [(i, t) for i, t in enumerate(["", "word " * 300, "x\n\ny  z", *texts(60, 30, 6)])]
    got = token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json"), limit=5)
    asked = got.select("doc_id", token_counts.tokens_within("prefix_steps", 7).alias("within"), token_counts.longest_fit("prefix_steps", 4).alias("fit")).collect()
    for r in asked:
        t = dict(rows)[r["doc_id"]]
        assert r["within"] == count(t[:7])
        assert r["fit"] == max(p for p in range(len(t) + 1) if count(t[:p]) <= 4)


def test_files_have_stripes_indexes_and_filters(spark, tmp_path):
    from pyarrow import orc

    r = random.Random(3)
    rows = [(i, " ".join(f"{r.choice('abcdefgh')}{r.randrange(9999)}" for _ in range(400))) for i in range(3000)]
    path = str(tmp_path / "ids")
    token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json"), path, 2)
    files = sorted(str(p) for p in (tmp_path / "ids").glob("part-*.orc"))
    assert sum(orc.ORCFile(f).nrows for f in files) == 3000
    largest = max(files, key=lambda f: orc.ORCFile(f).nrows)
    assert orc.ORCFile(largest).nstripes > 1 and orc.ORCFile(largest).row_index_stride == 1000
    jvm = spark._jvm
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(largest), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    columns = spark.sparkContext._gateway.new_array(jvm.boolean, 5)
    for i in range(5):
        columns[i] = True
    index = reader.rows().readRowIndex(0, columns, columns)
    assert index.getBloomFilterIndex()[1].getBloomFilterCount() > 0  # column 1 is doc_id
    assert index.getRowGroupIndex()[1].getEntryCount() > 0
    assert {x["doc_id"] for x in token_files.read_tokens(spark, path, [5, 2999, 4000]).collect()} == {5, 2999}


def test_more_files_than_names_in_order(spark):

    names = spark.range(100_020).select(F.format_string("part-%05d-x-c000.zstd.orc", "id").alias("file"), F.lit(2).cast("long").alias("n"), "id")
    starts = token_files.file_starts(names.select("file", "n")).join(names, "file")
    assert starts.where("offset <> 2 * id").count() == 0
