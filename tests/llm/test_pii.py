"""Fixed forms against plain patterns; what the bootstrap adds on planted cues."""

import hashlib
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from presswork.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        odd = sum(int(c) for c in digits[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
        return 12 <= len(digits) <= 19 and odd % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    found = [(m.start(), list(PLAIN).index(k), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text) if passes(k, m.group())]
    return sorted(found)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from([*"a1.@-+ %_0()", "4111 1111 1111 1111", "4539578763621486", "1.2.3.4", "256", "é", "x@y.z", "+49 (30) 123-4567", "00", "\n", "😀"]), max_size=25).map("".join))
def test_fixed_forms(text):
    assert pii.base_spans(text) == plain(text)
    spans = pii.candidates(text, pii.base_spans(text))
    assert all(s < e for s, e in spans) and all(b[0] >= e or b[2] <= s for s, e in spans for b in pii.base_spans(text))


def test_time_in_proportion_to_the_text():
    for unit in ("a", "1", "1.", "@", "a@", "+1 ", "1 ", "1-", "(", "+1(", "a.", "1.1.1.", "x1", "a=1", "é", "ab@cd"):
        text = unit * (1_000_000 // len(unit))
        began = time.process_time()
        base = pii.base_spans(text)
        pii.candidates(text, base)
        assert time.process_time() - began < 12, unit


def shown(df, texts):
    out = {}
    for r in df.collect():
        t = texts[r["doc_id"]] or ""
        out[r["doc_id"]] = [(pii.KINDS[s["kind"]], t[s["start"] : s["end"]]) for s in r["spans"]]
    return out


def test_cues_discover_what_no_form_matches(spark):
    filler = "the report of 12345 people and order A1B2C3D4 was read in the house of the town "
    texts = [filler + f"please write to me at person{i}@mail{i}.org today. " + filler + f"My phone number is +49 30 55501{i:02d} now" for i in range(8)]
    texts += [filler + "please write to me at bob@localhost today", filler + "my phone number is 030 555 0199 now", filler + "call 030 555 0199 twice", "nothing at all 99999 here", "", None]
    texts += texts[:2]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = pii.find_pii(df)
    got = shown(found, texts)
    assert sorted(got) == list(range(len(texts)))
    assert got[0] == [("email", "person0@mail0.org"), ("phone", "+49 30 5550100")] == got[14]
    assert got[8] == [("email", "bob@localhost")]
    assert got[9] == [("phone", "030 555 0199")]
    assert got[11] == got[12] == got[13] == []
    for r in pii.report(found).collect():
        text = texts[r["doc_id"]] or ""
        base = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in plain(text))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == i for x in plain(text)) for i in range(4)]
        assert set(base.split(",")) - {""} <= set(r["spans"].split(","))


def test_a_value_known_by_its_cues_is_found_elsewhere(spark):
    texts = [f"contact mail is user{i}@site.com ok" for i in range(20)] + ["contact mail is root@host ok"] * 4 + ["later root@host came back"]
    got = shown(pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), texts)
    assert got[24] == [("email", "root@host")]


def test_frequent_words_and_copies_make_no_pattern(spark):
    texts = [f"he saw the user{i}@site.com and" for i in range(6)] + ["in the house of the man the X9Y8Z7W6 and the rest of the day"] * 5
    texts += ["only this once one@two.three and"] * 30 + ["only this once AB12CD34 and"]
    got = shown(pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), texts)
    assert all(len(v) == ("@" in texts[i]) for i, v in got.items())


def test_nulls_repeats_and_clashing_names(spark):
    rows = [(None, "a@b.cd"), (None, None), (1, "a@b.cd"), (1, "a@b.cd"), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    odd = df.select("*", *[F.lit(1).alias(c) for c in ("id", "row", "x", "base", "seen", "spans", "pattern", "value", "kind", "start", "end", "n")])
    got = pii.report(pii.find_pii(odd)).collect()
    assert sorted((r["doc_id"] or 0, r["n_email"], r["spans"]) for r in got) == [(0, 0, ""), (0, 1, "email:0:6"), (1, 1, "email:0:6"), (1, 1, "email:0:6"), (2, 0, "")]
    assert pii.report(pii.find_pii(df.where("false"))).collect() == []
