"""Fill-in-the-middle against a plain version, exact round trips and odd rows."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm.fill_middle import MARKS, arranged, cut, fill_in_middle, rebuilt, restore, seeds, unit_ends


def plain(doc_id, text):
    """The stated result, by joined lists of lines."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if text == "" or "<P>" in text or "<S>" in text or "<M>" in text:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 50:
        return len(units), "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return len(units), "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


def test_odd_rows_match_the_plain_version(spark):
    texts = [None, "", "\n", "\n\n\n", "a", "one\ntwo", "one\ntwo\n", "ends with <P> mark", "<S", "a<\nS>b\n<M", "é😀\n𝒳 x\n", "x\r\ny\r\n", " \n", "same", "same"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id\nhere\n"), (7, "repeated id"), (-3, "minus\nid"), (1 << 40, "line\n" * 50_000), (9, "é" * 300_000)]
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, form string, n long")
    out = fill_in_middle(docs).collect()
    assert len(out) == len(rows)
    got = sorted((str(r["doc_id"]), r["n"], r["form"], str(r["prefix_chars"]), str(r["middle_chars"]), r["output"]) for r in out)
    want = []
    for i, t in rows:
        n, form, p, m, o = plain(i, t)
        want.append((str(i), n, form, str(p), str(m), o))
    assert got == sorted(want)
    for r in out:
        assert r["output_sha256"] == hashlib.sha256(r["output"].encode()).hexdigest()
    assert {str(r["doc_id"]) + r["restored_sha256"] for r in out} == {str(i) + hashlib.sha256((t or "").encode()).hexdigest() for i, t in rows}


def test_restore_gives_every_text_back(spark):
    docs = spark.createDataFrame([(i, "\n".join(f"line {j} of {i}" for j in range(i % 9)) or None) for i in range(200)], "doc_id long, text string")
    out = fill_in_middle(docs, percent=70, spm_percent=30)
    both = out.join(docs, "doc_id").select("form", "text", restore(out["output"], out["form"]).alias("again")).collect()
    assert all(r["again"] == (r["text"] or "") for r in both)
    assert {r["form"] for r in both} == {"plain", "psm", "spm"}
    assert restored_nulls(spark) == [(None,), (None,)]


def restored_nulls(spark):
    rows = spark.createDataFrame([(None, "psm"), ("<P><S><M>", None)], "o string, f string")
    return [tuple(r) for r in rows.select(restore(rows["o"], rows["f"])).collect()]


def test_empty_table_and_other_names(spark):
    assert fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    docs = spark.createDataFrame([("k", "a b c")], "name string, body string")
    out = fill_in_middle(docs, "name", "body", unit=r"\S+\s*", seed=3).collect()
    assert out[0]["name"] == "k" and out[0]["n"] == 3 and rebuilt(out[0]["output"], out[0]["form"]) == "a b c"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a<PSM>\n é", max_size=40), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1), st.sampled_from(["psm", "spm"]))
def test_cuts_and_round_trip(text, h1, h2, form):
    import regex

    ends = unit_ends(text, regex.compile(r"[^\n]*\n|[^\n]+"))
    assert not text or ends[-1] == len(text)
    begin, end = cut(text, ends, h1, h2)
    assert 0 <= begin <= end <= len(text) and (begin == 0 or begin in ends) and (end == 0 or end in ends)
    if not any(m in text for m in MARKS):
        assert rebuilt(arranged(text, begin, end, form), form) == text


def test_seeds_are_the_first_groups():
    digest = hashlib.sha256(b"7:12").hexdigest()
    assert seeds("7:12") == tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
