"""Fill-in-middle against a version in plain Python, and its boundaries against the units they should leave."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm import fill_in_middle as fim

TEXTS = ["", None, "a", "ab", "héé 😀😀x́\n漢字 \U0001f469‍\U0001f4bb", "\x00\r\n\t ", "has <P> in it", "a<S>", "<M", "<", "<P<S<M>", "<<<P", ">P>S>", "x" * 200_000, "😀" * 500, "word  word\n\nline 12ab"]


def brute(doc_id, text):
    text = text or ""
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", text, None, None
    x, y, z = text[:a], text[a:b], text[b:]
    return (n, "spm", f"<S>{z}<P>{x}<M>{y}", a, b - a) if h4 % 100 < 20 else (n, "psm", f"<P>{x}<S>{z}<M>{y}", a, b - a)


def test_fill_in_middle(spark):
    rows = [(i * len(TEXTS) + k, t, "clash", 1) for i in range(12) for k, t in enumerate(TEXTS)]
    rows += [(None, "no id", "x", 2), (None, None, None, None), rows[4], rows[4], (-5, "negative", "", 0), (4, "another text", "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _n string, _units int").repartition(3)
    found = fim.fill_in_middle(df).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(((x.doc_id, x.text, x._units, x._n, x._form, x._output, x._prefix_units, x._middle_units) for x in found), key=key) == sorted(((i, t, u, *brute(i, t)) for i, t, _, u in rows), key=key)
    assert all(x._restored == (x.text or "") for x in found)
    assert {x._form for x in found} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(df.limit(0)).count() == 0


@pytest.mark.parametrize("grammar,pattern", [("code_points", r"(?s)."), ("words", r"[^ \t-\r]*[ \t-\r]+|[^ \t-\r]+$"), ("lines", r"[^\n]*\n+|[^\n]+$"), ("runs", r"[A-Za-z]+|[0-9]+|[ \t-\r]+|[^A-Za-z0-9 \t-\r]+")])
def test_units(spark, grammar, pattern):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for x in df.select("text", fim.units(F.col("text"), grammar).alias("u")).collect():
        assert x.u == re.findall(pattern, x.text or ""), (grammar, x.text[:30])
    found = fim.fill_in_middle(df, grammar).collect()
    assert all(x._restored == (x.text or "") for x in found)


def test_boundaries_have_no_width():
    with pytest.raises(ValueError):
        fim.boundary("other", [])
    assert all(re.fullmatch(r"(\(\?<=\[[^\]]+\]\)\(\?=\[[^\]]+\]\)\|?)+", fim.boundary(*g)) for g in fim.GRAMMARS.values())
