import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_fixtures import awkward, no_rows
from pyspark.sql import functions as F

from fieldpulse.llm import fim


def by_definition(doc, text, cut_percent=100):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(lines)
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= cut_percent:
        return doc, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < 50:
        return doc, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def lined(rng, n, long):
    return "".join("x" * rng.choice((0, 1, 40, long)) + rng.choice(("\n", "é\n", "\r\n", "😀\n")) for _ in range(n))


@pytest.fixture
def texts(spark):
    rng = random.Random(9)
    extra = [(100 + n, lined(rng, rng.randrange(1, 60), 3_000), "en") for n in range(60)]
    extra += [
        (200, "no newline", "en"), (201, "\n", "en"), (202, "\n\n\n", "en"), (203, "a <P> b\nc", "en"), (204, "a<\nS>b<\n", "en"),
        (205, "<S\n>\n<M\nP>", "en"), (206, "<M>", "en"), (207, "end without newline\nlast", "fr"), (208, lined(rng, 30_000, 90), "en"),
        (209, "z" * 300_000 + "\n" + "y\n" * 4_000, "en"),
    ]
    return awkward(spark, extra)


@pytest.mark.parametrize(("cut_percent", "max_error"), [(100, 256), (40, 1)])
def test_outputs_match_the_definition_and_restore(spark, texts, cut_percent, max_error):
    rows, df = texts
    got = fim.fill_in_middle(df, cut_percent=cut_percent, max_error=max_error)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "n_segments"]
    want = Counter(by_definition(doc, text, cut_percent) for doc, text, *_ in rows)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert Counter(tuple(r)[:6] for r in got.collect()) == want
    back = got.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("text"))
    assert Counter(map(tuple, back.collect())) == Counter((doc, text or "") for doc, text, *_ in rows)


@pytest.mark.parametrize("max_error", [1, 16, 256])
def test_index_gives_every_boundary_exactly_within_its_bound(spark, texts, max_error):
    rows, df = texts
    texts_of = {doc: text or "" for doc, text, *_ in rows if doc and doc >= 100}
    found = {r["doc_id"]: r for r in fim.rank_index(df, max_error=max_error).filter("doc_id >= 100").collect()}
    assert found.keys() == texts_of.keys()
    for doc, text in texts_of.items():
        r = found[doc]
        want = np.cumsum([0, *map(len, re.findall(r"[^\n]*\n|[^\n]+", text))])
        starts, bases, slopes = (np.array(r[c]) for c in ("starts", "bases", "slopes"))
        ranks = np.arange(r["n"] + 1)
        at = np.searchsorted(starts, ranks, "right") - 1
        predicted = bases[at] + np.rint(slopes[at] * (ranks - starts[at])).astype(int)
        assert np.array_equal(predicted + np.array(r["residuals"]), want)
        assert np.abs(predicted - want).max() <= max_error + 1


def test_regular_lines_need_one_segment_and_jumps_more(spark):
    df = spark.createDataFrame([(1, "abcdefg\n" * 20_000), (2, "a\n" * 500 + "b" * 100_000 + "\n" + "c\n" * 500)], "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in fim.rank_index(df).collect()}
    assert len(found[1]["starts"]) == 1 and 2 <= len(found[2]["starts"]) <= 4


def test_empty_table_bad_marks_and_no_shuffle(spark, texts):
    _, df = texts
    assert fim.fill_in_middle(no_rows(df)).count() == 0 and fim.rank_index(no_rows(df)).count() == 0
    for marks in (("<P>", "<P>x", "<M>"), ("", "<S>", "<M>"), ("<P<", "<S>", "<M>"), ("P", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(df, marks=marks)
    with pytest.raises(ValueError):
        fim.fill_in_middle(df, max_error=0)
    assert "Exchange" not in fim.fill_in_middle(df)._jdf.queryExecution().executedPlan().toString()
