import hashlib
import string

import pytest
from llm_fixtures import awkward, no_rows

from fieldpulse.llm.exact import exact_duplicates, repeated_texts, without_copies

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def expected(rows):
    groups = {}
    for doc, text, *_ in rows:
        groups.setdefault((text or "").translate(FOLD), []).append(doc)
    out = []
    for doc, text, *_ in rows:
        norm = (text or "").translate(FOLD)
        ids = groups[norm]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((doc, keep, len(ids), doc == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("max_cells", [4_000_000, 0])
def test_groups_match_brute_force(spark, max_cells):
    rows, df = awkward(spark)
    got = exact_duplicates(df, max_cells=max_cells)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows)


def test_one_document_of_each_group_stays_with_all_columns(spark):
    rows, df = awkward(spark)
    kept = without_copies(df)
    assert kept.columns == df.columns
    texts = [(r["text"] or "").translate(FOLD) for r in kept.collect()]
    assert sorted(texts) == sorted({(t or "").translate(FOLD) for _, t, *_ in rows})
    assert all(r["doc_id"] == 10 for r in kept.collect() if r["text"] and r["text"].lower() == rows[0][1])


def test_a_group_of_a_third_of_all_rows_and_the_empty_table(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'same text', concat('text ', id)) as text")
    got = exact_duplicates(df).filter("group_size > 1")
    assert got.count() == 1000 and got.filter("keep_id <> 2997").isEmpty() and got.filter("kept").count() == 1
    assert exact_duplicates(no_rows(df)).count() == 0 and without_copies(no_rows(df)).count() == 0


def test_texts_are_never_shuffled(spark):
    _, df = awkward(spark)
    plan = repeated_texts(df)._jdf.queryExecution().executedPlan().toString()
    assert "_text" not in plan
