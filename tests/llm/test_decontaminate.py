import hashlib
import random
import re

import numpy as np
import pytest
from llm_fixtures import awkward, no_rows, words
from pyspark.sql import functions as F

from fieldpulse.llm.decontaminate import KeySet, contamination, without_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def spell(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(docs, items):
    wins = {}
    for item, text in items:
        w = spell(text)
        for s in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[s : s + 10]), set()).add("" if item is None else str(item))
    out = []
    for doc, text, *_ in docs:
        w, hit, found = spell(text), set(), set()
        for size in {len(x) for x in wins}:
            for s in range(len(w) - size + 1):
                if owners := wins.get(tuple(w[s : s + size])):
                    hit |= set(range(s, s + size))
                    found |= owners
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(8)
    passage, other = words(rng, 30), "É1 ça-va  日本 x_y " + words(rng, 7)
    items = [
        (1, passage), (2, other), (3, None), (4, " .,; "), (5, "one two"), (6, words(rng, 12)), (None, passage + " tail"),
        (11, passage), (5, "solitary"), (7, " ".join(["again"] * 14)), (8, "again again"),
    ]
    docs = [
        (20, "intro " + passage.upper() + " end", "en"), (21, " ".join(passage.split()[3:12]), "en"),
        (22, " ".join(passage.split()[3:13]), "en"), (23, other.replace(" ", ", "), "en"), (24, "one_two ONE;TWO three", "en"),
        (25, "again " * 9, "en"), (26, "again " * 30, "en"), (27, passage + " " + passage, "en"), (28, "x solitary", "en"),
        *((n, f"start {n} {passage} stop", "en") for n in range(30, 60)),
    ]
    rows, df = awkward(spark, docs)
    return rows, df, items, spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 as window", "2 as item")


@pytest.mark.parametrize("block_keys", [500_000, 20])
def test_hits_match_brute_force(tables, block_keys):
    rows, df, items, benchmark = tables
    got = contamination(df, benchmark, block_keys=block_keys)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows, items)


def test_clean_documents_stay_whole(tables):
    rows, df, items, benchmark = tables
    hit = {doc for doc, *_, bad in expected(rows, items) if bad}
    kept = without_contaminated(df, benchmark)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(d) for d, *_ in rows if d not in hit)
    assert contamination(no_rows(df), benchmark).count() == 0
    assert contamination(df, no_rows(benchmark)).filter("contaminated or n_items > 0").isEmpty()


def test_many_different_words_stay_off_the_driver(spark):
    """Windows of words that occur once each; documents hold every thousandth passage."""
    n = 30_000
    item = F.expr("array_join(transform(sequence(0, 99), j -> concat('w', cast(id * 100 + j as string))), ' ')")
    benchmark = spark.range(n).select(F.col("id").alias("item_id"), item.alias("text"))
    docs = benchmark.filter("item_id % 1000 = 0").selectExpr("item_id as doc_id", "concat('before ', substring_index(text, ' ', 20), ' after') as text")
    got = contamination(docs, benchmark, block_keys=1_000_000).groupBy("n_words", "n_hit", "n_items").count().collect()
    assert [tuple(r) for r in got] == [(22, 20, 1, n // 1000)]


def test_keys_and_word_bounds():
    from fieldpulse.llm import decontaminate

    assert len(decontaminate._shingle_keys(np.zeros(2, np.uint64), 3)) == 0
    seen = KeySet.of(np.array([5, -7, 5 + (1 << 40)], np.int64))
    at, slot = seen.places(np.array([5, 6, -7, 5 + (1 << 40), 5 + (1 << 41)], np.int64))
    assert at.tolist() == [0, 2, 3] and seen.keys[slot].tolist() == [5, -7, 5 + (1 << 40)]
    begins, ends = decontaminate._word_bounds(b"  ab c  d")
    assert begins.tolist() == [2, 5, 8] and ends.tolist() == [4, 6, 9]
