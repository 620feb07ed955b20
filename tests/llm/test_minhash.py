import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_fixtures import awkward, no_rows, words

from fieldpulse.llm import minhash
from fieldpulse.llm.minhash import Plan, least_matches, near_duplicates, without_near_copies

SMALL = Plan(list_rows=2, left=300, right=500)


def shingle_set(text, size=2):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    size = min(size, len(found))
    return frozenset(tuple(found[i : i + size]) for i in range(len(found) - size + 1)) if size else frozenset()


def by_definition(rows, size=2, percent=80):
    """Component names by comparing every set with every other."""
    sets = [shingle_set(text, size) for _, text, *_ in rows]
    different = sorted({s for s in sets if s}, key=sorted)
    top = list(range(len(different)))

    def find(k):
        while top[k] != k:
            top[k] = top[top[k]]
            k = top[k]
        return k

    for i, a in enumerate(different):
        for j in range(i):
            b = different[j]
            if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                continue
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                top[find(i)] = find(j)
    at = {s: find(k) for k, s in enumerate(different)}
    first = {}
    for (doc, *_), s in zip(rows, sets):
        if s and doc is not None:
            first[at[s]] = min(doc, first.get(at[s], doc))
    out = Counter()
    for (doc, *_), s in zip(rows, sets):
        component = first.get(at[s]) if s else doc
        out[doc, len(s), component, doc == component] += 1
    return out


def edited(rng, text, share):
    return " ".join(w if rng.random() > share else f"edit{rng.randrange(10**6)}" for w in text.split())


def mixed_rows():
    """Groups around the bound, a chain, templates, and a hub that alone links its copies."""
    rng = random.Random(8)
    rows, number = [], 1000
    for _ in range(25):
        origin = words(rng, rng.randrange(12, 200), 5_000)
        for share in (0.0, 0.02, 0.04, 0.06, 0.08):
            rows.append((number, edited(rng, origin, share), "en"))
            number += 1
    step = words(rng, 80, 5_000)
    for _ in range(40):
        step = edited(rng, step, 0.02)
        rows.append((number, step, "en"))
        number += 1
    variants = [[words(rng, 20, 5_000) for _ in range(3)] for _ in range(15)]
    for _ in range(60):
        picks = [rng.choice(v) for v in variants]
        rows.append((number, " ".join(picks), "en"))
        picks[rng.randrange(15)] = words(rng, 20, 5_000)
        rows.append((number + 1, " ".join(picks), "en"))
        number += 2
    hub = words(rng, 150, 5_000).split()
    rows.append((number, " ".join(hub), "en"))
    for k in range(40):
        other = list(hub)
        for at in rng.sample(range(0, 150, 3), 13):
            other[at] = f"copy{k}x{at}"
        rows.append((number + 1 + k, " ".join(other), "en"))
    return rows


@pytest.mark.parametrize("plan", [Plan(), SMALL], ids=["whole lists", "blocks"])
def test_components_match_brute_force(spark, plan):
    rows, df = awkward(spark, mixed_rows())
    want = by_definition(rows)
    got = near_duplicates(df, plan=plan)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert Counter(tuple(r) for r in got.collect()) == want
    sizes = Counter(c for _, _, c, _ in want.elements())
    assert max(sizes.values()) >= 40 and sum(n == 2 for n in sizes.values()) >= 20
    if plan == SMALL:
        five = near_duplicates(df, shingle_words=5, min_percent=60, plan=plan)
        assert Counter(tuple(r) for r in five.collect()) == by_definition(rows, 5, 60)


def test_one_document_of_each_group_stays_with_all_columns(spark):
    rows, df = awkward(spark)
    kept = without_near_copies(df)
    assert kept.columns == df.columns
    found = by_definition(rows)
    want = {doc for doc, *_ in found} - {doc for doc, _, _, stays in found if not stays}
    assert {r["doc_id"] for r in kept.collect()} == want
    for empty in (near_duplicates(no_rows(df)), without_near_copies(no_rows(df))):
        assert empty.count() == 0


def test_a_near_copy_group_of_a_third_of_all_rows_is_not_paired_out(spark, monkeypatch):
    rng = random.Random(2)
    origin = words(rng, 200, 9_000)
    rows = [(n, edited(rng, origin, 0.02) if n % 3 == 0 else words(rng, 60, 9_000)) for n in range(1_500)]
    asked = []
    confirm = minhash._confirmed

    def counted(pairs, *rest):
        asked.append(pairs.count())
        return confirm(pairs, *rest)

    monkeypatch.setattr(minhash, "_confirmed", counted)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert got.filter("doc_id % 3 = 0 and component_id <> 0").isEmpty() and got.filter("not kept").count() == 499
    # Of the 124,750 pairs of the group only those with leaders leave a bucket.
    assert asked[0] < 500 * 30 and asked[1] < 500


def test_pruning_follows_the_posterior():
    needed = least_matches(80, 288, 24, 1e-7)
    assert len(needed) == 12 and needed == sorted(needed)
    rng = np.random.default_rng(1)
    stay = minhash._pruner(needed, 24)
    kept = {}
    for s in (0.3, 0.6, 0.8, 0.9):
        left = rng.integers(0, 256, (20_000, 288), np.uint8)
        right = np.where(rng.random(left.shape) < s, left, rng.integers(0, 256, left.shape, np.uint8))
        kept[s] = len(stay(left, right)) / 20_000
    assert kept[0.9] == kept[0.8] == 1.0 and kept[0.3] == 0.0 and kept[0.6] < 0.2


def test_texts_of_one_word_and_case(spark):
    rows = [(1, "One"), (2, "one"), (3, "one\tone"), (4, "ONE one ONE"), (5, "É"), (6, "é"), (7, " \n"), (8, ""), (9, None)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(by_definition(rows).elements())
    assert {r["component_id"] for r in got.filter("doc_id < 3").collect()} == {1}


@pytest.mark.parametrize("bad", [{"bands": 0}, {"miss": 0.0}, {"list_rows": 1}])
def test_bad_plans_are_refused(bad):
    with pytest.raises(ValueError):
        Plan(**bad)
