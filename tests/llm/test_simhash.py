import random
import re
from collections import Counter

import pytest
import xxhash
from llm_fixtures import awkward, no_rows, words

from fieldpulse.llm.components import components
from fieldpulse.llm.simhash import link_fingerprints, near_duplicates, without_near_copies


def fingerprint(text):
    """Bit by bit, from the definition."""
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def signed(fp):
    return fp - (1 << 64) if fp >> 63 else fp


def reach(prints):
    """Component of each fingerprint by comparing all pairs."""
    name = {p: p for p in prints}

    def top(p):
        while name[p] != p:
            p = name[p]
        return p

    order = sorted(prints)
    for i, a in enumerate(order):
        for b in order[:i]:
            if (a ^ b).bit_count() <= 2:
                name[top(a)] = top(b)
    return {p: top(p) for p in prints}


def test_documents_match_brute_force(spark):
    rng = random.Random(5)
    long = words(rng, 700, 100_000)
    extra = [(100 + n, " ".join(w if rng.random() > 0.002 else "edit" for w in long.split()), "en") for n in range(30)]
    rows, df = awkward(spark, extra)
    prints = [(doc, fingerprint(text)) for doc, text, *_ in rows]
    root = reach({p for _, p in prints})
    first = {}
    for doc, p in prints:
        if doc is not None:
            first[root[p]] = min(doc, first.get(root[p], doc))
    want = Counter((doc, signed(p), first.get(root[p])) for doc, p in prints)
    assert len({c for _, _, c in want}) < len({p for _, p in prints}), "the fixture links no different fingerprints"
    got = near_duplicates(df)
    assert got.columns == ["doc_id", "fp", "component_id"]
    assert Counter(tuple(r) for r in got.collect()) == want
    kept = without_near_copies(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == set(first.values())
    assert near_duplicates(no_rows(df)).count() == 0 and without_near_copies(no_rows(df)).count() == 0


@pytest.mark.parametrize("list_rows", [2, 64, 10_000])
def test_links_do_not_depend_on_the_length_of_lists(spark, list_rows):
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    near = {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)}
    prints = near | {rng.getrandbits(64) for _ in range(100)} | {centre, 0, (1 << 64) - 1}
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp bigint")
    edges = link_fingerprints(df, list_rows)
    for a, b in edges.collect():
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
    root = reach(prints)
    groups, found = {}, {}
    for p in prints:
        groups.setdefault(root[p], set()).add(signed(p))
    for r in components(edges).collect():
        found.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(sorted, found.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_pairs_of_a_crowded_list_are_not_formed(spark):
    # All share four positional bytes; each list of n members must give rows in proportion to n.
    df = spark.range(4096).selectExpr("id * 16 as fp")
    assert link_fingerprints(df).count() < 40 * 4096
