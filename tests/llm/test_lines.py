import random
from collections import Counter

import pytest
from llm_fixtures import awkward, no_rows

from fieldpulse.llm.lines import without_repeated_lines

LAST = (1 << 63) - 1


def expected(rows, m):
    """Windows of ``m`` lines in document order, each but the first deleted; equal rows share the first's verdict."""
    seen, verdict = set(), {}
    for doc, text in sorted(((LAST if d is None else d, t or "") for d, t, *_ in rows), key=lambda x: x[0]):
        lines, gone = text.split("\n"), set()
        for i in range(len(lines) - m + 1):
            if (window := tuple(lines[i : i + m])) in seen:
                gone |= set(range(i, i + m))
            seen.add(window)
        verdict.setdefault((doc, text), (len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return Counter((d, *verdict[LAST if d is None else d, t or ""]) for d, t, *_ in rows)


@pytest.mark.parametrize("min_lines", [1, 2, 3, 5])
def test_later_copies_of_runs_go(spark, min_lines):
    rng = random.Random(min_lines)
    block = "\n".join(f"line {n}" for n in range(40))
    extra = [(300 + n, "\n".join(rng.choice("abc") for _ in range(rng.randrange(12))), "en") for n in range(60)]
    extra += [(400 + n, f"head {n}\n{block}\nfoot {n}", "en") for n in range(30)]
    extra += [(500, "same\n" * 200, "en"), (501, block + "\n" + block, "en"), (502, "\n\n\n", "en")]
    rows, df = awkward(spark, extra)
    got = without_repeated_lines(df, min_lines=min_lines)
    assert got.columns == ["doc_id", "n_lines", "n_removed", "longest", "removed", "text"]
    found = got.collect()
    assert Counter((r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in found) == expected(rows, min_lines)
    longest = {r["doc_id"]: r["longest"] for r in found}
    assert 20 < longest[405] <= 40 and (longest[405] // min_lines).bit_count() == 1
    assert without_repeated_lines(no_rows(df)).count() == 0


def test_less_than_one_line_is_refused(spark):
    with pytest.raises(ValueError):
        without_repeated_lines(spark.createDataFrame([], "doc_id bigint, text string"), min_lines=0)


@pytest.mark.parametrize(("min_lines", "min_words"), [(3, 25), (5, 8)])
def test_short_runs_of_many_words_go(spark, min_lines, min_words):
    rng = random.Random(min_words)
    pool = [" ".join(f"w{rng.randrange(9**6)}" for _ in range(n)) for n in (0, 1, 2, 3, 5, 8, 13, 14, 25, 40)]
    rows = [(n, "\n".join(rng.choice(pool) if rng.random() < 0.5 else f" line  {n} {k}\t" for k in range(rng.randrange(1, 9)))) for n in range(120)]
    seen, want = set(), {}
    for doc, text in rows:
        parts, gone = text.split("\n"), set()
        for i in range(len(parts)):
            for j in range(i + 1, min(len(parts), i + min_lines) + 1):
                run = tuple(parts[i:j])
                if (len(run) == min_lines or sum(len(x.split()) for x in run) >= min_words) and run in seen:
                    gone |= set(range(i, j))
                seen.add(run)
        want[doc] = (len(gone), "\n".join(x for k, x in enumerate(parts) if k not in gone))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = without_repeated_lines(df, min_lines=min_lines, min_words=min_words).collect()
    assert {r["doc_id"]: (r["n_removed"], r["text"]) for r in found} == want
    assert sum(n for n, _ in want.values()) > sum(r["n_removed"] for r in without_repeated_lines(df, min_lines=min_lines).collect())
