"""Every operator that sends a small table to its tasks gives the same rows when the table is too large for that."""

import random

import pytest
from llm_fixtures import awkward, words

from fieldpulse.llm import exact, lines, minhash, rows, secrets, spans

PASSAGE = ". ".join(f"the {w} sentence of a passage goes on for these words" for w in ("first", "second", "third"))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    texts = [f"{words(rng, 20)}.\n{PASSAGE}.\n" + "\n".join(["line one", "line two", "line three"]) + f"\ntoken=abcdefgh{n % 5}" for n in range(20)]
    near = words(rng, 120).split()
    texts += [" ".join([*near[:k], f"x{k}", *near[k + 1 :]]) for k in range(0, 60, 4)]
    return awkward(spark, [(100 + n, t, "en") for n, t in enumerate(texts)] + [(500 + n, texts[0], "en") for n in range(15)])[1]


RUNS = {
    "copies": lambda df, path: exact.without_copies(df).select("doc_id", "text"),
    "ids": lambda df, path: rows.drop_ids(df, df.filter("doc_id % 3 = 0").select("doc_id")).select("doc_id", "text"),
    "lines": lambda df, path: lines.without_repeated_lines(df, min_words=25),
    "spans": lambda df, path: spans.without_repeated_spans(df, single_words=50),
    "secrets": lambda df, path: secrets.scan(df, str(path / "ledger")),
    "near copies": lambda df, path: minhash.near_duplicates(df),
}


@pytest.mark.parametrize("name", RUNS)
def test_same_rows_either_way(docs, tmp_path, monkeypatch, name):
    small = sorted(map(str, RUNS[name](docs, tmp_path / "small").collect()))
    for module in (exact, lines, minhash, rows, secrets, spans):
        monkeypatch.setattr(module, "narrow", lambda df, *_: (df, False))
    assert sorted(map(str, RUNS[name](docs, tmp_path / "large").collect())) == small
    assert len(small) > 20
