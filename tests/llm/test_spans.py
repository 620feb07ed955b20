import random
import re
from collections import Counter

from llm_fixtures import awkward, no_rows, words

from fieldpulse.llm.spans import without_repeated_spans

EDGE = re.compile(r"[.!?]+[)\]\"'»”]*\s+|[。！？]+\s*|\n\s*")
LAST = (1 << 63) - 1


def sentences(text):
    bounds = [0, *(m.end() for m in EDGE.finditer(text))]
    if bounds[-1] < len(text):
        bounds.append(len(text))
    return [text[a:b] for a, b in zip(bounds, bounds[1:])]


def runs(parts):
    for i in range(len(parts)):
        for j in range(i + 1, len(parts)):
            spelled = " ".join(w for s in parts[i : j + 1] for w in s.split())
            if len(spelled.split()) >= 25:
                yield i, j, spelled.encode().lower()
                break


def expected(rows):
    first = {}
    parts = [(LAST if d is None else d, sentences(t or "")) for d, t, *_ in rows]
    for doc, s in sorted(parts, key=lambda x: x[0]):
        for i, _, run in runs(s):
            first.setdefault(run, (doc, i))
    out = []
    for (doc, s), (own, *_) in zip(parts, rows, strict=True):
        gone = set()
        for i, j, run in runs(s):
            if first[run][0] != doc or any(run == r and k < i for k, _, r in runs(s)):
                gone |= set(range(i, j + 1))
        out.append((own, len(s), len(gone), "".join(x for k, x in enumerate(s) if k not in gone)))
    return Counter(out)


def test_repeated_passages_go_and_their_first_place_stays(spark):
    rng = random.Random(4)
    passage = ". ".join(words(rng, 14).capitalize() for _ in range(4)) + ". "
    extra = [(50, "Intro here. " + passage + "End.", "en"), (40, "Mine. " + passage.upper().replace(" ", "  "), "en")]
    extra += [(60, passage + "Between! " + passage, "en"), (61, "Short one. Short two.", "en"), (62, "Short one. Short two.", "en")]
    extra += [(n, f"Number {n} begins. {passage}Number {n} ends\n", "en") for n in range(70, 110)]
    extra += [(None, passage, "en"), (63, words(rng, 60), "en")]
    rows, df = awkward(spark, extra)
    got = without_repeated_spans(df)
    assert got.columns == ["doc_id", "n_sentences", "n_removed", "removed", "text"]
    found = got.collect()
    assert Counter((r["doc_id"], r["n_sentences"], r["n_removed"], r["text"]) for r in found) == expected(rows)
    assert {r["doc_id"]: r["text"] for r in found}[70] == "Number 70 begins. Number 70 ends\n"
    assert {r["doc_id"]: r["text"] for r in found}[40].startswith("Mine. ")
    assert without_repeated_spans(no_rows(df)).count() == 0


def test_every_run_of_enough_words_is_covered(spark):
    rng = random.Random(9)
    pool = [words(rng, n, 10**6).capitalize() + ". " for n in (1, 2, 3, 6, 11, 20, 20, 3, 24, 49, 50, 60)]
    rows = [(n, "".join(rng.choice(pool) if rng.random() < 0.6 else f"Own {n} {k}. " for k in range(9))) for n in range(80)]
    rows += [(90, "".join(pool[5:8]) + "Ends here."), (91, "Before. " + "".join(pool[5:8]) + "Other end."), (92, pool[11])]
    first, want = {}, {}

    def every(parts):
        for i in range(len(parts)):
            for j in range(i, len(parts)):
                spelled = " ".join(" ".join(parts[i : j + 1]).split()).lower()
                if len(spelled.split()) >= (50 if i == j else 25):
                    yield i, j, spelled

    for doc, text in rows:
        for i, _, run in every(sentences(text)):
            first.setdefault(run, (doc, i))
    for doc, text in rows:
        parts = sentences(text)
        gone = {k for i, j, run in every(parts) if first[run] != (doc, i) for k in range(i, j + 1)}
        want[doc] = "".join(x for k, x in enumerate(parts) if k not in gone)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"]: r["text"] for r in without_repeated_spans(df, single_words=50).collect()} == want
    assert want[91] == "Before. Other end." and want[92] == ""
