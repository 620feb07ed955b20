import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from fieldpulse.functions.vectors import centroids, parse_vector
from fieldpulse.plans import inbox as views
from fieldpulse.plans.embedding import (
    embed,
    embed_in_slices,
    embedding_report,
    pending_texts,
    with_retries,
)
from fieldpulse.plans.formation import form_patterns, provisional_names
from fieldpulse.plans.novelty import ask_in_slices, assess, assessment_report, search_result, shortlist, verdict_precision
from fieldpulse.plans.scoring import score_patterns, scoring_report
from fieldpulse.schema import TABLES


def now():
    return F.lit("2024-05-01 00:00:00").cast("timestamp")
d = dt.date


def test_scoring_windows(spark):
    dates = {
        1: [d(2024, 6, 30), d(2024, 5, 1), d(2024, 4, 30), d(2023, 5, 2), d(2023, 5, 1), d(2024, 7, 1), None],
        2: [d(2024, 6, 1)], 3: [d(2023, 12, 1)],
    }
    rows = [(p, n * 100 + p, x) for p, l in dates.items() for n, x in enumerate(l)]
    df = spark.createDataFrame(rows, "pattern_id bigint, odi_number bigint, date_of_incident date")
    patterns = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id bigint")
    scores = score_patterns(patterns, df.drop("date_of_incident"), df.drop("pattern_id"), d(2024, 6, 30))
    got = {r["id"]: (r["recent_count"], r["baseline_count"], r["ratio"] and round(r["ratio"], 4), r["severity"]) for r in scores.collect()}
    assert got == {1: (2, 2, 6.0833, "high"), 2: (1, 0, None, None), 3: (0, 1, 0.0, "none"), 4: (0, 0, None, None)}
    assert scoring_report(scores).first().asDict() == {"patterns_scored": 4, "patterns_with_ratio": 2, "patterns_baseline_zero": 2}


@pytest.fixture(scope="module")
def inbox_data(spark):
    patterns = spark.createDataFrame(
        [
            (1, "a", 3, 1.0, "medium", "new", "novel"), (2, "b", 2, None, None, "new", "novel"),
            (3, "c", 9, 9.0, "high", "reviewed", "partially_covered"), (4, "d", 1, 5.0, "high", "new", "known"),
            (5, "e", 1, 1.5, "low", "new", "novel"), (6, "f", 1, 8.0, "high", "hidden", "novel"),
            (7, "g", 5, None, None, "new", "novel"),
        ],
        "id bigint, name string, member_count int, ratio double, severity string, state string, novelty_verdict string",
    ).withColumns({"recent_count": F.lit(0), "baseline_count": F.lit(0), "novelty_recall_ref": F.lit(None).cast("string")})
    members = spark.createDataFrame(
        [(1, 10, 0.9), (1, 11, 0.95), (1, 12, 0.95), (2, 20, 1.0), (3, 30, 1.0)],
        "pattern_id bigint, odi_number bigint, similarity double",
    )
    reports = spark.createDataFrame(
        [
            (10, "T", "B", ["X: 1"], ["X"], "raw ten", "ten"), (11, "T", "A", None, None, "eleven", None),
            (12, "T", "A", ["Y: 1", "X: 1"], ["X", "Y"], "twelve", None),
            (20, "T", "B", None, [], "twenty", None), (30, "T", "C", None, None, "x" * 50, None),
        ],
        "odi_number bigint, make string, model string, components array<string>, components_coarse array<string>, "
        "summary string, summary_stripped string",
    ).withColumns({"model_year": F.lit(2021), "date_of_incident": F.lit(None).cast("date")})
    return patterns, members, reports


def test_inbox(inbox_data):
    rows = views.inbox(*inbox_data).collect()
    assert [r["id"] for r in rows] == [1, 7, 2, 3]
    first, bare, empty = rows[0], rows[1], rows[2]
    assert (first["vehicle"], first["vehicles"], first["category"]) == ("T A", 2, "X")
    assert (bare["vehicle"], bare["vehicles"], bare["category"]) == (None, 0, None)
    assert (empty["vehicle"], empty["category"]) == ("T B", None)
    assert rows[3]["category"] == "UNCATEGORISED"
    assert [r["id"] for r in views.inbox(*inbox_data, limit=2).collect()] == [1, 7]
    every = views.inbox(*inbox_data, where=views.in_view(True, True), limit=None)
    assert every.count() == 7
    assert views.view_counts(inbox_data[0]).first()["total"] == 4
    assert views.pattern_detail(*inbox_data, pattern_id=6).first()["state"] == "hidden"
    assert [r["odi_number"] for r in views.member_listing(*inbox_data[1:], pattern_id=1).collect()] == [11, 12, 10]


def test_samples_and_names(inbox_data):
    _, members, reports = inbox_data
    got = {(r["pattern_id"], r["rank"]): r["text"] for r in views.sample_narratives(members, reports, 2, 5).collect()}
    assert got == {(1, 1): "eleve", (1, 2): "twelv", (2, 1): "twent", (3, 1): "xxxxx"}
    sizes = members.groupBy("pattern_id").agg(F.count("*").alias("member_count"))
    names = {r["pattern_id"]: r["name"] for r in provisional_names(members, sizes, reports).collect()}
    assert names == {1: "T A +1 other — X: 1", 2: "T B — uncategorised", 3: "T C — uncategorised"}


def test_recall_lookup(spark):
    patterns = spark.createDataFrame([(1, "C1"), (2, "GONE"), (3, None)], "id bigint, novelty_recall_ref string")
    recalls = spark.createDataFrame(
        [("C1", "T", "B", 2021, "p2"), ("C1", "T", "A", 2022, "p1")],
        "campaign_number string, make string, model string, model_year int, component string",
    ).withColumns({c: F.lit(None).cast("string") for c in ("summary", "consequence", "remedy")}).withColumn(
        "report_received_date", F.lit(None).cast("date"))
    got = {r["id"]: (r["found"], r["component"]) for r in views.recall_lookup(patterns, recalls).collect()}
    assert got == {1: (True, "p1"), 2: (False, None)}


# --- formation and assessment -----------------------------------------------------------


@pytest.fixture(scope="module")
def world(spark):
    rows = [(n, "T", "A" if n < 5 else "B", n != 9, [1.0, 0.01 * n] if n < 5 else [0.01 * n, 1.0]) for n in range(1, 11)]
    base = spark.createDataFrame(rows, "odi_number bigint, make string, model string, is_failure_report boolean, embedding_stripped array<float>")
    reports = base.drop("embedding_stripped").withColumns(
        {"components": F.array(F.lit("P: q")), "summary": F.concat(F.lit("text "), F.col("odi_number").cast("string")),
         "summary_stripped": F.lit(None).cast("string")})
    embeddings = base.select("odi_number", "embedding_stripped")
    recalls = spark.createDataFrame(
        [("R1", "T", "A", 2020, [1.0, 0.0]), ("R1", "T", "A", 2021, [0.0, 1.0]), ("R2", "T", "A", 2020, [0.5, 0.5]),
         ("R3", "t", "A", 2020, [1.0, 0.0]), ("R4", "T", "A", 2020, None)],
        "campaign_number string, make string, model string, model_year smallint, embedding array<float>",
    ).withColumns({"component": F.lit("P"), "summary": F.lit("s"), "consequence": F.lit(None).cast("string")})
    return reports, embeddings, recalls


def test_form_patterns(spark, world):
    reports, embeddings, _ = world
    patterns, members, report = form_patterns(reports, embeddings, now(), floor=0.9, cap=25, min_members=4)
    assert patterns.schema.names == TABLES["patterns"].schema.names
    got = [(r["id"], r["name"], r["member_count"], r["state"]) for r in patterns.orderBy("id").collect()]
    assert got == [(1, "T A — P: q", 4, "new"), (2, "T B — P: q", 5, "new")]
    assert {r["odi_number"] for r in members.collect()} == {1, 2, 3, 4, 5, 6, 7, 8, 10}
    assert report.first()["pool_size"] == 9
    none = reports.withColumn("is_failure_report", F.lit(None).cast("boolean"))
    assert form_patterns(none, embeddings, now()) is None


def members_of(spark):
    rows = [(1, n, 1.0) for n in range(1, 5)] + [(2, n, 1.0) for n in (5, 6, 7)]
    return spark.createDataFrame(rows, "pattern_id bigint, odi_number bigint, similarity double")


def test_shortlist(spark, world):
    reports, embeddings, recalls = world
    found = shortlist(members_of(spark), reports, embeddings, recalls.drop("embedding"), recalls)
    rows = found.orderBy("rank").collect()
    assert [(r["pattern_id"], r["campaign_number"], r["vehicle"]) for r in rows] == [(1, "R1", "T A 2020"), (1, "R2", "T A 2020")]
    asked = spark.createDataFrame([(1,), (2,), (5,)], "id bigint")
    patterns = spark.createDataFrame([(1, "one"), (2, "two")], "id bigint, name string")
    got = {r["pattern_id"]: (r["status"], r["candidate_count"]) for r in search_result(asked, patterns, members_of(spark), reports, found).collect()}
    assert got == {1: ("ok", 2), 2: ("ok", 0), 5: ("error", None)}


@pytest.mark.parametrize("answer, want", [
    ({"verdict": "known", "recall": "R1", "reason": "r"}, ("ok", "known", "R1", True)),
    ({"verdict": "novel", "recall": "R1", "reason": "r"}, ("ok", "novel", None, True)),
    ({"verdict": "maybe"}, ("error", None, None, None)),
    (None, ("error", None, None, None)),
])
def test_assess(spark, world, answer, want):
    reports, embeddings, recalls = world
    patterns = spark.createDataFrame(
        [(1, "one", 2.0, "partially_covered", "R9"), (2, "two", 1.0, None, None)],
        "id bigint, name string, ratio double, novelty_verdict string, novelty_recall_ref string",
    ).withColumn("updated_at", now())

    def judge(prompts):
        if answer is None:
            raise RuntimeError("endpoint down " + "x" * 300)
        assert all("R1 (T A 2020, P): s " in p and "- text" in p for p in prompts)
        return ["Well. " + json.dumps(answer) + " End" for _ in prompts]

    out = assess(patterns, members_of(spark), reports, embeddings, recalls.drop("embedding"), recalls, judge, now(),
                 source="tool", error_chars=160,
                 pattern_ids=spark.createDataFrame([(1,), (2,), (77,)], "id bigint"))
    rows = {r["id"]: r for r in out.results.collect()}
    assert (rows[1]["status"], rows[1]["verdict"], rows[1]["recall_ref"], rows[1]["changed"]) == want
    assert (rows[2]["verdict"], rows[2]["candidates_considered"], rows[2]["changed"]) == ("novel", 0, False)
    assert rows[77]["message"] == "no pattern with id 77"
    assert all(len(r["message"] or "") <= 160 for r in rows.values())
    if answer is None:
        whole = assess(patterns, members_of(spark), reports, embeddings, recalls.drop("embedding"), recalls, judge, now(),
                       pattern_ids=spark.createDataFrame([(1,)], "id bigint"))
        assert whole.results.first()["message"] == "endpoint down " + "x" * 300
    stored = {r["id"]: r["novelty_verdict"] for r in out.patterns.collect()}
    assert stored == {1: want[1] or "partially_covered", 2: "novel"}
    assert out.history.count() == (1 if want[0] == "ok" else 0)
    report = assessment_report(out.results).first()
    assert (report["no_candidates"], report["failed"]) == (1, 1 if want[0] == "ok" else 2)


def test_answers_are_kept_as_they_are_earned(spark, tmp_path):
    asked = spark.createDataFrame([(n, f"prompt {n}") for n in range(40)], "id bigint, prompt string")
    path, log = str(tmp_path / "answers"), str(tmp_path / "log")

    def judge(prompts):
        if any(p == "prompt 7" for p in prompts) and not os.path.exists(log + ".up"):
            raise RuntimeError("down")
        with open(log, "a") as f:
            f.writelines(p + "\n" for p in prompts)
        return [f"answer to {p}" for p in prompts]

    first = {r["id"]: r for r in ask_in_slices(asked, judge, path, 4).collect()}
    assert first[7]["error"] == "down" and first[8]["response"] == "answer to prompt 8" and len(first) == 40
    open(log + ".up", "w").close()
    again = {r["id"]: r["response"] for r in ask_in_slices(asked, judge, path, 4).collect()}
    assert again == {n: f"answer to prompt {n}" for n in range(40)}
    assert sorted(open(log).read().split("\n"))[1:] == sorted(f"prompt {n}" for n in range(40))
    changed = asked.withColumn("prompt", F.concat("prompt", F.lit("!")))
    assert {r["response"] for r in ask_in_slices(changed.filter("id = 3"), judge, path, 2).collect()} == {"answer to prompt 3!"}


def test_only_missing_and_limit(spark, world):
    reports, embeddings, recalls = world
    patterns = spark.createDataFrame(
        [(1, "one", 2.0, "known", "R9"), (2, "two", 1.0, None, None)],
        "id bigint, name string, ratio double, novelty_verdict string, novelty_recall_ref string",
    ).withColumn("updated_at", now())
    judge = lambda prompts: ['{"verdict":"known","recall":"R1"}'] * len(prompts)
    args = (patterns, members_of(spark), reports, embeddings, recalls.drop("embedding"), recalls, judge, now())
    assert [r["id"] for r in assess(*args).results.collect()] == [2]
    assert [r["id"] for r in assess(*args, only_missing=False, limit=1).results.collect()] == [1]


def test_precision(spark):
    df = spark.createDataFrame([(1, "known", True), (2, "known", False), (3, "novel", True)], "id bigint, verdict string, confirmed boolean")
    assert {r["verdict"]: r["precision"] for r in verdict_precision(df).collect()} == {"known": 0.5, "novel": 1.0}


def test_centroid_averages_raw_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 0.0])], "k bigint, e array<float>")
    got = {r["k"]: r["centroid"] for r in centroids(df, "k", "e").collect()}
    assert got[1] == pytest.approx([0.9486833, 0.3162278]) and got[2] == [0.0, 0.0]
    text = spark.createDataFrame([("[0.5,1e-1]",)], "t string").select(parse_vector(F.col("t")).alias("v"))
    assert text.first()["v"] == pytest.approx([0.5, 0.1])


# --- embedding -----------------------------------------------------------------------------


def test_embedding_resumes(spark, tmp_path):
    rows = spark.createDataFrame([(n, "t" * n) for n in range(1, 21)] + [(99, None)], "odi_number bigint, text string")
    empty = spark.createDataFrame([], "odi_number bigint, vector array<float>")
    call = lambda texts: [[float(len(t)), float(len(texts))] for t in texts]
    todo = pending_texts(rows, empty, ["odi_number"], F.col("text"), "vector")
    got = {r["odi_number"]: r["vector"] for r in embed(todo, ["odi_number"], call, partitions=2, chars=15).collect()}
    assert {k: v[0] for k, v in got.items()} == {n: float(min(n, 15)) for n in range(1, 21)}
    assert max(v[1] for v in got.values()) <= 8
    path = str(tmp_path / "vectors")
    embed_in_slices(todo.filter(F.col("odi_number") < 11), ["odi_number"], call, path, partitions=2, slices=3)
    stored = spark.read.parquet(path)
    rest = pending_texts(rows, stored, ["odi_number"], F.col("text"), "vector")
    assert rest.count() == 10
    embed_in_slices(rest, ["odi_number"], call, path, partitions=2, slices=2)
    stored = spark.read.parquet(path)
    assert pending_texts(rows, stored, ["odi_number"], F.col("text"), "vector").isEmpty()
    report = embedding_report(todo, stored, ["odi_number"]).first()
    assert (report["to_embed"], report["embedded"], report["written"], report["dim"]) == (20, 20, 20, 2)
    odd = stored.limit(3).withColumn("vector", F.array(F.lit(1.0).cast("float")))
    report = embedding_report(todo, stored.unionByName(odd), ["odi_number"]).first()
    assert (report["embedded"], report["written"], report["dim"]) == (20, 23, None)


class Status(Exception):
    def __init__(self, status):
        self.status = status


def test_retries():
    waits, refreshed, plan = [], [], [429, 503, 403, None]

    def call(texts):
        status = plan.pop(0)
        if status:
            raise Status(status)
        return [[1.0]]

    run = with_retries(call, refresh=lambda: refreshed.append(1), sleep=waits.append)
    assert run(["a"]) == [[1.0]] and len(waits) == 2 and refreshed == [1]
    with pytest.raises(Status):
        with_retries(lambda t: (_ for _ in ()).throw(Status(400)), sleep=waits.append)(["a"])
    with pytest.raises(RuntimeError):
        with_retries(lambda t: (_ for _ in ()).throw(Status(500)), attempts=3, cap=0.5, sleep=waits.append)(["a"])
    assert max(waits[2:]) <= 0.5


def test_shortlist_blocks_match_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    cars = [("T", "A"), ("T", "B")]
    reports, members, vectors = [], [], []
    for odi in range(60):
        reports.append((odi, *cars[rng.random() < 0.2]))
        members.append((odi % 12, odi, 1.0))
        vectors.append((odi, [float(x) for x in rng.normal(size=6)]))
    recalls = [
        (f"C{int(rng.integers(0, 15))}", *cars[rng.random() < 0.3], n, [float(x) for x in rng.normal(size=6)])
        for n in range(80)
    ]
    frame = spark.createDataFrame(
        recalls, "campaign_number string, make string, model string, model_year int, embedding array<double>"
    ).withColumns({c: F.lit(None).cast("string") for c in ("component", "summary", "consequence")})
    got = shortlist(
        spark.createDataFrame(members, "pattern_id bigint, odi_number bigint, similarity double"),
        spark.createDataFrame(reports, "odi_number bigint, make string, model string"),
        spark.createDataFrame(vectors, "odi_number bigint, embedding_stripped array<double>"),
        frame.drop("embedding"), frame, block_rows=4,
    )
    by_pattern = {}
    for r in got.orderBy("pattern_id", "rank").collect():
        by_pattern.setdefault(r["pattern_id"], []).append((r["campaign_number"], round(r["similarity"], 9)))
    for p in range(12):
        mine = [o for q, o, _ in members if q == p]
        mean = np.mean([vectors[o][1] for o in mine], axis=0)
        near = {}
        for c, mk, md, _, v in recalls:
            if (mk, md) in {reports[o][1:] for o in mine}:
                sim = float(mean @ v / np.linalg.norm(mean) / np.linalg.norm(v))
                near[c] = max(sim, near.get(c, -2.0))
        want = sorted(near.items(), key=lambda x: (-x[1], x[0]))[:5]
        assert by_pattern[p] == [(c, round(s, 9)) for c, s in want]
