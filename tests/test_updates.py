import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fieldpulse.operators import merge
from fieldpulse.schema import TABLES, Table, cascade, conform, violations
from fieldpulse.sources.tables import load_snapshot, save_snapshot
from fieldpulse.streaming.incremental import snapshot_changes


def now():
    return F.lit("2024-05-01 00:00:00").cast("timestamp")


def complaints(spark, rows):
    return conform(
        spark.createDataFrame(
            rows, "odi_number bigint, components array<string>, components_coarse array<string>, source string, "
            "summary string, summary_stripped string, is_failure_report boolean"
        ),
        "complaints",
    )


def delivery(spark, rows):
    return spark.createDataFrame(rows, "odi_number bigint, components_coarse array<string>, summary string")


def test_api_upsert(spark):
    old = complaints(spark, [(1, ["A: x"], ["A"], "flat", "s", "t", True), (2, None, None, "api", "s", None, None),
                             (9, ["K"], ["K"], "flat", "keep", None, False)])
    new = delivery(spark, [(1, ["A"], "n"), (2, ["A"], "n"), (3, ["B"], "n")])
    once = merge.upsert_api(old, new, now())
    rows = {r["odi_number"]: r for r in once.collect()}
    assert rows[1]["components"] == ["A: x"] and rows[1]["source"] == "api" and rows[1]["summary"] == "n"
    assert rows[1]["summary_stripped"] == "t" and rows[1]["is_failure_report"] is True
    assert rows[2]["components"] == ["A"]
    assert rows[3]["components"] is None and rows[3]["components_coarse"] == ["B"]
    assert rows[9]["summary"] == "keep" and rows[9]["ingested_at"] is None
    again = merge.upsert_api(once, new, now())
    third = {r["odi_number"]: r for r in again.collect()}
    # The second delivery finds the row stored, so the coarse form fills its empty components.
    assert third[3]["components"] == ["B"]
    assert {k: v for k, v in third.items() if k != 3} == {k: v for k, v in rows.items() if k != 3}
    assert merge.upsert_api(again, new, now()).exceptAll(again).isEmpty()


def test_flat_upsert_overwrites_components(spark):
    old = complaints(spark, [(1, ["A: x"], ["A"], "api", "s", "t", True)])
    new = spark.createDataFrame([(1, ["B: y"], ["B"])], "odi_number bigint, components array<string>, components_coarse array<string>")
    row = merge.upsert_flat(old, new, now()).first()
    assert (row["components"], row["source"], row["summary"]) == (["B: y"], "flat", "s")


def test_vector_upsert_keeps_the_other_vector(spark):
    old = conform(spark.createDataFrame([(1, [1.0], "m")], "odi_number bigint, embedding array<float>, model string"), "complaint_embeddings")
    new = spark.createDataFrame([(1, [2.0]), (2, [3.0])], "odi_number bigint, vector array<float>")
    rows = {r["odi_number"]: r for r in merge.upsert_vector(old, new, "embedding_stripped", "m2", now()).collect()}
    assert (rows[1]["embedding"], rows[1]["embedding_stripped"], rows[1]["model"]) == ([1.0], [2.0], "m2")
    assert (rows[2]["embedding"], rows[2]["embedding_stripped"]) == (None, [3.0])
    left = merge.missing_vectors(spark.range(1, 4).withColumnRenamed("id", "odi_number"), old, ["odi_number"], "embedding")
    assert sorted(r[0] for r in left.collect()) == [2, 3]


def test_verdict_audit(spark):
    stored = spark.createDataFrame(
        [(1, None, None), (2, "novel", None), (3, "novel", None), (4, "known", "R1"), (5, "known", "R1")],
        "id bigint, novelty_verdict string, novelty_recall_ref string",
    ).withColumn("updated_at", F.lit(None).cast("timestamp"))
    new = spark.createDataFrame(
        [(1, "novel", None), (2, "novel", None), (3, "known", "R1"), (4, "known", "R2"), (99, "novel", None)],
        "id bigint, verdict string, recall_ref string",
    )
    updated, history, unknown = merge.write_verdicts(stored, new, "batch", now())
    assert sorted((r["pattern_id"], r["old_verdict"], r["new_verdict"], r["new_recall_ref"]) for r in history.collect()) == [
        (3, "novel", "known", "R1"), (4, "known", "known", "R2")]
    rows = {r["id"]: r for r in updated.collect()}
    assert rows[2]["updated_at"] is not None and rows[5]["updated_at"] is None
    assert (rows[4]["novelty_recall_ref"], rows[5]["novelty_recall_ref"]) == ("R2", "R1")
    assert [r["id"] for r in unknown.collect()] == [99]
    stored_history = conform(spark.createDataFrame([(7, 3)], "id bigint, pattern_id bigint"), "novelty_history")
    grown = merge.append_history(stored_history, history)
    assert sorted((r["id"], r["pattern_id"]) for r in grown.collect()) == [(7, 3), (8, 3), (9, 4)]
    assert conform(grown, "novelty_history").count() == 3
    assert [r["id"] for r in merge.append_history(stored_history.limit(0), history).orderBy("id").collect()] == [1, 2]


def test_a_key_that_is_delivered_twice_fails_the_update(spark):
    stored = spark.createDataFrame([(1, "a")], "id bigint, x string")
    twice = spark.createDataFrame([(1, "b"), (1, "c"), (2, "d")], "id bigint, x string")
    with pytest.raises(Exception, match="more than one row for the key 1"):
        merge.upsert(stored, twice, ["id"]).collect()
    assert merge.upsert(stored, twice.filter("x <> 'c'"), ["id"]).count() == 2
    patterns = stored.selectExpr("id", "x as novelty_verdict", "x as novelty_recall_ref").withColumn("updated_at", now())
    with pytest.raises(Exception, match="more than one row"):
        merge.write_verdicts(patterns, twice.selectExpr("id", "x as verdict", "x as recall_ref"), "batch", now())[0].collect()


def test_last_state_wins(spark):
    ts = lambda h: dt.datetime(2024, 1, 1, h)
    stored = spark.createDataFrame([(1, "new"), (2, "hidden")], "id bigint, state string").withColumn("updated_at", now())
    events = spark.createDataFrame(
        [(1, "reviewed", ts(1), 1), (1, "hidden", ts(2), 2), (1, "new", ts(2), 3), (7, "new", ts(1), 1)],
        "id bigint, state string, at timestamp, seq bigint",
    )
    after = merge.apply_states(stored, events)
    assert {r["id"]: r["state"] for r in after.collect()} == {1: "new", 2: "hidden"}
    assert snapshot_changes(stored, after, "id", ["state"]).isEmpty()


def test_classification_touches_only_nulls(spark):
    df = spark.createDataFrame([(1, "broke", None), (2, None, None), (3, "broke", False)], "odi_number bigint, summary string, is_failure_report boolean")
    counts = merge.classification_counts(df).first().asDict()
    assert counts == {"classified": 2, "failure_report": 1, "non_failure_report": 1}
    done = merge.classify_missing(df)
    assert {r[0]: r["is_failure_report"] for r in done.collect()} == {1: True, 2: False, 3: False}
    assert merge.classification_counts(done).first()["classified"] == 0


def test_schema_registry(spark, tmp_path):
    df = spark.createDataFrame([(1, "p")], "id int, name string")
    rows = conform(df, "patterns")
    assert rows.schema.names == TABLES["patterns"].schema.names
    assert rows.first()["state"] == "new" and rows.first()["member_count"] == 0
    assert conform(rows, "patterns").collect() == rows.collect()
    with pytest.raises(ValueError):
        conform(df.withColumn("vin", F.lit(1)), "patterns")
    with pytest.raises(ValueError):
        conform(df.drop("id"), "patterns")
    save_snapshot(df, str(tmp_path), "patterns", 1)
    save_snapshot(df.withColumn("name", F.lit("q")), str(tmp_path), "patterns", 2)
    assert load_snapshot(spark, str(tmp_path), "patterns").first()["name"] == "q"
    assert load_snapshot(spark, str(tmp_path), "patterns", 1).first()["name"] == "p"


def test_a_version_without_its_marker_is_not_read_and_can_be_written_again(spark, tmp_path):
    root = str(tmp_path)
    rows = lambda name: spark.createDataFrame([(1, name)], "id int, name string")
    with pytest.raises(ValueError):
        load_snapshot(spark, root, "patterns")
    save_snapshot(rows("one"), root, "patterns", 1)
    conform(rows("half"), "patterns").write.parquet(f"{root}/patterns/version=2")
    assert load_snapshot(spark, root, "patterns").first()["name"] == "one"
    save_snapshot(rows("two"), root, "patterns", 2)
    assert [r["name"] for r in load_snapshot(spark, root, "patterns").collect()] == ["two"]
    with pytest.raises(ValueError):
        save_snapshot(rows("again"), root, "patterns", 2)
    save_snapshot(rows("three"), root, "patterns", 3, keep=2)
    with pytest.raises(ValueError):
        load_snapshot(spark, root, "patterns", 1)
    assert not (tmp_path / "patterns" / "version=1").exists()
    assert load_snapshot(spark, root, "patterns", 2).first()["name"] == "two"


def test_integrity(spark):
    members = spark.createDataFrame([(1, 10, 1.0), (1, 10, 1.0), (2, 10, 0.9), (3, 11, None)], TABLES["pattern_members"].columns)
    frames = {
        "pattern_members": members,
        "patterns": spark.createDataFrame([(1,), (2,)], "id bigint"),
        "complaints": spark.createDataFrame([(10,)], "odi_number bigint"),
    }
    got = {(r["rule"], r["key"], r["n"]) for r in violations("pattern_members", frames).collect()}
    assert got == {
        ("primary_key:pattern_id,odi_number", "1|10", 2), ("unique:odi_number", "10", 3),
        ("not_null:similarity", "3|11", 1), ("foreign_key:pattern_id->patterns", "3", 1),
        ("foreign_key:odi_number->complaints", "11", 1),
    }
    kept = cascade(members, ("pattern_id",), frames["patterns"], ("id",))
    assert kept.count() == 3


def test_keys_are_counted_in_tasks_that_follow_the_rows(spark):
    """Rows go to tasks by key before they are counted; merged tasks held the keys of all of them."""
    child = Table("child", "a bigint, b bigint", key=("a", "b"), required=("c",), unique=(("c",),), parents=((("a",), "parent", ("k",)),))
    rows = [(n % 40 if n else None, n % 3, n // 2 if n % 7 else None) for n in range(120)] + [(1, 1, 999), (1, 1, 999)]
    frames = {
        "child": spark.createDataFrame(rows, "a bigint, b bigint, c bigint"),
        "parent": spark.createDataFrame([(n % 35,) for n in range(90)], "k bigint"),
    }
    text = lambda *key: "|".join("" if k is None else str(k) for k in key)
    want = {("primary_key:a,b", text(*k), n) for k, n in Counter(r[:2] for r in rows).items() if n > 1}
    want |= {("unique:c", text(k), n) for k, n in Counter(r[2] for r in rows).items() if n > 1}
    want |= {("not_null:c", text(*k), n) for k, n in Counter(r[:2] for r in rows if r[2] is None).items()}
    want |= {("not_null:a", text(None, 0), 1)}
    want |= {("foreign_key:a->parent", text(k), n) for k, n in Counter(r[0] for r in rows).items() if k is not None and k >= 35}
    found = violations("child", frames, {"child": child}, dealt_rows=10)
    got = [(r["rule"], r["key"], r["n"]) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("13), REPARTITION_BY_NUM") >= 5 and "ENSURE_REQUIREMENTS" not in plan
