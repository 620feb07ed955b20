import pytest
from pyspark.sql import functions as F

from fieldpulse import settings
from fieldpulse.functions import text as X
from fieldpulse.functions.labels import category_label, ratio_label, severity
from fieldpulse.plans.novelty import parse_verdict


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr(F.col("c")).alias("r")).first()["r"]


RULES = (r"^note:", r"\bthanks\b")


@pytest.mark.parametrize(
    "text, expected",
    [
        (
            "Note: x. The brake pedal sinks to the floor at speed every day. Thanks!",
            ("The brake pedal sinks to the floor at speed every day.", False),
        ),
        ("  Note: x. Bad. ", ("Note: x. Bad.", True)),
        ("Note: x. " + "a" * 39, ("Note: x. " + "a" * 39, True)),
        ("Note: x. " + "a" * 40, ("a" * 40, False)),
        ("", ("", False)),
        (None, ("", False)),
        (" Kept text  with \n odd   spaces and enough characters.", ("Kept text with odd spaces and enough characters.", False)),
    ],
)
def test_strip_boilerplate(spark, text, expected):
    got = one(spark, lambda c: X.strip_boilerplate(c, RULES), text)
    assert (got["text"], got["fell_back"]) == expected


@pytest.mark.parametrize(
    "sentence, dropped",
    [
        ("The contact owns a 2021 model.", True),
        ("And the contact owns a 2021 model.", False),
        ("The local dealer was notified.", True),
        ("  *TR", True),
        ("trouble", False),
        ("VIN: 1FTEW1EP5JF123456", True),
        ("My vin was lost", False),
        ("I am writing to you", True),
        ("We urge that the NHTSA act", True),
        ("Thank you.", True),
        ("This warrants a recall", True),
        ("The engine stalls.", False),
        ("", True),
    ],
)
def test_standard_rules(spark, sentence, dropped):
    kept = one(spark, X.kept_sentences, sentence)
    assert (kept == []) is dropped


def test_shared_anchor_means_the_same():
    import re

    rules = (r"^a|b", r"^(c|d)\b", r"\be(f|g)", r"h[|]i", r"\bj\|k")
    joined = X.any_of(rules).removeprefix("(?iUd)")
    for probe in ("a", "xb", "c", "xc", "ef", "xef", "h|i", "j|k", "xj|k", "j"):
        want = any(re.search(r, probe, re.I) for r in rules)
        assert bool(re.search(joined, probe, re.I)) == want, probe


def test_failure_report(spark):
    rows = {
        None: False,
        "": False,
        " ": True,
        "Brakes failed": True,
        "The contact HAD NOT experienced a failure.": False,
        "xhad not experienced a failure": True,
        "éhad not experienced a failure": True,
        "they did not experience a failure": False,
    }
    for text, want in rows.items():
        assert one(spark, X.is_failure_report, text) is want, text


def test_every_rule_is_stated_once():
    assert len(settings.BOILERPLATE) == len(set(settings.BOILERPLATE)) == 31
    assert len(settings.CATEGORY_LABELS) == 24
    assert len(settings.FLAT_FIELDS) == 51


def test_variant(spark):
    rows = [("Z-9", n) for n in ("Z-9", "z 9", "Z  9 SUPER", "Z9", "Z-90", None)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in df.select(X.names_variant(F.col("a"), F.col("b"))).collect()]
    assert got == [True, True, True, False, False, None]


def test_lists(spark):
    assert one(spark, X.split_list, "B, A,,A ") == ["A", "B"]
    assert one(spark, X.split_list, None) == []
    assert one(spark, X.coarse_components, ["BRAKES: ABS", "BRAKES: X", "AIR"], "array<string>") == ["AIR", "BRAKES"]


def test_labels(spark):
    assert one(spark, category_label, "FUEL/PROPULSION SYSTEM") == "Fuel / propulsion system"
    assert one(spark, category_label, "CHILD SEAT/O'REILLY 2ND") == "Child Seat/O'Reilly 2Nd *"
    assert one(spark, category_label, "") == "Uncategorised"
    assert one(spark, category_label, None) == "Uncategorised"
    for value in (1.125, 2.675, 1.005, 0.0, 1234.5, 1.115, 6.0833):
        assert one(spark, ratio_label, value, "double") == f"{value:.2f}×"
    assert one(spark, ratio_label, None, "double") == "insufficient history"
    edges = {4.0: "high", 3.999: "medium", 2.0: "medium", 1.0: "low", 0.999: "none", 0.0: "none", None: None}
    for value, want in edges.items():
        assert one(spark, severity, value, "double") == want


def test_parse_verdict(spark):
    rows = {
        'Sure. {"verdict":"known","recall":"R1"} ok': ("known", "R1", None),
        '{"verdict":"novel","recall":"R1"}': ("novel", None, None),
        '{"verdict":"known","recall":""}': ("known", None, None),
        '{"verdict":"maybe"}': (None, None, "unknown verdict"),
        "no object": (None, None, "no JSON in response"),
        "{broken": (None, None, "unknown verdict"),
        None: (None, None, "no response"),
    }
    for text, want in rows.items():
        got = one(spark, parse_verdict, text)
        assert (got["verdict"], got["recall"], got["error"]) == want, text
