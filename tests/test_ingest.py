import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from fieldpulse import settings
from fieldpulse.operators.normalise import (
    accepted,
    ingest_bounds,
    normalise_recalls,
    normalise_reports,
    reject_counts,
)
from fieldpulse.sources import flat, landed

FIELDS = settings.FLAT_FIELDS


def flat_line(**values):
    return "\t".join(values.get(f, "") for f in FIELDS)


def test_flat_scan_and_collapse(spark, tmp_path):
    base = dict(ODINO="10", MAKETXT="Acme", MODELTXT="Z-9 HYBRID", YEARTXT="2021", CRASH="", FIRE="Y",
                FAILDATE="20221399", LDATE="20230105", INJURED="x", DEATHS="1", PROD_TYPE="V",
                VIN="1SECRET", CDESCR='It said "stop\' é')
    lines = [
        flat_line(**base, COMPDESC=" BRAKES: HYDRAULIC "),
        flat_line(**base, COMPDESC="BRAKES: ABS"),
        flat_line(**base, COMPDESC="BRAKES: ABS"),
        flat_line(**{**base, "ODINO": "11", "MODELTXT": "Z-90"}, COMPDESC="A"),
        flat_line(**{**base, "ODINO": "12", "PROD_TYPE": "T"}, COMPDESC="A"),
        flat_line(**{**base, "ODINO": "13", "YEARTXT": "2o21"}, COMPDESC="A"),
        flat_line(**{**base, "ODINO": "14", "CDESCR": ""}, COMPDESC="A"),
        flat_line(**{**base, "ODINO": "15", "MODELTXT": "z-9"}, COMPDESC="A"),
    ]
    path = tmp_path / "feed.txt"
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    raw = flat.read_flat(spark, str(path))
    assert len(raw.columns) == 51
    rows = {r["odi_number"]: r for r in flat.collapse(raw, [("ACME", "Z-9")], [2020, 2021]).collect()}
    assert set(rows) == {10, 15}
    r = rows[10]
    assert r["components"] == ["BRAKES: ABS", "BRAKES: HYDRAULIC"]
    assert r["components_coarse"] == ["BRAKES"]
    assert r["summary"] == 'It said "stop\' é'
    assert (r["date_of_incident"], r["date_complaint_filed"]) == (None, dt.date(2023, 1, 5))
    assert (r["crash"], r["fire"], r["injuries"], r["deaths"]) == (None, True, None, 1)
    assert "VIN" not in {c.upper() for c in rows[10].asDict()}
    written = flat.collapse(raw, [("ACME", "Z-9")], [2020, 2021])
    got = flat.funnel(raw, [("ACME", "Z-9")], [2020, 2021], written=written).first().asDict()
    lost = flat.funnel(raw, [("ACME", "Z-9")], [2020, 2021], written=written.limit(0)).first().asDict()
    assert lost == got | {"written": 0}
    assert got == {"rows_loaded": 8, "rows_vehicles": 7, "rows_scoped": 5, "complaints_deduped": 2, "written": 2}


def land(spark, records, **key):
    key = {"make": "acme", "query_model": "Z-9", "model_year": 2021, **key}
    rows = [(*key.values(), 200, json.dumps({"count": 1, "results": records}))]
    return spark.createDataFrame(rows, "make string, query_model string, model_year int, status int, body string")


def car(make="Acme", model=" Z-9 ", year="2021", kind="Vehicle"):
    return {"type": kind, "productMake": make, "productModel": model, "productYear": year}


GOOD = {"summary": " It broke ", "products": [car(kind="Tire"), car(), car(model="Q")],
        "dateOfIncident": "1/2/2022", "dateComplaintFiled": "02/03/2022", "components": None}


@pytest.mark.parametrize(
    "change, reason",
    [
        ({"odiNumber": None, "summary": ""}, "missing_odi_number"),
        ({"odiNumber": "12"}, "missing_odi_number"),
        ({"summary": "  "}, "summary_missing"),
        ({"products": [car(kind="Tire")]}, "no_vehicle_attribution"),
        ({"products": None}, "no_vehicle_attribution"),
        ({"products": [car(year="20x2")]}, "no_vehicle_attribution"),
        ({"products": [car(make="Other")]}, "no_vehicle_attribution"),
        ({"dateOfIncident": "13/45/2022"}, "incident_date_unparseable"),
        ({"dateOfIncident": 20220101}, "incident_date_unparseable"),
        ({"dateOfIncident": "", "dateComplaintFiled": "x"}, "filed_date_unparseable"),
        ({}, None),
    ],
)
def test_report_rejects(spark, change, reason):
    record = {"odiNumber": 1, **GOOD, **change}
    records = landed.open_envelope(land(spark, [record]), landed.REPORT_RECORD, "make")
    row = normalise_reports(records).first()
    assert row["reject_reason"] == reason
    if reason is None:
        assert (row["odi_number"], row["make"], row["model"], row["model_year"]) == (1, "acme", "Z-9", 2021)
        assert (row["summary"], row["components_coarse"]) == ("It broke", [])
        assert (row["date_of_incident"], row["date_complaint_filed"]) == (dt.date(2022, 1, 2), dt.date(2022, 2, 3))


def test_valid_and_rejects_cover_the_input(spark):
    records = [{"odiNumber": n if n % 3 else None, **GOOD} for n in range(9)]
    rows = normalise_reports(landed.open_envelope(land(spark, records), landed.REPORT_RECORD, "make"))
    assert accepted(rows).count() + reject_counts(rows).agg(F.sum("n")).first()[0] == 9


@pytest.mark.parametrize(
    "record, want",
    [
        ({"NHTSACampaignNumber": " "}, "missing_campaign_number"),
        ({"NHTSACampaignNumber": "C", "ReportReceivedDate": "02/16/2022"}, "report_date_unparseable"),
        ({"NHTSACampaignNumber": "C", "ModelYear": "20x2"}, "model_year_invalid"),
        ({"NHTSACampaignNumber": " C ", "Model": " q ", "ModelYear": "0", "ReportReceivedDate": "16/02/2022"},
         ("C", "ACME", "Q", 2021, dt.date(2022, 2, 16))),
        ({"NHTSACampaignNumber": "C", "Make": " ", "Model": "", "ModelYear": "2019"},
         ("C", "", "Z-9", 2019, None)),
    ],
)
def test_recalls(spark, record, want):
    rows = land(spark, [record]).withColumnRenamed("query_model", "model")
    row = normalise_recalls(
        landed.open_envelope(rows, landed.RECALL_RECORD, "make", "model", "model_year")
    ).first()
    if isinstance(want, str):
        assert row["reject_reason"] == want
    else:
        assert row["reject_reason"] is None
        assert tuple(row[c] for c in ("campaign_number", "make", "model", "model_year", "report_received_date")) == want


def test_triage_trusts_the_status_only(spark):
    ok = '{"count":0,"message":"Results returned successfully","results":[]}'
    rows = [(200, ok), (400, ok), (503, ok), (200, "<html>"), (200, '{"count":1}'), (200, "x" * 500), (None, ok)]
    frame = spark.createDataFrame(rows, "status int, body string")
    got = landed.triage(frame).collect()
    assert [r["failure"] for r in got] == [None, "client_error", "server_error", "not_json", "no_results", "not_json", "no_status"]
    assert [r["retryable"] for r in got] == [False, False, True, False, False, False, False]
    assert got[5]["message"] == "not_json status 200 " + "x" * 500
    assert max(len(r["message"] or "") for r in landed.triage(frame, message_chars=120).collect()) == 120
    assert landed.opened(frame, landed.REPORT_RECORD, "status").filter("failure is null").count() == 1


def test_landing_folder_keys_come_from_the_path(spark, tmp_path):
    folder = tmp_path / "make=RAM" / "query_model=1500" / "model_year=2021"
    folder.mkdir(parents=True)
    (folder / "r.json").write_text(json.dumps({"status": 200, "body": '{"results":[{"odiNumber":5}]}'}))
    rows = landed.open_envelope(
        landed.read_landing(spark, str(tmp_path)), landed.REPORT_RECORD, "make", "query_model", "model_year"
    ).collect()
    assert [(r["make"], r["query_model"], r["model_year"], r["record"]["odiNumber"]) for r in rows] == [
        ("RAM", "1500", 2021, 5)
    ]


def test_pages(spark):
    page = lambda total, n: json.dumps({"meta": {"pagination": {"total": total}}, "results": [{"a": 1}] * n})
    rows = [("whole", page(3, 2)), ("whole", page(3, 1)), ("short", page(3, 2)), ("ended", page(None, 2)),
            ("ended", page(None, 0)), ("open", page(None, 2))]
    got = landed.page_completeness(spark.createDataFrame(rows, "feed string, body string")).collect()
    assert {r["feed"]: r["complete"] for r in got} == {"whole": True, "short": False, "ended": True, "open": False}


def test_discovery(spark):
    models = spark.createDataFrame([("FORD", "F-150"), ("RAM", "1500")], "make string, model string")
    listing = spark.createDataFrame(
        [(0, "2021", "FORD", "F-150  SUPER CREW"), (1, "2021", "FORD", "F-150"), (2, "2021", "FORD", "F-150"),
         (3, "2021", "FORD", "F-250"), (4, None, "RAM", None)],
        "ord int, modelYear string, make string, model string",
    )
    unique = landed.distinct_listing(listing)
    assert sorted(r["ord"] for r in unique.collect()) == [0, 1, 3, 4]
    keys, gaps = landed.discover(landed.work_list(models, [2021]), listing)
    assert sorted(r["query_model"] for r in keys.collect()) == ["F-150", "F-150  SUPER CREW"]
    assert [tuple(r) for r in gaps.select("make", "model", "model_year").collect()] == [("RAM", "1500", 2021)]


def test_bounds(spark):
    d = dt.date
    rows = [(d(2023, 1, 1), d(2023, 2, 1), "x" * 40, None), (d(2023, 1, 1), d(2021, 12, 31), "x" * 40, "before_history"),
            (d(2023, 1, 1), d(2023, 6, 2), "x" * 40, "held_back"), (d(1999, 12, 31), d(2023, 2, 1), "x" * 40, "implausible_incident_date"),
            (None, None, "x" * 39, "summary_too_short")]
    df = spark.createDataFrame(rows, "date_of_incident date, date_complaint_filed date, summary string, want string")
    for r in ingest_bounds(df, "2023-07-01").collect():
        assert r["bound"] == r["want"]
