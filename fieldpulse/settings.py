"""Fixed values and defaults. Every job takes these as arguments."""

from __future__ import annotations

# --- Fixed values: vehicle scope ---------------------------------------------

MODEL_YEARS = (2020, 2021, 2022, 2023, 2024)

MODELS = (
    ("FORD", "F-150"),
    ("CHEVROLET", "SILVERADO 1500"),
    ("RAM", "1500"),
    ("TOYOTA", "RAV4"),
    ("TOYOTA", "CAMRY"),
    ("HONDA", "CR-V"),
    ("HONDA", "CIVIC"),
    ("NISSAN", "ROGUE"),
    ("JEEP", "GRAND CHEROKEE"),
    ("TESLA", "MODEL 3"),
)

# --- Fixed values: positional columns of the delimited feed --------------------

FLAT_FIELDS = (
    "CMPLID", "ODINO", "MFR_NAME", "MAKETXT", "MODELTXT", "YEARTXT",
    "CRASH", "FAILDATE", "FIRE", "INJURED", "DEATHS", "COMPDESC",
    "CITY", "STATE", "VIN", "DATEA", "LDATE", "MILES", "OCCURENCES",
    "CDESCR", "CMPL_TYPE", "POLICE_RPT_YN", "PURCH_DT", "ORIG_OWNER_YN",
    "ANTI_BRAKES_YN", "CRUISE_CONT_YN", "NUM_CYLS", "DRIVE_TRAIN",
    "FUEL_SYS", "FUEL_TYPE", "TRANS_TYPE", "VEH_SPEED", "DOT", "TIRE_SIZE",
    "LOC_OF_TIRE", "TIRE_FAIL_TYPE", "ORIG_EQUIP_YN", "MANUF_DT",
    "SEAT_TYPE", "RESTRAINT_TYPE", "DEALER_NAME", "DEALER_TEL",
    "DEALER_CITY", "DEALER_STATE", "DEALER_ZIP", "PROD_TYPE", "REPAIRED_YN",
    "MEDICAL_ATTN", "VEHICLES_TOWED_YN", "STATE_OF_INCIDENT",
    "VEHICLE_OPERATOR",
)

FLAT_DATE = "yyyyMMdd"
REPORT_DATE = "M/d/yyyy"
RECALL_DATE = "d/M/yyyy"

# --- Fixed values: boilerplate sentences ---------------------------------------

BOILERPLATE = (
    # Hotline template
    r"^the contact (owns|leases|purchased)\b",
    r"\bthe (local )?dealer was (contacted|notified|made aware)\b",
    r"\bthe manufacturer was (not )?(made aware|notified|contacted)\b",
    r"\b(failure|approximate) mileage was\b",
    r"^the vehicle was not (repaired|diagnosed)",
    r"^the vehicle was (taken|towed) to (the|a) (local )?dealer",
    r"\bthe contact had not experienced a failure\b",
    r"\bthe contact (was|has been) (referred|advised)\b",
    r"\bparts distribution disconnect\b",
    r"\bvin tool confirms parts not available\b",
    r"\bthe manufacturer had exceeded a reasonable amount of time\b",
    r"\bthe vin was not available\b",
    r"^the contact (stated|reached out|received)\b.*\b(recall|remedy|parts)\b",
    # Administrative artefacts
    r"information redacted pursuant to the freedom of information act",
    r"^\W*\*?tr\W*$",
    r"^see attached document",
    r"\b(case|claim|reference) (number|#)\s*[:\-]?\s*\w+",
    r"\bvin\b\s*[:#]?\s*[a-hj-npr-z0-9]{9,}",
    # Complaint genre
    r"^i am (writing|reporting|filing|submitting) (this|a|to)\b",
    r"\b(i|we) (request|urge|ask|petition)\w*\s+(that\s+)?(the\s+)?nhtsa\b",
    r"\bnhtsa (to )?(investigate|look into|review)\b",
    r"\bplease (investigate|review|look into) (this|the)\b",
    r"\bthank you for your (attention|time|consideration)\b",
    r"^thank you\W*$",
    r"\bplease (feel free to )?contact me\b",
    r"\bi (would like to )?(formally )?report(ing)? (this|a|an)\b.*\b(defect|incident|issue)\b",
    r"\b(warrant|justif)\w*\s+(a\s+)?(recall|investigation|review)\b",
    r"\bi (believe|feel) this (should|warrants|merits)\b",
    r"\bi look forward to\b",
    r"^sincerely\W*",
    r"^(hello|dear)\b.*\bnhtsa\b",
)
MIN_USEFUL_CHARS = 40

NON_FAILURE_MARKERS = (
    r"\bhad not experienced a failure\b",
    r"\bdid not experience a failure\b",
)

# --- Fixed values: display labels ------------------------------------------------

CATEGORY_LABELS = {
    "AIR BAGS": "Air bags",
    "BACK OVER PREVENTION": "Backup camera / rear visibility",
    "ELECTRICAL SYSTEM": "Electrical system",
    "ENGINE": "Engine",
    "ENGINE AND ENGINE COOLING": "Engine & cooling",
    "EXTERIOR LIGHTING": "Exterior lighting",
    "FORWARD COLLISION AVOIDANCE": "Forward collision avoidance",
    "FUEL SYSTEM": "Fuel system",
    "FUEL/PROPULSION SYSTEM": "Fuel / propulsion system",
    "LANE DEPARTURE": "Lane departure warning",
    "LATCHES/LOCKS/LINKAGES": "Latches, locks & linkages",
    "POWER TRAIN": "Powertrain",
    "SEAT BELTS": "Seat belts",
    "SEATS": "Seats",
    "SERVICE BRAKES": "Brakes",
    "STEERING": "Steering",
    "STRUCTURE": "Body / structure",
    "SUSPENSION": "Suspension",
    "TIRES": "Tires",
    "UNKNOWN OR OTHER": "Uncategorised",
    "VEHICLE SPEED CONTROL": "Speed control / cruise control",
    "VISIBILITY": "Visibility",
    "VISIBILITY/WIPER": "Visibility / wipers",
    "WHEELS": "Wheels",
}
NO_CATEGORY = "UNCATEGORISED"
NO_BASELINE = "insufficient history"
NOVELTY_LABELS = {
    "novel": "novel",
    "partially_covered": "partly covered",
    "known": "known recall",
}

# --- Fixed values: retrieval, formation, scoring, assessment ----------------------

SIMILARITY_FLOOR = 0.78
NEIGHBOUR_CAP = 25
EMBEDDING_DIM = 1024
MIN_PATTERN_MEMBERS = 5
RECENT_DAYS = 60
BASELINE_DAYS = 365
SEVERITY = ((4.0, "high"), (2.0, "medium"), (1.0, "low"))
STATES = ("new", "reviewed", "hidden")
PAGE_SIZE = 50
VERDICTS = ("novel", "known", "partially_covered")
SHORTLIST_SIZE = 5
SAMPLE_SUMMARIES = 4
DETAIL_SUMMARIES = 5
SAMPLE_CHARS = 900
RECALL_SUMMARY_CHARS = 600
RECALL_CONSEQUENCE_CHARS = 300
EMBED_CHARS = 4000
EMBED_BATCH = 8
EMBED_ATTEMPTS = 10
EMBED_BACKOFF_CAP = 60.0

# --- Fixed values: documented ingest bounds ----------------------------------------

HISTORY_START = "2022-01-01"
HOLDBACK_DAYS = 30
EARLIEST_INCIDENT = "2000-01-01"
MIN_SUMMARY_CHARS = 40
