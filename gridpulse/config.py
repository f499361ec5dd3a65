"""Configuration and fixed values.

Everything that the reference hard-codes but that a deployment changes
(project list, the project whose last SAT stage is 9, run dates) lives in
:class:`Config`. The fixed value tables below must equal the reference's
for results to agree.
"""
from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's; stated plainly, in natural order)
# ---------------------------------------------------------------------------

# Meter-type code -> consumer sub-category (13 codes).
CONSUMER_SUBCATEGORY_MAP = {
    "1PH-STSM": "1PH-Consumer_meter",
    "NBSM-1PH": "1PH-Consumer_meter",
    "NSM1-PH": "1PH-Consumer_meter",
    "3PH-STSM": "3PH-Consumer_meter",
    "3PNBLTSM": "3PH-Consumer_meter",
    "NBSM-3PH": "3PH-Consumer_meter",
    "NSM3-PH": "3PH-Consumer_meter",
    "3LTTOUSM": "3PH-Consumer_meter",
    "HTNBTOUS": "3PH-Consumer_meter",
    "HT-TOUSM": "3PH-Consumer_meter",
    "LT-NBTOUS": "3PH-Consumer_meter",
    "3PLTCTSM": "LTCT-Consumer_meter",
    "HTCTPTSM": "HTCT-Consumer_meter",
}
METER_TYPE_CODES = list(CONSUMER_SUBCATEGORY_MAP)
CONSUMER_SUB_KEYS = [
    "1PH-Consumer_meter",
    "3PH-Consumer_meter",
    "LTCT-Consumer_meter",
    "HTCT-Consumer_meter",
]
# Substring rule used by the SAT-invoice dashboard only, tested in this order.
CONSUMER_SUBSTRING_RULES = [
    ("1PH", "1PH-Consumer_meter"),
    ("3PH", "3PH-Consumer_meter"),
    ("LTCT", "LTCT-Consumer_meter"),
    ("HTCT", "HTCT-Consumer_meter"),
]
CATEGORY_KEYS = ["CONSUMER", "FEEDER", "DT"]
CATEGORY_INPUTS = ("total", "consumer", "feeder", "dt", "dtr")
CATEGORY_INPUT_MAP = {"consumer": "CONSUMER", "feeder": "FEEDER", "dt": "DT"}

# Category fallback when connection_type is null.
DT_FALLBACK_METERTYPE = "3PLTCTSM"
FEEDER_FALLBACK_METERTYPE = "HTCTPTSM"

# Defect classification of complaint types.
BURNT_TYPES = [
    "Meter burnt",
    "Meter Sparking or Sparking at Meter terminal",
    "Meter Terminal Burnt",
]
FAULTY_TYPE = "Meter faulty or not working"
DEFECT_BURNT = "Meter Burnt"
DEFECT_FAULTY = "Meter Faulty"
DEFECT_OTHERS = "Others"

# Complaint source patterns (case-insensitive LIKE).
SOURCE_AUTO_PATTERN = "%auto%ticketing%"
SOURCE_HELPDESK_PATTERN = "%1912%helpdesk%"

# Ageing classes.
STOCK_AGE_BOUNDS = [30, 60, 90]                 # <=30, 31-60, 61-90, >90 (days, inclusive upper)

# Comparison levels.
LEVEL_TYPOS = {"divison": "division", "subdivison": "subdivision"}

MIDIM = ["project", "discom", "zone", "circle", "division", "subdivision",
         "substation", "feeder", "dtr", "new_meter_type", "meter_category"]
OMDIM = ["project", "discom", "zone", "circle", "division", "subdivision",
         "substation", "feeder", "dtr", "meter_category"]
GEO5 = ["discom", "zone", "circle", "division", "subdivision"]

SAT_STAGES = list(range(1, 10))


@dataclass(frozen=True)
class Config:
    """Deployment parameters. Defaults bind the test fixtures (FIXTURES.md §3)."""

    projects: tuple = ("AFRICA", "AMERICA", "ASIA")
    stage9_project: str = "AFRICA"
    meter_as_of: dt.date = dt.date(2001, 8, 1)
    complaint_as_of: dt.datetime = dt.datetime(2024, 1, 31, 0, 0, 0)


DEFAULT = Config()
