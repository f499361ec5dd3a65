"""Property tests: the Column rules agree with plain-Python statements of the
same rules on random inputs (one Spark job per example batch)."""
import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st

from gridpulse import config as C
from gridpulse.functions import columns as X
from gridpulse.functions import predicates as P
from gridpulse.schemas import METERS, rows_to_df

TEXT = st.one_of(st.none(), st.sampled_from(["", " ", " dt ", "Feeder", "consumer", "SAT-1", "sat-10", "SAT Pending",
                                             " SAT-9 ", "x"]))
MTYPE = st.one_of(st.none(), st.sampled_from(C.METER_TYPE_CODES + ["OTHER"]))


def py_category(conn, mtype, cons):
    if conn is not None:
        return conn.strip(" ").upper()
    blank = cons is None or cons.strip(" ") == ""
    if mtype == "3PLTCTSM" and blank:
        return "DT"
    if mtype == "HTCTPTSM" and blank:
        return "FEEDER"
    return "CONSUMER"


def py_stage(sat):
    if sat is None:
        return None
    s = sat.strip(" ").lower()
    for k in range(1, 10):
        if s.startswith(f"sat-{k}"):
            return f"s{k}"
    return None


def py_installed(mi, sat):
    return mi is not None and sat is not None and sat.strip(" ") != ""


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(TEXT, MTYPE, TEXT, TEXT, st.booleans()), min_size=1, max_size=40))
def test_row_rules_match_python(spark, rows):
    data = [{"connection_type": a, "metertype": b, "consumerno": c, "sat_no": d,
             "mi_date": dt.date(2000, 1, 1) if e else None} for a, b, c, d, e in rows]
    df = rows_to_df(spark, METERS, data)
    got = df.select(X.meter_category().alias("c"), X.sat_stage().alias("s"),
                    P.verified_installation().alias("i")).collect()
    for r, (a, b, c, d, e) in zip(got, rows):
        assert r.c == py_category(a, b, c)
        assert r.s == py_stage(d)
        assert r.i == py_installed(dt.date(2000, 1, 1) if e else None, d)
