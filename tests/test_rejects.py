"""Rejects of file reads (S5, S11): nothing vanishes, every reason is named."""
import pytest

from gridpulse.sources import rejects as RJ
from gridpulse.sources.versions import VersionedStore


def write(folder, **files):
    folder.mkdir()
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


def test_complaint_files(spark, tmp_path):
    head = "TicketId,CreatedDate,ClosedDate\n"
    path = write(tmp_path / "in", a=head + "1,2024-01-01 10:00:00,\n2,01-13-2024,2024-01-02\n3,2024-01-01\n", b=head + '4,2024-01-01,x,y\n5,no,never\n"6, q",2024-02-01,02/03/2024\n')
    rows = RJ.read_strings(spark, path)
    q = RJ.Quarantine(VersionedStore(spark, str(tmp_path / "s")), "t").write(rows, RJ.complaint_reasons(rows))
    assert sorted(r.TicketId for r in q.kept().collect()) == ["1", "6, q"]
    got = {r.TicketId: (r.file, r.reasons, r.record) for r in q.rejects().collect()}
    assert got == {"2": ("a.csv", ["CreatedDate is no time"], "2,01-13-2024,2024-01-02"), "3": ("a.csv", [RJ.WRONG_CELLS], "3,2024-01-01"),
                   "4": ("b.csv", [RJ.WRONG_CELLS], "4,2024-01-01,x,y"), "5": ("b.csv", ["CreatedDate is no time", "ClosedDate is no time"], "5,no,never")}
    assert tuple(q.reconciliation(rows).first()) == (6, 2, 4, True)
    assert tuple(q.reconciliation(rows.limit(5)).first()) == (5, 2, 4, False)
    # a read of one cell still counts the cells
    assert len([r for r in rows.select("TicketId", RJ.CORRUPT).collect() if r[1]]) == 2


def test_other_header_is_an_error(spark, tmp_path):
    path = write(tmp_path / "in", a="A,B\n1,2\n", b="B,A\n3,4\n")
    with pytest.raises(Exception, match="(?i)header"):
        RJ.read_strings(spark, path).collect()


def test_mapping_rows_and_empty_input(spark, tmp_path):
    names = [" meter_serial_number", "discom", " zone ", "circle", "division", "subdivision"]
    raw = spark.createDataFrame([("M1", "d", "z", "c", "v", "s"), ("M2", None, " ", "c", "v", "s")], ", ".join(f"c{i} string" for i in range(6))).toDF(*names)
    store = VersionedStore(spark, str(tmp_path / "s"))
    q = RJ.Quarantine(store, "map").write(raw, RJ.mapping_reasons(raw))
    assert [r.reasons for r in q.rejects().collect()] == [["discom is blank", "zone is blank"]] and q.kept().columns == names
    none = RJ.Quarantine(store, "none").write(raw.limit(0), RJ.mapping_reasons(raw))
    assert tuple(none.reconciliation(raw.limit(0)).first()) == (0, 0, 0, True) and none.kept().count() == 0
