import csv
import io
import random

import pytest

from topicloom.sources import faq, splits


@pytest.fixture
def small_ranges(spark):
    own = {"spark.sql.files.maxPartitionBytes": "173", "spark.sql.files.openCostInBytes": "1"}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k in own:
        spark.conf.unset(k)


def quoted(cell: str) -> str:
    return '"' + cell.replace('"', '""') + '"' if any(x in cell for x in '",\n') else cell


def test_a_line_opens_a_quote_or_not():
    cases = {"": False, "a,b": False, '"a"': False, '"a': True, 'a,"b': True, 'a"b': False, '"a""': True, '"a"""': False, '"a"x,"b': True, ' "a': False, '"a","b"': False, '"",""': False, ',"': True}
    assert {c: splits.stays_open(c, False) for c in cases} == cases
    assert [splits.stays_open(c, True) for c in ("", "a", 'a"', 'a","b', 'a"",b', 'a",b')] == [True, True, False, True, True, False]


@pytest.mark.parametrize("seed", range(3))
def test_csv_in_many_ranges_equals_one_reader(spark, tmp_path, small_ranges, seed):
    r = random.Random(seed)
    alphabet = ["a", "é", "日", " ", ",", '"', "\n", '","', '"\n"', "word "]
    rows = [[quoted("".join(r.choices(alphabet, k=r.choice([0, 1, 3, 8])))) for _ in range(r.choice([0, 1, 2, 5]))] for _ in range(150)]
    rows[70] = [quoted('x","y\n' * 120)]  # a row over many ranges, each of which looks like rows of its own
    if seed == 2:
        rows.append(['"never closed', "x\n\ny"])
    body = "\n".join(",".join(x) for x in rows) + ("" if seed == 1 else "\n")
    p = tmp_path / "x.csv"
    p.write_text(body)
    want = [*enumerate(csv.reader(io.StringIO(body)))]
    got = sorted((x.row_no, x.cells) for x in splits.csv_rows(spark, str(p)).collect())
    assert splits.pieces(spark, str(p), "\n").select("b").distinct().count() > 10
    if seed == 2:  # a row that the file leaves open ends with it, with or without the last line's end
        assert got[:-1] == want[:-1] and got[-1][1][0].rstrip("\n") == want[-1][1][0].rstrip("\n")
    else:
        assert got == want


def test_no_rows(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    assert faq.csv_rows(spark, str(tmp_path / "e.csv")).collect() == []
