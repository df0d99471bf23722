"""CSV records with line breaks in quoted cells, over many splits of a file."""
import csv
import io
import random

import pytest

from docket.sources import csv_records as R
from docket.sources import files as SF


def plain(text):
    rows = [r for r in csv.reader(io.StringIO(text.removeprefix("﻿"), newline="")) if r and (len(r) > 1 or r[0].strip())]
    return rows[0], rows[1:]


def test_line_state():
    assert [R.ends_inside(x, False) for x in ('a,b', 'a,"b', '"a""b",c', '"a""', '5" pipe,b', 'a,"x"y,"z', '', '"')] == [False, True, False, True, False, True, False, True]
    assert [R.ends_inside(x, True) for x in ('a,b', 'a"', 'a"",b', 'a",b,"c', 'a",5" x', '"')] == [True, False, True, True, False, False]


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_equals_a_plain_reader_over_many_splits(spark, tmp_path, newline):
    rng = random.Random(3)
    cell = lambda: rng.choice(["x", "", "plain text", 'a "quoted" word', "two\nlines", "a,b", "\n", 'ends with quote"', "long " * rng.randrange(30), '"', "line\n\nline"])
    want, paths = {}, []
    for k in range(3):
        rows = [[str(i), f"2024-01-{1 + i % 28:02d}", *[cell() for _ in range(3)]] for i in range(60 + 70 * k)]
        buf = io.StringIO(newline="")
        w = csv.writer(buf, lineterminator=newline)
        w.writerow(["case_enquiry_id", "open_dt", "reason", "type", "closure_reason"])
        w.writerows(rows)
        text = buf.getvalue()
        if k == 1:  # blank lines between records, a quote inside an unquoted cell
            text = text.replace(newline + "5,", newline + newline + "5,", 1) + f'900,2024-01-05,5" pipe,,{newline}'
        path = tmp_path / f"d{k}.csv"
        path.write_bytes(("﻿" if k == 2 else "").encode() + text.encode())
        paths.append(str(path))
        want[path.name] = plain(text)[1]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("300", "57", old):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows, _ = SF.read_csv_deliveries(spark, paths)
            got = rows.collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        for name, expected in want.items():
            mine = sorted((r for r in got if r["_file"].endswith(name)), key=lambda r: r["_row"])
            assert [r["_row"] for r in mine] == list(range(1, len(expected) + 1))
            for r, e in zip(mine, expected):
                assert [r[c] for c in ("case_enquiry_id", "open_dt", "reason", "type", "closure_reason")] == e and not r["_excess"]


def test_open_quote_makes_the_file_malformed(spark, tmp_path):
    p = tmp_path / "open.csv"
    p.write_text('case_enquiry_id,open_dt,reason\n1,2024-01-05,"a\nb"\n2,2024-01-06,"never closed\n3,2024-01-07,x\n')
    rows, _ = SF.read_csv_deliveries(spark, [str(p)])
    got = sorted((r["_row"], r["case_enquiry_id"], r["reason"], r["_excess"]) for r in rows.collect())
    assert got[0] == (1, "1", "a\nb", False) and got[1][0] == 2 and got[1][3] and len(got) == 2


def test_excess_cells_and_header_only(spark, tmp_path):
    (tmp_path / "e.csv").write_text("case_enquiry_id,open_dt\n1,2024-01-05,too many\n2,2024-01-06\n3\n")
    (tmp_path / "h.csv").write_text("case_enquiry_id,open_dt\n")
    rows, headers = SF.read_csv_deliveries(spark, [str(tmp_path / "e.csv"), str(tmp_path / "h.csv")])
    assert sorted((r["_row"], r["case_enquiry_id"], r["open_dt"], r["_excess"]) for r in rows.collect()) == [
        (1, "1", "2024-01-05", True), (2, "2", "2024-01-06", False), (3, "3", "", False)] and headers.count() == 2
