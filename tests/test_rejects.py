import csv
import io

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.operators import rejects

ROWS = [
    ("IOCL,A-1,bolt,NOS,FAST,7318,12.50", None),
    ('IOCL,A-1,"bolt, ""M6""\nlong",NOS,FAST,7318,"1,250.50"', None),
    ("IOCL, a/1.2 ,bolt,,,,N/A", None),
    ("", "column_count"),
    (None, "column_count"),
    ("IOCL,A-1,bolt,NOS,FAST,7318", "column_count"),
    ("IOCL,A-1,bolt,NOS,FAST,7318,1,2", "column_count"),
    ('IOCL,A-1,bolt 2" long,NOS,FAST,7318,1', "broken_quoting"),
    ('IOCL,A-1,"bolt,NOS,FAST,7318,1', "broken_quoting"),
    ('IOCL,A-1,"bolt" x,NOS,FAST,7318,1', "broken_quoting"),
    ("IOCL,,bolt,NOS,FAST,7318,1", "bad_code"),
    ("IOCL,A é,bolt,NOS,FAST,7318,1", "bad_code"),
    ("IOCL,A-1,123,NOS,FAST,7318,1", "bad_description"),
    ("IOCL,A-1,बोल्ट,NOS,FAST,7318,1", None),
    ("IOCL,A-1,bolt,NOS,FAST,7318,.5", "bad_rate"),
    ("IOCL,A-1,bolt,NOS,FAST,7318,5.", "bad_rate"),
    ("IOCL,A-1," + "x" * 200_000 + ",NOS,FAST,7318,5", None),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, r, "clash", "clash") for i, (r, _) in enumerate(rows)], "line_id long, raw_line string, reason string, cpse string")


def test_reasons(spark):
    got = {r.line_id: r.reason for r in rejects.check_materials(frame(spark, ROWS)).collect()}
    assert got == {i: why for i, (_, why) in enumerate(ROWS)}


def test_valid_rows_are_typed(spark):
    got = {r.line_id: r for r in rejects.valid_rows(frame(spark, ROWS)).collect()}
    assert got[1].description == 'bolt, "M6"\nlong' and float(got[1].last_rate_inr) == 1250.5
    assert got[2].material_code == "a/1.2" and got[2].uom is None and got[2].last_rate_inr is None


def test_empty(spark):
    assert rejects.rejected_rows(frame(spark, [])).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet='a",\n ', max_size=12), min_size=1, max_size=6))
def test_index_against_a_state_machine(lines):
    raw = [x.encode() for x in lines]
    ends = np.cumsum([len(x) for x in raw])
    starts = ends - [len(x) for x in raw]
    broken, fields, _, _ = rejects.index_records(np.frombuffer(b"".join(raw), np.uint8), starts, ends)
    for k, x in enumerate(lines):
        want = parse(x)
        assert bool(broken[k]) == (want is None)
        if want is not None:
            assert fields[k] == len(want)


def parse(x):
    fields, i = [], 0
    while True:
        if x[i : i + 1] == '"':
            i, b = i + 1, ""
            while True:
                if i >= len(x):
                    return None
                if x[i] != '"':
                    b, i = b + x[i], i + 1
                elif x[i + 1 : i + 2] == '"':
                    b, i = b + '"', i + 2
                else:
                    i += 1
                    break
            if x[i : i + 1] not in ("", ","):
                return None
        else:
            j = x.find(",", i)
            b = x[i:] if j < 0 else x[i:j]
            if '"' in b:
                return None
            i += len(b)
        fields.append(b)
        if i >= len(x):
            return fields
        i += 1


@pytest.mark.parametrize("row", [["a", 'b "c"', "d,e", "", "f\ng", "h", "1"]])
def test_round_trip(spark, row):
    text = io.StringIO()
    csv.writer(text, lineterminator="").writerow(row)
    got = rejects.split_records(spark.createDataFrame([(1, text.getvalue())], "line_id long, raw_line string")).first()
    assert [got[c] for c in rejects.COLUMNS] == row
