import re

from corvane.operators.rejects import Field, failed_lines, reject_report, sort_lines, valid_rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

SCHEMAS = {
    "users": (Field("uid"), Field("name", 32), Field("state", 8), Field("age")),
    "pairs": (Field("a"), Field("b", 5)),
}
LINES = "line_id long, file_name string, dest string, line_no int, raw_text string, reason string, fields int"


def brute(line, fields):
    """One character after the other."""
    values, i, n = [], 0, len(line)
    while True:
        while i < n and line[i] == " ":
            i += 1
        if i < n and line[i] == '"':
            i, value = i + 1, ""
            while True:
                if i >= n:
                    return "quoting", None
                if line[i] != '"':
                    value += line[i]
                    i += 1
                elif line[i + 1 : i + 2] == '"':
                    value += '"'
                    i += 2
                else:
                    break
            i += 1
            while i < n and line[i] == " ":
                i += 1
            if i < n and line[i] != ",":
                return "quoting", None
        else:
            end = line.find(",", i)
            end = n if end < 0 else end
            value = line[i:end].rstrip(" ")
            if '"' in value:
                return "quoting", None
            i = end
        values.append(value)
        if i >= n:
            break
        i += 1
    if len(values) != len(fields):
        return "columns", None
    for f, v in zip(fields, values, strict=True):
        if f.is_int:
            if not re.fullmatch("-?[0-9]+", v, re.A) or not -(2**31) <= int(v) < 2**31:
                return "value", None
        elif not 1 <= len(v.encode()) <= f.max_bytes or any(c < " " or c == "�" for c in v):
            return "value", None
    return None, values




def judge(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], LINES)
    return sort_lines(df, SCHEMAS)


CASES = [
    '1,Ann,CA,20', ' 1 , "Ann" ,"CA" , 20 ', '1,"Lee, Ann",CA,20', '1,"say ""hi""",CA,20', '"1","Ann","CA","20"', '1,Ann,CA', '1,Ann,CA,20,',
    '1,"Ann,CA,20', '1,"Ann" x,CA,20', '1,A"nn,CA,20', 'x,Ann,CA,20', '1,,CA,20', '1,"",CA,20', '1," ",CA,20', '1,Ann,CALIFORNIA,20',
    '2147483648,Ann,CA,20', '-2147483648,Ann,CA,20', '0000000000000000012,Ann,CA,20', '1,Ann,CA,+5', '1,Ann,CA,٣', '1,A\tn,CA,20', '1,A�n,CA,20',
    '1,Ann,CA,""', '1,Ann,CA," 20"', '\t1,Ann,CA,20', '1,"a\nb",CA,20', '1,Ann\r,CA,20', '1,' + "é" * 16 + ',CA,20', '1,' + "é" * 17 + ',CA,20', ',,,', '"', '""',
    "1,Ann,CA,-", "1,Ann,CA,-0", "1," + "x" * 100_000 + ",CA,1", ",", "1,'Ann',CA,20", "1,A\0n,CA,20", "1\0,Ann,CA,20", '1,"\0",CA,20', "1,Ann,CA,1" + "0" * 4000, "1;2;3;4", '1, "a"" b" ,CA,0',
]


def test_each_case(spark):
    rows = [(i, "f.csv", "users", 2, t) for i, t in enumerate(CASES)]
    got = {r["line_id"]: (r["reason"], r["fields"]) for r in judge(spark, rows).collect()}
    for i, t in enumerate(CASES):
        assert got[i] == brute(t, SCHEMAS["users"]), t


@settings(max_examples=20, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet='12 ,"a\n\r\té-', max_size=12), min_size=1, max_size=60))
def test_random_lines(spark, texts):
    rows = [(i, "f.csv", "pairs", 2, t) for i, t in enumerate(texts) if t.strip(" ")]
    got = {r["line_id"]: (r["reason"], r["fields"]) for r in judge(spark, rows).collect()} if rows else {}
    assert got == {r[0]: brute(r[4], SCHEMAS["pairs"]) for r in rows}


def test_headers_blanks_and_nulls(spark):
    rows = [
        (1, "f", "users", 1, "1,Ann,CA,20"), (2, "f", "users", 2, ""), (3, "f", "users", 2, "   "), (4, "f", "users", 2, None),
        (5, "f", "users", None, "1,Ann,CA,20"), (6, "f", None, 2, "1"), (7, "f", "nowhere", 2, "1"), (None, None, "users", 2, "1"), (5, "f", "users", 2, "x"),
    ]
    got = sorted((str(r["line_id"]), str(r["reason"])) for r in judge(spark, rows).collect())
    assert got == [("5", "None"), ("5", "value"), ("6", "destination"), ("7", "destination"), ("None", "columns")] or got == [
        ("5", "None"), ("5", "columns"), ("6", "destination"), ("7", "destination"), ("None", "columns"),
    ]
    assert judge(spark, [(1, "f", "users", 1, "a")]).count() == 0
    assert sort_lines(spark.createDataFrame([], LINES), SCHEMAS).count() == 0


def test_loaded_and_failed(spark):
    rows = [(1, "f", "users", 2, '7,"Ann, B",CA,-3'), (2, "f", "users", 3, "x,,CA,y"), (3, "f", "pairs", 2, "1,b"), (4, "g", "pairs", 2, '"')]
    judged = judge(spark, rows)
    assert [tuple(r) for r in valid_rows(judged, SCHEMAS["users"], "users").collect()] == [(1, 7, "Ann, B", "CA", -3)]
    failed = {r["line_id"]: (r["raw_text"], r["reason"], r["bad_cells"]) for r in failed_lines(judged).collect()}
    assert failed == {2: ("x,,CA,y", "value", "uid,name,age"), 4: ('"', "quoting", None)}
    report = sorted(map(tuple, reject_report(judged).collect()))
    assert report == [("f", "pairs", 1, 0, 0, 0), ("f", "users", 1, 0, 0, 1), ("g", "pairs", 0, 1, 0, 0)]
