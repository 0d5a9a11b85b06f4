import csv
import io
import math
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from redsift.operators.bad_rows import loaded, reason_counts, rejected

GOOD = '"V","f.JP2","ESP_1","ESP_1_RED","MARS", 62884,"X","say ""hi"", there","2018", 36.5,1,2,3,4,5,"NO "'


def brute(line):
    """A character machine, independent of the operator."""
    fields, i, n = [], 0, len(line)
    while True:
        j = i
        while j < n and line[j].isspace():
            j += 1
        if j < n and line[j] == '"':
            text, j = "", j + 1
            while True:
                if j >= n:
                    return "quoting", None
                if line[j] == '"':
                    if line[j + 1 : j + 2] == '"':
                        text, j = text + '"', j + 2
                        continue
                    j += 1
                    break
                text, j = text + line[j], j + 1
            while j < n and line[j].isspace():
                j += 1
            if j < n and line[j] != ",":
                return "quoting", None
        else:
            k = line.find(",", i)
            k = n if k < 0 else k
            text, j = line[i:k], k
            if '"' in text:
                return "quoting", None
        fields.append(text.strip())
        if j >= n:
            break
        i = j + 1
    if len(fields) != 16:
        return "columns", None
    if not re.fullmatch(r"\+?0*[0-9]{1,6}", fields[5]):
        return "orbit_number", None
    if not re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", fields[9]) or not 0 <= float(fields[9]) <= 180 or math.isinf(float(fields[9])):
        return "incidence_angle", None
    return None, fields


def reasons(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "line_id long, line string")
    bad = {r["line_id"]: r["reason"] for r in rejected(df).collect()}
    good = {r["line_id"]: r for r in loaded(df).collect()}
    assert set(bad) | set(good) == set(range(len(lines)))
    assert not set(bad) & set(good)
    return bad, good


def with_field(k, v):
    f = next(csv.reader(io.StringIO(GOOD)))
    f[k] = v
    return ",".join(f'"{x}"'.replace('"' + x + '"', x) if i == k else '"' + x.replace('"', '""') + '"' for i, x in enumerate(f))


CASES = [
    GOOD, GOOD + " \r", GOOD + '"', GOOD[:-1], "", "   ", "a,b", GOOD + ",x", GOOD.replace('"MARS"', 'MA"RS'), GOOD.replace('"X"', '"X" y'), GOOD.replace('"X"', '"X" "Y"'), GOOD.replace('"X"', ' "X" '),
    with_field(5, '" 12 "'), with_field(5, "+7"), with_field(5, "-7"), with_field(5, "1000000"), with_field(5, "0000000123"), with_field(5, "１２"), with_field(5, "1e4"), with_field(5, "10²"), with_field(5, ""),
    with_field(9, "180"), with_field(9, "180.5"), with_field(9, "-0"), with_field(9, "1.5e1"), with_field(9, "NaN"), with_field(9, "1e400"), with_field(9, "5d"), with_field(9, "0x1p3"), with_field(9, ".5"), with_field(9, "5."), with_field(9, ""),
    ",".join(['"', '"'] * 8), '""' * 50, '"' * 51, "," * 15, "," * 40_000, '"' + "x" * 300_000 + '"', '"a' + '""' * 60_000 + '"',
]


def test_cases(spark):
    bad, good = reasons(spark, CASES)
    for i, line in enumerate(CASES):
        reason, fields = brute(line)
        assert bad.get(i) == reason, (i, line[:80], reason)
        if fields:
            assert good[i]["orbit_number"] == int(fields[5])
            assert good[i]["incidence_angle"] == float(fields[9])
            assert good[i]["rationale_desc"] == fields[7]


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(['"', ",", " ", "a", "1", '""', '","', GOOD, "\t"]), max_size=14).map("".join), min_size=1, max_size=120))
def test_any_lines(spark, lines):
    bad, _ = reasons(spark, lines)
    assert {i: bad.get(i) for i in range(len(lines))} == {i: brute(x)[0] for i, x in enumerate(lines)}


def test_nulls_repeats_clashes_empty(spark):
    df = spark.createDataFrame([(1, GOOD, "k"), (1, GOOD, "k"), (2, None, None)], "line_id long, line string, product_id string")
    assert [(r["line_id"], r["reason"]) for r in rejected(df).collect()] == [(2, "columns")]
    got = loaded(df).collect()
    assert len(got) == 2 and got[0]["line_product_id"] == "k" and got[0]["product_id"] == "ESP_1_RED"
    assert {tuple(r) for r in reason_counts(df, "product_id").collect()} == {("k", "loaded", 2), (None, "columns", 1)}
    assert rejected(df.limit(0)).count() == 0 and loaded(df.limit(0)).count() == 0


def test_lines_that_the_reader_skips_keep_all_fields(spark):
    lines = [*CASES, GOOD.replace('"X"', '" a,b,, ""c"" "'), GOOD.replace("1,2,3", " +1.5 ,,abc")]
    df = spark.createDataFrame(list(enumerate(lines)), "line_id long, line string")
    want = {r["line_id"]: r for r in loaded(df).collect()}
    assert {r["line_id"]: r for r in loaded(df, max_commas=3).collect()} == want
    assert want[len(CASES)]["mission_phase_name"] == 'a,b,, "c"' and want[len(CASES) + 1]["emission_angle"] == 1.5
