"""Values of every layout: lines with known digits in every field, and the row rules' borders."""

import pytest

from skyloom.sources import tables

SIGNED = {"ppm": 42, "bd": 24, "taylor2": 7, "usno": 60, "gilliss1963": 49, "wb": 30, "ua": 110, "bsc5": 84}
#: What a line must hold besides its place, so that its row counts.
NEEDED = {
    "gc": {6: " 1"}, "gc2": {12: " 0", 44: "-"}, "weiss": {6: "1", 49: "00012"}, "stone2": {}, "brisbane": {20: "A"}, "usno": {6: " "}, "gilliss": {6: " "},
    "gilliss1963": {26: "A"}, "cd": {11: " ", 12: " 9.5"}, "bd": {11: " ", 12: " 9.5"}, "sd": {11: " ", 12: " 9.5"}, "cpd": {11: " ", 12: " 9.5"},
}


def put(line, at, text):
    return line[: at - 1] + text + line[at - 1 + len(text) :]


def printed(part, whole, divisor=1.0):
    """``whole`` in the part's width, and the number it stands for."""
    start, width = part
    text = f"{whole:0{width}d}"[-width:]
    return start, text, int(text) / divisor


def line_of(table, name, sign="-"):
    """A line with digits in every number's field, and the place that they make."""
    line, want = " " * 220, {}
    for f in table.fields:
        if f.kind != "text":
            line = put(line, f.start, "".join(str((f.start + k) % 9 + 1) for k in range(f.length)))
    for key, parts, values in (("ra", table.ra, (13, 47, 2)), ("dec", table.dec, (5, 38, 4))):
        if not parts:
            continue
        total = 0.0
        for part, value, scale in zip(parts[:3], values, (1.0, 60.0, 3600.0)):
            if part:
                start, text, number = printed(part, value, parts[3] if part == parts[2] else 1.0)
                line = put(line, start, text)
                total += number / scale
        want[key] = total * 15 if key == "ra" else total
    for at, text in NEEDED.get(name, {}).items():
        line = put(line, at, text)
    if name in SIGNED:
        line = put(line, SIGNED[name], sign)
    return line, want


def digits_of(line, f):
    return int("".join(c if c != " " else "0" for c in line[f.start - 1 : f.start - 1 + f.length]) or 0)


PLACED = sorted(n for n, t in tables.TABLES.items() if t.side != "degrees")


@pytest.mark.parametrize("name", PLACED)
def test_values_of_a_line(spark, name):
    table = tables.TABLES[name]
    minus, want = line_of(table, name)
    plus = line_of(table, name, "+")[0]
    lines = spark.createDataFrame([(1, minus), (2, plus)], "line long, value string").coalesce(1)
    got = {x.line: x for x in tables.stars(lines, name).collect()}
    assert 1 in got, minus
    for f in table.fields:
        if f.kind == "int":
            assert got[1][f.name] == digits_of(minus, f), f
        elif f.kind == "decimal":
            assert got[1][f.name] == pytest.approx(digits_of(minus, f) / f.divisor), f
        else:
            assert got[1][f.name] == minus[f.start - 1 : f.start - 1 + f.length].strip(), f
    assert got[1].epoch == table.epoch
    if table.ra:
        assert got[1].ra == pytest.approx(want["ra"], abs=1e-9)
    if table.dec:
        size = want["dec"]
        one = {"south": -size, "north": size, "npd": 90 - size, "spd": size - 90}.get(table.side, -size)
        assert got[1].dec == pytest.approx(one, abs=1e-9)
        if name in SIGNED and name not in ("gc2",) and 2 in got:
            assert got[2].dec == pytest.approx(size, abs=1e-9)


def test_no_two_numbers_share_a_place():
    for name, table in tables.TABLES.items():
        taken = {}
        spans = [(f.name, f.start, f.length) for f in table.fields if f.kind != "text"]
        spans += [(k, *p) for k, parts in (("ra", table.ra), ("dec", table.dec)) if parts for p in parts[:3] if p]
        for field, start, length in spans:
            for c in range(start, start + length):
                assert name == "wb" and {taken.get(c), field} == {"hour", "ra"} or c not in taken, (name, c, taken.get(c), field)
                taken[c] = field


def kept(spark, name, changes):
    """For each change of a good line whether its row still counts."""
    good = line_of(tables.TABLES[name], name)[0]
    rows = [(i, put(good, *c) if c else good) for i, c in enumerate([None, *changes])]
    lines = spark.createDataFrame(rows, "line long, value string")
    found = {x.line for x in tables.stars(lines, name).collect()}
    return [i in found for i, _ in rows]


@pytest.mark.parametrize(
    "name, changes, want",
    [
        ("cd", [(11, "D"), (12, "20.0"), (12, "40.0"), (12, "50.0"), (12, "30.0"), (11, "a")], [False, False, False, False, True, True]),
        ("bd", [(11, "D"), (11, "*"), (12, "50.0"), (11, "b")], [False, False, False, True]),
        ("sd", [(11, "a"), (12, "20.0"), (12, "40.0")], [False, False, False]),
        ("cpd", [(11, "a"), (12, "20.0"), (12, "30.0"), (12, "40.0")], [False, False, False, True]),
        ("gc", [(6, " 2"), (6, "11")], [False, False]),
        ("gc2", [(12, " 1"), (44, "+")], [False, False]),
        ("weiss", [(6, "2"), (49, "     ")], [False, False]),
        ("brisbane", [(20, "N"), (29, " "), (55, " ")], [False, False, False]),
        ("usno", [(6, "d")], [False]),
        ("gilliss", [(6, "d")], [False]),
        ("gilliss1963", [(26, "N"), (31, " "), (54, "x")], [False, False, False]),
        ("lalande", [(19, " "), (32, " ")], [False, False]),
    ],
)
def test_which_rows_count(spark, name, changes, want):
    assert kept(spark, name, changes) == [True, *want]


def test_tycho_places_are_degrees(spark):
    line = " " * 220
    for at, text in ((1, "9537"), (6, "  387"), (12, "1"), (111, " 9.250"), (124, " 8.125"), (153, "  1.23456789"), (166, "-89.87654321")):
        line = put(line, at, text)
    x = tables.stars(spark.createDataFrame([(1, line)], "line long, value string"), "tycho2").first()
    assert (x.tyc1, x.tyc2, x.tyc3, x.bt, x.vt, x.ra, x.dec) == (9537, 387, 1, "9.250", "8.125", 1.23456789, -89.87654321)
