import random
import re

import pytest

from morphex.operators.records import Layout, classify_records, failed_records, read_layouts, valid_records

LAYOUTS = [Layout("plain", ",", ("image", "label"), 2), Layout("noted", ",", ("image", "label", "sample", "note"), 4), Layout("tabbed", "\t", ("image", "sample", "label"), 3), Layout("semi", ";", ("sample", "image", "label", "note"), 4)]


def expected(raw, layout):
    """Character by character, the rules as written."""
    if raw is None:
        return ("skipped", None)
    line = raw[:-1] if raw.endswith("\r") else raw
    if not line.strip():
        return ("skipped", None)
    if layout is None:
        return ("failed", "unknown_layout")
    fields, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            value, j = "", i + 1
            while True:
                if j >= len(line):
                    return ("failed", "bad_quoting")
                if line[j] == '"':
                    if line[j + 1 : j + 2] == '"':
                        value, j = value + '"', j + 2
                        continue
                    break
                value, j = value + line[j], j + 1
            j += 1
            if j < len(line) and line[j] != layout.delim:
                return ("failed", "bad_quoting")
        else:
            j = i
            while j < len(line) and line[j] != layout.delim:
                if line[j] == '"':
                    return ("failed", "bad_quoting")
                j += 1
            value = line[i:j]
        fields.append(value)
        if j >= len(line):
            break
        i = j + 1
    if len(fields) != layout.n_fields:
        return ("failed", "field_count")
    image, label = (fields[layout.columns.index(c)].strip() for c in ("image", "label"))
    bad = lambda s: any(ord(c) < 32 or ord(c) == 127 or c == "�" for c in s)
    if bad(image) or image[:1] in ("/", "\\") or re.match("[A-Za-z]:", image) or ".." in re.split(r"[/\\]", image) or not re.search(r"\.(jpe?g|png|bmp|webp|tiff?)$", image, re.I):
        return ("failed", "bad_image")
    if label and (not label[0].isalpha() or bad(label)):
        return ("failed", "bad_label")
    return ("valid", (image, label or None))


CASES = [
    None, "", "  \t ", "\r", "a/b.jpg,Aus bus", "a/b.JPG,", '"a/b.jpg","Aus ""x"" bus"', 'a/b.jpg,"Aus', 'a/b.jpg,Au"s', '"a/b.jpg" ,Aus', "a/b.jpg", "a/b.jpg,Aus,more", "/a/b.jpg,Aus", "C:\\a.jpg,Aus", "a/../b.jpg,Aus",
    "a/..b.jpg,Aus", "a/b.gif,Aus", "a/b.jpg,1aus", "a/b.jpg,Ünd", "a/b.jpg,A\x01us", "a/�.jpg,Aus", '"a,b.jpg","Aus, bus"', '"a\nb.jpg",Aus', "a/b.jpg,Aus\r", "a/b.jpg,Aus\r\r", " a/b.jpg , Aus ", '"",""', ",", '"a/b.jpg",""',
    "a/b.jpg,Aus\nbus", "\\a.jpg,Aus", "..,x", ".jpg,Aus", "é.tiff,物种", "a/b.jpg," + "x" * 200_000, '"' + "a" * 100_000 + '.jpg",Aus', "a/b.jpg\x7f.png,Aus",
]


def _check(spark, rows):
    df = spark.createDataFrame([(i, lay, raw, "extra") for i, (lay, raw) in enumerate(rows)], "rec_id long, layout string, raw string, image string")
    by = {x.name: x for x in LAYOUTS}
    got = {r.rec_id: r.parsed for r in classify_records(df, LAYOUTS).collect()}
    assert len(got) == len(rows)
    for i, (lay, raw) in enumerate(rows):
        status, detail = expected(raw, by.get(lay))
        assert (got[i].status, got[i].reason if status != "valid" else (got[i].image, got[i].label)) == (status, detail), repr(raw)[:200]


def test_cases(spark):
    _check(spark, [(lay, raw) for raw in CASES for lay in ("plain", "noted", None, "none of these")])


def test_random_records(spark):
    rng = random.Random(5)
    pieces = ['"', '""', ",", "\t", ";", "a/b.jpg", "Aus", " ", "\r", "\n", "\x01", "..", "/", "�", "x.png", ""]
    _check(spark, [(lay, "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9)))) for _ in range(700) for lay in ("plain", "noted", "tabbed", "semi")])


def test_tables_and_clashes(spark):
    df = spark.createDataFrame([], "rec_id long, layout string, raw string")
    assert failed_records(classify_records(df, LAYOUTS)).count() == 0 == valid_records(classify_records(df, LAYOUTS)).count()
    with pytest.raises(ValueError):
        classify_records(df.selectExpr("*", "1 AS Parsed"), LAYOUTS)
    table = spark.createDataFrame([("p", ",", "image,label", 2), ("p", ",", "image,label", 2), (None, ",", "image,label", 2)], "layout string, delim string, header_line string, n_fields int")
    assert read_layouts(table) == [Layout("p", ",", ("image", "label"), 2)]
    with pytest.raises(ValueError):
        read_layouts(spark.createDataFrame([("p", "||", "image||label", 2)], table.schema))
