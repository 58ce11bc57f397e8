"""Label-sheet records: typed rows for those that parse, a reason for the others.

The reader runs permissively under an explicit schema per layout and keeps the raw text. Records that
it can't vouch for (wrong column count, any quote, line break or control character) are then read
again under the strict grammar: field count, quoting, and value checks. All of it stays in the JVM, in
one projection without a shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import bind, is_blank

#: Permitted endings of an image reference.
IMAGE_ENDINGS = ("jpg", "jpeg", "png", "bmp", "webp", "tif", "tiff")
REASONS = ("unknown_layout", "bad_quoting", "field_count", "bad_image", "bad_label")
MAX_LAYOUTS = 200

_FORBIDDEN = r"[\x00-\x1F\x7F�]"
_IMAGE_OK = r"(?is)^(?![/\\])(?![a-z]:)(?!(?:.*[/\\])?\.\.(?:[/\\]|\z)).*\.(?:" + "|".join(IMAGE_ENDINGS) + r")\z"
_TRIM = r"^\p{IsWhite_Space}++|\p{IsWhite_Space}++\z"


@dataclass(frozen=True)
class Layout:
    """One kind of sheet: its name, one-character delimiter, column names and field count."""

    name: str
    delim: str
    columns: tuple[str, ...]
    n_fields: int


def read_layouts(df: DataFrame) -> list[Layout]:
    """Layouts as driver values. The table describes kinds of sheet; more than MAX_LAYOUTS is an error."""
    rows = df.select("layout", "delim", "header_line", "n_fields").distinct().limit(MAX_LAYOUTS + 1).collect()
    if len(rows) > MAX_LAYOUTS:
        raise ValueError(f"more than {MAX_LAYOUTS} sheet layouts")
    out = [Layout(r.layout, r.delim, tuple(r.header_line.split(r.delim)), r.n_fields) for r in rows if r.layout is not None]
    if len({x.name for x in out}) < len(out):
        raise ValueError("a layout is described twice in different ways")
    for x in out:
        if len(x.delim) != 1 or not {"image", "label"} <= set(x.columns):
            raise ValueError(f"layout {x.name!r} needs a one-character delimiter and the columns image and label")
    return sorted(out, key=lambda x: x.name)


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, _TRIM, "")


def _grammar(delim: str) -> tuple[str, str]:
    """Strict field and quoted-field patterns. Possessive, so matching needs no stack on long texts."""
    quoted = r'"[^"]*+(?:""[^"]*+)*+"'
    return f'(?:{quoted}|[^"{re.escape(delim)}]*+)', quoted


def _read(line: Column, layout: Layout) -> Column:
    """Struct (problem, image, label) of one layout."""
    delim = re.escape(layout.delim)
    field, quoted = _grammar(layout.delim)
    schema = ", ".join(f"c{i} string" for i in range(layout.n_fields)) + ", _raw string"
    parsed = F.from_csv(
        line,
        schema,
        {"sep": layout.delim, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_raw", "nullValue": "", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"},
    )
    at = {name: layout.columns.index(name) for name in ("image", "label")}
    value = {name: f"c{i}" for name, i in at.items()}
    bad_quote = ~line.rlike(rf"^{field}(?:{delim}{field})*+\z")
    bare = F.regexp_replace(line, quoted, "")
    count = F.length(bare) - F.length(F.replace(bare, F.lit(layout.delim))) + 1

    def strict(i: int) -> Column:
        raw = F.regexp_extract(line, rf"^(?:{field}{delim}){{{i}}}({field})", 1)
        return F.when(raw.startswith('"'), F.replace(raw.substr(F.lit(2), F.length(raw) - 2), F.lit('""'), F.lit('"'))).otherwise(raw)

    def judged(row: Column) -> Column:
        doubtful = row["_raw"].isNotNull() | line.rlike(r'["\x00-\x08\x0A-\x1F]')
        problem = F.when(bad_quote, "bad_quoting").when(count != layout.n_fields, "field_count")
        again = F.struct(problem.alias("problem"), *(_trimmed(strict(i)).alias(name) for name, i in at.items()))
        return F.when(doubtful, again).otherwise(F.struct(F.lit(None).cast("string").alias("problem"), *(_trimmed(F.coalesce(row[value[name]], F.lit(""))).alias(name) for name in at)))

    return bind(parsed, judged)


def classify_records(records: DataFrame, layouts: list[Layout], raw: str = "raw", layout: str = "layout") -> DataFrame:
    """Every column of ``records`` plus ``parsed`` = struct (status, reason, image, label).

    status is ``skipped`` (null text or nothing but white space), ``failed`` or ``valid``. A failed record
    has one of REASONS and null values; a valid one has its image and its label, null for a blank label.
    The first reason that holds is given, in the order of REASONS. A record under an unknown or null
    layout fails. One trailing carriage return is taken off. Rows are kept as delivered, repeats too;
    a column that is already called ``parsed`` is an error.
    """
    if "parsed" in (c.lower() for c in records.columns):
        raise ValueError("the records have a column called parsed")
    line = F.regexp_replace(F.col(raw), r"\r\z", "")
    read = F.lit(None).cast("struct<problem string, image string, label string>")
    for x in layouts:
        read = F.when(F.col(layout) == x.name, _read(line, x)).otherwise(read)
    step = records.withColumn("parsed", F.when(~is_blank(raw), read))

    def verdict(row: Column) -> Column:
        return _verdict(row, is_blank(raw))

    return step.withColumn("parsed", bind(F.col("parsed"), verdict))


def _verdict(row: Column, blank: Column) -> Column:
    image, label = row["image"], row["label"]
    reason = (
        F.when(row.isNull(), "unknown_layout")
        .when(row["problem"].isNotNull(), row["problem"])
        .when(~image.rlike(_IMAGE_OK) | image.rlike(_FORBIDDEN), "bad_image")
        .when((label != "") & (~label.rlike(r"^\p{L}") | label.rlike(_FORBIDDEN)), "bad_label")
    )
    status = F.when(blank, "skipped").when(reason.isNotNull(), "failed").otherwise("valid")
    ok = status == "valid"
    return bind(
        F.struct(status.alias("status"), reason.alias("reason"), image.alias("image"), label.alias("label")),
        lambda x: F.struct(
            x["status"].alias("status"),
            F.when(x["status"] == "failed", x["reason"]).alias("reason"),
            F.when(x["status"] == "valid", x["image"]).alias("image"),
            F.when((x["status"] == "valid") & (x["label"] != ""), x["label"]).alias("label"),
        ),
    )


def valid_records(classified: DataFrame) -> DataFrame:
    """Typed rows (rec_id, image, label) of the records that parse."""
    return classified.where("parsed.status = 'valid'").select("rec_id", "parsed.image", "parsed.label")


def failed_records(classified: DataFrame) -> DataFrame:
    """(rec_id, layout, reason, raw) of the records that don't."""
    return classified.where("parsed.status = 'failed'").select("rec_id", "layout", "parsed.reason", "raw")
