"""Rows that fail to parse: load the valid lines of a delimited table, keep the others with their reason.

A permissive read under an explicit schema (``from_csv``) keeps the raw text of a corrupt line. The reader is more
lenient than the format in places (a stray quote in a bare field, digits of other scripts) and stricter in others (a
padded number within quotes), so every line is then classified exactly by quoting, count and cast checks, all of them
JVM expressions of linear cost without recursion: a line of any length is safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The 16 fields of an index line. The types are fixed values of the format.
TAB_SCHEMA = T.StructType(
    [
        T.StructField("volume_id", T.StringType()),
        T.StructField("file_name_specification", T.StringType()),
        T.StructField("observation_id", T.StringType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("target_name", T.StringType()),
        T.StructField("orbit_number", T.IntegerType()),
        T.StructField("mission_phase_name", T.StringType()),
        T.StructField("rationale_desc", T.StringType()),
        T.StructField("start_time", T.StringType()),
        T.StructField("incidence_angle", T.DoubleType()),
        T.StructField("emission_angle", T.StringType()),
        T.StructField("min_latitude", T.StringType()),
        T.StructField("max_latitude", T.StringType()),
        T.StructField("min_longitude", T.StringType()),
        T.StructField("max_longitude", T.StringType()),
        T.StructField("stereo_flag", T.StringType()),
    ]
)
#: Other numeric fields are cast leniently: they are not judged, an unusable value becomes null.
LENIENT = ("emission_angle", "min_latitude", "max_latitude", "min_longitude", "max_longitude")
CORRUPT = "_corrupt_line"
WHOLE = r"^\+?0*[0-9]{1,6}$"
DECIMAL = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
#: The CSV reader allocates this many columns. A line with more commas (in quoted fields, if it is loadable) skips it:
#: its fields are taken from the raw text.
MAX_COMMAS = 1_000_000


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _outside(parts: Column) -> Column:
    """The line with the text inside quotes removed; parts: the line split at its quotes."""
    return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.lit("")).otherwise(p)), '"')


def _raw_fields(parts: Column) -> Column:
    """The fields of a well-quoted line as they stand, a comma inside quotes as U+0001."""
    masked = F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.translate(p, ",", "\u0001")).otherwise(p)), '"')
    return F.split(masked, ",", -1)


def _value(raw: Column) -> Column:
    """A raw field unquoted, ``""`` undone, stripped."""
    raw = _strip(raw)
    bare = F.when(raw.startswith('"') & raw.endswith('"'), F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
    return _strip(F.translate(F.replace(bare, F.lit('""'), F.lit('"')), "\u0001", ","))


def classified(lines: DataFrame, line: str = "line", schema: T.StructType = TAB_SCHEMA, max_commas: int = MAX_COMMAS) -> DataFrame:
    """``lines`` with the struct ``_row`` (permissive read) and ``_reason`` (null: loadable).

    Reasons, the first that applies: ``quoting`` (a quote never closed, text after a closing quote, a quote in a bare
    field), ``columns`` (not as many fields as the schema; so are blank, empty and null lines), ``orbit_number`` (no
    whole number 0..999999 in ASCII digits, one leading ``+`` and leading zeros allowed), ``incidence_angle`` (no finite
    decimal 0..180 in ASCII). Other fields are not judged. White space around fields and inside a quoted number means
    nothing. Repeated lines are each judged. Columns of ``lines`` are kept; none may be named ``_row``, ``_taken``,
    ``_reason``, ``_raw``, ``_orbit_number`` or ``_incidence_angle``. ``_raw``: fields of a line that the reader skipped.
    """
    names = [f.name for f in schema.fields]
    permissive = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "quote": '"', "escape": '"', "lineSep": "\u0002",
        "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "maxColumns": str(max_commas + 2),
    }
    text = F.coalesce(F.col(line), F.lit(""))
    readable = F.length(text) - F.length(F.replace(text, F.lit(","), F.lit(""))) <= max_commas
    out = lines.withColumn("_row", F.from_csv(F.when(readable, _strip(text)), permissive.simpleString(), options))
    # the reader took it, and it is of the plain form in which reader and format agree
    row = F.col("_row")
    taken = row[CORRUPT].isNull() & text.rlike(_plain_form(names)) & row["orbit_number"].between(0, 999_999) & row["incidence_angle"].between(0, 180)
    out = out.withColumn("_taken", F.coalesce(taken, F.lit(False)))
    # the others, corrupt to the reader or not, are classified from the raw text
    parts = F.split(text, '"', -1)
    o = _outside(parts)
    quoting = (F.size(parts) % 2 == 0) | o.rlike(r'(?U)[^",\s]\s*"|"\s*[^",\s]|"\s+"')
    count = F.length(o) - F.length(F.replace(o, F.lit(","), F.lit(""))) + 1
    exact = {n: _value(F.try_element_at(_raw_fields(parts), F.lit(names.index(n) + 1))) for n in ("orbit_number", "incidence_angle")}
    angle = F.when(exact["incidence_angle"].rlike(DECIMAL), exact["incidence_angle"].try_cast("double"))
    reason = (
        F.when(F.col("_taken"), F.lit(None).cast("string"))
        .when(quoting, F.lit("quoting"))
        .when(count != len(names), F.lit("columns"))
        .when(~F.coalesce(exact["orbit_number"].rlike(WHOLE), F.lit(False)), F.lit("orbit_number"))
        .when(~F.coalesce(angle.between(0, 180), F.lit(False)), F.lit("incidence_angle"))
    )
    orbit = F.when(F.col("_taken"), row["orbit_number"]).otherwise(exact["orbit_number"].try_cast("int"))
    incidence = F.when(F.col("_taken"), row["incidence_angle"]).otherwise(angle)
    out = out.select("*", reason.alias("_reason"), orbit.alias("_orbit_number"), incidence.alias("_incidence_angle")).drop("_taken")
    return out.withColumn("_raw", F.when(~readable & F.col("_reason").isNull(), _raw_fields(parts)))


def _plain_form(names: list[str]) -> str:
    """A line of whole fields, bare or quoted without inner quotes, with ASCII numbers where they are judged.

    All quantifiers are possessive: no backtracking and no recursion that grows with the line.
    """
    field = r'(?:\s*+"[^"]*+"\s*+|[^",]*+)'
    numbers = {"orbit_number": r"\s*+\+?+[0-9]++\s*+", "incidence_angle": r"\s*+[+-]?+(?:[0-9]++\.?+[0-9]*+|\.[0-9]++)(?:[eE][+-]?+[0-9]++)?+\s*+"}
    return "^" + ",".join(numbers.get(n, field) for n in names) + "$"


def rejected(lines: DataFrame, line: str = "line", schema: T.StructType = TAB_SCHEMA) -> DataFrame:
    """Lines that cannot be loaded, with their columns, the raw text and one ``reason``. An empty table gives none."""
    got = classified(lines, line, schema).where(F.col("_reason").isNotNull())
    keep = [F.col(f"`{c}`") for c in lines.columns if c != "reason"]
    return got.select(*keep, F.col("_reason").alias("reason"))


def loaded(lines: DataFrame, line: str = "line", schema: T.StructType = TAB_SCHEMA, max_commas: int = MAX_COMMAS) -> DataFrame:
    """Loadable lines as typed rows: the columns of ``lines`` but the text, then those of the schema.

    A column of ``lines`` that is named like a field of the schema gets the prefix ``line_``. Strings are stripped, as
    white space around fields means nothing; blank strings stay blank.
    """
    names = [f.name for f in schema.fields]
    got = classified(lines, line, schema, max_commas).where(F.col("_reason").isNull())
    keep = [F.col(f"`{c}`").alias(f"line_{c}" if c in names else c) for c in lines.columns if c != line]
    fields = []
    for k, f in enumerate(schema.fields):
        if f.name in ("orbit_number", "incidence_angle"):
            c = F.col(f"_{f.name}")
        else:
            c = F.when(F.col("_raw").isNotNull(), _value(F.col("_raw")[k])).otherwise(_strip(F.col(f"_row.`{f.name}`").cast("string")))
            c = c.try_cast("double") if f.name in LENIENT else c.try_cast(f.dataType)
        fields.append(c.alias(f.name))
    return got.select(*keep, *fields)


def reason_counts(lines: DataFrame, by: str, line: str = "line", schema: T.StructType = TAB_SCHEMA) -> DataFrame:
    """Per ``by`` and reason (``loaded`` for the good ones) the number of lines."""
    got = classified(lines, line, schema)
    return got.groupBy(F.col(f"`{by}`").alias(by), F.coalesce("_reason", F.lit("loaded")).alias("reason")).agg(F.count(F.lit(1)).alias("n_lines"))
