"""Message indexes: parsing, validation, names, times and identities of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import compact, iso_label, slug
from ..model import GridError
from .joins import cut_lineage, lookup_join
from .ordered import number_rows, with_neighbours

# Short names of index lines and the parameter they stand for.
SHORT_NAMES = {
    "AOTK": "aerosol_optical_thickness",
    "ASYSFK": "asymmetry_factor",
    "SSALBK": "single_scattering_albedo",
    "SCTAOTK": "scattering_aerosol_optical_thickness",
}
# Prefix of an interval by its comparison sign.
SIGNS = {"<": "lt", "<=": "lt", ">": "gt", ">=": "gt", "=": "eq"}
# Product templates (first, last) and the position of their time unit.
FORECAST_OFFSETS = [
    (0, 15, 8), (32, 34, 8), (51, 51, 8), (60, 61, 8), (86, 87, 8), (91, 91, 8), (1000, 1101, 8),
    (40, 43, 10), (44, 47, 21), (85, 85, 21), (48, 49, 32), (55, 56, 14), (59, 59, 14), (62, 63, 14),
    (70, 73, 13), (76, 79, 11), (80, 81, 33), (82, 84, 22), (88, 88, 26),
]
# Time unit codes in seconds.
TIME_UNIT_SECONDS = {0: 60, 1: 3600, 2: 86400, 10: 10800, 11: 21600, 12: 43200, 13: 1}
# Product templates with aerosol fields, and those with wavelengths.
AEROSOL_TEMPLATES = [(44, 50), (80, 85), (156, 159), (168, 176), (179, 187), (190, 198)]
WAVELENGTH_TEMPLATES = [
    48, 49, 80, 81, 156, 157, 158, 159, 169, 172, 175, 176, 180, 183, 186, 187, 191, 194, 197, 198,
]
# Naming of an interval by its type code; 1 and 2 stand for its ends.
INTERVAL_NAMES = {
    0: ("lt", 1), 1: ("gt", 2), 3: ("gt", 1), 4: ("lt", 2), 5: ("le", 1), 6: ("ge", 2),
    8: ("ge", 1), 9: ("le", 2), 11: ("eq", 1),
}
INTERVAL_BOTH = [2, 7, 10]
# Code table entries (table, code, label).
CODE_TABLE = [
    ("0.0", 0, "Meteorological Products"),
    ("0.0", 1, "Hydrological Products"),
    ("0.0", 2, "Land Surface Products"),
    ("0.0", 10, "Oceanographic Products"),
    ("4.1", 13, "Aerosols"),
    ("4.1", 14, "Trace Gases"),
    ("4.1", 20, "Atmospheric Chemical Constituents"),
    ("4.233", 62033, "Anthropogenic Secondary Organic Aerosol"),
    ("4.233", 62034, "Rain Water"),
    ("4.233", 62035, "Cloud Water"),
    ("4.233", 62036, "Brown Carbon Dry"),
    ("4.233", 62037, "Sea Salt Wet at 80% Relative Humidity"),
]
# Parameter labels (discipline, category, number, label).
PARAMETERS = [
    (0, 13, 0, "Aerosol Type"),
    (0, 20, 100, "Surface Area Density (Aerosol)"),
    (0, 20, 101, "Vertical Visual Range"),
    (0, 20, 102, "Aerosol Optical Thickness"),
    (0, 20, 103, "Single Scattering Albedo"),
    (0, 20, 104, "Asymmetry Factor"),
    (0, 20, 105, "Aerosol Extinction Coefficient"),
    (0, 20, 106, "Aerosol Absorption Coefficient"),
    (0, 20, 107, "Aerosol Lidar Backscatter from Satellite"),
    (0, 20, 108, "Aerosol Lidar Backscatter from the Ground"),
    (0, 20, 109, "Aerosol Lidar Extinction from Satellite"),
    (0, 20, 110, "Aerosol Lidar Extinction from the Ground"),
    (0, 20, 111, "Angstrom Exponent"),
    (0, 20, 112, "Absorption Aerosol Optical Thickness"),
    (0, 20, 113, "Aerosol Backscatter Coefficient"),
]


# --- index files --------------------------------------------------------------------


def _fields(lines: DataFrame) -> DataFrame:
    text = F.trim("text")
    kept = lines.withColumn("raw", text).filter((text != "") & ~text.startswith("#"))
    parts = F.transform(F.split("raw", ":"), lambda x: F.trim(x))
    whole = r"^\+?[0-9]{1,18}$"

    def number(i: int) -> Column:
        x = F.get(F.col("fields"), F.lit(i))
        return F.when(x.rlike(whole), F.regexp_replace(x, r"^\+", "").cast("bigint"))

    kept = kept.withColumn("fields", parts)
    return kept.withColumn("ordinal", number(0)).withColumn("offset", number(1))


def _linked(lines: DataFrame, sizes: DataFrame) -> DataFrame:
    """Record lines with their neighbours and the size of their object."""
    rows = _fields(lines).select("object", "line", "raw", "fields", "ordinal", "offset")
    near = with_neighbours(
        rows, ["object"], [F.col("line")],
        previous={"line": "_prev_line", "ordinal": "_prev_ordinal", "offset": "_prev_offset"},
        following={"offset": "_next_offset"},
    )
    return lookup_join(near, sizes, ["object"])


def _problem() -> Column:
    return (
        F.when(F.size("fields") < 2, "fewer than two fields")
        .when(F.col("ordinal").isNull(), "the ordinal is not a number")
        .when(F.col("ordinal") == 0, "ordinals count from 1, found 0")
        .when(F.col("_prev_line").isNull() & (F.col("ordinal") != 1), "counting does not begin at 1")
        .when(F.col("offset").isNull(), "the offset is not a number")
        .when(F.col("size").isNull() | (F.col("offset") >= F.col("size")), "the offset lies past the end of the object")
        .when(F.col("offset") <= F.col("_prev_offset"), "offset does not lie after the previous one")
        .when(F.col("ordinal") <= F.col("_prev_ordinal"), "ordinal does not follow the previous one")
    )


def validate_idx(lines: DataFrame, sizes: DataFrame) -> DataFrame:
    """Every faulty line of the index files: object, line, reason.

    ``lines``: object, line (1-based), text; ``sizes``: object, size in bytes.
    """
    return _linked(lines, sizes).withColumn("reason", _problem()).filter("reason IS NOT NULL").select(
        "object", "line", "reason"
    )


def parse_idx(lines: DataFrame, sizes: DataFrame, strict: bool = True) -> DataFrame:
    """Records of index files: object, line, ordinal, offset, length, raw, fields.

    A length runs to the next offset, the last one to the end of the object.  A file with
    a faulty line is an error, or is left out when not ``strict``.
    """
    rows = _linked(lines, sizes).withColumn("_reason", _problem())
    wrong = rows.filter("_reason IS NOT NULL")
    if strict:
        bad = wrong.select("object", "line", "_reason").orderBy("object", "line").first()
        if bad is not None:
            raise GridError(f"{bad['object']}: .idx line {bad['line']}: {bad['_reason']}")
        good = rows
    else:
        good = lookup_join(rows, wrong.select("object").distinct(), ["object"], "left_anti")
    return good.select(
        "object", "line", "ordinal", "offset",
        (F.coalesce("_next_offset", "size") - F.col("offset")).alias("length"), "raw", "fields",
    )


def _after(prefix: str) -> Column:
    """Rest of the first field that starts with ``prefix``."""
    hit = F.get(F.filter("fields", lambda f: f.startswith(prefix)), F.lit(0))
    return F.substr(hit, F.lit(len(prefix) + 1))


def _interval(text: Column, factor: float, unit: str) -> Column:
    """``>=a,<b`` and the like as part of a name; NULL when it is not such a text."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x))
    shape = r"^(>=|<=|>|<|=)\s*([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)$"

    def sign(i: int) -> Column:
        return F.nullif(F.regexp_extract(F.get(parts, F.lit(i)), shape, 1), F.lit(""))

    def quantity(i: int) -> Column:
        number = F.nullif(F.regexp_extract(F.get(parts, F.lit(i)), shape, 2), F.lit("")).try_cast("double")
        return F.concat(compact(number * factor), F.lit(unit))

    def prefix(s: Column) -> Column:
        out = F.lit("")
        for mark, name in SIGNS.items():
            out = F.when(s == mark, name).otherwise(out)
        return out

    one = F.concat(prefix(sign(0)), quantity(0))
    closed = sign(0).isin(">=", ">") & sign(1).isin("<=", "<")
    both = F.when(closed, F.concat(quantity(0), F.lit("-"), quantity(1))).otherwise(
        F.concat(prefix(sign(0)), quantity(0), F.lit("-"), prefix(sign(1)), quantity(1))
    )
    return F.when((F.size(parts) == 1) & sign(0).isNotNull(), one).when(
        (F.size(parts) == 2) & sign(0).isNotNull() & sign(1).isNotNull(), both
    )


def idx_name() -> Column:
    """Variable name of an index record (column ``fields``); NULL without a fourth field."""
    short = F.get("fields", F.lit(3))
    parameter = slug(short)
    for code, name in SHORT_NAMES.items():
        parameter = F.when(F.upper(short) == code, name).otherwise(parameter)
    species = slug(_after("aerosol="))
    size = _interval(_after("aerosol_size "), 1e6, "um")
    wavelength = _interval(_after("aerosol_wavelength "), 1e9, "nm")
    return F.when(short.isNotNull(), F.concat_ws("_", species, size, parameter, wavelength))


def idx_names(records: DataFrame) -> DataFrame:
    return records.withColumn("name", idx_name())


def idx_time() -> Column:
    """ISO label of the ``d=YYYYMMDDHH`` field; NULL when absent or malformed."""
    stamp = _after("d=")
    shape = r"^([0-9]{4})([0-9]{2})([0-9]{2})([0-9]{2}).*$"
    text = F.regexp_replace(stamp, shape, "$1-$2-$3T$4:00:00Z")
    return F.when(stamp.rlike(shape), text)


def unique_names(df: DataFrame, by: list[str], name: str = "name", ordinal: str = "ordinal", time: str | None = None) -> DataFrame:
    """Add ``unique_name``; ``ordinal`` counts messages from one within ``by``.

    The first use keeps the name.  Later ones get ``_message_<ordinal>`` or, when a
    ``time`` label column is given, ``_valid_<time>`` for its first use and
    ``_variant_<ordinal>`` afterwards.  First uses are found by aggregation, so a name
    that is used millions of times is no hot spot.
    """
    first = cut_lineage(df.groupBy(*by, name).agg(F.min(ordinal).alias("_first")))
    rows = lookup_join(df, first, [*by, name], "inner")
    again = F.col(ordinal) > F.col("_first")
    if time is None:
        other = F.concat(F.col(name), F.format_string("_message_%04d", F.col(ordinal)))
        return rows.withColumn("unique_name", F.when(again, other).otherwise(F.col(name))).drop("_first")
    stamp = slug(F.col(time))
    rows = rows.withColumn(
        "_dated", F.when(again & (F.coalesce(stamp, F.lit("")) != ""), F.concat(F.col(name), F.lit("_valid_"), stamp))
    )
    dated = cut_lineage(rows.filter("_dated IS NOT NULL").groupBy(*by, "_dated").agg(F.min(ordinal).alias("_first_dated")))
    rows = lookup_join(rows, dated, [*by, "_dated"])
    variant = F.concat(F.col(name), F.format_string("_variant_%03d", F.col(ordinal)))
    chosen = (
        F.when(~again, F.col(name))
        .when(F.col(ordinal) == F.col("_first_dated"), F.col("_dated"))
        .otherwise(variant)
    )
    return rows.withColumn("unique_name", chosen).drop("_first", "_dated", "_first_dated")


# --- index against messages ---------------------------------------------------------


def reconcile(idx: DataFrame, headers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Match index records with message headers by offset.

    ``headers``: object, offset, seq (order in the file), message_length and more.
    Returns matched records, one per submessage with its ``submessage`` position, and
    diagnostics for records without a message or with another length.
    """
    first = headers.groupBy("object", "offset").agg(F.min_by("message_length", "seq").alias("declared"))
    seen = idx.join(first, ["object", "offset"], "left")
    message = F.when(
        F.col("declared").isNull(), F.format_string("line %d: no message begins at its offset", F.col("line"))
    ).when(
        F.col("declared") != F.col("length"),
        F.format_string(
            "line %d: the index gives %d bytes, the header %d",
            F.col("line"), F.col("length"), F.col("declared"),
        ),
    )
    seen = seen.withColumn("message", message)
    diagnostics = seen.filter("message IS NOT NULL").select("object", "line", "message")
    parts = number_rows(headers, ["object", "offset"], [F.col("seq")], "_part")
    good = seen.filter("message IS NULL").drop("message", "declared")
    matched = good.join(parts, ["object", "offset"]).withColumn("submessage", (F.col("_part") - 1).cast("int")).drop("_part")
    return matched, diagnostics


# --- message headers ----------------------------------------------------------------


def _byte(i: Column | int, payload: str = "payload") -> Column:
    """Unsigned byte at 0-based position ``i``; NULL past the end."""
    at = F.lit(i) if isinstance(i, int) else i
    piece = F.hex(F.substring(F.col(payload), at + 1, F.lit(1)))
    return F.when(piece != "", F.conv(piece, 16, 10).cast("bigint"))


def _word(i: Column | int, n: int, payload: str = "payload") -> Column:
    """Unsigned big-endian integer of n bytes; NULL past the end."""
    at = F.lit(i) if isinstance(i, int) else i
    piece = F.hex(F.substring(F.col(payload), at + 1, F.lit(n)))
    return F.when(F.length(piece) == 2 * n, F.conv(piece, 16, 10).cast("bigint"))


def _signed_byte(i: int) -> Column:
    """Two's-complement reading of one byte."""
    b = _byte(i)
    return F.when(b >= 128, b - 256).otherwise(b)


def _signed_word(i: int) -> Column:
    w = _word(i, 4)
    return F.when(w >= 1 << 31, w - (1 << 32)).otherwise(w)


def valid_time() -> Column:
    """ISO label of reference time plus forecast offset; NULL for unknown templates or units.

    Columns: product_template, payload (Section 4 bytes), reference_time.
    """
    template = F.col("product_template")
    at = F.lit(None).cast("int")
    for low, high, offset in FORECAST_OFFSETS:
        at = F.when(template.between(low, high), offset).otherwise(at)
    unit, value = _byte(at + 4), _word(at + 5, 4)
    seconds = F.lit(None).cast("bigint")
    for code, length in TIME_UNIT_SECONDS.items():
        seconds = F.when(unit == code, F.lit(length).cast("bigint")).otherwise(seconds)
    return iso_label(F.timestamp_seconds(F.unix_seconds(F.col("reference_time").cast("timestamp")) + value * seconds))


def _in_ranges(x: Column, ranges: list[tuple[int, int]]) -> Column:
    out = F.lit(False)
    for low, high in ranges:
        out = out | x.between(low, high)
    return out


def _quantity(scale: Column, value: Column, factor: float, unit: str, by_scale: bool = False) -> Column:
    """Value times ten to minus scale; small numbers, or numbers of a small scale, in the finer unit."""
    step = F.pow(F.lit(10.0), -scale.cast("double"))
    x = value.cast("double") * step
    fine = F.concat(compact(x * factor), F.lit(unit))
    return F.when(value == -(1 << 31), "missing").when((step if by_scale else F.abs(x)) < 1e-3, fine).otherwise(F.concat(compact(x), F.lit("m")))


def aerosol(headers: DataFrame, species: DataFrame | None = None, unit_by_scale: bool = False) -> DataFrame:
    """Aerosol qualifiers of messages with an aerosol template; NULL for all others.

    Adds species, size1, size2, wavelength1, wavelength2 (``interval=<type>;<value>``)
    and optical.  ``species``: code, label; unknown codes become ``code-<n>``.  Lengths below
    1 mm are in um or nm; with ``unit_by_scale`` all whose scale factor is below 1 mm.
    """
    template = F.col("product_template")
    known = _in_ranges(template, AEROSOL_TEMPLATES)
    code = F.when(known, _word(6, 2))
    spark = headers.sparkSession
    labels = species if species is not None else spark.createDataFrame(
        [(c, label) for t, c, label in CODE_TABLE if t == "4.233"], "code BIGINT, label STRING"
    )
    rows = headers.withColumn("_code", code)
    rows = lookup_join(rows, labels.select(F.col("code").alias("_code"), F.col("label").alias("_label")), ["_code"])
    is_aerosol = F.col("_code").isNotNull()

    def interval(at: int, factor: float, unit: str) -> tuple[Column, Column]:
        whole = _byte(at + 10).isNotNull() & is_aerosol
        kind = F.concat(F.lit("interval="), _byte(at).cast("string"), F.lit(";"))
        ends = [
            F.when(whole, F.concat(kind, _quantity(_signed_byte(at + 1 + 5 * i), _signed_word(at + 2 + 5 * i), factor, unit, unit_by_scale)))
            for i in (0, 1)
        ]
        return ends[0], ends[1]

    size = interval(8, 1e6, "um")
    wave = interval(19, 1e9, "nm")
    has_wave = template.isin(*WAVELENGTH_TEMPLATES)
    return rows.select(
        *headers.columns,
        F.when(is_aerosol, F.coalesce("_label", F.concat(F.lit("code-"), F.col("_code").cast("string")))).alias("species"),
        size[0].alias("size1"), size[1].alias("size2"),
        F.when(has_wave, wave[0]).alias("wavelength1"), F.when(has_wave, wave[1]).alias("wavelength2"),
        F.when(is_aerosol, F.concat(F.lit("template-4."), template.cast("string"))).alias("optical"),
    )


def _interval_name(first: Column, second: Column) -> Column:
    kind = F.nullif(F.regexp_extract(first, "^interval=([0-9]+);", 1), F.lit("")).try_cast("int")

    def value(x: Column) -> Column:
        return slug(F.regexp_replace(x, "^interval=[0-9]+;", ""))

    a, b = value(first), value(second)
    both = F.concat(a, F.lit("-"), b)
    out = F.when(kind.isNull() | kind.isin(*INTERVAL_BOTH), both)
    for code, (prefix, end) in INTERVAL_NAMES.items():
        out = out.when(kind == code, F.concat(F.lit(prefix), a if end == 1 else b))
    return out.otherwise(F.concat(F.lit("interval"), kind.cast("string"), F.lit("_"), both))


def readable_name(description: Column) -> Column:
    """Name made of the parameter line of a description (or the whole text)."""
    line = F.regexp_extract(description, r"(?m)^  Parameter:(.*)$", 1)
    source = F.trim(F.when(description.rlike(r"(?m)^  Parameter:"), line).otherwise(description))
    name = F.regexp_replace(F.regexp_replace(F.lower(source), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(name == "", "grib2_field").otherwise(name)


def _escape(x: Column) -> Column:
    for mark, code in (("%", "%25"), (";", "%3B"), ("=", "%3D")):
        x = F.replace(x, F.lit(mark), F.lit(code))
    return x


def field_identity(headers: DataFrame, species: DataFrame | None = None, unit_by_scale: bool = False) -> DataFrame:
    """Add ``machine_key``, ``human_name`` and ``short_name`` to message headers."""
    rows = aerosol(headers, species, unit_by_scale)

    def part(name: str, column: str) -> Column:
        return F.concat(F.lit(f"{name}="), F.col(column).cast("string"))

    def optional(name: str, column: str) -> Column:
        return F.concat(F.lit(f"{name}="), F.coalesce(F.col(column).cast("string"), F.lit("missing")))

    def qualifier(name: str) -> Column:
        return F.concat(F.lit(f"{name}="), _escape(F.col(name)))

    key = F.concat(
        F.lit("grib2/v1/"),
        F.concat_ws(
            ";", part("discipline", "discipline"), part("centre", "centre"), part("subcentre", "subcentre"),
            part("master", "master_table"), part("local", "local_table"), part("grid", "grid_template"),
            part("product", "product_template"), part("repr", "data_template"),
            optional("category", "category"), optional("parameter", "number"),
            F.concat(F.lit("product-bytes="), F.lower(F.hex("payload"))),
            *[qualifier(q) for q in ("species", "size1", "size2", "wavelength1", "wavelength2", "optical")],
        ),
    )
    base = readable_name(F.col("description"))
    human = F.when(
        F.col("species").isNotNull(),
        F.concat_ws(
            "_", slug(F.col("species")),
            F.when(F.col("size1").isNotNull(), _interval_name(F.col("size1"), F.col("size2"))), base,
            F.when(F.col("wavelength1").isNotNull(), _interval_name(F.col("wavelength1"), F.col("wavelength2"))),
        ),
    ).otherwise(base)
    return rows.select(
        *headers.columns, key.alias("machine_key"), human.alias("human_name"),
        F.split(base, "_")[0].alias("short_name"),
    )


def resolve_codes(df: DataFrame, codes: DataFrame | None = None) -> DataFrame:
    """Label of (``table``, ``code``); without one the reason, and the raw code stays.

    ``codes``: table, code, label.  Reasons: missing (255), local-use (192 and above),
    unknown.
    """
    table = codes if codes is not None else df.sparkSession.createDataFrame(
        CODE_TABLE, "table STRING, code BIGINT, label STRING"
    )
    rows = lookup_join(df, table, ["table", "code"])
    reason = F.when(F.col("label").isNull(), F.when(F.col("code") == 255, "missing").when(F.col("code") >= 192, "local-use").otherwise("unknown"))
    return rows.withColumn("reason", reason)


def parameter_label(df: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Label of (``discipline``, ``category``, ``number``): built in, else from ``table``.

    Anything else is named as a local or newer entry of its category.
    """
    key = ["discipline", "category", "number"]
    spark = df.sparkSession
    own = spark.createDataFrame(PARAMETERS, "discipline INT, category INT, number INT, _own STRING")
    rows = lookup_join(df, own, key)
    label = F.col("_own")
    if table is not None:
        rows = lookup_join(rows, table.select(*key, F.col("label").alias("_table")), key)
        label = F.coalesce(label, F.col("_table"))
    weather = F.col("discipline") == 0
    number = F.col("number").cast("string")
    category = (
        F.when(weather & (F.col("category") == 13), "Aerosol")
        .when(weather & (F.col("category") == 20), "Atmospheric chemical constituent").otherwise("GRIB2")
    )
    fallback = F.when(
        weather & (F.col("category") == 13) & (F.col("number") >= 192), F.concat(F.lit("Aerosol local parameter "), number)
    ).otherwise(F.concat(category, F.lit(" parameter "), number, F.lit(" (local or newer table entry)")))
    return rows.select(*df.columns, F.coalesce(label, fallback).alias("label"))


def surface_name(label: Column, unit: Column, value: Column, second: Column, same_type: Column) -> tuple[Column, Column]:
    """Machine and display form of a level: ``<surface>_<value><unit>[-<value2><unit>]``."""
    machine_label = F.regexp_replace(slug(label), "_surface$", "")
    display_label = F.lower(F.regexp_replace(label, " surface$", ""))
    short = F.coalesce(slug(unit), F.lit(""))
    shown = F.when(F.coalesce(unit, F.lit("")) == "", "").otherwise(F.concat(F.lit(" "), unit))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    layer = finite(second) & same_type & (F.abs(second - value) > 2.220446049250313e-16)
    machine = F.concat(machine_label, F.lit("_"), compact(value), short)
    display = F.concat(display_label, F.lit(" "), compact(value), shown)
    return (
        F.when(finite(value), F.when(layer, F.concat(machine, F.lit("-"), compact(second), short)).otherwise(machine)),
        F.when(finite(value), F.when(layer, F.concat(display, F.lit("–"), compact(second), shown)).otherwise(display)),
    )


def raw_code_label() -> Column:
    """``d<discipline>-c<category>-p<number>-g<grid>-t<product>-r<representation>``."""
    def code(letter: str, column: str) -> Column:
        return F.concat(F.lit(letter), F.coalesce(F.col(column).cast("string"), F.lit("x")))

    return F.concat_ws(
        "-", code("d", "discipline"), code("c", "category"), code("p", "number"), code("g", "grid_template"),
        code("t", "product_template"), code("r", "data_template"),
    )


# --- forecast files -----------------------------------------------------------------

_FORECAST = r"^(.*)\.f((?!.*\.f)[0-9]{3})(.*)$"


def forecast_key(paths: DataFrame) -> DataFrame:
    """Add ``forecast_key`` and ``hour`` to ``path``s of remote forecast files; NULL for others.

    The key is the name without its hour; the extension must be a message-file one.  Local
    paths (without a scheme, or of scheme ``file``) have none.
    """
    path = F.col("path")
    remote = path.rlike(r"(?i)^[a-z][a-z0-9+.\-]*://") & ~path.rlike(r"(?i)^file:")
    known = remote & path.rlike(r"(?i)\.(grib|grib2|grb|grb2)$") & path.rlike(_FORECAST)
    key = F.concat(F.regexp_extract(path, _FORECAST, 1), F.regexp_extract(path, _FORECAST, 3))
    hour = F.regexp_extract(path, r"^.*\.f([0-9]+)", 1).try_cast("int")
    return paths.withColumn("forecast_key", F.when(known, key)).withColumn("hour", F.when(known, hour))


def is_forecast_collection(paths: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per group: several files that all have the same forecast key."""
    keyed = forecast_key(paths)
    return keyed.groupBy(*(by or [])).agg(
        (
            (F.count(F.lit(1)) > 1) & (F.count("forecast_key") == F.count(F.lit(1)))
            & (F.min("forecast_key") == F.max("forecast_key"))
        ).alias("is_collection")
    )


def forecast_time(base: Column, base_hour: Column, hour: Column) -> Column:
    """Base label moved by the difference of hours, else ``forecast f<hour>``."""
    from ..functions.scalars import parse_label

    ts = parse_label(base)
    moved = F.timestamp_seconds(F.unix_seconds(ts) + (hour - base_hour).cast("bigint") * 3600)
    return F.coalesce(iso_label(moved), F.format_string("forecast f%03d", hour))
