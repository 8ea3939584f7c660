"""Column maps of files and canonical rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cyclelake.functions.text import normalise_label, null_if_token, strip
from cyclelake.functions.values import unit_factor
from cyclelake.schema import NUMERIC_FIELDS

# --- fixed values ---------------------------------------------------------------------
TIME_PRIORITY = ["timestamp", "time", "datetime", "date_time", "dateheure", "date heure"]
TIME_PARTS = ["timestamp", "datetime", "date heure"]
TOLERATED_UNITS = [("cm3", "mm_or_cm3"), ("mm", "mm_or_cm3")]
SELECTOR = "^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"
ANY = "*"
# --------------------------------------------------------------------------------------
MAP_COLUMNS = ["canonical", "unit", "source_unit", "scale", "confidence", "matched_by", "mapped_brand"]


def file_headers(profiles: DataFrame) -> DataFrame:
    """(path, brand, position, label, source unit) rows of the profiled files."""
    return profiles.select(
        "path", "brand", "units", F.posexplode("headers").alias("position", "label")
    ).select("path", "brand", "position", "label", F.try_element_at("units", F.col("position") + 1).alias("unit_cell"))


def column_map(headers: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Canonical field of every header by the dictionary of its brand and the generic one.

    The last fitting dictionary entry wins; an entry of the detected brand has confidence 1,
    a generic one 0.75, no entry 0. Of headers that read the same only the last is mapped.
    """
    keyed = headers.withColumn("_norm", normalise_label(F.col("label")))
    last = keyed.groupBy("path", "_norm").agg(F.max("position").alias("position"))
    entries = dictionary.select(
        normalise_label(F.col("label")).alias("_norm"),
        "ordinal",
        "canonical",
        "unit",
        "source_unit",
        "scale",
        F.col("label").alias("matched_by"),
        F.col("brand").alias("mapped_brand"),
    )
    fitting = (
        keyed.join(last, ["path", "_norm", "position"], "left_semi")
        .join(F.broadcast(entries), "_norm")  # fixed-size vocabulary
        .where(F.col("mapped_brand").isin("generic") | (F.col("mapped_brand") == F.col("brand")))
        .withColumn("confidence", F.when(F.col("mapped_brand") == F.col("brand"), 1.0).otherwise(0.75))
    )
    best = fitting.groupBy("path", "position").agg(F.max_by(F.struct(*MAP_COLUMNS), "ordinal").alias("m"))
    return headers.join(best, ["path", "position"], "left").select(
        *headers.columns,
        *[F.col(f"m.{c}").alias(c) for c in MAP_COLUMNS if c not in ("scale", "confidence")],
        F.coalesce("m.scale", F.lit(1.0)).alias("scale"),
        F.coalesce("m.confidence", F.lit(0.0)).alias("confidence"),
    )


# Selectors of a version set, most specific first.
SELECTORS = [("site", "machine"), ("site", None), (None, "machine"), (None, None)]


def chosen_versions(files: DataFrame, versions: DataFrame) -> DataFrame:
    """(path, parser_version, v_site, v_machine) of the most specific version set of every file that has one.

    A file asks for its four selectors by equality; the most specific set there is counts, also if it is of another
    brand. Selectors that are not plain names match nothing.
    """
    plain = lambda c: F.when(F.col(c).rlike(SELECTOR), F.col(c))
    part = lambda name: F.coalesce(plain(name), F.lit(ANY)) if name else F.lit(ANY)
    asked = [F.struct(F.lit(-rank).alias("rank"), part(site).alias("v_site"), part(machine).alias("v_machine")) for rank, (site, machine) in enumerate(SELECTORS)]
    safe = reduce(lambda a, b: a & b, [F.coalesce(F.col(c).rlike(SELECTOR) | (F.col(c) == ""), F.lit(True)) for c in ("site", "machine")])
    wanted = files.where(safe & F.col("parser_version").rlike(SELECTOR)).select("path", "parser_version", F.explode(F.array(*asked)).alias("s"))
    sets = versions.select("parser_version", F.coalesce("site", F.lit(ANY)).alias("v_site"), F.coalesce("machine", F.lit(ANY)).alias("v_machine")).distinct()
    met = wanted.select("path", "parser_version", "s.*").join(sets, ["parser_version", "v_site", "v_machine"])
    best = met.groupBy("path", "parser_version").agg(F.max_by(F.struct("v_site", "v_machine"), "rank").alias("best"))
    return best.select("path", "parser_version", "best.*")


def apply_versions(mapped: DataFrame, files: DataFrame, versions: DataFrame) -> DataFrame:
    """Override the map by the most specific alias set of a file's site, machine and version.

    `files`: path, site, machine, parser_version. `versions`: site, machine (null for any),
    parser_version, mapping_brand and per alias: alias_label, canonical, unit, source_unit,
    scale, confidence. Order: site and machine, site, machine, version. An alias set applies
    only where its brand is the detected one. Of aliases that read the same the last by label counts.
    """
    own = [c for c in versions.columns if c not in ("site", "machine", "parser_version")]
    keys = ["parser_version", "v_site", "v_machine"]
    aliases = versions.select(
        "parser_version",
        F.coalesce("site", F.lit(ANY)).alias("v_site"),
        F.coalesce("machine", F.lit(ANY)).alias("v_machine"),
        normalise_label(F.col("alias_label")).alias("_norm"),
        F.struct(*[F.col(c).alias(f"v_{c}") for c in own]).alias("_alias"),
    )
    single = aliases.groupBy(*keys, "_norm").agg(F.max_by("_alias", "_alias.v_alias_label").alias("_alias"))
    chosen = chosen_versions(files, versions).join(single, keys).select("path", "_norm", "_alias.*")
    joined = mapped.withColumn("_norm", normalise_label(F.col("label"))).join(chosen, ["path", "_norm"], "left")
    hit = F.col("v_canonical").isNotNull() & (F.col("v_mapping_brand") == F.col("brand"))
    new = {
        "canonical": F.col("v_canonical"),
        "unit": F.col("v_unit"),
        "source_unit": F.coalesce("v_source_unit", "v_unit"),
        "scale": F.coalesce("v_scale", F.lit(1.0)),
        "confidence": F.coalesce("v_confidence", F.lit(1.0)),
        "matched_by": F.col("v_alias_label"),
        "mapped_brand": F.col("brand"),
    }
    return joined.withColumns({k: F.when(hit, c).otherwise(F.col(k)) for k, c in new.items()}).select(*mapped.columns)


def normalised_unit(unit: Column) -> Column:
    plain = F.translate(F.lower(strip(F.coalesce(unit, F.lit("")))), "³°", "3")
    return F.when(plain.isin("c", "degc"), "celsius").otherwise(plain)


def apply_unit_row(mapped: DataFrame) -> DataFrame:
    """Let an explicit unit cell decide the scale; add `unit_compatible`.

    An explicit unit beats a scale inferred from the header. Units without a known factor
    are incompatible and leave the scale as it was.
    """
    source, target = normalised_unit(F.col("unit_cell")), normalised_unit(F.col("unit"))
    stated = F.col("canonical").isNotNull() & ~source.isin("", "-")
    tolerated = reduce(
        lambda a, b: a | b, [(source == s) & (target == t) for s, t in TOLERATED_UNITS], source == target
    )
    kept = (F.col("scale") != 1.0) & (source == normalised_unit(F.col("source_unit")))
    factor = unit_factor(source, target)
    scale = (
        F.when(~stated | kept, F.col("scale")).when(tolerated, 1.0).otherwise(F.coalesce(factor, F.col("scale")))
    )
    return mapped.withColumns(
        {
            "unit_compatible": ~stated | kept | tolerated | factor.isNotNull(),
            "scale": scale,
            "source_unit": F.when(stated, source).otherwise(F.col("source_unit")),
        }
    )


def mapping_confidence(mapped: DataFrame) -> DataFrame:
    return mapped.groupBy("path").agg(F.round(F.avg("confidence"), 3).alias("mapping_confidence"))


def time_column(labels: Column) -> Column:
    """Label of the time column: exact names by priority, else the first that contains one."""
    plain = F.transform(labels, lambda h: F.lower(strip(h)))
    exact = [F.nullif(F.array_position(plain, name), F.lit(0)) for name in TIME_PRIORITY]
    partial = F.array_min(
        F.transform(plain, lambda h, i: F.when(reduce(lambda a, b: a | b, [h.contains(p) for p in TIME_PARTS]), i + 1))
    )
    return F.try_element_at(labels, F.coalesce(*exact, partial).cast("int"))


def map_rows(rows: DataFrame, mapped: DataFrame) -> DataFrame:
    """Canonical rows of `rows` (path, line_no, cells: map of label to text).

    Adds `canonical`, a map of field to cleaned text with numbers scaled, and `raw_data` with
    the unmapped columns. Of columns mapped to one field the last wins. Text that is not a
    number stays for the validator.
    """
    fields = mapped.where(F.col("canonical").isNotNull()).groupBy("path", "canonical").agg(
        F.max_by(F.struct("label", "scale"), "position").alias("s")
    )
    # one row per file: as many entries as the file has columns
    specs = fields.groupBy("path").agg(
        F.collect_list(F.struct("canonical", F.col("s.label").alias("label"), F.col("s.scale").alias("scale"))).alias("fields")
    )
    known = mapped.where(F.col("canonical").isNotNull()).groupBy("path").agg(F.collect_set("label").alias("known"))
    joined = rows.join(specs, "path", "left").join(known, "path", "left")

    def value(f: Column) -> Column:
        text = null_if_token(F.try_element_at(F.col("cells"), f.label))
        number = F.replace(text, F.lit(","), F.lit(".")).try_cast("double")
        scaled = F.when(f.scale == 1.0, number).otherwise(number * f.scale)
        numeric = f.canonical.isin(NUMERIC_FIELDS) | (f.scale != 1.0)
        return F.when(numeric & number.isNotNull(), scaled.cast("string")).otherwise(text)

    nothing = F.array().cast("array<string>")
    return joined.withColumns(
        {
            "canonical": F.map_from_entries(
                F.transform(
                    F.coalesce("fields", F.array().cast("array<struct<canonical:string,label:string,scale:double>>")),
                    lambda f: F.struct(f.canonical.alias("key"), value(f).alias("value")),
                )
            ),
            "raw_data": F.transform_values(
                F.map_filter("cells", lambda k, x: ~F.array_contains(F.coalesce(F.col("known"), nothing), k)),
                lambda k, x: null_if_token(x),
            ),
        }
    ).drop("fields", "known")


def typed(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Columns of the chosen canonical fields; numeric ones as double."""
    made = {}
    for f in fields:
        text = F.try_element_at(F.col("canonical"), F.lit(f))
        made[f] = text.try_cast("double") if f in NUMERIC_FIELDS else text
    return rows.withColumns(made)
