"""Profiles of text exports: one row per file of a lake, by expressions on its lines."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from cyclelake.functions.text import fold_label, strip

# --- fixed values ---------------------------------------------------------------------
BRAND_SIGNATURES = {
    "arburg": ["protocole arburg", "arburg protokoll", "arburg protocol", "t4012", "t4015", "v4062", "f1403", "f077"],
    "engel": ["engel", "t_cycle", "t_dos", "activeplastificationtime", "cc300"],
    "haitian": ["haitian", "cycletime", "dosingtime", "cushionvolume"],
}
DELIMITERS = [";", ",", "\t", " "]
HEADER_UNITS = ["s", "bar", "cm³", "mm", "°c", "kn", "h:min"]
TRANSPOSED_HEADS = ["variable", "parameter", "parametre", "paramètre"]
TRANSPOSED_TIMES = ["time", "timestamp", "date_time", "dateheure", "date heure"]
TIME_LABELS = ["time", "timestamp", "date", "heure", "datetime", "dateheure", "t007", "startedat", "debut"]
PROCESS_LABELS = [
    "cycletime", "cycletimes", "tcycle", "tempscycle", "t4012", "dosingtime", "tdos", "t4015",
    "injectiontime", "tinj", "t4018", "cushion", "cushionvolume", "vmat", "v4062",
    "switchoverpressure", "psw", "p4072", "peakpressure", "pmax", "cyclecounter", "ncycle", "f1403",
]
MACHINE_LABELS = ["machine", "machineid", "machineerpref", "refmachine"]
BRAND_HINT_LABELS = ["t007", "t4012", "t4015", "t4018", "v4062", "p4072", "f1403"]
FINGERPRINT_VERSION = "tabular-fingerprint/v1"
IDENTIFIER = "^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"
DIGEST = "^[0-9a-f]{64}$"
MAX_FILE_BYTES = 256 * 1024 * 1024
MAX_COLUMNS = 2048
MAX_CELL_CHARS = 16384
# --------------------------------------------------------------------------------------
SAMPLE_BYTES = 8192


def settled(df: DataFrame) -> DataFrame:
    """The same rows, with all columns computed before the next step uses them.

    Without it Catalyst merges the steps into one projection and repeats an expression such
    as the delimiter inside every later one.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, with the value computed once a row; in a lambda Catalyst computes it at every place that names it."""
    return F.transform(F.array(value), use)[0]


def text_lines(text: Column) -> Column:
    """Lines without their ends; a final line end adds no line."""
    body = F.regexp_replace(text, r"(\r\n|\n|\r)\z", "")
    return F.split(body, r"\r\n|\n|\r")


def cells(line: Column, delimiter: Column) -> Column:
    return F.split(line, F.concat(F.lit("\\Q"), delimiter, F.lit("\\E")))


def filled_cells(line: Column, delimiter: Column) -> Column:
    return F.filter(F.transform(cells(line, delimiter), lambda c: strip(c)), lambda c: c != "")


def occurrences(text: Column, part: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))


def with_encoding(files: DataFrame) -> DataFrame:
    """Add `encoding` and `is_binary` from the bytes of `content`.

    Byte order marks first, then the NUL pattern of UTF-16 without a mark, then valid UTF-8,
    else Latin-1. A text counts as binary with over 1 % NUL or 5 % control bytes.
    """
    content = F.col("content")
    mark = F.hex(F.substring(content, 1, 3))
    sample = F.decode(F.substring(content, 1, SAMPLE_BYTES), "ISO-8859-1")
    even = F.regexp_replace(sample, r"(?s)(.).?", "$1")
    odd = F.regexp_replace(sample, r"(?s).(.?)", "$1")
    share = lambda t: occurrences(t, "\x00") / F.greatest(F.lit(1), F.length(t))
    utf16_bom = mark.startswith("FFFE") | mark.startswith("FEFF")
    utf8_bom = mark == "EFBBBF"
    guess = F.when((share(odd) > 0.3) & (share(even) < 0.05), "UTF-16LE").when(
        (share(even) > 0.3) & (share(odd) < 0.05), "UTF-16BE"
    )
    # the sample's NULs removed leave the other byte of plain characters
    plain = F.replace(sample, F.lit("\x00"), F.lit(""))
    printable = F.length(F.regexp_replace(plain, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")) / F.greatest(
        F.lit(1), F.length(plain)
    )
    utf16_plain = (
        guess.isNotNull() & (F.length(sample) >= 8) & (printable > 0.9) & plain.contains("\n") & plain.rlike("[,;\t|]")
    )
    control = F.length(sample) - F.length(F.regexp_replace(sample, r"[\x00-\x08\x0E-\x1F]", ""))
    ratio = F.greatest(F.lit(1), F.length(sample))
    return files.withColumns(
        {
            "encoding": F.when(utf16_bom, "UTF-16")
            .when(utf8_bom, "UTF-8")
            .when(utf16_plain, guess)
            .when(F.is_valid_utf8(content.cast("string")), "UTF-8")
            .otherwise("ISO-8859-1"),
            "is_binary": ~(utf16_bom | utf8_bom | F.coalesce(utf16_plain, F.lit(False)))
            & ((occurrences(sample, "\x00") / ratio > 0.01) | (control / ratio > 0.05)),
        }
    )


def with_lines(files: DataFrame) -> DataFrame:
    """Add `lines` of decoded, non-binary files (a byte order mark is dropped)."""
    text = F.regexp_replace(F.call_function("decode", F.col("content"), F.col("encoding")), "^\\x{FEFF}", "")
    return files.withColumn("lines", F.when(~F.col("is_binary"), text_lines(text)))


def detect_delimiter(lines: Column) -> Column:
    """The delimiter most of the first 20 lines repeat, else the most frequent one."""
    head = F.slice(lines, 1, 20)

    def option(place: int, mark: str) -> Column:
        repeated = F.size(F.filter(head, lambda line: occurrences(line, mark) >= 2))
        total = F.aggregate(
            head, F.lit(0).cast("bigint"), lambda acc, line: acc + occurrences(line, mark).cast("bigint")
        )
        return F.struct(
            repeated.alias("repeated"), total.alias("total"), F.lit(-place).alias("place"), F.lit(mark).alias("mark")
        )

    options = F.array(*[option(place, mark) for place, mark in enumerate(DELIMITERS)])
    def best(found: Column) -> Column:
        by_repeat = F.array_max(F.transform(found, lambda o: F.struct(o.repeated, o.place, o.mark)))
        by_total = F.array_max(F.transform(found, lambda o: F.struct(o.total, o.place, o.mark)))
        return F.when(by_repeat.repeated > 0, by_repeat.mark).otherwise(by_total.mark)

    return let(options, best)


def detect_transposed(lines: Column, delimiter: Column) -> Column:
    """Parameters in rows: named as such with a time row below, or far wider than long."""
    filled = F.filter(lines, lambda line: strip(line) != "")

    def by_name(first: Column) -> Column:
        below = F.slice(first, 2, F.greatest(F.size(first) - 1, F.lit(0)))
        times = F.array(*[F.lit(t) for t in TRANSPOSED_TIMES])
        return (F.size(first) >= 3) & F.try_element_at(first, F.lit(1)).isin(TRANSPOSED_HEADS) & F.arrays_overlap(below, times)

    named = let(F.transform(filled, lambda line: F.lower(strip(cells(line, delimiter)[0]))), by_name)
    head = F.filter(F.slice(lines, 1, 20), lambda line: strip(line) != "")
    widths = F.aggregate(head, F.lit(0), lambda acc, line: acc + F.size(cells(line, delimiter)))
    average = widths / F.greatest(F.lit(1), F.size(head))
    return F.coalesce(named, F.lit(False)) | ((average > F.size(filled) * 2) & (average > 30))


def detect_brand(lines: Column) -> tuple[Column, Column]:
    """(brand, confidence) by distinct signatures in the first 30 lines; generic if none."""
    content = F.lower(F.array_join(F.slice(lines, 1, 30), "\n"))
    scores = [
        F.struct(
            sum((content.contains(s).cast("int") for s in signatures), F.lit(0)).alias("n"),
            F.lit(-place).alias("place"),
            F.lit(brand).alias("brand"),
        )
        for place, (brand, signatures) in enumerate(BRAND_SIGNATURES.items())
    ]
    best = F.array_max(F.array(*scores))
    return (
        F.when(best.n == 0, "generic").otherwise(best.brand),
        F.when(best.n == 0, 0.0).otherwise(F.round(F.least(best.n / 4, F.lit(1.0)), 2)),
    )


def looks_like_header(line: Column, delimiter: Column) -> Column:
    def mostly_words(parts: Column) -> Column:
        words = F.size(F.filter(parts, lambda c: c.rlike("^[a-zA-Z]")))
        return let(words, lambda n: (F.size(parts) >= 3) & (n > F.size(parts) * 0.4) & (n > 2))

    return let(filled_cells(line, delimiter), mostly_words)


def find_header(lines: Column, delimiter: Column) -> Column:
    """0-based header row: the first with three or more cells, mostly words; 0 if none."""
    hits = F.transform(lines, lambda line, i: F.when(looks_like_header(line, delimiter), i))
    return F.coalesce(F.array_min(hits), F.lit(0))


def profile_files(files: DataFrame) -> DataFrame:
    """Structure of every file of (path, content), one row per file.

    A file is one row. Files beyond the reading limit are told apart by their length alone, which the file
    scan evaluates before it opens them; they keep a row without content (see `guard_files`).
    """
    if "length" in files.columns:
        within = F.coalesce(F.col("length"), F.lit(0)) <= MAX_FILE_BYTES
        beyond = files.where(~within).withColumn("content", F.lit(None).cast("binary"))
        files = files.where(within).unionByName(beyond)
    base = settled(with_lines(settled(with_encoding(files))).drop("content"))
    base = settled(base.withColumn("delimiter", detect_delimiter(F.col("lines"))))
    brand, confidence = detect_brand(F.col("lines"))
    base = base.withColumns(
        {
            "is_transposed": detect_transposed(F.col("lines"), F.col("delimiter")),
            "brand": brand,
            "brand_confidence": confidence,
            "row_count": F.size("lines"),
            "header_row": find_header(F.col("lines"), F.col("delimiter")),
        }
    )
    base = settled(
        settled(base).withColumn("header_row", F.when(F.col("is_transposed"), 0).otherwise(F.col("header_row")))
    )
    line_at = lambda n: F.try_element_at(F.col("lines"), n)
    below = filled_cells(F.coalesce(line_at(F.col("header_row") + 2), F.lit("")), F.col("delimiter"))
    is_units = F.size(F.filter(below, lambda c: F.lower(c).isin(HEADER_UNITS))) > 1
    base = settled(
        base.withColumn("unit_row", F.when(~F.col("is_transposed") & is_units, F.col("header_row") + 1))
    )
    header = filled_cells(F.coalesce(line_at(F.col("header_row") + 1), F.lit("")), F.col("delimiter"))
    units = F.transform(
        cells(line_at(F.col("unit_row") + 1), F.col("delimiter")), lambda c: strip(c)
    )
    made = base.withColumns(
        {
            "data_start": F.when(F.col("is_transposed"), 1).otherwise(
                F.coalesce(F.col("unit_row"), F.col("header_row")) + 1
            ),
            "headers": F.when(
                F.col("is_transposed"),
                F.transform("lines", lambda line: strip(cells(line, F.col("delimiter"))[0])),
            ).otherwise(header),
            "units": units,
            "metadata": F.when(F.col("is_transposed"), F.array().cast("array<string>")).otherwise(
                F.slice("lines", 1, F.col("header_row"))
            ),
            "column_count": F.when(F.col("is_transposed"), F.size("lines")).otherwise(F.size(header)),
        }
    )
    return settled(made)


def with_metadata(profiles: DataFrame) -> DataFrame:
    """Add `metadata_keys` (sorted, distinct) and `reference_date` of the lines above the header."""
    pair = F.transform(
        "metadata",
        lambda line: F.struct(
            fold_label(F.split(filled_cells(line, F.col("delimiter"))[0], ":", 2)[0]).alias("key"),
            F.try_element_at(filled_cells(line, F.col("delimiter")), F.lit(2)).alias("value"),
        ),
    )
    keys = F.filter(F.transform(pair, lambda p: p.key), lambda k: k.isNotNull() & (k != "") & ~k.rlike("^[0-9]+$"))
    dated = F.filter(pair, lambda p: p.key.startswith("date") & p.value.isNotNull())
    made = profiles.withColumns(
        {
            "metadata_keys": F.array_sort(F.array_distinct(keys)),
            "reference_date": F.split(F.try_element_at(dated, F.lit(1)).value, r"\s+")[0],
        }
    )
    return settled(made)


def with_fingerprint(profiles: DataFrame) -> DataFrame:
    """Add `fingerprint`: SHA-256 of the structure; values and paths do not take part."""
    columns = F.transform(
        "headers",
        lambda label, i: F.struct(
            i.alias("position"),
            fold_label(label).alias("label"),
            F.when(F.coalesce(F.try_element_at("units", i + 1), F.lit("")) != "", fold_label(F.try_element_at("units", i + 1))).alias("unit"),
        ),
    )
    structure = F.struct(
        F.lit(FINGERPRINT_VERSION).alias("schema"),
        F.when(F.col("is_binary"), "binary").otherwise("delimited_text").alias("family"),
        F.when(F.col("is_transposed"), "transposed").otherwise("rows").alias("orientation"),
        "delimiter",
        "header_row",
        "unit_row",
        "data_start",
        columns.alias("columns"),
        "metadata_keys",
    )
    return settled(profiles.withColumn("fingerprint", F.sha2(F.to_json(structure), 256)))


def _folded(headers: str = "headers") -> Column:
    return F.transform(headers, lambda h: fold_label(h))


def _any_of(labels: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(labels, F.array(*[F.lit(w) for w in wanted]))


def with_classification(profiles: DataFrame) -> DataFrame:
    """Add structural brand hint, the three signals, `structure_score` and `structure_label`."""
    labels = F.concat(_folded(), F.coalesce("metadata_keys", F.array().cast("array<string>")))
    hits = F.size(F.array_intersect(labels, F.array(*[F.lit(x) for x in BRAND_HINT_LABELS])))
    hint = (
        F.when(hits >= 2, "arburg")
        .when(F.exists(labels, lambda x: x.contains("kistler")), "kistler")
        .when(_any_of(labels, ["tcycle", "activeplastificationtime", "cc300"]), "engel")
        .otherwise("generic")
    )
    own = _folded()
    has_time = _any_of(own, TIME_LABELS)
    has_process = _any_of(own, PROCESS_LABELS)
    has_context = _any_of(own, MACHINE_LABELS) | (hint != "generic")
    point = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    score = F.round(0.4 * point(has_time) + 0.4 * point(has_process) + 0.2 * point(has_context), 2)
    usable = F.when(F.col("is_binary"), 0.0).otherwise(score)
    made = profiles.withColumns(
        {
            "brand_hint": hint,
            "structure_score": usable,
            "structure_label": F.when(F.col("is_binary"), "binary_unsupported")
            .when(usable >= 0.8, "machine_export")
            .otherwise("tabular_unknown"),
        }
    )
    return settled(made)


def fingerprint_groups(profiles: DataFrame) -> DataFrame:
    """(fingerprint, path, files): membership rows with the group's size.

    A group may hold a large share of all files, so it stays rows and is not one list.
    """
    sizes = profiles.groupBy("fingerprint").agg(F.count("*").alias("files"))
    return profiles.select("fingerprint", "path").join(sizes, "fingerprint")


def check_profiles(registry: DataFrame) -> DataFrame:
    """Add `registry_error` to the rows of a profile registry, null for the usable ones.

    Approved profiles need their field validation; enabled ones a digest of the current fingerprint version.
    Evidence columns that the registry does not have are not asked for.
    """
    named = lambda c: F.coalesce(F.col(c).rlike(IDENTIFIER), F.lit(False))
    evidence = [F.col(c).isNotNull() & (F.col(c).cast("string") != "") for c in ("approved_at", "approved_by") if c in registry.columns]
    evidence += [F.coalesce("field_validated", F.lit(False))] if "field_validated" in registry.columns else []
    enabled = F.coalesce("match_enabled", F.lit(True))
    error = (
        F.when(~F.coalesce(F.col("status").isin("approved", "candidate"), F.lit(False)), "status_invalid")
        .when((F.col("status") == "approved") & ~reduce(lambda a, b: a & b, evidence, F.lit(True)), "approval_without_evidence")
        .when(~named("profile_id"), "identifier_invalid")
        .when(~named("profile_version"), "version_invalid")
        .when(F.col("parser_version").isNotNull() & ~named("parser_version"), "parser_version_invalid")
        .when(enabled & ~F.col("fingerprint_version").eqNullSafe(FINGERPRINT_VERSION), "fingerprint_version_unsupported")
        .when(enabled & ~F.coalesce(F.col("digest").rlike(DIGEST), F.lit(False)), "digest_invalid")
    )
    return registry.withColumn("registry_error", error)


def match_profiles(profiles: DataFrame, registry: DataFrame) -> DataFrame:
    """Add `profile_status` approved/candidate/none/duplicate and the chosen profile.

    `registry`: profile_id, profile_version, status, match_enabled, digest, fingerprint_version,
    parser_version. Approved beats candidate; two of the chosen status are an error status. Rows that
    `check_profiles` finds fault with take no part.
    """
    enabled = check_profiles(registry).where(F.col("registry_error").isNull() & F.coalesce("match_enabled", F.lit(True)))
    per_status = enabled.groupBy("digest").agg(
        F.count_if(F.col("status") == "approved").alias("_approved"),
        F.count_if(F.col("status") == "candidate").alias("_candidates"),
        F.min(F.when(F.col("status") == "approved", F.struct("profile_id", "profile_version", "parser_version"))).alias("_a"),
        F.min(F.when(F.col("status") == "candidate", F.struct("profile_id", "profile_version", "parser_version"))).alias("_c"),
    )
    n_a, n_c = F.col("_approved"), F.col("_candidates")
    chosen = F.when(n_a == 1, F.col("_a")).when((n_a == 0) & (n_c == 1), F.col("_c"))
    return (
        profiles.join(per_status, F.col("fingerprint") == F.col("digest"), "left")
        .withColumn(
            "profile_status",
            F.when((n_a > 1) | ((n_a == 0) & (n_c > 1)), "duplicate")
            .when(n_a == 1, "approved")
            .when(n_c == 1, "candidate")
            .otherwise("none"),
        )
        .withColumns(
            {"profile_id": chosen.profile_id, "profile_version": chosen.profile_version, "parser_version": chosen.parser_version}
        )
        .drop("digest", "_approved", "_candidates", "_a", "_c")
    )


def invalid_registry_rows(registry: DataFrame) -> DataFrame:
    """Registry rows that break the profile contract, with the reason."""
    name = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"
    reason = (
        F.when(~F.col("status").isin("approved", "candidate"), "status")
        .when(
            (F.col("status") == "approved")
            & (F.col("approved_at").isNull() | F.col("approved_by").isNull() | ~F.coalesce("field_validated", F.lit(False))),
            "approval_evidence",
        )
        .when(~F.col("profile_id").rlike(name), "profile_id")
        .when(~F.col("profile_version").rlike(name), "profile_version")
        .when(F.col("parser_version").isNotNull() & ~F.col("parser_version").rlike(name), "parser_version")
        .when(
            F.coalesce("match_enabled", F.lit(True)) & (F.coalesce("fingerprint_version", F.lit("")) != FINGERPRINT_VERSION),
            "fingerprint_version",
        )
        .when(
            F.coalesce("match_enabled", F.lit(True)) & ~F.coalesce("digest", F.lit("")).rlike("^[0-9a-f]{64}$"), "digest"
        )
    )
    return registry.withColumn("reason", reason).where(F.col("reason").isNotNull())


def with_balance(profiles: DataFrame) -> DataFrame:
    """Add `unbalanced`: the first ten non-empty lines differ in their number of cells."""
    head = F.slice(F.filter("lines", lambda line: strip(line) != ""), 1, 10)
    widths = F.transform(head, lambda line: F.size(cells(line, F.col("delimiter"))))
    return profiles.withColumn("unbalanced", F.size(F.array_distinct(widths)) > 1)


def guard_files(profiles: DataFrame) -> DataFrame:
    """Add `guard_code`: why a file is beyond the reading limits, null if it is not."""
    measured = F.transform(
        "lines",
        lambda line: let(
            cells(line, F.col("delimiter")),
            lambda parts: F.struct(F.size(parts).alias("cells"), F.array_max(F.transform(parts, lambda c: F.length(c))).alias("longest")),
        ),
    )
    code = let(
        measured,
        lambda m: F.when(F.col("length") == 0, "INGEST_EMPTY_FILE")
        .when(F.col("length") > MAX_FILE_BYTES, "INGEST_FILE_TOO_LARGE")
        .when(F.array_max(F.transform(m, lambda x: x["cells"])) > MAX_COLUMNS, "INGEST_TOO_MANY_COLUMNS")
        .when(F.array_max(F.transform(m, lambda x: x["longest"])) > MAX_CELL_CHARS, "INGEST_CELL_TOO_LARGE"),
    )
    return profiles.withColumn("guard_code", code)
