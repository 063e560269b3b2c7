"""Bands and rules. The scales differ on purpose; each is a function of its own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bands(v: Column, cuts: list[tuple[float, str]], rest: str) -> Column:
    """The name of the first cut that v reaches."""
    out = F.when(v >= cuts[0][0], cuts[0][1])
    for at, name in cuts[1:]:
        out = out.when(v >= at, name)
    return out.otherwise(rest)


def confidence_level(v: Column) -> Column:
    return F.when(v >= 0.8, "high").when(v >= 0.5, "medium").when(v > 0, "low").otherwise("missing")


def grid_colour(v: Column) -> Column:
    return F.when(v >= 0.8, "high").when(v >= 0.6, "medium").when(v > 0, "low").otherwise("none")


def completeness_level(v: Column) -> Column:
    return bands(v, [(0.95, "excellent"), (0.8, "good"), (0.6, "fair")], "poor")


def overall_label(v: Column) -> Column:
    return bands(v, [(0.9, "Excellent"), (0.8, "Good"), (0.7, "Fair")], "Needs Improvement")


def speed(v: Column) -> Column:
    return F.when(v <= 0, F.lit(None)).when(v < 2, "Fast").when(v < 5, "Normal").otherwise("Slow")


def grade(v: Column) -> Column:
    return bands(v, [(90, "A"), (80, "B"), (70, "C"), (60, "D")], "F")


def performance(rate: Column) -> Column:
    return F.when(rate > 0.9, "Good").when(rate > 0.7, "Fair").otherwise("Poor")


def memory_pressure(v: Column) -> Column:
    return F.when(v > 75, "critical").when(v > 60, "warning").otherwise("normal")


#: Names of errors by what they are, a narrower kind with its wider one.
CONNECTION = ("ConnectionError", "ConnectionResetError", "ConnectionRefusedError", "ConnectionAbortedError", "BrokenPipeError")
TIMEOUT = ("TimeoutError",)
NO_FILE = ("FileNotFoundError",)
NO_ACCESS = ("PermissionError",)
OTHER_FILE = ("IsADirectoryError", "NotADirectoryError", "FileExistsError")
SYSTEM = ("MemoryError", "SystemExit", "KeyboardInterrupt")
VALUE = ("ValueError", "UnicodeDecodeError", "UnicodeEncodeError", "JSONDecodeError")


def error_class(name: Column, status: Column) -> Column:
    """temporary, permanent or critical: by the error's name, else by the HTTP status it carries, else temporary."""
    return (
        F.when(name.isin(*CONNECTION, *TIMEOUT), "temporary")
        .when(name.isin(*NO_FILE, *NO_ACCESS, "IsADirectoryError"), "permanent")
        .when(name.isin(*SYSTEM), "critical")
        .when((status >= 400) & (status < 500), "permanent")
        .otherwise("temporary")
    )


def should_retry(name: Column, status: Column, attempt: Column, most: int = 3) -> Column:
    """Temporary errors of a kind that is tried again, while attempts are left."""
    again = name.isin(*CONNECTION, *TIMEOUT, *NO_FILE, *NO_ACCESS, *OTHER_FILE, "OSError")
    return F.coalesce((error_class(name, status) == "temporary") & (attempt < most) & again, F.lit(False))


def error_kind(name: Column) -> tuple[Column, Column, Column]:
    """(category, severity, start of the message) of what an error is reported as."""
    rows = [
        (NO_FILE, "file_access", "medium", "File not found: "), (NO_ACCESS, "file_access", "medium", "Permission denied: "),
        (CONNECTION, "api_error", "medium", "Network connection error: "), (VALUE, "validation_error", "medium", "Invalid value: "),
    ]
    out = [F.lit("configuration_error"), F.lit("high"), F.lit("Unexpected error: ")]
    for names, *said in rows:
        out = [F.when(name.isin(*names), x).otherwise(rest) for x, rest in zip(said, out)]
    return out[0], out[1], out[2]


def retry_delay(attempt: Column, base: float = 1.0, factor: float = 2.0, most: float = 60.0) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(factor), attempt - 1), F.lit(most))


#: How hard a format is.
FORMAT_FACTORS = {"pdf": 1.0, "docx": 0.8, "doc": 0.9, "xlsx": 0.7, "xls": 0.8, "txt": 0.3, "rtf": 0.6, "odt": 0.8, "ods": 0.7}


#: Megabytes up to which a file is so many times as hard.
SIZE_STEPS = ((1, 1.0), (5, 1.2), (10, 1.5), (50, 2.0))


def complexity(extension: Column, size: Column) -> Column:
    factor = F.lit(1.2)
    for name, value in FORMAT_FACTORS.items():
        factor = F.when(extension == name, value).otherwise(factor)
    mb = F.coalesce(size, F.lit(5 << 20)) / float(1 << 20)
    steps = F.lit(3.0)
    for most, value in reversed(SIZE_STEPS):
        steps = F.when(mb <= most, value).otherwise(steps)
    return factor * steps


def duration(complexity_: Column) -> Column:
    """Seconds that a file of this complexity is expected to take."""
    return complexity_ * 60.0


def completeness_band(v: Column, optional: Column) -> Column:
    return F.when(v >= 0.9, "high").when(v >= 0.7, "medium").when(optional, "optional_low").otherwise("required_low")


def preview_section(missing: Column, score: Column) -> Column:
    return F.when(missing, "missing").when(score >= 0.8, "high").when(score >= 0.5, "medium").otherwise("low")


def field_status(missing: Column, optional: Column, score: Column) -> Column:
    """What is said beside a field; null for nothing."""
    return F.when(missing, F.when(~optional, "⚠ Required field missing")).when(score < 0.5, "⚠ Low confidence - please verify").when(score < 0.7, "ℹ Medium confidence")


#: What each status is described as.
STATUS_TEXT = {"completed": "Processing completed successfully", "processing": "Currently processing...", "failed": "Processing failed", "pending": "Waiting to be processed", "cancelled": "Processing was cancelled"}


def status_text(status: Column) -> Column:
    out = F.lit("Unknown status")
    for name, said in STATUS_TEXT.items():
        out = F.when(status == name, said).otherwise(out)
    return out


def scaling(queue: Column, active: Column, workers: Column, least: int = 1, most: int = 8) -> Column:
    """up when over two jobs wait for each worker, down when nothing waits and fewer than half of the workers are busy; else null."""
    return F.when((queue > workers * 2) & (workers < most), "scale_up").when((queue == 0) & (active < F.floor(workers / 2)) & (workers > least), "scale_down")


def dots(v: Column) -> Column:
    """How many of five dots a confidence fills."""
    return F.floor(v * 5)


#: The type names that are shown, by the kind of a value's JSON.
TYPE_NAMES = {"BIGINT": "int", "DOUBLE": "float", "FLOAT": "float", "BOOLEAN": "bool", "STRING": "str", "VOID": "NoneType"}


def value_type(v: Column) -> Column:
    """The run-time type of a value that came as JSON text: int, float, bool, str, NoneType, list or dict; a text that is no JSON is a str. The
    value is read as a variant, and its own schema tells."""
    kind = F.schema_of_variant(F.try_parse_json(v))
    out = F.when(v.isNull(), F.lit(None)).when(kind.isNull(), "str").when(kind.startswith("DECIMAL"), F.when(v.rlike(r"^\s*-?\d+\s*$"), "int").otherwise("float")).when(kind.startswith("ARRAY"), "list").when(kind.startswith("OBJECT"), "dict")
    for name, shown in TYPE_NAMES.items():
        out = out.when(kind == name, shown)
    return out.otherwise("str")
