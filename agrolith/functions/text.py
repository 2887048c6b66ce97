"""Recognised text, progress messages, paths and formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shapes of serial numbers, with and without hyphens.
SERIAL = r"[A-Z0-9][A-Z0-9-]{8,18}[A-Z0-9]"
PLAIN_SERIAL = r"[A-Z0-9]{10,20}"


def ocr_normal(text: Column) -> Column:
    """Upper case; only letters, digits, white space and hyphens; white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(text), r"[^A-Z0-9\s-]", ""), r"\s+", " "))


def serial_candidates(normal: Column) -> Column:
    """Distinct candidates in the order of discovery: with hyphens first, then of the text without hyphens."""
    return F.array_distinct(F.concat(F.regexp_extract_all(normal, F.lit(SERIAL), F.lit(0)), F.regexp_extract_all(F.regexp_replace(normal, "-", ""), F.lit(PLAIN_SERIAL), F.lit(0))))


def serial_score(candidate: Column, mean_confidence: Column | None = None) -> Column:
    """Points for a candidate's length and kinds of characters, and a tenth of its words' mean confidence."""
    clean = F.regexp_replace(candidate, "-", "")
    n = F.length(clean)
    letters, digits = clean.rlike("[A-Z]"), clean.rlike("[0-9]")
    points = F.when(n.between(14, 17), 50).when(n.between(10, 20), 30).otherwise(0) + F.when(letters & digits, 20).otherwise(0) - F.when(digits & ~letters, 20).otherwise(0)
    return points.cast("double") + (F.coalesce(mean_confidence, F.lit(0.0)) / 10 if mean_confidence is not None else F.lit(0.0))


def needs_retry(serial: Column, confidence: Column) -> Column:
    return serial.isNull() | (confidence < 60) | (F.length(F.regexp_replace(serial, "[^A-Z0-9]", "")) < 10)


def progress_percent(status: Column, message: Column) -> Column:
    """Percent from "Stage i/n" in a message; 5 while queued, 50 if nothing tells."""
    pattern = r"(?i)stage\s*(\d{1,9})\s*/\s*(\d{1,9})"
    at, of = (F.regexp_extract(message, pattern, k) for k in (1, 2))
    known = (at != "") & (F.when(of != "", of).otherwise("0").cast("int") > 0)
    share = F.floor((F.when(at != "", at).otherwise("0").cast("double") - 0.5) / F.when(of.isin("", "0"), "1").otherwise(of).cast("double") * 100 + 0.5)
    return F.when(known, share).when(status == "queued", 5).otherwise(50).cast("int")


def blended_progress(stage: Column, percent: Column) -> Column:
    """Upload fills 0 to 30, processing 30 to 90, download 90 to 100."""
    x = F.when(stage == "upload", percent * 0.3).when(stage == "processing", 30 + percent * 0.6).when(stage == "download", 90 + percent * 0.1).otherwise(0.0)
    return F.floor(x + 0.5).cast("int")


def epsg_code(wkt: Column) -> Column:
    """The first EPSG authority in a coordinate system's text; 4326 if there is none."""
    found = F.regexp_extract(wkt, r'AUTHORITY\["EPSG","(\d+)"\]', 1)
    return F.concat(F.lit("EPSG:"), F.when(found != "", found).otherwise("4326"))


def file_size_text(size: Column) -> Column:
    kb, mb = 1024, 1024 * 1024
    tenths = lambda x: F.format_string("%.1f", F.floor(x * 10 + 0.5) / 10)  # noqa: E731  halves go up
    return F.when(size < kb, F.concat(size.cast("string"), F.lit(" B"))).when(size < mb, F.concat(tenths(size / kb), F.lit(" KB"))).otherwise(F.concat(tenths(size / mb), F.lit(" MB")))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def tile_url(z: Column, x: Column, y: Column, prefix: str = "/tiles") -> Column:
    return F.concat_ws("/", F.lit(prefix), z.cast("string"), x.cast("string"), F.concat(y.cast("string"), F.lit(".png")))


def retry_delay(attempt: Column, base: float = 1.0, most: float = 60.0) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most))
