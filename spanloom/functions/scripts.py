"""Scripts of characters, by ranges of code points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---- fixed values: first and last code point, script ----
SCRIPTS = (
    (0x0041, 0x005A, "Latin"), (0x0061, 0x007A, "Latin"), (0x00AA, 0x00AA, "Latin"), (0x00BA, 0x00BA, "Latin"), (0x00C0, 0x00D6, "Latin"), (0x00D8, 0x00F6, "Latin"), (0x00F8, 0x02B8, "Latin"),
    (0x0370, 0x0373, "Greek"), (0x0375, 0x0377, "Greek"), (0x037A, 0x037D, "Greek"), (0x0386, 0x0386, "Greek"), (0x0388, 0x03E1, "Greek"), (0x0400, 0x052F, "Cyrillic"), (0x0531, 0x058A, "Armenian"), (0x0591, 0x05F4, "Hebrew"), (0x0620, 0x063F, "Arabic"), (0x0641, 0x064A, "Arabic"), (0x0900, 0x0963, "Devanagari"),
    (0x0E01, 0x0E3A, "Thai"), (0x10A0, 0x10FF, "Georgian"), (0x1100, 0x11FF, "Hangul"), (0x1E00, 0x1EFF, "Latin"), (0x1F00, 0x1FFE, "Greek"), (0x2C60, 0x2C7F, "Latin"), (0x2E80, 0x2FD5, "Han"), (0x3041, 0x3096, "Hiragana"), (0x30A1, 0x30FA, "Katakana"), (0x3400, 0x4DBF, "Han"), (0x4E00, 0x9FFF, "Han"), (0xA722, 0xA787, "Latin"), (0xAC00, 0xD7A3, "Hangul"), (0xFF21, 0xFF3A, "Latin"), (0xFF41, 0xFF5A, "Latin"), (0x20000, 0x2FA1D, "Han"),
)
# ---- end of fixed values ----


def script_table(spark: SparkSession) -> DataFrame:
    """(start, end, script) of SCRIPTS."""
    return spark.createDataFrame(list(SCRIPTS), "start int, end int, script string")
