"""Text expressions, all inside generated code: names, slugs, statements, words, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that separate words, as Unicode lists them.
SPACES = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE_CHARACTERS = "".join(
    chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)

# File endings and the modality each stands for.
TABULAR = (".csv", ".tsv", ".xlsx", ".parquet", ".json")
IMAGE = (".png", ".jpg", ".jpeg", ".bmp", ".gif", ".tiff")
AUDIO = (".wav", ".mp3", ".flac", ".ogg", ".m4a")
VIDEO = (".mp4", ".avi", ".mov", ".mkv")
VIDEO_BY_NAME_ONLY = (".webm",)


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.btrim(c, F.lit(SPACE_CHARACTERS))


def normalize_name(c: Column) -> Column:
    """Column name as hints expect it: stripped, lower case, blanks as underscores."""
    return F.replace(F.lower(strip(c)), F.lit(" "), F.lit("_"))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def title_label(c: Column) -> Column:
    """``binary_classification`` -> ``Binary Classification``."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def words(c: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(c, f"[{SPACES}]+"), lambda w: w != "")


def first_token(c: Column) -> Column:
    return F.upper(F.regexp_extract(c, f"^[{SPACES}]*([^{SPACES}]+)", 1))


def clean_statement(c: Column) -> Column:
    """A SQL text without code fences, backticks and comments."""
    c = F.regexp_replace(c, "(?i)```(?:sql)?", "")
    c = F.replace(c, F.lit("`"), F.lit(""))
    c = F.regexp_replace(c, r"--[^\n]*", "")
    return strip(F.regexp_replace(c, r"(?s)/\*.*?\*/", ""))


def is_select(c: Column) -> Column:
    return first_token(c) == "SELECT"


def chunk_starts(n_words: Column, size: int, overlap: int) -> Column:
    """0, step, 2*step … below the word count; empty for no words."""
    return F.when(
        n_words > 0, F.sequence(F.lit(0), n_words - 1, F.lit(size - overlap))
    ).otherwise(F.array().cast("array<int>"))


def file_extension(path: Column) -> Column:
    """Lower-case ending with its dot; a leading dot alone makes no ending."""
    return F.lower(F.regexp_extract(path, r"[^/\\.][^/\\]*?(\.[^./\\]+)$", 1))


def modality(path: Column, mime: Column) -> Column:
    """tabular / image / audio / video; the MIME type decides when there is one."""
    ext = file_extension(path)
    by_mime = (
        F.when(mime.contains("tabular") | mime.contains("csv") | mime.contains("excel"), "tabular")
        .when(mime.contains("image") | ext.isin(*IMAGE), "image")
        .when(mime.contains("audio") | ext.isin(*AUDIO), "audio")
        .when(mime.contains("video") | ext.isin(*VIDEO), "video")
    )
    by_name = (
        F.when(ext.isin(*TABULAR), "tabular")
        .when(ext.isin(*IMAGE), "image")
        .when(ext.isin(*AUDIO), "audio")
        .when(ext.isin(*VIDEO, *VIDEO_BY_NAME_ONLY), "video")
    )
    has_mime = F.coalesce(mime, F.lit("")) != ""
    return F.coalesce(F.when(has_mime, by_mime).otherwise(by_name), F.lit("tabular"))


def utf8_text(content: Column) -> Column:
    """Bytes as UTF-8 text, invalid bytes left out."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("\ufffd"), F.lit(""))
