"""File names: base name, suffix and media types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def suffix(path: Column) -> Column:
    """The lower-cased last suffix; a leading dot starts a name, not a suffix."""
    return F.lower(F.regexp_extract(base_name(path), r"^\.*[^.].*?(\.[^.]*)$", 1))


def page_media_type(ext: Column) -> Column:
    """Of what a page is shown as; null for other files."""
    plain = F.substring(ext, 2, 10)
    image = F.when(plain == "jpg", "image/jpeg").when(plain.isin("tif", "tiff"), "image/tiff").otherwise(F.concat(F.lit("image/"), plain))
    return F.when(ext == ".pdf", "image/jpeg").when(plain.isin("png", "jpg", "jpeg", "tiff", "tif", "bmp", "webp"), image)


def file_media_type(ext: Column) -> Column:
    """Of the file itself, image suffixes as they are written."""
    plain = F.substring(ext, 2, 10)
    return F.when(ext == ".pdf", "application/pdf").when(plain.isin("png", "jpg", "jpeg", "tiff", "tif", "bmp", "webp"), F.concat(F.lit("image/"), plain)).otherwise("application/octet-stream")
