"""The fixed vocabularies and limits of an audit."""

from __future__ import annotations

# fixed values of the report's contract
SEVERITIES = ("critical", "high", "medium", "low")
SUFFIXES = (".pdf", ".png", ".jpg", ".jpeg", ".tiff", ".tif", ".bmp")
PASS, REVIEW, FAIL = "PASS", "REVIEW REQUIRED", "FAIL"
PASS_FROM, REVIEW_FROM = 80.0, 50.0
SINGLE_MARGIN, Z_95 = 12.5, 1.96
MAX_PAGES = 10
