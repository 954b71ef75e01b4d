"""JSON sources: errata snapshots and question sets."""

from __future__ import annotations

import json
import os
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from scriptorium.schema import ERRATA, ERRATA_STATUSES

# Names that a field goes by, in any case.
ALIASES = {
    "errata_id": ("errata_id", "eid", "id"),
    "rfc_number": ("rfc_number", "rfc", "doc-id", "doc_id", "document"),
    "section": ("section",),
    "status": ("errata_status_code", "status"),
    "original_text": ("orig_text", "original_text"),
    "corrected_text": ("correct_text", "corrected_text"),
    "reported_date": ("submit_date", "reported_date", "reported_at"),
}


def erratum(entry: object) -> tuple | None:
    """A row of the errata table; None for an entry without a positive id and document."""
    if not isinstance(entry, dict):
        return None
    low = {str(k).lower(): v for k, v in entry.items()}
    get = lambda name: next((str(low[a]).strip() for a in ALIASES[name] if low.get(a) not in (None, "")), None) or None
    numbers = []
    for name in ("errata_id", "rfc_number"):
        value = (get(name) or "").upper().removeprefix("RFC").strip()
        if not value.isdigit() or int(value) <= 0:
            return None
        numbers.append(int(value))
    status = (get("status") or "reported").replace(" ", "_").replace("-", "_")
    status = status.lower() if status.lower() in ERRATA_STATUSES else status
    try:
        reported = date.fromisoformat((get("reported_date") or "")[:10])
    except ValueError:
        reported = None
    return (*numbers, get("section"), status, get("original_text"), get("corrected_text"), reported)


def read_errata(spark: SparkSession, path: str) -> DataFrame:
    """A root array, or an object with ``errata`` or ``entries``; anything else, or no file, gives no rows.

    A snapshot is one JSON document of a few MB, read on the driver as such; bad entries are left out one by one.
    """
    try:
        with open(os.path.expanduser(path), encoding="utf-8") as file:
            root = json.load(file)
    except (OSError, ValueError):
        root = None
    if isinstance(root, dict):
        low = {k.lower(): v for k, v in root.items()}
        root = low.get("errata", low.get("entries"))
    rows = [r for r in map(erratum, root) if r] if isinstance(root, list) else []
    return spark.createDataFrame(rows, ERRATA)


QUESTION = "query_id string, query string, documents array<int>, sections array<string>, must_cite array<int>, should_not_cite array<int>, answer_type string, corpus string, include_obsolete boolean"
FIELDS = ("id", "question", "expectedrfcs", "expectedsections", "mustcite", "shouldnotcite", "answertype", "corpus", "includeobsolete")


def read_questions(spark: SparkSession, path: str, corpus: str = "all") -> DataFrame:
    """A JSON array of questions with names in any case; ``all`` keeps every corpus."""
    with open(os.path.expanduser(path), encoding="utf-8") as file:
        entries = json.load(file)
    rows = []
    for place, entry in enumerate(entries):
        low = {k.lower(): v for k, v in entry.items()}
        low.setdefault("id", f"q{place + 1}")
        low.setdefault("question", low.get("query"))
        low.setdefault("expectedrfcs", low.get("expectedrfcany") or [])
        row = tuple(low.get(f) for f in FIELDS)
        rows.append(tuple([] if v is None and 2 <= i <= 5 else v for i, v in enumerate(row)))
    found = spark.createDataFrame(rows, QUESTION)
    return found if corpus == "all" else found.where(found["corpus"] == corpus)
