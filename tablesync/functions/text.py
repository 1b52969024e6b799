"""Text shown for accounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_username(username: Column) -> Column:
    """Trimmed name; NULL when nothing is left."""
    trimmed = F.trim(username)
    return F.when(trimmed != "", trimmed)


def account_label(platform: Column, username: Column) -> Column:
    return F.concat(platform, F.lit(" - "), username)


def ingestion_text(latest_ingestion: Column) -> Column:
    return F.coalesce(latest_ingestion.cast("string"), F.lit("Never"))
