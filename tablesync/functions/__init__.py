"""Column expressions: keys, predicates, time and text. All run inside the JVM."""

from tablesync.functions.keys import as_predicate, enum_valid, key_predicate, null_safe_equal, surrogate_key
from tablesync.functions.text import account_label, clean_username, ingestion_text
from tablesync.functions.times import (
    EPOCH,
    day_minute_path,
    day_path,
    duration_seconds,
    epoch_micros,
    from_epoch_seconds,
    instant_to_utc,
    ntz,
    text_to_utc,
    to_epoch,
    zoned_to_utc,
)

__all__ = [
    "EPOCH",
    "account_label",
    "as_predicate",
    "clean_username",
    "day_minute_path",
    "day_path",
    "duration_seconds",
    "enum_valid",
    "epoch_micros",
    "from_epoch_seconds",
    "ingestion_text",
    "instant_to_utc",
    "key_predicate",
    "ntz",
    "null_safe_equal",
    "surrogate_key",
    "text_to_utc",
    "to_epoch",
    "zoned_to_utc",
]
