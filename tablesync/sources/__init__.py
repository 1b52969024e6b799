"""Readers and writers of files."""

from tablesync.sources.landing import landing_load, landing_write, ndjson_read
from tablesync.sources.logs import LOG, log_read, log_tail

__all__ = ["LOG", "landing_load", "landing_write", "log_read", "log_tail", "ndjson_read"]
