"""The bridge between users and accounts.

An account that very many users follow is a hot key on the bridge side. The other
side of those joins is left as a plain scan of unique keys, because AQE only cuts a
skewed join whose two inputs come straight from an exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesync.contract import TableContract
from tablesync.functions import account_label, clean_username, ingestion_text
from tablesync.operators.guards import guard_empty, key_set
from tablesync.operators.merge import absent_from
from tablesync.operators.outcome import WriteOutcome
from tablesync.operators.writes import insert_ignore


def accounts_for_user(
    bridge: DataFrame, accounts: DataFrame, users: DataFrame | None = None, *, ordered: bool = False
) -> DataFrame:
    """The accounts each user follows; links to a missing account are left out.

    ``ordered`` sorts by user and account, which is one more shuffle.
    """
    if users is not None:
        bridge = bridge.join(users.select("user_id"), "user_id", "left_semi")
    found = bridge.select("user_id", "account_id").join(accounts, "account_id", "inner")
    columns = ["user_id", "account_id", *(c for c in accounts.columns if c != "account_id")]
    found = found.select(*columns)
    return found.orderBy("user_id", "account_id") if ordered else found


def stale_links(bridge: DataFrame, accounts: DataFrame) -> DataFrame:
    """Links whose account is gone."""
    return bridge.join(accounts.select("account_id"), "account_id", "left_anti").select(*bridge.columns)


def live_links(bridge: DataFrame, accounts: DataFrame) -> DataFrame:
    """Links whose account exists."""
    return bridge.join(accounts.select("account_id"), "account_id", "left_semi").select(*bridge.columns)


def unlink_cascade(bridge: DataFrame, users: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and users left once the removed users and all their links are gone."""
    gone = removed.select("user_id")
    return (
        bridge.join(gone, "user_id", "left_anti").select(*bridge.columns),
        users.join(gone, "user_id", "left_anti").select(*users.columns),
    )


def orphan_accounts(accounts: DataFrame, bridge: DataFrame) -> DataFrame:
    """Accounts no user follows."""
    return absent_from(accounts, bridge, ["account_id"], unique_target=False).select(*accounts.columns)


def link_add(
    requests: DataFrame,
    accounts: DataFrame,
    bridge: DataFrame,
    accounts_contract: TableContract,
    bridge_contract: TableContract,
) -> tuple[WriteOutcome, WriteOutcome, DataFrame]:
    """Add accounts, then links, skipping those that exist.

    Returns both writes and a report ``(user_id, account_id, is_new)`` with one
    row per requested link; ``is_new`` speaks of the link, not the account.
    """
    columns = [c for c in accounts_contract.column_names if c in requests.columns]
    order = [c for c in columns if c != "account_id"] or columns
    new_accounts = insert_ignore(accounts, requests.select(*columns), accounts_contract, order_by=order)
    asked = key_set(requests, ["user_id", "account_id"])
    new_links = insert_ignore(bridge, asked, bridge_contract, order_by=["user_id", "account_id"])
    held = key_set(bridge, ["user_id", "account_id"]).withColumn("_held", F.lit(True))
    report = asked.join(held, ["user_id", "account_id"], "left").select(
        "user_id", "account_id", F.col("_held").isNull().alias("is_new")
    )
    return new_accounts, new_links, report


def link_remove(bridge: DataFrame, removals: DataFrame) -> DataFrame:
    """Links left after the removals; a removal without a link fails the job."""
    keys = ["user_id", "account_id"]
    asked = key_set(removals, keys)
    unknown = absent_from(asked, bridge, keys, unique_target=False)
    return guard_empty(bridge, unknown, "no such link").join(asked, keys, "left_anti").select(*bridge.columns)


def account_list(accounts: DataFrame) -> DataFrame:
    """Accounts as they are shown: cleaned name, label and last ingestion; blank names drop out."""
    named = accounts.withColumn("username", clean_username(F.col("username"))).where(F.col("username").isNotNull())
    return named.select(
        "account_id",
        "username",
        account_label(F.col("platform"), F.col("username")).alias("label"),
        ingestion_text(F.col("latest_ingestion")).alias("latest_ingestion"),
    )
