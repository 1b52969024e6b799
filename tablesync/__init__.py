"""Keeping analytic tables in step with incoming data, as Spark plans."""

from tablesync.contract import ColumnContract, Reference, TableContract, stored_table
from tablesync.errors import ContractError, PredicateError
from tablesync.session import build_session

__all__ = ["ColumnContract", "ContractError", "PredicateError", "Reference", "TableContract", "build_session", "stored_table"]
