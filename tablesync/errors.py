"""Exceptions raised while a plan is being built.

Violations that depend on the rows surface when the plan runs, as Spark's own
``USER_RAISED_EXCEPTION`` (see :mod:`tablesync.operators.guards`).
"""


class ContractError(ValueError):
    """A table contract is malformed, or a request does not fit the contract."""


class PredicateError(ValueError):
    """A mandatory predicate is missing or blank."""
