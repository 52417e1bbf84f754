"""From raw callback requests to responses and alerts, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgrisk.operators import callbacks, notices

PAIR = ["account_low", "account_high"]


def answer(
    requests: DataFrame, app_id: str, order: str, scope: str = "conversation",
    rows_per_task: int | None = None,
) -> DataFrame:
    """Each request with its response.

    ``requests`` are raw bodies with their parameters and, beside each, ``rating,
    reasoning, advice`` of its message, null where it has none. Requests are parsed
    and checked; those that fail are refused and leave the state alone. Notices
    follow from the accepted ones only.
    """
    checked = callbacks.validate(callbacks.parse(requests), app_id)
    taken = callbacks.keyed(callbacks.routed(callbacks.accepted(checked)))
    noticed = notices.inject_notices(taken, PAIR, order, scope, rows_per_task)
    refused = callbacks.rejected(checked)
    both = noticed.unionByName(refused, allowMissingColumns=True)
    return callbacks.respond(both)


def alerts(answered: DataFrame, **options) -> DataFrame:
    """Admin messages for the accepted requests that call for one."""
    return callbacks.alerts(answered.filter(F.col("error_info").isNull()), **options)
