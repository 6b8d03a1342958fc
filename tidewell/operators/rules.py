"""Rule checks as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Message = str | Column


def _text(message: Message) -> Column:
    return message if isinstance(message, Column) else F.lit(message)


def first_failure(checks: Sequence[tuple[Column, Message]]) -> Column:
    """Message of the first check that fails, null when none does."""
    chain = F
    for failed, message in checks:
        chain = chain.when(failed, _text(message))
    return chain.otherwise(F.lit(None).cast("string"))


def failure(rule: tuple[str, str], failed: Column) -> tuple[str, Column, Message]:
    """A check of ``all_failures`` from a (field, message) pair."""
    return rule[0], failed, rule[1]


def all_failures(checks: Sequence[tuple[str, Column, Message]]) -> Column:
    """Map of field -> message of every check that fails; a later check of a field overwrites an earlier one."""
    messages: dict[str, Column] = {}
    for field, failed, message in checks:
        earlier = messages.get(field, F.lit(None).cast("string"))
        messages[field] = F.when(failed, _text(message)).otherwise(earlier)
    every = F.map_from_arrays(F.array(*[F.lit(f) for f in messages]), F.array(*messages.values()))
    return F.map_filter(every, lambda _, message: message.isNotNull())


def with_status(failures: Column) -> Column:
    """The failure map plus ``status``: ``failed`` or ``success``."""
    status = F.when(F.size(failures) > 0, "failed").otherwise("success")
    return F.map_concat(failures, F.create_map(F.lit("status"), status))
