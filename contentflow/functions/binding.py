"""Small helpers for building plans: naming a value, staging a column, spreading a small input."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tasks that work on texts is dealt out to; not set on a cluster, whose inputs have splits enough.
TEXT_TASKS = "spark.contentflow.text.tasks"


def spread(rows: DataFrame, tasks: int | None = None) -> DataFrame:
    """Deal rows out evenly to ``tasks``, or to as many as the session names; without either they stay where they were read.

    Work on texts is bound by the processor, not by reading. Whoever runs a job
    on a few files asks for this; it is never decided by the size of the input.
    """
    named = rows.sparkSession.conf.get(TEXT_TASKS, None)
    count = tasks or (int(named) if named else None)
    return rows.repartition(count) if count else rows


def text_tasks(spark: SparkSession) -> int:
    """Tasks to deal texts out to that come from an exchange or a written table: as many as the session names, or its shuffle partitions.

    Such texts are packed well, and what goes by bytes makes few tasks of them.
    """
    return int(spark.conf.get(TEXT_TASKS, None) or spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    Column arithmetic copies its operands into the expression tree, so a rule
    that looks at the same parsed part ten times would parse it ten times, and
    rules built on rules would grow exponentially.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def remembered(rule: Callable[..., Column]) -> Callable[..., Column]:
    """Reuse the expression a rule built for the same input.

    A Column is immutable, and building a long rule takes hundreds of calls
    into the JVM; jobs apply the same few rules to the same few columns.
    """
    built: dict[tuple, Column] = {}

    @functools.wraps(rule)
    def once(*arguments, **options) -> Column:
        shown = tuple(str(a) for a in arguments) + tuple(sorted(options.items()))
        # A nested rule may refer to a variable bound around it, which only exists there.
        if any("namedlambdavariable" in str(part) or "lambda" in str(part) for part in shown):
            return rule(*arguments, **options)
        key = (id(SparkContext._gateway), *shown)
        if key not in built:
            built[key] = rule(*arguments, **options)
        return built[key]

    return once


def staged(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later steps read, not re-derive.

    The optimiser pushes filters and join conditions below a projection by
    copying the projected expression, which for a long URL rule costs more
    than it saves. A generated row is a boundary it keeps.
    """
    named = [value.alias(name) for name, value in columns.items()]
    return rows.select("*", F.inline(F.array(F.struct(*named))))
