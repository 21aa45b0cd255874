"""Predicates of routes, dates, conditions and inputs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_scope(origin: Column, destination: Column, of_origin: Column, of_destination: Column) -> Column:
    """A rule's route covers a shipment's; a null end of the rule is any,
    a null end of the shipment is only covered by any."""
    return F.coalesce((of_origin.isNull() | (of_origin == origin)) & (of_destination.isNull() | (of_destination == destination)), F.lit(False))


def browses(value: Column, wanted: str | None) -> Column:
    """A filter that an absent parameter leaves open; null ends are shown."""
    return F.lit(True) if wanted is None else value.isNull() | (value == wanted)


def effective(since: Column, until: Column, on: Column) -> Column:
    """Within both dates, inclusive; null is unbounded."""
    return (since.isNull() | (since <= on)) & (until.isNull() | (until >= on))


def current(sys_to: Column) -> Column:
    """The version that has not been closed."""
    return sys_to.isNull()


def known_at(sys_from: Column, sys_to: Column, at: Column) -> Column:
    """The version that was current at an instant."""
    return (sys_from <= at) & (sys_to.isNull() | (at < sys_to))


def satisfied(conditions: Column, value: Column, currency: Column, metadata: Column) -> Column:
    """All conditions of a rule hold.  ``conditions`` is a struct
    ``min_value, max_value, currency_in, metadata_eq``, null fields are absent;
    a missing value fails a bound; no conditions hold."""
    low, high = conditions["min_value"], conditions["max_value"]
    ok = F.when(low.isNotNull(), F.coalesce(value >= low, F.lit(False))).otherwise(True)
    ok = ok & F.when(high.isNotNull(), F.coalesce(value <= high, F.lit(False))).otherwise(True)
    ok = ok & F.when(conditions["currency_in"].isNotNull(), F.coalesce(F.array_contains(conditions["currency_in"], currency), F.lit(False))).otherwise(True)
    same = F.forall(F.map_entries(conditions["metadata_eq"]), lambda e: F.coalesce(metadata[e["key"]].eqNullSafe(e["value"]), F.lit(False)))
    return ok & F.when(conditions["metadata_eq"].isNotNull(), same).otherwise(True)


CONDITIONS = "min_value double, max_value double, currency_in array<string>, metadata_eq map<string,string>"


def iso(code: Column) -> Column:
    """A country code, trimmed and in capitals, or null if it is not two letters."""
    clean = F.upper(F.trim(code))
    return F.when(clean.rlike("^[A-Z]{2}$"), clean)


def rule_errors(rule: dict[str, Column]) -> Column:
    """What is wrong with a rule's input; an empty array if nothing is."""
    group = rule["phrases"]
    return F.filter(
        F.array(
            F.when(~F.coalesce(F.length(rule["name"]).between(1, 200), F.lit(False)), "name"),
            F.when(F.coalesce(F.length(rule["phrase"]), F.lit(0)) < 3, "phrase"),
            F.when(~F.coalesce(rule["threshold"].between(0, 1), F.lit(False)), "threshold"),
            F.when(group.isNotNull() & ~F.size(group).between(1, 10), "phrases"),
        ),
        lambda e: e.isNotNull(),
    )


def valid_list_name(name: Column) -> Column:
    """1 to 29 of ``a-z 0-9 _ -``."""
    return F.coalesce(name.rlike("^[a-z0-9_-]{1,29}$"), F.lit(False))


def staleness(finished: Column, now: dt.datetime | Column) -> Column:
    """Whole days since an instant, not below 0."""
    now = now if isinstance(now, Column) else F.lit(now)
    seconds = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(finished.cast("timestamp"))
    return F.greatest(F.lit(0), F.floor(seconds / 86400)).cast("int")


def severity(days: Column, kind: Column) -> Column:
    """Colour of an age: sanctions after 7 and 30 days, taxonomies after 90 and 365."""
    warn, stale = F.when(kind == "taxonomy", 90).otherwise(7), F.when(kind == "taxonomy", 365).otherwise(30)
    return F.when(days.isNull(), "gray").when(days <= warn, "green").when(days <= stale, "amber").otherwise("red")
