"""Rules as rows with a time from which they hold: a record is judged by the rules of its own time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logstream.functions.clock import utc
from logstream.functions.rows import free_name

# service, valid_from, position, name, kind, argument, score.
RULE_ROW = (
    "service STRING, valid_from TIMESTAMP, position INT, name STRING, kind STRING, argument STRING, score DOUBLE"
)
# Columns of the result; those of the input that have such a name are replaced.
ADDED = ("rules_from", "matched_rule", "anomaly_score", "is_anomaly")
_RULES = "array<struct<position:int,name:string,kind:string,argument:string,score:double>>"
# A table of service and day has this many rows at most to be broadcast.
BROADCAST_ROWS = 100_000


def _meets(rule: Column) -> Column:
    """Whether a record meets a rule; an unknown kind, or a NULL field, does not."""
    kind, argument = rule["kind"], rule["argument"]
    number = argument.try_cast("double")
    message = F.col("message")
    met = (
        F.when(kind == "level_is", F.col("level") == argument)
        .when(kind == "mentions", F.contains(F.lower(message), F.lower(argument)))
        .when(kind == "longer_than", F.length(message) > number)
        .when(kind == "before_hour", F.hour("timestamp") < number)
    )
    return F.coalesce(met, F.lit(False))


def rule_versions(rules: DataFrame) -> DataFrame:
    """The rules of a service that start at one time as one version, with the time it ends (NULL: open).

    A later version replaces the one before as a whole. Rules are in the order of ``position``, then name.
    """
    fields = ["position", "name", "kind", "argument", "score"]
    versions = rules.groupBy("service", "valid_from").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("rules")
    )
    following = F.lead("valid_from").over(W.partitionBy("service").orderBy("valid_from"))
    return versions.withColumn("valid_to", following)


def version_days(versions: DataFrame, until: Column | datetime) -> DataFrame:
    """Per service and day the versions that hold at some time of that day, oldest first.

    A version is a row of every day it covers, up to that of ``until``: records meet it by plain equality.
    """
    last = F.to_date(F.coalesce(F.col("valid_to"), utc(until)))
    days = F.sequence(F.to_date("valid_from"), F.greatest(last, F.to_date("valid_from")))
    spread = versions.select("service", "valid_from", "rules", F.explode(days).alias("day"))
    return spread.groupBy("service", "day").agg(
        F.array_sort(F.collect_list(F.struct("valid_from", "rules"))).alias("versions")
    )


def detect_dated(df: DataFrame, rules: DataFrame, until: Column | datetime) -> DataFrame:
    """Every record with what the rules in force at its event time say of it.

    Adds ``rules_from`` (start of the version in force, NULL if there is none), ``matched_rule`` (the first
    that the record meets), ``anomaly_score`` (the greatest score of those it meets, else 0) and
    ``is_anomaly``. ``rules`` has the columns of RULE_ROW; ``until`` is a time no record is later than, or
    later ones are judged by no rule. Records keep their number and place: each meets the one row of its
    service and day, which is broadcast up to BROADCAST_ROWS such rows and joined by key beyond that.
    """
    kind = df.schema["timestamp"].dataType
    service, day, versions, version, met = (
        free_name(df, f"_{c}") for c in ("service", "day", "versions", "version", "met")
    )
    days = version_days(rule_versions(rules), until).withColumnsRenamed(
        {"service": service, "day": day, "versions": versions}
    )
    if days.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        days = F.broadcast(days)
    same = (F.col("service") == F.col(service)) & (F.to_date("timestamp") == F.col(day))
    begun = F.filter(versions, lambda v: v["valid_from"].cast(kind) <= F.col("timestamp"))
    found = df.join(days, same, "left").withColumn(version, F.try_element_at(begun, F.lit(-1)))
    # No version: no rules, rather than NULL.
    held = F.filter(F.coalesce(F.col(version)["rules"], F.from_json(F.lit("[]"), _RULES)), _meets)
    scores = F.transform(met, lambda r: r["score"])
    kept = [c for c in df.columns if c not in ADDED]
    return found.withColumn(met, held).select(
        *kept,
        F.col(version)["valid_from"].alias("rules_from"),
        F.try_element_at(met, F.lit(1))["name"].alias("matched_rule"),
        F.coalesce(F.array_max(scores), F.lit(0.0)).alias("anomaly_score"),
        (F.size(met) > 0).alias("is_anomaly"),
    )
