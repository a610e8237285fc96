"""Names to numbers and scores to names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from logstream import model


def code(name: Column, codes: Mapping[str, int], default: int) -> Column:
    """The number of ``name``; NULL and unknown names get ``default``."""
    return F.coalesce(*[F.when(name == key, value) for key, value in codes.items()], F.lit(default))


def band(score: Column, floors: Sequence[tuple[str, float]], lowest: str) -> Column:
    """The first band, from the top, whose floor the score reaches."""
    reached = [F.when(score >= F.lit(floor), name) for name, floor in floors]
    return F.coalesce(*reached, F.lit(lowest))


def level_code(level: Column) -> Column:
    return code(level, model.LEVEL_CODES, model.UNKNOWN_LEVEL_CODE)


def service_code(service: Column) -> Column:
    return code(service, model.SERVICE_CODES, 0)


def environment_code(environment: Column) -> Column:
    return code(environment, model.ENVIRONMENT_CODES, 0)


def severity(score: Column) -> Column:
    return band(score, model.SEVERITY_BANDS, model.LOWEST_SEVERITY)


def is_error(level: Column) -> Column:
    return F.coalesce(level.isin(*model.ERROR_LEVELS), F.lit(False))
