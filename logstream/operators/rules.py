"""Rule-based anomaly detectors.

A rule is data: a name and a SQL condition over the log columns, the stream
features, ``lower_message`` and ``has_memory_text``. Conditions become plain
Spark expressions, so a rule table runs inside the generated code of the scan's
stage, on batch tables and streams alike.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logstream import model
from logstream.functions import codes, text
from logstream.functions.rows import pinned
from logstream.operators.features import LOWERED, lowered_stream_features


def has_word(words: Iterable[str]) -> str:
    """SQL condition: the message holds one of the lower-case words in any letter case."""
    quoted = [word.replace("\\", "\\\\").replace("'", "\\'") for word in words]
    return "(" + " OR ".join(f"contains({LOWERED}, '{word}')" for word in quoted) + ")"


@dataclass(frozen=True)
class Rule:
    """A named condition; ``score`` is used in score tables only."""

    name: str
    condition: str
    score: float | None = None

    @property
    def column(self) -> Column:
        return F.expr(self.condition)


ERROR_LEVELS_SQL = "level IN ('ERROR', 'FATAL')"

# Words that are features or serve flag and score are tested once, as columns.
FEATURE_WORDS = {"exception": "has_exception", "timeout": "has_timeout", "failed": "has_failed"}
FEATURE_WORDS_SQL = " OR ".join(f"{flag} = 1" for flag in FEATURE_WORDS.values())
HAS_MEMORY_TEXT = "has_memory_text"
OTHER_FAILURE_WORDS = [word for word in model.FAILURE_WORDS if word not in FEATURE_WORDS]

# What flags a record, most telling first.
FLAG_RULES = (
    Rule("fatal_level", "level = 'FATAL'"),
    Rule("memory_text", HAS_MEMORY_TEXT),
    Rule("crash_text", has_word(model.CRASH_WORDS)),
    Rule("failure_text", f"{FEATURE_WORDS_SQL} OR {has_word(OTHER_FAILURE_WORDS)}"),
    Rule("very_long_message", f"message_length > {model.VERY_LONG_MESSAGE}"),
    Rule("many_words", f"word_count > {model.MANY_WORDS}"),
    Rule("early_error", f"hour < {model.EARLY_HOUR} AND {ERROR_LEVELS_SQL}"),
    Rule("payment_declined", f"service = 'payment-service' AND {has_word(['declined'])}"),
    Rule("auth_unauthorized", f"service = 'auth-service' AND {has_word(['unauthorized'])}"),
)

# What a record scores, independent of the flag: an unflagged record may score
# high and a flagged one low.
SCORE_RULES = (
    Rule("fatal_level", "level = 'FATAL'", 1.0),
    Rule("memory_text", HAS_MEMORY_TEXT, 0.95),
    Rule("error_level", "level = 'ERROR'", 0.8),
    Rule("exception_text", "has_exception = 1", 0.7),
    Rule("timeout_text", "has_timeout = 1", 0.6),
    Rule("failed_text", "has_failed = 1", 0.5),
)
DEFAULT_SCORE = 0.1


def first_rule(rules: Sequence[Rule]) -> Column:
    """Name of the first rule that holds, or NULL."""
    return F.coalesce(*[F.when(rule.column, rule.name) for rule in rules])


def first_score(rules: Sequence[Rule], default: float) -> Column:
    """Score of the first rule that holds."""
    scores = [F.when(rule.column, F.lit(float(rule.score))) for rule in rules]
    return F.coalesce(*scores, F.lit(float(default)))


def detect_v1(df: DataFrame, max_len: int = model.LONG_MESSAGE) -> DataFrame:
    """Keeps ERROR records and long messages."""
    return df.where((F.col("level") == "ERROR") | (F.length("message") > max_len))


def detect_v2(
    df: DataFrame, max_len: int = model.LONG_MESSAGE, as_of: Column | None = None
) -> DataFrame:
    """Keeps error levels, long messages and failure words; scores them by level."""
    level, message = F.col("level"), F.col("message")
    kept = df.where(
        level.isin(*model.ERROR_LEVELS)
        | (F.length(message) > max_len)
        | text.mentions(message, model.SHORT_FAILURE_WORDS)
    )
    scores = (Rule("fatal", "level = 'FATAL'", 1.0), Rule("error", "level = 'ERROR'", 0.8))
    return kept.withColumns(
        {
            "detection_timestamp": F.current_timestamp() if as_of is None else as_of,
            "anomaly_score": first_score(scores, 0.6),
        }
    )


def detect_v3(
    df: DataFrame,
    rules: Sequence[Rule] = FLAG_RULES,
    scores: Sequence[Rule] = SCORE_RULES,
    default_score: float = DEFAULT_SCORE,
) -> DataFrame:
    """Flags, scores and grades every record; keeps all rows.

    Adds the stream features, ``is_anomaly``, ``matched_rule``, ``anomaly_score``
    and ``severity``. Every word is looked for once per row, in a message that
    is lower-cased once, and a later filter on the results repeats none of it.
    """
    scored = (
        lowered_stream_features(df)
        .withColumn(HAS_MEMORY_TEXT, text.holds(F.col(LOWERED), model.MEMORY_WORDS))
        .withColumns(
            {
                "matched_rule": first_rule(rules),
                "anomaly_score": first_score(scores, default_score),
            }
        )
        .drop(LOWERED, HAS_MEMORY_TEXT)
    )
    kept = pinned(scored, *FEATURE_WORDS.values(), "matched_rule", "anomaly_score")
    return kept.withColumns(
        {
            "is_anomaly": F.col("matched_rule").isNotNull(),
            "severity": codes.severity(F.col("anomaly_score")),
        }
    )
