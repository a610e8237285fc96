"""Quality rules for documents, and verdicts on the hosts they come from.

Each document is measured and tested by itself. Failures are then counted by host, the
hosts' failure rates are shrunk towards a beta prior that is fitted to all hosts, and a
host whose rate is surely above the limit takes its documents with it.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logstream.llm.common import attempt_name, join_sized, map_arrow, map_batches, stored, text_or_empty

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Limits:
    """What documents and hosts must meet."""

    least_words: int = 50
    repeat_percent: int = 50
    host_rate: float = 0.5
    # Standard deviations by which a host's rate must lie above the limit.
    sureness: float = 1.645
    # Greatest weight of the prior, in documents, for hosts that do not differ at all.
    prior_weight: float = 1e6


def measure(text: str) -> tuple[int, ...]:
    """The MEASURES of one text."""
    data = text.encode()
    words = data.split()
    spaces = len(data) - len(data.translate(None, SPACES))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [line for line in data.split(b"\n") if line.strip(SPACES)]
    return (
        len(words),
        len(text) - spaces,
        symbols,
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def repeated_words(words: list[bytes]) -> int:
    """Words inside a window of three that occurs at least twice."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered, end = 0, 0
    for start, window in enumerate(windows):
        if counts[window] > 1:
            covered += start + 3 - max(start, end)
            end = start + 3
    return covered


def _measure_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    measured = zip(*map(measure, batch.column("text").to_pylist()))
    kept = [name for name in batch.schema.names if name != "text"]
    columns = [batch.column(name) for name in kept]
    columns += [pa.array(values, pa.int64()) for values in measured]
    return pa.RecordBatch.from_arrays(columns, [*kept, *MEASURES])


def measured(docs: DataFrame, host: str = "source", limits: Limits = Limits()) -> DataFrame:
    """doc_id, host, the measures and ``base_failed`` of each row. A NULL text has no words."""
    rows = docs.select("doc_id", F.col(host).cast("string").alias("host"), text_or_empty())
    doc_id = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {doc_id}, host string, " + ", ".join(f"{m} long" for m in MEASURES)
    failed = (F.col("n_words") < limits.least_words) | (
        100 * F.col("n_repeat_words") > limits.repeat_percent * F.col("n_words")
    )
    return map_batches(rows, _measure_batch, schema).withColumn("base_failed", failed)


def host_verdicts(rules: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Each named host with its counts, shrunk failure rate, its deviation, and ``rejected``.

    The prior is fitted by moments over all hosts: the spread of the hosts' rates beyond
    that of drawing n documents gives its weight. One host, or hosts that do not differ,
    get the greatest weight, so that none is judged by its own few documents.
    """
    hosts = (
        rules.filter(F.col("host").isNotNull())
        .groupBy("host")
        .agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    )
    pooled = hosts.agg((F.sum("failed") / F.sum("n")).alias("rate")).scalar()
    mean = F.col("mean")
    spread = (
        hosts.withColumn("mean", pooled)
        .agg(
            F.max("mean").alias("mean"),
            F.avg((F.col("failed") / F.col("n") - mean) * (F.col("failed") / F.col("n") - mean)).alias(
                "variance"
            ),
            F.avg(1 / F.col("n")).alias("drawn"),
        )
        .select(
            "mean",
            (F.col("variance") - mean * (1 - mean) * F.col("drawn")).alias("between"),
        )
    )
    weight = F.when(
        F.col("between") > 0,
        F.least(
            F.greatest(mean * (1 - mean) / F.col("between") - 1, F.lit(1.0)),
            F.lit(limits.prior_weight),
        ),
    ).otherwise(F.lit(limits.prior_weight))
    prior = spread.select(F.struct("mean", weight.alias("weight")).alias("prior")).scalar()
    total = F.col("n") + F.col("prior.weight")
    rate = (F.col("failed") + F.col("prior.mean") * F.col("prior.weight")) / total
    return (
        hosts.withColumn("prior", prior)
        .withColumn("rate", rate)
        .withColumn("deviation", F.sqrt(F.col("rate") * (1 - F.col("rate")) / (total + 1)))
        .withColumn(
            "rejected",
            F.col("rate") - limits.sureness * F.col("deviation") > limits.host_rate,
        )
        .drop("prior")
    )


def judge(docs: DataFrame, host: str = "source", limits: Limits = Limits()) -> DataFrame:
    """doc_id, host, the measures, ``base_failed`` and ``kept``: one row per row of ``docs``.

    Rows without a host are judged by their own text alone. Repeated rows are judged each,
    and an empty table gives no rows. Other columns are not read.
    """
    # Texts are read once: what follows needs the measures alone.
    rules = stored(measured(docs, host, limits), "measures")
    rejected = host_verdicts(rules, limits).filter("rejected").select("host", F.lit(True).alias("bad"))
    judged = join_sized(rules, rejected, "host", "left")
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("bad").isNull()).drop("bad")


def keep_good(docs: DataFrame, host: str = "source", limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` that are kept, unchanged.

    The text is read again rather than shuffled: only the verdicts on hosts travel.
    """
    rules = stored(measured(docs, host, limits), "measures")
    # A name that no column of the documents has.
    key = attempt_name("host")
    rejected = host_verdicts(rules, limits).filter("rejected").select(F.col("host").alias(key))
    named = docs.withColumn(key, F.col(host).cast("string"))
    allowed = join_sized(named, rejected, key, "left_anti").select(*docs.columns)

    def passing(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            mask = pa.array([_passes(text or "", limits) for text in texts], pa.bool_())
            yield batch.filter(mask)

    return map_arrow(allowed, passing, allowed.schema)


def _passes(text: str, limits: Limits) -> bool:
    words = text.encode().split()
    if len(words) < limits.least_words:
        return False
    return 100 * repeated_words(words) <= limits.repeat_percent * len(words)
