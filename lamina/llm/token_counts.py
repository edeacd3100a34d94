"""Operator 10: token counts from an exact histogram of encoded lengths.

Every document is encoded once; all that is kept is how many documents have each length. Sums from
the long end answer totals, quantiles and totals after truncation for every context limit.

Null and empty texts have length 0 and are counted; very long ones are encoded whole. Repeated rows count
each time, and equal lengths are one row of the histogram. Null groups are groups. An empty table gives
an empty histogram.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.shared import ship

#: Lengths per block of the two-level sums, so that no window holds more rows than this.
BLOCK = 4096

_ENCODINGS: dict[int, object] = {}


def _encoding(rows: bytes, pattern: str):
    import tiktoken

    key = hash((rows, pattern))
    if key not in _ENCODINGS:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rows.splitlines())}
        _ENCODINGS[key] = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


def encoded_lengths(docs: DataFrame, vocabulary: str, pattern: str, keep: list[str], text_column: str = "text") -> DataFrame:
    """The columns `keep` and n_tokens of every row. vocabulary: a file of token ranks."""
    ship(docs.sparkSession)
    with open(vocabulary, "rb") as f:
        rows = f.read()

    def run(batches):
        coder = _encoding(rows, pattern)
        for batch in batches:
            n = [len(coder.encode_ordinary(t.as_py() or "")) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=[*batch.schema.names[:-1], "n_tokens"])

    out = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep) + ", " * bool(keep) + "n_tokens long"
    return docs.select(*keep, F.col(text_column).cast("string").alias("_text")).mapInArrow(run, out)


def length_histogram(lengths: DataFrame, by: list[str] = ()) -> DataFrame:
    """Rows (by..., n_tokens, n_docs): one for each length that occurs."""
    return lengths.groupBy(*by, "n_tokens").agg(F.count("*").alias("n_docs"))


def with_limits(histogram: DataFrame, limits: list[int], by: list[str] = ()) -> DataFrame:
    """The histogram with lengths of no documents, so that a report has a row for each limit."""
    more = histogram.select(*by).distinct().select(*by, F.explode(F.array(*[F.lit(x).cast("long") for x in limits])).alias("n_tokens"), F.lit(0).cast("long").alias("n_docs"))
    return histogram.unionByName(more).groupBy(*by, "n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def context_report(histogram: DataFrame, by: list[str] = ()) -> DataFrame:
    """For each length L of a histogram, as a context limit: documents and tokens up to L and
    above, tokens left when each document is truncated at L, tokens lost, and the share of
    documents that fit (in millionths, rounded down).

    Between two lengths a..b every figure but truncated_tokens is that of a; truncated_tokens
    grows by docs_above for each token. Sums run within blocks of lengths and over block totals,
    so no single task sees all lengths.
    """
    h = histogram.withColumn("_b", F.floor(F.col("n_tokens") / F.lit(BLOCK)).cast("long")).withColumn("_t", F.col("n_tokens") * F.col("n_docs"))
    totals = h.groupBy(*by, "_b").agg(F.sum("n_docs").alias("_bd"), F.sum("_t").alias("_bt"))
    below = Window.partitionBy(*by).orderBy("_b")
    totals = totals.select(
        *by,
        "_b",
        (F.sum("_bd").over(below) - F.col("_bd")).alias("_d0"),
        (F.sum("_bt").over(below) - F.col("_bt")).alias("_t0"),
        F.sum("_bd").over(Window.partitionBy(*by)).alias("_dn"),
        F.sum("_bt").over(Window.partitionBy(*by)).alias("_tn"),
    )
    on = [F.col(f"h.{c}").eqNullSafe(F.col(f"t.{c}")) for c in [*by, "_b"]]
    joined = h.alias("h").join(totals.alias("t"), on).select("h.*", "t._d0", "t._t0", "t._dn", "t._tn")
    within = Window.partitionBy(*by, "_b").orderBy("n_tokens")
    d, t = F.col("_d0") + F.sum("n_docs").over(within), F.col("_t0") + F.sum("_t").over(within)
    out = joined.select(*by, "n_tokens", "n_docs", d.alias("docs_within"), (F.col("_dn") - d).alias("docs_above"), t.alias("tokens_within"), F.col("_tn").alias("total_tokens"), F.col("_dn").alias("_dn"))
    cut = F.col("tokens_within") + F.col("n_tokens") * F.col("docs_above")
    return out.select(
        *by,
        F.col("n_tokens").alias("context_limit"),
        "n_docs",
        "docs_within",
        "docs_above",
        "tokens_within",
        cut.alias("truncated_tokens"),
        (F.col("total_tokens") - cut).alias("tokens_lost"),
        F.expr("docs_within * 1000000 div _dn").alias("fit_millionths"),
    )


def quantiles(report: DataFrame, shares: list[float], by: list[str] = ()) -> DataFrame:
    """The least context limit within which each share of the documents fits."""
    return report.groupBy(*by).agg(*[F.min(F.when(F.col("docs_within") >= F.lit(s) * (F.col("docs_within") + F.col("docs_above")), F.col("context_limit"))).alias(f"q{s:g}") for s in shares])


def full_report(lengths: DataFrame, by: str, limits: list[int], shares: list[float]) -> DataFrame:
    """context_report of each value of the column `by` and of all rows (in_all true, `by` null), at all
    lengths that occur and at the limits given, with the quantiles of the group."""
    each = length_histogram(lengths, [by]).withColumn("in_all", F.lit(False))
    whole = each.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")).select(F.lit(None).cast(lengths.schema[by].dataType).alias(by), "n_tokens", "n_docs", F.lit(True).alias("in_all"))
    keys = [by, "in_all"]
    report = context_report(with_limits(each.unionByName(whole), limits, keys), keys)
    at = quantiles(report, shares, keys)
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"q.{c}")) for c in keys]
    return report.alias("r").join(at.alias("q"), on[0] & on[1]).select("r.*", *[F.col(f"q.`q{s:g}`").alias(f"quantile_{round(100 * s)}") for s in shares])


def truncated_total(histogram: DataFrame, limit: int, by: list[str] = ()) -> DataFrame:
    """Tokens left when each document is cut at any limit, occurring as a length or not."""
    return histogram.groupBy(*by).agg(F.sum(F.least("n_tokens", F.lit(limit)) * F.col("n_docs")).alias("truncated_tokens"))
