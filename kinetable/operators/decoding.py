"""Choosing tokens from tables of scores: samplers, beams and rules against repetition.

Candidates are rows (context, token, log-probability). A context's candidates are few (a
vocabulary at most), so windows by context are bounded; contexts are many and run in parallel."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ranked(df: DataFrame, by: list[str], token: str, logp: str):
    return Window.partitionBy(*by).orderBy(F.desc(logp), token)


def top_k(df: DataFrame, by: list[str], token: str, logp: str, k: int) -> DataFrame:
    """The k best tokens of each context, their probabilities made to add up to one."""
    kept = df.withColumn("_r", F.row_number().over(_ranked(df, by, token, logp))).where(F.col("_r") <= k).drop("_r")
    return renormalised(kept, by, logp)


def top_k_top_p(df: DataFrame, by: list[str], token: str, logp: str, k: int, p: float) -> DataFrame:
    """Of the k best the fewest whose probabilities reach p; the one that crosses it stays."""
    kept = top_k(df, by, token, logp, k)
    run = F.sum(F.exp(logp)).over(_ranked(kept, by, token, logp).rowsBetween(Window.unboundedPreceding, 0))
    kept = kept.withColumn("_s", run - F.exp(logp)).where(F.col("_s") < p).drop("_s")
    return renormalised(kept, by, logp)


def renormalised(df: DataFrame, by: list[str], logp: str) -> DataFrame:
    return df.withColumn(logp, F.col(logp) - F.ln(F.sum(F.exp(logp)).over(Window.partitionBy(*by))))


def gumbel_pick(df: DataFrame, by: list[str], token: str, logp: str, u: Column, temperature: float = 1.0) -> DataFrame:
    """One token a context with its probability: the largest score plus Gumbel noise from ``u``,
    a uniform number of context and token."""
    noisy = F.col(logp) / temperature - F.ln(-F.ln(F.greatest(u, F.lit(1e-12))))
    return df.groupBy(*by).agg(F.max(F.struct(noisy.alias("s"), F.col(token).alias("t")))["t"].alias(token))


def multinomial_pick(df: DataFrame, by: list[str], token: str, logp: str, u: Column) -> DataFrame:
    """One token a context: the first, by token, whose running probability exceeds ``u``, the
    context's uniform number."""
    w = Window.partitionBy(*by)
    run = F.sum(F.exp(logp)).over(w.orderBy(token).rowsBetween(Window.unboundedPreceding, 0))
    out = df.withColumn("_run", run).withColumn("_all", F.sum(F.exp(logp)).over(w)).where(F.col("_run") > u * F.col("_all"))
    return out.groupBy(*by).agg(F.min(token).alias(token))


Rule = Callable[[Column, Column, Column], Column]


def repetition_penalty(factor: float) -> Rule:
    """Scores of tokens that the beam has are multiplied by the factor (log-probabilities fall)."""
    return lambda beam, token, logp: F.when(F.array_contains(beam, token), logp * factor).otherwise(logp)


def frequency_penalty(weight: float) -> Rule:
    """A token's score falls by the weight for each time the beam has it."""
    return lambda beam, token, logp: logp - weight * F.size(F.filter(beam, lambda x: x == token))


def no_repeated_ngrams(n: int) -> Rule:
    """A token that would complete an n-gram the beam already has gets no score."""

    def rule(beam: Column, token: Column, logp: Column) -> Column:
        last = F.slice(beam, F.greatest(F.size(beam) - (n - 2), F.lit(1)), n - 1) if n > 1 else F.array().cast("array<string>")
        starts = F.sequence(F.lit(1), F.greatest(F.size(beam) - (n - 1), F.lit(1)))
        seen = F.exists(starts, lambda i: F.slice(beam, i, n) == F.concat(last, F.array(token)))
        return F.when((F.size(beam) >= n) & seen, F.lit(None).cast("double")).otherwise(logp)

    return rule


def beam_search(start: DataFrame, steps: DataFrame, width: int, length: int, rules: tuple[Rule, ...] = ()) -> DataFrame:
    """(id, beam, score): the best beams of ``length`` further tokens. ``start``: id, token;
    ``steps``: token, next, logp. A round joins all beams with what may follow and keeps the
    best of each id; ties go to the smaller beam."""
    beams = start.select("id", F.array("token").alias("beam"), F.lit(0.0).alias("score"))
    for _ in range(length):
        grown = beams.withColumn("token", F.element_at("beam", -1)).join(steps, "token")
        logp = F.col("logp")
        for r in rules:
            logp = r(F.col("beam"), F.col("next"), logp)
        grown = grown.withColumn("_l", logp).where("_l is not null")
        grown = grown.select("id", F.concat("beam", F.array("next")).alias("beam"), (F.col("score") + F.col("_l")).alias("score"))
        best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("score", 9)), "beam"))
        beams = grown.withColumn("_r", best).where(F.col("_r") <= width).drop("_r")
    return beams
