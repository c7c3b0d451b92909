"""Tone of corpora by rules over their cadence: one projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxcorpus.functions.lists import SHOWN_MEASURES, TONE_RULES, UNCERTAIN

SIGNALS = [
    "mean_length", "std_length", "p25_length", "p50_length", "p75_length", "pronoun_ratio_first", "pronoun_ratio_second",
    "punct_density", "question_rate", "exclamation_rate", "fragment_rate",
]
LABELS = tuple(label for label, _ in TONE_RULES)


def bounds(least: float | None, most: float | None, closed: bool) -> str:
    """A trigger's bounds in words."""
    shown = [f"{x:g}" for x in (least, most) if x is not None]
    if len(shown) == 2:
        return f"from {shown[0]} to {shown[1]}" if closed else f"between {shown[0]} and {shown[1]}"
    over = least is not None
    return (("at least " if over else "at most ") if closed else ("over " if over else "under ")) + shown[0]


def _fires(signal: str, least: float | None, most: float | None, closed: bool) -> Column:
    x = F.col(signal)
    out = F.lit(True)
    if least is not None:
        out = out & (x >= least if closed else x > least)
    if most is not None:
        out = out & (x <= most if closed else x < most)
    return F.coalesce(out, F.lit(False))


def _value(signal: str) -> Column:
    """A signal's figure as it is shown."""
    _, factor, digits, unit = SHOWN_MEASURES[signal]
    shown = F.format_number(F.col(signal) * factor, digits)
    return F.concat(F.replace(shown, F.lit(","), F.lit("")), F.lit(unit))


def has_contractions(tokens: Column) -> Column:
    """1 if one of the tokens has an apostrophe; a null or empty array has none."""
    return F.when(F.exists(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: t.contains("'")), 1.0).otherwise(0.0)


def scores(cadences: DataFrame) -> DataFrame:
    """Adds ``score_<label>``, the share of a label's triggers that fire. Null measures count as 0;
    without ``sig_tokens`` there are no contractions."""
    df = cadences.fillna(0.0, SIGNALS)
    tokens = F.col("sig_tokens") if "sig_tokens" in df.columns else F.lit(None).cast("array<string>")
    df = df.withColumn("has_contractions", has_contractions(tokens))
    made = {}
    for label, triggers in TONE_RULES:
        fired = sum((_fires(*t).cast("int") for t in triggers), F.lit(0))
        made[f"score_{label}"] = fired / F.lit(float(len(triggers)))
    return df.withColumns(made)


def classify(cadences: DataFrame) -> DataFrame:
    """Adds ``primary_tone, secondary_tone, confidence, uncertain, rationale``.

    Corpora without sentences or words are ``unknown``; those no trigger fires for are ``mixed``. Ties
    go to the label declared first.
    """
    df = scores(cadences)
    order = [F.struct((-F.col(f"score_{x}")).alias("s"), F.lit(i).alias("i"), F.lit(x).alias("label")) for i, x in enumerate(LABELS)]
    df = df.withColumn("_r", F.array_sort(F.array(*order)))
    first, second = F.col("_r")[0], F.col("_r")[1]
    empty = (F.coalesce("sentence_count", F.lit(0)) == 0) | (F.coalesce("word_count", F.lit(0)) == 0)
    top = -first["s"]
    mixed = top == 0
    plain = ~empty & ~mixed
    close = (-second["s"] >= 0.5) & (-second["s"] >= top - 0.25)
    lines = {
        label: F.filter(
            F.array(*[
                F.when(_fires(s, *b), F.concat(F.lit(f"{label}: {SHOWN_MEASURES[s][0]} "), _value(s), F.lit(f", {bounds(*b)}")))
                for s, *b in triggers
            ]),
            lambda x: x.isNotNull(),
        )
        for label, triggers in TONE_RULES
    }

    def lines_of(label: Column, most: int) -> Column:
        out = F.array().cast("array<string>")
        for x in LABELS:
            out = F.when(label == x, F.slice(lines[x], 1, most)).otherwise(out)
        return out

    df = df.withColumns(
        {
            "primary_tone": F.when(empty, "unknown").when(mixed, "mixed").otherwise(first["label"]),
            "secondary_tone": F.when(plain & close, second["label"]),
            "confidence": F.when(plain, top).otherwise(0.0),
        }
    )
    rationale = (
        F.when(empty, F.array(F.lit("empty input")))
        .when(mixed, F.array(F.lit("no tone triggers fired")))
        .otherwise(
            F.concat(
                lines_of(F.col("primary_tone"), 3),
                F.when(F.col("secondary_tone").isNotNull(), lines_of(F.col("secondary_tone"), 2)).otherwise(
                    F.array().cast("array<string>")
                ),
            )
        )
    )
    return df.withColumn("uncertain", F.col("confidence") < UNCERTAIN).withColumn("rationale", rationale).drop("_r")
