"""Keyword-rule matcher (J3) and request validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import _c, is_blank, tokens

# The symptom rules (disease, keywords, dosha, advice) in
# priority order, and the default answer when nothing matches.
RULES = [
    ("Cough", ["cough", "throat", "congestion", "khansi", "phlegm", "cold"], ["Kapha", "Vata"],
     "Drink warm fluids, avoid cold foods, try ginger-tulsi tea."),
    ("Diabetes", ["fatigue", "urination", "sugar", "thirst", "diabetes"], ["Kapha", "Pitta"],
     "Avoid sugar, follow a low-GI diet, exercise regularly."),
    ("Hypertension", ["bp", "pressure", "stress", "hypertension", "headache"], ["Pitta", "Vata"],
     "Reduce salt, practice meditation and pranayama."),
]
DEFAULT_RULE = ("General imbalance", ["Vata"], "Improve sleep, reduce stress, and eat a balanced, warm diet.")


def match_rules(df: DataFrame, text_col: str = "text", rules=RULES, default=DEFAULT_RULE) -> DataFrame:
    """The rule with most whole-token keyword hits; first rule on ties;
    the default row (confidence 0.0) when no keyword hits.

    The rule list is a bounded literal, so each rule compiles to an array
    expression over the text's token set: no join and no shuffle.
    Adds disease, dosha, advice, matched_keywords, confidence.
    """
    toks = F.col("_toks")
    cand = []
    for i, (disease, kws, dosha, advice) in enumerate(rules):
        kw = F.array(*[F.lit(k.lower()) for k in kws])
        hits = F.filter(kw, lambda k: F.array_contains(toks, k))
        cand.append(F.struct(
            F.size(hits).alias("n"), F.lit(-i).alias("neg_order"),
            F.lit(disease).alias("disease"), F.array(*[F.lit(d) for d in dosha]).alias("dosha"),
            F.lit(advice).alias("advice"), hits.alias("matched_keywords"),
            F.bround(F.size(hits) / F.lit(max(len(kws), 1)), 2).alias("confidence"),  # D19: half-even
        ))
    best = F.array_max(F.array(*cand))
    hit = best["n"] > 0

    def pick(field: str, dflt: Column) -> Column:
        return F.when(hit, best[field]).otherwise(dflt)

    return df.withColumn("_toks", tokens(text_col)).select(
        *df.columns,
        pick("disease", F.lit(default[0])).alias("disease"),
        pick("dosha", F.array(*[F.lit(d) for d in default[1]])).alias("dosha"),
        pick("advice", F.lit(default[2])).alias("advice"),
        pick("matched_keywords", F.array().cast("array<string>")).alias("matched_keywords"),
        pick("confidence", F.lit(0.0)).alias("confidence"),
    )


# Request limits (fixed values).
MIN_QUESTION_CHARS, MAX_QUESTION_CHARS = 3, 2000
MIN_TOP_K, MAX_TOP_K = 1, 20
SOURCE_FILTERS = ["csv", "pdf"]


def validate_questions(df: DataFrame, question="question", top_k=None, source_filter=None) -> DataFrame:
    """Adds ``reason`` (null when valid) and ``is_valid``.

    question 3-2000 characters and not blank, top_k 1-20, source_filter in {csv, pdf, null}.
    """
    q = _c(question)
    checks = [
        (q.isNull(), "question is required"),
        (F.length(q) < MIN_QUESTION_CHARS, f"question shorter than {MIN_QUESTION_CHARS} characters"),
        (F.length(q) > MAX_QUESTION_CHARS, f"question longer than {MAX_QUESTION_CHARS} characters"),
        (is_blank(q), "question is blank"),
    ]
    if top_k is not None:
        k = _c(top_k)
        checks.append(((k < MIN_TOP_K) | (k > MAX_TOP_K), f"top_k outside {MIN_TOP_K}-{MAX_TOP_K}"))
    if source_filter is not None:
        sf = _c(source_filter)
        checks.append((sf.isNotNull() & ~sf.isin(*SOURCE_FILTERS), "source_filter must be csv, pdf or null"))
    reason = F.lit(None).cast("string")
    for cond, msg in reversed(checks):
        reason = F.when(cond, F.lit(msg)).otherwise(reason)
    return df.withColumn("reason", reason).withColumn("is_valid", F.col("reason").isNull())
