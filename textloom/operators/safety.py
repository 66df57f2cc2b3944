"""Guards on questions and answers, as columns instead of exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns, searched without regard to case.
INJECTION = (
    r"ignore\s+(all\s+)?(previous|prior)\s+instructions?",
    r"disregard\s+(all\s+)?(previous|prior)\s+instructions?",
    r"you\s+are\s+now\s+",
    r"act\s+as\s+(if\s+you\s+are|an?\s+)",
    r"(do\s+not|don'?t)\s+follow\s+",
    r"jailbreak",
    r"prompt\s+injection",
    r"system\s+prompt",
    r"override\s+(your\s+)?(instructions?|rules?|guidelines?)",
    r"forget\s+(your\s+)?(previous\s+)?(instructions?|training|rules?)",
    r"<\s*/?system\s*>",
    r"\[INST\]",
    r"###\s*System\s*:",
)
HARMFUL = (
    r"\b(how\s+to\s+)?make\s+(a\s+)?(bomb|weapon|explosive)",
    r"\b(child|infant)\s+(sexual|porn|nude)",
    r"\bterrorist?\s+(attack|plot|plan)",
)
#: Personal data with a form, in the order of replacement. Names, groups and places need a model.
PII = (
    ("URL", r"https?://[A-Za-z0-9./?=&_%#~:+-]+"),
    ("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("IBAN_CODE", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b"),
    ("CREDIT_CARD", r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b"),
    ("IP_ADDRESS", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"),
    ("PHONE_NUMBER", r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}"),
    ("DATE_TIME", r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2})?)?\b"),
)
#: What every match of a kind has in it, which is looked for first.
MARKS = {"URL": "://", "EMAIL_ADDRESS": "@", "PHONE_NUMBER": "+"}
REFUSAL = "The answer was withheld because it may be harmful."
DISCLAIMER = "\n\nNote: parts of this answer may not be supported by the sources."


def any_of(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def redact(text: Column) -> tuple[Column, Column]:
    """The text with personal data replaced by <TYPE>, and the types that were found, in order."""
    state = F.struct(F.coalesce(text, F.lit("")).alias("text"), F.expr("cast(array() as array<string>)").alias("types"))
    for name, pattern in PII:
        state = _redacted(state, name, pattern)
    return state["text"], state["types"]


def _redacted(state: Column, name: str, pattern: str) -> Column:
    """``state`` (text, types) after one kind; the state before is worked out once, and only texts with a match are written again."""

    def step(s: Column) -> Column:
        has = s["text"].rlike(pattern)
        if name in MARKS:
            has = s["text"].contains(MARKS[name]) & has
        return F.when(has, F.struct(F.regexp_replace(s["text"], pattern, f"<{name}>").alias("text"), F.array_append(s["types"], F.lit(name)).alias("types"))).otherwise(s)

    return F.get(F.transform(F.array(state), step), F.lit(0))


def guard(queries: DataFrame, text: str = "text", classify: Column | None = None) -> DataFrame:
    """Adds sanitised, pii_types, injection, harmful, violation_type, passed.

    The rules look at the sanitised text; the first violation counts. ``classify``, a
    model's second opinion on injection, is asked about texts that pass the rules.
    """
    sanitised, types = redact(F.col(text))
    rows = queries.withColumns({"sanitised": sanitised, "pii_types": types})
    injection = any_of(F.col("sanitised"), INJECTION)
    if classify is not None:
        injection = injection | F.coalesce(classify, F.lit(False))
    rows = rows.withColumns({"injection": injection, "harmful": any_of(F.col("sanitised"), HARMFUL)})
    kind = F.when(F.col("injection"), "injection").when(F.col("harmful"), "harmful")
    return rows.withColumns({"violation_type": kind, "passed": kind.isNull()})


def output_guard(answers: DataFrame, toxic_limit: float = 0.7, faithful_limit: float = 0.5) -> DataFrame:
    """Replaces toxic answers and marks unfaithful ones.

    ``answers`` has answer, toxicity (map of class to score; null: none), faithfulness
    (null, as without a model: 1).
    """
    toxic = F.coalesce(F.exists(F.map_values("toxicity"), lambda x: x > toxic_limit), F.lit(False))
    faithful = F.coalesce("faithfulness", F.lit(1.0))
    answer = F.when(toxic, F.lit(REFUSAL)).when(faithful < faithful_limit, F.concat("answer", F.lit(DISCLAIMER))).otherwise(F.col("answer"))
    return answers.withColumns({"blocked": toxic, "guarded_answer": answer, "faithfulness": F.when(toxic, 0.0).otherwise(faithful)})
