"""Question expansion by a rule table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T


@dataclass(frozen=True)
class Rule:
    """If the question holds ``trigger`` and not ``absent`` (case ignored), append ``to`` or replace ``source`` by it (case kept)."""

    trigger: str
    absent: str
    to: str
    source: str | None = None


#: The rules of engine A.
RULES = (
    Rule("embassy", "consulate", "consulate"),
    Rule("consulate", "embassy", "embassy"),
    Rule("vienna", "wien", "wien", "vienna"),
    Rule("wien", "vienna", "vienna", "wien"),
)


def expansions(question: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The stripped question and its variants, in order, without repeats or empty ones."""
    base = T.strip(question)
    low = F.lower(base)
    variants = [base]
    for r in rules:
        made = F.concat(base, F.lit(" " + r.to)) if r.source is None else F.replace(base, F.lit(r.source), F.lit(r.to))
        variants.append(F.when(F.contains(low, F.lit(r.trigger)) & ~F.contains(low, F.lit(r.absent)), made))
    return F.array_distinct(F.filter(F.array(*variants), lambda x: x.isNotNull() & (x != "")))


def expand_questions(questions: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``query_id, variant, question``."""
    return questions.select("query_id", F.posexplode(expansions(F.col("question"), rules)).alias("variant", "question"))
