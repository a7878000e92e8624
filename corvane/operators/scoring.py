"""Weighted rules to scores and levels, as the risk rules of change reviews use them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least scores of the levels, from the top; below the last the level is low.
LEVELS = (("critical", 70), ("high", 45), ("medium", 20))


def weighted_score(*rules: tuple[Column, int]) -> Column:
    """Sum of the weights of the rules that hold, between 0 and 100."""
    total = F.lit(0)
    for holds, weight in rules:
        total = total + F.when(holds, weight).otherwise(0)
    return F.least(F.lit(100), F.greatest(F.lit(0), total))


def level(score: Column) -> Column:
    out = F.lit("low")
    for name, least in reversed(LEVELS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def rolled_up(best: Column, total: Column, per: int = 10, most: int = 10) -> Column:
    """The best part's score, plus one for every ``per`` points of the rest, at most ``most``; capped at 100."""
    return F.least(F.lit(100), best + F.least(F.lit(most), F.floor((total - best) / per)))


@dataclass(frozen=True)
class Rule:
    """A reason for risk: a code, what is said (SQL text), its weight (SQL int), and when it holds (SQL condition).

    ``uncertain`` rules count a quarter where the source of a row isn't certain.
    """

    code: str
    message: str
    weight: str
    when: str
    uncertain: bool = False


#: What a reason is, and what follows a message that could not be verified.
REASON = "struct<code:string,message:string,weight:int>"
UNVERIFIED = " (unverified)"


def reasons_of(rules: list[Rule], unsure: str = "false") -> Column:
    """The rules that hold, as one expression: an array of reasons in the rules' order, each code and message once.

    Where ``unsure`` holds, rules that can't be certain then keep a quarter of their weight, rounded, and their message says so.
    """

    def one(r: Rule) -> str:
        certain = f"named_struct('code', '{r.code}', 'message', {r.message}, 'weight', CAST({r.weight} AS INT))"
        doubted = f"named_struct('code', '{r.code}', 'message', concat({r.message}, '{UNVERIFIED}'), 'weight', CAST(floor(({r.weight}) / 4 + 0.5) AS INT))"
        return f"IF(coalesce({r.when}, false), {f'IF(coalesce({unsure}, false), {doubted}, {certain})' if r.uncertain else certain}, null)"

    held = F.expr(f"filter(array({', '.join(map(one, rules))}), r -> r IS NOT NULL)")
    first = lambda r, i: ~F.exists(F.slice(held, 1, i), lambda x: (x["code"] == r["code"]) & (x["message"] == r["message"]))
    return F.filter(held, first).cast(f"array<{REASON}>")


def assessed(rows: DataFrame, rules: list[Rule], is_test: str = "false", unsure: str = "false") -> DataFrame:
    """Adds ``reasons``, ``score`` from 0 to 100 and ``level``; of tests half the score counts, with a reason that takes the rest off."""
    told = rows.withColumn("reasons", reasons_of(rules, unsure)).withColumn("_raw", F.aggregate("reasons", F.lit(0), lambda acc, r: acc + r["weight"]))
    capped = F.least(F.lit(100), F.col("_raw"))
    half = F.floor(capped / 2 + 0.5).cast("int")
    halved = F.expr(f"coalesce({is_test}, false)") & (F.col("_raw") > 0)
    off = F.struct(F.lit("test").alias("code"), F.lit("half of the risk, as for any test").alias("message"), (half - capped).cast("int").alias("weight"))
    scored = told.withColumn("score", F.when(halved, half).otherwise(F.greatest(F.lit(0), capped)).cast("int")).withColumn("reasons", F.when(halved, F.concat("reasons", F.array(off))).otherwise(F.col("reasons")))
    return scored.drop("_raw").withColumn("level", level(F.col("score")))
