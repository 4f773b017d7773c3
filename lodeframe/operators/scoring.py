"""Scores of cases with known answers: all checks of all cases in one plan, a row a check.

    cases         case_id, answerability, provenance, manual (null or why a person must look), allowed (array of actions)
    outcomes      case_id, run_state, clarified, answer, called (array of actions), refused (null, or whether a forbidden action was)
    calculations  case_id, key, value, tolerance, unit, column      observed   case_id, key, value, unit, column
    passages      case_id, n, alias, phrases (array), policy, version   evidence  case_id, alias, text, declared, version
    artifacts     case_id, n, media_type, schema (JSON text)        made       case_id, media_type, schema, available
    sources       case_id, alias, before, after (hashes)
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.operators.evaluate import schema_matches, unexpected_actions
from lodeframe.text.expressions import normal

# States of a run.
BROKEN = "failed timeout cancelled infrastructure_error model_error error".split()
COMPLETE, WAITING = "completed complete succeeded".split(), "awaiting_clarification needs_clarification".split()


@dataclass(frozen=True)
class Bench:
    """The tables that a scoring reads."""

    cases: DataFrame
    outcomes: DataFrame
    calculations: DataFrame
    observed: DataFrame
    passages: DataFrame
    evidence: DataFrame
    artifacts: DataFrame
    made: DataFrame
    sources: DataFrame


def _passes(holds: Column) -> Column:
    return F.when(F.coalesce(holds, F.lit(False)), "pass").otherwise("fail")


def _review(unless: Column) -> Column:
    return F.when(F.coalesce(unless, F.lit(False)), "pass").otherwise("needs_review")


def _rows(df: DataFrame, name: Column | str, status: Column) -> DataFrame:
    return df.select("case_id", (F.lit(name) if isinstance(name, str) else name).alias("name"), status.alias("status"))


def _says_unit(answer: Column, unit: Column) -> Column:
    """Whether the answer has the unit as a word, or its symbol."""
    symbol = F.create_map(*map(F.lit, ("gbp", "£", "inr", "₹", "eur", "€")))[F.lower(unit)]
    word = F.concat(F.lit(r"(?iU)(?<!\w)\Q"), unit, F.lit(r"\E(?!\w)"))
    return F.regexp_like(answer, word) | F.coalesce(F.contains(answer, symbol), F.lit(False))


def _fits(schema: Column, wanted: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(s: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([schema_matches(json.loads(a or "{}"), json.loads(b or "{}")) for a, b in zip(s, w, strict=True)], dtype=bool)

    return run(schema, wanted)


def _calculated(b: Bench, live: DataFrame) -> list[DataFrame]:
    seen = b.observed.select("case_id", "key", F.col("value").alias("__value"), F.trim(F.coalesce("unit", F.lit(""))).alias("__unit"), F.coalesce("column", F.lit("")).alias("__column"))
    # A key that a run tells twice counts once: by its least row.
    seen = seen.groupBy("case_id", "key").agg(F.min(F.struct("__value", "__unit", "__column")).alias("__s")).select("case_id", "key", "__s.*")
    rows = b.calculations.join(live.select("case_id", F.lower(F.coalesce("answer", F.lit(""))).alias("__answer")), "case_id").join(seen, ["case_id", "key"], "left")
    near = F.abs(F.col("__value") - F.col("value")) <= F.col("tolerance")
    there = F.coalesce(F.col("column"), F.lit("")).isin("") | (F.lower("column") == F.lower("__column"))
    unit = rows.where("unit IS NOT NULL")
    told = F.coalesce("__unit", F.lit("")) != ""
    return [
        _rows(rows, F.concat(F.lit("calculation:"), "key"), _passes(near & there)),
        _rows(unit, F.concat(F.lit("calculation_unit:"), "key"), F.when(~told, "needs_review").otherwise(_passes(F.lower("__unit") == F.lower("unit")))),
        _rows(unit, F.concat(F.lit("answer_unit:"), "key"), _passes(_says_unit(F.col("__answer"), F.col("unit")))),
    ]


def _cited(b: Bench, live: DataFrame) -> DataFrame:
    e = b.evidence.where("coalesce(declared, true)").select("case_id", "alias", normal(F.coalesce("text", F.lit(""))).alias("__text"), F.col("version").cast("string").alias("__version")).where("__text <> ''")
    p = b.passages.join(live.select("case_id"), "case_id", "left_semi")
    same = (p["case_id"] == e["case_id"]) & (p["alias"] == e["alias"]) & (p["version"].isNull() | (p["version"].cast("string") == e["__version"]))
    has = F.exists(p["phrases"], lambda x: F.contains(e["__text"], normal(x)))
    # The join is of a case's own passages and evidence; only whether any fits is kept of it.
    by = p.join(e, same, "left").groupBy(p["case_id"], p["n"], p["policy"]).agg(F.coalesce(F.bool_or(has), F.lit(False)).alias("found"), F.coalesce(F.bool_or(e["__text"].isNotNull()), F.lit(False)).alias("cited"))
    status = F.when(F.col("found"), "pass").when(F.col("cited") & (F.col("policy") == "diagnostic"), "needs_review").otherwise("fail")
    return _rows(by, F.concat(F.lit("passage:"), F.col("n").cast("string")), status)


def _produced(b: Bench, live: DataFrame) -> DataFrame:
    m = b.made.where("coalesce(available, true)").select("case_id", "media_type", F.col("schema").alias("__schema"))
    a = b.artifacts.join(live.select("case_id"), "case_id", "left_semi")
    fits = a.join(m, ["case_id", "media_type"]).withColumn("__fits", _fits(F.col("__schema"), F.col("schema"))).groupBy("case_id", "n").agg(F.bool_or("__fits").alias("__fits"))
    return _rows(a.join(fits, ["case_id", "n"], "left"), F.concat(F.lit("artifact:"), F.col("n").cast("string")), _passes(F.col("__fits")))


def score_cases(b: Bench) -> DataFrame:
    """(case_id, name, status): pass, fail or needs_review for each check of each case that has an outcome.

    A run that broke off has one row, to be looked at. Null arrays are empty and null states unknown; expected rows of a case without an outcome
    give nothing. Ids are unique in cases and outcomes.
    """
    both = b.cases.join(b.outcomes, "case_id")
    state = F.lower(F.coalesce("run_state", F.lit("unknown")))
    none = F.array().cast("array<string>")
    both = both.withColumns({"__state": state, "__clear": F.coalesce("clarified", F.lit(False)), "allowed": F.coalesce("allowed", none), "called": F.coalesce("called", none)})
    live = both.where(~F.col("__state").isin(*BROKEN))
    open_ = F.col("answerability").isin("ambiguous", "unsupported")
    done = F.col("__state").isin(*COMPLETE) | (F.col("__state").isin(*WAITING) & F.col("__clear") & open_)
    s = b.sources.join(live.select("case_id"), "case_id", "left_semi").where("before IS NOT NULL OR after IS NOT NULL")
    expects = [b.calculations, b.passages, b.artifacts]
    known = expects[0].select("case_id").unionByName(expects[1].select("case_id")).unionByName(expects[2].select("case_id")).distinct()
    loose = live.where((F.size("allowed") == 0) & (F.coalesce("answerability", F.lit("")) == "answerable")).join(known, "case_id", "left_anti")
    review = F.lit("needs_review")
    parts = [
        _rows(both, "run_completion", _review(done & ~F.col("__state").isin(*BROKEN))),
        _rows(live.where(open_), F.concat("answerability", F.lit("_handling")), _review(F.col("__clear"))),
        *_calculated(b, live), _cited(b, live), _produced(b, live),
        _rows(live.where((F.size("called") > 0) | (F.size("allowed") > 0)), "action_allowlist", _passes(F.size(unexpected_actions(F.col("called"), F.col("allowed"))) == 0)),
        _rows(live.where("refused IS NOT NULL"), "prohibited_action_rejection", _passes(F.col("refused"))),
        _rows(s, F.concat(F.lit("source_immutable:"), "alias"), _passes((F.col("before") != "") & (F.col("before") == F.col("after")))),
        _rows(loose, "known_answer", review),
        _rows(live.where("provenance IS DISTINCT FROM 'human_reviewed'"), "label_provenance", review),
        _rows(live.where("manual IS NOT NULL"), "manual_review", review),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
