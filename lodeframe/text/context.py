"""Conversations within a budget of characters: all that the user said and all facts first, then the newest prose."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.text.expressions import FACTS

_FACT = re.compile(FACTS.replace("(?iU)", "(?i)"))
_END = re.compile(r"(?<=[.!?।])\s+")


def fact_sentences(text):
    """The sentences of a text column that state a fact, a unit or an assumption."""
    parts = F.filter(F.transform(F.split(text, r"(?<=[.!?।])\s+"), lambda s: F.trim(s)), lambda s: s != "")
    return F.filter(parts, lambda s: s.rlike(FACTS))


def select_turns(turns: list[tuple[int, str, str]], most: int) -> list[tuple[int, str, str]] | None:
    """(turn, role, text) within so many characters; None if users' turns and facts alone are more."""
    parts = {t: [s.strip() for s in _END.split(text or "") if s.strip()] for t, role, text in turns if role == "assistant"}
    keep = {t: {i for i, s in enumerate(ss) if _FACT.search(s)} for t, ss in parts.items()}
    size = sum(len(text or "") for _, role, text in turns if role == "user")
    size += sum(len(" ".join(parts[t][i] for i in sorted(k))) for t, k in keep.items())
    if size > most:
        return None
    left = most - size
    for t in sorted(parts, reverse=True):
        for i in range(len(parts[t]) - 1, -1, -1):
            need = len(parts[t][i]) + (1 if keep[t] else 0)
            if i not in keep[t] and need <= left:
                keep[t].add(i)
                left -= need
    out = []
    for t, role, text in turns:
        if role == "user":
            out.append((t, role, text or ""))
        elif role == "assistant":
            out.append((t, role, " ".join(parts[t][i] for i in sorted(keep[t]))))
    return out


def select_context(df: DataFrame, most: int) -> DataFrame:
    """(conv_id, turn, role, text, fits) of conversations cut to ``most`` characters each."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in ("turn", "role", "text")), strict=True), key=lambda r: r[0])
        kept = select_turns(rows, most)
        shown = rows if kept is None else kept
        return pa.table({"conv_id": pa.array([table["conv_id"][0].as_py()] * len(shown), pa.int64()), "turn": pa.array([r[0] for r in shown], pa.int64()), "role": pa.array([r[1] for r in shown], pa.string()), "text": pa.array([r[2] for r in shown], pa.string()), "fits": pa.array([kept is not None] * len(shown), pa.bool_())})

    return df.select("conv_id", "turn", "role", "text").groupBy("conv_id").applyInArrow(run, "conv_id long, turn long, role string, text string, fits boolean")
