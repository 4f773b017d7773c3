"""Runs a list of declared operations over named frames."""

from __future__ import annotations

from dataclasses import dataclass, field

from lodeframe.errors import require
from lodeframe.frame import Frame
from lodeframe.operators import pipeline as p


@dataclass
class Analysis:
    """What a run gives: the frames at its end, a note for each operation, and statistics."""

    frames: dict[str, Frame]
    notes: list[dict] = field(default_factory=list)


def analyze(frames: dict[str, Frame], operations: list[dict]) -> Analysis:
    """Folds operations over frames. An operation is {kind, frame, ...} with its operator's arguments."""
    run = Analysis(dict(frames))
    for op in operations:
        op = dict(op)
        kind, name = op.pop("kind"), op.pop("frame")
        f = run.frames[name]
        if kind == "statistics":
            run.notes.append({"operation": kind, "frame": name, op.get("function", "describe"): p.statistics(f, **op)})
            continue
        if kind == "join":
            op["right"] = run.frames[op.pop("right_frame")]
            op["left_on"] = op.pop("columns")
        if kind == "aggregate":
            op["metrics"] = [m if isinstance(m, p.Metric) else p.Metric(**m) for m in op["metrics"]]
        act = {"convert": p.convert, "filter": p.filter_rows, "missing": p.missing_values, "duplicates": p.duplicates, "join": p.join, "aggregate": p.aggregate, "derive": p.derive, "melt": p.melt, "pivot": p.pivot}.get(kind)
        require(act is not None, "unknown_operation")
        run.frames[name] = act(f, **op)
        run.notes.append({"frame": name} | run.frames[name].notes[-1])
    return run
