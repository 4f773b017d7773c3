"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

A term is a vector position. A block of candidates keeps, for each term, its
postings: places and weights. A sparse query row scatters its weighted postings, term
by term, into a dense array of scores, of which a partition selection keeps the best;
a task merges them as blocks stream past its queries. A term that most of a block holds keeps its
postings as a full column, as then adding the column is the same and cheaper.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.llm.shared import written

#: Candidates and queries in a block.
CANDIDATES, QUERIES = 2048, 256
#: Queries whose best a task holds, and candidates that stream past them; a block of each is in memory.
HELD, READ = 32_768, 131_072
#: Small tables are dealt to so many tasks at the most, each with so many pairs at the least.
TASKS, PAIRS = 64, 1 << 25
_LONG = np.iinfo(np.int64)


def scaled(df: DataFrame, id_col: str, vector_col: str, factor: float) -> DataFrame:
    """(vec_id, terms array<double>): floor(factor * x). Rows that take no part are left out."""
    whole = f"`{id_col}` IS NOT NULL AND `{vector_col}` IS NOT NULL AND forall(`{vector_col}`, x -> x IS NOT NULL AND abs(double(x)) < double('infinity') AND NOT isnan(x))"
    return df.where(whole).select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"),
        F.expr(f"transform(`{vector_col}`, x -> double(floor({factor!r}D * double(x))))").alias("terms"),
    )


def _dense(rows: list) -> np.ndarray:
    """Rows as one matrix of integers; short vectors end in zeros. Python integers where 64 bits don't do."""
    out = np.zeros((len(rows), max((len(r) for r in rows), default=0)))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


class Postings:
    """For each term, the candidates that hold it, as (places, weights) or as a full column."""

    def __init__(self, block: np.ndarray, dtype):
        self.n, self.dtype, self.terms = len(block), dtype, []
        for t in range(block.shape[1]):
            at = np.flatnonzero(block[:, t])
            self.terms.append((None, _cast(block[:, t], dtype)) if 2 * len(at) > self.n else (at, _cast(block[at, t], dtype)))

    def scores(self, terms: np.ndarray, weights: list) -> np.ndarray:
        out, spare = np.zeros(self.n, self.dtype), np.empty(self.n, self.dtype)
        for t, w in zip(terms, weights, strict=True):
            if t >= len(self.terms):
                continue
            at, column = self.terms[t]
            if at is None:
                np.multiply(column, w, out=spare)
                out += spare
            elif len(at):
                out[at] += column * w
        return out


def _cast(x: np.ndarray, dtype) -> np.ndarray:
    return np.array([int(v) for v in x], object) if dtype is object else x.astype(dtype)


def block_best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, block: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: its number, and the ids and scores of its k best in the block, best first."""
    top = float(np.abs(queries).max(initial=0)) * float(np.abs(block).max(initial=0)) * max(1, block.shape[1])
    dtype = np.int32 if top < 2**31 else np.int64 if top < 2**62 else object
    order = np.argsort(ids, kind="stable")
    ids, postings = ids[order], Postings(block[order], dtype)
    for i, q in enumerate(queries):
        held = np.flatnonzero(q)
        weights = [int(v) for v in q[held]] if dtype is object else list(q[held].astype(dtype))
        scores = postings.scores(held, weights)
        own = slice(*np.searchsorted(ids, [query_ids[i], query_ids[i] + 1]))
        there = np.ones(len(ids), bool)
        there[own] = False
        at = np.flatnonzero(there)
        scores = scores[at]
        if len(at) > k:
            least = sorted(scores)[-k] if dtype is object else np.partition(scores, len(at) - k)[len(at) - k]
            kept = np.flatnonzero(scores >= least)
            at, scores = at[kept], scores[kept]
        best = sorted(range(len(at)), key=lambda j: (-int(scores[j]), j))[:k]
        yield i, ids[at[best]], np.array([min(max(int(scores[j]), _LONG.min), _LONG.max) for j in best], np.int64)


def _blocks(rows: DataFrame, n: int) -> DataFrame:
    """One row a block: its number b, ids as bytes, and a matrix of doubles as bytes with its width."""

    def pack(group: pa.Table) -> pa.Table:
        ids = group["vec_id"].to_numpy()
        m = _dense(group["terms"].to_pylist())
        return pa.table({"b": pa.array([group["b"][0].as_py()], pa.int32()), "ids": pa.array([ids.astype(np.int64).tobytes()], pa.binary()), "rows": pa.array([m.tobytes()], pa.binary()), "width": pa.array([m.shape[1]], pa.int32())})

    # The row's own number is in the hash, so that many rows of one id still spread.
    b = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(n)).cast("int")
    return rows.withColumn("b", b).groupBy("b").applyInArrow(pack, "b int, ids binary, rows binary, width int")


def top_k(df: DataFrame, k: int = 20, every: int = 20, factor: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k best other rows of every row whose id is divisible by ``every``.

    Returns (query_id, rank from 1, vec_id, score): score is the integer inner product
    of floor(factor * x), ties go to the smaller vec_id, and fewer rows than k give all.
    A null id, or a vector that is null or holds null, NaN or infinite components, takes
    no part. Rows with the query's id are its own. Vectors of unequal lengths count as
    ending in zeros, so an empty one scores 0. Scores beyond 64 bits are held at its ends.
    Rows that repeat a query's id are queries of their own, each with its ranks.

    Queries are dealt into groups and candidates into others, and a pair of groups is a task:
    its queries are held with their best so far, and blocks of candidates stream past them.
    Vectors are thus copied once for each group of the other kind, not for each block.
    """
    rows = scaled(df, id_col, vector_col, factor)
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    n, q = rows.agg(F.count("*"), F.count(F.when(F.pmod("vec_id", F.lit(every)) == 0, 1))).first()
    nb, nq, held = (max(1, math.ceil(x / most)) for x, most in ((n, CANDIDATES), (q, QUERIES), (q, HELD)))
    read = min(nb, max(math.ceil(n / READ), min(TASKS, math.ceil(n * q / PAIRS / held)), 1))
    number = lambda name, groups: F.pmod(F.col("b"), F.lit(groups)).alias(name)
    every_one = lambda name, groups: F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias(name)
    # A query is known by its place in its block, so the blocks are written.
    queries = written(_blocks(asked, nq), "topk-queries").select(number("r", held), every_one("g", read), F.lit(0).alias("role"), "*")
    candidates = _blocks(rows, nb).select(every_one("r", held), number("g", read), F.lit(1).alias("role"), "*")
    dealt = queries.unionByName(candidates).repartition(held * read, "r", "g").sortWithinPartitions("r", "g", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, asking = None, []
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                m = np.frombuffer(row["rows"]).reshape(len(ids), row["width"])
                if task != (row["r"], row["g"]):
                    yield from _best_rows(asking)
                    task, asking = (row["r"], row["g"]), []
                if row["role"] == 0:
                    asking.append((row["b"], ids, m, {}))
                    continue
                for _, q_ids, q_rows, best in asking:
                    for i, found, scores in block_best(q_ids, q_rows, ids, m, k):
                        best[i] = merged(*best[i], found, scores, k) if i in best else (found, scores)
        yield from _best_rows(asking)

    found = dealt.mapInArrow(run, "q int, i int, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("q", "i").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def merged(ids: np.ndarray, scores: np.ndarray, more_ids: np.ndarray, more_scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of both, best first, ties to the smaller id."""
    ids, scores = np.concatenate([ids, more_ids]), np.concatenate([scores, more_scores])
    # ~x orders integers downwards and has no overflow at the least one.
    best = np.lexsort((ids, ~scores))[:k]
    return ids[best], scores[best]


def _best_rows(asking: list[tuple]) -> Iterator[pa.RecordBatch]:
    for q, q_ids, _, best in asking:
        sizes = [len(ids) for ids, _ in best.values()]
        places = np.repeat(np.array(list(best), np.int32), sizes)
        ids, scores = (np.concatenate([b[j] for b in best.values()] or [np.empty(0, np.int64)]) for j in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(places), q, np.int32), places, q_ids[places], ids, scores)], ["q", "i", "query_id", "vec_id", "score"])
