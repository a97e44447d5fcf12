"""Exact top-k inner products by a three-phase uniform threshold.

A vector's components are cut into ``LISTS`` runs; the products of a query with one run of all candidates are a local score
list, and a score is the sum over the lists. No task has more than one list of some candidates.

1. Every list gives its ``DEPTH`` best candidates of a query. Their whole scores are asked from all lists; the k-th best of them,
   tau, is a safe cutoff: k candidates reach it.
2. Each list sends every candidate whose local score times the number of lists is at least tau. One that no list sends has a
   score below tau. What was sent by all lists is a whole score and raises the cutoff; one that some lists did not send gets
   less than tau / lists from each of those, and is discarded where even that does not lift it to the raised cutoff.
3. The whole scores of the few that remain are asked from all lists, and the best k are taken.

Lists meet queries in cells of a grid of bounded size (``QUERIES`` x ``CANDIDATES``): only ids and local scores leave a cell,
packed by query, and the cutoff travels with the query.

Equal vectors are one candidate with its k + 1 smallest ids, and one query; so a vector that a third of all rows share
takes part once and nothing is lost: a query can show at most k of them. Equal vectors are found by grouping; of a group's rows
each task sends k + 1 at most.

Results: scores are exact whole numbers (one of 2^62 or more is an error); the vectors of a table that are not
usable take no part; a shorter vector counts as filled up with zeros; a row with the id of another is a row of its own, as query and as
candidate; a null id is no query and stands behind all others in a tie. Without candidates a query has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revmatch.llm.common import placed, written
from revmatch.llm.vectors import VEC, padded, whole_vectors, width
from revmatch.operators.ranking import lookup

SCALE = 256.0
K, EVERY = 5, 50
#: Local score lists, candidates that each gives in the first phase, and the size of a cell.
LISTS, DEPTH = 2, 24
QUERIES, CANDIDATES = 2048, 8192
#: Queries of a cell whose local scores are held at once.
_TURN = 256
#: Query rows of one vector that are looked up as one group; beyond, its answer is broadcast (there are at most rows / HOT such).
HOT = 100_000
_FAR = 1 << 62  # stands for a null id in ties: no id is as large
_CELL = ["list", "q_part", "c_part"]
_LOWEST = -(1 << 62)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact products of whole-number rows: through doubles where they can't round, else as Python's whole numbers."""
    if not q.size or not c.size:
        return np.zeros((len(q), len(c)), np.int64)
    bound = float(np.abs(q.astype(float)).max()) * float(np.abs(c.astype(float)).max()) * q.shape[1]
    if bound < 2.0 ** 52:
        return (q.astype(float) @ c.astype(float).T).astype(np.int64)
    if bound < 2.0 ** 62:
        return q @ c.T
    whole = q.astype(object) @ c.astype(object).T
    if max(abs(int(whole.max())), abs(int(whole.min()))) >= 1 << 62:
        raise OverflowError("a score of 2^62 or more")
    return whole.astype(np.int64)


def _matrix(table: pa.Table) -> np.ndarray:
    flat = table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, -1) if table.num_rows else flat.reshape(0, 0)


def _packed(q: np.ndarray, at: np.ndarray, ids: np.ndarray, scores: np.ndarray, extra: dict) -> pa.Table:
    """Entries (place of the query, id, score), sorted by query, as one row a query."""
    places, first = np.unique(at, return_index=True)
    offsets = pa.array(np.append(first, len(at)).astype(np.int32))
    return pa.table({
        **{name: pa.array([value] * len(places), pa.int32()) for name, value in extra.items()}, "q": pa.array(q[places], pa.int64()),
        "ids": pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int64())), "scores": pa.ListArray.from_arrays(offsets, pa.array(scores, pa.int64()))})


_PACKED = "list int, c_part int, q long, ids array<long>, scores array<long>"


def _entries(key, queries: pa.Table, candidates: pa.Table, chosen) -> pa.Table:
    """The entries that ``chosen(local scores, first query)`` names as places of query and candidate, for some queries at a time."""
    left, right, found = _matrix(queries), _matrix(candidates), []
    for i in range(0, len(left) if len(right) else 0, _TURN):
        local = _products(left[i:i + _TURN], right)
        at, where = chosen(local, i)
        found.append((at + i, where, local[at, where]))
    at, where, scores = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
    return _packed(queries["q"].to_numpy(), at, candidates["c"].to_numpy()[where], scores, {"list": key[0].as_py(), "c_part": key[2].as_py()})


def _best_of_list(depth: int):
    """Phase 1 in a cell: the ``depth`` best local scores of each query."""
    def best(key, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        n = min(depth, candidates.num_rows)

        def chosen(local: np.ndarray, _) -> tuple[np.ndarray, np.ndarray]:
            return np.repeat(np.arange(len(local)), n), np.argpartition(-local, n - 1, axis=1)[:, :n].ravel()

        return _entries(key, queries, candidates, chosen)

    return best


def _above_cutoff(lists: int):
    """Phase 2 in a cell: every candidate whose local score times the number of lists reaches the query's cutoff."""
    def above(key, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        least = np.array([-(-tau // lists) for tau in queries["tau"].to_pylist()], np.int64)
        return _entries(key, queries, candidates, lambda local, i: np.nonzero(local >= least[i:i + len(local), None]))

    return above


def _asked(key, queries: pa.Table, candidates: pa.Table) -> pa.Table:
    """Local scores of the candidates that queries ask for in a cell; rows without ``x`` in ``queries`` are what is asked."""
    known = queries.filter(pc.is_valid(queries["x"]))
    asked = queries.filter(pc.is_null(queries["x"]))
    at_q, at_c = (np.argsort(t[c].to_numpy()) for t, c in ((known, "q"), (candidates, "c")))
    q, c = asked["q"].to_numpy(), asked["c"].to_numpy()
    rows = at_q[np.searchsorted(known["q"].to_numpy(), q, sorter=at_q)]
    columns = at_c[np.searchsorted(candidates["c"].to_numpy(), c, sorter=at_c)]
    left, right, out = _matrix(known), _matrix(candidates), np.zeros(len(q), np.int64)
    order = np.argsort(rows, kind="stable")
    cuts = np.flatnonzero(np.diff(rows[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        out[part] = _products(left[rows[part[:1]]], right[columns[part]])[0]
    return pa.table({"q": pa.array(q, pa.int64()), "c": pa.array(c, pa.int64()), "local": pa.array(out, pa.int64())})


class _Lists:
    """Queries (``q``, ``x``) and candidates (``c``, ``x``) cut into lists and laid out in a grid of cells."""

    def __init__(self, queries: DataFrame, candidates: DataFrame, d: int, lists: int, size: tuple[int, int], counts: tuple[int, int]):
        self.lists, self.parts = lists, [max(1, -(-n // s)) for n, s in zip(counts, size)]
        cuts = [d * k // lists for k in range(lists + 1)]
        runs = F.array(*[F.struct(F.lit(k).alias("list"), F.slice("x", a + 1, b - a).alias("x")) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))])
        self.queries, self.candidates = (t.select("*", F.explode(runs).alias("run")).drop("x").select("*", "run.*").drop("run") for t in (queries, candidates))

    def part(self, side: int, ids: str) -> Column:
        return F.pmod(F.xxhash64(ids), F.lit(self.parts[side])).cast("int")

    def _all(self, side: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(self.parts[side] - 1)))

    def meet(self, ask: DataFrame, work, schema: str) -> DataFrame:
        """``work`` on every cell; ``ask`` has the query side, placed already."""
        listed = self.candidates.withColumn("c_part", self.part(1, "c")).withColumn("q_part", self._all(0))
        return ask.groupBy(*_CELL).cogroup(listed.groupBy(*_CELL)).applyInArrow(work, schema)

    def placed_queries(self, cutoffs: DataFrame | None = None) -> DataFrame:
        asking = self.queries if cutoffs is None else self.queries.join(cutoffs, "q")
        return asking.withColumn("q_part", self.part(0, "q")).withColumn("c_part", self._all(1))

    def whole_scores(self, pairs: DataFrame) -> DataFrame:
        """``q, c, score`` of pairs ``q, c``, each added up from all lists; ids travel to the cells, vectors don't follow them."""
        wanted = pairs.select("q", "c", F.explode(F.sequence(F.lit(0), F.lit(self.lists - 1))).alias("list")).select(
            "list", self.part(0, "q").alias("q_part"), self.part(1, "c").alias("c_part"), "q", "c", F.lit(None).cast("array<long>").alias("x"))
        asking = self.placed_queries().select(*_CELL, "q", F.lit(None).cast("long").alias("c"), "x")
        return self.meet(wanted.unionByName(asking), _asked, "q long, c long, local long").groupBy("q", "c").agg(F.sum("local").alias("score"))


def _first(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query by score, then by rising candidate; each task cuts its own before the exchange."""
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))
    return scored.withColumn("place", place).filter(F.col("place") <= k)


def _kth(scored: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``q, tau``: the k-th best score of each query, or the lowest number where there are fewer."""
    found = _first(scored, k).filter(F.col("place") == k).select("q", F.col("score").alias("tau"))
    return queries.select("q").join(found, "q", "left").select("q", F.coalesce("tau", F.lit(_LOWEST).cast("long")).alias("tau"))


def _combined(lists: int):
    """What the lists sent for one query and part of the candidates, added up: id, sum of what is known, lists that sent it."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {"q": [], "ids": [], "sums": [], "sent": []}
            for q, sent in zip(b.column("q").to_pylist(), b.column("sent")):
                parts = sent.values
                ids = pa.concat_arrays([parts.field("ids")]).flatten().to_numpy()
                scores = parts.field("scores").flatten().to_numpy()
                known, back, times = np.unique(ids, return_inverse=True, return_counts=True)
                sums = np.zeros(len(known), np.int64)
                np.add.at(sums, back, scores)
                out["q"].append(q), out["ids"].append(known), out["sums"].append(sums), out["sent"].append(times.astype(np.int32))
            yield pa.record_batch([pa.array(out["q"], pa.int64()), *[pa.array(out[c], pa.list_(t)) for c, t in (("ids", pa.int64()), ("sums", pa.int64()), ("sent", pa.int32()))]],
                                  names=list(out))
    return add


def nearest(queries: DataFrame, candidates: DataFrame, d: int, k: int, lists: int = LISTS, depth: int = DEPTH,
            size: tuple[int, int] = (QUERIES, CANDIDATES)) -> DataFrame:
    """``q, c, score``: the k candidates (``c``, ``x``) with the largest inner product with each query (``q``, ``x``), ties to the smaller ``c``."""
    lists = max(1, min(lists, d))
    grid = _Lists(queries, candidates, d, lists, size, (queries.count(), candidates.count()))
    depth = max(depth, k)
    # phase 1: local lists, and the cutoff from whole scores of what they name
    local = grid.meet(grid.placed_queries(), _best_of_list(depth), _PACKED)
    entries = local.select("list", "q", F.explode(F.arrays_zip("ids", "scores")).alias("e")).select("list", "q", F.col("e.ids").alias("c"), F.col("e.scores").alias("s"))
    place = F.row_number().over(Window.partitionBy("list", "q").orderBy(F.desc("s"), "c"))
    named = entries.withColumn("place", place).filter(F.col("place") <= depth).select("q", "c").distinct()
    cutoffs = written(_kth(grid.whole_scores(named), queries, k), "cutoffs")
    # phase 2: everything that can reach the cutoff
    sent = grid.meet(grid.placed_queries(cutoffs), _above_cutoff(lists), _PACKED)
    gathered = sent.groupBy("q", "c_part").agg(F.collect_list(F.struct("ids", "scores")).alias("sent")).select("q", "sent")
    reached = written(gathered.mapInArrow(_combined(lists), "q long, ids array<long>, sums array<long>, sent array<int>"), "reached")
    each = reached.select("q", F.explode(F.arrays_zip("ids", "sums", "sent")).alias("e")).select("q", F.col("e.ids").alias("c"), F.col("e.sums").alias("score"), "e.sent")
    whole = each.filter(F.col("sent") == lists).drop("sent")
    raised = _kth(whole, queries, k).select("q", F.col("tau").alias("better"))
    bars = written(cutoffs.join(raised, "q").select("q", "tau", F.greatest("tau", "better").alias("bar")), "bars")
    # phase 3: the rest that could still be among the best; a list that did not send a candidate has less than tau / lists for it
    below = F.expr(f"-((-tau - pmod(-tau, {lists})) div {lists}) - 1")
    most = F.col("score") + (lists - F.col("sent")) * below
    open_pairs = each.filter(F.col("sent") < lists).join(bars, "q").filter(most >= F.col("bar")).select("q", "c")
    return _first(whole.unionByName(grid.whole_scores(open_pairs).select(*whole.columns)), k).drop("place")


def search(table: DataFrame, k: int = K, every: int = EVERY, lists: int = LISTS, depth: int = DEPTH,
           size: tuple[int, int] = (QUERIES, CANDIDATES), hot: int = HOT) -> DataFrame:
    """The k best other rows of every row whose id ``every`` divides: ``query_id, rank, vec_id, score``."""
    vectors = whole_vectors(table, SCALE)
    d = width(vectors)
    rows = written(padded(vectors, d, 0).withColumn("place", F.coalesce(VEC, F.lit(_FAR))), "rows")
    first = rows.withColumn("no", F.row_number().over(Window.partitionBy("x").orderBy("place"))).filter(F.col("no") <= k + 1)
    classes = first.groupBy("x").agg(F.sort_array(F.collect_list("place")).alias("members")).withColumn("least", F.col("members")[0])
    # classes are numbered by their smallest id, so that a tie of scores falls to the smaller number
    numbered, runs = placed(classes, ["least", "x"], "classes")
    candidates = numbered.join(runs, "part").select((F.col("at") - F.col("first") + F.col("before")).alias("c"), "x", "members")
    candidates = written(candidates, "candidates")
    asking = rows.filter(F.col(VEC) % every == 0).select(VEC, "x")
    queries = written(asking.groupBy("x").agg(F.count(F.lit(1)).alias("rows")).join(candidates.select("c", "x"), "x").select(F.col("c").alias("q"), "x", "rows"), "queries")
    # its own vector is among a query's candidates, so one more is taken
    best = nearest(queries.select("q", "x"), candidates.select("c", "x"), d, k + 1, lists, depth, size)
    named = best.join(candidates.select("c", "members"), "c")
    shown = F.transform("members", lambda m: F.struct((-F.col("score")).alias("below"), m.alias("place"), (F.col("q") == F.col("c")).alias("own")))
    merged = named.select("q", shown.alias("s")).groupBy("q").agg(F.sort_array(F.flatten(F.collect_list("s"))).alias("found"))
    answers = queries.join(merged, "q").select("x", "rows", "found")
    told = lookup(asking, answers, ["x"], ties="rows", limit=hot).select(F.col(VEC).alias("query_id"), "found")
    # the row itself stands among the k + 1 first of its vector at most once; rows of one id and vector are alike
    me = F.array_position(F.transform("found", lambda e: e["own"] & (e["place"] == F.col("query_id"))), True).cast("int")
    others = told.withColumn("me", me).select("query_id", F.slice(F.when(F.col("me") > 0, F.concat(
        F.slice("found", F.lit(1), F.col("me") - 1), F.slice("found", F.col("me") + 1, F.size("found")))).otherwise(F.col("found")), 1, k).alias("found"))
    ranked = others.select("query_id", F.posexplode("found").alias("at", "e"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.when(F.col("e.place") < _FAR, F.col("e.place")).alias(VEC), (-F.col("e.below")).alias("score"))
