"""Nearest neighbours by cosine: vantage-point trees, one a shard, searched for blocks of queries.

Vectors are scaled to length one, where the chord sqrt(2 - 2 cos) is a metric
that orders like the cosine. A tree node keeps a vantage vector and, for each
half of the rest, the least and greatest chord to it and to the vantage vectors
above. A query passes a half over if the triangle inequality, the best of these
bounds multiplied by `relax`, says that nothing in it can be among the query's
nearest. relax = 1 is exact; larger values pass over more and may miss. Vectors
without clusters, like independent random ones of 64 dimensions, let no metric
bound refuse anything at relax = 1: then the leaves are compared whole, in
matrix products.

Vectors are dealt to shards by a hash of id and vector, a shard holds about
shard_rows of them whatever the table's size, and one that a third of all rows
share is spread evenly. Every query goes to every shard; there the rows of the
shard come first, are built into a tree, and the queries stream past it in
batches. Each shard returns its best k, and a partial limit by query merges
them.

Equal vectors are one point of the tree with the smallest ids that can matter.
The chord only steers the search: candidates within a rounding margin of the
k-th are scored on the original vectors, dot product and squares summed in
order in double precision, and ranked by that score and then the id.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components take no part; vectors of different lengths are never compared; rows
that share an id with the query are no candidates of it; a repeated query row
is answered once, a repeated candidate row counts once; a null id takes no
part; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

LEAF, MARGIN = 256, 1e-9


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise dot products summed strictly in order, so equal rows have equal results wherever they stand."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


class Tree:
    """Over distinct vectors; ids[i] are the smallest ids of point i, ascending.

    A node keeps, for each half and each vantage vector from the root down to its
    own, the least and greatest chord of the half's vectors to it.
    """

    def __init__(self, x: np.ndarray, ids: list[list[int]], leaf: int = LEAF, seed: int = 5):
        self.x, self.ids, self.scored = x, ids, 0
        self.norm = np.sqrt(dots(x, x))
        self.unit = x / self.norm[:, None]
        self.rng, self.leaf = np.random.default_rng(seed), leaf
        self.root = self._build(np.arange(len(x)), np.zeros((len(x), 0)))

    def _build(self, rows: np.ndarray, far: np.ndarray):
        """Leaf rows, or a vantage row with (least chords, greatest chords, child) of two halves; by rank, so ties don't unbalance.

        far: the rows' chords to the vantage vectors above.
        """
        if len(rows) <= self.leaf:
            return rows
        # of a few rows, the one that spreads a few others most
        some, others = self.rng.choice(rows, 5, replace=False), self.rng.choice(rows, min(len(rows), 200), replace=False)
        v = some[np.argmax(chord(self.unit[some] @ self.unit[others].T).std(axis=1))]
        rest = rows != v
        rows, d = rows[rest], chord(self.unit[rows[rest]] @ self.unit[v])
        far = np.concatenate([far[rest], d[:, None]], axis=1)
        order = np.argsort(d, kind="stable")
        half = len(order) // 2
        return v, [(far[part].min(axis=0), far[part].max(axis=0), self._build(rows[part], far[part])) for part in (order[:half], order[half:])]

    def search(self, q: np.ndarray, own: np.ndarray, k: int, relax: float):
        """For queries q with ids own: lists of (score, id), best first; ``scored`` counts the pairs that were compared."""
        s = _Search(self, q, own, k, relax)
        s.visit(self.root, np.arange(len(q)), np.zeros((len(q), 0)))
        self.scored += s.scored
        return [[(-a, i) for a, i in best] for best in s.best]


def chord(cos):
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cos))


class _Search:
    def __init__(self, tree: Tree, q, own, k, relax):
        self.t, self.q, self.own, self.k, self.relax, self.scored = tree, q, own, k, relax, 0
        self.qn = np.sqrt(dots(q, q))
        self.u = q / self.qn[:, None]
        self.least = np.full(len(q), -np.inf)  # cosine of the k-th best so far
        self.best: list[list[tuple[float, int]]] = [[] for _ in range(len(q))]

    def far(self, who: np.ndarray) -> np.ndarray:
        return np.where(np.isinf(self.least[who]), np.inf, chord(np.maximum(self.least[who], -1.0)))

    def offer(self, who: np.ndarray, rows: np.ndarray) -> None:
        cos = self.u[who] @ self.t.unit[rows].T
        self.scored += cos.size
        floor = self.least[who]
        if len(rows) > self.k + 1:  # one of the k + 1 best may be the query itself
            floor = np.maximum(floor, np.partition(cos, len(rows) - self.k - 1, axis=1)[:, len(rows) - self.k - 1])
        a, b = np.nonzero(cos >= floor[:, None] - MARGIN)
        if not len(a):
            return
        a, b = who[a], rows[b]
        score = dots(self.q[a], self.t.x[b]) / (self.qn[a] * self.t.norm[b])
        for i, r, s in zip(a.tolist(), b.tolist(), score.tolist(), strict=True):
            best, own = self.best[i], self.own[i]
            for key in self.t.ids[r]:
                if key != own:
                    best.append((-s, key))
        for i in np.unique(a).tolist():
            best = self.best[i]
            best.sort()
            seen: set[int] = set()
            best[:] = [(s, key) for s, key in best if not (key in seen or seen.add(key))][: self.k]
            if len(best) == self.k:
                self.least[i] = -best[-1][0]

    def visit(self, node, who: np.ndarray, to: np.ndarray) -> None:
        """to: the queries' chords to the vantage vectors above."""
        if not len(who):
            return
        if isinstance(node, np.ndarray):
            self.offer(who, node)
            return
        v, halves = node
        self.offer(who, np.array([v]))
        to = np.concatenate([to, chord(self.u[who] @ self.t.unit[v])[:, None]], axis=1)
        # the triangle inequality, by whichever vantage vector says most
        gap = [np.maximum(0.0, np.maximum(lo - to, to - hi).max(axis=1)) for lo, hi, _ in halves]
        own = [np.maximum(lo[-1] - to[:, -1], to[:, -1] - hi[-1]) for lo, hi, _ in halves]
        nearer = own[0] <= own[1]
        # each query enters its nearer half first, then the other if its bound still allows
        for h, first in ((0, nearer), (1, ~nearer), (0, ~nearer), (1, nearer)):
            keep = first & (gap[h] * self.relax <= self.far(who) + MARGIN)
            self.visit(halves[h][2], who[keep], to[keep])


def _distinct(x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, list[list[int]]]:
    """Distinct vectors, each with its k + 1 smallest distinct ids: more can't be among the k nearest of any query."""
    first: dict[bytes, int] = {}
    rows, lists = [], []
    for i in np.argsort(ids, kind="stable"):
        at = first.setdefault(x[i].tobytes(), len(rows))
        if at == len(rows):
            rows.append(i)
            lists.append([])
        mine = lists[at]
        if len(mine) <= k and (not mine or mine[-1] != ids[i]):
            mine.append(int(ids[i]))
    return x[rows], lists


def searchable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    ok = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    return df.where(ok).select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"))


def nearest(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", relax: float = 1.0, shard_rows: int = 20_000) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows of each row that meets is_query (a condition on `id`)."""
    rows = searchable(df, id_col, vector_col)
    shards = max(1, -(-rows.count() // shard_rows))
    points = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), "id", "v")
    queries = rows.where(is_query).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), "id", "v")
    # ranges, as the hashes of a few small numbers collide
    dealt = points.union(queries).repartitionByRange(shards, "shard").sortWithinPartitions("shard", "asks", "id")

    def run(batches):
        import pyarrow as pa

        shard, held, trees = None, [], None

        def vectors(part):
            flat = part.column("v").combine_chunks() if isinstance(part.column("v"), pa.ChunkedArray) else part.column("v")
            at = np.diff(flat.offsets.to_numpy())
            values = flat.flatten().to_numpy(zero_copy_only=False)
            return part.column("id").to_numpy(), at, values, np.concatenate([[0], np.cumsum(at)])

        def build():
            found: dict[int, tuple[list, list]] = {}
            for ids, width, values, at in held:
                for i in range(len(ids)):
                    xs, ks = found.setdefault(int(width[i]), ([], []))
                    xs.append(values[at[i] : at[i + 1]])
                    ks.append(ids[i])
            return {w: Tree(*_distinct(np.array(xs), np.array(ks), k)) for w, (xs, ks) in found.items()}

        for b in batches:
            names = b.column("shard").to_numpy()
            cuts = np.flatnonzero(np.diff(names)) + 1
            for i, j in zip([0, *cuts], [*cuts, len(names)], strict=True):
                if i == j:
                    continue
                if names[i] != shard:
                    shard, held, trees = names[i], [], None
                asks = b.column("asks").to_numpy(zero_copy_only=False).astype(bool)[i:j]
                split = i + int(np.searchsorted(asks, True))
                if split > i:
                    held.append(vectors(b.slice(i, split - i)))
                if split == j:
                    continue
                if trees is None:
                    trees, held = build(), []
                ids, width, values, at = vectors(b.slice(split, j - split))
                out = []
                for w in np.unique(width).tolist():
                    mine = np.flatnonzero(width == w)
                    if w not in trees:
                        continue
                    for s in range(0, len(mine), 512):
                        part = mine[s : s + 512]
                        q = np.array([values[at[n] : at[n + 1]] for n in part])
                        for n, best in zip(part, trees[w].search(q, ids[part], k, relax), strict=True):
                            out += [(int(ids[n]), key, score) for score, key in best]
                cols = list(zip(*out, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_vp_tree_ann(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


_DOT = "list_reduce(list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i]), lambda x, y: x + y, 0::DOUBLE)"
OP2_SQL = f"""
WITH v AS (SELECT vec_id, e, sqrt({_DOT.format(a='e', b='e')}) AS n FROM (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings
             WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0) WHERE len(list_filter(e, lambda c: c <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, max({_DOT.format(a='q.e', b='c.e')} / (q.n * c.n)) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0 GROUP BY ALL)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 5
"""
