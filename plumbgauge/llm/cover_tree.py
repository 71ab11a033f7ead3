"""Hard negatives by cover trees over norm-augmented candidates.

A candidate gets one more coordinate that gives all candidates of a block the same norm, so a larger inner product with an anchor is a smaller distance to it. The rows of a label, ordered by their nearest
pivot and the distance to it, are cut into blocks of bounded size, and each block holds a cover tree: a node covers its members within its radius, the
centres of its children lie more than a lower level's radius apart, and what no other member is near stays with the node itself. A distance and a covering radius bound the inner products below a node
from both sides. A descent takes the node with the largest upper bound first, leaves out nodes that lie outside every window
still open or below all that is already found there, and takes the inner products of what is left exactly, as integers.

First the best rows of an anchor's own label are found: one window without ends. Their scores give the windows for the
rows of other labels. Blocks are bounded like nodes before anything is sent to them. Anchors with equal vectors are searched once; of
equal candidates only those with the smallest ids can be among the first k, so others are not searched.

Defined results: rows with a null label, vector or id, or a null or non-finite component, take no part; vectors of different length are not compared;
repeated rows count once; ties go to the smaller id; scores beyond 64 bits are the largest number of 64 bits, or minus that; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbgauge.llm.common import cut, ship
from plumbgauge.llm.cross_polytope import first_of_equal

#: Rows of a block, of a tile of anchors or blocks, and pivots at most.
BLOCK, TILE, PIVOTS = 2048, 4096, 256
LEAF, SHRINK = 24, 1.5
_EXACT, _LONG = 1 << 53, 1 << 62
_MOST = (1 << 63) - 1


def integers(column: pa.Array) -> np.ndarray:
    """Integer vectors of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def largest(rows: np.ndarray) -> int:
    return max(int(rows.max()), -int(rows.min())) if rows.size else 0


def products(rows: np.ndarray, floats: np.ndarray, most: int, query: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point where all sums are small enough for that."""
    bound = most * largest(query) * max(rows.shape[1], 1)
    if bound < _EXACT:
        return (floats @ query.astype(np.float64)).astype(np.int64)
    if bound < _LONG:
        return rows @ query
    full = rows.astype(object) @ query.astype(object)
    return np.array([max(-_MOST, min(_MOST, int(x))) for x in full], dtype=np.int64)


@dataclass
class Node:
    center: int
    radius: float
    loose: np.ndarray  # members verified here
    children: list


class Tree:
    """Cover tree over the rows of a block. ``rows`` are integers, ``ids`` their names."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray):
        self.rows, self.ids = rows, ids
        self._ready()
        mean = self.floats.mean(axis=0)
        self.root = self._node(np.arange(len(rows)), int(((self.floats - mean) ** 2).sum(axis=1).argmin()))

    def _ready(self) -> None:
        self.floats = self.rows.astype(np.float64)
        self.most = largest(self.rows)
        norms = (self.floats ** 2).sum(axis=1)
        self.norm = float(norms.max())
        self.lift = np.sqrt(np.maximum(self.norm - norms, 0))

    def __getstate__(self):
        return self.rows, self.ids, self.root

    def __setstate__(self, state):
        self.rows, self.ids, self.root = state
        self._ready()

    def _apart(self, members: np.ndarray, center: int) -> np.ndarray:
        """Distances in the augmented space."""
        return np.sqrt(((self.floats[members] - self.floats[center]) ** 2).sum(axis=1) + (self.lift[members] - self.lift[center]) ** 2)

    def _node(self, members: np.ndarray, center: int) -> Node:
        """Depth is bounded: radii shrink by a factor, to the least distance between different rows."""
        apart = self._apart(members, center)
        radius = float(apart.max())
        if len(members) <= LEAF or radius < 1e-9:
            return Node(center, radius, members, [])
        within = radius / SHRINK
        near = apart <= within
        groups, rest = [(members[near], center)], members[~near]
        while len(rest):
            first = int(rest[0])
            near = self._apart(rest, first) <= within
            groups.append((rest[near], first))
            rest = rest[~near]
        loose = [g for g, _ in groups if len(g) < LEAF // 4]
        return Node(center, radius, np.concatenate(loose) if loose else members[:0], [self._node(g, c) for g, c in groups if len(g) >= LEAF // 4])

    def bounds(self, centers: np.ndarray, radii: np.ndarray, query: np.ndarray, square: float) -> tuple[np.ndarray, np.ndarray]:
        return bounds(self.floats[centers] @ query, radii, self.norm, square, query.size)

    def search(self, query: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per window [low, high] the ids and scores of the k largest inner products in it, ties by smaller id."""
        floats = query.astype(np.float64)
        square = float((floats ** 2).sum())
        none = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        found, least = [none] * len(low), low.astype(np.float64)
        upper, lower = self.bounds(np.array([self.root.center]), np.array([self.root.radius]), floats, square)
        heap, count = [(-upper[0], 0, lower[0], self.root)], 1
        while heap:
            above, _, below, node = heapq.heappop(heap)
            if not ((-above >= least) & (below <= high)).any():
                continue
            if len(node.loose):
                scores = products(self.rows[node.loose], self.floats[node.loose], self.most, query)
                for w in range(len(low)):
                    hit = (scores >= least[w]) & (scores <= high[w])
                    if hit.any():
                        ids, got = np.concatenate([found[w][0], self.ids[node.loose[hit]]]), np.concatenate([found[w][1], scores[hit]])
                        order = np.lexsort((ids, -got))[:k]
                        found[w] = ids[order], got[order]
                        if len(order) == k:
                            least[w] = max(least[w], float(got[order[-1]]) * (1 - 1e-15) if got[order[-1]] > 0 else float(got[order[-1]]) * (1 + 1e-15))
            if node.children:
                upper, lower = self.bounds(np.array([c.center for c in node.children]), np.array([c.radius for c in node.children]), floats, square)
                for child, u, b in zip(node.children, upper.tolist(), lower.tolist()):
                    heapq.heappush(heap, (-u, count, b, child))
                    count += 1
        return found


def bounds(inner: np.ndarray, radii: np.ndarray, norm, square, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower bound of the inner products within ``radii`` of centres whose own are ``inner``; wider than rounding."""
    apart = np.sqrt(np.maximum(square + norm - 2 * inner, 0))
    scale = square + norm  # below 2^50 squared lengths are exact
    slack = scale * np.where(scale < 1 << 50, 1e-12 * (width + 8), 1e-6) + 1e-6
    upper, lower = (scale - np.maximum(apart - radii, 0) ** 2) / 2 + slack, (scale - (apart + radii) ** 2) / 2 - slack
    return np.clip(upper, -_MOST - 1, _MOST), np.clip(lower, -_MOST - 1, _MOST)


def _node_of(rows: DataFrame) -> list[Column]:
    return [F.xxhash64("label", "x").alias("h1"), F.xxhash64(F.lit(1), "label", "x").alias("h2")]


def blocks(rows: DataFrame) -> DataFrame:
    """(block, label, width, center, radius, norm, n, tree): the rows (label, x, vec_id) in cover trees of at most BLOCK rows."""
    spark = rows.sparkSession
    n = rows.count()
    fields = max(1, rows.select("label").distinct().count())
    wanted = max(1, min(PIVOTS, n // (fields * BLOCK)))
    pivots = rows.orderBy(F.xxhash64("x", F.lit(23)), "vec_id").limit(wanted).select("x").collect()  # PIVOTS vectors at most
    by_width: dict[int, list] = {}
    for row in pivots:
        by_width.setdefault(len(row["x"]), []).append(row["x"])
    known = {w: np.array(p, dtype=np.float64).reshape(len(p), w) for w, p in by_width.items()}

    def placed(batches):
        for batch in batches:
            lengths = np.diff(batch.column(1).offsets.to_numpy())
            near, apart = np.zeros(batch.num_rows, dtype=np.int32), np.zeros(batch.num_rows)
            for w in np.unique(lengths).tolist():
                if w in known:
                    at = np.nonzero(lengths == w)[0]
                    x = integers(batch.column(1).take(pa.array(at))).astype(np.float64)
                    square = ((x ** 2).sum(axis=1)[:, None] + (known[w] ** 2).sum(axis=1)[None, :] - 2 * x @ known[w].T)
                    near[at], apart[at] = square.argmin(axis=1), np.sqrt(np.maximum(square.min(axis=1), 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lengths.astype(np.int32)), pa.array(near), pa.array(apart)],
                                             names=["label", "x", "vec_id", "width", "pivot", "apart"])

    order = ["label", "width", "pivot", "apart", "vec_id"]
    names = ["block", "label", "width", "center", "radius", "norm", "n", "tree"]

    def built(batches):
        held, size, now = [], 0, None

        def finish():
            part = pa.Table.from_batches(held).combine_chunks()
            x, ids = integers(part.column("x").combine_chunks()), part.column("vec_id").to_numpy()
            tree = Tree(x, ids)
            blob = pickle.dumps(tree)
            name = int.from_bytes(blake2b(blob, digest_size=8).digest(), "little", signed=True)
            values = [name, now[0], now[1], x[tree.root.center].tolist(), tree.root.radius, tree.norm, len(ids), blob]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.float64(), pa.float64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)

        for batch in batches:
            keys = [batch.column(i).to_numpy() for i in (0, 1, 2)]
            change = np.zeros(batch.num_rows, dtype=bool)
            for c in keys:
                change[1:] |= c[1:] != c[:-1]
            starts = [0, *np.nonzero(change)[0].tolist(), batch.num_rows]
            for s, e in zip(starts, starts[1:]):
                while s < e:
                    mine = tuple(int(c[s]) for c in keys)
                    # a label's next pivot may go on in a block that is not half full
                    if held and (mine[:2] != now[:2] or size == BLOCK or (mine != now and size >= BLOCK // 2)):
                        yield finish()
                        held, size = [], 0
                    now, step = mine, min(e - s, BLOCK - size)
                    held.append(batch.slice(s, step))
                    size, s = size + step, s + step
        if held:
            yield finish()

    dealt = rows.select("label", "x", "vec_id").mapInArrow(placed, "label long, x array<long>, vec_id long, width int, pivot int, apart double")
    return cut(dealt.select("label", "width", "pivot", "apart", "vec_id", "x").repartitionByRange(n // (4 * BLOCK) + 1, *order).sortWithinPartitions(*order)
               .mapInArrow(built, "block long, label long, width int, center array<long>, radius double, norm double, n long, tree binary"))


def _asked(anchors: DataFrame, index: DataFrame, tiles: int, k: int, same_label: bool) -> DataFrame:
    """(h1, h2, block, part): which blocks an anchor must search. Anchors and bounds of blocks meet in tiles of bounded size."""
    stats = index.drop("tree")
    rows = max(1, -(-stats.count() // TILE))
    left = anchors.select("part", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("row"), F.lit(1).alias("kind"), "h1", "h2", "label", "width", F.col("x").alias("v"),
                          F.col("least").cast("double").alias("p"), F.col("most").cast("double").alias("q"), F.lit(0).cast("long").alias("n"))
    right = stats.select(F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("part"), F.pmod(F.xxhash64("block", F.lit(9)), F.lit(rows)).cast("int").alias("row"),
                         F.lit(0).alias("kind"), F.col("block").alias("h1"), F.lit(0).cast("long").alias("h2"), "label", "width", F.col("center").alias("v"),
                         F.col("radius").alias("p"), F.col("norm").alias("q"), "n")
    unit = ["part", "row", "width"]

    def met(batches):
        now, held, table = None, [], None
        for batch in batches:
            keys = [batch.column(i).to_numpy() for i in range(4)]
            change = np.zeros(batch.num_rows, dtype=bool)
            for c in keys:
                change[1:] |= c[1:] != c[:-1]
            starts = [0, *np.nonzero(change)[0].tolist(), batch.num_rows]
            for s, e in zip(starts, starts[1:]):
                if s == e:
                    continue
                mine = tuple(int(c[s]) for c in keys[:3])
                if mine != now:
                    now, held, table = mine, [], None
                part = batch.slice(s, e - s)
                if not keys[3][s]:
                    held.append(part)
                    continue
                if not held:
                    continue
                if table is None:
                    table = pa.Table.from_batches(held).combine_chunks()
                    centers = integers(table.column("v").combine_chunks()).astype(np.float64)
                    names, labels = table.column("h1").to_numpy(), table.column("label").to_numpy()
                    radii, norms, sizes = (table.column(c).to_numpy() for c in ("p", "q", "n"))
                x = integers(part.column("v")).astype(np.float64)
                square = (x ** 2).sum(axis=1)
                upper, lower = bounds(x @ centers.T, radii[None, :], norms[None, :], square[:, None], x.shape[1])
                own = part.column("label").to_numpy()[:, None] == labels[None, :]
                if same_label:  # a block of k rows shows what the k best have at least
                    sure = np.where(own & (sizes >= k)[None, :], lower, -np.inf).max(axis=1, keepdims=True)
                    need = own & (upper >= sure)
                else:
                    least, most = part.column("p").to_numpy()[:, None], part.column("q").to_numpy()[:, None]
                    need = ~own & (upper >= least) & (lower <= most)
                a, b = np.nonzero(need)
                yield pa.RecordBatch.from_arrays([part.column("h1").take(pa.array(a)), part.column("h2").take(pa.array(a)), pa.array(names[b]),
                                                  pa.array(np.full(len(a), now[0], dtype=np.int32))], names=["h1", "h2", "block", "part"])

    parts = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*unit, "kind"]
    columns = [*order, "h1", "h2", "label", "v", "p", "q", "n"]
    return right.select(*columns).unionByName(left.select(*columns)).repartition(parts, *unit).sortWithinPartitions(*order).mapInArrow(
        met, "h1 long, h2 long, block long, part int")


def _searched(anchors: DataFrame, index: DataFrame, tiles: int, k: int, same_label: bool) -> DataFrame:
    """(h1, h2, window, vec_id, score): the k first of each window (number, low, high) of each anchor, among at least these."""
    asked = _asked(anchors, index, tiles, k, same_label).join(anchors.select("h1", "h2", "x", "windows"), ["h1", "h2"])
    wanted = asked.select("block", "part").distinct().join(index.select("block", "tree"), "block")
    both = wanted.select("block", "part", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), "tree",
                         F.lit(None).cast("array<long>").alias("x"), F.lit(None).cast("array<struct<low:long,high:long>>").alias("windows")).unionByName(
        asked.select("block", "part", F.lit(1).alias("kind"), "h1", "h2", F.lit(None).cast("binary").alias("tree"), "x", "windows"))

    def run(batches):
        now, tree = None, None
        out: list[list] = [[], [], [], [], []]

        def taken():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))],
                                               names=["h1", "h2", "high", "vec_id", "score"])
            for c in out:
                c.clear()
            return batch

        for batch in batches:
            for i in range(batch.num_rows):
                mine = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if batch.column(2)[i].as_py() == 0:
                    now, tree = mine, pickle.loads(batch.column(5)[i].as_py())
                    continue
                assert mine == now
                windows = batch.column(7)[i].as_py()
                query = np.array(batch.column(6)[i].as_py(), dtype=np.int64)
                low, high = (np.array([w[c] for w in windows], dtype=np.int64) for c in ("low", "high"))
                for window, (ids, scores) in zip(windows, tree.search(query, low, high, k)):
                    for c, more in zip(out, ([batch.column(3)[i].as_py()] * len(ids), [batch.column(4)[i].as_py()] * len(ids), [window["high"]] * len(ids), ids.tolist(), scores.tolist())):
                        c.extend(more)
            if len(out[0]) > 50_000:
                yield taken()
        yield taken()

    parts = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = Window.partitionBy("h1", "h2", "high").orderBy(F.desc("score"), "vec_id")
    return both.repartition(parts, "block", "part").sortWithinPartitions("block", "part", "kind").mapInArrow(
        run, "h1 long, h2 long, high long, vec_id long, score long").withColumn("nth", F.row_number().over(near)).where(F.col("nth") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores, for ``rows`` (vec_id, label, x) of long, long and array<long>.

    Positives are the first ``positives`` other rows of the anchor's label. Negatives are the first rows of other labels with a score of
    ``low`` to ``high`` hundredths of the positive's. ``is_anchor`` is over vec_id.
    """
    ship(rows.sparkSession)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull())
    stored = cut(first_of_equal(rows, ["label", "x"], "vec_id", max(positives, negatives) + 1))
    index = blocks(stored)
    named = rows.where(is_anchor).select("vec_id", "label", "x", *_node_of(rows))
    anchors = named.groupBy("h1", "h2").agg(F.first("label").alias("label"), F.first("x").alias("x")).withColumn("width", F.size("x"))
    anchors = cut(anchors)
    tiles = max(1, -(-anchors.count() // TILE))
    anchors = anchors.withColumn("part", F.pmod(F.xxhash64("h1", F.lit(3)), F.lit(tiles)).cast("int"))
    ends = F.array(F.struct(F.lit(-_MOST - 1).cast("long").alias("low"), F.lit(_MOST).cast("long").alias("high")))
    near = _searched(anchors.withColumn("least", F.lit(0)).withColumn("most", F.lit(0)).withColumn("windows", ends), index, tiles, positives + 1, True)
    near = cut(near.select("h1", "h2", "vec_id", "score"))
    first = Window.partitionBy("anchor_id", "h1", "h2").orderBy(F.desc("score"), "vec_id")
    chosen = cut(named.select(F.col("vec_id").alias("anchor_id"), "h1", "h2").distinct().join(near, ["h1", "h2"]).where("vec_id <> anchor_id")
                 .withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= positives).select(
                     "anchor_id", "h1", "h2", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # whole numbers n with low * score <= 100 * n <= high * score; none if the score is negative
    score = F.col("positive_score").cast("decimal(25,0)")
    floor, ceiling = (F.floor(score * high / 100).cast("long"), F.ceil(score * low / 100).cast("long"))
    windows = chosen.where("positive_score >= 0").select("h1", "h2", F.struct(ceiling.alias("low"), floor.alias("high")).alias("w")).distinct()
    # equal ends are one window; more positives of an anchor's vector than ``positives`` + 1 do not exist
    windows = windows.groupBy("h1", "h2", "w.high").agg(F.min("w.low").alias("low")).groupBy("h1", "h2").agg(
        F.collect_list(F.struct("low", "high")).alias("windows"), F.min("low").alias("least"), F.max("high").alias("most"))
    found = _searched(cut(anchors.join(windows, ["h1", "h2"])), index, tiles, negatives, False)
    told = chosen.withColumn("high", floor).join(found.select("h1", "h2", "high", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), ["h1", "h2", "high"])
    told = told.where(F.col("negative_score") >= ceiling)
    rank = Window.partitionBy("anchor_id", "h1", "h2", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    return told.withColumn("rank", F.row_number().over(rank).cast("int")).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def whole_numbers(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, x): components as floor(scale * component) in double precision; rows that take no part are left out."""
    v = F.col(vector_col).cast("array<double>")
    sound = F.col(label_col).isNotNull() & v.isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    most = F.lit(float(1 << 62))  # beyond, a component is the largest
    return vectors.where(F.coalesce(sound, F.lit(False))).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
        F.transform(v, lambda c: F.floor(F.greatest(-most, F.least(most, scale * c)))).alias("x"))
