"""Sampling, splitting and balancing (B1–B6) plus the ``two_level_rank`` helper.

Random choices are replaced by the order of ``md5(key)`` — uniform, reproducible,
and partition-independent.  Global ranks never use an unpartitioned window:
``two_level_rank`` buckets the sort key by range, counts per (group, bucket),
prefix-sums that small table and adds a ``row_number`` inside each
(group, bucket).  The result equals the global order exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.functions.exprs import col, hash_uniform, md5_chunk_uniform
from millwright.session import materialize

BUCKET_DIGITS = 4      # of the hash: 65,536 rank buckets a group


def md5_key(key: str | Column) -> Column:
    return F.md5(col(key).cast("string"))


def two_level_rank(df: DataFrame, group_cols: list[str], order_key: Column, tie_key: Column,
                   bucket: Column | None = None, out: str = "rank",
                   group_total: str | None = None) -> DataFrame:
    """Exact 1-based rank of ``(order_key, tie_key)`` within ``group_cols`` (ascending).

    ``bucket`` must be monotone in ``order_key``; by default the key is an md5 hex
    string and the bucket its first ``BUCKET_DIGITS`` hex digits.  The count table has at
    most groups × 16^digits rows, so its prefix sum is cheap, and no task sees a whole group.
    """
    if bucket is None:
        bucket = F.conv(F.substring(order_key, 1, BUCKET_DIGITS), 16, 10).cast("long")
    b = bucket
    d = df.withColumns({"__ok": order_key, "__tk": tie_key, "__b": b})
    counts = d.groupBy(*group_cols, "__b").agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(*group_cols).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__c").over(w), F.lit(0)))
    if group_total:
        # group sizes fall out of the same bucket counts — no second pass over the rows
        offsets = offsets.withColumn(group_total, F.sum("__c").over(Window.partitionBy(*group_cols)))
    # the offset table is written once, so that Spark plans the join by its size
    j = d.join(materialize(offsets.drop("__c"), "rank-offsets"), [*group_cols, "__b"])
    wr = Window.partitionBy(*group_cols, "__b").orderBy("__ok", "__tk")
    return j.withColumn(out, F.row_number().over(wr) + F.col("__off")).drop("__ok", "__tk", "__b", "__off")


def class_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))


def class_quotas(sizes: dict, max_rows: int) -> dict:
    """Rows of each class in a stratified sample: proportional, largest remainders first."""
    n = sum(sizes.values())
    if n <= max_rows:
        return dict(sizes)
    exact = {c: max_rows * v / n for c, v in sizes.items()}
    quota = {c: int(math.floor(x)) for c, x in exact.items()}
    rest = max_rows - sum(quota.values())
    for c in sorted(exact, key=lambda c: (-(exact[c] - quota[c]), str(c)))[:rest]:
        quota[c] += 1
    return quota


def stratified_sample(df: DataFrame, label: str, key: str, max_rows: int) -> DataFrame:
    """B1: keep ``max_rows`` rows, class quotas proportional (largest remainder), first by md5(key)."""
    sizes = {r[label]: r["__n"] for r in class_sizes(df, label).collect()}  # one row per class
    if sum(sizes.values()) <= max_rows:
        return df
    ranked = two_level_rank(df, [label], md5_key(key), col(key))
    qmap = F.create_map(*[x for c, v in class_quotas(sizes, max_rows).items() for x in (F.lit(c), F.lit(v))])
    return ranked.filter(F.col("rank") <= F.element_at(qmap, col(label))).drop("rank")


def stratified_split(df: DataFrame, label: str, key: str, keep_rank: bool = False) -> DataFrame:
    """B2: 70/10/20 train/val/test within each class by md5(key) rank: test if (r−1)/n < .2, val if < .3.

    ``keep_rank`` leaves the rank within the class, so that a sample of a split needs no second ranking.
    """
    j = two_level_rank(df, [label], md5_key(key), col(key), group_total="__n")
    r0 = F.col("rank") - 1
    split = F.when(r0 * 5 < F.col("__n"), "test").when(r0 * 10 < F.col("__n") * 3, "val").otherwise("train")
    return j.withColumn("split", split).drop("__n", *([] if keep_rank else ["rank"]))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n/(2·n_c) per class and the neural positive weight clip(n_neg/n_pos, 1, 4.5)."""
    g = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(col(label) == 1).alias("n_pos"))
    g = g.withColumn("n_neg", F.col("n") - F.col("n_pos"))
    pos_w = F.least(F.lit(4.5), F.greatest(F.lit(1.0), F.col("n_neg") / F.greatest(F.col("n_pos"), F.lit(1))))
    return g.select(
        "n", "n_pos", "n_neg",
        (F.col("n") / (F.lit(2.0) * F.col("n_neg"))).alias("weight_neg"),
        (F.col("n") / (F.lit(2.0) * F.col("n_pos"))).alias("weight_pos"),
        pos_w.alias("dl_pos_weight"),
    )


def with_class_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    w = class_weights(df, label).first()
    return df.withColumn(out, F.when(col(label) == 1, F.lit(w["weight_pos"])).otherwise(F.lit(w["weight_neg"])))


def preview_sample(df: DataFrame, label: str, key: str, limit: int = 14) -> DataFrame:
    """Up to limit/2 failures, the rest healthy, each the first by md5(key)."""
    n_fail_avail = df.filter(col(label) == 1).limit(limit // 2).count()
    fail = df.filter(col(label) == 1).orderBy(md5_key(key), col(key)).limit(min(n_fail_avail, limit // 2))
    healthy = df.filter(col(label) == 0).orderBy(md5_key(key), col(key)).limit(limit - n_fail_avail)
    return fail.unionByName(healthy)


def explanation_sample(df: DataFrame, key: str, n: int = 180) -> DataFrame:
    """Fixed-size background / explanation sample (top-n by md5(key); per-partition top-k then merge)."""
    return df.orderBy(md5_key(key), col(key)).limit(n)


# ----------------------------------------------------------------------- B3: SMOTE
CELL_ROWS = 2048    # rows aimed at per cell, until there are CELLS cells
CELLS = 4096        # cells at most: their boxes are what the driver holds
SAMPLE = 16         # rows per cell that the cuts between cells are taken from (cuts decide where rows meet, not what is found)
QUERY_ROWS = 1024   # rows that one task answers at a time in a cell


def _closest(ids, x, best, cid, cx, k: int):
    """``best`` (rounded distance, distance, id of k rows per query) after more candidates; the same id is never its own neighbour."""
    centre = cx.mean(axis=0)
    a, b = x - centre, cx - centre
    a2, b2 = (a * a).sum(axis=1), (b * b).sum(axis=1)
    near = a2[:, None] + b2[None, :] - 2 * (a @ b.T)        # squared distances but for rounding
    both = pd.factorize(np.concatenate((ids, cid)))[0]
    near[both[:len(ids), None] == both[None, len(ids):]] = np.inf
    top = np.partition(near, k - 1, axis=1)[:, k - 1] if near.shape[1] >= k else np.full(len(x), np.inf)
    top = np.minimum(top, best[0][:, -1] ** 2)
    slack = 1e-12 * (a2 + b2.max(initial=0.0)) + 1e-8 * (1 + np.sqrt(np.maximum(top, 0)))
    row, col_ = np.nonzero((near <= (top + slack)[:, None]) & np.isfinite(near))
    diff = x[row] - cx[col_]
    dist = np.sqrt((diff * diff).sum(axis=1))
    had = np.nonzero(np.isfinite(best[1]))
    row, dist = np.concatenate((had[0], row)), np.concatenate((best[1][had], dist))
    other = np.concatenate((best[2][had], cid[col_]))
    rounded = np.round(dist, 9)
    order = np.lexsort((np.unique(other, return_inverse=True)[1].ravel(), rounded, row)) if len(row) else np.zeros(0, np.int64)
    row = row[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    order, row, place = order[place < k], row[place < k], place[place < k]
    out = (np.full(best[0].shape, np.inf), np.full(best[0].shape, np.inf), np.full(best[0].shape, ids[0], dtype=ids.dtype))
    for o, v in zip(out, (rounded, dist, other)):
        o[row, place] = v[order]
    return out


def _nearest(k: int):
    """The k nearest candidates of each query: rows come by (cell, chunk), queries (kind 0) first, candidates streamed past."""

    def answer(at, best):
        found = [[{"r": r, "nn_id": i, "dist": d} for r, d, i in zip(*row) if d < np.inf] for row in zip(*(v.tolist() for v in best))]
        return pd.DataFrame({"__q": at, "found": found})

    def run(batches):
        group, at, ids, x, best = None, None, None, None, None
        for pdf in batches:
            marks = list(zip(pdf["cell"].tolist(), pdf["chunk"].tolist(), pdf["kind"].tolist()))
            cuts = [0, *(i for i in range(1, len(marks)) if marks[i] != marks[i - 1]), len(marks)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                part = pdf.iloc[lo:hi]
                new_at, new_ids, new_x = part["__q"].to_numpy(), part["__id"].to_numpy(), np.stack(part["__x"].to_numpy()).astype(np.float64)
                if marks[lo][:2] != group:
                    if ids is not None:
                        yield answer(at, best)
                    group, ids = marks[lo][:2], None
                if marks[lo][2] == 0:
                    at, ids, x = (new_at, new_ids, new_x) if ids is None else (np.concatenate((at, new_at)), np.concatenate((ids, new_ids)), np.concatenate((x, new_x)))
                    best = (np.full((len(ids), k), np.inf), np.full((len(ids), k), np.inf), np.full((len(ids), k), ids[0], dtype=ids.dtype))
                    continue
                if ids is None:
                    continue
                for lo2 in range(0, len(new_ids), 2048):
                    best = _closest(ids, x, best, new_ids[lo2:lo2 + 2048], new_x[lo2:lo2 + 2048], k)
        if ids is not None:
            yield answer(at, best)

    return run


def _cuts(x: np.ndarray, cells: int) -> list[tuple[int, float, int, int]]:
    """A tree of cuts (feature or -1, threshold, left, right; a leaf's left is its cell) through the medians of the widest features."""
    nodes: list[list] = [[-1, 0.0, 0, -1]]
    todo, leaves = [(0, np.arange(len(x)))], 1
    while todo and leaves < cells:
        todo.sort(key=lambda t: -len(t[1]))
        at, some = todo.pop(0)
        if len(some) < 2:
            break
        f = int(np.argmax(np.ptp(x[some], axis=0)))
        v = np.sort(x[some, f])
        cut = v[(len(v) - 1) // 2]
        if cut == v[-1]:
            below = v[v < cut]
            if not len(below):
                continue                # all alike
            cut = below[-1]
        goes_left = x[some, f] <= cut
        nodes[at] = [f, float(cut), len(nodes), len(nodes) + 1]
        todo += [(len(nodes), some[goes_left]), (len(nodes) + 1, some[~goes_left])]
        nodes += [[-1, 0.0, 0, -1], [-1, 0.0, 0, -1]]
        leaves += 1
    cell = 0
    for n in nodes:
        if n[0] < 0:
            n[2], cell = cell, cell + 1
    return [tuple(n) for n in nodes]


def knn_within(df: DataFrame, key: str, vec: str, k: int) -> DataFrame:
    """Exact k nearest neighbours (Euclidean, self excluded; ties by neighbour key) inside ``df``.

    Cells are boxes cut at medians. Every row first finds its k nearest in its own cell; the distance of
    the last bounds what other cells can offer, so it then asks only those whose box lies within that bound.
    Cells are answered on executors, QUERY_ROWS queries at a time with the candidates streamed past, so
    memory is bounded.
    """
    d = materialize(df.select(F.monotonically_increasing_id().alias("__q"), col(key).alias("__id"), F.col(vec).cast("array<double>").alias("__x")), "knn-rows")
    id_type = d.schema["__id"].dataType
    schema = T.StructType([T.StructField("__id", id_type), T.StructField("nn_id", id_type), T.StructField("dist", T.DoubleType()), T.StructField("nn_rank", T.LongType())])
    found = T.ArrayType(T.StructType([T.StructField("r", T.DoubleType()), T.StructField("nn_id", id_type), T.StructField("dist", T.DoubleType())]))
    answers = T.StructType([T.StructField("__q", T.LongType()), T.StructField("found", found)])
    m = min(CELLS, math.ceil(d.count() / CELL_ROWS))
    if not m:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("__id", key)
    some = np.array([r["__x"] for r in d.orderBy(F.xxhash64("__id"), "__id").limit(m * SAMPLE).collect()], dtype=np.float64)
    nodes = _cuts(some, m)
    m = sum(n[0] < 0 for n in nodes)

    @F.pandas_udf("int")
    def place(xs: pd.Series) -> pd.Series:
        x = np.stack(xs.to_numpy()).astype(np.float64)
        cell, todo = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            f, cut, left, right = nodes[at]
            if f < 0:
                cell[rows] = left
            elif len(rows):
                goes_left = x[rows, f] <= cut
                todo += [(left, rows[goes_left]), (right, rows[~goes_left])]
        return pd.Series(cell)

    placed = materialize(d.withColumn("cell", place("__x")), "knn-cells")
    dims = range(some.shape[1])
    sizes, low, high = [0] * m, np.full((len(nodes), len(dims)), np.inf), np.full((len(nodes), len(dims)), -np.inf)
    leaf = {n[2]: i for i, n in enumerate(nodes) if n[0] < 0}
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.min(F.col("__x")[i]) for i in dims]).alias("low"), F.array(*[F.max(F.col("__x")[i]) for i in dims]).alias("high")).collect():
        sizes[r["cell"]], low[leaf[r["cell"]]], high[leaf[r["cell"]]] = r["n"], r["low"], r["high"]
    for i in range(len(nodes) - 1, -1, -1):         # children come after their parent
        if nodes[i][0] >= 0:
            low[i], high[i] = np.minimum(*low[[*nodes[i][2:]]]), np.maximum(*high[[*nodes[i][2:]]])

    @F.pandas_udf("array<int>")
    def asks(xs: pd.Series, cell: pd.Series, bound: pd.Series) -> pd.Series:
        x, own = np.stack(xs.to_numpy()).astype(np.float64), cell.to_numpy()
        reach = bound.to_numpy(np.float64, na_value=np.inf)
        reach = reach + 1e-6 * (1 + np.where(np.isfinite(reach), reach, 0))
        out: list[list[int]] = [[] for _ in range(len(x))]
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            gap = np.maximum(np.maximum(low[at] - x[rows], x[rows] - high[at]), 0)
            rows = rows[(np.sqrt((gap * gap).sum(axis=1)) <= reach[rows]) & bool(np.isfinite(low[at]).all())]
            f, _, left, right = nodes[at]
            if not len(rows):
                continue
            if f >= 0:
                todo += [(left, rows), (right, rows)]
            else:
                for i in rows[own[rows] != left].tolist():
                    out[i].append(left)
        return pd.Series([np.array(o, np.int32) for o in out], dtype=object)

    def answered(queries: DataFrame, asked: list[int]) -> DataFrame:
        """``queries`` (cell, __q, __id, __x) against all rows of their cells, ``asked``: queries by cell."""
        in_cell = F.element_at(F.array(*[F.lit(math.ceil(c / QUERY_ROWS)) for c in asked]), F.col("cell") + 1)
        mine = queries.select("cell", F.pmod(F.xxhash64("__q"), in_cell).cast("int").alias("chunk"), F.lit(0).alias("kind"), "__q", "__id", "__x")
        held = placed.filter(in_cell > 0).select("cell", F.explode(F.sequence(F.lit(0), in_cell - 1)).alias("chunk"), F.lit(1).alias("kind"), "__q", "__id", "__x")
        rows = mine.unionByName(held).repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", "kind")
        return rows.mapInPandas(_nearest(k), answers)

    own = materialize(answered(placed, sizes), "knn-own")
    if m > 1:
        bound = F.when(F.size("found") >= k, F.element_at("found", -1)["r"])
        reached = placed.join(own.select("__q", bound.alias("bound")), "__q")
        sent = materialize(reached.select("__q", "__id", "__x", F.explode(asks("__x", "cell", "bound")).alias("cell")), "knn-asked")
        asked = [0] * m
        for r in sent.groupBy("cell").count().collect():
            asked[r["cell"]] = r["count"]
        every = own.unionByName(answered(sent, asked)).groupBy("__q").agg(F.flatten(F.collect_list("found")).alias("found"))
        own = every.select("__q", F.slice(F.sort_array("found"), 1, k).alias("found"))
    pairs = own.select("__q", F.posexplode("found").alias("pos", "nn")).join(placed.select("__q", "__id"), "__q")
    return pairs.select("__id", "nn.nn_id", "nn.dist", (F.col("pos") + 1).cast("long").alias("nn_rank")).withColumnRenamed("__id", key)


def smote(df: DataFrame, label: str, key: str, vec: str, ratio: float = 0.38, minority_label: int = 1,
          max_k: int = 5) -> tuple[DataFrame, dict]:
    """Synthesize floor(ratio·n_maj − n_min) minority rows: x + u·(nn − x), nn among k nearest.

    Synthetic row i uses base = minority row i mod n_min (in md5(key) order), neighbour
    rank 1 + floor(u₁·k), gap u₂ — hash-uniform draws on i.  Returns (synthetic rows, info).
    """
    cnt = df.agg(F.count_if(col(label) == minority_label).alias("mn"), F.count_if(col(label) != minority_label).alias("mj")).first()
    n_min, n_maj = int(cnt["mn"]), int(cnt["mj"])
    n_new = int(math.floor(ratio * n_maj - n_min))
    info = {"n_min": n_min, "n_maj": n_maj, "n_new": max(n_new, 0), "k": min(max_k, n_min - 1)}
    spark = df.sparkSession
    if n_min < 6 or n_new <= 0:
        info["skipped"] = True
        empty = df.filter(F.lit(False)).select(F.lit(0).cast("long").alias("syn_id"), col(key).alias("base_id"),
                                                 col(key).alias("nn_id"), F.lit(0.0).alias("gap"), F.col(vec).cast("array<double>").alias(vec))
        return empty, info
    k = info["k"]
    mino = df.filter(col(label) == minority_label)
    ranked = two_level_rank(mino, [], md5_key(key), col(key), out="base_no")
    nn = knn_within(mino, key, vec, k)
    ids = spark.range(n_new).withColumnRenamed("id", "syn_id")
    ids = ids.withColumns({
        "base_no": (F.col("syn_id") % n_min) + 1,
        "nn_rank": (F.floor(hash_uniform("syn_id", "nn") * k) + 1).cast("int"),
        "gap": hash_uniform("syn_id", "gap"),
    })
    base = ranked.select("base_no", col(key).alias("base_id"), F.col(vec).cast("array<double>").alias("__bx"))
    j = ids.join(base, "base_no").join(nn.select(col(key).alias("base_id"), "nn_rank", "nn_id"), ["base_id", "nn_rank"])
    nxt = mino.select(col(key).alias("nn_id"), F.col(vec).cast("array<double>").alias("__nx"))
    j = j.join(nxt, "nn_id")
    syn = F.zip_with("__bx", "__nx", lambda a, b: a + F.col("gap") * (b - a))
    return j.select("syn_id", "base_id", "nn_id", "gap", syn.alias(vec)), info


__all__ = ["two_level_rank", "stratified_sample", "stratified_split", "class_weights", "with_class_weight",
           "preview_sample", "explanation_sample", "knn_within", "smote", "md5_key", "md5_chunk_uniform"]
