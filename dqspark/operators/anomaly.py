"""Outlier scores on distinct points: isolation forest, local outlier factor, nearest-neighbour imputation, evaluation.

A score depends on a point only, so points are made distinct, scored, and joined back. The forest's trees grow from a
bounded sample of rows and are broadcast. The outlier factor is exact at any number of points: they are dealt to the leaves
of a tree of cuts, each leaf finds neighbours among its own, and a point whose neighbours reach over its leaf's edge visits
the leaves that its reach meets.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .features import scale
from .order import quantile, running, settled

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

#: Points of a leaf, and those of the sample from which the cuts are taken (they balance leaves, no result rests on them).
LEAF, CUTS = 4_000, 20_000
#: What outliers are injected into.
MEASURES = ["Quantity", "UnitPrice"]


def points(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*(F.col(c).cast("double").alias(c) for c in columns)).dropna().groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def neighbours(x: np.ndarray, ref: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances and places of the k nearest of ref that aren't the point itself; ties by the order of ref."""
    d = sum((x[:, [c]] - ref[:, c]) ** 2 for c in range(x.shape[1]))
    row, at = np.nonzero(d == 0)  # underflow makes other points of these too
    same = (x[row] == ref[at]).all(axis=1)
    d[row[same], at[same]] = np.inf
    reach = np.partition(d, k - 1, axis=1)[:, [k - 1]]
    row, at = np.nonzero(d <= reach)  # k of a row, and all as near as the last
    near = d[row, at]
    order = np.lexsort((at, near, row))
    first = np.searchsorted(row, np.arange(len(x)))
    held = order[first[:, None] + np.arange(k)]
    return near[held], at[held]


def _cuts(x: np.ndarray, leaves: int) -> tuple | None:
    """Nested (column, value, less, more); a leaf is None."""
    if leaves <= 1 or not len(x) or not (spread := x.max(axis=0) - x.min(axis=0)).any():
        return None
    c = int(spread.argmax())
    at = float(np.median(x[:, c]))
    if at == x[:, c].min():  # all below the median are alike
        at = float(x[x[:, c] > at, c].min())
    left = x[:, c] < at
    return c, at, _cuts(x[left], leaves // 2), _cuts(x[~left], leaves - leaves // 2)


def _boxes(tree: tuple | None, low: np.ndarray, high: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each leaf's bounds, in order."""
    if tree is None:
        return [(low, high)]
    c, at, less, more = tree
    below, above = high.copy(), low.copy()
    below[c] = above[c] = at
    return _boxes(less, low, below) + _boxes(more, above, high)


def _leaf_of(tree: tuple | None, x: np.ndarray) -> np.ndarray:
    if tree is None:
        return np.zeros(len(x), np.int64)
    c, at, less, more = tree
    left, out = x[:, c] < at, np.zeros(len(x), np.int64)
    out[left] = _leaf_of(less, x[left])
    out[~left] = _leaf_of(more, x[~left]) + _size(less)
    return out


def _size(tree: tuple | None) -> int:
    return 1 if tree is None else _size(tree[2]) + _size(tree[3])


POINT = pa.list_(pa.float64())
NEAR = pa.list_(pa.struct([("d2", pa.float64()), ("q", POINT)]))


def _lists(x: np.ndarray) -> pa.Array:
    """Rows of x as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), pa.float64()))


def _coordinates(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Lists of dims numbers as rows, ordered by their coordinates."""
    flat = pa.chunked_array([column]) if isinstance(column, pa.Array) else column
    x = np.concatenate([np.zeros(0), *(c.flatten().to_numpy(zero_copy_only=False) for c in flat.chunks)]).reshape(-1, dims)
    return x[np.lexsort(x.T[::-1])]


def _found(x: np.ndarray, ref: np.ndarray, k: int) -> pa.Array:
    """For each point up to k nearest of ref (itself not counted), as (squared distance, coordinates)."""
    sizes, ds, qs = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros((0, x.shape[1]))]
    step = max(1, (1 << 21) // max(1, len(ref)))
    for i in range(0, len(x), step):
        if not len(ref):
            sizes.append(np.zeros(len(x[i : i + step]), np.int64))
            continue
        d, at = neighbours(x[i : i + step], ref, min(k, len(ref)))
        real = np.isfinite(d)
        sizes.append(real.sum(axis=1))
        ds.append(d[real])
        qs.append(ref[at[real]])
    ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    near = pa.StructArray.from_arrays([pa.array(np.concatenate(ds), pa.float64()), _lists(np.concatenate(qs))], fields=list(NEAR.value_type))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), near, type=NEAR)


def _met(x: np.ndarray, reach: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of a point, leaf) for the leaves whose bounds a point's reach meets."""
    found = []
    step = max(1, (1 << 20) // len(low))
    for i in range(0, len(x), step):
        own = x[i : i + step]
        gap = sum(np.maximum(0, np.maximum(low[:, c] - own[:, [c]], own[:, [c]] - high[:, c])) ** 2 for c in range(x.shape[1]))
        row, leaf = np.nonzero(gap <= reach[i : i + step, None])
        found.append((row + i, leaf))
    none = [np.zeros(0, np.int64)]
    return np.concatenate(none + [f[0] for f in found]), np.concatenate(none + [f[1] for f in found])


def nearest(pts: DataFrame, columns: list[str], k: int) -> DataFrame:
    """(p, near): each distinct point and its k nearest others in order; ties by their coordinates."""
    n, dims = pts.count(), len(columns)
    sample = pts.orderBy(F.xxhash64(*columns), *columns).limit(CUTS).select(*columns).collect()
    tree = _cuts(np.array([tuple(r) for r in sample], float).reshape(-1, dims), -(-n // LEAF))
    boxes = _boxes(tree, np.full(dims, -np.inf), np.full(dims, np.inf))
    held = pts.sparkSession.sparkContext.broadcast((tree, np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes])))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(dims)]).astype(float)
            yield pa.RecordBatch.from_arrays([pa.array(_leaf_of(held.value[0], x), pa.int64()), _lists(x)], names=["leaf", "p"])

    def inside(key, own):  # no hints: Spark would want all
        x = _coordinates(own.column("p"), dims)
        return pa.table({"leaf": pa.array(np.full(len(x), key[0].as_py()), pa.int64()), "p": _lists(x), "near": _found(x, x, k)})

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf, near = b.column("leaf").to_numpy(), b.column("near")
            x = b.column("p").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            ends, d2 = np.cumsum(near.value_lengths().to_numpy(zero_copy_only=False)), near.flatten().field("d2").to_numpy(zero_copy_only=False)
            full = np.diff(ends, prepend=0) == k
            reach = np.full(len(x), np.inf)
            reach[full] = d2[ends[full] - 1]
            row, met = _met(x, reach, *held.value[1:])
            other = met != leaf[row]
            yield pa.RecordBatch.from_arrays([pa.array(met[other], pa.int64()), _lists(x[row[other]])], names=["leaf", "p"])

    def visited(own, guests):
        ref, x = (_coordinates(f.column("p"), dims) for f in (own, guests))
        return pa.table({"p": _lists(x), "near": _found(x, ref, k)})

    near_type = "near array<struct<d2: double, q: array<double>>>"
    dealt = settled(pts.select(*columns).mapInArrow(deal, "leaf long, p array<double>"))
    own = settled(dealt.groupBy("leaf").applyInArrow(inside, f"leaf long, p array<double>, {near_type}"))
    if len(boxes) == 1:
        return own.select("p", "near")
    guests = own.mapInArrow(visits, "leaf long, p array<double>")
    more = dealt.groupBy("leaf").cogroup(guests.groupBy("leaf")).applyInArrow(visited, f"p array<double>, {near_type}")
    both = own.select("p", "near").unionByName(more).groupBy("p").agg(F.collect_list("near").alias("all"))
    return both.select("p", F.slice(F.array_sort(F.flatten("all")), 1, k).alias("near"))


def lof(df: DataFrame, columns: list[str], k: int = 20) -> DataFrame:
    """(columns, n, lof) for each distinct point."""
    pts = settled(points(df, columns))
    total = pts.count()
    if total < 2:
        return pts.withColumn("lof", F.lit(1.0))
    k = max(1, min(k, total - 1))
    near = settled(nearest(pts, columns, k))
    each = near.select("p", F.explode("near").alias("x")).select("p", F.col("x.q").alias("q"), F.sqrt("x.d2").alias("d"))
    far = near.select(F.col("p").alias("q"), F.sqrt(F.element_at("near", -1)["d2"]).alias("far"))
    density = settled(each.join(far, "q").groupBy("p").agg((1 / F.greatest(F.lit(1e-10), F.avg(F.greatest("d", "far")))).alias("density")))
    around = each.join(density.withColumnsRenamed({"p": "q", "density": "theirs"}), "q").groupBy("p").agg(F.avg("theirs").alias("theirs"))
    scored = around.join(density, "p").select("p", (F.col("theirs") / F.col("density")).alias("lof"))
    named = scored.select(*(F.col("p")[i].alias(c) for i, c in enumerate(columns)), "lof")
    return pts.join(named, columns)


def _tree(x: np.ndarray, rng: np.random.Generator, depth: int, limit: int) -> tuple:
    n = len(x)
    spread = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if n else []
    if depth >= limit or n <= 1 or not len(spread):
        return (n,)
    f = int(rng.choice(spread))
    at = rng.uniform(x[:, f].min(), x[:, f].max())
    left = x[:, f] < at
    return (f, at, _tree(x[left], rng, depth + 1, limit), _tree(x[~left], rng, depth + 1, limit))


def _expected(n: np.ndarray | float) -> np.ndarray:
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _depth(tree: tuple, x: np.ndarray, rows: np.ndarray, depth: int, out: np.ndarray) -> None:
    if not len(rows):
        return
    if len(tree) == 1:
        out[rows] += depth + _expected(tree[0])
        return
    left = x[rows, tree[0]] < tree[1]
    _depth(tree[2], x, rows[left], depth + 1, out)
    _depth(tree[3], x, rows[~left], depth + 1, out)


def isolation_forest(df: DataFrame, columns: list[str], trees: int = 200, subsample: int = 256, seed: int = 42) -> DataFrame:
    """(columns, n, score): 0 to 1, higher for points that random splits set apart sooner (Liu et al. 2008). Trees grow on
    the driver from a hash sample of rows; only they are broadcast."""
    pts = points(df, columns)
    rows = df.select(*(F.col(c).cast("double") for c in columns)).dropna().orderBy(F.xxhash64(*columns, *(["row_id"] if "row_id" in df.columns else []), F.lit(seed))).limit(20 * subsample).collect()
    x, rng = np.array([tuple(r) for r in rows], float).reshape(-1, len(columns)), np.random.default_rng(seed)
    size = min(subsample, len(x))
    limit = int(np.ceil(np.log2(max(size, 2))))
    held = df.sparkSession.sparkContext.broadcast([_tree(x[rng.choice(len(x), size, replace=False)], rng, 0, limit) for _ in range(trees)] if size else [])

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            own, total = pdf[columns].to_numpy(float), np.zeros(len(pdf))
            for tree in held.value:
                _depth(tree, own, np.arange(len(own)), 0, total)
            yield pdf.assign(score=2 ** (-total / max(1, len(held.value)) / max(1e-9, float(_expected(size)))))

    return pts.mapInPandas(score, ", ".join([*(f"`{c}` double" for c in columns), "n long, score double"]))


def flag_top(scored: DataFrame, column: str, contamination: float = 0.01) -> DataFrame:
    scored = settled(scored)
    return scored.withColumn("is_outlier", F.col(column) > F.lit(quantile(scored, column, 1 - contamination)))


def flag_points(df: DataFrame, columns: list[str], contamination: float = 0.01, trees: int = 200) -> DataFrame:
    """(columns, n, if_score, lof, is_if, is_lof) for each distinct point; the forest's cut is by rows, the factor's by points."""
    forest = settled(isolation_forest(df, columns, trees).withColumnRenamed("score", "if_score"))
    factor = settled(lof(df, columns).drop("n"))
    if_cut, lof_cut = quantile(forest, "if_score", 1 - contamination, "n"), quantile(factor, "lof", 1 - contamination)
    return forest.join(factor, columns).withColumns({"is_if": F.col("if_score") > F.lit(if_cut), "is_lof": F.col("lof") > F.lit(lof_cut)})


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a gap in the columns, which have mean 0 and deviation 1."""
    return settled(scale(df.dropna(subset=columns), columns).drop(*columns).withColumnsRenamed({f"{c}_scaled": c for c in columns}))


def _own(df: DataFrame, columns: list[str]) -> DataFrame:
    return settled(df.select(*(["row_id"] if "row_id" in df.columns else []), *columns))


def severity(df: DataFrame, columns: list[str], contamination: float = 0.01, trees: int = 200) -> DataFrame:
    """One row: n_rows, rows that each model and both flag, and anomaly_severity (0 to 100, the share that both flag)."""
    df = _own(df, columns)
    flagged = flag_points(standardised(df, columns), columns, contamination, trees)
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    one = flagged.agg(n(F.col("is_if")).alias("n_if"), n(F.col("is_lof")).alias("n_lof"), n(F.col("is_if") & F.col("is_lof")).alias("n_both"))
    rows = F.lit(df.count())
    return one.select(rows.alias("n_rows"), "*", F.coalesce(F.round(F.try_divide(100.0 * F.col("n_both"), rows), 4), F.lit(0.0)).alias("anomaly_severity"))


def evaluate(df: DataFrame, columns: list[str], contamination: float = 0.01, trees: int = 200) -> DataFrame:
    """(model, tp, fp, fn, tn, precision, recall, f1, auc, precision_at_k) on rows with injected outliers: each model, rows
    that either or both flag (scored by the mean of the percent ranks). K is the number of injected rows; rows tied at the
    K-th place count by their share."""
    rows = standardised(settled(inject(_own(df, MEASURES))), columns)
    flagged = settled(combined_rank(settled(flag_points(rows, columns, contamination, trees)), "if_score", "lof", "n"))
    scored = rows.select("label", *columns).join(flagged.drop("n"), columns)
    models = {"isolation_forest": ("if_score", F.col("is_if")), "lof": ("lof", F.col("is_lof")), "either": ("combined", F.col("is_if") | F.col("is_lof")), "both": ("combined", F.col("is_if") & F.col("is_lof"))}
    each = scored.select("label", F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(s).alias("score"), f.alias("flag")) for m, (s, f) in models.items()))).alias("x")).select("label", "x.*")
    hit = F.col("label") == 1
    by = settled(each.groupBy("model", "score").agg(F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg"), F.count_if(hit & F.col("flag")).alias("tp"), F.count_if(~hit & F.col("flag")).alias("fp")))
    totals = F.broadcast(by.groupBy("model").agg(F.sum("pos").alias("k"), F.sum("neg").alias("all_neg")))  # four rows
    ranked = running(by, "score", ["pos", "neg"], ["model"]).join(totals, "model")
    ranked = ranked.withColumns({"pos_above": F.col("k") - F.col("pos_below") - F.col("pos"), "neg_above": F.col("all_neg") - F.col("neg_below") - F.col("neg")})
    room = F.greatest(F.lit(0), F.col("k") - F.col("pos_above") - F.col("neg_above"))
    ranked = ranked.withColumns({"wins": F.col("neg") * (F.col("pos_above") + 0.5 * F.col("pos")), "top": F.col("pos") * F.least(F.lit(1.0), room / (F.col("pos") + F.col("neg")))})
    one = ranked.groupBy("model").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), (F.sum("pos") - F.sum("tp")).alias("fn"), (F.sum("neg") - F.sum("fp")).alias("tn"), F.sum("wins").alias("wins"), F.sum("top").alias("top"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(1.0 * a, b), F.lit(0.0)), 4)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return one.select("model", "tp", "fp", "fn", "tn", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"), share(F.col("wins"), (tp + fn) * (fp + tn)).alias("auc"), share(F.col("top"), tp + fn).alias("precision_at_k"))


def recall_by_model(df: DataFrame, columns: list[str], contamination: float = 0.01, trees: int = 200) -> DataFrame:
    """(model, anomaly_type, n, recall) on injected rows, at the models' own cuts."""
    rows = standardised(settled(inject(_own(df, MEASURES))), columns)
    flagged = flag_points(rows, columns, contamination, trees)
    hits = rows.filter("label = 1").select("anomaly_type", *columns).join(flagged, columns)
    models = {"isolation_forest": F.col("is_if"), "lof": F.col("is_lof"), "either": F.col("is_if") | F.col("is_lof"), "both": F.col("is_if") & F.col("is_lof")}
    each = hits.select("anomaly_type", F.explode(F.array(*(F.struct(F.lit(m).alias("model"), x.alias("hit")) for m, x in models.items()))).alias("x")).select("anomaly_type", "x.*")
    return each.groupBy("model", "anomaly_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("hit").cast("double")), 4).alias("recall"))


def combined_rank(scored: DataFrame, a: str, b: str, weight: str | None = None) -> DataFrame:
    """scored with the mean of both scores' percent ranks; a row counts ``weight`` times, alike rows share a mean rank."""
    out = scored.withColumn("_n", F.col(weight) if weight else F.lit(1))
    total = out.agg(F.sum("_n")).head()[0] or 1
    parts = []
    for i, c in enumerate((a, b)):
        out = running(out, c, ["_n"]).withColumn(f"_r{i}", (F.col("_n_below") + (F.col("_n_same") + 1) / 2) / F.lit(total)).drop("_n_below", "_n_same")
        parts.append(F.col(f"_r{i}"))
    return out.withColumn("combined", (parts[0] + parts[1]) / 2).drop("_n", "_r0", "_r1")


def top_union(scored: DataFrame, a: str, b: str, keys: list[str], k: int = 10) -> DataFrame:
    """The top k of either score, by their sum, and which score they come from."""
    top = lambda c: scored.orderBy(F.desc(c), *keys).limit(k).select(*keys, F.lit(True).alias(f"top_{c}"))
    found = scored.join(top(a), keys, "left").join(top(b), keys, "left").filter(f"top_{a} or top_{b}")
    source = F.when(F.col(f"top_{a}") & F.col(f"top_{b}"), "both").when(F.col(f"top_{a}"), a).otherwise(b)
    return found.select(*keys, a, b, source.alias("source"))


def _fills(df: DataFrame, known: str, wanted: str, k: int) -> DataFrame:
    """(known, fill) for each value of known beside which wanted is missing. Rows that have both are donors. Those with the
    same value win, all of them; else the k nearest donor rows, and all as near as the last, weigh by inverse distance.

    Values without their like among donors are found by ranges: each range's k outermost donor values go to the others
    through the driver, so that neighbours beyond a range's edge are known in it."""
    donors = df.filter(F.col(known).isNotNull() & F.col(wanted).isNotNull()).groupBy(F.col(known).alias("v")).agg(F.count(F.lit(1)).alias("n"), F.sum(wanted).alias("s")).cache()
    asked = df.filter(F.col(known).isNotNull() & F.col(wanted).isNull()).select(F.col(known).alias("v")).distinct().cache()
    same = asked.join(donors, "v").select(F.col("v").alias(known), (F.col("s") / F.col("n")).alias("fill"))
    rest = asked.join(donors, "v", "left_anti").cache()
    total = donors.count()
    if not total or rest.isEmpty():
        return same
    parts = -(-total // 50_000)
    edges = sorted(set(donors.approxQuantile("v", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    at = (F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)), lambda e: e <= F.col("v"))) if edges else F.lit(0)).alias("bin")
    binned, lost = donors.select("v", "n", "s", at), rest.select("v", at)
    first, last = (F.row_number().over(W.partitionBy("bin").orderBy(o)) for o in ("v", F.desc("v")))
    outer = sorted(tuple(r) for r in binned.withColumns({"i": first, "j": last}).filter((F.col("i") <= k) | (F.col("j") <= k)).select("v", "n", "s", "bin").collect())
    held = df.sparkSession.sparkContext.broadcast(np.array(outer, float).reshape(-1, 4))

    def fill(key, own: pd.DataFrame, lost: pd.DataFrame) -> pd.DataFrame:
        beyond = held.value[held.value[:, 3] != key[0], :3]
        x = np.concatenate([own[["v", "n", "s"]].to_numpy(float), beyond])
        x, out = x[np.argsort(x[:, 0])], []
        for v in lost["v"].to_numpy(float):
            i = int(np.searchsorted(x[:, 0], v))
            near = x[max(0, i - k) : i + k]
            d = np.abs(near[:, 0] - v)
            order = np.argsort(d, kind="stable")
            enough = np.cumsum(near[order, 1]) >= k
            reach = d[order][enough.argmax()] if enough.any() else d.max()
            w = np.where(d <= reach, 1 / d, 0.0)
            out.append(float((near[:, 2] * w).sum() / (near[:, 1] * w).sum()))
        return pd.DataFrame({known: lost["v"].to_numpy(float), "fill": out})

    return same.unionByName(binned.groupBy("bin").cogroup(lost.groupBy("bin")).applyInPandas(fill, f"`{known}` double, fill double"))


def knn_impute(df: DataFrame, a: str = "Quantity", b: str = "UnitPrice", k: int = 5) -> DataFrame:
    """Gaps of either measure from the k donor rows nearest by the other, weighted by inverse distance (equal ones win); rows
    that lack both, and all gaps if there is no donor, get the medians. a is rounded to whole numbers."""
    own = df.withColumns({a: F.col(a).cast("double"), b: F.col(b).cast("double")}).cache()
    medians = {c: quantile(own, c, 0.5) for c in (a, b)}
    fills = {a: _fills(own, b, a, k).withColumnsRenamed({b: "_at_b", "fill": "_fill_a"}), b: _fills(own, a, b, k).withColumnsRenamed({a: "_at_a", "fill": "_fill_b"})}
    out = own.join(fills[a], F.col(b) == F.col("_at_b"), "left").join(fills[b], F.col(a) == F.col("_at_a"), "left")
    new_a = F.coalesce(F.col(a), F.round("_fill_a"), F.lit(medians[a]).cast("double"))
    new_b = F.coalesce(F.col(b), F.col("_fill_b"), F.lit(medians[b]).cast("double"))
    return out.withColumns({a: new_a, b: new_b}).select(*df.columns)


def hidden(share: int, salt: int) -> Column:
    """Which rows hide a cell: about one of ``share``, by arithmetic on row_id."""
    return F.pmod((F.col("row_id") * 1103515245 + salt) % 2147483648, F.lit(share)) == 0


def knn_verify(df: DataFrame, share: int = 20, k: int = 5) -> DataFrame:
    """One row: about one of ``share`` cells of either measure is hidden and filled; n, mean absolute error, exact fills."""
    salts = {"Quantity": 12345, "UnitPrice": 54321}
    true = df.withColumns({f"_true_{c}": F.col(c).cast("double") for c in salts})
    masked = true.withColumns({c: F.when(~hidden(share, s), F.col(c)) for c, s in salts.items()})
    filled = knn_impute(masked, k=k)
    cells = F.array(*(F.when(hidden(share, s) & F.col(f"_true_{c}").isNotNull(), F.abs(F.col(c) - F.col(f"_true_{c}"))) for c, s in salts.items()))
    e = filled.select(F.explode(F.array_compact(cells)).alias("e"))
    return e.agg(F.count(F.lit(1)).alias("n_masked"), F.round(F.avg("e"), 4).alias("mae"), F.round(F.avg((F.col("e") < 0.005).cast("double")), 4).alias("exact_match"))


def inject(df: DataFrame, n: int = 25) -> DataFrame:
    """df (row_id, Quantity, UnitPrice) with 4n labelled rows, made from base rows by arithmetic on row_id."""
    r = (F.col("row_id") * 1103515245 + 12345) % 2147483648
    base = df.select("row_id", r.alias("_r")).orderBy("_r", "row_id").limit(4 * n)
    numbered = base.withColumn("_i", F.row_number().over(W.orderBy("_r", "row_id")) - 1)  # 4n rows
    kind = F.element_at(F.array(*(F.lit(x) for x in ("extreme_price", "extreme_quantity", "extreme_return", "odd_combo"))), (F.col("_i") % 4 + 1).cast("int"))
    u = F.col("_r") / F.lit(2147483648.0)
    q = F.expr("case _i % 4 when 0 then 1 + floor(12 * u) when 1 then 15000 + floor(45000 * u) when 2 then -60000 + floor(45000 * u) else 300 + floor(600 * u) end")
    p = F.expr("case _i % 4 when 0 then 25000 + 35000 * u when 3 then 2000 + 7000 * u else 1 + 9 * u end")
    made = numbered.withColumn("u", u).select((F.col("row_id") + 1_000_000_000).alias("row_id"), q.cast("double").alias("Quantity"), F.round(p, 2).cast("double").alias("UnitPrice"), kind.alias("anomaly_type"), F.lit(1).alias("label"))
    own = df.select("row_id", F.col("Quantity").cast("double").alias("Quantity"), F.col("UnitPrice").cast("double").alias("UnitPrice"), F.lit(None).cast("string").alias("anomaly_type"), F.lit(0).alias("label"))
    return own.unionByName(made).withColumn("LineValue", F.round(F.col("Quantity") * F.col("UnitPrice"), 2) + F.lit(0.0))


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    y, z = F.col(label) == 1, F.col(predicted) == 1
    one = df.agg(F.count_if(y & z).alias("tp"), F.count_if(~y & z).alias("fp"), F.count_if(y & ~z).alias("fn"), F.count_if(~y & ~z).alias("tn"))
    div = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 4)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return one.select("*", div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"), div(2 * tp, 2 * tp + fp + fn).alias("f1"))


def by_score(df: DataFrame, label: str, score: str) -> DataFrame:
    """(score, pos, neg): labels summed for each distinct score, which ranks are then taken over."""
    return df.groupBy(F.col(score).cast("double").alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Exact area: chances that a positive outranks a negative, ties half."""
    each = running(by_score(df, label, score).cache(), "score", ["neg"])
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))
    return each.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.round(F.try_divide(wins.cast("double"), (F.sum("pos") * F.sum("neg")).cast("double")), 6).alias("auc"))


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    each = by_score(df, label, score).cache()
    total = each.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).head()
    rate = lambda c: F.round(F.coalesce(F.try_divide(F.lit(float(total[c] or 0)) - F.col(f"{c}_below"), F.lit(float(total[c] or 0))), F.lit(0.0)), 6)
    return running(each, "score", ["pos", "neg"]).select(F.col("score").alias("threshold"), rate("neg").alias("fpr"), rate("pos").alias("tpr"))


def precision_at_k(df: DataFrame, label: str, score: str, key: str) -> DataFrame:
    """K is the number of positives; ties by key. Whole scores are counted, and only the rows of the one score at which K is
    reached are put in order."""
    each = by_score(df, label, score).withColumn("n", F.col("pos") + F.col("neg")).cache()
    total = each.agg(F.sum("n").alias("n"), F.sum("pos").alias("k")).head()
    k, above = total.k or 0, F.lit(total.n or 0) - F.col("n_below") - F.col("n_same")
    ranked = running(each, "score", ["n"]).withColumn("above", above).filter(F.col("above") < k).cache()
    whole = ranked.filter(F.col("above") + F.col("n") <= k).agg(F.sum("pos")).head()[0] or 0
    cut = ranked.filter(F.col("above") + F.col("n") > k).head()
    part = 0 if cut is None else df.filter(F.col(score) == cut.score).orderBy(key).limit(k - cut.above).agg(F.count_if(F.col(label) == 1)).head()[0]
    return df.sparkSession.createDataFrame([(k, round((whole + part) / k, 4) if k else 0.0)], "k long, precision_at_k double")


def recall_by_type(df: DataFrame, kind: str, predicted: str) -> DataFrame:
    return df.filter(F.col(kind).isNotNull()).groupBy(F.col(kind).alias("anomaly_type")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col(predicted) == 1).cast("double")), 4).alias("recall"))
