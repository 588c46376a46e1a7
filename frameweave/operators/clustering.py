"""Clustering of vectors: k-means in its variants, distances, pooling, PCA, soft-DTW."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, MinMaxScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameweave.functions.binding import let
from frameweave.functions.hashing import u
from frameweave.functions.vectors import DISTANCES, Distance, cosine, doubles, minmax, squared, unit
from frameweave.plans.ordering import order_rows, top_rows
from frameweave.plans.staging import materialise, small_side

VECTORS = "array<array<double>>"


def distance_of(name: str | Distance) -> Distance:
    return DISTANCES[name] if isinstance(name, str) else name


# ---- distances, means, normalisation ----------------------------------------------------------


def centre_arrays(centres: DataFrame, keys: Sequence[str], label: str, vector: str) -> DataFrame:
    """Centres of each key as one ordered array; their number is the cluster count, not data size."""
    item = F.struct(F.col(label).alias("label"), doubles(vector).alias("c"))
    return centres.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_centres"))


def with_centres(points: DataFrame, centres: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every point beside the centre array of its key; without keys the array is one literal."""
    if keys:
        return points.join(small_side(centres), list(keys))
    return points.withColumn("_centres", literal_value(centres.select("_centres")))


def literal_value(one: DataFrame) -> Column:
    """The value of a one-row, one-column table as a literal of the same type.

    Only for values bounded by a parameter, such as the centres of one clustering.
    """
    kind = one.schema[0].dataType
    return F.from_json(F.lit(one.select(F.to_json(one.columns[0])).first()[0]), kind)


def distance_table(
    points: DataFrame, centres: DataFrame, x: str, keys: Sequence[str], distance: str | Distance, power: float = 1.0
) -> DataFrame:
    """Distance of every point to every centre of its key, one row per pair."""
    d = distance_of(distance)
    rows = with_centres(points, centres, keys)
    pairs = F.transform(
        "_centres",
        lambda s: F.struct(s["label"].alias("label"), F.pow(d(F.col(x), s["c"]), F.lit(power)).alias("distance")),
    )
    return rows.withColumn("_pairs", pairs).drop("_centres").select("*", F.inline("_pairs")).drop("_pairs")


def assign(
    points: DataFrame, centres: DataFrame, x: str, keys: Sequence[str], distance: str | Distance
) -> DataFrame:
    """Nearest centre per point (`label`, `distance`); the lowest label wins a tie."""
    d = distance_of(distance)
    rows = with_centres(points, centres, keys)
    best = F.array_min(
        F.transform("_centres", lambda s: F.struct(d(F.col(x), s["c"]).alias("d"), s["label"].alias("l")))
    )
    return (
        rows.withColumn("_best", best)
        .withColumns({"label": F.col("_best.l"), "distance": F.col("_best.d")})
        .drop("_best", "_centres")
    )


def mean_vectors(df: DataFrame, keys: Sequence[str], x: str, weight: str | None = None, out: str = "centre") -> DataFrame:
    """Weighted mean vector and total weight per key, combined on the map side."""
    vec = array_to_vector(doubles(x))
    if weight is None:
        mean, total = Summarizer.mean(vec), F.count(F.lit(1)).cast("double")
    else:
        mean, total = Summarizer.mean(vec, F.col(weight)), F.sum(weight)
    return df.groupBy(*keys).agg(mean.alias("_m"), total.alias("weight")).select(
        *keys, vector_to_array("_m").alias(out), "weight"
    )


def cluster_statistics(
    df: DataFrame, keys: Sequence[str], label: str, x: str, old: DataFrame | None = None
) -> DataFrame:
    """Mean, size and inertia per cluster; `shift` from the centres of `old` if given."""
    means = mean_vectors(df, [*keys, label], x)
    gaps = df.join(small_side(means), [*keys, label]).groupBy(*keys, label).agg(
        F.sum(squared(x, "centre")).alias("inertia")
    )
    out = means.join(gaps, [*keys, label])
    if old is not None:
        before = old.select(*keys, label, F.col("centre").alias("_old"))
        out = out.join(before, [*keys, label]).withColumn("shift", F.sqrt(squared("centre", "_old"))).drop("_old")
    return out


def normalise(df: DataFrame, x: str, how: str, keys: Sequence[str] = ()) -> DataFrame:
    """`mean`: subtract the mean of the key; `minmax`: scale each row; `unit`: length 1."""
    if how == "minmax":
        return df.withColumn(x, minmax(x))
    if how == "unit":
        return df.withColumn(x, unit(x))
    if how != "mean":
        raise ValueError(f"unknown normalisation {how!r}")
    means = mean_vectors(df, keys, x, out="_mean").drop("weight")
    if keys:
        joined = df.join(small_side(means), list(keys))
    else:
        joined = df.withColumn("_mean", literal_value(means.select("_mean")))
    return joined.withColumn(x, F.zip_with(doubles(x), "_mean", lambda a, b: a - b)).drop("_mean")


# ---- k-means ----------------------------------------------------------------------------------


@dataclass
class Clustering:
    """`centres`: instance, label, centre. `labels`: instance, point, label, distance.
    `inertia`: instance, run, inertia of the kept run. `iterations` done."""

    centres: DataFrame
    labels: DataFrame
    inertia: DataFrame
    iterations: int


def kmeans(
    points: DataFrame,
    instance: str,
    point: str,
    x: str,
    k: int,
    weight: str | None = None,
    distance: str | Distance = "l2",
    init: str = "rnd",
    runs: int = 1,
    max_iter: int = 10,
    tol: float = 1e-4,
    seed: int = 42,
    scale: str | None = None,
    start: DataFrame | None = None,
) -> Clustering:
    """Lloyd's k-means for many instances at once, of any size, as joins and aggregations.

    Every iteration assigns points to the centre array of their (instance, run) and takes weighted
    means with map-side combining, so one huge instance is spread over all tasks. Centres are the
    only state carried from round to round; they are written out, which cuts the lineage. An
    instance with no more than `k` points keeps them all as centres. `start` (instance, vector)
    resumes from given centres, each moved to its nearest point. The run of least inertia is kept.
    `init="k-means++"` goes through the points once per centre; "k-means||" a fixed number of
    times, for many clusters or points.
    """
    if k < 1 or runs < 1 or max_iter < 1:
        raise ValueError("k, runs and max_iter must be positive")
    if init not in ("rnd", "k-means++", "k-means||"):
        raise ValueError(f"unknown init method {init!r}")
    d = distance_of(distance)
    base = points.select(
        F.col(instance).alias("instance"),
        F.col(point).alias("point"),
        doubles(x).alias("x"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
    )
    if scale:
        base = normalise(base, "x", scale, ["instance"])
    base = materialise(base)
    spread = base.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))

    if start is not None:
        given = start.select(F.col(instance).alias("instance"), doubles("vector").alias("g"))
        given = order_rows(given, ["instance"], ["g"], seq="label").df
        near = base.join(small_side(given), "instance")
        near = near.groupBy("instance", "label").agg(F.min_by("x", F.struct(d(F.col("x"), F.col("g")), "point")).alias("centre"))
        centres = near.withColumn("run", F.lit(1))
        spread, runs = base.withColumn("run", F.lit(1)), 1
    elif init == "rnd":
        centres = top_rows(
            spread.withColumn("_u", u(seed, "run", "instance", "point")), ["instance", "run"], ["_u", "point"], k
        ).select("instance", "run", (F.col("rank") - 1).cast("long").alias("label"), F.col("x").alias("centre"))
    elif init == "k-means++":
        centres = _plus_plus(spread, k, d, seed)
    else:
        centres = _parallel_seeds(spread, k, d, seed)
    centres = materialise(centres.select("instance", "run", "label", "centre"))

    done = 0
    for done in range(1, max_iter + 1):
        keys = ["instance", "run"]
        arrays = centre_arrays(centres, keys, "label", "centre")
        told = assign(spread, arrays, "x", keys, d)
        new = mean_vectors(told, [*keys, "label"], "x", "w").drop("weight")
        new = materialise(new.select("instance", "run", "label", "centre"))
        lost = centres.join(new, [*keys, "label"], "left_anti").select(*keys, "label")
        if not lost.isEmpty():
            new = materialise(new.unionByName(_refill(spread, lost, k, seed, done)))
        moved = centres.withColumnRenamed("centre", "_old").join(new, [*keys, "label"])
        shift = moved.groupBy(*keys).agg(F.sum(F.sqrt(squared("_old", "centre"))).alias("s")).agg(F.max("s")).first()[0]
        centres = new
        if shift is None or shift < tol:
            break
    arrays = centre_arrays(centres, ["instance", "run"], "label", "centre")
    told = assign(spread, arrays, "x", ["instance", "run"], d)
    if runs > 1:
        cost = told.groupBy("instance", "run").agg(F.sum(F.col("distance") * F.col("w")).alias("inertia"))
        best = cost.groupBy("instance").agg(F.min(F.struct("inertia", "run")).alias("_b"))
        best = materialise(best.select("instance", "_b.run", "_b.inertia"))
        keep = small_side(best.select("instance", "run"))
        told, centres = told.join(keep, ["instance", "run"]), centres.join(keep, ["instance", "run"])
    else:
        best = told.groupBy("instance", "run").agg(F.sum(F.col("distance") * F.col("w")).alias("inertia"))
    return Clustering(
        centres.select(F.col("instance").alias(instance), "label", "centre"),
        told.select(F.col("instance").alias(instance), F.col("point").alias(point), "label", "distance"),
        best.select(F.col("instance").alias(instance), "run", "inertia"),
        done,
    )


def _refill(spread: DataFrame, lost: DataFrame, k: int, seed: int, done: int) -> DataFrame:
    """A random point for each cluster that lost all of its points."""
    holes = order_rows(lost, ["instance", "run"], ["label"], seq="_h").df
    drawn = spread.withColumn("_u", u(f"{seed}/{done}", "run", "instance", "point"))
    drawn = top_rows(drawn, ["instance", "run"], ["_u", "point"], k).select(
        "instance", "run", (F.col("rank") - 1).cast("long").alias("_h"), F.col("x").alias("centre")
    )
    return holes.join(drawn, ["instance", "run", "_h"]).select("instance", "run", "label", "centre")


def _plus_plus(spread: DataFrame, k: int, d: Distance, seed: int, weight: str | None = None) -> DataFrame:
    """Each next centre is drawn with probability proportional to its squared distance (times weight).

    The draw takes the largest ln(u)/weight, one round per centre.
    """
    keys = ["instance", "run"]
    first = spread.withColumn("_u", u(f"{seed}/0", "run", "instance", "point"))
    centres = top_rows(first, keys, ["_u", "point"], 1).select(
        *keys, F.lit(0).cast("long").alias("label"), F.col("x").alias("centre")
    )
    centres = materialise(centres)
    for j in range(1, k):
        near = assign(spread, centre_arrays(centres, keys, "label", "centre"), "x", keys, d)
        draw = F.log(u(f"{seed}/{j}", "run", "instance", "point") + 1e-12) / (F.pow("distance", F.lit(2.0)) * (F.col(weight) if weight else F.lit(1.0)))
        drawn = near.where(F.col("distance") > 0).withColumn("_u", draw)
        drawn = top_rows(drawn, keys, [F.col("_u").desc(), "point"], 1).select(
            *keys, F.lit(j).cast("long").alias("label"), F.col("x").alias("centre")
        )
        centres = materialise(centres.unionByName(drawn))
    return centres


#: Rounds of oversampling, and points drawn in a round per centre wanted.
ROUNDS, OVERSAMPLE = 5, 2


def _parallel_seeds(spread: DataFrame, k: int, d: Distance, seed: int) -> DataFrame:
    """k centres from about ROUNDS * OVERSAMPLE * k candidates (k-means||).

    Every point keeps its least distance to the candidates so far, so a round compares it with the
    round's new ones only, and draws it with probability proportional to weight times squared
    distance. The candidates, weighted by the points nearest to them, are few; one task per
    (instance, run) picks k of them by weighted k-means++.
    """
    keys = ["instance", "run"]
    draw = lambda r: u(f"{seed}/par/{r}", "run", "instance", "point")
    new = top_rows(spread.withColumn("_u", draw(0)), keys, ["_u", "point"], 1)
    new = materialise(new.select(*keys, F.lit(0).cast("long").alias("label"), F.col("x").alias("centre")))
    candidates, counted = new, new.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    near = materialise(assign(spread, centre_arrays(new, keys, "label", "centre"), "x", keys, d))
    for r in range(1, ROUNDS + 1):
        cost = F.col("w") * F.col("distance") * F.col("distance")
        total = materialise(near.groupBy(*keys).agg(F.sum(cost).alias("_phi")).where("_phi > 0"))
        drawn = near.join(small_side(total), keys).where(draw(r) * F.col("_phi") < OVERSAMPLE * k * cost)
        drawn = order_rows(drawn.select(*keys, "point", "x"), keys, ["point"], seq="_i").df.join(small_side(counted), keys)
        new = materialise(drawn.select(*keys, (F.col("_c") + F.col("_i")).alias("label"), F.col("x").alias("centre")))
        if new.isEmpty():
            break
        candidates = candidates.unionByName(new)
        counted = materialise(candidates.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")))
        # An instance without new candidates is compared with its first one again.
        again = candidates.where("label = 0").join(new.select(*keys).distinct(), keys, "left_anti")
        arrays = materialise(centre_arrays(new.unionByName(again), keys, "label", "centre"))
        old = near.withColumnsRenamed({"label": "_label", "distance": "_distance"})
        told = assign(old, arrays, "x", keys, d)
        closer = F.col("distance") < F.col("_distance")
        near = told.withColumns(
            {"label": F.when(closer, F.col("label")).otherwise(F.col("_label")), "distance": F.least("distance", "_distance")}
        ).drop("_label", "_distance")
        near = materialise(near)
    mass = near.groupBy(*keys, "label").agg(F.sum("w").alias("mass"))

    def pick(part: pd.DataFrame) -> pd.DataFrame:
        x, w = np.stack(part["centre"].to_numpy()), part["mass"].to_numpy(float)
        rng = np.random.default_rng([seed, int(part["run"].iloc[0])])
        chosen, gap = [int(rng.choice(len(x), p=w / w.sum()))], np.full(len(x), np.inf)
        while len(chosen) < min(k, len(x)):
            gap = np.minimum(gap, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
            share = gap * w
            if share.sum() <= 0:
                break
            chosen.append(int(rng.choice(len(x), p=share / share.sum())))
        out = part.iloc[chosen][["instance", "run", "centre"]].copy()
        out["label"] = np.arange(len(chosen))
        return out[["instance", "run", "label", "centre"]]

    few = candidates.join(mass, [*keys, "label"])
    kind = spread.schema["instance"].dataType.simpleString()
    return few.groupBy(*keys).applyInPandas(pick, f"instance {kind}, run int, label long, centre array<double>")


def chunk_kmeans(
    frames: DataFrame,
    keys: Sequence[str],
    order: str,
    x: str,
    k: int,
    weight: str | None = None,
    max_iter: int = 10,
    tol: float = 1e-4,
    seed: int = 42,
) -> DataFrame:
    """K-means inside each chunk of a bounded number of frames; short chunks pass through.

    Returns keys, cluster, centroid, weight and the `members` positions. A chunk is cut by count
    beforehand, so one task holds one chunk.
    """
    data = frames.select(
        *keys,
        F.col(order).alias("_o"),
        doubles(x).alias("_x"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"),
    )
    data = data.withColumn("_u", u(seed, *keys, "_o"))
    schema = T.StructType(
        [data.schema[c] for c in keys]
        + [
            T.StructField("cluster", T.LongType()),
            T.StructField("centroid", T.ArrayType(T.DoubleType())),
            T.StructField("weight", T.DoubleType()),
            T.StructField("members", T.ArrayType(T.LongType())),
        ]
    )
    names = list(keys)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_o", ignore_index=True)
        x, w = np.stack(pdf["_x"].to_numpy()), pdf["_w"].to_numpy()
        centres, label = lloyd(x, w, np.argsort(pdf["_u"].to_numpy()), k, max_iter, tol)
        rows = [
            [*pdf.loc[0, names], j, c.tolist(), float(w[label == j].sum()), pdf["_o"][label == j].tolist()]
            for j, c in enumerate(centres)
        ]
        return pd.DataFrame(rows, columns=[f.name for f in schema])

    return data.groupBy(*keys).applyInPandas(fit, schema)


def lloyd(
    x: np.ndarray, w: np.ndarray, draw: np.ndarray, k: int, max_iter: int = 10, tol: float = 1e-4
) -> tuple[np.ndarray, np.ndarray]:
    """Weighted k-means on one small matrix, starting from the rows listed first in `draw`.

    The centres returned are the means of the labels returned.
    """
    if len(x) <= k:
        return x, np.arange(len(x))
    centres = x[draw[:k]]
    for _ in range(max_iter):
        label = ((x[:, None, :] - centres[None, :, :]) ** 2).sum(2).argmin(1)
        hot = np.zeros((k, len(x)))
        hot[label, np.arange(len(x))] = w
        mass = hot.sum(1)
        new = np.divide(hot @ x, mass[:, None], out=np.zeros_like(centres), where=mass[:, None] > 0)
        empty = np.flatnonzero(mass <= 0)
        new[empty] = x[draw[(k + np.arange(len(empty))) % len(x)]]
        shift = np.linalg.norm(new - centres, axis=1).sum()
        centres = new
        if shift < tol:
            break
    return centres, label


def predict(points: DataFrame, centres: DataFrame, x: str, keys: Sequence[str], distance: str | Distance) -> DataFrame:
    """Labels of new points by the centres of a clustering."""
    return assign(points, centre_arrays(centres, keys, "label", "centre"), x, keys, distance)


def soft_step(
    points: DataFrame, centres: DataFrame, x: str, keys: Sequence[str], temp: float = 5.0, eps: float = 1e-8
) -> tuple[DataFrame, DataFrame]:
    """One soft k-means step: (assignment probabilities, new centres).

    Probabilities are the softmax of `temp` times the cosine similarity, a similarity of exactly
    0 excluded; a centre with such a point becomes the zero vector.
    """
    rows = with_centres(points, centres, keys)
    sims = F.transform("_centres", lambda s: F.struct(s["label"].alias("label"), cosine(F.col(x), s["c"]).alias("s")))

    def shares(all_s: Column) -> Column:
        raw = F.transform(
            all_s,
            lambda p: F.struct(
                p["label"].alias("label"),
                p["s"].alias("similarity"),
                F.when(p["s"] == 0, 0.0).otherwise(F.exp(p["s"] * temp)).alias("e"),
            ),
        )
        return let(
            raw,
            lambda r: let(
                F.aggregate(r, F.lit(0.0), lambda a, p: a + p["e"]),
                lambda total: F.transform(
                    r,
                    lambda p: F.struct(
                        p["label"].alias("label"),
                        p["similarity"].alias("similarity"),
                        F.when(total > 0, p["e"] / total).otherwise(0.0).alias("probability"),
                    ),
                ),
            ),
        )

    soft = rows.withColumn("_p", let(sims, shares)).drop("_centres").select("*", F.inline("_p")).drop("_p")
    vec = array_to_vector(doubles(x))
    new = soft.groupBy(*keys, "label").agg(
        Summarizer.mean(vec, F.col("probability")).alias("_m"),
        F.sum("probability").alias("mass"),
        F.bool_or(F.col("similarity") == 0).alias("_zero"),
    )
    shrink = F.when(F.col("_zero"), 0.0).otherwise(F.col("mass") / (F.col("mass") + eps))
    new = new.withColumn("_c", vector_to_array("_m")).select(
        *keys, "label", F.transform("_c", lambda v: v * shrink).alias("centre"), "mass"
    )
    return soft, new


def soft_kmeans(
    points: DataFrame, centres: DataFrame, x: str, keys: Sequence[str], temp: float = 5.0, max_iter: int = 10, tol: float = 1e-4
) -> DataFrame:
    """Soft k-means from given centres (keys, label, centre) until they move less than `tol`."""
    for _ in range(max_iter):
        _, new = soft_step(points, centre_arrays(centres, keys, "label", "centre"), x, keys, temp)
        new = materialise(new.select(*keys, "label", "centre"))
        gaps = centres.select(*keys, "label", F.col("centre").alias("_o")).join(new, [*keys, "label"])
        shift = gaps.agg(F.max(F.sqrt(squared("_o", "centre")))).first()[0]
        centres = new
        if shift is None or shift < tol:
            break
    return centres


# ---- capacity ---------------------------------------------------------------------------------


def constrained_assign(
    points: DataFrame, centres: DataFrame, keys: Sequence[str], point: str, x: str, weight: str
) -> DataFrame:
    """Assign weighted points to clusters of capacity 1: (keys, point, label), -1 where nothing fits.

    Priority is weight / distance. In each round every open point asks the cluster of its highest
    priority that has room for it, ties going to the lower label; a cluster takes the askers
    of highest priority up to the first that no longer fits, ties going to the lower point. The first
    asker always fits, so each asked cluster fills up; a point that fits nowhere is left out,
    as room never grows. The result does not depend on how rows are spread: an instance of any size
    is ordered over all tasks, and the state between rounds is the room of each cluster.
    """
    keys = list(keys)
    arrays = centre_arrays(centres, keys, "label", "centre")
    rows = points.select(*keys, point, doubles(x).alias("_x"), F.col(weight).cast("double").alias("_w"))
    priority = F.transform(
        "_centres",
        lambda s: F.struct(
            (-F.col("_w") / F.greatest(F.sqrt(squared("_x", s["c"])), F.lit(1e-9))).alias("p"), s["label"].alias("label")
        ),
    )
    ranked = rows.join(small_side(arrays), keys).select(*keys, point, "_w", F.array_sort(priority).alias("_p"))
    open_ = materialise(ranked)
    free = F.map_from_entries(F.transform("_centres", lambda s: F.struct(s["label"], F.lit(1.0))))
    rooms = materialise(arrays.select(*keys, free.alias("_room")))
    done = []
    while True:
        asks = open_.join(small_side(rooms), keys)
        fits = F.filter("_p", lambda c: F.element_at("_room", c["label"]) >= F.col("_w") - 1e-12)
        asks = materialise(asks.withColumn("_ask", F.get(fits, 0)))
        done.append(asks.where("_ask is null").select(*keys, point, F.lit(-1).cast("long").alias("label")))
        asks = asks.where("_ask is not null").withColumns({"label": F.col("_ask.label").cast("long"), "_pr": F.col("_ask.p")})
        if asks.isEmpty():
            break
        run = order_rows(asks.select(*keys, point, "_w", "_p", "_room", "label", "_pr"), [*keys, "label"], ["_pr", point])
        run = run.running(_load=F.col("_w")).df
        taken = F.col("_load") <= F.element_at("_room", F.col("label")) + 1e-12
        run = materialise(run.withColumn("_taken", taken).select(*keys, point, "_w", "_p", "label", "_taken"))
        done.append(run.where("_taken").select(*keys, point, "label"))
        loads = run.where("_taken").groupBy(*keys, "label").agg(F.sum("_w").alias("_used"))
        loads = loads.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("label", "_used"))).alias("_used"))
        left = F.transform_values(
            "_room", lambda j, r: r - F.coalesce(F.element_at("_used", j.cast("long")), F.lit(0.0))
        )
        rooms = materialise(rooms.join(loads, keys, "left").select(*keys, left.alias("_room")))
        open_ = run.where("not _taken").select(*keys, point, "_w", "_p")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


@dataclass
class Constrained:
    """`labels`: instance, point, label. `centres`: instance, label, centre. `instances`: instance,
    infeasible (some point fits nowhere in every run), run kept and its inertia."""

    labels: DataFrame
    centres: DataFrame
    instances: DataFrame


def constrained_kmeans(
    points: DataFrame,
    instance: str,
    point: str,
    x: str,
    weight: str,
    k: int,
    init: str = "rnd",
    runs: int = 1,
    max_iter: int = 10,
    tol: float = 1e-4,
    seed: int = 42,
) -> Constrained:
    """k-means whose clusters hold a total weight of at most 1 each.

    Starts: `rnd` (random points), `k-means++`, `topk` (the heaviest points; one run), `ckm++` (as
    k-means++, drawing by weight times squared distance). Points are assigned by
    `constrained_assign` and centres moved to the plain mean of their points until they move less
    than `tol`. Of the runs in which every point is placed the one of least inertia is kept; an
    instance without such a run is flagged infeasible and keeps its least inertia over placed points.
    """
    if init not in ("rnd", "k-means++", "topk", "ckm++"):
        raise ValueError(f"unknown init method {init!r}")
    if init == "topk" and runs > 1:
        raise ValueError("topk always gives the same start")
    keys = ["instance", "run"]
    base = points.select(
        F.col(instance).alias("instance"), F.col(point).alias("point"), doubles(x).alias("x"),
        F.col(weight).cast("double").alias("w"),
    )
    base = materialise(base)
    if not base.where("w is null or w <= 0 or w > 1").isEmpty():
        raise ValueError("weights must be positive and at most 1")
    rows = base.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))
    if init in ("rnd", "topk"):
        draw = u(seed, "run", "instance", "point") if init == "rnd" else -F.col("w")
        drawn = top_rows(rows.withColumn("_o", draw), keys, ["_o", "point"], k)
        centres = drawn.select(*keys, (F.col("rank") - 1).cast("long").alias("label"), F.col("x").alias("centre"))
    else:
        centres = _plus_plus(rows, k, distance_of("l2"), seed, "w" if init == "ckm++" else None)
    centres = materialise(centres.select(*keys, "label", "centre"))
    for _ in range(max_iter):
        told = constrained_assign(rows, centres, keys, "point", "x", "w").where("label >= 0")
        placed = rows.join(told, [*keys, "point"])
        new = mean_vectors(placed, [*keys, "label"], "x").drop("weight").withColumnRenamed("centre", "_new")
        moved = centres.join(new, [*keys, "label"], "left").withColumn("_new", F.coalesce("_new", "centre"))
        moved = materialise(moved.withColumn("_shift", F.sqrt(squared("centre", "_new"))))
        shift = moved.groupBy(*keys).agg(F.sum("_shift").alias("s")).agg(F.max("s")).first()[0]
        centres = moved.select(*keys, "label", F.col("_new").alias("centre"))
        if shift is None or shift < tol:
            break
    told = materialise(constrained_assign(rows, centres, keys, "point", "x", "w"))
    near = rows.join(told, [*keys, "point"]).join(small_side(centres), [*keys, "label"], "left")
    cost = near.groupBy(*keys).agg(
        F.sum(squared("x", "centre")).alias("inertia"), F.bool_or(F.col("label") < 0).alias("infeasible")
    )
    best = cost.groupBy("instance").agg(F.min(F.struct("infeasible", "inertia", "run")).alias("b"))
    best = materialise(best.select("instance", "b.infeasible", "b.run", "b.inertia"))
    keep = small_side(best.select(*keys))
    return Constrained(
        told.join(keep, keys).select(F.col("instance").alias(instance), F.col("point").alias(point), "label"),
        centres.join(keep, keys).select(F.col("instance").alias(instance), "label", "centre"),
        best.withColumnRenamed("instance", instance),
    )


# ---- pooling, PCA, soft-DTW -------------------------------------------------------------------


def pool_patches(patches: Column, side: int, rate: int) -> Column:
    """Average pooling of a side x side grid of patch vectors; a ragged edge is dropped."""
    out = side // rate
    grid = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(out - 1)),
            lambda r: F.transform(F.sequence(F.lit(0), F.lit(out - 1)), lambda c: F.struct(r.alias("r"), c.alias("c"))),
        )
    )

    def cell(at: Column) -> Column:
        picked = [
            F.get(patches, (at["r"] * rate + i) * side + at["c"] * rate + j).cast("array<double>")
            for i in range(rate)
            for j in range(rate)
        ]
        summed = picked[0]
        for p in picked[1:]:
            summed = F.zip_with(summed, p, lambda a, b: a + b)
        return F.transform(summed, lambda v: v / (rate * rate))

    return F.transform(grid, cell)


def project(df: DataFrame, row_id: Sequence[str], x: str, components: int) -> tuple[DataFrame, list[float]]:
    """PCA to `components` and min-max scaling of all rows in one fit; explained variances."""
    rows = df.withColumn("_v", array_to_vector(doubles(x)))
    model = PCA(k=components, inputCol="_v", outputCol="_pc").fit(rows)
    scaled = MinMaxScaler(inputCol="_pc", outputCol="_s").fit(model.transform(rows))
    out = scaled.transform(model.transform(rows)).select(*row_id, vector_to_array("_s").alias("point"))
    return out, [float(v) for v in model.explainedVariance.toArray()]


def soft_dtw_values(d: np.ndarray, gamma: float, bandwidth: float = 0.0) -> np.ndarray:
    """Soft-DTW of a stack of equally sized distance matrices, along anti-diagonals."""
    count, n, m = d.shape
    r = np.full((count, n + 2, m + 2), np.inf)
    r[:, 0, 0] = 0.0
    for diagonal in range(2, n + m + 1):
        i = np.arange(max(1, diagonal - m), min(n, diagonal - 1) + 1)
        j = diagonal - i
        if bandwidth > 0:
            near = np.abs(i - j) <= bandwidth
            i, j = i[near], j[near]
        before = np.stack([r[:, i - 1, j - 1], r[:, i - 1, j], r[:, i, j - 1]])
        low = before.min(0)
        base = np.where(np.isfinite(low), low, 0.0)
        with np.errstate(divide="ignore"):
            soft = base - gamma * np.log(np.exp(-(before - base) / gamma).sum(0))
        r[:, i, j] = d[:, i - 1, j - 1] + soft
    return r[:, n, m]


def soft_dtw(gamma: float = 1.0, normalise: bool = False, bandwidth: float = 0.0) -> Callable[[Column, Column], Column]:
    """Arrow UDF over two columns of sequences (array of vectors): squared-Euclid soft-DTW.

    Pairs of equal lengths in a batch are computed together. `normalise` subtracts half of both
    self-distances, so equal sequences give 0.
    """

    def cost(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        gap = ((a[:, :, None, :] - b[:, None, :, :]) ** 2).sum(3)
        return soft_dtw_values(gap, gamma, bandwidth)

    def matrix(sequence) -> np.ndarray:
        return np.stack([np.asarray(v, float) for v in sequence])

    @F.pandas_udf(T.DoubleType())
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        out = np.full(len(left), np.nan)
        sizes = list(zip(left.map(len), right.map(len)))
        for size in set(sizes):
            at = [i for i, s in enumerate(sizes) if s == size]
            for part in range(0, len(at), 256):
                rows = at[part : part + 256]
                a = np.stack([matrix(left.iloc[i]) for i in rows])
                b = np.stack([matrix(right.iloc[i]) for i in rows])
                value = cost(a, b)
                if normalise:
                    value = value - 0.5 * (cost(a, a) + cost(b, b))
                out[rows] = value
        return pd.Series(out)

    return run


def pairwise_soft_dtw(
    pairs: DataFrame, left: str, right: str, out: str = "distance", **options
) -> DataFrame:
    """Soft-DTW of the two sequences of every row of a pair table.

    The work per pair is large and the rows are small, so the pairs are dealt evenly to the shuffle
    partitions instead of staying in the few partitions their size would give.
    """
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(parts).withColumn(out, soft_dtw(**options)(F.col(left), F.col(right)))
