"""Speaker vectors: centroids, the registry of known speakers, and clustering. Vectors are arrays of numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Added to norms, so that zero vectors have no infinite similarity.
TINY = 1e-9
#: Names of the registry that are compared at once, and clusters that one is compared with at once; no result hangs on them.
NAMES_AT_ONCE, CLUSTERED_AT_ONCE = 20_000, 1_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 with a zero vector."""
    return dot(a, b) / (norm(a) * norm(b) + TINY)


def unit(a: Column) -> Column:
    n = norm(a) + TINY
    return F.transform(a, lambda x: x.cast("double") / n)


def centroids(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """The mean vector of each group, scaled to length 1: ``keys``, ``centroid``, ``members``.

    Components are averaged before the shuffle. Null vectors don't count; vectors of a group have one length.
    """
    cells = df.filter(F.col(vector).isNotNull()).select(*keys, F.posexplode(vector).alias("pos", "x"))
    means = cells.groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count(F.lit(1)).alias("n"))
    out = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("c"), F.max("n").alias("members"))
    return out.select(*keys, unit(F.transform("c", lambda e: e["x"])).alias("centroid"), "members")


def match_registry(df: DataFrame, ident: str, vector: str, registry: DataFrame) -> DataFrame:
    """The most similar name of ``registry`` (``name``, ``centroid``) for each vector: ``ident``, ``name``, ``similarity``.

    Names are compared in blocks of ``NAMES_AT_ONCE``, each of which is sent to the workers and read through by one
    pass over the vectors; so a registry of any size is compared in full. Of equally similar names the first counts. An
    empty registry gives null and 0.
    """
    blocks = registry.select("name", "centroid", F.pmod(F.xxhash64("name"), F.lit(max(1, -(-registry.count() // NAMES_AT_ONCE)))).alias("block"))
    vectors = df.select(F.col(ident).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    kind = dict(df.dtypes)[ident]
    found = vectors.select("id", F.lit(None).cast("string").alias("name"), F.lit(0.0).alias("similarity")).limit(0)
    for (block,) in blocks.select("block").distinct().orderBy("block").collect():
        known = sorted((r[0], list(r[1])) for r in blocks.filter(F.col("block") == block).select("name", "centroid").collect())
        names = [n for n, _ in known]
        matrix = np.array([c for _, c in known], np.float64)
        lengths = np.linalg.norm(matrix, axis=1)

        def run(batches: Iterator[pd.DataFrame], names=names, matrix=matrix, lengths=lengths) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    v = np.stack([np.asarray(x, np.float64) for x in batch["v"]])
                    sims = v @ matrix.T / (np.linalg.norm(v, axis=1)[:, None] * lengths[None, :] + TINY)
                    best = sims.argmax(axis=1)
                    yield pd.DataFrame({"id": batch["id"], "name": [names[i] for i in best], "similarity": sims[np.arange(len(v)), best]})

        found = found.unionByName(vectors.filter("v IS NOT NULL").mapInPandas(run, f"id {kind}, name string, similarity double"))
    best = found.groupBy("id").agg(F.min(F.struct((-F.col("similarity")).alias("d"), "name", "similarity")).alias("b"))
    out = vectors.select("id").join(best, "id", "left")
    return out.select(F.col("id").alias(ident), F.col("b.name").alias("name"), F.coalesce("b.similarity", F.lit(0.0)).alias("similarity"))


def assign_names(matches: DataFrame, sure: float = 0.70, doubtful: float = 0.60) -> DataFrame:
    """``matches`` with ``assigned`` (the name from ``sure`` on) and ``needs_review`` (from ``doubtful`` up to ``sure``)."""
    s = F.col("similarity")
    return matches.withColumn("assigned", F.when(s >= sure, F.col("name"))).withColumn("needs_review", (s >= doubtful) & (s < sure))


def update_registry(registry: DataFrame, fresh: DataFrame, alpha: float = 0.30) -> DataFrame:
    """The registry (``name``, ``centroid``, ``samples``) moved by ``fresh`` (``name``, ``centroid``); new names are enrolled with one sample."""
    old, new = F.col("centroid"), F.col("__new")
    both = registry.join(fresh.select("name", F.col("centroid").cast("array<double>").alias("__new")), "name", "full").withColumn("centroid", old.cast("array<double>"))
    moved = unit(F.zip_with(old, new, lambda a, b: a * (1 - alpha) + b * alpha))
    return both.select(
        "name", F.when(old.isNull(), new).when(new.isNull(), old).otherwise(moved).alias("centroid"), F.expr("CASE WHEN samples IS NULL THEN 1L WHEN __new IS NULL THEN samples ELSE samples + 1 END").alias("samples")
    )


def collapse_speakers(durations: DataFrame, dominance: float = 0.88, secondary_max_ratio: float | None = None, secondary_min: int | None = None) -> DataFrame:
    """Whether a file is of one speaker: ``file_id``, ``speaker_id`` (dominant), ``share``, ``collapse``.

    ``durations`` has ``file_id``, ``speaker_id``, ``speech`` (ms). One voice must have ``dominance`` of the speech; the
    others together less than ``secondary_max_ratio``, and each less than ``secondary_min``, if these are given.
    """
    top = durations.groupBy("file_id").agg(F.sum("speech").alias("total"), F.count(F.lit(1)).alias("n"), F.min(F.struct((-F.col("speech")).alias("d"), "speaker_id")).alias("t"))
    second = durations.join(top.select("file_id", F.col("t.speaker_id").alias("__top")), "file_id").filter("speaker_id <> __top").groupBy("file_id").agg(F.max("speech").alias("second"))
    out = top.join(second, "file_id", "left").filter("total > 0").withColumn("share", F.expr("-t.d / CAST(total AS double)"))
    collapse = (F.col("n") > 1) & (F.col("share") >= dominance)
    if secondary_max_ratio:
        collapse = collapse & (1 - F.col("share") < secondary_max_ratio)
    if secondary_min:
        collapse = collapse & (F.coalesce("second", F.lit(0)) < secondary_min)
    return out.select("file_id", F.col("t.speaker_id").alias("speaker_id"), "share", collapse.alias("collapse"))


def agglomerate(x: np.ndarray, weights: np.ndarray, threshold: float, k: int | None = None) -> np.ndarray:
    """Labels of average-linkage clusters by cosine distance: pairs are joined up to ``threshold``, or until ``k`` are left."""
    n = len(x)
    if n == 0:
        return np.zeros(0, np.int64)
    v = x / (np.linalg.norm(x, axis=1, keepdims=True) + TINY)
    d = 1.0 - v @ v.T
    np.fill_diagonal(d, np.inf)
    w, label, alive = weights.astype(float).copy(), np.arange(n), n
    while alive > (k or 1):
        i, j = divmod(int(d.argmin()), n)
        if k is None and d[i, j] > threshold or not np.isfinite(d[i, j]):
            break
        i, j = min(i, j), max(i, j)
        row = (d[i] * w[i] + d[j] * w[j]) / (w[i] + w[j])
        row[~np.isfinite(d[i]) | ~np.isfinite(d[j])] = np.inf
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        w[i] += w[j]
        label[label == label[j]] = label[i]
        alive -= 1
    return np.unique(label, return_inverse=True)[1]


def linked(x: np.ndarray, threshold: float) -> np.ndarray:
    """Labels of the clusters of ``agglomerate`` up to ``threshold``, without a matrix of pairs: memory grows with ``x``.

    The mean cosine distance of two clusters is 1 less the product of the means of their unit vectors, so a sum and a
    count is all that a cluster needs. A chain goes from a cluster to its nearest one until two are nearest to each
    other, which are joined; with average linkage this gives the clusters of joining the nearest pair first. A cluster
    without any other within ``threshold`` stays so, and is left out from then on.
    """
    n = len(x)
    sums = x / (np.linalg.norm(x, axis=1, keepdims=True) + TINY)
    weight, label, at = np.ones(n), np.arange(n), np.arange(n)
    alive = np.ones(n, bool)
    chain: list[int] = []

    def nearest(i: int, before: int | None) -> tuple[int, float]:
        mean, best, least = sums[i] / weight[i], -1, np.inf
        for a in range(0, len(sums), CLUSTERED_AT_ONCE):
            d = 1.0 - sums[a : a + CLUSTERED_AT_ONCE] @ mean / weight[a : a + CLUSTERED_AT_ONCE]
            d[~alive[a : a + CLUSTERED_AT_ONCE]] = np.inf
            if a <= i < a + len(d):
                d[i - a] = np.inf
            if before is not None and a <= before < a + len(d) and d[before - a] <= least + TINY and d[before - a] <= d.min() + TINY:
                best, least = before, d[before - a]  # of equally near ones the one before, or the chain would have no end
            elif len(d) and d.min() < least - (TINY if best == before else 0):
                best, least = a + int(d.argmin()), d.min()
        return best, float(least)

    left, first = n, 0
    while True:
        if not chain:
            while first < len(alive) and not alive[first]:
                first += 1
            if first == len(alive):
                break
            chain.append(first)
        i = chain[-1]
        j, d = nearest(i, chain[-2] if len(chain) > 1 else None)
        if j < 0 or d > threshold:
            alive[i] = False
            chain.pop()
            left -= 1
        elif len(chain) > 1 and j == chain[-2]:
            i, j = min(i, j), max(i, j)
            sums[i] += sums[j]
            weight[i] += weight[j]
            label[at[j]] = at[i]
            alive[j] = False
            del chain[-2:]
            left -= 1
        else:
            chain.append(j)
        if not chain and left < len(alive) // 2:
            sums, weight, at, first = sums[alive], weight[alive], at[alive], 0
            alive = np.ones(left, bool)
    for i in range(n):  # a cluster is named by its lowest row, which comes before all that were joined to it
        label[i] = label[label[i]]
    return np.unique(label, return_inverse=True)[1]


def cluster(df: DataFrame, keys: list[str], ident: str, vector: str, threshold: float = 0.25) -> DataFrame:
    """Clusters of the vectors of each group: ``keys``, ``ident``, ``cluster``, numbered by the first ``ident``.

    Average linkage by cosine distance, by the same rule at every size. A group is one task's: its memory grows with
    the vectors of the group, its time with their square. Null vectors don't count; vectors of a group have one length.
    """
    types = dict(df.dtypes)
    names = [f"k{i}" for i in range(len(keys))]
    key = "".join(f"{a} {types[k]}, " for k, a in zip(keys, names))
    rows = df.select(*[F.col(k).alias(a) for k, a in zip(keys, names)], F.col(ident).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("v IS NOT NULL")

    def inside(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [("id", "ascending")])).combine_chunks()
        v = table["v"]
        if len(pc.unique(pc.list_value_length(v))) != 1:
            raise ValueError("vectors of a group have different lengths")
        x = pc.list_flatten(v).to_numpy().reshape(len(v), -1)
        return table.drop_columns("v").append_column("label", pa.array(linked(x, threshold), pa.int64()))

    joined = rows.groupBy(*names).applyInArrow(inside, f"{key}id {types[ident]}, label bigint")
    firsts = joined.withColumn("first", F.min("id").over(Window.partitionBy(*names, "label")))
    out = firsts.withColumn("cluster", F.dense_rank().over(Window.partitionBy(*names).orderBy("first", "label")))
    return out.select(*[F.col(a).alias(k) for k, a in zip(keys, names)], F.col("id").alias(ident), "cluster")


def merge_similar(centroids: DataFrame, keys: list[str], label: str, threshold: float, least: int = 1) -> DataFrame:
    """Labels of a group whose centroids are within ``threshold``, joined nearest first: ``keys``, ``label``, ``merged_into``.

    ``centroids`` has ``label``, ``centroid`` and ``members``. The label that sorts first stays; at least ``least`` labels are left. A group is the labels of a
    recording, few and small, so it is one task's.
    """
    types = dict(centroids.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(label).reset_index(drop=True)
        x = {i: np.asarray(v) * w for i, (v, w) in enumerate(zip(pdf["centroid"], pdf["members"]))}
        into = list(range(len(pdf)))
        while len(x) > max(1, least):
            at = sorted(x)
            unit_x = np.stack([x[i] / (np.linalg.norm(x[i]) + TINY) for i in at])
            d = 1.0 - unit_x @ unit_x.T
            d[np.tril_indices(len(at))] = np.inf
            i, j = divmod(int(d.argmin()), len(at))
            if not d[i, j] < threshold:
                break
            x[at[i]] = x[at[i]] + x.pop(at[j])
            into = [at[i] if k == at[j] else k for k in into]
        return pdf[[*keys, label]].assign(merged_into=[pdf[label][k] for k in into])

    spec = ", ".join(f"`{c}` {types[c]}" for c in [*keys, label]) + f", merged_into {types[label]}"
    return centroids.groupBy(*keys).applyInPandas(run, spec)


def silhouette(df: DataFrame, keys: list[str], label: str, vector: str) -> DataFrame:
    """How well labels fit, by cosine distance to centroids, -1 to 1: mean over vectors of (b - a) / max(a, b).

    ``a`` is the distance to the own label's centroid, ``b`` to the nearest other; this needs no pairs of vectors. Null
    where a group has one label. Centroids of a group travel as one row, as there are few labels.
    """
    middles = centroids(df, [*keys, label], vector)
    packed = middles.groupBy(*keys).agg(F.collect_list(F.struct(F.col(label).alias("l"), F.col("centroid").alias("c"))).alias("all"))
    rows = df.filter(F.col(vector).isNotNull()).join(packed, keys)
    far = F.transform("all", lambda m: F.struct(m["l"].alias("l"), (1 - cosine(F.col(vector), m["c"])).alias("d")))
    own = F.array_min(F.transform(F.filter(far, lambda m: m["l"] == F.col(label)), lambda m: m["d"]))
    other = F.array_min(F.transform(F.filter(far, lambda m: m["l"] != F.col(label)), lambda m: m["d"]))
    return rows.select(*keys, own.alias("a"), other.alias("b")).groupBy(*keys).agg(F.avg(F.expr("CASE WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) WHEN b IS NOT NULL THEN 0.0D END")).alias("silhouette"))


def mean_silhouette(df: DataFrame, keys: list[str], label: str, vector: str) -> DataFrame:
    """The silhouette of labels by cosine distance to all members, -1 to 1: ``keys``, ``silhouette``.

    The mean distance of a unit vector to the members of a label is 1 less its product with their mean, so this needs no
    pairs of vectors. A vector that is alone in its label counts 0. Null where a group has one label.
    """
    rows = df.filter(F.col(vector).isNotNull()).select(*keys, F.col(label).alias("__l"), unit(F.col(vector)).alias("__u"))
    cells = rows.select(*keys, "__l", F.posexplode("__u").alias("pos", "x")).groupBy(*keys, "__l", "pos").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("n"))
    sums = cells.groupBy(*keys, "__l").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("s"), F.max("n").alias("n"))
    packed = sums.groupBy(*keys).agg(F.collect_list(F.struct(F.col("__l").alias("l"), "s", "n")).alias("all"))
    far = F.transform("all", lambda m: F.struct(m["l"].alias("l"), m["n"].alias("n"), dot(F.col("__u"), m["s"]).alias("p")))
    own = F.filter("far", lambda m: m["l"] == F.col("__l"))[0]
    other = F.array_min(F.transform(F.filter("far", lambda m: m["l"] != F.col("__l")), lambda m: 1 - m["p"] / m["n"]))
    a = F.when(own["n"] > 1, 1 - (own["p"] - dot(F.col("__u"), F.col("__u"))) / (own["n"] - 1))
    fit = rows.join(packed, keys).withColumn("far", far).select(*keys, a.alias("a"), other.alias("b"))
    return fit.groupBy(*keys).agg(F.avg(F.expr("CASE WHEN b IS NULL THEN NULL WHEN greatest(a, b) > 0 AND a IS NOT NULL THEN (b - a) / greatest(a, b) ELSE 0.0D END")).alias("silhouette"))


def _spoken(turns: DataFrame) -> DataFrame:
    """Of each file: ``n`` speakers, ``turns``, and of the speaker with most speech ``speaker_id`` and ``share``; ``second``, the speech of the next."""
    by = turns.groupBy("file_id", "speaker_id").agg(F.sum(F.greatest(F.col("speech"), F.lit(0))).alias("speech"), F.count(F.lit(1)).alias("turns"))
    files = by.groupBy("file_id").agg(
        F.sum("speech").alias("total"), F.sum("turns").alias("turns"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct((-F.col("speech")).alias("d"), "speaker_id"))).alias("t")
    )
    second = F.when(F.col("n") > 1, -F.col("t")[1]["d"])
    return files.filter("total > 0").select("file_id", "n", "turns", F.col("t")[0]["speaker_id"].alias("speaker_id"), F.expr("-t[0].d / CAST(total AS double)").alias("share"), second.alias("second"))


def collapse_turns(turns: DataFrame, dominance: float = 0.88, centroid: float = 0.08, min_turns: int = 3, secondary_max_ratio: float | None = None, secondary_min: int | None = None) -> DataFrame:
    """Whether a file is of one speaker, by its turns: ``file_id``, ``speaker_id`` (dominant), ``share``, ``collapse``.

    ``turns`` has ``file_id``, ``speaker_id``, ``speech`` (ms) and ``vector``; those without a speaker don't count. From
    ``min_turns`` on, one voice must have ``dominance`` of the speech (and the others together less than
    ``secondary_max_ratio``), or no two centroids be further apart than ``centroid``; each other voice must have less
    than ``secondary_min``. Centroids of a file travel as one row, as there are few speakers.
    """
    turns = turns.filter("trim(speaker_id) <> ''")
    packed = centroids(turns, ["file_id", "speaker_id"], "vector").groupBy("file_id").agg(F.collect_list("centroid").alias("all"))
    pairs = F.flatten(F.transform("all", lambda a: F.transform("all", lambda b: 1 - cosine(a, b))))
    apart = packed.filter(F.size("all") > 1).select("file_id", F.array_max(pairs).alias("apart"))
    rows = _spoken(turns).join(apart, "file_id", "left")
    dominant, near = F.col("share") >= dominance, F.coalesce(F.col("apart") <= centroid, F.lit(False))
    if dominance <= 0:
        dominant = F.lit(False)
    if centroid <= 0:
        near = F.lit(False)
    small = 1 - F.col("share") < secondary_max_ratio if secondary_max_ratio else F.lit(True)
    collapse = (F.col("n") > 1) & (F.col("turns") >= max(2, min_turns)) & F.when(dominant, small).otherwise(near)
    if secondary_min:
        collapse = collapse & (F.coalesce("second", F.lit(0)) < secondary_min)
    return rows.select("file_id", "speaker_id", "share", collapse.alias("collapse"))


def force_single_speaker(turns: DataFrame, dominance: float = 0.85, most: int = 4, fit: float = 0.10) -> DataFrame:
    """Whether a file's labels are to be made one, as they don't fit: ``file_id``, ``speaker_id`` (dominant), ``share``, ``silhouette``, ``force``.

    ``turns`` as for ``collapse_turns``. One voice has ``dominance`` of the speech, there are 2 to ``most`` voices, and the
    silhouette of the turns' vectors (zero ones don't count) is at most ``fit``; it needs more vectors than labels.
    """
    turns = turns.filter("trim(speaker_id) <> ''")
    known = turns.filter(F.col("vector").isNotNull()).filter(norm(F.col("vector")) > 0)
    enough = known.groupBy("file_id").agg(F.count(F.lit(1)).alias("v"), F.countDistinct("speaker_id").alias("l")).filter("l > 1 AND v > l")
    scores = mean_silhouette(known, ["file_id"], "speaker_id", "vector").join(enough.select("file_id"), "file_id")
    force = (F.col("n") > 1) & (F.col("n") <= most) & (F.col("share") >= dominance) & F.coalesce(F.col("silhouette") <= fit, F.lit(False))
    return _spoken(turns).join(scores, "file_id", "left").select("file_id", "speaker_id", "share", "silhouette", force.alias("force"))


def centroid_spread(centroids: DataFrame, keys: list[str]) -> DataFrame:
    """The largest cosine distance of two centroids of a group: ``keys``, ``labels``, ``apart`` (null for one label).

    A group is the labels of a recording: few, so its centroids travel as one row.
    """
    packed = centroids.groupBy(*keys).agg(F.collect_list("centroid").alias("all"))
    pairs = F.flatten(F.transform("all", lambda a: F.transform("all", lambda b: 1 - cosine(a, b))))
    return packed.select(*keys, F.size("all").cast("bigint").alias("labels"), F.when(F.size("all") > 1, F.array_max(pairs)).alias("apart"))


def affinity(x: np.ndarray, share: float = 0.90) -> np.ndarray:
    """Cosine similarities, those below the ``share`` quantile of their row as 0, made symmetric by the larger one, and moved to 0..1."""
    v = x / (np.linalg.norm(x, axis=1, keepdims=True) + TINY)
    a = v @ v.T
    np.fill_diagonal(a, 1.0)
    if 0 < share < 1:
        a = np.where(a >= np.quantile(a, share, axis=1)[:, None], a, 0.0)
    return np.clip((np.maximum(a, a.T) + 1) / 2, 0.0, 1.0)


def _kmeans(x: np.ndarray, k: int, tries: int = 10, rounds: int = 100) -> np.ndarray:
    """Labels of the best of some runs of Lloyd's method, each begun with points far from those before; the same on every run."""
    best, least = np.zeros(len(x), np.int64), np.inf
    for seed in range(tries):
        rnd = np.random.default_rng(seed)
        middles = x[[rnd.integers(len(x))]]
        while len(middles) < k:
            d = ((x[:, None] - middles) ** 2).sum(axis=2).min(axis=1)
            middles = np.vstack([middles, x[rnd.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rnd.integers(len(x))]])
        for _ in range(rounds):
            labels = ((x[:, None] - middles) ** 2).sum(axis=2).argmin(axis=1)
            moved = np.stack([x[labels == j].mean(axis=0) if (labels == j).any() else middles[j] for j in range(k)])
            if np.allclose(moved, middles):
                break
            middles = moved
        cost = float(((x - middles[labels]) ** 2).sum())
        if cost < least - 1e-12:
            best, least = labels, cost
    return best


def _silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    v = x / (np.linalg.norm(x, axis=1, keepdims=True) + TINY)
    names = np.unique(labels)
    if not 1 < len(names) < len(x):
        return -1.0
    sums, n = np.stack([v[labels == c].sum(axis=0) for c in names]), np.array([(labels == c).sum() for c in names])
    dots, own = v @ sums.T, np.searchsorted(names, labels)
    rows = np.arange(len(x))
    a = 1 - (dots[rows, own] - (v * v).sum(axis=1)) / np.maximum(1, n[own] - 1)
    far = 1 - dots / n
    far[rows, own] = np.inf
    b = far.min(axis=1)
    return float(np.where(n[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-12), 0.0).mean())


def spectral_labels(x: np.ndarray, least: int = 2, most: int = 6, floor: float = 0.01, share: float = 0.90) -> tuple[np.ndarray | None, float]:
    """Spectral clusters of the number, ``least`` to ``most``, with the best silhouette by cosine distance, and that silhouette.

    Each number takes as many eigenvectors of the normalised affinity and clusters their rows. None below ``floor``, or for fewer than two vectors.
    """
    if len(x) < 2:
        return None, -1.0
    a = affinity(x, share)
    scale = 1 / np.sqrt(np.maximum(a.sum(axis=1), 1e-12))
    _, vectors = np.linalg.eigh(a * scale[:, None] * scale[None, :])
    best, score = None, -1.0
    for k in range(least, min(most, len(x)) + 1):
        labels = _kmeans(vectors[:, -k:] * scale[:, None], k)
        found = _silhouette(x, labels)
        if found > score:
            best, score = labels, found
    return (best, score) if best is not None and score >= floor else (None, score)


def spectral_cluster(df: DataFrame, keys: list[str], ident: str, vector: str, most_vectors: int = 5_000) -> DataFrame:
    """``spectral_labels`` of the vectors of each group: ``keys``, ``ident``, ``cluster`` (null where there are none), ``silhouette``.

    A group is one task's, as the method needs all its similarities: more than ``most_vectors`` in one group are an error, for
    which ``cluster`` is the way. Null vectors don't count.
    """
    types = dict(df.dtypes)
    rows = df.filter(F.col(vector).isNotNull()).select(*keys, ident, F.col(vector).cast("array<double>").alias("__v"))

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > most_vectors:
            raise ValueError(f"{len(pdf)} vectors in a group: more than {most_vectors}")
        pdf = pdf.sort_values(ident).reset_index(drop=True)
        labels, score = spectral_labels(np.stack(pdf["__v"]))
        firsts = {} if labels is None else {c: j for j, c in enumerate(dict.fromkeys(labels.tolist()))}
        return pdf[[*keys, ident]].assign(cluster=pd.array([None] * len(pdf) if labels is None else [firsts[c] for c in labels.tolist()], "Int64"), silhouette=score)

    return rows.groupBy(*keys).applyInPandas(inside, ", ".join(f"`{c}` {types[c]}" for c in [*keys, ident]) + ", cluster bigint, silhouette double")
