"""Average-linkage clustering of embeddings, one key a task in memory linear in its vectors, and speaker attribution."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe.constants import MAX_SPEAKERS, MIN_EMBED_SEC, SPEAKER_THRESHOLD
from voxframe.operators.intervals import nearest_label

#: Rows of similarities that are made at a time.
ROWS = 256


def agglomerate(vectors, threshold: float, most: int | None = None) -> list[list[int]]:
    """Groups of element numbers, by average cosine.

    Groups keep the order of a list from which the joined two leave and whose end their union
    takes; the first largest mean in that order is joined, while it reaches the threshold or
    there are more than ``most`` groups.

    The mean cosine of two groups is the product of their sums of unit vectors over their
    sizes, so no similarity is kept: memory is linear in the vectors.  Each group knows the
    first of its nearest among those behind it in the list; a union stands at the end, so only
    groups that lost their nearest look again.  Means are compared to twelve decimals, as the
    order of additions must not decide between equal ones.  A vector of zeros is like none.
    """
    import numpy as np

    x = np.asarray(vectors, "float32").astype("float64")
    n = len(x)
    if n == 0:
        return []
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    total = 2 * n - 1
    sums = np.zeros((total, x.shape[1] if x.ndim > 1 else 0))
    sums[:n] = np.where(norm > 0, x / np.where(norm > 0, norm, 1.0), 0.0)
    size = np.ones(total)
    alive = np.zeros(total, bool)
    alive[:n] = True
    near, best = np.zeros(total, "int64"), np.full(total, -np.inf)
    children: dict[int, tuple[int, int]] = {}

    def look(rows, end: int) -> None:
        """The nearest behind each row, of the groups up to ``end``."""
        for a in range(0, len(rows), ROWS):
            own = rows[a : a + ROWS]
            others = np.flatnonzero(alive[own[0] + 1 : end]) + own[0] + 1
            if not len(others):
                best[own] = -np.inf
                continue
            mean = (sums[own] @ sums[others].T / np.outer(size[own], size[others])).round(12)
            mean[others[None, :] <= own[:, None]] = -np.inf
            at = mean.argmax(1)
            near[own], best[own] = others[at], mean[np.arange(len(own)), at]

    look(np.arange(n), n)
    left, new = n, n
    most = n if most is None else most
    while left > 1:
        i = int(best[:new].argmax())  # the first of the largest
        if best[i] < threshold and left <= most:
            break
        j = int(near[i])
        children[new] = i, j
        sums[new], size[new] = sums[i] + sums[j], size[i] + size[j]
        alive[[i, j]], alive[new] = False, True
        best[[i, j]] = -np.inf
        left -= 1
        live = np.flatnonzero(alive[:new])
        lost = live[(near[live] == i) | (near[live] == j)]
        if len(lost):
            look(lost, new)
        if len(live):  # the union is behind all others
            mean = (sums[live] @ sums[new] / (size[live] * size[new])).round(12)
            nearer = mean > best[live]
            near[live[nearer]], best[live[nearer]] = new, mean[nearer]
        new += 1

    def members(g: int) -> list[int]:
        out, todo = [], [g]
        while todo:
            at = todo.pop()
            if at < n:
                out.append(at)
            else:
                todo += children[at]
        return sorted(out)

    return sorted((members(int(g)) for g in np.flatnonzero(alive[:new])), key=lambda m: m[0])


def cluster(vectors: DataFrame, keys: list[str], vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = SPEAKER_THRESHOLD, most: int | None = MAX_SPEAKERS) -> DataFrame:
    """(keys, vec_id, cluster): clusters are numbered by their first member."""
    schema = T.StructType([*vectors.select(*keys, vec_id).schema.fields, T.StructField("cluster", T.StringType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values(vec_id).reset_index(drop=True)
        label = [""] * len(pdf)
        for k, group in enumerate(agglomerate(np.stack(pdf[embedding].tolist()), threshold, most)):
            for i in group:
                label[i] = str(k)
        return pdf[[*keys, vec_id]].assign(cluster=label)

    return vectors.select(*keys, vec_id, embedding).groupBy(*keys).applyInPandas(run, schema)


def diarize(segments: DataFrame, keys: list[str], threshold: float = SPEAKER_THRESHOLD, most: int = MAX_SPEAKERS, min_sec: float = MIN_EMBED_SEC) -> DataFrame:
    """``speaker`` of each segment (keys, idx, start_sec, end_sec, embedding).

    Segments of ``min_sec`` or more are clustered; the others take the label of the
    nearest of those by start, the earlier on ties; without any, all are '0'.
    """
    long = segments.where(F.col("end_sec") - F.col("start_sec") >= min_sec)
    labels = cluster(long, keys, "idx", "embedding", threshold, most).withColumnRenamed("cluster", "speaker")
    joined = segments.drop("embedding").join(labels, [*keys, "idx"], "left")
    return nearest_label(joined, keys, "start_sec", "speaker")
