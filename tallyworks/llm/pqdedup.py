"""Near-duplicate vectors by product quantisation: inverted lists, residual codes, table-lookup distances, exact cosine.

A coarse quantiser and the codebooks of the residuals' subspaces are fitted on a bounded sample (fit_rows). Every vector is
indexed in its cell once, with its residual's codes and how far they lie from it. Every vector also
visits its nearest cells (probes). There, distances from the query to the coded vectors come from one table
per subspace; a pair goes on if that distance, less the coding error, is within reach, so codes lose no pair; the rest
is decided by the exact cosine in double precision. Only missed cells can lose a link (recall is measured in
the tests and in the README).

Equal vectors of a label are one vector with a count. Large cells are dealt in blocks, and a group of vectors that
all link leaves a task as counts and a spanning star, not as pairs.

Null labels link with nothing, nor do vectors that are null, zero, hold null or non-finite components, or have
another length than most: no links, component of their own. A null vec_id has no links and a null
component and is kept. Repeated rows are vectors of their own, and so are rows that share a vec_id: they link, or not, by their
vectors, and only the smallest vec_id that each reaches is looked up. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small
from .components import components
from .vectors import dimension, kmeans, matrix, nearest, sample, scaled, squared, unit_rows, usable

FOUND = "id long, n long, root long"


class Index:
    """Coarse centres and the codebooks of residuals."""

    def __init__(self, unit: np.ndarray, cells: int, subspaces: int, codes: int, seed: int = 3):
        self.centres = kmeans(unit, cells, seed)
        residual = unit - self.centres[nearest(unit, self.centres)]
        self.cuts = [c for c in np.array_split(np.arange(unit.shape[1]), min(subspaces, unit.shape[1]))]
        self.books = [kmeans(residual[:, c], codes, seed + i) for i, c in enumerate(self.cuts, 1)]

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes = np.stack([nearest(residual[:, c], b) for c, b in zip(self.cuts, self.books, strict=True)], axis=1)
        back = np.empty_like(residual)
        for i, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            back[:, c] = b[codes[:, i]]
        return codes.astype(np.uint8), np.sqrt(((residual - back) ** 2).sum(1))

    def distances(self, query_residual: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """From each query to each coded vector, by table lookup."""
        d = np.zeros((len(query_residual), len(codes)))
        for i, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            d += squared(query_residual[:, c], b)[:, codes[:, i]]
        return np.sqrt(d)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that each of 0..n-1 reaches over links (a, b)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all():
            return root


def link(vectors: DataFrame, threshold: float = 0.98, fit_rows: int = 20_000, probes: int = 8, subspaces: int = 16, codes: int = 64, block: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding, label)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), "embedding").withColumn("ok", usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    valid = rows.filter("ok")
    size = dimension(valid, "embedding")
    key = F.xxhash64("embedding")
    one = valid.filter(F.size("embedding") == size).withColumn("h", key).groupBy("label", "h", "embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("times"))
    one = cut(one.withColumn("id", F.monotonically_increasing_id()))  # a number for each distinct vector, fixed by the write
    total = one.count()
    if total == 0:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    reach = float(np.sqrt(2 - 2 * threshold))
    fit = unit_rows(sample(one, "embedding", fit_rows))
    n_cells = int(max(1, min(2048, len(fit) // 8, round(total**0.5 / 2))))
    index = Index(fit, n_cells, subspaces, codes)

    def visit(batches):
        """A row in its own cell (home), with its codes and their error, and one in each other cell it probes."""
        for b in batches:
            unit = unit_rows(matrix(b["embedding"]))
            order = np.argsort(squared(unit, index.centres), axis=1, kind="stable")[:, :probes]
            codes_, error = index.encode(unit - index.centres[order[:, 0]])
            n = order.shape[1]
            at = np.repeat(np.arange(len(b)), n)
            home = np.tile(np.arange(n) == 0, len(b))
            own = [c.tobytes() for c in codes_]
            yield pd.DataFrame({"label": b["label"].to_numpy()[at], "cell": order.ravel(), "home": home, "own": order[:, 0][at], "probed": [order[i].astype("<i4").tobytes() for i in at],
                                "codes": [own[i] if h else None for i, h in zip(at.tolist(), home.tolist(), strict=True)], "error": np.where(home, error[at], np.nan),
                                "id": b["id"].to_numpy()[at], "times": b["times"].to_numpy()[at], "embedding": b["embedding"].to_numpy()[at]})

    label, kind = one.schema["label"].dataType.simpleString(), one.schema["embedding"].dataType.simpleString()
    visits = cut(one.select("label", "id", "times", "embedding").mapInPandas(visit, f"label {label}, cell long, home boolean, own long, probed binary, codes binary, error double, id long, times long, embedding {kind}"))
    # a cell of many rows is dealt in blocks of stored vectors by blocks of visitors
    sizes = visits.groupBy(F.col("label").alias("l"), F.col("cell").alias("c")).agg(
        F.ceil(F.sum(F.col("home").cast("int")) / block).cast("int").alias("stored"), F.ceil(F.count(F.lit(1)) / (4 * block)).cast("int").alias("asking")).filter("stored > 0")
    v = visits.join(small(sizes), (F.col("label") == F.col("l")) & (F.col("cell") == F.col("c"))).drop("l", "c")
    spread = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), n.cast("long")).cast("int")
    stored = v.filter("home").withColumn("i", spread(F.col("stored"), 1)).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("asking") - 1)))
    asking = v.select(*[F.col(c).alias(c) for c in v.columns if c not in ("codes", "error", "home")]).withColumn("j", spread(F.col("asking"), 2)).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("stored") - 1)))

    def compare(key: tuple, s: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(s) or not len(q):
            return pd.DataFrame({"id": [], "n": [], "root": []}).astype("int64")
        cell = int(key[1])
        x, y = scaled(matrix(s["embedding"])), scaled(matrix(q["embedding"]))
        xn, yn = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
        centre = index.centres[cell]
        codes_, error = np.frombuffer(b"".join(s["codes"]), np.uint8).reshape(len(s), -1), s["error"].to_numpy()
        sid, qid, qown = s["id"].to_numpy(), q["id"].to_numpy(), q["own"].to_numpy()
        sw, qw = s["times"].to_numpy(), q["times"].to_numpy()
        probed = np.frombuffer(b"".join(s["probed"]), "<i4").reshape(len(s), -1)
        ids = np.unique(np.r_[sid, qid])
        ns, nq = np.searchsorted(ids, sid), np.searchsorted(ids, qid)
        n = np.zeros(len(ids), np.int64)
        root = np.arange(len(ids))
        for i in range(0, len(q), 512):
            d = index.distances(y[i:i + 512] / yn[i:i + 512, None] - centre, codes_)
            a, b = np.nonzero(d <= reach + error + 1e-9)
            a += i
            if len(a):
                cos = np.concatenate([np.einsum("ij,ij->i", y[a[k:k + 65536]], x[b[k:k + 65536]]) for k in range(0, len(a), 65536)]) / (yn[a] * xn[b])
                use = (cos >= threshold) & (qid[a] != sid[b])
                # two of one cell meet twice; two of different cells maybe in both, then the smaller cell counts
                same = qown[a] == cell
                use &= np.where(same, qid[a] < sid[b], ~((probed[b] == qown[a][:, None]).any(1) & (qown[a] < cell)))
                a, b = a[use], b[use]
                np.add.at(n, nq[a], sw[b])
                np.add.at(n, ns[b], qw[a])
                root = _roots(len(ids), np.r_[nq[a], np.arange(len(ids))], np.r_[ns[b], root])
        hit = n > 0
        return pd.DataFrame({"id": ids[hit], "n": n[hit], "root": ids[root[hit]]})

    by = ["label", "cell", "i", "j"]
    found = cut(stored.groupBy(*by).cogroup(asking.groupBy(*by)).applyInPandas(compare, FOUND))
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    comp = components(found.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    nodes = one.select(F.col("id").alias("node"), "first").join(comp, F.col("node") == F.col("vertex"))
    smallest = nodes.groupBy(F.col("component").alias("of")).agg(F.min("first").alias("least"))
    least = nodes.join(smallest, F.col("component") == F.col("of")).select("vertex", "least")
    named = one.select(F.col("label").alias("l"), F.col("h").alias("hh"), F.col("embedding").alias("e"), F.col("id").alias("rid"), "first", "times").join(links, F.col("rid") == F.col("id"), "left").join(least, F.col("rid") == F.col("vertex"), "left").select(
        "l", "hh", "e", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("least", "first").alias("c"))
    out = rows.join(named, F.col("ok") & (F.col("label") == F.col("l")) & (key == F.col("hh")) & (F.col("embedding") == F.col("e")), "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
