"""The k most similar vectors for every vector of a collection.

An inverted file of spherical k-means cells narrows the search. Inside a block
of a cell the rows are held as four-bit codes (32 subspaces of two dimensions,
16 centres each) that were chosen by a score-aware anisotropic loss: the error
parallel to the vector, which shifts inner products most, costs more than the
error across it. Queries scan the codes by table look-up, and every row whose
approximate score comes near the threshold is reranked with the exact cosine.

Scale. Centroids and codebooks are fitted on a bounded, hash-chosen sample
(``SAMPLE_BOUND`` rows); every row is indexed and every row is a query. Exact
copies of a vector are one class and are compared once; a class of any size
costs a row per member. A cell is cut into blocks of about ``BLOCK_ROWS`` rows
by a salt, to each of which its queries go, so no task holds a whole hot cell.
Per query and block only the best k + 1 classes leave a task.

Accuracy. ``probes`` cells are searched for each vector, and a pair found from
either side counts for both. Against brute force on the test tables more than
0.99 of the pairs are found (tests/llm/test_vector_neighbors.py).

Defined results: null, short, long, all-zero or not finite vectors are left out
(``usable``); a null id is left out; ties in the rounded similarity go to
the smaller id; a repeated (id, vector) row counts once; empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataloom.functions.vectors import usable

SAMPLE_BOUND = 65_536
CELL_ROWS = 512
MAX_CELLS = 4_096
BLOCK_ROWS = 4_096
SUB, CENTRES = 32, 16
#: What the approximate score may lie below the exact one and still be reranked.
SLACK = 0.22
#: Candidate pairs of a block after which only the best of each query and of each row are kept.
PRUNE_PAIRS = 2_000_000


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)  # lengths near the ends of the number range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_cells(x: np.ndarray, cells: int, rounds: int = 6) -> np.ndarray:
    """Unit centroids of spherical k-means; the start is spread evenly over the sample."""
    centres = x[np.linspace(0, len(x) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        sums = np.zeros_like(centres)
        for part in np.array_split(x, max(1, len(x) // 8192)):
            best = (part @ centres.T).argmax(axis=1)
            order = np.argsort(best, kind="stable")
            hit, starts = np.unique(best[order], return_index=True)
            sums[hit] += np.add.reduceat(part[order], starts, axis=0)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centres)
    return centres.astype(np.float32)


def parallel_weight(dim: int, threshold: float = 0.2) -> float:
    """How many times more an error parallel to the vector costs than one across it, for scores above ``threshold``."""
    return (dim - 1) * threshold**2 / (1 - threshold**2)


def encode_codes(x: np.ndarray, books: np.ndarray, weight: float, rounds: int = 1) -> np.ndarray:
    """Codes (rows, SUB) by coordinate descent on the anisotropic loss |r|^2 + (weight - 1) (r.x)^2."""
    n, dim = x.shape
    width = dim // SUB
    parts = x.reshape(n, SUB, width)
    code = np.empty((n, SUB), dtype=np.uint8)
    for s in range(SUB):
        code[:, s] = ((parts[:, s, None, :] - books[s][None]) ** 2).sum(-1).argmin(1)
    chosen = books[np.arange(SUB)[None], code]
    along = ((parts - chosen) * parts).sum((1, 2))
    for _ in range(rounds):
        for s in range(SUB):
            rest = parts[:, s, None, :] - books[s][None]
            own = ((parts[:, s] - books[s][code[:, s]]) * parts[:, s]).sum(1)
            par = (along - own)[:, None] + (rest * parts[:, s, None, :]).sum(-1)
            best = ((rest**2).sum(-1) + (weight - 1) * par**2).argmin(1)
            along = par[np.arange(n), best]
            code[:, s] = best
    return code


def anisotropic_codebooks(x: np.ndarray, rounds: int = 3) -> np.ndarray:
    """Codebooks (SUB, CENTRES, dim / SUB) under the anisotropic loss.

    For fixed codes each centre is moved to the minimum of the loss of its rows, the other
    subspaces held: a small linear system per centre.
    """
    n, dim = x.shape
    width, weight = dim // SUB, parallel_weight(dim)
    parts = x.reshape(n, SUB, width)
    spread = np.linspace(0, n - 1, CENTRES).astype(int)
    books = np.stack([parts[np.argsort(parts[:, s, s % width], kind="stable")[spread], s] for s in range(SUB)]).astype(np.float64)
    for s in range(SUB):
        for _ in range(5):
            best = ((parts[:, s, None, :] - books[s][None]) ** 2).sum(-1).argmin(1)
            for c in range(CENTRES):
                if (best == c).any():
                    books[s, c] = parts[best == c, s].mean(0)
    for _ in range(rounds):
        code = encode_codes(x, books, weight)
        along = ((parts - books[np.arange(SUB)[None], code]) * parts).sum((1, 2))
        for s in range(SUB):
            p = parts[:, s]
            others = along - ((p - books[s][code[:, s]]) * p).sum(1)
            for c in range(CENTRES):
                rows = code[:, s] == c
                if rows.any():
                    q, o = p[rows], others[rows] + (p[rows] ** 2).sum(1)
                    left = rows.sum() * np.eye(width) + (weight - 1) * q.T @ q
                    books[s, c] = np.linalg.solve(left, q.sum(0) + (weight - 1) * q.T @ o)
            along = others + ((p - books[s][code[:, s]]) * p).sum(1)
    return books.astype(np.float32)


def scan_tables(queries: np.ndarray, codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Approximate scores (queries, rows): two four-bit codes at a time index a table of 256 sums."""
    k, width = len(queries), books.shape[2]
    table = np.einsum("ksw,scw->ksc", queries.reshape(k, SUB, width), books)
    score = np.zeros((k, len(codes)), dtype=np.float32)
    for s in range(0, SUB, 2):
        pair = (table[:, s, :, None] + table[:, s + 1, None, :]).reshape(k, CENTRES * CENTRES)
        score += pair[:, codes[:, s].astype(np.intp) * CENTRES + codes[:, s + 1]]
    return score


def block_pairs(ids: np.ndarray, x: np.ndarray, is_row: np.ndarray, books: np.ndarray, floor: float, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, other, similarity) of one block: the ``keep`` best rows of each query and the best queries of each row."""
    rows = np.flatnonzero(is_row)
    none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    if not len(rows):
        return none
    unit = _unit(x)
    codes = encode_codes(unit[rows], books, parallel_weight(x.shape[1]))
    small = unit.astype(np.float32)
    left, right, sims = [], [], []
    step = max(1, 4_000_000 // len(rows))
    for begin in range(0, len(ids), step):
        near_q, near_r = np.nonzero(scan_tables(small[begin : begin + step], codes, books) >= floor - SLACK)
        for cut in range(0, len(near_q), 200_000):
            q, r = near_q[cut : cut + 200_000] + begin, rows[near_r[cut : cut + 200_000]]
            exact = np.round((unit[q] * unit[r]).sum(1), 6)
            ok = (exact >= floor) & (ids[q] != ids[r])
            left.append(ids[q[ok]])
            right.append(ids[r[ok]])
            sims.append(exact[ok])
        if sum(map(len, left)) > PRUNE_PAIRS:
            a, b, s = map(np.concatenate, (left, right, sims))
            best = np.union1d(_best_at(a, b, s, keep), _best_at(b, a, s, keep))
            left, right, sims = [a[best]], [b[best]], [s[best]]
    if not left:
        return none
    a, b, s = map(np.concatenate, (left, right, sims))
    one, two = _best(a, b, s, keep), _best(b, a, s, keep)
    return tuple(np.concatenate(v) for v in zip(one, two))


def _best_at(a: np.ndarray, b: np.ndarray, s: np.ndarray, keep: int) -> np.ndarray:
    """Places of the ``keep`` best of each ``a``."""
    order = np.lexsort((b, -s, a))
    a = a[order]
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.empty(0, int)
    place = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)]))
    return order[place < keep]


def _best(a: np.ndarray, b: np.ndarray, s: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = _best_at(a, b, s, keep)
    return a[at], b[at], s[at]


def _fit(vectors: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Centroids, salts per cell and codebooks from the bounded sample."""
    n = vectors.count()
    if not n:
        return None
    cells = int(min(MAX_CELLS, max(1, n // CELL_ROWS)))
    want = min(n, SAMPLE_BOUND, max(8_192, 64 * cells))
    chosen = vectors if want == n else vectors.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_050_000 * want / n) + 1)
    rows = chosen.select("v").limit(SAMPLE_BOUND).toArrow().column("v").combine_chunks()
    if not len(rows):
        return np.eye(1, dim, dtype=np.float32), np.array([1 + n // BLOCK_ROWS]), anisotropic_codebooks(np.eye(dim))
    x = _unit(rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dim))
    x = x[np.lexsort((x[:, 1], x[:, 0]))]
    centres = spherical_cells(np.unique(x, axis=0), cells)
    share = np.bincount((x.astype(np.float32) @ centres.T).argmax(1), minlength=len(centres)) / len(x)
    return centres, np.ceil(share * n / BLOCK_ROWS).clip(1).astype(np.int64), anisotropic_codebooks(x[:: max(1, len(x) // 8_192)])


def nearest_neighbors(vectors: DataFrame, id_col: str, vector_col: str, k: int = 5, floor: float = 0.9, dim: int = 64, probes: int = 3) -> DataFrame:
    """(id, neighbor, similarity): up to ``k`` most similar others of each vector, at or above ``floor``."""
    spark: SparkSession = vectors.sparkSession
    clean = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v"), dim).isNotNull())
    made = _fit(clean, dim)
    if made is None:
        return spark.createDataFrame([], "id bigint, neighbor bigint, similarity double")
    shared = spark.sparkContext.broadcast(made)
    # A class of exact copies is known by two independent hashes of its numbers.
    keyed = clean.withColumn("k1", F.xxhash64("v")).withColumn("k2", F.hash("v", F.lit(7)))
    copies = keyed.select("k1", "k2", "id").distinct()
    classes = keyed.groupBy("k1", "k2").agg(F.min(F.struct("id", "v")).alias("m")).select(F.col("m.id").alias("id"), F.col("m.v").alias("v"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, salts, _ = shared.value
        take = min(probes, len(centres))
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float32)
            score = _unit(x).astype(np.float32) @ centres.T
            near = np.argpartition(-score, take - 1, axis=1)[:, :take]
            best = score.argmax(1)
            # Own cell and salt: row and query at once; all other blocks of the searched cells: query.
            cell = near.ravel()
            who = np.repeat(np.arange(len(ids)), take)
            count = salts[cell]
            who, cell = np.repeat(who, count), np.repeat(cell, count)
            salt = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
            row = (cell == best[who]) & (salt == ids[who] % salts[cell])
            flat = pa.array(x[who].ravel(), pa.float32())
            vec = pa.ListArray.from_arrays(pa.array(np.arange(0, len(who) * dim + 1, dim, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(salt.astype(np.int32)), pa.array(row), pa.array(ids[who]), vec], names=["cell", "salt", "is_row", "id", "v"])

    def search(part: pa.Table) -> pa.Table:
        ids = part.column("id").to_numpy()
        x = part.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        a, b, s = block_pairs(ids, x, part.column("is_row").to_numpy(), shared.value[2], floor, k + 1)
        return pa.table({"id": a, "other": b, "similarity": s})

    assigned = classes.mapInArrow(assign, "cell int, salt int, is_row boolean, id bigint, v array<float>")
    found = assigned.groupBy("cell", "salt").applyInArrow(search, "id bigint, other bigint, similarity double")
    best = Window.partitionBy("id").orderBy(F.col("similarity").desc(), "other")
    links = found.distinct().withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r")

    # Members of a class: the k + 1 smallest ids are all that any list can need.
    by_id = Window.partitionBy("k1", "k2").orderBy("id")
    first = copies.withColumn("r", F.row_number().over(by_id)).filter(F.col("r") <= k + 1)
    small = first.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("class", F.col("ids")[0])
    repeated = small.filter("size(ids) > 1").select("class", "ids")
    own = repeated.select(F.col("class").alias("id"), F.explode("ids").alias("neighbor"), F.lit(1.0).alias("similarity"))
    others = links.join(repeated, F.col("other") == F.col("class"), "left").select("id", F.explode(F.coalesce("ids", F.array("other"))).alias("neighbor"), "similarity")
    order = Window.partitionBy("id").orderBy(F.col("similarity").desc(), "neighbor")
    lists = own.unionByName(others).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1)
    # A class with one member keeps its own list; the members of the others each get the class's list.
    members = copies.join(small.filter("size(ids) > 1").select("k1", "k2", "class"), ["k1", "k2"]).select("class", F.col("id").alias("member"))
    spread = lists.join(members, lists["id"] == members["class"], "left").select(F.coalesce("member", "id").alias("id"), "neighbor", "similarity").filter("id <> neighbor")
    last = Window.partitionBy("id").orderBy(F.col("similarity").desc(), "neighbor")
    return spread.withColumn("r", F.row_number().over(last)).filter(F.col("r") <= k).drop("r")


def neighbor_pairs(neighbors: DataFrame) -> DataFrame:
    """Unordered pairs (id_a < id_b) of a neighbour list."""
    return neighbors.select(F.least("id", "neighbor").alias("id_a"), F.greatest("id", "neighbor").alias("id_b")).distinct()
