"""Embedding near-duplicates over an inverted multi-index.

Two independent codebooks, one for each half of the (unit) vectors, form a
product grid of cells. A vector is filed in the cell of its nearest pair of
centroids; as a query it visits cells by multi-sequence traversal: in order of
the least distance the two halves must go to enter the cell, up to a reach
that is set for a target recall. Two vectors meet if either visits the other's
cell, and every meeting is verified by its cosine in double precision.

*Recall.* The reach is the quantile, at ``recall``, of what partners at exactly
the threshold cosine need, measured on partners made in random directions
from the fitting sample (at most ``sample`` vectors; every vector is indexed).
Real links are closer, and either side's visit is enough.

*Scale.* The number of centroids follows the number of vectors, so a cell
holds about ``per_cell`` of a label. Equal vectors are one entry with a
multiplicity. Cells are cut into tiles of at most ``tile`` filed vectors by
4 x ``tile`` queries, so a crowded cell is many tasks; a tile returns counts
and a star of links, never its pairs.

Defined results: a vector that is null, zero or empty, or holds a null or
non-finite component links with nothing; so does one with a null label.
Vectors of several lengths link within each length, each with codebooks of its
own (some jobs a length). Rows are vectors: repeated rows are linked to each
other, and one vec_id may stand for several vectors. A very long vector is
one row. A row with a null vec_id counts as a vector, but can't name a component (null if
there is no other name) and is not kept. An empty table gives an empty
result. Extra input columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.components import components
from gazette.llm.joins import join_measured
from gazette.llm.simhash import least_labels
from gazette.session import cut_lineage

@dataclass
class Grid:
    """Codebooks (two arrays of centroids) and the squared reach."""
    books: tuple[np.ndarray, np.ndarray]
    reach: float = 0.0

    def entry(self, x: np.ndarray) -> list[np.ndarray]:
        """Per half, a lower bound of the squared distance from each vector
        to each centroid's region (0 for its own)."""
        out = []
        for half, book in zip(np.array_split(x, 2, axis=1), self.books, strict=True):
            d = (half ** 2).sum(1)[:, None] - 2 * half @ book.T + (book ** 2).sum(1)
            own = d.argmin(1)
            gap = np.sqrt(np.maximum(((book[:, None] - book[None]) ** 2).sum(2), 1e-300))
            low = np.maximum(d - d[np.arange(len(d)), own][:, None], 0) / (2 * gap[own])
            low[np.arange(len(d)), own] = 0
            out.append(low ** 2)
        return out

    def home(self, entry: list[np.ndarray]) -> np.ndarray:
        return (entry[0] == 0).argmax(1) * len(self.books[1]) + (entry[1] == 0).argmax(1)

    def visits(self, entry: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(vector, cell) by multi-sequence traversal: each vector takes the cells
        of the grid in order of their cost, from two sorted lists, until the next one
        lies beyond the reach. All vectors take a step at a time: for each place of
        the first list stands the next place of the second one that was not taken
        with it, and the least sum is taken."""
        first, second = (np.argsort(e, axis=1, kind="stable") for e in entry)
        a, b = np.take_along_axis(entry[0], first, 1), np.take_along_axis(entry[1], second, 1)
        b = np.concatenate([b, np.full((len(b), 1), np.inf)], axis=1)
        a = a[:, :max(1, int((a <= self.reach).sum(1).max(initial=1)))]  # no other place is ever taken
        following, live, rows, cells = np.zeros(a.shape, np.int64), np.arange(len(a)), [], []
        while len(live):
            cost = a[live] + np.take_along_axis(b[live], following[live], 1)
            i = cost.argmin(1)
            ok = cost[np.arange(len(live)), i] <= self.reach
            live, i = live[ok], i[ok]
            j = following[live, i]
            rows.append(live)
            cells.append(first[live, i] * len(self.books[1]) + second[live, j])
            following[live, i] = j + 1
        return (np.concatenate(rows), np.concatenate(cells)) if rows else (np.empty(0, np.int64),) * 2


def _centroids(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    if not x.shape[1]:  # vectors of one component have no second half
        return x[:1]
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = ((c ** 2).sum(1) - 2 * x @ c.T).argmin(1)
        n = np.bincount(near, minlength=k)
        total = np.stack([np.bincount(near, weights=x[:, d], minlength=k) for d in range(x.shape[1])], axis=1)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def fit(sample: np.ndarray, k: int, threshold: float, recall: float, seed: int = 7) -> Grid:
    """Codebooks and reach from unit vectors."""
    rng = np.random.default_rng(seed)
    k = min(k, len(sample))
    grid = Grid(tuple(_centroids(np.ascontiguousarray(h), k, rng) for h in np.array_split(sample, 2, axis=1)))
    x = sample[rng.integers(0, len(sample), 20_000)]
    away = rng.standard_normal(x.shape)
    away -= (away * x).sum(1)[:, None] * x
    away /= np.maximum(np.linalg.norm(away, axis=1), 1e-300)[:, None]
    y = threshold * x + np.sqrt(1 - threshold ** 2) * away
    from_x, from_y = grid.entry(x), grid.entry(y)
    row = np.arange(len(x))
    cost = sum(e[row, (o == 0).argmax(1)] for e, o in zip(from_x, from_y, strict=True))
    grid.reach = float(np.quantile(cost, recall))
    return grid


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)
    return x / np.linalg.norm(x, axis=1)[:, None]


def entries(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> tuple[DataFrame, DataFrame]:
    """All rows (vec_id, label, v, ok) and the distinct usable vectors
    (label, v, name, least_id, times); a name is a hash of label and vector."""
    v = F.transform(vectors[embedding], lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    rows = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), vectors[label].alias("label"), v.alias("v"),
                          F.coalesce(vectors[label].isNotNull() & finite & some, F.lit(False)).alias("ok"))
    rows = cut_lineage(rows)
    distinct = rows.where("ok").groupBy("label", "v").agg(
        F.min("vec_id").alias("least_id"), F.count("*").alias("times")).withColumn("name", F.xxhash64("label", "v"))
    return rows, cut_lineage(distinct)


def links(distinct: DataFrame, dim: int, threshold: float = 0.98, recall: float = 0.9999, per_cell: int = 256,
          sample: int = 20_000, tile: int = 2048) -> tuple[DataFrame, DataFrame]:
    """(name, others) with the linked vectors' multiplicities summed, and the
    star links (a, b)."""
    label_type = distinct.schema["label"].dataType.simpleString()
    n, labels = distinct.agg(F.count("*"), F.approx_count_distinct("label")).first()
    k = max(1, min(256, round((n / max(labels, 1) / per_cell) ** 0.5)))
    fitted = distinct.select("v", F.xxhash64("label", "v").alias("_h")).orderBy("_h").limit(sample).select("v").toArrow()
    unit = _unit(fitted.column("v").combine_chunks(), dim)
    grid = fit(unit, k, threshold, recall) if len(unit) else Grid((np.zeros((1, 1)), np.zeros((1, 1))))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                entry = grid.entry(_unit(batch.column(1), dim))
                row, cell = grid.visits(entry)
                home = grid.home(entry)[row]
                taken = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(cell), pa.array(home)], [*taken.schema.names, "cell", "home"])

    filed = cut_lineage(distinct.select("label", "v", "name", "times").mapInArrow(
        file, f"label {label_type}, v array<double>, name long, times long, cell long, home long"))
    is_home = F.col("cell") == F.col("home")
    cells = filed.groupBy(F.col("label").alias("_l"), F.col("cell").alias("_c")).agg(
        F.ceil(F.sum(is_home.cast("int")) / tile).cast("int").alias("_homes"), F.ceil(F.count("*") / (4 * tile)).cast("int").alias("_queries"))
    cells = cells.where("_homes > 0")
    q = join_measured(filed, cells, (F.col("label") == F.col("_l")) & (F.col("cell") == F.col("_c")), "inner")
    h = F.xxhash64("name")
    every = lambda size: F.sequence(F.lit(0), F.col(size) - 1)
    filed_rows = q.where(is_home).withColumn("_h", F.pmod(h, "_homes").cast("int")).withColumn("_q", F.explode(every("_queries"))).withColumn("filed", F.lit(True))
    asking = q.withColumn("_q", F.pmod(h, "_queries").cast("int")).withColumn("_h", F.explode(every("_homes"))).withColumn("filed", F.lit(False))
    both = filed_rows.select("label", "cell", "_h", "_q", "filed", "v", "name", "times", "home").unionByName(
        asking.select("label", "cell", "_h", "_q", "filed", "v", "name", "times", "home"))

    def verify(table: pa.Table) -> pa.Table:
        filed = table.column("filed").to_numpy()
        x = _unit(table.column("v").combine_chunks(), dim)
        name, times, home = (table.column(c).to_numpy() for c in ("name", "times", "home"))
        y, y_name, y_times = x[filed], name[filed], times[filed]
        ids, back = np.unique(name, return_inverse=True)
        y_back, others, pairs = back[filed], np.zeros(len(ids), np.int64), []
        side = len(grid.books[1])
        y_entry = grid.entry(y) if len(y) else None
        asking = np.flatnonzero(~filed)
        for at in range(0, len(asking) if len(y) else 0, 1024):
            mine = asking[at:at + 1024]
            a, b = np.nonzero(x[mine] @ y.T >= threshold)
            a = mine[a]
            # a pair that meets in both cells counts where its smaller name asks
            cell = home[a]
            meets_back = y_entry[0][b, cell // side] + y_entry[1][b, cell % side] <= grid.reach
            once = (name[a] != y_name[b]) & (~meets_back | (name[a] < y_name[b]))
            a, b = a[once], b[once]
            np.add.at(others, back[a], y_times[b])
            np.add.at(others, y_back[b], times[a])
            pairs.append((back[a], y_back[b]))
        label = least_labels(len(ids), iter(pairs))
        some = np.flatnonzero(others)
        return pa.table({"name": ids[some], "others": others[some], "least": ids[label[some]]})

    found = cut_lineage(both.groupBy("label", "cell", "_h", "_q").applyInArrow(verify, "name long, others long, least long"))
    counts = found.groupBy("name").agg(F.sum("others").alias("others"))
    return counts, found.where("name <> least").select(F.col("name").alias("a"), F.col("least").alias("b"))


def near_duplicate_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
                           label: str = "label", threshold: float = 0.98, **params) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per vector."""
    rows, distinct = entries(vectors, vec_id, embedding, label)
    # vectors of each length meet by codebooks of their own
    lengths = [r[0] for r in distinct.select(F.size("v")).distinct().collect()]
    found = [links(distinct.where(F.size("v") == dim), dim, threshold, **params) for dim in sorted(lengths)]
    if not found:
        found = [links(distinct, 0, threshold, **params)]
    counts, pairs = found[0]
    for more_counts, more_pairs in found[1:]:
        counts, pairs = counts.union(more_counts), pairs.union(more_pairs)
    named = distinct.join(counts.withColumnRenamed("name", "_a"), F.col("name") == F.col("_a"), "left")
    named = cut_lineage(named.join(components(pairs), F.col("name") == F.col("node"), "left").select(
        F.col("label").alias("_label"), F.col("v").alias("_v"),
        (F.coalesce("others", F.lit(0)) + F.col("times") - 1).alias("n_links"), "least_id",
        F.coalesce("component", "name").alias("_root")))
    smallest = cut_lineage(named.groupBy(F.col("_root").alias("_of")).agg(F.min("least_id").alias("_component")))
    named = named.join(smallest, F.col("_root") == F.col("_of")).select("_label", "_v", "n_links", "_component", F.lit(True).alias("_linked"))
    out = rows.join(cut_lineage(named), (F.col("ok")) & (F.col("label") == F.col("_label")) & (F.col("v") == F.col("_v")), "left")
    component = F.when(F.col("_linked"), F.col("_component")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id")).withColumn(
                          "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
