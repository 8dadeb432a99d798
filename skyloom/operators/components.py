"""Connected components and one-to-one assignment of a candidate graph."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.plans.lineage import release, shared_table

#: Fixed values of the cost model: position and magnitude spread, the cost of an unknown magnitude, and of no match.
SIGMA_POS, SIGMA_MAG, UNKNOWN_COST, NO_MATCH = 60.0, 0.5, 8.0, 69.0
SMALL = 5
#: Cells of a cost matrix that one task holds, and by how much the auction's margin falls.
DENSE_CELLS, MARGIN_STEP = 4_000_000, 8
#: Cells of a matrix up to which lists are faster than arrays.
LISTED_CELLS = 400
#: Places of a cost that the auction counts.
DIGITS = 6


def edge_cost(theta: str = "dist", mag_a: str = "l_mag", mag_b: str = "r_mag") -> str:
    """-log likelihood of a pair up to constants; a NULL magnitude is unknown."""
    return f"{theta}*{theta} / {2 * SIGMA_POS**2!r}D + coalesce(({mag_a} - {mag_b}) * ({mag_a} - {mag_b}) / {2 * SIGMA_MAG**2!r}D, {UNKNOWN_COST!r}D)"


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """node, least: the least node that is reachable, for all nodes but the least ones themselves. ``edges`` has two long columns, a and b, in any direction.

    Alternating large-star and small-star steps: each node's least neighbour is found by grouped
    aggregation and joined back, so no neighbour list is ever built. Every round ends in a shared table;
    it stops when only stars are left, after a number of rounds that grows with the logarithm of
    the edges.
    """
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    down = shared_table(down, f"{label}-edges", small=True)
    while True:
        both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        before, down = down, shared_table(small.filter("u <> v").distinct(), f"{label}-stars", small=True)
        release(before)
        # stars: each node has one edge, and no node that others lead to leads on
        links = down.select("u", F.lit(1).alias("_out"), F.lit(0).alias("_in")).unionByName(down.select(F.col("v").alias("u"), F.lit(0).alias("_out"), F.lit(1).alias("_in")))
        if links.groupBy("u").agg(F.sum("_out").alias("_out"), F.max("_in").alias("_in")).filter("_out > 1 or _out = 1 and _in = 1").isEmpty():
            return down.select(F.col("u").alias("node"), F.col("v").alias("least"))


def hungarian(cost: np.ndarray) -> list[tuple[int, int]]:
    """Least-cost assignment of all rows (at most as many as columns), by shortest augmenting paths."""
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, way = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while True:
            used[j0] = True
            i0 = match[j0]
            reduced = cost[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better] = reduced[better]
            way[1:][better] = j0
            free = np.where(used[1:], np.inf, least[1:])
            j1 = int(np.argmin(free)) + 1
            delta = free[j1 - 1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]


def _paths(cost: list[list[float]]) -> list[tuple[int, int]]:
    """hungarian() on plain lists: the same steps and choices, for matrices so small that each array operation would cost more than its work."""
    n, m = len(cost), len(cost[0])
    u, v, match = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, way = [math.inf] * (m + 1), [False] * (m + 1), [0] * (m + 1)
        while True:
            used[j0] = True
            i0 = match[j0]
            row, ui, delta, j1 = cost[i0 - 1], u[i0], math.inf, 0
            for j in range(1, m + 1):
                if not used[j]:
                    reduced = row[j - 1] - ui - v[j]
                    if reduced < least[j]:
                        least[j], way[j] = reduced, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]


def _solve(lefts: list[int], rights: list[int], costs: list[float], partial: bool) -> list[tuple[int, int, float]]:
    """The matches (l, r, cost) of one component's edges."""
    left, right = sorted(set(lefts)), sorted(set(rights))
    flip = len(left) > len(right)
    if flip:
        left, right, lefts, rights = right, left, rights, lefts
    small = len(left) <= SMALL
    whole = small and not partial  # the whole smaller side is matched, or nothing is
    none = 1e9 if whole else NO_MATCH
    best: dict[tuple[int, int], float] = {}
    rows, columns = {x: i for i, x in enumerate(left)}, {x: i for i, x in enumerate(right)}
    for a, b, c in zip(lefts, rights, costs):
        k = rows[a], columns[b]
        if c < best.get(k, NO_MATCH):
            best[k] = c
    if len(left) * len(right) <= LISTED_CELLS:
        matrix = [[none] * len(right) for _ in left]
        for (i, j), c in best.items():
            matrix[i][j] = c
        pairs = _paths(matrix)
    else:
        cost = np.full((len(left), len(right)), none)
        for k, c in best.items():
            cost[k] = c
        pairs = hungarian(cost)
    found = [(i, j) for i, j in pairs if (i, j) in best]
    if whole and len(found) < len(pairs):
        return []
    return [(right[j], left[i], best[i, j]) if flip else (left[i], right[j], best[i, j]) for i, j in found]


def _solved(edges: DataFrame, partial: bool) -> DataFrame:
    """component, l, r, cost of the matches of all components, each solved on its own.

    Edges stream through partitions sorted by component: a task holds one batch and one component, and a call to Python has many components.
    """
    names = ["component", "l", "r", "cost"]

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([(c, pa.float64() if c == "cost" else pa.int64()) for c in names])
        rest = None

        def solved(columns, last):
            at = np.flatnonzero(np.diff(columns[0])) + 1
            ends = [*at.tolist(), *([len(columns[0])] if last else [])]
            lists, out, start = [c.tolist() for c in columns], [], 0
            for end in ends:
                if end > start:
                    found = _solve(*(c[start:end] for c in lists[1:]), partial)
                    out += [(lists[0][start], *x) for x in found]
                start = end
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 4, schema)], schema=schema), start

        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            if not len(columns[0]):
                continue
            rest = [[c] for c in columns] if rest is None else [[*old, new] for old, new in zip(rest, columns)]
            if rest[0][0][0] == columns[0][-1]:
                continue  # one component so far
            columns = [np.concatenate(c) for c in rest]
            done, start = solved(columns, False)
            rest = [[c[start:]] for c in columns]
            yield done
        if rest is not None:
            yield solved([np.concatenate(c) for c in rest], True)[0]

    placed = edges.select(*names).repartition("component").sortWithinPartitions("component")
    return placed.mapInArrow(run, "component long, l long, r long, cost double")


def auction(edges: DataFrame, label: str = "auction", digits: int = DIGITS) -> DataFrame:
    """One-to-one matches of edges (l, r, cost) of least total cost, where a node without a match costs NO_MATCH once a pair; costs count to ``digits`` places.

    For components that no task holds. A match gains NO_MATCH - cost; so that all nodes can be matched, each gets a twin on the
    other side: l may take its twin for nothing, and the twins of a matched pair take each other. Persons bid for objects as
    whole numbers, with a margin that falls by MARGIN_STEP from phase to phase down to 1, where whole gains, multiplied by one
    more than the persons, make the result the best. A round is one plan: the free persons join their edges and the
    objects' prices, each bids for its best object by its lead over the second, each object takes its highest bid.
    """
    pairs = edges.groupBy("l", "r").agg(F.min("cost").alias("cost")).filter(F.col("cost") < NO_MATCH)
    gain = F.round((NO_MATCH - F.col("cost")) * 10**digits).cast("long")
    # persons: l and the twins of r; objects: r and the twins of l
    node = lambda kind, c: F.struct(F.lit(kind).alias("k"), F.col(c).alias("i"))
    graph = pairs.select(node(0, "l").alias("p"), node(0, "r").alias("o"), gain.alias("w"))
    graph = graph.unionByName(pairs.select(node(1, "r").alias("p"), node(1, "l").alias("o"), F.lit(0).cast("long").alias("w")))
    for kind, (c, d) in enumerate((("l", "l"), ("r", "r"))):
        own = pairs.select(c).distinct()
        graph = graph.unionByName(own.select(node(kind, c).alias("p"), node(1 - kind, d).alias("o"), F.lit(0).cast("long").alias("w")))
    graph = shared_table(graph, f"{label}-graph", small=True)
    persons = shared_table(graph.select("p").distinct(), f"{label}-persons", small=True)
    n = persons.count()
    graph = graph.withColumn("w", F.col("w") * (n + 1))
    margin = max(1, (graph.agg(F.max("w")).first()[0] or 0) // MARGIN_STEP)
    prices = shared_table(graph.select("o").distinct().withColumn("price", F.lit(0).cast("long")), f"{label}-prices", small=True)
    none = F.lit(None).cast(persons.schema["p"].dataType)
    while n:
        held = prices.withColumn("owner", none)
        while True:
            free = persons.join(held.select(F.col("owner").alias("p")), "p", "left_anti")
            offers = free.join(graph, "p").join(held.select("o", "price"), "o").withColumn("v", F.col("w") - F.col("price"))
            ranked = offers.withColumn("_n", F.row_number().over(Window.partitionBy("p").orderBy(F.desc("v"), "o"))).filter("_n < 3")
            best = ranked.groupBy("p").agg(F.max(F.when(F.col("_n") == 1, F.struct("o", "price", "v"))).alias("b"), F.min("v").alias("second"))
            bids = best.select(F.col("b.o").alias("o"), F.struct((F.col("b.price") + F.col("b.v") - F.col("second") + margin).alias("bid"), "p").alias("x"))
            taken = bids.groupBy("o").agg(F.max("x").alias("x"))
            after = held.join(taken, "o", "left").select("o", F.coalesce("x.bid", "price").alias("price"), F.coalesce("x.p", "owner").alias("owner"), F.col("x").isNotNull().alias("_new"))
            after = shared_table(after, f"{label}-round", small=True)
            done = after.filter("_new").isEmpty()
            release(held)
            held = after.drop("_new")
            if done:
                break
        if margin == 1:
            break
        margin = max(1, margin // MARGIN_STEP)
        prices = held.drop("owner")
    else:
        return pairs.limit(0)
    matched = held.filter("o.k = 0 and owner.k = 0").select(F.col("owner.i").alias("l"), F.col("o.i").alias("r"))
    return matched.join(pairs, ["l", "r"])


def assign(edges: DataFrame, partial: bool = False, cells: int = DENSE_CELLS, digits: int = DIGITS) -> DataFrame:
    """One-to-one matches of edges (l, r, cost) of least total cost in each component.

    Components whose matrix has at most ``cells`` cells, and those with a side of at most SMALL, are solved in tasks of their own;
    greater ones together by auction(), where no task holds one.
    """
    edges = shared_table(edges.select("l", "r", F.col("cost").cast("double").alias("cost")), "assign-pairs")  # a join on the sphere is made once
    graph = edges.select((F.col("l") * 2).alias("a"), (F.col("r") * 2 + 1).alias("b"))
    labels = components(graph, "assign")
    known = edges.withColumn("node", F.col("r") * 2 + 1).join(labels, "node", "left").select(F.coalesce("least", "node").alias("component"), "l", "r", "cost")

    # most components of a sparse sky are one edge, which needs no solver
    known = shared_table(known, "assign-edges")
    for done in (edges, labels):
        release(done)
    size = known.groupBy("component").agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("l").alias("_l"), F.count_distinct("r").alias("_r"))
    large = (F.col("_l") * F.col("_r") > cells) & (F.least("_l", "_r") > SMALL)
    size = shared_table(size.select("component", "_n", large.alias("_large")), "assign-sizes", small=True)
    single = known.join(size.filter("_n = 1").hint("merge"), "component").filter(F.col("cost") < NO_MATCH).drop("_n", "_large")
    rest = known.join(size.filter("_n > 1 and not _large").select("component").hint("merge"), "component")
    out = single.unionByName(_solved(rest, partial))
    if size.filter("_large").isEmpty():
        return out
    great = known.join(size.filter("_large").select("component"), "component")
    return out.unionByName(auction(great, digits=digits).join(great.select("component", "l").distinct(), "l").select("component", "l", "r", "cost"))


def component_sizes(labels: DataFrame) -> DataFrame:
    """Histogram of component sizes, from components()."""
    size = labels.groupBy("least").agg((F.count(F.lit(1)) + 1).alias("size"))
    return size.groupBy("size").agg(F.count(F.lit(1)).alias("n"))


