"""Joins on the sphere and by identifier. All are hash-partitioned equi-joins with an exact filter behind them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from skyloom.functions import sky
from skyloom.operators.order import fold, least_before
from skyloom.plans.lineage import release, shared_table

#: Position (arcsec) and magnitude limits by comparison.
THRESHOLDS = {
    "cd": (120.0, 1.5), "bd": (180.0, 0.4), "agk": (180.0, 1.0), "cpd": (180.0, None), "sd": (180.0, 0.8), "shared": (120.0, None),
    "gc": (20.0, 2.9), "gc_cd": (90.0, None), "doubles": (30.0, None), "guide": (20.0, None), "likelihood": (300.0, 3.0),
}


#: A level's cubes are so many times as wide as the next finer ones'; places of a cube beyond which finer ones are made, and the finest width.
STEP, CROWD, FINEST = 4, 256, 1e-8
#: Cubes are so many times as wide as the chord of the radius.
WIDTH = 4
#: Rows that nearest_anywhere() takes at a time, and rows of a block on average.
PORTION, BLOCK = 1_500_000, 1024
#: Cubes at most that the top of a pyramid has.
TOP = 64
#: Rows within the radius that the first band of magnitudes has for a place, and how the bands grow.
SEEN, GROWTH = 4, 8


def chord(radius: float) -> float:
    """The chord of an angle in arcseconds."""
    return 2 * math.sin(math.radians(radius / 3600) / 2)


def within(left: DataFrame, right: DataFrame, radius: float, many: str = "left") -> DataFrame:
    """All pairs closer than ``radius`` arcseconds: columns of both (l_ and r_ before the names), d2 and dist.

    Both sides have x, y, z. Space is cut into cubes of WIDTH times the radius' chord; a left point (a right one with ``many`` right) goes to the cubes that
    its surroundings touch (two an axis at most, 1.5 on average), the other side's to its own, then the cubes are an equi-join. Poles and
    the step from 360 to 0 degrees need no special case.
    """
    h = chord(radius)
    l, r = (df.select(*[F.col(c).alias(p + c) for c in df.columns]) for df, p in ((left, "l_"), (right, "r_")))  # noqa: E741
    l, r = _cubes(l, "l_", h, many == "left"), _cubes(r, "r_", h, many == "right")  # noqa: E741
    joined = l.join(r.hint("merge"), ["cx", "cy", "cz"]).drop("cx", "cy", "cz")
    d2 = F.expr(sky.chord_squared("l_", "r_"))
    return joined.withColumn("d2", d2).filter(F.col("d2") < h * h).withColumn("dist", F.expr(sky.arcsec("d2")))


def _cubes(df: DataFrame, p: str, h: float, around: bool) -> DataFrame:
    """``df`` with its points' cubes, or a row for each cube that a point's surroundings touch."""
    df = _placed(df, p)
    if not around:
        return df.withColumns({f"c{c}": F.floor(F.col(f"{p}{c}") / (WIDTH * h)) for c in "xyz"})
    for c in "xyz":
        df = df.withColumn(f"c{c}", F.explode(F.sequence(*[F.floor((F.col(f"{p}{c}") + s * h) / (WIDTH * h)) for s in (-1, 1)])))
    return df


def _placed(df: DataFrame, p: str = "") -> DataFrame:
    return df.filter(f"{p}x is not null and {p}y is not null and {p}z is not null")


def nearest(left: DataFrame, right: DataFrame, radius: float, key: list[str], order: str) -> DataFrame:
    """For each left row with a match its nearest right row; ties go to the least ``order`` of the right table.

    ``key`` and ``order`` tell the rows of their tables apart. Only they and the places are exploded and matched, and the least is
    found by partial aggregation, so a crowded place sends one row for each key and task; the other columns are joined back.
    """
    pairs = within(left.select(*key, "x", "y", "z"), right.select(F.col(order).alias("_order"), "x", "y", "z"), radius)
    best = pairs.groupBy(*[f"l_{k}" for k in key]).agg(F.min(F.struct("d2", "r__order")).alias("b"))
    best = best.select(*[F.col(f"l_{k}").alias(f"_k{i}") for i, k in enumerate(key)], F.col("b.d2").alias("d2"), F.col("b.r__order").alias("_order"))
    l, r = (df.select(*[F.col(c).alias(p + c) for c in df.columns]) for df, p in ((left, "l_"), (right, "r_")))  # noqa: E741
    same = F.lit(True)
    for i, k in enumerate(key):
        same = same & (F.col(f"l_{k}") == F.col(f"_k{i}"))
    out = l.join(best.hint("merge"), same).join(r.hint("merge"), F.col("_order") == F.col(f"r_{order}"))
    return out.select(*[f"l_{k}" for k in key], "d2", *[c for c in (*l.columns, *r.columns) if c not in {f"l_{k}" for k in key}], F.expr(sky.arcsec("d2")).alias("dist"))


def brightest(left: DataFrame, right: DataFrame, radius: float, key: str, order: str) -> DataFrame:
    """key, match, mag, d2: each left row's brightest right row within ``radius``; ties go to the nearer one, then to the least ``order``; unknown magnitudes come last.

    The right rows are taken in bands of magnitude, the brightest first and each GROWTH times as many as the band before. The first holds some
    SEEN rows within the radius of a place (by the area), so most rows find theirs there; only rows without a match go on to the next
    band, whose rows are all fainter. No row meets all that are within its radius.
    """
    rows = left.select(key, "x", "y", "z")
    stars = right.select(F.col(order).alias("match"), "mag", F.coalesce(F.col("mag").cast("double"), F.lit(math.inf)).alias("m"), "x", "y", "z")
    expected = right.count() * chord(radius) ** 2 / 4
    shares = [SEEN / expected * GROWTH**k for k in range(64)] if expected > SEEN else []
    shares = [s for s in shares if s < 1]
    cuts = sorted(set(stars.select(F.percentile_approx("m", F.array(*map(F.lit, shares)), 10000)).first()[0] or [])) if shares else []
    found = None
    for low, high in zip([None, *cuts], [*cuts, None]):
        band = stars if low is None else stars.filter(F.col("m") > low)
        pairs = within(rows, band if high is None else band.filter(F.col("m") <= high), radius)
        best = pairs.groupBy(F.col(f"l_{key}").alias(key)).agg(F.min(F.struct("r_m", "d2", "r_match", "r_mag")).alias("b"))
        best = best.select(key, F.col("b.r_match").alias("match"), F.col("b.r_mag").alias("mag"), F.col("b.d2").alias("d2"))
        if high is not None:
            best = shared_table(best, "brightest", small=True)
            rows = rows.join(best.select(key).hint("merge"), key, "left_anti")
        found = best if found is None else found.unionByName(best)
    return found


def id_nearest(left: DataFrame, right: DataFrame, keys: list[str], row: str, order: str) -> DataFrame:
    """Equi-join on an identifier; among duplicates the nearest. Adds r_ columns and dist; a miss drops the row."""
    l = left.select(*[F.col(c).alias(c if c in keys else f"l_{c}") for c in left.columns])  # noqa: E741
    r = right.select(*[F.col(c).alias(c if c in keys else f"r_{c}") for c in right.columns])
    pairs = l.join(r, keys).withColumn("d2", F.expr(sky.chord_squared("l_", "r_")))
    best = pairs.groupBy(f"l_{row}").agg(F.min(F.struct("d2", f"r_{order}")).alias("b"), F.count(F.lit(1)).alias("candidates"))
    return best.select(f"l_{row}", F.col(f"b.r_{order}").alias(f"r_{order}"), F.expr(sky.arcsec("b.d2")).alias("dist"), "candidates")


def keep_nearest_in_order(rows: DataFrame, target: str, order: str, dist: str) -> DataFrame:
    """Greedy one-to-one: in order, a row enters only if strictly nearer than all before it; those that lose later are ``discard``."""
    entered = least_before(rows, [target], [order], dist, "_before").filter(F.col("_before").isNull() | (F.col(dist) < F.col("_before"))).drop("_before")
    best = entered.groupBy(target).agg(F.min(dist).alias("_best"))
    return entered.join(best, target).withColumn("discard", F.col(dist) > F.col("_best")).drop("_best")


def adjacent(left: DataFrame, right: DataFrame, zone: str, number: str, row: str) -> DataFrame:
    """Join on number and zone, zone - 1 or zone + 1 (in this order on ties); the nearest overall and in the same zone."""
    step = F.explode(F.expr("array(struct(0 AS d, 0 AS o), struct(-1 AS d, 1 AS o), struct(1 AS d, 2 AS o))"))
    l = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns]).withColumn("_s", step)  # noqa: E741
    l = l.withColumn("_zone", F.col(f"l_{zone}") + F.col("_s.d")).withColumn("_number", F.col(f"l_{number}"))  # noqa: E741
    r = right.select(F.col(zone).alias("_zone"), F.col(number).alias("_number"), *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in (zone, number)])
    pairs = l.join(r, ["_zone", "_number"]).withColumn("d2", F.expr(sky.chord_squared("l_", "r_")))
    key = F.struct("d2", F.col("_s.o").alias("o"), F.col(f"r_{row}").alias("r"), F.col("_zone").alias("zone"))
    best = pairs.groupBy(f"l_{row}", f"l_{zone}").agg(F.min(key).alias("b"), F.min(F.when(F.col("_s.o") == 0, F.col("d2"))).alias("same"))
    return best.select(f"l_{row}", F.col("b.r").alias(f"r_{row}"), F.expr(sky.arcsec("b.d2")).alias("dist"), F.expr(sky.arcsec("same")).alias("same_zone_dist"), (F.col("b.zone") != F.col(f"l_{zone}")).alias("other_zone"))


def either_way(mapping: DataFrame, source: str, target: str) -> DataFrame:
    """Rows of a mapping table that may have its two sides swapped: (source id, target id) by their codes."""
    forward = (F.col("code") == source) & (F.col("target_code") == target)
    back = (F.col("code") == target) & (F.col("target_code") == source)
    pick = lambda a, b: F.when(forward, F.col(a)).otherwise(F.col(b))
    return mapping.filter(forward | back).select("line", pick("id", "target_id").alias("source_id"), pick("target_id", "id").alias("target_id"))


def last_writer(mapping: DataFrame, key: str, value: str, order: str = "line") -> DataFrame:
    """Later rows overwrite earlier ones."""
    return mapping.groupBy(key).agg(F.max(F.struct(order, value)).alias("_m")).select(key, F.col(f"_m.{value}").alias(value))


def first_registered(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, with ``n`` (how often it came)."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_f"), F.count(F.lit(1)).alias("n"))
    return best.select(*keys, *[F.col(f"_f.{c}").alias(c) for c in rest], "n")


def cascade(df: DataFrame, levels: list[tuple[str, Column, Column]]) -> DataFrame:
    """The first level whose condition holds names the row: ``source`` and ``name``; a null name falls through."""
    source, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for label, condition, value in reversed(levels):
        hit = condition & value.isNotNull()
        source, name = F.when(hit, F.lit(label)).otherwise(source), F.when(hit, value).otherwise(name)
    return df.withColumns({"source": source, "name": name})


def nearest_anywhere(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """key, match (the ``order`` of the nearest right row, the least on ties), d2, dist for every left row with a place, however far.

    The right places form a pyramid of cubes, each level STEP times as wide as the one below; a cube knows the box of its places and one of
    them. The left rows form blocks of some BLOCK rows each, and a block knows the box of its rows. From the top of the pyramid blocks
    follow cubes down to the places; a cube or place is dropped where one known place is nearer to all of the block's box. So the
    joins see blocks, not rows, and no row meets a whole table. At last rows and the places that are left for their block stream
    through partitions sorted by block, PORTION rows at a time, so the disk holds one portion's shuffle.
    """
    points = _known(right).groupBy(*[F.col(c).cast("double").alias(c) for c in "xyz"]).agg(F.min(order).alias("match"))
    points = shared_table(points, "nearest-points", small=True)
    n = points.count()
    rows = _known(left).select(F.col(key).alias("k"), *[F.col(c).cast("double").alias(c) for c in "xyz"])
    if not n:
        return rows.select(F.col("k").alias(key), F.lit(None).cast(points.schema["match"].dataType).alias("match"), F.lit(None).cast("double").alias("d2"), F.lit(None).cast("double").alias("dist")).limit(0)
    cube = lambda w: {f"c{c}": F.floor(F.col(c) / w) for c in "xyz"}
    ends = [f(f"{c}{end}").alias(f"{c}{end}") for c in "xyz" for end, f in (("0", F.min), ("1", F.max))]
    single = points.select(*[F.col(c).alias(f"{c}{end}") for c in "xyz" for end in "01"], F.struct(*"xyz").alias("p"), F.lit(1).cast("long").alias("n"), "match", *"xyz")
    level = lambda df: df.groupBy("cx", "cy", "cz").agg(F.min("p").alias("p"), F.sum("n").alias("n"), *ends)
    widths = [min(1.0, math.sqrt(4 * math.pi / n))]
    levels = [shared_table(level(single.withColumns(cube(widths[0]))), "nearest-cubes", small=True)]
    while levels[0].agg(F.max("n")).first()[0] > CROWD and widths[0] > FINEST:  # crowded places get finer cubes
        widths.insert(0, widths[0] / STEP)
        levels.insert(0, shared_table(level(single.withColumns(cube(widths[0]))), "nearest-cubes", small=True))
    while levels[-1].count() > TOP:
        levels.append(shared_table(level(levels[-1].withColumns({f"c{c}": F.floor(F.col(f"c{c}") / STEP) for c in "xyz"})), "nearest-cubes", small=True))

    placed = shared_table(rows, "nearest-rows")
    total = placed.count()
    count = max(1, -(-total // PORTION))
    rows, made = _blocks(placed, min(2.0, math.sqrt(4 * math.pi * BLOCK / max(1, total))))
    rows = shared_table(rows.withColumn("portion", F.pmod("block", F.lit(count))), "nearest-blocks", by="portion")
    for done in (placed, *made):
        release(done)
    blocks = rows.select("block", *[F.col(c).alias(f"{c}{end}") for c in "xyz" for end in "01"]).groupBy("block").agg(*ends)
    held = blocks.select("block", F.struct(*[f"{c}{end}" for c in "xyz" for end in "01"]).alias("b")).crossJoin(F.broadcast(levels[-1].drop("n")))
    made = []
    for i in reversed(range(len(levels))):
        if made:
            below = levels[i].drop("n").withColumns({f"u{c}": F.floor(F.col(f"c{c}") / STEP) for c in "xyz"})
            held = made[-1].join(below.hint("merge"), ["ux", "uy", "uz"])
        held = _not_behind(held).select("block", "b", "q", *[F.col(f"c{c}").alias(f"u{c}") for c in "xyz"])
        made.append(shared_table(held, "nearest-level", small=True))
    leaves = single.drop("n").withColumns({f"u{c}": F.floor(F.col(c) / widths[0]) for c in "xyz"})
    held = _not_behind(made[-1].join(leaves.hint("merge"), ["ux", "uy", "uz"]))
    held = shared_table(held.select("block", "match", *"xyz", F.pmod("block", F.lit(count)).alias("portion")), "nearest-held", by="portion")
    for done in made:
        release(done)

    found = None
    columns = lambda df, kind, k, match: df.select("block", F.lit(kind).alias("kind"), k.alias("k"), match.alias("match"), *"xyz")
    kinds = {c: F.lit(None).cast(df.schema[c].dataType) for df, c in ((rows, "k"), (held, "match"))}
    for i in range(count):
        own, near = (df.filter(F.col("portion") == i) for df in (rows, held))
        both = columns(own, 0, F.col("k"), kinds["match"]).unionByName(columns(near, 1, kinds["k"], F.col("match")))
        both = both.repartition("block").sortWithinPartitions("block", "kind", "match")
        one = shared_table(both.mapInArrow(_nearest_of_block, StructType([rows.schema["k"], held.schema["match"], StructField("d2", DoubleType())])), "nearest-found")
        found = one if found is None else found.unionByName(one)
    for done in (rows, held, points, *levels):
        release(done)
    return found.select(F.col("k").alias(key), "match", "d2", F.expr(sky.arcsec("d2")).alias("dist"))


def _known(df: DataFrame) -> DataFrame:
    return _placed(df).filter(" and ".join(f"abs(cast({c} as double)) < double('infinity')" for c in "xyz"))


def _blocks(rows: DataFrame, width: float) -> tuple[DataFrame, list[DataFrame]]:
    """``rows`` (k, x, y, z) with ``block``, the hash of their cube; and the shared tables behind them.

    Cubes of over four times BLOCK rows give way to finer ones; rows of one place, or of a cube of the FINEST width, are dealt out by their keys.
    """
    done, made, limit = [], [], 4 * BLOCK
    while True:
        rows = rows.withColumns({f"c{c}": F.floor(F.col(c) / width) for c in "xyz"})
        extent = F.greatest(*[F.max(c) - F.min(c) for c in "xyz"])
        size = rows.groupBy("cx", "cy", "cz").agg(F.count(F.lit(1)).alias("n"), extent.alias("extent")).filter(F.col("n") > limit)
        size = shared_table(size, "nearest-crowded", small=True)
        made.append(size)
        cube = [F.lit(width), "cx", "cy", "cz"]
        if size.isEmpty():
            done.append(rows.select("k", *"xyz", F.xxhash64(*cube).alias("block")))
            break
        marked = rows.join(size.hint("merge"), ["cx", "cy", "cz"], "left")
        whole = F.col("n").isNull() | (F.col("extent") == 0) | F.lit(width <= FINEST)
        part = F.pmod(F.xxhash64("k"), F.ceil(F.coalesce("n", F.lit(1)) / limit))
        marked = marked.select("k", *"xyz", F.when(whole, F.xxhash64(*cube, part)).alias("block"))
        made.append(shared_table(marked, "nearest-marked", small=True))
        done.append(made[-1].filter("block is not null"))
        rows = made[-1].filter("block is null").drop("block")
        if rows.isEmpty():
            break
        width /= STEP
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out, made


def _not_behind(pairs: DataFrame) -> DataFrame:
    """Blocks (block, their box b, and q, a place, once one is known) with boxes of places (x0 to z1, one place p): those that hold a place which may be the nearest to some of the block's box.

    Of the places p that a block meets, q becomes the one whose greatest distance from the block's box is least. A box of places is dropped if q is nearer
    than any place of it could be, wherever in the block's box: the least of (distance from the box)² - (distance from q)², a sum over
    axes of which each is least at an end of the block, or where the box of places begins or ends.
    """

    if "q" in pairs.columns:
        pairs = pairs.mapInArrow(_ahead, pairs.schema)
    far = sum((F.pow(F.greatest(F.abs(F.col(f"p.{c}") - F.col(f"b.{c}0")), F.abs(F.col(f"p.{c}") - F.col(f"b.{c}1"))), F.lit(2.0)) for c in "xyz"), F.lit(0.0))
    pairs = pairs.withColumn("far", far).withColumn("q", F.min_by("p", "far").over(Window.partitionBy("block"))).drop("far")
    return pairs.mapInArrow(_ahead, pairs.schema)


def _ahead(batches):
    """The pairs of _not_behind() that stay."""
    import pyarrow as pa

    for batch in batches:
        column = lambda c, at=None: (batch.column(c) if at is None else batch.column(c).field(at)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
        lead, scale = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
        for c in "xyz":
            low, high, to, first, last = column("b", f"{c}0"), column("b", f"{c}1"), column("q", c), column(f"{c}0"), column(f"{c}1")
            least = np.full(batch.num_rows, np.inf)
            for v in (low, high, np.clip(first, low, high), np.clip(last, low, high)):
                at = np.clip(v, first, last)
                least = np.minimum(least, (to - at) * ((v - at) + (v - to)))  # (v - at)² - (v - to)²
            lead += least
            scale += np.maximum((low - to) ** 2, (high - to) ** 2)
        yield batch.filter(pa.array(lead <= scale * 1e-12))


def _nearest_of_block(batches):
    """k, match, d2 from rows (kind 0) and then places (kind 1, by match) of one block after the other: a task holds one block's rows and one batch."""
    import pyarrow as pa
    import pyarrow.compute as pc

    block, rows, told = None, [], []

    def end():
        if rows:
            told.append((pa.concat_arrays([k for k, *_ in rows]), pa.concat_arrays([m for *_, m in rows]), np.concatenate([d for *_, d, _ in rows])))
            rows.clear()

    def out():
        if told:
            k, match, d2 = zip(*told)
            told.clear()
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(k), pa.concat_arrays(match), pa.array(np.concatenate(d2))], names=["k", "match", "d2"])

    for batch in batches:
        of, kind, *at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "kind", *"xyz"))
        keys, matches = batch.column("k"), batch.column("match")
        cuts = [*(np.flatnonzero((np.diff(of) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(of)]
        start = 0
        for stop in cuts if len(of) else []:
            if of[start] != block:
                end()
                block = of[start]
            if kind[start] == 0:
                rows.append((keys[start:stop], [c[start:stop, None] for c in at], np.full(stop - start, np.inf), pa.nulls(stop - start, matches.type)))
            for a in range(start, stop, 1024) if kind[start] else []:
                b = min(stop, a + 1024)
                for i, (k, place, best, match) in enumerate(rows):
                    d2 = sum(np.square(c[a:b] - l) for c, l in zip(at, place))
                    least = d2.argmin(1)
                    d2 = d2[np.arange(len(best)), least]
                    nearer = d2 < best  # places come by match: the first of equals is the least
                    rows[i] = k, place, np.where(nearer, d2, best), pc.if_else(pa.array(nearer), matches[a:b].take(pa.array(least)), match)
            start = stop
        yield from out()
    end()
    yield from out()


def pairs_once(stars: DataFrame, radius: float, key: str = "id") -> DataFrame:
    """a, b, d2: each two stars of a table closer than ``radius`` arcseconds once; rows of equal key are no pair.

    A star goes to its own cube and to the 13 neighbouring ones behind it in the order of the coordinates, with nothing but
    its key and place: two stars of different cubes meet in one of them only, those of one cube by the order of their keys.
    """
    h = chord(radius)
    place = stars.filter("x is not null and y is not null and z is not null").select(F.col(key).alias("k"), *[F.col(c).cast("double").alias(c) for c in "xyz"])
    cells = place.withColumns({f"c{c}": F.floor(F.col(c) / h) for c in "xyz"})
    steps = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) >= (0, 0, 0)]
    near = F.explode(F.array(*[F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip("xyz", s)]) for s in steps]))
    l = cells.withColumn("n", near).select(F.col("k").alias("a"), *[F.col(c).alias(f"l_{c}") for c in "xyz"], *[(F.col(f"c{c}") + F.col(f"n.{c}")).alias(f"c{c}") for c in "xyz"], F.expr("n.x = 0 and n.y = 0 and n.z = 0").alias("own"))  # noqa: E741
    r = cells.select(F.col("k").alias("b"), *[F.col(c).alias(f"r_{c}") for c in "xyz"], "cx", "cy", "cz")
    pairs = l.join(r.hint("merge"), ["cx", "cy", "cz"]).filter(F.when(F.col("own"), F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b")))
    return pairs.select("a", "b", F.expr(sky.chord_squared("l_", "r_")).alias("d2")).filter(F.col("d2") < h * h)


def _ends(stars: DataFrame, radius: float, key: str) -> DataFrame:
    """key, d2 and o, the other star, for both stars of each pair."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("k"), F.col("b").alias("o")), F.struct(F.col("b").alias("k"), F.col("a").alias("o"))))
    return pairs_once(stars, radius, key).select("d2", ends.alias("e")).select(F.col("e.k").alias(key), "d2", F.col("e.o").alias("o"))


def neighbours(stars: DataFrame, radius: float, key: str = "id") -> DataFrame:
    """For each star with a neighbour: how many within the radius, the nearest (of least key on ties) and its distance."""
    out = _ends(stars, radius, key).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d2", "o")).alias("b"))
    return out.select(key, "n", F.col("b.o").alias("nearest"), F.expr(sky.arcsec("b.d2")).alias("dist"))


def neighbour_counts(stars: DataFrame, radius: float, key: str = "id") -> DataFrame:
    """For each star with a neighbour: how many within the radius, the least distance, and the neighbour of least key.

    Numbers only, so pairs are summed up in a hash table where they are found; a struct's minimum would sort them all first.
    """
    out = _ends(stars, radius, key).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("d2").alias("d2"), F.min("o").alias("least"))
    return out.select(key, "n", "least", F.expr(sky.arcsec("d2")).alias("dist"))


def isolated_doubles(stars: DataFrame, radius: float, closest: float, low: float = 3.0, high: float = 8.0) -> DataFrame:
    """Pairs that are each other's only neighbour within ``radius`` and closer than ``closest``, both of middling magnitude; the brighter first."""
    one = neighbour_counts(stars, radius).filter((F.col("n") == 1) & (F.col("dist") < closest)).withColumnRenamed("least", "nearest")
    a = one.join(stars.select("id", F.col("mag").alias("mag_a")).hint("merge"), "id")
    b = one.select(F.col("id").alias("nearest"), F.col("nearest").alias("back")).join(stars.select(F.col("id").alias("nearest"), F.col("mag").alias("mag_b")).hint("merge"), "nearest")
    both = a.join(b.hint("merge"), "nearest").filter((F.col("back") == F.col("id")) & (F.col("id") < F.col("nearest")))
    both = both.filter(F.col("mag_a").between(low, high) & F.col("mag_b").between(low, high))
    swap = F.col("mag_b") < F.col("mag_a")
    return both.select(F.when(swap, F.col("nearest")).otherwise(F.col("id")).alias("id1"), F.when(swap, F.col("id")).otherwise(F.col("nearest")).alias("id2"), F.least("mag_a", "mag_b").alias("mag1"), F.greatest("mag_a", "mag_b").alias("mag2"), "dist")


def nearest_with_margin(left: DataFrame, right: DataFrame, radius: float, key: str, order: str, margin: float = 1.0) -> DataFrame:
    """key, match, dist: of the right rows within ``radius``, read in their order, the first stands until one is over ``margin`` arcseconds nearer."""
    pairs = within(left.select(key, "x", "y", "z"), right.select(F.col(order).alias("match"), "x", "y", "z"), radius)
    pairs = pairs.select(F.col(f"l_{key}").alias(key), F.col("r_match").alias("match"), "dist")
    return fold(pairs, key, "match", ["dist"], lambda c, x: c["dist"] - margin > x["dist"])


def staged(rows: DataFrame, key: str, stages: list[tuple[str, DataFrame, float, str, float | None]]) -> DataFrame:
    """key, source, match, dist: the first stage that finds a row's match names it.

    A stage is (name, table with id and place, radius, condition on rows, margin); with a margin the table's order has a say, else the
    nearest counts. Each stage joins its own table with only the rows that no stage before it named, and its matches are
    written, so a stage's work falls with what is left.
    """
    rest, found = rows, []
    for name, table, radius, condition, margin in stages:
        some = rest.filter(condition)
        if margin is None:
            hits = nearest(some.select(key, "x", "y", "z"), table.select("id", "x", "y", "z"), radius, [key], "id").select(F.col(f"l_{key}").alias(key), F.col("r_id").alias("match"), "dist")
        else:
            hits = nearest_with_margin(some, table, radius, key, "id", margin)
        hits = shared_table(hits.select(key, F.lit(name).alias("source"), "match", "dist"), "staged", small=True)
        found.append(hits)
        rest = rest.join(hits.select(key), key, "left_anti")
    out = found[0]
    for hits in found[1:]:
        out = out.unionByName(hits)
    return out


def second_look(rows: DataFrame, table: DataFrame, note: int = 1) -> DataFrame:
    """Rows (id, place, ref) with their nearest star (star) against ``table`` (star, number, mag, place): does the star bear the number that the row refers to?

    verdict: match, note (the numbers are at most ``note`` apart) or mismatch; rows or stars without a number aren't judged. Only for rows whose numbers differ
    a second look finds the first star that does bear the number: other, other_mag and its distance. ``kept``: the reference may be
    written: it matches, or no star bears it.
    """
    own = table.select("star", F.col("number").alias("_own"))
    judged = rows.join(own, "star").filter("_own > 0 and ref > 0")
    gap = F.abs(F.col("ref") - F.col("_own"))
    judged = judged.withColumn("verdict", F.when(gap == 0, "match").when(gap <= note, "note").otherwise("mismatch"))
    differ = judged.filter("verdict <> 'match'")
    bears = table.filter("number > 0").groupBy("number").agg(F.min_by(F.struct("star", "mag", "x", "y", "z"), "star").alias("o"))
    looked = differ.join(bears, differ["ref"] == bears["number"], "left").select("id", F.col("o.star").alias("other"), F.col("o.mag").alias("other_mag"), F.when(F.col("o").isNotNull(), F.expr(sky.arcsec(sky.chord_squared("", "o.")))).alias("other_dist"))
    out = judged.join(looked, "id", "left")
    return out.select("id", "star", "ref", F.col("_own").alias("number"), "verdict", "other", "other_mag", "other_dist", F.col("other").isNull().alias("kept"))


def reference_limits(rows: DataFrame, table: DataFrame, limit: float, mag_limit: float | None) -> DataFrame:
    """Rows (id, place, mag, number) against the star of ``table`` (number, place, mag) that they name: place is absent, far or ok; mag is whether the magnitudes differ by more than the limit."""
    stars = table.groupBy("number").agg(F.min_by(F.struct("mag", "x", "y", "z"), "star").alias("o"))
    both = rows.join(stars, "number", "left").withColumn("dist", F.when(F.col("o").isNotNull(), sky.arcsec_c(F.expr(sky.chord_squared("", "o.")))))
    place = F.when(F.col("o").isNull(), "absent").when(F.col("dist") > limit, "far").otherwise("ok")
    unlike = F.lit(False) if mag_limit is None else F.coalesce(F.abs(F.col("mag") - F.col("o.mag")) > mag_limit, F.lit(False))
    return both.select("id", "number", place.alias("place"), "dist", unlike.alias("mag_differs"))


def zoned(stars: DataFrame, zones: DataFrame, key: str = "id", ra_step: float = 15.0, dec_step: float = 10.0) -> DataFrame:
    """key and name for ``stars`` (key, ra, dec): the name of the first row of ``zones`` (row, ra_lo, ra_hi, dec_lo, name) that holds them: ra in [ra_lo, ra_hi) and dec from dec_lo up.

    A zone goes to the bins of right ascension and bands of declination that it touches, then bin and band are an equi-join with an
    exact filter and a grouped minimum of the row number. Zones that cross 0 degrees have two rows.
    """
    bands = int(180 / dec_step) - 1
    band = lambda c: F.least(F.greatest(F.floor((F.col(c) + 90) / dec_step), F.lit(0)), F.lit(bands)).cast("int")
    last = F.floor((F.col("ra_hi") - 1e-9) / ra_step).cast("int")
    cells = zones.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("ra_lo") / ra_step).cast("int"), last))).withColumn("_band", F.explode(F.sequence(band("dec_lo"), F.lit(bands))))
    # columns that can't be null need no null checks, which the optimizer would push through all that ra and dec are made of
    places = stars.select(key, *[F.coalesce(c, F.lit(-999.0)).alias(c) for c in ("ra", "dec")])
    met = places.withColumns({"_bin": F.coalesce(F.floor(F.col("ra") / ra_step).cast("int"), F.lit(-1)), "_band": F.coalesce(band("dec"), F.lit(-1))}).join(cells, ["_bin", "_band"])
    met = met.filter("ra >= ra_lo and ra < ra_hi and dec >= dec_lo")
    return met.groupBy(key).agg(F.min_by("name", "row").alias("name"))
