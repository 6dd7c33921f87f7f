"""Three-dimensional structures: distances, contacts, clustering of selected residues."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .pairs import importable, in_tiles, once, stored, tiled

#: From so many positions apart, a pair is short, medium or long range.
SHORT, MEDIUM, LONG = 6, 12, 24
#: Distance below which two residues touch in the clustering score.
TOUCH = 4.0
#: Residues of the two sides of a tile, whose pairs leave it or are only summed; pairs of atoms that are looked at at once.
RESIDUES, SUMMED, STRIP_CELLS = 512, 1024, 500_000


def atoms_for(atoms: DataFrame, method: str = "Any") -> DataFrame:
    """The atoms that stand for a residue: all; CA, else all; or CB, else CA, else all."""
    if method == "Any":
        return atoms
    if method not in ("CA", "CB"):
        raise ValueError("method must be Any, CA or CB")
    order = F.when(F.col("atom_name") == "CA", 1).otherwise(2)
    if method == "CB":
        order = F.when(F.col("atom_name") == "CB", 0).otherwise(order)
    best = F.min(order).over(Window.partitionBy("chain", "resno"))
    return atoms.withColumn("_o", order).withColumn("_b", best).where("_o = _b").drop("_o", "_b")


def _atoms_of(p: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of the atoms of some residues, residue after residue, and where each residue's begin."""
    flat = p.flatten()
    xyz = np.array([pc.fill_null(flat.field(c), np.nan).to_numpy(zero_copy_only=False) for c in "xyz"])
    return xyz, np.append(0, np.cumsum(p.value_lengths().to_numpy()))


def _least_even(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Squares of the least distances; u, v: coordinate, number of the atom in its residue, residue."""
    best, square, part = (np.full((u.shape[2], v.shape[2]), np.nan) for _ in range(3))
    for x in np.moveaxis(u, 1, 0):
        for y in np.moveaxis(v, 1, 0):
            for c, (p, q) in enumerate(zip(x, y, strict=True)):
                one = part if c else square
                np.subtract(p[:, None], q[None, :], out=one)
                np.multiply(one, one, out=one)
                if c:
                    np.add(square, part, out=square)
            np.fmin(best, square, out=best)
    return best


def _least(a: pa.Table, b: pa.Table) -> Iterator[tuple[slice, np.ndarray]]:
    """Least distances of the residues of a (strips of them) to all of b; NaN where there are no two atoms."""
    p, q = (t["p"].combine_chunks() for t in (a, b))
    here, there = (np.flatnonzero(x.is_valid().to_numpy(zero_copy_only=False)) for x in (p, q))
    (u, starts), (v, ends) = (_atoms_of(x.drop_null()) for x in (p, q))
    strip = max(1, STRIP_CELLS * len(a) // max(1, u.shape[1] * v.shape[1]))
    (m, n), cells = (np.diff(x).max(initial=0) for x in (starts, ends)), u.shape[1] * v.shape[1]
    # with about as many atoms in each residue, first atoms, second atoms, ... are looked at together; the last stands in for more
    even = len(here) * m * len(there) * n <= 2 * cells
    if even:
        u, v = (x[:, np.minimum(k[:-1] + np.arange(most)[:, None], k[1:] - 1)] for x, k, most in ((u, starts, m), (v, ends, n)))
    for at in range(0, len(a), strip):
        rows = slice(at, min(at + strip, len(a)))
        lo, hi = np.searchsorted(here, [rows.start, rows.stop])
        out = np.full((rows.stop - rows.start, len(b)), np.nan)
        if lo < hi and len(there):
            if even:
                square = _least_even(u[:, :, lo:hi], v)
            else:
                some = slice(starts[lo], starts[hi])
                square = sum((x[some, None] - y[None, :]) ** 2 for x, y in zip(u, v, strict=True))
                square = np.fmin.reduceat(np.fmin.reduceat(square, ends[:-1], axis=1), starts[lo:hi] - starts[lo], axis=0)
            if len(here) == len(a) and len(there) == len(b):
                out = np.sqrt(square)
            else:
                out[np.ix_(here[lo:hi] - rows.start, there)] = np.sqrt(square)
        yield rows, out


def _residues(atoms: DataFrame, method: str) -> DataFrame:
    """chain, resno, p: the atoms of each residue."""
    use = atoms_for(atoms, method).select("chain", "resno", *[F.col(c).cast("double").alias(c) for c in "xyz"])
    return use.groupBy("chain", "resno").agg(F.collect_list(F.struct("x", "y", "z")).alias("p"))


def _distance(d: np.ndarray, *blocks: pa.Table) -> pa.Array:
    """NaN is null where some coordinate is."""
    flat = [t["p"].combine_chunks().flatten() for t in blocks]
    return pa.array(d, from_pandas=any(f.field(c).null_count for f in flat for c in "xyz"))


def residue_distances(atoms: DataFrame, method: str = "Any", within: float | None = None, below: bool = False) -> DataFrame:
    """chain, res_i < res_j, distance: the least distance of their atoms.

    With ``within`` only the pairs of residues at that distance at most (``below``: at less); the others do not leave
    their tile."""
    rows = _residues(atoms, method)
    kind = {c: rows.schema[c].dataType for c in ("chain", "resno")}
    schema = T.StructType([T.StructField("chain", kind["chain"]), *[T.StructField(r, kind["resno"]) for r in ("res_i", "res_j")], T.StructField("distance", T.DoubleType())])

    def kernel(at: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        r, s, own, batches = a["resno"].to_numpy(), b["resno"].to_numpy(), at[-2].as_py() == at[-1].as_py(), []
        for some, d in _least(a, b):
            x, y = r[some, None], s[None, :]
            keep = x < y if own else x != y
            if within is not None:
                keep = keep & (d < within if below else d <= within)
            i, j = np.minimum(x, y)[keep], np.maximum(x, y)[keep]
            batches.append(pa.RecordBatch.from_arrays([pa.repeat(at[0], len(i)), pa.array(i), pa.array(j), _distance(d[keep], a, b)], names=schema.names))
        return pa.Table.from_batches(batches)

    return in_tiles(rows, "resno", ["chain"], kernel, schema, RESIDUES)


def near_residues(atoms: DataFrame, cutoff: float, method: str = "Any") -> DataFrame:
    """chain, res_i < res_j, distance of the residues within ``cutoff``.

    All residues of a chain meet in tiles, and only the near ones leave them: pairs of atoms are never rows, however
    dense the atoms are."""
    return residue_distances(atoms, method, cutoff)


def separation_category(i: Column, j: Column) -> Column:
    gap = F.abs(j - i)
    return F.when(gap < SHORT, "Neighbors").when(gap < MEDIUM, "Short").when(gap < LONG, "Medium").otherwise("Long")


def pair_frame(positions: DataFrame, mapped: DataFrame, distances: DataFrame, cutoff: float) -> DataFrame:
    """All pairs of positions of a query with structure positions, separation, distance and contact.

    positions: (query, pos, aa); mapped: (query, pos, resno), absent where unmapped; distances: (query,
    res_i, res_j, distance).  Unmapped pairs have null distance and no contact.
    """
    known = positions.join(mapped, ["query", "pos"], "left")
    a, b, on = tiled(known.select("query", "pos", "aa", "resno"), "pos", ["query"])
    spot = lambda t, n: t.select(*on, F.col("pos").alias(f"_k{n}"), F.struct("pos", "aa", "resno").alias(n))
    met = spot(a, "u").join(spot(b, "v"), on).where(once("_ku", "_kv"))
    low, high = F.least("u", "v"), F.greatest("u", "v")  # by position, which comes first in them
    pairs = met.select("query", low.alias("u"), high.alias("v")).select(
        "query", *[F.col(f"{s}.{c}").alias(f"{n}_{e}") for s, e in (("u", "i"), ("v", "j")) for c, n in (("pos", "pos"), ("aa", "aa"), ("resno", "res"))]
    )
    far = distances.select("query", F.col("res_i").alias("_r"), F.col("res_j").alias("_s"), "distance")
    low, high = F.least("res_i", "res_j"), F.greatest("res_i", "res_j")
    on = (pairs["query"] == far["query"]) & (low == far["_r"]) & (high == far["_s"])
    out = pairs.join(far, on, "left").drop(far["query"]).drop("_r", "_s")
    return _shown(out, cutoff)


def _shown(pairs: DataFrame, cutoff: float) -> DataFrame:
    """Pairs of positions with their distance, and separation, category and contact added."""
    return pairs.select(
        "query", "pos_i", "aa_i", "pos_j", "aa_j", "res_i", "res_j",
        (F.col("pos_j") - F.col("pos_i")).alias("separation"),
        separation_category(F.col("pos_i"), F.col("pos_j")).alias("category"),
        "distance", F.coalesce(F.col("distance") <= cutoff, F.lit(False)).alias("contact"),
    )


def atom_frame(positions: DataFrame, mapped: DataFrame, atoms: DataFrame, cutoff: float, method: str = "Any") -> DataFrame:
    """The :func:`pair_frame` of the :func:`residue_distances` of atoms (chain: the query): positions meet together with the
    atoms of their residues, so that neither pairs nor distances are shuffled to be joined.

    Tiles hold runs of positions and list their pairs in order, which a columnar file stores in fewer bytes."""
    residues = _residues(atoms, method).withColumnRenamed("chain", "query")
    known = positions.select("query", "pos", "aa").join(mapped.select("query", "pos", "resno"), ["query", "pos"], "left").join(residues, ["query", "resno"], "left")
    kind = {c: known.schema[c].dataType for c in known.columns}
    names = [("pos", "pos"), ("aa", "aa"), ("resno", "res")]
    ends = [T.StructField(f"{n}_{e}", kind[c]) for e in "ij" for c, n in names]
    schema = T.StructType([T.StructField("query", kind["query"]), *ends, T.StructField("distance", T.DoubleType())])

    def kernel(at: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = a.sort_by("pos"), b.sort_by("pos")
        r, s, found = a["pos"].to_numpy(), b["pos"].to_numpy(), []
        bare, gone = (t["p"].combine_chunks().is_null().to_numpy(zero_copy_only=False) for t in (a, b))
        a_ends, b_ends = (t.select([c for c, _ in names]).combine_chunks() for t in (a, b))
        for some, d in _least(a, b):
            keep = r[some, None] < s[None, :]
            u, v = np.nonzero(keep)
            u += some.start
            i, j, none = a_ends.take(pa.array(u)), b_ends.take(pa.array(v)), pa.array(bare[u] | gone[v])
            none = pc.or_(none, pc.fill_null(pc.equal(i["resno"], j["resno"]), True).combine_chunks())  # nor to itself
            far = pc.if_else(none, None, _distance(d[keep], a, b))
            parts = [pa.repeat(at[0], len(i)), *i.columns, *j.columns, far]
            found.append(pa.Table.from_arrays(parts, names=schema.names))
        return pa.concat_tables(found)

    return _shown(in_tiles(known.select("query", "pos", "aa", "resno", "p"), "pos", ["query"], kernel, schema, RESIDUES, ordered=True), cutoff)


def _apart(a: pa.Table, b: pa.Table) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Distances of the positions of a (strips of them) to all of b, and which of them are known: not those of positions
    without a residue, or of the same residue."""
    places = pa.concat_arrays([t["resno"].combine_chunks() for t in (a, b)])  # numbered, so that any type can be compared
    codes = pc.fill_null(pc.index_in(places, pc.unique(places.drop_null())), -1).to_numpy()
    u, v = codes[: len(a)], codes[len(a) :]
    bare, gone = (t["p"].combine_chunks().is_null().to_numpy(zero_copy_only=False) for t in (a, b))
    flat = [t["p"].combine_chunks().flatten() for t in (a, b)]
    holes = any(f.field(c).null_count for f in flat for c in "xyz")  # NaN is unknown where some coordinate is
    for some, d in _least(a, b):
        known = (u[some, None] != v[None, :]) & ~bare[some, None] & ~gone[None, :]
        yield some, d, known & ~np.isnan(d) if holes else known


def _known(positions: DataFrame, mapped: DataFrame, atoms: DataFrame, method: str) -> DataFrame:
    residues = _residues(atoms, method).withColumnRenamed("chain", "query")
    known = positions.select("query", "pos").join(mapped.select("query", "pos", "resno"), ["query", "pos"], "left").join(residues, ["query", "resno"], "left")
    return known.select("query", "pos", "resno", "p")


def frame_distances(positions: DataFrame, mapped: DataFrame, atoms: DataFrame, method: str = "Any") -> DataFrame:
    """score: the distances of the :func:`atom_frame` that are known, without their positions."""

    def kernel(at: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        x, y = (t["pos"].to_numpy() for t in (a, b))
        own, found = at[-2].as_py() == at[-1].as_py(), []
        for some, d, known in _apart(a, b):
            found.append(d[known & (x[some, None] < y[None, :] if own else x[some, None] != y[None, :])])
        return pa.table({"score": pa.array(np.concatenate(found), pa.float64())})

    schema = T.StructType([T.StructField("score", T.DoubleType())])
    return in_tiles(_known(positions, mapped, atoms, method), "pos", ["query"], kernel, schema, SUMMED)


def middle_distances(positions: DataFrame, mapped: DataFrame, atoms: DataFrame, method: str = "Any") -> DataFrame:
    """query, pos, n, least, low, high: of each position, how many distances of the :func:`atom_frame` are known, the least one
    and the two in the middle, which are one if n is odd.

    A block of positions meets all of its query, so every distance is taken from both its ends, and none leaves a task; a
    task holds the residues of one query, and distances of a strip of positions.
    """
    rows = stored(_known(positions, mapped, atoms, method))
    sizes = rows.groupBy("query").agg(F.ceil(F.count("*") / SUMMED).cast("int").alias("_n"))
    blocks = rows.join(sizes, "query").withColumn("_part", F.pmod(F.xxhash64("pos"), F.col("_n")).cast("int"))
    every = rows.join(sizes, "query").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    left, right = blocks.drop("_n"), every.drop("_n").toDF(*[f"_r{c}" for c in ("query", "pos", "resno", "p", "_part")])
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = [rows.schema["query"], rows.schema["pos"]]
    schema = T.StructType([*ends, T.StructField("n", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("least", "low", "high")]])

    def run(at: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows:
            return to_arrow_schema(schema).empty_table()
        b = b.rename_columns(["query", "pos", "resno", "p", "_part"])
        x, y, found = a["pos"].to_numpy(), b["pos"].to_numpy(), []
        for some, d, known in _apart(a, b):
            known &= x[some, None] != y[None, :]
            d = np.sort(np.where(known, d, -1.0), axis=1)  # the unknown ones first
            n, row = known.sum(axis=1), np.arange(len(d))
            first = d.shape[1] - n
            at_most = lambda k: d[row, np.minimum(first + k, d.shape[1] - 1)]
            found.append(np.stack([n, at_most(0), at_most(np.maximum(n - 1, 0) // 2), at_most(n // 2)]))
        n, *values = np.concatenate(found, axis=1)
        got = pa.Table.from_arrays([a["query"], a["pos"], pa.array(n.astype(np.int64)), *map(pa.array, values)], names=schema.names)
        return got.filter(pc.greater(got["n"], 0)).cast(to_arrow_schema(schema))

    met = importable(left.repartition(parts, "query", "_part")).groupBy("query", "_part").cogroup(right.repartition(parts, "_rquery", "_r_part").groupBy("_rquery", "_r_part"))
    return met.applyInArrow(run, schema)


def frame_counts(positions: DataFrame, mapped: DataFrame, atoms: DataFrame, cutoff: float, method: str = "Any") -> DataFrame:
    """query, separation, category, contact, n: how many rows of the :func:`atom_frame` have these values.

    Pairs are counted inside their tile.  Tiles hold runs of positions, so that they have few separations, however many
    pairs.
    """
    residues = _residues(atoms, method).withColumnRenamed("chain", "query")
    known = positions.select("query", "pos").join(mapped.select("query", "pos", "resno"), ["query", "pos"], "left").join(residues, ["query", "resno"], "left")
    fields = [known.schema["query"], T.StructField("separation", known.schema["pos"].dataType), T.StructField("contact", T.BooleanType()), T.StructField("n", T.LongType())]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])

    def kernel(at: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        x, y = (t["pos"].to_numpy().astype(np.int64) for t in (a, b))
        own = at[-2].as_py() == at[-1].as_py()
        places = pa.concat_arrays([t["resno"].combine_chunks() for t in (a, b)])  # numbered, so that any type can be compared
        codes = pc.fill_null(pc.index_in(places, pc.unique(places.drop_null())), -1).to_numpy()
        u, v = codes[: len(x)], codes[len(x) :]
        found: dict[tuple[int, bool], int] = {}
        for some, d in _least(a, b):
            gap = y[None, :] - x[some, None]
            keep = gap > 0 if own else gap != 0
            contact = (d <= cutoff) & (u[some, None] != v[None, :])
            for is_contact, which in ((True, keep & contact), (False, keep & ~contact)):
                for s, n in zip(*np.unique(np.abs(gap[which]), return_counts=True), strict=True):
                    found[int(s), is_contact] = found.get((int(s), is_contact), 0) + int(n)
        columns = list(zip(*[(s, c, n) for (s, c), n in found.items()], strict=True)) or [(), (), ()]
        return pa.Table.from_arrays([pa.repeat(at[0], len(found)), *map(pa.array, columns)], names=schema.names).cast(to_arrow_schema(schema))

    sums = in_tiles(known.select("query", "pos", "resno", "p"), "pos", ["query"], kernel, schema, SUMMED, ordered=True)
    counts = sums.groupBy("query", "separation", "contact").agg(F.sum("n").alias("n"))
    return counts.select("query", "separation", separation_category(F.lit(0), F.col("separation")).alias("category"), "contact", "n")


def contact_weights(distances: DataFrame, biased: bool = True) -> DataFrame:
    """res_i, res_j, w of the residues that touch; w is the sequence separation if biased, else 1."""
    touch = distances.where(F.col("distance") < TOUCH)
    w = F.abs(F.col("res_j") - F.col("res_i")) if biased else F.lit(1)
    return touch.select("res_i", "res_j", w.cast("double").alias("w"))


def clustering_background(contacts: DataFrame) -> DataFrame:
    """One row: case1, case2, case3, total: sums of w w' over pairs of contacts with 2, 1 and no shared residue.

    In closed form from degrees, so no pair of contacts is formed:
    case1 = sum w^2, case2 = sum deg^2 - 2 case1, case3 = (sum w)^2 - case1 - case2.
    """
    degree = contacts.select(F.explode(F.array("res_i", "res_j")).alias("res"), "w").groupBy("res").agg(F.sum("w").alias("deg"))
    return _background(degree, contacts.select("w", (F.col("w") * F.col("w")).alias("square")))


def _background(degree: DataFrame, parts: DataFrame) -> DataFrame:
    """The :func:`clustering_background` from the degrees (deg) of residues and sums (w, square) over parts of the contacts."""
    squares = degree.agg(F.coalesce(F.sum(F.col("deg") * F.col("deg")), F.lit(0.0)).alias("d2"))
    sums = parts.agg(F.coalesce(F.sum("square"), F.lit(0.0)).alias("case1"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("total"))
    both = sums.crossJoin(squares)  # one row each
    case2 = F.col("d2") - 2 * F.col("case1")
    return both.select("case1", case2.alias("case2"), (F.col("total") * F.col("total") - F.col("case1") - case2).alias("case3"), "total")


def clustering_z_score(selected: Column, size: Column, w: Column, case1: Column, case2: Column, case3: Column, total: Column) -> Column:
    """z = (w - mean) / deviation of the weight of contacts among ``selected`` of ``size`` residues; null without deviation."""
    m, n = selected.cast("double"), size.cast("double")
    p1 = m * (m - 1) / (n * (n - 1))
    p2 = p1 * F.try_divide(m - 2, n - 2)
    p3 = p2 * F.try_divide(m - 3, n - 3)
    mean = total * p1
    variance = p1 * case1 + F.coalesce(p2, F.lit(0.0)) * case2 + F.coalesce(p3, F.lit(0.0)) * case3 - mean * mean
    return F.when(F.round(variance, 9) > 0, (w - mean) / F.sqrt(F.greatest(variance, F.lit(1e-300))))


def clustering_curve(first_seen: DataFrame, contacts: DataFrame, size: int) -> DataFrame:
    """cut, residues, w, z_score: the growing set of residues first seen (res, cut) at or before each cut.

    A contact counts from the later of its two ends, so a running sum replaces growing sets.  ``first_seen`` has a row
    for each residue of one structure and is broadcast, since there are about as many contacts as pairs of residues.
    """
    first_seen = stored(first_seen)
    a = first_seen.select(F.col("res").alias("res_i"), F.col("cut").alias("c_i"))
    b = first_seen.select(F.col("res").alias("res_j"), F.col("cut").alias("c_j"))
    at = contacts.join(F.broadcast(a), "res_i").join(F.broadcast(b), "res_j").groupBy(F.greatest("c_i", "c_j").alias("cut")).agg(F.sum("w").alias("w"))
    return _curve(first_seen, at, clustering_background(contacts), size)


def _curve(first_seen: DataFrame, at: DataFrame, background: DataFrame, size: int) -> DataFrame:
    """The :func:`clustering_curve` from the weight (cut, w) of the contacts that count from each cut on."""
    steps = first_seen.groupBy("cut").agg(F.count("*").alias("n")).join(at, "cut", "left")
    window = Window.orderBy("cut")  # one row per cut
    run = steps.select("cut", F.sum("n").over(window).alias("residues"), F.coalesce(F.sum("w").over(window), F.lit(0.0)).alias("w"))
    z = clustering_z_score(F.col("residues"), F.lit(size), F.col("w"), F.col("case1"), F.col("case2"), F.col("case3"), F.col("total"))
    return run.crossJoin(F.broadcast(background)).select("cut", "residues", "w", z.alias("z_score"))  # one row


def contact_sums(atoms: DataFrame, first_seen: DataFrame | None = None, biased: bool = True, method: str = "Any") -> DataFrame:
    """res, cut, w, square: sums of the :func:`contact_weights` of atoms, taken inside tiles, so that no contact is a row.

    In rows with res, w is weight of contacts of that residue; in rows with cut, that of contacts whose later end is
    first seen (res, cut) there; in rows with neither, w and square are sums of all weights and of their squares.  Add up
    the rows of different tiles.  The result is stored.
    """
    rows = _residues(atoms, method)
    seen = first_seen if first_seen is not None else rows.select(F.col("resno").alias("res"), F.lit(None).cast("int").alias("cut")).limit(0)
    rows = rows.join(seen.select(F.col("res").alias("resno"), "cut", F.lit(True).alias("seen")), "resno", "left")
    number = T.DoubleType()
    schema = T.StructType([T.StructField(n, t) for n, t in (("res", rows.schema["resno"].dataType), ("cut", rows.schema["cut"].dataType), ("w", number), ("square", number))])

    def kernel(at: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        cuts = pa.concat_arrays([t["cut"].combine_chunks() for t in (a, b)])
        steps = pc.unique(cuts.drop_null())
        steps = steps.take(pc.sort_indices(steps))
        # rows in order of cut (0: null, which is passed over; -1: never seen), so that weights are added up by runs
        codes = pc.fill_null(pc.index_in(cuts, steps), -1).to_numpy().astype(np.int64) + 1
        codes = np.where(np.concatenate([pc.fill_null(t["seen"], False).to_numpy() for t in (a, b)]), codes, -1)
        u, v = codes[: len(a)], codes[len(a) :]
        a, b, u, v = a.take(np.argsort(u, kind="stable")), b.take(np.argsort(v, kind="stable")), np.sort(u), np.sort(v)
        r, s = (t["resno"].to_numpy().astype(float) for t in (a, b))
        kinds, runs = np.unique(v, return_index=True)
        own, left, right, square = at[-2].as_py() == at[-1].as_py(), np.zeros(len(r)), np.zeros(len(s)), 0.0
        by = np.zeros((len(steps) + 2, len(kinds)))
        for some, d in _least(a, b):
            gap = s[None, :] - r[some, None]
            w = (d < TOUCH) & (gap > 0 if own else gap != 0)
            w = np.abs(gap, out=gap) * w if biased else w.astype(float)
            each = np.add.reduceat(w, runs, axis=1)
            left[some] += each.sum(axis=1)
            right += w.sum(axis=0)
            square += np.vdot(w, w)
            np.add.at(by, u[some] + 1, each)
        later = np.maximum(np.arange(-1, len(steps) + 1)[:, None], kinds[None, :])
        both = (np.arange(-1, len(steps) + 1)[:, None] >= 0) & (kinds[None, :] >= 0)
        by, total = np.bincount(later[both], by[both], len(steps) + 1), left.sum()
        ends = pa.concat_arrays([t["resno"].combine_chunks() for t in (a, b)])
        n, m = len(ends), len(steps)
        parts = [
            pa.concat_arrays([ends, pa.nulls(m + 1, ends.type)]), pa.concat_arrays([pa.nulls(n, steps.type), steps, pa.nulls(1, steps.type)]),
            pa.array(np.concatenate([left, right, by[1:], [total]])), pa.concat_arrays([pa.nulls(n + m, pa.float64()), pa.array([square])]),
        ]
        return pa.Table.from_arrays(parts, names=schema.names)

    return stored(in_tiles(rows.select("chain", "resno", "p", "cut", "seen"), "resno", ["chain"], kernel, schema, SUMMED))


def summed_background(sums: DataFrame) -> DataFrame:
    """The :func:`clustering_background` of :func:`contact_sums`."""
    degree = sums.where("res IS NOT NULL").groupBy("res").agg(F.sum("w").alias("deg"))
    return _background(degree, sums.where("square IS NOT NULL").select("w", "square"))


def summed_curve(first_seen: DataFrame, atoms: DataFrame, size: int, biased: bool = True) -> DataFrame:
    """The :func:`clustering_curve` of the contacts of atoms, from their :func:`contact_sums`."""
    first_seen = stored(first_seen)
    sums = contact_sums(atoms, first_seen, biased)
    at = sums.where("cut IS NOT NULL").groupBy("cut").agg(F.sum("w").alias("w"))
    return _curve(first_seen, at, summed_background(sums), size)


#: Diagonals whose choices are held at once; longer stretches are halved.  Cells of a diagonal of all pairs of a lot.
HELD, LOT_CELLS = 256, 50_000


class _Wavefront:
    """Global alignment with affine gaps of a lot of pairs of texts, all of the same two lengths, a whole anti-diagonal of all
    of them at a time.

    Scores of a cell are kept for three states: its letters aligned (0), a gap in b (1), a gap in a (2).
    A diagonal needs only the two before it.  To trace back through a stretch of diagonals, it is halved: the second
    half is done from the diagonals in the middle, then the first, and only ``HELD`` diagonals hold their choices.  So memory
    is linear in the lengths (times a logarithm), and what is chosen is the same as with a full table.
    """

    def __init__(self, a: list[str], b: list[str], score, gap_open: float, gap_extend: float):
        self.n, self.m, self.k = len(a[0]), len(b[0]), len(a)
        letters = sorted(set().union(*a, *b))
        code = {c: k for k, c in enumerate(letters)}
        self.table = np.array([[float(score(x, y)) for y in letters] for x in letters]).reshape(len(letters), len(letters))
        self.a, self.b = (np.array([[code[c] for c in x] for x in t], int).reshape(self.k, -1).T for t in (a, b))
        self.step = np.full((3, 3), float(gap_open))  # from a state (row) into a gap (1, 2)
        self.step[1, 1] = self.step[2, 2] = float(gap_extend)

    def diagonal(self, d: int, two: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(states x rows of cells x pairs) of diagonal d, and from which state each came, from those of d - 2 and d - 1."""
        now, came = np.full((3, self.n + 1, self.k), -np.inf), np.zeros((3, self.n + 1, self.k), np.int8)
        lo, hi = max(0, d - self.m), min(self.n, d)
        for state, first, last, back, before in ((0, max(lo, 1), min(hi, d - 1), 1, two), (1, max(lo, 1), hi, 1, one), (2, lo, min(hi, d - 1), 0, one)):
            if first > last:
                continue
            cells, ways = slice(first, last + 1), before[:, first - back : last + 1 - back]
            if state:
                ways = ways + self.step[:, state, None, None]
            best, origin = now[state, cells], came[state, cells]
            best[:] = ways[0]
            for s in (1, 2):
                more = ways[s] > best
                np.copyto(best, ways[s], where=more)
                origin[more] = s
            if not state:
                i = np.arange(first, last + 1)
                best += self.table[self.a[i - 1], self.b[d - i - 1]]
        return now, came

    def solve(self) -> tuple[np.ndarray, np.ndarray]:
        """Scores, and the aligned places (pair, i, j) in order."""
        empty = np.full((3, self.n + 1, self.k), -np.inf)
        first = empty.copy()
        first[0, 0] = 0.0
        last = self.n + self.m
        two, one = empty, first
        for d in range(1, last + 1):
            two, one = one, self.diagonal(d, two, one)[0]
        end = one[:, self.n]
        self.met = [np.zeros((3, 0), int)]
        self._trace(0, last, empty, first, np.full(self.k, last), np.full(self.k, self.n), end.argmax(axis=0))
        met = np.concatenate(self.met[::-1], axis=1)
        return end.max(axis=0), met[:, np.argsort(met[0], kind="stable")]

    def _trace(self, lo: int, hi: int, two: np.ndarray, one: np.ndarray, d: np.ndarray, i: np.ndarray, state: np.ndarray) -> None:
        """Walk back from the cells (i, d - i), d being ``hi`` at most, to the first ones on diagonal ``lo`` or before; d, i and
        state are moved there.  two, one: diagonals lo - 1 and lo."""
        if hi - lo > HELD:
            mid, x, y = (lo + hi) // 2, two, one
            for at in range(lo + 1, mid + 1):
                x, y = y, self.diagonal(at, x, y)[0]
            self._trace(mid, hi, x, y, d, i, state)
            return self._trace(lo, mid, two, one, d, i, state)
        chosen = []
        for at in range(lo + 1, hi + 1):
            now, came = self.diagonal(at, two, one)
            two, one = one, now
            chosen.append(came)
        for at in range(hi, lo, -1):
            (here,) = np.nonzero(d == at)
            was, row = state[here], i[here]
            state[here] = chosen[at - lo - 1][was, row, here]
            both = was == 0
            self.met.append(np.stack([here[both], row[both] - 1, at - row[both] - 1]))
            i[here] = row - (was < 2)
            d[here] = at - 1 - both


def global_alignments(a: list[str], b: list[str], score, gap_open: float = -10.0, gap_extend: float = -0.5) -> tuple[np.ndarray, np.ndarray]:
    """Best global alignments of a[k] and b[k]: their scores, and the aligned places (k, i, j), in order within each k.

    Pairs of the same lengths go together, in lots, which costs a fraction of one pair at a time."""
    totals, met, lots = np.zeros(len(a)), [np.zeros((3, 0), int)], {}
    for k, pair in enumerate(zip(a, b, strict=True)):
        lots.setdefault(tuple(map(len, pair)), []).append(k)
    for (n, _), lot in lots.items():
        most = max(1, LOT_CELLS // (n + 1))
        for at in range(0, len(lot), most):
            some = np.array(lot[at : at + most])
            totals[some], (k, i, j) = _Wavefront([a[x] for x in some], [b[x] for x in some], score, gap_open, gap_extend).solve()
            met.append(np.stack([some[k], i, j]))
    return totals, np.concatenate(met, axis=1)


def global_alignment(a: str, b: str, score, gap_open: float = -10.0, gap_extend: float = -0.5) -> tuple[float, list[tuple[int, int]]]:
    """Best global alignment with affine gaps: (score, aligned index pairs); ends cost like other gaps.

    Ties prefer a match, then a gap in b, then a gap in a.  Memory is linear in the lengths, see :class:`_Wavefront`.
    """
    totals, (_, i, j) = global_alignments([a], [b], score, gap_open, gap_extend)
    return float(totals[0]), list(zip(i.tolist(), j.tolist(), strict=True))
