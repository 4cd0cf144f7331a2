"""Vectors in array columns: norms, cosines, pair summaries, decoders, losses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stable import checkpointed

#: Labels whose sums a task holds at once.
MOST = 256
#: Vectors in a block of the search for nearest ones, and pivots at most.
NEAR_BLOCK = 8192
PIVOTS = 1024
#: Rows of one direction beyond which a group counts as hot, and the tasks that such a group is dealt to.
COPIES, SALTS = 10_000, 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector over its length; a zero vector is an error."""
    checked = lambda n: F.when(n == 0, F.raise_error(F.lit("zero vector")).cast("double")).otherwise(n)
    # the length stands in an array of its own, so that it is computed once and not for each component
    return F.element_at(F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: x.cast("double") / checked(n))), 1)


def centred(df: DataFrame, vector: str, dim: int, by: Sequence[str] = ()) -> DataFrame:
    """df with each vector less the mean of all (of its group): one aggregate over the components and a join of its single row."""
    mean = df.groupBy(*by).agg(F.array(*(F.avg(F.col(vector)[i].cast("double")) for i in range(dim))).alias("_mean"))
    joined = df.join(mean, list(by)) if by else df.crossJoin(F.broadcast(mean))
    return joined.withColumn(vector, F.zip_with(vector, "_mean", lambda x, m: x - m)).drop("_mean")


def cosine_pairs(df: DataFrame, key: str, vector: str, extra: Sequence[str] = (), clip: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """All pairs i < j of vectors within each of many small groups, with their cosine in double precision; asked_cosines is for one large group."""
    u = df.select(*by, F.col(key), *extra, unit(F.col(vector)).alias("_u"))
    a = u.select(*by, *(F.col(c).alias(f"{c}_i") for c in (key, *extra)), F.col("_u").alias("_a"))
    b = u.select(*(F.col(c).alias(f"_{c}") for c in by), *(F.col(c).alias(f"{c}_j") for c in (key, *extra)), F.col("_u").alias("_b"))
    on = F.col(f"{key}_i") < F.col(f"{key}_j")
    for c in by:
        on = on & (F.col(c) == F.col(f"_{c}"))
    cos = dot(F.col("_a"), F.col("_b"))
    return a.join(b, on).withColumn("cosine", F.greatest(F.least(cos, F.lit(1.0)), F.lit(-1.0)) if clip else cos).drop("_a", "_b", *(f"_{c}" for c in by))


#: Bytes of asked vectors that are broadcast as one matrix; more are compared block by block.
ASKED_BYTES = 32 << 20
#: Cosines that a task gives out at once.
OUT_ROWS = 1 << 18


def asked_cosines(df: DataFrame, key: str, vector: str, asked: Column, parts: dict[str, slice] | None = None, broadcast_bytes: int = ASKED_BYTES) -> DataFrame:
    """A row for each asked vector i with every other row's j: <key>_i, <key>_j and the cosine of each part of the vectors.

    ``parts`` names slices of the components (by default all, as cosine); all parts
    come from one pass. The asked vectors are one broadcast matrix if they have at
    most ``broadcast_bytes``, by count and length; beyond, blocks of asked rows meet
    blocks of rows, each pair of blocks once. Products are those of whole Arrow
    batches. Null vectors take no part; a zero vector (in any part) is an error. Rows
    of one key don't meet. Cosines lie between -1 and 1.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    parts = parts or {"cosine": slice(None)}
    rows = df.filter(F.col(vector).isNotNull()).select(F.col(key).alias("_k"), F.col(vector).cast("array<double>").alias("_v"), F.coalesce(asked, F.lit(False)).alias("_asked"))
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}_i` {kind}, `{key}_j` {kind}, {', '.join(f'`{n}` double' for n in parts)}"

    def matrix(vectors: pa.Array | pa.ChunkedArray, n: int) -> list:
        whole = np.asarray((vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors).flatten(), np.float64).reshape(n, -1 if n else 0)
        out = []
        for part in parts.values():
            lengths = np.sqrt((whole[:, part] ** 2).sum(axis=1, keepdims=True))
            if n and not lengths.all():
                raise ValueError("zero vector")
            out.append(whole[:, part] / lengths)
        return out

    def products(keys_i: pa.Array, one: list, keys_j: pa.Array, two: list):
        """Batches of all pairs of different keys; j in pieces, so that a batch has about OUT_ROWS."""
        piece = max(1, OUT_ROWS // max(1, len(keys_i)))
        for at in range(0, len(keys_j), piece):
            here = keys_j[at : at + piece]
            i, j = np.repeat(np.arange(len(keys_i)), len(here)), np.tile(np.arange(len(here)), len(keys_i))
            cosines = [np.clip(x @ y[at : at + piece].T, -1, 1).ravel() for x, y in zip(one, two)]
            batch = pa.RecordBatch.from_arrays([keys_i.take(pa.array(i)), here.take(pa.array(j)), *map(pa.array, cosines)], names=[f"{key}_i", f"{key}_j", *parts])
            yield batch.filter(pc.fill_null(pc.not_equal(batch.column(0), batch.column(1)), True))

    held = rows.filter("_asked")
    n, width = held.agg(F.count("*"), F.coalesce(F.max(F.size("_v")), F.lit(0))).first()
    if n * (width * 8 * len(parts) + 64) <= broadcast_bytes:
        table = held.select("_k", "_v").toArrow()
        sent = df.sparkSession.sparkContext.broadcast((table["_k"].combine_chunks(), matrix(table["_v"], table.num_rows)))

        def meet(batches):
            keys, asked_rows = sent.value
            for batch in batches:
                if len(batch) and len(keys):
                    yield from products(keys, asked_rows, batch.column("_k"), matrix(batch.column("_v"), len(batch)))

        return rows.select("_k", "_v").mapInArrow(meet, schema)
    total = rows.count()
    across, down = -(-n * width * 8 // (8 << 20)), max(1, -(-total * width * 8 // (32 << 20)))  # blocks of 8 and 32 MB
    block = lambda count: F.pmod(F.xxhash64("_k", F.xxhash64("_v")), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = held.select("_k", "_v", block(across).alias("_a")).withColumn("_b", every(down))
    right = rows.select("_k", "_v", block(down).alias("_b")).withColumn("_a", every(across))

    def blocks(one: pa.Table, two: pa.Table) -> pa.Table:
        found = products(one["_k"].combine_chunks(), matrix(one["_v"], one.num_rows), two["_k"].combine_chunks(), matrix(two["_v"], two.num_rows)) if one.num_rows and two.num_rows else ()
        return pa.Table.from_batches(found, names_of(one, two))

    def names_of(one: pa.Table, two: pa.Table) -> pa.Schema:
        return pa.schema([(f"{key}_i", one.schema.field("_k").type), (f"{key}_j", two.schema.field("_k").type), *((n, pa.float64()) for n in parts)])

    return left.groupBy("_a", "_b").cogroup(right.groupBy("_a", "_b")).applyInArrow(blocks, schema)


def pair_gap(pairs: DataFrame, same: Column, value: str = "cosine", by: Sequence[str] = ()) -> DataFrame:
    """Mean and population sd within and between groups, and the gap of the means."""
    out = pairs.groupBy(*by).agg(
        F.count_if(same).alias("within_n"), F.count_if(~same).alias("between_n"), F.avg(F.when(same, F.col(value))).alias("within"), F.avg(F.when(~same, F.col(value))).alias("between"),
        F.stddev_pop(F.when(same, F.col(value))).alias("within_sd"), F.stddev_pop(F.when(~same, F.col(value))).alias("between_sd"),
    )
    return out.withColumn("gap", F.col("within") - F.col("between"))


def group_sums(df: DataFrame, vector: str, label: str, dim: int, squares: bool = True, units: bool = True) -> DataFrame:
    """Sums of unit vectors (without ``units``: of the vectors as they are) by label, from which means and sds of all pair cosines follow without pairs: label, kind, pos, v.

    Kinds: n (the count), s (the sum of the vectors) and, with squares, m (that of their outer
    products, row by row). Null vectors take no part. A task adds up its rows, holding MOST labels.
    """
    import numpy as np
    import pyarrow as pa

    def run(batches):
        sums: dict = {}

        def flushed():
            for g, (n, total, square) in sums.items():
                v = np.concatenate([[n], total, square.ravel() if squares else []])
                kind = ["n"] + ["s"] * dim + ["m"] * (len(v) - 1 - dim)
                pos = np.concatenate([[0], np.arange(dim), np.arange(len(v) - 1 - dim)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(v), kinds), pa.array(kind), pa.array(pos), pa.array(v)], names=[label, "kind", "pos", "v"])
            sums.clear()

        for batch in batches:
            kinds = batch.schema.field(label).type
            x = np.asarray(batch.column("_u").flatten()).reshape(len(batch), -1)
            groups = batch.column(label).dictionary_encode()
            at = np.asarray(groups.indices.fill_null(-1))
            for i in np.unique(at):
                part = x[at == i]
                g = None if i < 0 else groups.dictionary[int(i)].as_py()
                n, total, square = sums.get(g, (0, 0.0, 0.0))
                sums[g] = (n + len(part), total + part.sum(axis=0), square + part.T @ part if squares else 0.0)
            if len(sums) > MOST:
                yield from flushed()
        yield from flushed()

    rows = df.filter(F.col(vector).isNotNull()).select(label, (unit(F.col(vector)) if units else F.col(vector).cast("array<double>")).alias("_u"))
    parts = rows.mapInArrow(run, f"`{label}` {df.schema[label].dataType.simpleString()}, kind string, pos int, v double")
    return parts.groupBy(label, "kind", "pos").agg(F.sum("v").alias("v"))


def all_pairs_gap(df: DataFrame, vector: str, label: str, dim: int) -> DataFrame:
    """What pair_gap gives over all pairs of df with two labels that aren't null, in time linear in the rows.

    A sum over ordered pairs of cosines (or of their squares) is the squared length of a sum
    of vectors (of outer products), which holds each vector's pair with itself, 1, too.
    """
    each = group_sums(df.filter(F.col(label).isNotNull()), vector, label, dim)
    own = each.groupBy("kind").agg(F.sum(F.col("v") * F.col("v")).alias("own"), F.sum("v").alias("total"))
    every = each.groupBy("kind", "pos").agg(F.sum("v").alias("v")).groupBy("kind").agg(F.sum(F.col("v") * F.col("v")).alias("every"))
    get = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    n = F.coalesce(get("n", "total"), F.lit(0.0))
    # sums over ordered pairs: of 1, of the cosine and of its square
    within = {k: F.coalesce(get(k, "own"), F.lit(0.0)) - n for k in "nsm"}
    between = {k: F.coalesce(get(k, "every") - get(k, "own"), F.lit(0.0)) for k in "nsm"}
    sums = own.join(every, "kind").agg(*(f[k].alias(f"{name}{k}") for name, f in (("w", within), ("b", between)) for k in "nsm"))
    mean = lambda name, k: F.try_divide(F.col(f"{name}{k}"), F.col(f"{name}n"))
    sd = lambda name: F.sqrt(F.greatest(mean(name, "m") - mean(name, "s") * mean(name, "s"), F.when(mean(name, "s").isNotNull(), 0.0)))
    out = sums.select(
        F.round(F.col("wn") / 2).cast("bigint").alias("within_n"), F.round(F.col("bn") / 2).cast("bigint").alias("between_n"), mean("w", "s").alias("within"), mean("b", "s").alias("between"),
        sd("w").alias("within_sd"), sd("b").alias("between_sd"),
    )
    return out.withColumn("gap", F.col("within") - F.col("between"))


def group_means(df: DataFrame, vector: str, label: str, dim: int) -> DataFrame:
    """Mean cosine of all pairs of different rows between any two labels, both orders: label_i, label_j, cosine (null for a label of one row with itself)."""
    each = group_sums(df, vector, label, dim, squares=False)
    wide = each.groupBy(label).agg(F.max(F.when(F.col("kind") == "n", F.col("v"))).alias("n"), F.array_sort(F.collect_list(F.when(F.col("kind") == "s", F.struct("pos", "v")))).alias("s"))
    wide = wide.withColumn("s", F.col("s.v"))
    a, b = (wide.select(F.col(label).alias(f"{label}_{x}"), F.col("n").alias(f"n_{x}"), F.col("s").alias(f"s_{x}")) for x in "ij")
    same = F.when(F.col(f"{label}_i").eqNullSafe(F.col(f"{label}_j")), F.col("n_i")).otherwise(0.0)
    return a.crossJoin(b).select(f"{label}_i", f"{label}_j", F.try_divide(dot(F.col("s_i"), F.col("s_j")) - same, F.col("n_i") * F.col("n_j") - same).alias("cosine"))


def nearest_others(df: DataFrame, key: str, vector: str, label: str, block: int = NEAR_BLOCK) -> DataFrame:
    """Each row's nearest other one by cosine (ties: least key): k, l, ok, ol, cosine, and met, how many vectors it was compared with.

    Keys are unique. Vectors of one direction are searched once, for the least key among their rows
    (nearest_distinct); the others of such a group get that key, or their search's find where it
    is as near and has a smaller key, in a join that deals groups of more than COPIES rows to
    SALTS tasks. So a group of copies costs its size and not its square. Cosines are equal if
    they are to 12 digits. Null vectors take no part; a row without others has no row.
    """
    units = checkpointed(df.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(label).alias("l"), unit(F.col(vector)).alias("_u")))
    groups = checkpointed(units.groupBy("_u").agg(F.min(F.struct("k", "l")).alias("r"), F.count("*").alias("copies")).withColumn("h", F.xxhash64("_u")))
    found = nearest_distinct(groups.select("r.k", "r.l", "_u"), block)
    several = groups.filter("copies > 1")
    if several.isEmpty():
        return found
    found = checkpointed(found)
    # a group of more than COPIES rows, or than a 200th of all, is hot: at most 200 hashes pass the driver
    hot = [r.h for r in several.filter(F.col("copies") > max(COPIES, units.count() // 200)).select("h").collect()]
    salts = F.when(F.col("h").isin(hot), SALTS).otherwise(1) if hot else F.lit(1)
    known = several.select("h", "_u", F.col("r.k").alias("rk"), F.col("r.l").alias("rl")).join(found.select(F.col("k").alias("rk"), "ok", "ol", "cosine", "met"), "rk", "left")
    one = units.withColumn("h", F.xxhash64("_u")).withColumn("salt", F.pmod(F.xxhash64("k"), salts).cast("int"))
    members = checkpointed(one.join(known.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))), ["h", "_u", "salt"]).select("k", "l", "rk", "rl", "ok", "ol", "cosine", "met"))
    second = members.filter("k != rk").groupBy("rk").agg(F.min(F.struct("k", "l")).alias("s"))
    firsts = members.filter("k = rk").join(second, "rk").select("k", "l", F.col("s.k").alias("rk"), F.col("s.l").alias("rl"), "ok", "ol", "cosine", "met")
    copies = members.filter("k != rk").select(firsts.columns).unionByName(firsts)
    farther = F.col("ok").isNull() | (F.col("cosine") < 1) | ((F.col("cosine") <= 1) & (F.col("rk") < F.col("ok")))
    either = lambda near, far: F.when(farther, near).otherwise(F.col(far)).alias(far)
    grouped = copies.select("k", "l", either(F.col("rk"), "ok"), either(F.col("rl"), "ol"), either(F.lit(1.0), "cosine"), (F.coalesce("met", F.lit(0)) + 1).alias("met"))
    return found.join(several.select(F.col("r.k").alias("k")), "k", "left_anti").unionByName(grouped)


def nearest_distinct(units: DataFrame, block: int = NEAR_BLOCK) -> DataFrame:
    """nearest_others of unit vectors (k, l, _u) of which few are equal.

    Exact, by pivots on the sphere. Rows are dealt to the nearest of PIVOTS vectors at most;
    a cell knows its widest angle from its pivot. Small cells share a block of ``block`` rows or so, large ones are cut
    into several. In a first round a row is compared with its own cell's part of its block. In a second one it goes, once for
    each block, to the cells that may hold something as near: by the triangle inequality,
    nothing in a cell is nearer than the row's angle to the pivot less the widest angle. On vectors
    without structure that is every cell, and the time is quadratic; on clustered ones it is few.
    A task holds two blocks, and rows travel once for each pair of blocks.
    """
    import numpy as np
    import pyarrow as pa

    kind = units.schema["l"].dataType.simpleString()
    found_schema = f"k long, l {kind}, ok long, ol {kind}, cosine double, met long"
    total = units.count()
    chosen = units.select("_u").orderBy(F.xxhash64("_u"), "k").limit(min(PIVOTS, max(1, 16 * total // block))).toArrow()
    if not chosen.num_rows:
        return units.sparkSession.createDataFrame([], found_schema)
    table = np.array(chosen["_u"].to_pylist())
    sent = units.sparkSession.sparkContext.broadcast(table)  # at most PIVOTS vectors
    angles_to = lambda x, pivots: np.arccos(np.clip(x @ pivots.T, -1, 1))
    rows_of = lambda column, n: np.asarray((column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()).reshape(n, -1)

    def assign(batches):
        for batch in batches:
            if len(batch):
                angles = angles_to(rows_of(batch.column("_u"), len(batch)), sent.value)
                cell = angles.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angles[np.arange(len(cell)), cell])], names=[*batch.schema.names, "cell", "angle"])

    dealt = checkpointed(units.mapInArrow(assign, f"k long, l {kind}, _u array<double>, cell int, angle double"))
    cells = [tuple(r) for r in dealt.groupBy("cell").agg(F.max("angle"), F.count("*")).collect()]  # at most PIVOTS rows
    wide, parts, first = np.zeros(len(table)), np.zeros(len(table), np.int64), np.zeros(len(table), np.int64)
    near_first, at, held_rows = angles_to(table, table[:1])[:, 0], -1, block
    for cell, angle, n in sorted(cells, key=lambda c: (near_first[c[0]], c[0])):
        wide[cell], parts[cell] = angle, -(-n // block)
        if held_rows + n > block:  # a new block, or as many as a large cell needs
            at, held_rows = at + 1, 0
        first[cell], held_rows = at, held_rows + n
        at += parts[cell] - 1
    lookup = lambda values: F.array(*(F.lit(int(v)) for v in values))
    own = F.get(lookup(first), "cell") + F.pmod(F.xxhash64("k"), F.get(lookup(parts), "cell"))
    blocked = checkpointed(dealt.withColumn("b", own.cast("int")))

    def nearest(x, keys, y, names) -> tuple:
        """For each row of x: the place of the nearest row of y, which is in order of keys, the cosine, and the number of rows met."""
        best, at, met = np.full(len(x), -np.inf), np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for a in range(0, len(x) if len(y) else 0, 512):
            cos = np.round(x[a : a + 512] @ y.T, 12)
            same = keys[a : a + 512, None] == names
            cos[same] = -np.inf
            met[a : a + 512] = (~same).sum(axis=1)
            at[a : a + 512] = cos.argmax(axis=1)
            best[a : a + 512] = cos[np.arange(len(cos)), at[a : a + 512]]
        return best, at, met

    def by_cells(one: pa.Table, two: pa.Table, asked: dict) -> dict:
        """The nearest among those cells of two, in order of keys, that each row of one asks for: ``asked`` has the rows of one by cell."""
        x, y = rows_of(one["_u"], one.num_rows), rows_of(two["_u"], two.num_rows)
        keys, names, cell = np.asarray(one["k"]), np.asarray(two["k"]), np.asarray(two["cell"])
        best, at, met = np.full(len(x), -np.inf), np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for c in np.unique(cell):
            if c not in asked:
                continue
            rows, columns = asked[c], np.flatnonzero(cell == c)
            cos, place, n = nearest(x[rows], keys[rows], y[columns], names[columns])
            place = columns[place]
            better = (cos > best[rows]) | ((cos == best[rows]) & (cos > -np.inf) & (names[place] < names[at[rows]]))
            best[rows[better]], at[rows[better]] = cos[better], place[better]
            met[rows] += n
        found = np.where(best > -np.inf, at, 0)
        take = lambda c: two[c].take(pa.array(found, mask=best == -np.inf)) if two.num_rows else pa.nulls(len(best), one.schema.field(c).type)
        return {"k": one["k"], "l": one["l"], "ok": take("k"), "ol": take("l"), "cosine": pa.array(best), "met": pa.array(met)}

    def inside(part: pa.Table) -> pa.Table:
        part = part.sort_by("k")
        cell = np.asarray(part["cell"])
        return pa.table(by_cells(part, part, {c: np.flatnonzero(cell == c) for c in np.unique(cell)}) | {"_u": part["_u"], "cell": part["cell"], "b": part["b"]})

    near = checkpointed(blocked.groupBy("b").applyInArrow(inside, f"{found_schema}, _u array<double>, cell int, b int"))

    def visits(batches):
        """The blocks that each row has to go to, and which cells it asks for there."""
        to = pa.list_(pa.struct([("c", pa.int32()), ("cells", pa.list_(pa.int32()))]))
        for batch in batches:
            if not len(batch):
                continue
            best = np.asarray(batch.column("cosine"))
            bound = np.where(best > -np.inf, np.arccos(np.clip(np.where(best > -np.inf, best, -1) - 2e-12, -1, 1)), np.inf) + 1e-6
            angles = angles_to(rows_of(batch.column("_u"), len(batch)), sent.value)
            goes = (angles - wide <= bound[:, None]) & (parts > 0)
            lists = []
            for row, b, mine in zip(goes, np.asarray(batch.column("b")), np.asarray(batch.column("cell"))):
                to_block: dict[int, list[int]] = {}
                for cell in np.flatnonzero(row):
                    for c in range(first[cell], first[cell] + parts[cell]):
                        if c != b or cell != mine:
                            to_block.setdefault(int(c), []).append(int(cell))
                lists.append([{"c": c, "cells": asked} for c, asked in to_block.items()])
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("l"), batch.column("_u"), batch.column("b"), pa.array(lists, to)], names=["k", "l", "_u", "q", "v"])

    asked = near.mapInArrow(visits, f"k long, l {kind}, _u array<double>, q int, v array<struct<c: int, cells: array<int>>>").select("k", "l", "_u", "q", F.inline("v"))
    pairs = asked.select(F.col("q").alias("by"), F.col("c").alias("of")).distinct()
    held = pairs.join(blocked.select(F.col("k").alias("hk"), F.col("l").alias("hl"), F.col("_u").alias("hu"), "cell", F.col("b").alias("of")), "of").select("by", "of", "hk", "hl", "hu", "cell")

    def across(one: pa.Table, two: pa.Table) -> pa.Table:
        two = two.rename_columns(["by", "of", "k", "l", "_u", "cell"]).sort_by("k")  # the first maximum is the least key's
        cells = one["cells"].combine_chunks()
        row = np.repeat(np.arange(one.num_rows), np.asarray(cells.value_lengths()))
        cell = np.asarray(cells.flatten())
        return pa.table(by_cells(one, two, {c: row[cell == c] for c in np.unique(cell)}))

    far = asked.groupBy("q", "c").cogroup(held.groupBy("by", "of")).applyInArrow(across, found_schema)
    every = near.select("k", "l", "ok", "ol", "cosine", "met").unionByName(far)
    top = every.groupBy("k", "l").agg(F.max_by(F.struct("ok", "ol", "cosine"), F.when(F.col("ok").isNotNull(), F.struct("cosine", (-F.col("ok")).alias("o")))).alias("n"), F.sum("met").alias("met"))
    return top.filter("n IS NOT NULL").select("k", "l", "n.*", "met")


def nearest_agreement(df: DataFrame, key: str, vector: str, label: str, block: int = NEAR_BLOCK) -> DataFrame:
    """By label: n and agree, the vectors whose nearest other one (ties: least key) has their label (see nearest_others)."""
    top = nearest_others(df, key, vector, label, block)
    return top.groupBy(F.col("l").alias(label)).agg(F.count("*").alias("n"), F.count_if(F.col("ol") == F.col("l")).alias("agree"))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def logsumexp(logits: Column) -> Column:
    top = F.array_max(logits)
    return top + F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def argmax(logits: Column) -> Column:
    """0-based place of the first maximum."""
    return F.array_position(logits, F.array_max(logits)).cast("int") - 1


def two_way(margin: Column) -> Column:
    """struct(p, branch): the probability of the first of two, and whether the margin is at least 0."""
    return F.struct((1 / (1 + F.exp(-margin))).alias("p"), (margin >= 0).alias("branch"))


def joint_decode(logits: Column, distances: int) -> Column:
    """struct(direction, distance) of the best joint action: its index divided by the number of distances."""
    at = argmax(logits)
    return F.struct(F.floor(at / distances).cast("int").alias("direction"), F.pmod(at, F.lit(distances)).alias("distance"))


def direction_first(logits: Column, directions: int, distances: int) -> Column:
    """struct(direction, distance, marginal): the direction of the greatest log-sum, then its best distance."""
    blocks = F.transform(F.sequence(F.lit(0), F.lit(directions - 1)), lambda d: F.slice(logits, d * distances + 1, distances))
    sums = F.transform(blocks, logsumexp)
    d = argmax(sums)
    return F.struct(d.alias("direction"), argmax(F.element_at(blocks, d + 1)).alias("distance"), F.array_max(sums).alias("marginal"))


def cross_entropy(logits: Column, target: Column, smoothing: float = 0.0) -> Column:
    """Against a target that has 1 - smoothing, the rest shared by all entries."""
    mean = F.aggregate(logits, F.lit(0.0), lambda a, x: a + x) / F.size(logits)
    return logsumexp(logits) - (1 - smoothing) * F.element_at(logits, (target + 1).cast("int")) - smoothing * mean


def safe_bounds(low: Column, high: Column, cap: float) -> Column:
    """struct(low, high) narrowed on both sides by the lesser of cap and a quarter of the slack."""
    margin = F.least(F.lit(cap), (high - low) / 4)
    return F.struct((low + margin).alias("low"), (high - margin).alias("high"))


def preferred(df: DataFrame, by: Sequence[str], direction: str, distance: str, robust: Column) -> DataFrame:
    """The robust actions of least distance in each direction, ties kept."""
    rank = F.rank().over(Window.partitionBy(*by, direction).orderBy(distance))
    return df.filter(robust).withColumn("_r", rank).filter("_r = 1").drop("_r")


def principal_axes(df: DataFrame, vector: str, dim: int, k: int = 2) -> tuple[list[float], list[list[float]], list[float]]:
    """The vectors' mean, their first k principal axes and the variance along each.

    Tasks add up their vectors and outer products; what meets on the driver is one
    matrix of dim by dim, whatever the number of rows. An axis points to where its
    component of greatest size (to 9 places; ties: the first) is positive, so reruns agree.
    """
    import numpy as np

    rows = group_sums(df.withColumn("_all", F.lit(0)), vector, "_all", dim, units=False).collect()  # 1 + dim + dim * dim rows
    n, total, square = 0.0, np.zeros(dim), np.zeros(dim * dim)
    for r in rows:
        if r["kind"] == "n":
            n = r["v"]
        else:
            (total if r["kind"] == "s" else square)[r["pos"]] = r["v"]
    mean = total / max(n, 1)
    values, axes = np.linalg.eigh(square.reshape(dim, dim) / max(n, 1) - np.outer(mean, mean))
    axes = axes.T[::-1][:k]
    signs = [np.sign(a[np.argmax(np.round(np.abs(a), 9))]) for a in axes]
    return mean.tolist(), [(a * s).tolist() for a, s in zip(axes, signs)], np.maximum(values[::-1][:k], 0).tolist()


def projected(df: DataFrame, vector: str, dim: int, k: int = 2) -> DataFrame:
    """df with ``pca``: each vector less the mean, along the first k principal axes of all; null for a null vector."""
    mean, axes, _ = principal_axes(df, vector, dim, k)
    literal = lambda values: F.array(*map(F.lit, values))
    along = [dot(F.col(vector), literal(a)) - sum(x * y for x, y in zip(mean, a)) for a in axes]
    return df.withColumn("pca", F.when(F.col(vector).isNotNull(), F.array(*along)))


def smooth_l1(error: Column, beta: float = 1.0) -> Column:
    """Half the square below beta (over it), the absolute value less half of beta beyond."""
    e = F.abs(error)
    return F.when(e < beta, e * e / (2 * beta)).otherwise(e - beta / 2)


def interval_loss(predicted: Column, low: Column, high: Column) -> Column:
    """Smooth L1 of how far a prediction lies outside its safe interval; 0 within."""
    return smooth_l1(F.greatest(low - predicted, predicted - high, F.lit(0.0)))


def acceptable_nll(logits: Column, acceptable: Column) -> Column:
    """Negative log of the probability of all acceptable entries together; null without any."""
    kept = F.transform(F.filter(F.arrays_zip(logits.alias("l"), acceptable.alias("a")), lambda z: z["a"]), lambda z: z["l"])
    return F.when(F.size(kept) > 0, logsumexp(logits) - logsumexp(kept))


def ranking_loss(logits: Column, acceptable: Column, margin: float = 1.0) -> Column:
    """How far the best entry that isn't acceptable comes within the margin of the best that is; 0 beyond, null unless there are both."""
    zipped = F.arrays_zip(logits.alias("l"), acceptable.alias("a"))
    best = lambda want: F.array_max(F.transform(F.filter(zipped, lambda z: z["a"] == want), lambda z: z["l"]))
    return F.greatest(best(F.lit(False)) - best(F.lit(True)) + margin, F.when(best(F.lit(True)).isNotNull() & best(F.lit(False)).isNotNull(), 0.0))
