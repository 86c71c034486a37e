"""Shards along a Hilbert curve through several metadata columns, with DataFrame functions only.

Every dimension is cut into ``2 ** bits`` cells that hold about equally many rows. The cells' Hilbert index orders the rows so that rows near
in all dimensions lie near in the order, and the order is cut into runs: one run is one shard, and a shard (or each file of it) covers a
small range of every dimension. Ranks are exact: sums of ranges of the order plus a running sum inside each range. Rows alike in id and
text are counted before the shuffle, so that no range of the order can be filled by one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.session import materialize

BITS = 5  # cells per dimension: 2 ** BITS
RUN = 1 << 16  # copies of one row that one task places


def hilbert_tables(n: int) -> tuple[list[int], list[int]]:
    """Digit and next state for ``state * 2**n + cell corner`` of the n-dimensional curve; state 0 is the start.

    A state is a corner at which the curve enters a cube and the axis along which it leaves it.
    """
    full = (1 << n) - 1
    turn = lambda x, k: ((x >> (k % n)) | (x << (n - k % n))) & full
    back = lambda x, k: turn(x, n - k % n)
    gray = lambda x: x ^ (x >> 1)
    rank = {gray(x): x for x in range(full + 1)}
    ones = lambda x: (~x & (x + 1)).bit_length() - 1  # noqa: E731  number of ones at the low end
    digit, follow = [], []
    for state in range((full + 1) * n):
        corner, axis = divmod(state, n)
        for cell in range(full + 1):
            w = rank[turn(cell ^ corner, axis + 1)]
            enter = 0 if w == 0 else gray((w - 1) // 2 * 2)
            leave = 0 if w == 0 else ones(w - 1 if w % 2 == 0 else w) % n
            digit.append(w)
            follow.append((corner ^ back(enter, axis + 1)) * n + (axis + leave + 1) % n)
    return digit, follow


def hilbert(cells: list[Column], bits: int) -> Column:
    """Index on the curve of a cell, given by one integer below ``2 ** bits`` per dimension."""
    n = len(cells)
    digit, follow = (F.array(*map(F.lit, t)) for t in hilbert_tables(n))
    corners = [sum((F.shiftright(c, level).bitwiseAND(1) * (1 << i) for i, c in enumerate(cells)), F.lit(0)) for level in reversed(range(bits))]

    def step(at: Column, corner: Column) -> Column:
        k = at["state"] * (1 << n) + corner
        return F.struct((at["index"] * (1 << n) + F.get(digit, k)).alias("index"), F.get(follow, k).alias("state"))

    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("state"))
    return F.aggregate(F.array(*corners), start, step, lambda at: at["index"])


def running(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """``df`` and, for each ``name: column``, the exact sum of the column over all rows before this one in the order, and ``all_<name>``.

    No two rows may be alike in ``order``. Rows are dealt out by ranges of the order; only one row per range is gathered.
    """
    ranged = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_ahead_{n}") for n, c in sums.items()])
    ahead, every = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    totals = totals.select("_range", *[F.coalesce(F.sum(f"_ahead_{n}").over(ahead), F.lit(0)).alias(f"_ahead_{n}") for n in sums], *[F.sum(f"_ahead_{n}").over(every).alias(f"all_{n}") for n in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(n) for n, c in sums.items()]).join(F.broadcast(totals), "_range")
    return rows.select(*df.columns, *[(F.col(n) + F.col(f"_ahead_{n}")).alias(n) for n in sums], *[f"all_{n}" for n in sums])


def _sortable(df: DataFrame, dim: str) -> tuple[Column, Column]:
    """A dimension's value as a number or as a text; the other of the two is null."""
    number = isinstance(df.schema[dim].dataType, T.NumericType)
    value = F.col(f"`{dim}`").cast("double" if number else "string")
    none = F.lit(None).cast("string" if number else "double")
    return (value, none) if number else (none, value)


def cell_cuts(df: DataFrame, dims: list[str], bits: int = BITS) -> list[list[tuple[object, int]]]:
    """For each dimension ``(least value, cell)``, ascending, at most ``2 ** bits``: a value's cell is the share of rows below it. Runs jobs."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), n.alias("num"), s.alias("txt")) for i, (n, s) in enumerate(_sortable(df, d) for d in dims)]))
    values = df.select(each.alias("v")).select("v.*").where("num is not null or txt is not null").groupBy("dim", "num", "txt").agg(F.count("*").alias("n"))
    ranked = running(values, ["dim", "num", "txt"], {"before": "n"})
    per = values.groupBy("dim").agg(F.sum("n").alias("rows")).select("dim", "rows", (F.sum("rows").over(Window.orderBy("dim")) - F.col("rows")).alias("ahead"))
    cell = F.expr(f"cast(((before - ahead) * {1 << bits}) div rows as int)")
    least = ranked.join(F.broadcast(per), "dim").groupBy("dim", cell.alias("cell")).agg(F.min("num").alias("num"), F.min("txt").alias("txt"))
    cuts = [[] for _ in dims]
    for r in least.orderBy("dim", "cell").collect():  # at most 2 ** bits rows per dimension
        cuts[r["dim"]].append((r["num"] if r["num"] is not None else r["txt"], r["cell"]))
    return cuts


def curve_index(df: DataFrame, dims: list[str], cuts, bits: int = BITS) -> Column:
    """The rows' index on the curve; null values lie in the first cell."""

    def pick(value: Column, some) -> Column:
        if len(some) < 2:
            return F.lit(some[0][1] if some else 0)
        middle = len(some) // 2
        return F.when(value < F.lit(some[middle][0]), pick(value, some[:middle])).otherwise(pick(value, some[middle:]))

    cells = []
    for dim, some in zip(dims, cuts):
        number, text = _sortable(df, dim)
        value = number if isinstance(df.schema[dim].dataType, T.NumericType) else text
        cells.append(F.when(value.isNull(), 0).otherwise(pick(value, some)))
    return hilbert(cells, bits)


def place(df: DataFrame, dims: list[str], shards: int = 16, law: str = "rows", id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """``<id>, size, text_crc32, law, shard, slot, grown_shard, curve``: one row per row of ``df``.

    Law ``rows`` cuts the order into runs whose counts differ by one at most; ``bytes`` cuts it where the bytes before a row reach the
    next shard's share, so that a shard differs from its share by less than its last row. ``slot`` counts from 0 in the order inside a
    shard; ``grown_shard`` is null, as a new cut moves all runs. Ties on the curve are ordered by size, checksum and id. A null text counts as
    empty, its size is 1; null ids and repeated rows are rows like others; null dimensions lie in the first cell. Empty
    tables give no rows. Other columns are ignored. Runs jobs.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"law {law!r} is neither 'rows' nor 'bytes'")
    named = [F.col(f"`{d}`").alias(f"_dim{i}") for i, d in enumerate(dims)]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    narrow = materialize(df.select(F.col(f"`{id_col}`").alias("_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *named), "narrow")
    inner = [f"_dim{i}" for i in range(len(dims))]
    index = curve_index(narrow, inner, cell_cuts(narrow, inner, bits), bits)
    alike = narrow.select("_id", "size", "text_crc32", index.alias("curve")).groupBy("curve", "size", "text_crc32", "_id").agg(F.count("*").alias("n"))
    order = ["curve", "size", "text_crc32", "_id"]
    placed = running(alike.withColumn("_bytes", F.col("size") * F.col("n")), order, {"rank": "n", "bytes": "_bytes"})
    few = placed.where(F.col("n") <= RUN).withColumn("_i", F.explode(F.expr("sequence(0L, n - 1)")))
    blocks = placed.where(F.col("n") > RUN).withColumn("_block", F.explode(F.expr(f"sequence(0L, (n - 1) div {RUN})"))).repartition("rank", "_block")
    many = blocks.withColumn("_i", F.explode(F.expr(f"sequence(_block * {RUN}, least(n, (_block + 1) * {RUN}) - 1)"))).drop("_block")
    rows = few.unionByName(many).withColumns({"rank": F.col("rank") + F.col("_i"), "bytes": F.col("bytes") + F.col("_i") * F.col("size")})
    if law == "rows":
        rows = rows.withColumn("shard", F.expr(f"cast((rank * {shards}) div all_rank as int)"))
        rows = rows.withColumn("slot", F.expr(f"rank - (shard * all_rank + {shards - 1}) div {shards}"))
    else:
        # A decimal, as bytes times shards may pass 64 bits.
        rows = rows.withColumn("shard", F.expr(f"cast(floor(cast(bytes as decimal(30, 0)) * {shards} / all_bytes) as int)"))
        first = rows.groupBy("shard").agg(F.min("rank").alias("_first"))  # one row per shard
        rows = rows.join(F.broadcast(first), "shard").withColumn("slot", F.col("rank") - F.col("_first"))
    none = F.lit(None).cast("int").alias("grown_shard")
    return rows.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", none, "curve")


def write(df: DataFrame, path: str, dims: list[str], shards: int = 16, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> None:
    """Whole rows of ``df`` as Parquet in folders ``shard=0`` and so on, each file one run of the curve in order.

    The cuts are those of ``place`` with law ``rows``; rows alike in id and text that a cut would part lie before it. ``df`` must not hold
    the columns ``shard`` and ``_curve``, ``_size``, ``_crc``. Runs jobs.
    """
    taken = {"shard", "_curve", "_size", "_crc"} & set(df.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are taken")
    key = F.struct(*[F.col(c) for c in ("curve", "size", "text_crc32")], F.col(id_col).alias("id"))
    firsts = place(df, dims, shards, "rows", id_col, text_col, bits).groupBy("shard").agg(F.min(key).alias("k"), F.max(key).alias("last")).orderBy("shard").collect()  # one row per shard
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    cuts = cell_cuts(df, dims, bits)
    keyed = df.withColumns({"_curve": curve_index(df, dims, cuts, bits), "_size": (F.octet_length(text) + 1).cast("long"), "_crc": F.crc32(text)})
    own = F.struct(F.col("_curve").alias("curve"), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.col(f"`{id_col}`").alias("id"))
    shard = F.lit(firsts[-1]["shard"] if firsts else 0)
    for r in reversed(firsts[:-1]):
        last = F.struct(*[F.lit(v).alias(n) for n, v in zip(("curve", "size", "text_crc32", "id"), r["last"])])
        shard = F.when(own <= last, F.lit(r["shard"])).otherwise(shard)
    order = ["shard", "_curve", "_size", "_crc", f"`{id_col}`"]
    out = keyed.withColumn("shard", shard).repartitionByRange(*order).sortWithinPartitions(*order).drop("_curve", "_size", "_crc")
    out.write.partitionBy("shard").parquet(path)
