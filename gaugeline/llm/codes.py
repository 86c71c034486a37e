"""Codes of vectors: every part of a vector becomes the number of the nearest entry of a codebook, found by Lloyd's rounds.

Parts are members of an entry and live with it: their rows are partitioned by (position, entry, salt), an *owner*. In a round each owner
tests its resident members against the codebooks, which every task has, as they are small. Members that keep their entry stay where they
are, without a shuffle; only those that change it migrate to their new owner. Then the owners add up their residents, and the sums per
entry give the next codebooks. The salt splits the owners of a much used entry, so no owner grows with its entry.

All numbers are integers: a component ``x`` counts as ``floor(scale * x)``, at most so large that no squared distance passes 64 bits.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.session import materialize, scratch_dir

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
OWNED = 1024  # members per owner, about, if all entries were one
HOT = 1000  # labels with at least one row in so many are looked up in a broadcast, at most as many labels


@dataclass
class Codebooks:
    """Entries as (part, entry, component); components fill a whole number of parts, behind the vector's own come zeros."""

    entries: np.ndarray
    dims: int

    def digest(self) -> str:
        """SHA-256 of all components as decimal numbers by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of one position the nearest entry, the first of several, and its squared distance, in whole numbers."""
    best, at = None, np.zeros(len(parts), np.int64)
    for i, entry in enumerate(entries):
        far = parts - entry
        far = np.einsum("ij,ij->i", far, far)
        if best is None:
            best = far
        else:
            closer = far < best
            at[closer] = i
            best = np.where(closer, far, best)
    return at, best


def _limit(dims: int) -> int:
    """Largest component counted, so that a squared distance over all components stays below 2 ** 62."""
    return int(np.sqrt(2.0**60 / max(dims, 1)))


def whole_numbers(df: DataFrame, id_col: str, vector_col: str, scale: int, more: list[str]) -> DataFrame:
    """``row, id, vector`` and ``more``: vectors as little-endian 64-bit integers; rows without a usable vector are left out."""
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), *[F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(more)], F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    fields = [f if f.name != "vector" else T.StructField("vector", T.BinaryType()) for f in rows.schema.fields]

    def run(batches):
        for batch in batches:
            column = batch.column("vector")
            flat, starts = column.values, column.offsets.to_numpy()
            value = flat.to_numpy(zero_copy_only=False).astype(float)  # null components become NaN
            sizes = np.diff(starts)
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(value))))
            good = column.is_valid().to_numpy(zero_copy_only=False) & (sizes > 0) & (bad[starts[1:]] == bad[starts[:-1]])
            out = []
            for i in np.flatnonzero(good):
                x = value[starts[i] : starts[i + 1]]
                most = _limit(len(x))
                out.append(np.clip(np.floor(scale * x), -most, most).astype("<i8").tobytes())
            kept = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([*kept.columns[:-1], pa.array(out, pa.binary())], batch.schema.names)

    return rows.mapInArrow(run, T.StructType(fields))


def _parts(vectors: list[bytes], dims: int, parts: int) -> np.ndarray:
    """(row, part, component), with zeros behind vectors whose length is not a multiple of the parts."""
    x = np.frombuffer(b"".join(vectors), "<i8").reshape(len(vectors), dims)
    wide = -(-dims // parts) * parts
    if wide > dims:
        x = np.concatenate((x, np.zeros((len(x), wide - dims), np.int64)), 1)
    return x.reshape(len(x), parts, wide // parts)


MEMBER = "row long, position int, entry int, salt int, part binary"


def _placed(books, dims: int, parts: int, salts: int):
    """The first owners: every vector's parts at their nearest entries."""

    def run(batches):
        for batch in batches:
            row = batch.column("row").to_numpy()
            x = _parts(batch.column("vector").to_pylist(), dims, parts)
            for p in range(parts):
                entry, _ = nearest(x[:, p], books.value[p])
                yield _members(row, np.full(len(row), p, np.int32), entry, salts, x[:, p])

    return run


def _salt(row: np.ndarray, salts: int) -> np.ndarray:
    spread = row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((spread >> np.uint64(33)) % np.uint64(salts)).astype(np.int32)


def _members(row, position, entry, salts: int, part: np.ndarray) -> pa.RecordBatch:
    raw = np.ascontiguousarray(part, "<i8")
    width = raw.shape[1] * 8
    binary = pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer((np.arange(len(raw) + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
    columns = [pa.array(row), pa.array(position, pa.int32()), pa.array(entry.astype(np.int32)), pa.array(_salt(row, salts)), binary]
    return pa.RecordBatch.from_arrays(columns, ["row", "position", "entry", "salt", "part"])


def _tested(books):
    """Residents with their entry under new codebooks and whether they have to move; rows come in any order."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            position, had = batch.column("position").to_numpy(), batch.column("entry").to_numpy()
            x = np.frombuffer(b"".join(batch.column("part").to_pylist()), "<i8").reshape(batch.num_rows, -1)
            entry = np.zeros(len(x), np.int32)
            for p in np.unique(position):
                own = np.flatnonzero(position == p)
                entry[own] = nearest(x[own], books.value[p])[0]
            c = batch.columns
            yield pa.RecordBatch.from_arrays([c[0], c[1], pa.array(entry), c[3], c[4], pa.array(entry != had)], [*batch.schema.names, "moves"])

    return run


def _added(parts: int, entries: int):
    """Sums and counts of one task's residents per owner's entry."""

    def run(batches):
        total = count = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("position").to_numpy().astype(np.int64) * entries + batch.column("entry").to_numpy()
            x = np.frombuffer(b"".join(batch.column("part").to_pylist()), "<i8").reshape(batch.num_rows, -1)
            if total is None:
                total, count = np.zeros((parts * entries, x.shape[1]), np.int64), np.zeros(parts * entries, np.int64)
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            total[key[order][first]] += np.add.reduceat(x[order], first, axis=0)
            count += np.bincount(key, minlength=parts * entries)
        if total is not None:
            some = np.flatnonzero(count)
            sums = pa.array(total[some].tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), sums], ["owner", "n", "sums"])

    return run


def _read(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.schema(MEMBER).parquet(*paths)


def _remove(spark: SparkSession, path: str) -> None:
    """A generation of members that has been followed by the next."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def train(vectors: DataFrame, seeds: np.ndarray, dims: int, rows: int, parts: int = PARTS, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks after ``rounds`` rounds from ``seeds`` (part, entry, component), for ``vectors (row, vector)`` of one length. Runs jobs.

    ``rows`` only sets how many owners an entry is split into. A round in which no member moves ends the work, as all further ones would be
    the same. Every generation of members is written to the shared folder before the one before it is removed, so lost executors cost one round.
    """
    spark, entries = vectors.sparkSession, seeds.shape[1]
    salts, books = max(1, -(-rows // OWNED)), seeds
    owners = ["position", "entry", "salt"]
    own: list[str] = []
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(books)
        if turn == 0:
            first = vectors.select("row", "vector").mapInArrow(_placed(shared, dims, parts, salts), MEMBER)
            home = scratch_dir(spark, "members")
            first.repartition(*owners).write.parquet(f"{home}/came")
            following, moved = [f"{home}/came"], True
        else:
            home = scratch_dir(spark, "members")
            _read(spark, own).mapInArrow(_tested(shared), MEMBER + ", moves boolean").write.partitionBy("moves").parquet(f"{home}/tested")
            tested = spark.read.schema(MEMBER + ", moves boolean").parquet(f"{home}/tested")
            movers = tested.where("moves").drop("moves")
            moved = not movers.isEmpty()
            following = [f"{home}/tested/moves=false"] if not tested.where("not moves").isEmpty() else []
            if moved:
                movers.repartition(*owners).write.parquet(f"{home}/came")
                following.append(f"{home}/came")
        if not moved:
            break
        for path in own:
            _remove(spark, path)
        own = following
        sums = _read(spark, own).mapInArrow(_added(parts, entries), "owner long, n long, sums array<long>")
        width = seeds.shape[2]
        sums = sums.groupBy("owner").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)])
        books = books.copy()
        for r in sums.collect():  # one row per entry of each part
            books[r["owner"] // entries, r["owner"] % entries] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return Codebooks(books, dims)


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """``vectors`` with ``code`` (two hex digits per part) and ``error`` (squared distances over all parts) in place of ``vector``. Lazy, no shuffle."""
    shared, dims = vectors.sparkSession.sparkContext.broadcast(books.entries), books.dims
    fields = [f for f in vectors.schema.fields if f.name != "vector"]

    def run(batches):
        for batch in batches:
            b = shared.value
            x = _parts(batch.column("vector").to_pylist(), dims, len(b))
            found = [nearest(x[:, p], b[p]) for p in range(len(b))]
            hexes = np.stack([f[0] for f in found], 1).astype(np.uint8)
            error = sum((f[1] for f in found), np.zeros(len(x), np.int64))
            kept = batch.drop_columns(["vector"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([h.tobytes().hex() for h in hexes], pa.string()), pa.array(error)], [*kept.schema.names, "code", "error"])

    return vectors.mapInArrow(run, T.StructType([*fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))


def decode(codes: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """``codes`` with a column ``vector``: the entries the code names, as numbers of the vectors' own scale. Lazy."""
    shared, dims = codes.sparkSession.sparkContext.broadcast(books.entries), books.dims
    at = codes.columns.index("code")

    def run(batches):
        for batch in batches:
            b = shared.value
            code = np.array([list(bytes.fromhex(c)) for c in batch.column(at).to_pylist()], np.int64).reshape(-1, len(b))
            x = b[np.arange(len(b)), code].reshape(len(code), -1)[:, :dims] / scale
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x.tolist(), pa.list_(pa.float64()))], [*batch.schema.names, "vector"])

    return codes.mapInArrow(run, T.StructType([*codes.schema.fields, T.StructField("vector", T.ArrayType(T.DoubleType()))]))


def with_group_sum(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """``df`` and the sum of ``value`` over its rows with equal ``group``, nulls together; null where the sum passes 64 bits.

    Groups with at least one row in ``HOT``, of which there are at most ``HOT``, are looked up in a broadcast, the others joined.
    """
    key = F.struct(F.col(group).alias("g"))  # a struct is equal to itself where its field is null
    sums = materialize(df.groupBy(key.alias("_key")).agg(F.count("*").alias("_n"), F.try_sum(value).alias(name)), "groups")
    rows = sums.agg(F.sum("_n")).first()[0] or 0
    hot = sums.where(F.col("_n") * HOT >= rows).select("_key", F.col(name).alias("_hot"), F.lit(True).alias("_is"))
    keyed = df.withColumn("_key", key).join(F.broadcast(hot), "_key", "left")
    often = keyed.where("_is").withColumn(name, F.col("_hot"))
    rest = keyed.where("_is is null").join(sums.select("_key", name), "_key")
    return often.select(*df.columns, name).unionByName(rest.select(*df.columns, name))


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Codebooks]:
    """``<id>, code, error, label_error`` per usable row of ``df``, and the codebooks.

    Usable rows hold a vector that is not null or empty and has only finite components, as many as that of the first such row by id (then by
    vector; null ids last). The codebooks start from the first ``ENTRIES`` rows in this order, or as many as there are. Vectors whose
    length is no multiple of the parts are filled up with zeros. Components beyond what 64-bit distances allow (over 130,000 for 64 components)
    count as that limit. Null ids and repeated rows are rows like others; an empty table gives no rows. Other columns are ignored. Runs jobs.
    """
    spark = df.sparkSession
    vectors = materialize(whole_numbers(df, id_col, vector_col, SCALE, [label_col]), "vectors")
    size = F.octet_length("vector")
    order = [F.col("id").asc_nulls_last(), "vector"]
    head = vectors.orderBy(*order).select("vector").first()
    width = len(head[0]) if head else 8
    usable = vectors.where(size == width)
    first = [r[0] for r in usable.orderBy(*order).select("vector").limit(ENTRIES).collect()]
    dims = width // 8
    if first:
        seeds = np.ascontiguousarray(_parts(first, dims, PARTS).transpose(1, 0, 2))
        books = train(usable, seeds, dims, usable.count())
    else:
        books = Codebooks(np.zeros((PARTS, 0, 1), np.int64), dims)
    coded = materialize(encode(usable.drop("row"), books), "codes")
    out = with_group_sum(coded, "x0", "error", "label_error")
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error"), books


def digest(coded: DataFrame, books: Codebooks) -> DataFrame:
    return coded.withColumn("codebooks_sha256", F.lit(books.digest()))
