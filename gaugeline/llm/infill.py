"""Fill-in-the-middle texts, cut at line ends that a learned rank index finds.

The offsets of all line ends of a block of texts are approximated by straight pieces over their rank: a text starts as one piece from its
first to its last end, and a piece that misses one of its ends by more than ``ERROR`` bytes is halved, all pieces of the block in step.
What is stored is one rank and offset per piece and, for every end, the small difference to the piece's value. A cut asks for the offset
of a rank: the piece gives a prediction, and the stored difference makes it exact.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeline.llm import bytesops as B

ERROR = 127  # bytes a piece may miss an end by: differences fit in one byte
MARKS = (b"<P>", b"<S>", b"<M>")
SHAPE = [("n", "long"), ("form", "string"), ("prefix_chars", "long"), ("middle_chars", "long"), ("output", "string")]


@dataclass
class RankIndex:
    """Exact offsets by rank for several sorted runs of offsets laid one behind the other."""

    ranks: np.ndarray  # first rank of each piece, and the number of ranks
    offsets: np.ndarray  # offset at that rank
    rise: np.ndarray  # bytes and ranks to the piece's last end
    run: np.ndarray
    differences: np.ndarray

    @staticmethod
    def fit(offsets: np.ndarray, first: np.ndarray, error: int = ERROR) -> RankIndex:
        """``first``: the first rank of each run, and the number of ranks; no run is empty. ``offsets`` do not fall within a run."""
        starts, lasts = first[:-1].astype(np.int64), first[1:].astype(np.int64) - 1
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(starts):
            at = np.repeat(starts - np.concatenate(([0], np.cumsum(lasts - starts + 1)[:-1])), lasts - starts + 1) + np.arange((lasts - starts + 1).sum())
            piece = np.repeat(np.arange(len(starts)), lasts - starts + 1)
            miss = np.abs(offsets[at] - _line(at, starts[piece], offsets[starts][piece], (offsets[lasts] - offsets[starts])[piece], (lasts - starts)[piece]))
            bad = np.maximum.reduceat(miss, np.concatenate(([0], np.cumsum(lasts - starts + 1)[:-1]))) > error
            done.append((starts[~bad], lasts[~bad]))
            middle = (starts[bad] + lasts[bad]) // 2
            starts, lasts = np.concatenate((starts[bad], middle + 1)), np.concatenate((middle, lasts[bad]))
        starts, lasts = (np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, np.int64),) * 2
        order = np.argsort(starts)
        starts, lasts = starts[order], lasts[order]
        index = RankIndex(np.concatenate((starts, first[-1:])), offsets[starts], offsets[lasts] - offsets[starts], lasts - starts, np.zeros(0, np.int64))
        index.differences = (offsets - index.predict(np.arange(len(offsets)))).astype(np.int8 if error < 128 else np.int64)
        return index

    def predict(self, rank: np.ndarray) -> np.ndarray:
        piece = np.searchsorted(self.ranks[:-1], rank, side="right") - 1
        return _line(rank, self.ranks[piece], self.offsets[piece], self.rise[piece], self.run[piece])

    def offset(self, rank: np.ndarray) -> np.ndarray:
        """Exact: the prediction and what it misses by."""
        return self.predict(rank) + self.differences[rank]


def _line(rank, start, offset, rise, run):
    return offset + (rank - start) * rise // np.maximum(run, 1)


def line_ends(block: B.Block) -> tuple[np.ndarray, np.ndarray]:
    """Offsets in the block where lines end, each text's own start first, and the rank of each text's start (and the number of ranks)."""
    ends = np.flatnonzero(block.data == 10) + 1
    starts, stops = block.starts[:-1], block.starts[1:]
    # A text that does not end in a line break has a last line without one.
    closed = np.zeros(len(block), bool)
    some = stops > starts
    closed[some] = block.data[stops[some] - 1] == 10
    open_ = np.flatnonzero(some & ~closed)
    text = np.concatenate((np.arange(len(block)), np.searchsorted(starts, ends - 1, side="right") - 1, open_))
    at = np.concatenate((starts, ends, stops[open_]))
    kind = np.concatenate((np.zeros(len(block), int), np.ones(len(ends) + len(open_), int)))
    order = np.lexsort((at, kind, text))
    return at[order].astype(np.int64), np.searchsorted(text[order], np.arange(len(block) + 1))


def hashes(doc_id) -> list[int]:
    """The four numbers a document's id gives; a null id counts as an empty one."""
    digest = hashlib.sha256(b"7:" + (b"" if doc_id is None else str(doc_id).encode())).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def _cut(block: B.Block, ids: list, rate: int, spm: int):
    """For each text of the block: n, form, characters of prefix and middle, output bytes."""
    ends, first = line_ends(block)
    index = RankIndex.fit(ends, first)
    lines = np.diff(first) - 1
    drawn = np.array([hashes(i) for i in ids], np.int64).reshape(-1, 4)
    a, b = drawn[:, 0] % (lines + 1), drawn[:, 1] % (lines + 1)
    one, two = index.offset(first[:-1] + np.minimum(a, b)), index.offset(first[:-1] + np.maximum(a, b))
    letters = np.concatenate(([0], np.cumsum((block.data & 0xC0) != 0x80)))
    texts = [block.text(i) for i in range(len(block))]
    plain = np.array([not t or any(m in t for m in MARKS) for t in texts], bool) | (drawn[:, 2] % 100 >= rate)
    form = np.where(plain, "plain", np.where(drawn[:, 3] % 100 < spm, "spm", "psm")).tolist()
    one_chars, two_chars = letters[one] - letters[block.starts[:-1]], letters[two] - letters[one]
    out = []
    for text, kind, at, i, j in zip(texts, form, block.starts[:-1].tolist(), one.tolist(), two.tolist()):
        prefix, middle, suffix = text[: i - at], text[i - at : j - at], text[j - at :]
        if kind == "plain":
            out.append(text)
        elif kind == "psm":
            out.append(b"<P>" + prefix + b"<S>" + suffix + b"<M>" + middle)
        else:
            out.append(b"<S>" + suffix + b"<P>" + prefix + b"<M>" + middle)
    return lines, form, pa.array(one_chars, mask=plain), pa.array(two_chars, mask=plain), out


def restore(output: bytes, form: str) -> bytes:
    """The text an output was made from: its parts hold no mark, so the first of each mark is the one set."""
    if form == "plain":
        return output
    middle = output.index(b"<M>")
    if form == "psm":
        suffix = output.index(b"<S>")
        return output[3:suffix] + output[middle + 3 :] + output[suffix + 3 : middle]
    prefix = output.index(b"<P>")
    return output[prefix + 3 : middle] + output[middle + 3 :] + output[3:prefix]


def _text(values: list[bytes]) -> pa.Array:
    """Texts of any bytes as Arrow strings, as Spark's own strings may hold bytes that are not valid."""
    made = pa.array(values, pa.binary())
    return pa.Array.from_buffers(pa.string(), len(made), made.buffers(), offset=made.offset)


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = 100, spm: int = 50) -> DataFrame:
    """``<id>, n, form, prefix_chars, middle_chars, output`` for each row: the text with a drawn run of whole lines moved to its end.

    A line ends behind a line break or at the end of the text; ``n`` counts lines. ``rate`` percent of the documents are changed, ``spm``
    percent of these have the suffix first; the id alone decides. Null and empty texts, and texts that hold a mark, stay as they are
    (form ``plain``, counts of characters null; a null text gives an empty output). Null ids count as empty ones,
    repeated rows give equal rows. Other columns are ignored. Lazy; no shuffle.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    names = ["id", *[n for n, _ in SHAPE]]

    def run(batches):
        for batch in batches:
            ids = batch.column("id")
            for block in B.blocks(batch.column("text")):
                own = ids.slice(block.row, len(block))
                n, form, prefix, middle, out = _cut(block, own.to_pylist(), rate, spm)
                yield pa.RecordBatch.from_arrays([own, pa.array(n, pa.int64()), pa.array(form), prefix.cast(pa.int64()), middle.cast(pa.int64()), _text(out)], names)

    shape = T.StructType([T.StructField("id", rows.schema["id"].dataType), *T._parse_datatype_string(", ".join(f"{n} {t}" for n, t in SHAPE)).fields])
    return rows.mapInArrow(run, shape).withColumnRenamed("id", id_col)


def restored(df: DataFrame, name: str = "restored") -> DataFrame:
    """``df`` with a column of the texts that its columns ``output`` and ``form`` were made from. Lazy."""
    at, kind = df.columns.index("output"), df.columns.index("form")

    def run(batches):
        for batch in batches:
            data, starts = B.bounds(batch.column(at))
            forms = batch.column(kind).to_pylist()
            back = [restore(data[starts[i] : starts[i + 1]].tobytes(), f) for i, f in enumerate(forms)]
            yield pa.RecordBatch.from_arrays([*batch.columns, _text(back)], [*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.StringType())]))


def digest(df: DataFrame) -> DataFrame:
    """SHA-256 of the output and of the text rebuilt from it, in place of the texts."""
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    back = restored(df, "_restored")
    return back.withColumns({"output_sha256": sha("output"), "restored_sha256": sha("_restored")}).drop("output", "_restored")
