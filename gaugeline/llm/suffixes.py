"""Repeated passages: every window of ``LENGTH`` bytes that starts in more than one place of the corpus.

The order of all suffixes is needed only through ``LENGTH`` bytes, and only groups of equal windows matter. The radix sort goes
from the most significant digits on and drops every group of one as soon as it is alone.

The first digits are dealt out by Spark. A window's first digit is its *anchor*: of the runs of ``GRAM`` bytes in it the one with
the least hash, leftmost of equals. Equal windows have the same anchor at the same place. All windows of one anchor's
occurrence make one row, about 1.2 rows per 100 bytes of text, with the digest of the bytes they span. An anchor
that occurs once settles its windows as single; spans that occur twice settle theirs as repeated, without any bytes being sent.
Only windows of spans that differ around the same anchor go on: their bytes are sent, dealt out by anchor, and
sorted inside each task by eight bytes at a time through byte ``LENGTH``. Anchors with more than ``HOT`` different spans, which would
make a task large, are dealt out by the digest of each single window instead.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm import bytesops as B
from gaugeline.session import materialize

LENGTH, GRAM, HOT = 200, 40, 5000
_PLACE = 30  # bits for a place within a block


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbouring values, for every start."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, B.U)
    padded[:n] = x
    rows = padded.reshape(-1, width)
    left = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    right = np.minimum.accumulate(rows, axis=1).ravel()
    return np.minimum(left[: n - width + 1], right[width - 1 : n])


def anchors(block: B.Block, length: int = LENGTH, gram: int = GRAM):
    """Of every anchor occurrence: text, first window start (in its text), number of windows, anchor hash, span digest."""
    empty = np.zeros(0, np.int64)
    n = len(block.data)
    if n < length:
        return empty, empty, empty, empty.astype(B.U), empty.astype(B.U)
    p = B.prefix_hash(block.data)
    at = np.arange(n - gram + 1)
    grams = B.span_hash(p, at, at + gram)
    low = _least(((grams >> B.U(_PLACE)) << B.U(_PLACE)) | at.astype(B.U), length - gram + 1)
    place = (low & B.U((1 << _PLACE) - 1)).astype(np.int64)  # the anchor of the window that starts at each byte
    text = np.repeat(np.arange(len(block)), np.diff(block.starts))[: len(place)]
    good = np.arange(len(place)) + length <= block.starts[1:][text]  # the window ends within its text
    start = np.flatnonzero(good)
    if not len(start):
        return empty, empty, empty, empty.astype(B.U), empty.astype(B.U)
    fresh = np.concatenate(([True], (place[start][1:] != place[start][:-1]) | (text[start][1:] != text[start][:-1])))
    head = np.flatnonzero(fresh)
    count = np.diff(np.append(head, len(start)))
    first = start[head]
    span = B.span_hash(p, first, first + count - 1 + length)
    return text[first], first - block.starts[text[first]], count, grams[place[first]], B.mix(span + count.astype(B.U))


def _anchored(length: int, gram: int):
    def run(batches):
        for batch in batches:
            row = batch.column("row").to_numpy()
            for block in B.blocks(batch.column("text")):
                text, first, count, anchor, span = anchors(block, length, gram)
                yield pa.RecordBatch.from_arrays([pa.array(row[block.row + text]), pa.array(first, pa.int32()), pa.array(count, pa.int32()), B.as_long(anchor), B.as_long(span)], ["row", "first", "count", "anchor", "span"])

    return run


def _cut(length: int):
    """The bytes of the spans listed for each text."""

    def run(batches):
        for batch in batches:
            texts, lists = batch.column("text").to_pylist(), batch.column("spans").to_pylist()
            out = [(r, s["first"], s["count"], s["anchor"], s["hot"], (t or "").encode()[s["first"] : s["first"] + s["count"] - 1 + length]) for r, t, spans in zip(batch.column("row").to_pylist(), texts, lists) for s in spans]
            cols = list(zip(*out)) or [[]] * 6
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["row", "first", "count", "anchor", "hot", "bytes"])

    return run


def repeated(group: np.ndarray, data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which windows equal another one of their group: a radix sort from the first byte on, eight bytes a pass.

    Groups of one are dropped after every pass; what is left behind the last pass are the groups of equal windows.
    """
    out = np.zeros(len(starts), bool)
    order = np.argsort(group, kind="stable")
    label = group[order]
    for byte in range(0, length, 8):
        label = np.cumsum(np.concatenate(([0], label[1:] != label[:-1]))) if len(label) else label
        many = np.bincount(label)[label] > 1 if len(label) else np.zeros(0, bool)
        order, label = order[many], label[many]
        if not len(order):
            return out
        wide = min(8, length - byte)
        digit = np.zeros((len(order), 8), np.uint8)
        digit[:, :wide] = data[starts[order][:, None] + np.arange(byte, byte + wide)]
        digit = digit.view(">u8").ravel()
        differs = (digit[1:] != digit[:-1]) & (label[1:] == label[:-1])
        if differs.any():
            # Only groups whose digits differ are put in order anew.
            mixed = np.zeros(int(label[-1]) + 1, bool)
            mixed[label[1:][differs]] = True
            some = np.flatnonzero(mixed[label])
            again = some[np.lexsort((digit[some], label[some]))]
            order[some], digit[some] = order[again], digit[again]
            label = np.cumsum(np.concatenate(([0], (digit[1:] != digit[:-1]) | (label[1:] != label[:-1]))))
    many = np.bincount(label)[label] > 1 if len(label) else np.zeros(0, bool)
    out[order[many]] = True
    return out


def _sorted(length: int, most: int = 1 << 21):
    """Rows come with equal anchors next to each other; windows of whole anchors are sorted together."""

    def settle(rows):
        size = np.array([len(r[4]) for r in rows])
        data = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
        offset = np.concatenate(([0], np.cumsum(size)[:-1]))
        count = np.array([r[2] for r in rows])
        of = np.repeat(np.arange(len(rows)), count)
        inner = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        _, group = np.unique(np.array([r[3] for r in rows]), return_inverse=True)
        hit = np.flatnonzero(repeated(group[of], data, offset[of] + inner, length))
        if not len(hit):
            return None
        head = np.flatnonzero(np.concatenate(([True], (hit[1:] != hit[:-1] + 1) | (of[hit][1:] != of[hit][:-1]))))
        run = np.diff(np.append(head, len(hit)))
        row, first = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        at = hit[head]
        return pa.RecordBatch.from_arrays([pa.array(row[of[at]], pa.int64()), pa.array(first[of[at]] + inner[at], pa.int32()), pa.array(run, pa.int32())], ["row", "first", "count"])

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("row", "first", "count", "anchor", "bytes"))):
                if r[3] != last and size > most:
                    if (done := settle(held)) is not None:
                        yield done
                    held, size = [], 0
                held.append(r)
                size, last = size + len(r[4]), r[3]
        if held and (done := settle(held)) is not None:
            yield done

    return run


def _windows(length: int):
    """One row per window, with a 128-bit digest."""

    def run(batches):
        for batch in batches:
            for row, first, count, span in zip(*(batch.column(c).to_pylist() for c in ("row", "first", "count", "bytes"))):
                digests = [hashlib.blake2b(span[i : i + length], digest_size=16).digest() for i in range(count)]
                yield pa.RecordBatch.from_arrays([pa.array([row] * count, pa.int64()), pa.array(range(first, first + count), pa.int32()), pa.array(digests, pa.binary())], ["row", "first", "digest"])

    return run


def repeats(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``(row, first, count)``: in the text of ``row``, the windows at ``first`` and the ``count - 1`` bytes behind start elsewhere too.

    ``texts(row long, text)`` may hold equal texts under one ``row``. Runs jobs.
    """
    found = texts.where(f"octet_length(text) >= {length}").mapInArrow(_anchored(length, gram), "row long, first int, count int, anchor long, span long")
    # Written first, so that the join below is between plain shuffles, which adaptive execution splits for a hot anchor.
    twice = materialize(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    found = materialize(found.join(twice, "anchor"), "occurrences")
    one = F.min(F.struct("row", "first", "count"))
    spans = materialize(found.groupBy("anchor", "span").agg(F.count("*").alias("n"), one.alias("at")), "spans")
    sure = found.join(spans.where("n > 1").select("anchor", "span"), ["anchor", "span"], "left_semi").select("row", "first", "count")
    # One occurrence of each span of the anchors that have a span which occurs once, and another one.
    open_ = spans.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("anchor", (F.col("kinds") > hot).alias("hot"))
    open_ = materialize(spans.join(open_, "anchor").select("at.row", "at.first", "at.count", "anchor", "hot"), "open")
    listed = open_.groupBy("row").agg(F.collect_list(F.struct("first", "count", "anchor", "hot")).alias("spans"))  # at most as long as the text
    cut = texts.join(listed, "row")
    cut = materialize(cut.mapInArrow(_cut(length), "row long, first int, count int, anchor long, hot boolean, bytes binary"), "bytes")
    calm = cut.where("not hot").select("row", "first", "count", "anchor", "bytes")
    calm = calm.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sorted(length), "row long, first int, count int")
    wild = cut.where("hot").mapInArrow(_windows(length), "row long, first int, digest binary")
    more = materialize(wild.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "digests")
    wild = wild.join(more, "digest", "left_semi").select("row", "first", F.lit(1).alias("count"))
    return sure.union(calm).union(wild)


def _covered(first, count, size: int, length: int) -> np.ndarray:
    """Starts and ends of the maximal covered runs, as two rows."""
    first, count = np.array(first, np.int64), np.array(count, np.int64)
    order = np.argsort(first, kind="stable")
    start, end = first[order], np.maximum.accumulate((first + count - 1 + length)[order])
    fresh = np.concatenate(([True], start[1:] > end[:-1]))
    at = np.flatnonzero(fresh)
    return np.stack((start[at], np.minimum(end[np.append(at[1:] - 1, len(end) - 1)], size)))


def _whole_letters(piece: bytes, after_cut: bool, before_cut: bool) -> bytes:
    """A stretch of UTF-8 without the rest of a letter that a cut before it, and the beginning of one that a cut behind it, has halved."""
    a, b = 0, len(piece)
    while after_cut and a < b and piece[a] & 0xC0 == 0x80:
        a += 1
    if before_cut:
        lead = b - 1
        while lead >= a and piece[lead] & 0xC0 == 0x80:
            lead -= 1
        if lead >= a and piece[lead] >= 0xC0 and lead + (2 if piece[lead] < 0xE0 else 3 if piece[lead] < 0xF0 else 4) > b:
            b = lead
    return piece[a:b]


def _removed(length: int, letters: bool = False):
    def run(batches):
        for batch in batches:
            out = []
            for doc, text, lists in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "spans"))):
                raw = (text or "").encode()
                if not lists:
                    out.append((doc, len(raw), [], [], raw))
                    continue
                starts, ends = _covered([x["first"] for x in lists], [x["count"] for x in lists], len(raw), length)
                pieces = zip([0, *ends.tolist()], [*starts.tolist(), len(raw)])
                kept = b"".join(_whole_letters(raw[a:b], a > 0, b < len(raw)) if letters else raw[a:b] for a, b in pieces)
                out.append((doc, len(raw), starts.tolist(), ends.tolist(), kept))
            cols = list(zip(*out)) or [[]] * 5
            types = [batch.schema.field("doc").type, pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc", "n_bytes", "starts", "ends", "kept"])

    return run


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, whole_letters: bool = False
) -> DataFrame:
    """``<id_col>, n_bytes, starts, ends, kept``: the removed runs of each whole text's UTF-8 bytes, and the bytes that stay.

    A byte goes if a window of ``length`` bytes covers it that also starts anywhere else in the table, the same text included;
    windows never cross texts and are judged on the input. Null and empty texts and those shorter than ``length`` stay whole.
    With ``whole_letters``, what a cut leaves of a letter goes from ``kept`` too; everything else stays, byte by byte.
    Null and repeated ids are fine, each row is a text of its own; rows alike in id and text are copies of each other. Other
    columns are ignored. Runs jobs.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text")).withColumn("row", F.xxhash64("doc", "text"))
    ranges = repeats(rows.select("row", "text"), length, gram)
    lists = ranges.groupBy("row").agg(F.collect_set(F.struct("first", "count")).alias("spans"))  # at most as long as the text
    kind = rows.schema["doc"].dataType.simpleString()
    shape = f"doc {kind}, n_bytes long, starts array<long>, ends array<long>, kept binary"
    return rows.join(lists, "row", "left").mapInArrow(_removed(length, whole_letters), shape).withColumnRenamed("doc", id_col)


def digest(removed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``<id_col>, n_bytes, n_removed, n_spans, kept_sha256``."""
    gone = F.col("n_bytes") - F.octet_length("kept")
    return removed.select(F.col(id_col), "n_bytes", gone.cast("long").alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
