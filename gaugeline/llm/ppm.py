"""Language-model scores by prediction by partial matching (PPM) over bytes, with a word-frequency base score beside it.

The model reads a text as its lower-cased words with one blank between them and an end sign, byte by byte. For every byte it
looks at the longest known context of up to ``ORDER`` bytes. A context that occurred ``c`` times, and after which ``d`` different bytes
are known, gives byte ``x`` the chance ``c(x) / (c + d)`` and escapes with the chance ``d / (c + d)`` to the context one byte shorter,
where all bytes that the longer one knows are excluded from ``c`` and ``d``. Behind the empty context all other bytes are equally
likely. The chances of the bytes after a context thus add up to one.

Counts are over all learning texts. Texts are read in chunks of about ``CHUNK`` bytes. A chunk names each of its different runs of
``ORDER + 1`` bytes once, with its count in learning texts, and deals them out to groups by the ``NEAR`` last bytes of their contexts. A group
adds up the counts of all chunks, which gives all learned runs whose contexts end alike, shorter runs being sums over longer ones, and answers
every chunk with the chances of its runs. Only the counts of runs of up to ``NEAR`` bytes, at most 256 ** ``NEAR``, are
sent to all groups. No run is dropped, and the same steps are taken at every size. Words that make up at least one part in ``PARTS`` of all are
sent along, the others are counted and joined in Spark.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm import bytesops as B
from gaugeline.llm.sampling import remainder
from gaugeline.session import materialize, scratch_dir

ORDER = 5
PARTS = 1 << 20
CHUNK = 1 << 24  # bytes of text that name their runs and are scored together
NEAR = 3  # runs whose contexts end in the same so many bytes lie in one group
GROUP = 1 << 22  # bytes of text per group of runs
END = 10  # a byte that no word holds and the blank is not


def canonical(block: B.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts as lower-cased words, one blank between words, ``END`` behind each text; starts; word hashes; first word per text."""
    data = B.lower(block.data)
    begins, ends, first = B.word_spans(data, block.starts)
    hashes = B.span_hash(B.prefix_hash(data), begins, ends)
    # Every word takes its bytes and one sign behind: a blank, or END behind a text's last word. Texts without words are END only.
    size = ends - begins + 1
    count = np.diff(first)
    bare = (count == 0).astype(np.int64)
    before = np.concatenate(([0], np.cumsum(size)))
    starts = before[first] + np.concatenate(([0], np.cumsum(bare)))
    out = np.full(int(starts[-1]), 32, np.uint8)
    if len(begins):
        shift = np.repeat(np.cumsum(bare) - bare, count)  # ends of texts without words that lie before
        at = before[:-1] + shift
        step = np.ones(int(before[-1]) - len(begins), np.int64)  # source places of all word bytes, as running sums
        length = size - 1
        head = np.concatenate(([0], np.cumsum(length)[:-1]))
        src = np.repeat(begins - head, length) + np.arange(len(step))
        dst = np.repeat(at - head, length) + np.arange(len(step))
        out[dst] = data[src]
    out[starts[1:] - 1] = END
    return out, starts, hashes, first


def runs(data: np.ndarray, starts: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For every byte, the run of ``order`` bytes before it and itself as one number, the byte itself in the lowest place.

    Before a text's first byte stand END signs.
    """
    key = np.zeros(len(data), B.U)
    place = np.arange(len(data)) - np.repeat(starts[:-1], np.diff(starts))
    for back in range(order, -1, -1):
        key <<= B.U(8)
        if back == 0:
            key |= data.astype(B.U)
        else:
            shifted = np.full(len(data), END, np.uint8)
            shifted[back:] = data[:-back]
            key |= np.where(place >= back, shifted, np.uint8(END)).astype(B.U)
    return key


@dataclass
class Trie:
    """Runs by order, sorted, and the logarithms that scoring needs.

    Of order k: ``keys[k]`` (context and byte) with the log10 count; ``nodes[k]`` (context) with log10 of ``c + d``, of ``d``, and of the
    same two numbers of the context one byte shorter without the bytes that this one knows.
    """

    order: int
    keys: list[np.ndarray]
    count: list[np.ndarray]
    nodes: list[np.ndarray]
    total: list[np.ndarray]
    kinds: list[np.ndarray]
    total_below: list[np.ndarray]
    kinds_below: list[np.ndarray]

    def log10(self, key: np.ndarray) -> np.ndarray:
        """log10 of the chance of each run's last byte after its other bytes."""
        some, back = np.unique(key, return_inverse=True)
        out, open_ = np.zeros(len(some)), np.arange(len(some))
        above = np.full(len(some), -1, np.int64)  # the node one order up that was known and escaped from
        for k in range(self.order, -1, -1):
            if not len(open_):
                break
            run = some[open_] & B.U((1 << 8 * (k + 1)) - 1)
            node = _find(self.nodes[k], run >> B.U(8))
            at = _find(self.keys[k], run)
            up = above[open_]
            fresh, known = up < 0, node >= 0
            # Totals here: plain if this is the first known context, else without what the longer context knows.
            if k < self.order and len(self.nodes[k + 1]):
                j = np.maximum(up, 0)
                total = np.where(fresh, self.total[k][node] if len(self.nodes[k]) else 0.0, self.total_below[k + 1][j])
                kinds = np.where(fresh, self.kinds[k][node] if len(self.nodes[k]) else 0.0, self.kinds_below[k + 1][j])
            else:
                total, kinds = (self.total[k][node], self.kinds[k][node]) if len(self.nodes[k]) else (np.zeros(len(run)), np.zeros(len(run)))
            hit = known & (at >= 0)
            out[open_[hit]] += self.count[k][at[hit]] - total[hit]
            miss = known & ~hit
            # A context that knows no byte beyond those of the longer one is passed for certain.
            passed = miss & (kinds > -1)
            out[open_[passed]] += kinds[passed] - total[passed]
            above[open_[known]] = node[known]
            open_ = open_[~hit]
        if len(open_):  # bytes that no context knows
            seen = len(self.keys[0])
            out[open_] -= np.log10(256 - seen) if seen < 256 else 0.0
        return out[back]


def _find(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.full(len(x), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return np.where(sorted_[at] == x, at, -1)


def _log(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, np.log10(np.maximum(x, 1e-300)), -2.0)  # -2: none


def build(levels: list[tuple[np.ndarray, np.ndarray]]) -> Trie:
    """A trie from the runs of every order with their counts. Of each context all runs must be there, as must all their shorter forms."""
    order = len(levels) - 1
    trie = Trie(order, [], [], [], [], [], [], [])
    counts, sums, kinds = [], [], []
    for k, (key, n) in enumerate(levels):
        at = np.argsort(key)
        key, n = key[at].astype(B.U), n[at].astype(np.float64)
        node, start = np.unique(key >> B.U(8), return_index=True)
        trie.keys.append(key)
        counts.append(n)
        sums.append(np.add.reduceat(n, start) if len(n) else np.zeros(0))
        kinds.append(np.diff(np.append(start, len(n))).astype(np.float64))
        trie.count.append(_log(n))
        trie.nodes.append(node)
        trie.total.append(_log(sums[k] + kinds[k]))
        trie.kinds.append(_log(kinds[k]))
        if k == 0:
            trie.total_below.append(np.zeros(len(node)))
            trie.kinds_below.append(np.zeros(len(node)))
            continue
        # Every byte known here is known one order below: a shorter run is at least as frequent.
        low = _find(trie.keys[k - 1], key & B.U((1 << 8 * k) - 1))
        shared = np.add.reduceat(counts[k - 1][low], start) if len(n) else np.zeros(0)
        below = _find(trie.nodes[k - 1], node & B.U((1 << 8 * (k - 1)) - 1))
        left, more = sums[k - 1][below] - shared, kinds[k - 1][below] - kinds[k]
        trie.total_below.append(_log(left + more))
        trie.kinds_below.append(_log(more))
    return trie


def _counted(batches):
    """Per batch: word counts (kind 0; the end of texts is word 0) and counts of runs of ``NEAR`` bytes (kind 1)."""
    for batch in batches:
        words, keys = [], []
        texts = batch.num_rows
        for block in B.blocks(batch.column("text")):
            data, starts, hashes, _ = canonical(block)
            words.append(np.unique(hashes, return_counts=True))
            n = np.bincount(runs(data, starts, NEAR - 1).astype(np.int64), minlength=1 << 8 * NEAR)
            some = np.flatnonzero(n)
            keys.append((some.astype(B.U), n[some]))
        for kind, parts, more in ((0, words, [(np.zeros(1, B.U), np.array([texts]))] if texts else []), (1, keys, [])):
            parts = parts + more
            if parts:
                key, n = _added(parts)
                for cut in range(0, len(key), 1 << 16):
                    some = slice(cut, cut + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key[some]), kind, np.int32)), B.as_long(key[some]), pa.array(n[some], pa.int64())], ["kind", "key", "n"])


def _added(parts):
    key, n = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(key)
    key, n = key[order], n[order]
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[start], np.add.reduceat(n, start)


@dataclass
class Model:
    low: list[tuple[np.ndarray, np.ndarray]]  # all runs of up to ``NEAR`` bytes with their counts, by order
    words: np.ndarray  # hashes of the frequent words, sorted
    count: np.ndarray
    tokens: int  # N
    distinct: int  # V
    texts: int  # learning texts, the count of the end


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = 5, held: int = 1) -> tuple[Model, DataFrame]:
    """What is known of all texts whose crc32(id) mod ``divisor`` is not ``held`` but for the long runs, and the table of all word counts
    ``(word, c)``. Runs jobs."""
    rows = docs.where(F.coalesce(remainder(id_col, divisor), F.lit(-1)) != held).select(F.col(f"`{text_col}`").alias("text"))
    sums = rows.mapInArrow(_counted, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    sums = materialize(sums, "counts")
    tokens, distinct, texts = sums.where("kind = 0").agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("key") == 0, F.col("n")))).first()
    tokens, distinct, texts = tokens or 0, distinct or 0, texts or 0
    near = sums.where("kind = 1").select("key", "n").toArrow()  # at most 256 ** NEAR rows
    key, n = near["key"].to_numpy().astype(B.U), near["n"].to_numpy()
    low = [_added([(key & B.U((1 << 8 * (k + 1)) - 1), n)]) if len(key) else (key, n) for k in range(NEAR)]
    counts = sums.where("kind = 0 and key != 0").select(F.col("key").alias("word"), F.col("n").alias("c"))
    often = counts.where(F.col("c") >= max(1, -(-tokens // PARTS))).toArrow()  # at most PARTS rows
    words = often["word"].to_numpy().view(B.U) if len(often) else np.zeros(0, B.U)
    at = np.argsort(words)
    return Model(low, words[at], often["c"].to_numpy()[at] if len(often) else np.zeros(0, np.int64), int(tokens), int(distinct), int(texts)), counts


def _rows(own: Model, table, chance):
    """Scores of a table or batch ``doc, row, text``; ``chance`` gives the log10 of the chance of each run."""
    norm = np.log10(own.tokens + 0.5 * (own.distinct + 1))
    for block in B.blocks(table.column("text")):
        data, starts, hashes, first = canonical(block)
        score = np.add.reduceat(chance(runs(data, starts)), starts[:-1])
        text, n = np.repeat(np.arange(len(block)), np.diff(first)), np.diff(first)
        at = _find(own.words, hashes)
        known = at >= 0
        base = np.bincount(text[known], np.log10(own.count[at[known]] + 0.5), len(block)) if known.any() else np.zeros(len(block))
        base = base + np.log10(own.texts + 0.5) - (n + 1) * norm
        found = np.bincount(text[known], minlength=len(block)) + (own.texts > 0)
        # The other words of a text, each once with its number.
        order = np.lexsort((hashes[~known], text[~known]))
        w, t = hashes[~known][order], text[~known][order]
        start = np.flatnonzero(np.concatenate(([True], (w[1:] != w[:-1]) | (t[1:] != t[:-1])))) if len(w) else np.zeros(0, np.int64)
        times = np.diff(np.append(start, len(w)))
        cut = np.searchsorted(t[start], np.arange(len(block) + 1))
        lists = lambda x: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x, pa.int64()))
        yield pa.Table.from_arrays(
            [table.column("doc").slice(block.row, len(block)), table.column("row").slice(block.row, len(block)), pa.array(n + 1, pa.int64()), pa.array(found, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), lists(w[start].view(np.int64)), lists(times)],
            ["doc", "row", "n_tokens", "n_known", "base", "score", "words", "times"],
        )


def _chunked(batches):
    """Numbers the chunks of a task's texts."""
    chunk, size = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        _, at = B.bounds(batch.column("text"))
        before = size + at[:-1] - at[0]
        size += int(at[-1] - at[0])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chunk + before // CHUNK, pa.int64())], [*batch.schema.names, "chunk"])


def _dealt(key: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts sorted runs into groups, and the group of each run in it."""
    group = B.mix((key >> B.U(8)) & B.U((1 << 8 * NEAR) - 1)) % B.U(groups)
    order = np.argsort(group, kind="stable")
    return order, group[order].astype(np.int64)


def _bytes(key: np.ndarray) -> bytes:
    """Runs as their first bytes, then their second ones and so on: sorted runs share the first, which packs well."""
    return np.ascontiguousarray(key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : ORDER + 1].T[::-1]).tobytes()


def _keys(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // (ORDER + 1), 8), np.uint8)
    wide[:, : ORDER + 1] = np.frombuffer(raw, np.uint8).reshape(ORDER + 1, -1)[::-1].T
    return wide.view("<u8").ravel().astype(B.U)


def _named(groups: int):
    """For each chunk and group: the chunk's different runs in order, and how often each occurs in the chunk's learning texts."""

    def out(chunk: int, parts):
        key, n = _added(parts)
        order, group = _dealt(key, groups)
        key, n = key[order], n[order]
        edges = np.flatnonzero(np.diff(group, prepend=-1, append=groups))
        for first in range(0, len(edges) - 1, 1024):
            cuts = edges[first : first + 1025]
            own = list(zip(cuts, cuts[1:]))
            counts = [n[a:b].astype("u1" if n[a:b].max() < 256 else "<u8").tobytes() for a, b in own]
            yield pa.RecordBatch.from_arrays(
                [pa.array(group[cuts[:-1]]), pa.array(np.full(len(own), chunk, np.int64)), pa.array([_bytes(key[a:b]) for a, b in own], pa.binary()), pa.array(counts, pa.binary())],
                ["group", "chunk", "keys", "counts"],
            )

    def run(batches):
        held, chunk = [], None
        for batch in batches:
            every, learns = batch.column("chunk").to_numpy(), batch.column("learns").to_numpy(zero_copy_only=False).astype(bool)
            starts = np.flatnonzero(np.diff(every, prepend=-1)) if len(every) else []
            for a, b in zip(starts, [*starts[1:], len(every)]):
                if chunk != every[a]:
                    if held:
                        yield from out(chunk, held)
                    held, chunk = [], int(every[a])
                for block in B.blocks(batch.column("text").slice(a, b - a)):
                    data, at, _, _ = canonical(block)
                    key = runs(data, at)
                    learned = np.repeat(learns[a + block.row : a + block.row + len(block)], np.diff(at))
                    held.append(np.unique(key[learned], return_counts=True))
                    rest = np.unique(key[~learned])
                    held.append((rest, np.zeros(len(rest), np.int64)))
                if len(held) > 16:
                    held = [_added(held)]
        if held:
            yield from out(chunk, held)

    return run


def _answered(model):
    """The chances of every chunk's runs of one group."""

    def run(table: pa.Table) -> pa.Table:
        raw, sizes = table["keys"].to_pylist(), table["counts"].to_pylist()
        asked = [_keys(k) for k in raw]
        n = [np.frombuffer(c, "u1" if len(c) == len(k) else "<u8").astype(np.int64) for c, k in zip(sizes, asked)]
        key, count = _added(list(zip(asked, n)))
        learned = count > 0
        known = (key[learned], count[learned])
        longer = [_added([(known[0] & B.U((1 << 8 * (k + 1)) - 1), known[1])]) if learned.any() else known for k in range(NEAR, ORDER + 1)]
        chance = build([*model.value.low, *longer]).log10(key)
        answers = [chance[np.searchsorted(key, k)].tobytes() for k in asked]
        return pa.table({"chunk": table["chunk"], "keys": table["keys"], "chances": pa.array(answers, pa.binary())})

    return run


def _chunk_scored(model):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        # A chunk that was read in two parts names some runs twice, with the same chance.
        key = np.concatenate([_keys(k) for k in answers["keys"].to_pylist()])
        chance = np.frombuffer(b"".join(answers["chances"].to_pylist()), "<f8")
        order = np.argsort(key)
        key, chance = key[order], chance[order]
        return pa.concat_tables(list(_rows(model.value, texts, lambda run: chance[np.searchsorted(key, run)])))

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = 5, held: int = 1) -> DataFrame:
    """``<id_col>, held_out, n_tokens, n_known, train_tokens, base_score, score``, one row per row of ``docs``.

    Learns from the texts that are not held out and scores all. Null and empty texts and texts of separators are one end sign. A
    null id is not held out. Without learning texts every token is unknown and all bytes are equally likely. Rows that repeat
    an id are texts of their own. Further columns are ignored. Runs jobs.
    """
    spark = docs.sparkSession
    model, counts = train(docs, id_col, text_col, divisor, held)
    shared = spark.sparkContext.broadcast(model)
    learns = F.coalesce(remainder(id_col, divisor), F.lit(-1)) != held
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"), F.monotonically_increasing_id().alias("row"), learns.alias("learns"))
    kind = rows.schema["doc"].dataType.simpleString()
    # Written once, so that row numbers and chunks stay.
    path = scratch_dir(spark, "chunks")
    rows.mapInArrow(_chunked, f"doc {kind}, text string, row long, learns boolean, chunk long").write.option("compression", "zstd").parquet(path)
    texts = spark.read.parquet(path)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-size // GROUP))
    named = texts.select("text", "learns", "chunk").mapInArrow(_named(groups), "group long, chunk long, keys binary, counts binary")
    answers = named.groupBy("group").applyInArrow(_answered(shared), "chunk long, keys binary, chances binary")
    shape = f"doc {kind}, row long, n_tokens long, n_known long, base double, score double, words array<long>, times array<long>"
    out = texts.select("doc", "text", "row", "chunk").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_chunk_scored(shared), shape)
    out = materialize(out, "scores")
    # Words below the share: at most c of them each, so no word gathers many rows. Their counts come from the table of all.
    rare = out.select("row", F.explode(F.arrays_zip("words", "times")).alias("w"))
    rare = rare.select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times")).join(counts, "word", "left")
    sums = rare.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rest"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more")
    )
    held_out = F.coalesce(remainder("doc", divisor) == held, F.lit(False))
    return out.drop("words", "times").join(sums, "row", "left").select(
        F.col("doc").alias(id_col), held_out.alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score",
    )
