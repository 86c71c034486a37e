"""Packing of documents into sequences by lexical retrieval.

Full windows of a long document are sequences of their own. The rest of every document goes to a shard of about ``SHARD`` tokens by its
rarest term that another document has too, so that documents on one matter meet: a frequent such term has shards of its own, rarer ones share
one. A shard has an inverted index whose BM25 weights use document frequencies of the whole table. The longest
unused piece is the seed of a window; the postings of all its different terms score the unused pieces, which fill the window
greedily in the order of their scores, down to the last with a positive score. The best one that does not fit is cut to fill the
window exactly, and its rest goes back as unused. Only then do pieces without a common term follow, longest first. What is left at
the end of a shard becomes sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm import bytesops as B
from gaugeline.llm.bpe import is_latin
from gaugeline.session import materialize

WINDOW, SHARD = 4096, 1 << 20
K1, SLOPE = 1.2, 0.75
END_OF_DOCUMENT = 2
KEEP, TOGETHER = 700_000, 100
# Fixed value: the splitting pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


# By Latin-1 sign: the small letter, and the kind of it: 0 space, 1 letter, 2 number, 3 other; a piece is a run of letters or of others, or one number.
_SMALL = bytes(range(256)).decode("latin-1").lower().encode("latin-1")
_KIND = bytes(0 if c in "\t\n\x0b\x0c\r \x85\xa0" else 1 if re.match("[A-Za-zªµºÀ-ÖØ-öø-ÿ]", c) else 2 if re.match("[0-9²³¹¼-¾]", c) else 3 for c in map(chr, range(256)))


def split_latin(signs: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every piece of small Latin-1 signs that end in a space; what ``PATTERN`` finds in them."""
    data, kind = np.frombuffer(signs, np.uint8), np.frombuffer(signs.translate(_KIND), np.uint8)
    space = kind == 0
    start = ~space
    start[1:] &= (kind[1:] == 2) | (kind[1:] != kind[:-1])
    # An apostrophe alone between a sign of another kind and one of these endings takes the ending along.
    tick = np.flatnonzero(start & (data == 39))
    ahead = np.concatenate((data, np.zeros(3, np.uint8)))
    one, two = ahead[tick + 1], ahead[tick + 2]
    single = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    double = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
    for some, more in ((tick[single], 1), (tick[double], 2)):
        start[some + 1] = False
        behind = some + 1 + more
        start[behind] = ~space[behind]  # letters behind the ending are a piece of their own, other signs are anyway
    edge = np.flatnonzero(start | space)
    first = start[edge]
    return edge[first], edge[1:][first[:-1]]


_SHORT, _LONG = 7, 64
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], B.U)
_ODD = B.U(0x9E3779B97F4A7C15)


def piece_hash(signs: bytes, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hash of pieces of more than ``_SHORT`` signs."""
    eight = np.ndarray(len(signs) + 1, "<u8", signs + bytes(8), strides=(1,))  # the eight signs from each place on
    out = (eight[starts] ^ length.astype(B.U)) * _ODD
    for done in range(8, _LONG, 8):
        more = np.flatnonzero(length > done)
        if not len(more):
            break
        x = out[more]
        out[more] = (x ^ (x >> B.U(29)) ^ (eight[starts[more] + done] & _MASK[np.minimum(length[more] - done, 8)])) * _ODD
    far = np.flatnonzero(length > _LONG)
    out[far] = [hash(signs[a:b]) & 0xFFFFFFFFFFFFFFFF for a, b in zip(starts[far].tolist(), (starts[far] + length[far]).tolist())]
    return out ^ (out >> B.U(32))


def piece_keys(signs: bytes, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A number above 0 for each piece: its length and signs up to ``_SHORT`` signs, so only those of longer pieces can be alike for different ones."""
    eight = np.ndarray(len(signs) + 1, "<u8", signs + bytes(8), strides=(1,))
    keys = (eight[starts] & _MASK[np.minimum(length, _SHORT)]) | (length.astype(B.U) << B.U(56))
    more = np.flatnonzero(length > _SHORT)
    keys[more] = piece_hash(signs, starts[more], length[more]) | B.U(1 << 63)
    return keys


class Places:
    """Numbers above 0 by key, for many keys at once: a table of slots, of which at most half are taken."""

    def __init__(self):
        self.keys, self.numbers, self.taken = np.zeros(1 << 12, B.U), np.zeros(1 << 12, np.int32), 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        x = keys ^ (keys >> B.U(31))
        return ((x * _ODD) >> B.U(65 - len(self.keys).bit_length())).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, 0 if it has none."""
        slots = self._slots(keys)
        there = self.keys[slots]
        out = np.where(there == keys, self.numbers[slots], 0)
        open_ = np.flatnonzero((there != keys) & (there != 0))
        slots = slots[open_]
        while len(open_):
            slots = (slots + 1) & (len(self.keys) - 1)
            there = self.keys[slots]
            hit = there == keys[open_]
            out[open_[hit]] = self.numbers[slots[hit]]
            go = ~hit & (there != 0)
            open_, slots = open_[go], slots[go]
        return out

    def put(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """Different keys that are not here yet."""
        self.taken += len(keys)
        if 2 * self.taken > len(self.keys):
            old = self.numbers != 0
            keys, numbers = np.concatenate((self.keys[old], keys)), np.concatenate((self.numbers[old], numbers))
            size = 1 << (2 * self.taken).bit_length()
            self.keys, self.numbers = np.zeros(size, B.U), np.zeros(size, np.int32)
        slots = self._slots(keys)
        while len(keys):
            free = self.numbers[slots] == 0
            self.numbers[slots[free]] = numbers[free]
            won = self.numbers[slots] == numbers  # one of those that want the same slot
            self.keys[slots[won]] = keys[won]
            keys, numbers, slots = keys[~won], numbers[~won], (slots[~won] + 1) & (len(self.keys) - 1)


class Row:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.all, self.n = np.zeros(1 << 12, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.all):
            wider = np.zeros(1 << (self.n + len(values)).bit_length(), self.all.dtype)
            wider[: self.n] = self.all[: self.n]
            self.all = wider
        self.all[self.n : self.n + len(values)] = values
        self.n += len(values)


class Words:
    """Token ids of whole texts through the library, which sees each distinct piece of a worker once (up to ``KEEP`` kept)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.path, self.loaded = path, None
        # The merges alone, for pieces that are in normal form, small letters and split already.
        self.merges = Tokenizer.from_file(path)
        self.merges.no_truncation()
        self.merges.no_padding()
        self.special = [t.content for t in self.merges.get_added_tokens_decoder().values()]
        self.merges.normalizer = normalizers.Sequence([])
        # Pieces come many to a text, a line's end between them. A piece's last token alone has the suffix, if the vocabulary has one.
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit("\n"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix, self.last = self.merges.model.end_of_word_suffix, np.zeros(1 << 16, bool)
        self.last[[i for t, i in self.merges.get_vocab(with_added_tokens=False).items() if suffix and t.endswith(suffix)]] = True
        self.splitter = regex.compile(PATTERN)
        self.known: dict[str, bytes] = {}
        self._forget()

    @property
    def library(self):
        """The whole tokenizer, which only few texts need."""
        if self.loaded is None:
            from tokenizers import Tokenizer

            self.loaded = Tokenizer.from_file(self.path)
            self.loaded.no_truncation()
            self.loaded.no_padding()
        return self.loaded

    def _forget(self):
        """No Latin-1 piece is known. Known are, by number: the signs and the ids, one piece behind the other; number 0 is none."""
        self.places, self.pieces = Places(), 0
        self.sign_first, self.length, self.signs = Row(np.int64), Row(np.int64), Row(np.uint8)
        self.first, self.size, self.ids = Row(np.int64), Row(np.int64), Row("<u2")
        for row in (self.sign_first, self.length, self.first, self.size):
            row.add(np.zeros(1, np.int64))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 16-bit numbers (the vocabulary has fewer than 65,536 entries)."""
        out: list[bytes | None] = [None] * len(texts)
        latin, other = [], []
        for i, text in enumerate(texts):
            # Special tokens stand in their own right, and signs above 16 bits may be classed by a newer Unicode here.
            if any(s in text for s in self.special):
                out[i] = self._whole(text)
            elif text.isascii() or is_latin(text):  # always in normal form
                latin.append(i)
            elif max(text) > "\uffff":
                out[i] = self._whole(text)
            else:
                other.append(i)
        for rows, ids in ((latin, self._latin([texts[i].encode("latin-1") for i in latin])), (other, self._other([texts[i] for i in other]))):
            for i, x in zip(rows, ids):
                out[i] = x
        return out

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _latin(self, texts: list[bytes]) -> list[bytes]:
        if not texts:
            return []
        signs = (b"\n".join(texts) + b"\n").translate(_SMALL)
        starts, ends = split_latin(signs)
        begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        if not len(starts):
            return [b""] * len(texts)
        length = ends - starts
        number = self._numbers(signs, starts, length)
        long = np.flatnonzero(length > _SHORT)
        piece, many = number[long], length[long]
        if not (np.array_equal(self.length.all[piece], many) and _same(np.frombuffer(signs, np.uint8), starts[long], self.signs.all, self.sign_first.all[piece], many)):
            return self._other([t.decode("latin-1") for t in texts])  # two pieces share a hash
        size = self.size.all[number]
        ahead = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        ids = self.ids.all[np.repeat(self.first.all[number] - ahead[:-1], size) + np.arange(ahead[-1])].tobytes()
        cut = 2 * ahead[np.searchsorted(starts, begins)]
        return [ids[a:b] for a, b in zip(cut.tolist(), cut[1:].tolist())]

    def _numbers(self, signs: bytes, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
        """A number for each piece, the same for the same key; those of new keys are encoded."""
        keys = piece_keys(signs, starts, length)
        number = self.places.find(keys)
        new = np.flatnonzero(number == 0)
        if not len(new):
            return number
        fresh, sample, which = np.unique(keys[new], return_index=True, return_inverse=True)
        if self.pieces and self.pieces + len(fresh) > KEEP:
            self._forget()
            return self._numbers(signs, starts, length)
        sample = new[sample]
        begin, many, text = starts[sample], length[sample], signs.decode("latin-1")
        pieces = [text[a:b] for a, b in zip(begin.tolist(), (begin + many).tolist())]
        ids, size = self._encode_pieces(pieces)
        numbers = np.arange(self.pieces + 1, self.pieces + 1 + len(fresh), dtype=np.int32)
        self.pieces += len(fresh)
        self.places.put(fresh, numbers)
        number[new] = numbers[which]
        self.sign_first.add(self.signs.n + np.cumsum(many) - many)
        self.length.add(many)
        self.signs.add(np.frombuffer("".join(pieces).encode("latin-1"), np.uint8))
        self.first.add(self.ids.n + np.cumsum(size) - size)
        self.size.add(size)
        self.ids.add(ids)
        return number

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one piece behind the other, and how many each has. ``TOGETHER`` pieces are one text to the library, as each call and result costs more than a piece."""
        texts = ["\n".join(pieces[i : i + TOGETHER]) for i in range(0, len(pieces), TOGETHER)]
        ids = np.concatenate([np.array(e.ids, "<u2") for e in self.merges.encode_batch_fast(texts, add_special_tokens=False)])
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) == len(pieces) and ends[-1] == len(ids):
            return ids, np.diff(ends, prepend=0)
        made = [e.ids for e in self.merges.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.array([i for m in made for i in m], "<u2"), np.array([len(m) for m in made], np.int64)

    def _other(self, texts: list[str]) -> list[bytes]:
        # The library lower-cases sign by sign, so a capital sigma never becomes a final one.
        pieces = [self.splitter.findall(unicodedata.normalize("NFC", t).replace("Σ", "σ").lower()) for t in texts]
        new = {w for p in pieces for w in p}.difference(self.known)
        if len(self.known) + len(new) > KEEP:
            self.known.clear()
            new = {w for p in pieces for w in p}
        if new:
            made = list(new)
            ids, size = self._encode_pieces(made)
            run, ends = ids.tobytes(), 2 * np.cumsum(size)
            self.known.update((w, run[a:b]) for w, a, b in zip(made, (ends - 2 * size).tolist(), ends.tolist()))
        return [b"".join(map(self.known.__getitem__, p)) for p in pieces]


def _same(data: np.ndarray, a: np.ndarray, others: np.ndarray, b: np.ndarray, length: np.ndarray) -> bool:
    """Whether all runs of ``data`` from ``a`` hold the same bytes as those of the same length of ``others`` from ``b``."""
    before = np.cumsum(length) - length
    step = np.arange(int(length.sum()))
    return np.array_equal(data[np.repeat(a - before, length) + step], others[np.repeat(b - before, length) + step])


_words: dict[str, Words] = {}


def words(path: str) -> Words:
    if path not in _words:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share the cores already
        _words[path] = Words(path)
    return _words[path]


def _encoded(path: str):
    end = np.array([END_OF_DOCUMENT], "<u2").tobytes()

    def run(batches):
        own = words(path)
        for batch in batches:
            for block in B.blocks(batch.column("text")):
                ids = [x + end for x in own.encode([t or "" for t in batch.column("text").slice(block.row, len(block)).to_pylist()])]
                yield pa.RecordBatch.from_arrays([batch.column("doc").slice(block.row, len(block)), pa.array(ids, pa.binary())], ["doc", "ids"])

    return run


def _terms(batches):
    """Document frequencies (term, n), and under term -1 the number of documents, -2 their tokens."""
    df, docs, tokens = np.zeros(1 << 16, np.int64), 0, 0
    place, steps = np.zeros(1 << 16, np.int64), np.arange(1 << 12)
    for batch in batches:
        for ids in batch.column("ids").to_pylist():
            x = np.frombuffer(ids, "<u2")
            steps = steps if len(x) <= len(steps) else np.arange(2 * len(x))
            place[x] = steps[: len(x)]  # the last place of each term
            df[x[place[x] == steps[: len(x)]]] += 1
            docs, tokens = docs + 1, tokens + len(x)
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-1, -2]), pa.int64()), pa.array(np.append(df[some], [docs, tokens]), pa.int64())], ["term", "n"])


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


_COLUMNS = ["doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _full(batches):
    """Windows that one document fills."""
    number = (1 << 62) + (TaskContext.get().partitionId() << 36)
    for batch in batches:
        out = []
        for doc, ids in zip(batch.column("doc"), batch.column("ids").to_pylist()):
            x = np.frombuffer(ids, "<u2")
            for start in range(0, len(x) - WINDOW + 1, WINDOW):
                out.append((doc, start, WINDOW, crc(x[start : start + WINDOW]), len(x), number, 0))
                number += 1
        if out:
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field("doc").type), *(pa.array(c, pa.int64()) for c in cols[1:])], _COLUMNS)


def pack(lengths: np.ndarray, terms: list[np.ndarray], weights: list[np.ndarray], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces ``(document, start, length)`` over one shard. ``terms`` are distinct ids, at least one, ``weights`` their BM25 parts."""
    n = len(lengths)
    # The inverted index: postings (document, weight), those of a term one behind the other. Those of used documents are
    # taken out once half of the documents are used.
    term = np.concatenate(terms)
    order = np.argsort(term, kind="stable")
    doc, term, weight = np.repeat(np.arange(n), [len(t) for t in terms])[order], term[order], np.concatenate(weights)[order]
    first = np.concatenate(([0], np.cumsum(np.bincount(term))))
    steps = np.arange(len(doc))
    present = n
    left, at = lengths.astype(np.int64).copy(), np.zeros(n, np.int64)
    out = []
    total = int(left.sum())
    ranked = np.argsort(-left, kind="stable").tolist()
    carried: list[int] = []  # documents that were cut: their rests are the next seeds
    head = 0
    while total >= window:
        seed = -1
        while carried and seed < 0:
            c = carried.pop()
            seed = c if left[c] else -1
        while seed < 0:
            seed = ranked[head] if left[ranked[head]] else -1
            head += 1
        row, room = [], window

        def take(d: int, size: int):
            nonlocal room
            row.append((d, int(at[d]), size))
            at[d] += size
            left[d] -= size
            room -= size

        take(seed, min(int(left[seed]), room))
        if room:
            unused = left > 0
            if 2 * unused.sum() < present:
                entries = unused[doc]
                doc, term, weight, present = doc[entries], term[entries], weight[entries], int(unused.sum())
                first = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(first) - 1))))
            begin = first[terms[seed]]
            many = first[terms[seed] + np.int64(1)] - begin
            ahead = np.cumsum(many)
            posting = np.repeat(begin - ahead + many, many)
            posting += steps[: len(posting)]
            score = np.bincount(doc[posting], weight[posting], n)
            near = np.flatnonzero((score > 0) & unused)
            near = near[np.argsort(-score[near], kind="stable")]
            at_near = 0
            while room and at_near < len(near):  # all that fit, best first
                fits = np.flatnonzero(left[near[at_near:]] <= room)
                if not len(fits):
                    break
                at_near += int(fits[0])
                take(int(near[at_near]), int(left[near[at_near]]))
                at_near += 1
            if room:
                for d in near[left[near] > 0].tolist() + ranked:  # the best that did not fit is cut
                    if not room:
                        break
                    if left[d]:
                        take(d, min(int(left[d]), room))
                        if left[d]:
                            carried.append(d)
        total -= window
        out.append(row)
    rest = [d for d in ranked if left[d]]
    while total:  # below one window: lengths that are powers of two
        room, row = 1 << (total.bit_length() - 1), []
        total -= room
        while room:
            d = rest[0]
            size = min(int(left[d]), room)
            row.append((d, int(at[d]), size))
            at[d] += size
            left[d] -= size
            room -= size
            if not left[d]:
                rest.pop(0)
        out.append(row)
    return out


def _topic_rank(idf: np.ndarray, counts: dict[int, int]) -> np.ndarray:
    """Place of every term in the order that topics are chosen by: the rarest that at least two documents have first, others last."""
    shared = np.zeros(1 << 16, bool)
    shared[[t for t, df in counts.items() if df > 1]] = True
    rank = np.empty(1 << 16, np.int64)
    rank[np.lexsort((np.arange(1 << 16), -idf, ~shared))] = np.arange(1 << 16)
    return rank


def _tail_topics(batch, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Of every row: the place of its tail's topic, the tail's tokens, and the tail."""
    tails = [x[2 * start :] for x, start in zip(batch.column("ids").to_pylist(), batch.column("start").to_pylist())]
    size = np.array([len(t) // 2 for t in tails], np.int64)
    flat = rank[np.frombuffer(b"".join(tails), "<u2")]
    return (np.minimum.reduceat(flat, np.cumsum(size) - size) if len(size) else size), size, tails


def _topics(idf: np.ndarray, counts: dict[int, int]):
    def run(batches):
        rank, total = _topic_rank(idf, counts), np.zeros(1 << 16)
        for batch in batches:
            topic, size, _ = _tail_topics(batch, rank)
            total += np.bincount(topic, size, 1 << 16)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some].astype(np.int64))], ["topic", "tokens"])

    return run


def _shards(tokens: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """First shard of every topic and how many it has: as many as it fills, or one that it shares with the topics next to it."""
    first, parts = np.zeros(1 << 16, np.int64), np.ones(1 << 16, np.int64)
    shard, room = 0, SHARD
    for topic in sorted(tokens):
        if tokens[topic] > SHARD:
            own = -(-tokens[topic] // SHARD)
            shard, room = shard + (room < SHARD), SHARD
            first[topic], parts[topic] = shard, own
            shard += own
            continue
        if tokens[topic] > room:
            shard, room = shard + 1, SHARD
        first[topic] = shard
        room -= tokens[topic]
    return first, parts


def _dealt(idf: np.ndarray, counts: dict[int, int], first: np.ndarray, parts: np.ndarray):
    """Tails with their shard. The rows of a topic with several shards are dealt out by their number in the task."""

    def run(batches):
        rank = _topic_rank(idf, counts)
        seen = TaskContext.get().partitionId()
        for batch in batches:
            topic, size, tails = _tail_topics(batch, rank)
            shard = first[topic] + (seen + np.arange(len(size))) % parts[topic]
            seen += len(size)
            yield pa.RecordBatch.from_arrays([pa.array(shard), batch.column("doc"), batch.column("start"), batch.column("doc_tokens"), pa.array(tails, pa.binary())], ["shard", "doc", "start", "doc_tokens", "ids"])

    return run


def _shard(idf: np.ndarray, mean: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ids = [np.frombuffer(x, "<u2") for x in rows["ids"]]
        starts, tokens, names = rows["start"].to_numpy(), rows["doc_tokens"].to_numpy(), rows["doc"]
        # The terms of all pieces and how often each has them, piece by piece.
        size = np.array([len(x) for x in ids], np.int64)
        kind = np.uint32 if len(ids) <= 1 << 16 else np.int64  # the narrow one is sorted faster
        x = np.sort(np.repeat(np.arange(len(ids), dtype=kind) << kind(16), size) | np.concatenate(ids))
        ends = np.append(np.flatnonzero(x[1:] != x[:-1]), len(x) - 1)
        tf, x = np.diff(ends, prepend=-1), x[ends]
        own, t = (x >> kind(16)).astype(np.int64), x.astype(np.uint16)  # the lower bits are the term
        weight = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - SLOPE + SLOPE * size[own] / mean))
        cut = np.searchsorted(own, np.arange(len(ids) + 1)).tolist()
        terms, weights = [t[a:b] for a, b in zip(cut, cut[1:])], [weight[a:b] for a, b in zip(cut, cut[1:])]
        out = []
        for k, row in enumerate(pack(size, terms, weights)):
            offset = 0
            for d, start, size in row:
                out.append((d, int(starts[d]) + start, size, crc(ids[d][start : start + size]), int(tokens[d]), (int(key[0]) << 20) + k, offset))
                offset += size
        cols = list(zip(*out))
        frame = pd.DataFrame(dict(zip(_COLUMNS[1:], cols[1:])))
        frame.insert(0, "doc", names.iloc[list(cols[0])].to_numpy())
        return frame

    return run


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, start, length, ids_crc32, doc_tokens, sequence_id, offset``, one row per piece.

    Every text is encoded whole, null as empty, and ends with id 2, so an empty text is one token. Each token lies in exactly one
    piece, and a sequence's pieces follow each other without gaps from offset 0 up to 4096 tokens at most. Sequences shorter than that
    have a power of two as length. Null and repeated ids are rows of their own. Other columns are ignored. ``vocabulary`` is the path
    of a tokenizers file of fewer than 65,536 entries, readable on every node. Runs jobs.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    ids = materialize(rows.mapInArrow(_encoded(vocabulary), f"doc {kind}, ids binary"), "ids")
    # One row per entry of the vocabulary and two more.
    counts = {r["term"]: r["n"] for r in ids.select("ids").mapInArrow(_terms, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n, tokens = counts.pop(-1, 0) or 0, counts.pop(-2, 0) or 0
    idf = np.zeros(1 << 16, np.float64)
    for term, df in counts.items():
        idf[term] = np.log(1 + (n - df + 0.5) / (df + 0.5))
    shape = f"doc {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    whole = ids.where(f"octet_length(ids) >= {2 * WINDOW}").mapInArrow(_full, shape)
    size = F.expr("cast(octet_length(ids) div 2 as bigint)")
    tails = ids.withColumn("doc_tokens", size).where(f"doc_tokens % {WINDOW} > 0").withColumn("start", F.expr(f"(doc_tokens div {WINDOW}) * {WINDOW}"))
    topics = tails.select("start", "ids").mapInArrow(_topics(idf, counts), "topic long, tokens long").groupBy("topic").agg(F.sum("tokens").alias("tokens"))
    first, parts = _shards({r["topic"]: r["tokens"] for r in topics.collect()})  # one row per entry of the vocabulary at most
    tails = tails.mapInArrow(_dealt(idf, counts, first, parts), f"shard long, doc {kind}, start long, doc_tokens long, ids binary")
    packed = tails.groupBy("shard").applyInPandas(_shard(idf, tokens / max(n, 1)), shape)
    return whole.union(packed).withColumnRenamed("doc", id_col)
