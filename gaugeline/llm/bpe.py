"""Byte-level BPE encoding over a trie of distinct words, and decoding.

A text is split into words by the vocabulary's pattern. The distinct words of a batch go into a trie, here the sorted list
of words walked depth first: words in order share their prefixes with the word before, so every prefix is worked on once.
The state of a prefix is the last token of its encoding. That token is the one vocabulary entry ``t`` ending there whose
join with the last token of the prefix before it is stable, i.e. merging would leave both as they are; it exists and is
unique. A word's encoding is then read backwards along the last tokens.

Encodings of words are kept per Python worker up to ``KEEP`` words, so the memory is bounded whatever the texts hold.
"""

from __future__ import annotations

import json
import re
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEEP = 700_000
# Fixed value: the splitting pattern of this vocabulary; the other forms are the same for ASCII and Latin-1 texts.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PATTERN_ASCII = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""
PATTERN_LATIN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zªµºÀ-ÖØ-öø-ÿ]+| ?[0-9²³¹¼-¾]+| ?[^\t-\r \x85\xa0A-Za-zªµºÀ-ÖØ-öø-ÿ0-9²³¹¼-¾]+|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+"""


def is_latin(text: str) -> bool:
    """Whether all signs are below U+0100."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        signs, model = byte_signs(), file["model"]
        raw = lambda token: bytes(signs[c] for c in token)
        self.tokens: list[bytes] = [b""] * (max(model["vocab"].values()) + 1 + len(file["added_tokens"]))
        rank = {}
        for token, i in model["vocab"].items():
            self.tokens[i] = raw(token)
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        for text, i in self.special.items():
            self.tokens[i] = text.encode()
        self.ids = {t: i for i, t in enumerate(self.tokens) if t and i not in self.special.values()}
        # Merge order by pair, and the pair that makes a token. Ids rise with merge order, single bytes come first.
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for n, pair in enumerate(model["merges"]):
            left, right = (self.ids[raw(x)] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            made = self.ids[self.tokens[left] + self.tokens[right]]
            rank[made] = n
            self.merged[left, right] = made
            self.parts[made] = (left, right)
        self.rank = [-1] * len(self.tokens)
        for i, n in rank.items():
            self.rank[i] = n
        self.stable_pairs: dict[tuple[int, int], bool] = {}
        # Tokens that merging their own bytes does not give can never be in an encoding.
        self.longest = max(map(len, self.tokens))
        self.usable = {t: i for t, i in self.ids.items() if self._merge(t) == [i]}
        self.known: dict[str, bytes] = {}
        self.splitter, self.splitter_ascii, self.splitter_latin = regex.compile(PATTERN), re.compile(PATTERN_ASCII, re.ASCII), re.compile(PATTERN_LATIN)
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def _merge(self, word: bytes) -> list[int]:
        """Plain merging, lowest order first; used once per token of the vocabulary."""
        ids = [self.ids[word[i : i + 1]] for i in range(len(word))]
        while len(ids) > 1:
            best = min(((self.rank[m], i) for i in range(len(ids) - 1) if (m := self.merged.get((ids[i], ids[i + 1]))) is not None), default=None)
            if best is None:
                break
            ids[best[1] : best[1] + 2] = [self.merged[ids[best[1]], ids[best[1] + 1]]]
        return ids

    def _stable(self, left: int, right: int) -> bool:
        """Whether merging the bytes of two tokens side by side gives just these two.

        The last merges of both are undone in turn, latest first; if the tokens that face each other at the seam would
        have merged before the next merge that was undone, the pair is not stable.
        """
        merged, rank, parts = self.merged, self.rank, self.parts
        limit = 1 << 60
        while True:
            joined = merged.get((left, right))
            if joined is not None and rank[joined] < limit:
                return False
            if rank[left] > rank[right]:  # the left one was made later, so it is undone first
                limit = rank[left]
                left = parts[left][1]
            elif rank[right] >= 0:
                # A merge at the seam of equal order would come before the right one's, being further left.
                limit = rank[right] + 1
                right = parts[right][0]
            else:
                return True

    def encode_words(self, words: list[str]) -> None:
        """Adds the encodings of new words to ``known``."""
        usable, stable, pairs, longest = self.usable, self._stable, self.stable_pairs, self.longest
        if len(self.known) + len(words) > KEEP:
            self.known.clear()
        if len(pairs) > 2 * KEEP:
            pairs.clear()
        before, last = b"", [(-1, 0)]  # last[d]: last token of the prefix of d bytes, and its length
        for word, name in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for size in range(min(end, longest), 0, -1):
                    token = usable.get(word[end - size : end])
                    if token is None:
                        continue
                    if size == end:
                        break
                    pair = (last[end - size][0], token)
                    ok = pairs.get(pair)
                    if ok is None:
                        ok = pairs[pair] = stable(*pair)
                    if ok:
                        break
                last.append((token, size))
            before, at, ids = word, len(word), []
            while at:
                token, size = last[at]
                ids.append(token)
                at -= size
            ids.reverse()
            self.known[name] = pack(f"<{len(ids)}I", *ids)

    def split(self, text: str) -> list[str]:
        return (self.splitter_ascii if text.isascii() else self.splitter_latin if is_latin(text) else self.splitter).findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian 32-bit numbers. Texts of special tokens stand for these, as in the library."""
        pieces = []
        for text in texts:
            if self.marks is not None and any(m in text for m in self.special):
                parts = self.marks.split(text)
                pieces.append([x for i, p in enumerate(parts) for x in ([self.special[p]] if i % 2 else self.split(p))])
            else:
                pieces.append(self.split(text))
        out = []
        for part in range(0, len(pieces), 256):  # a bounded set of new words at a time
            some = pieces[part : part + 256]
            new = {w for p in some for w in p if type(w) is str}.difference(self.known)
            if new:
                if len(self.known) + len(new) > KEEP:
                    new = {w for p in some for w in p if type(w) is str}
                self.encode_words(list(new))
            known = self.known
            for p in some:
                try:
                    out.append(b"".join(map(known.__getitem__, p)))
                except KeyError:
                    out.append(b"".join(np.array([w], "<u4").tobytes() if type(w) is int else known[w] for w in p))
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _encoded(path: str):
    def run(batches):
        own = encoder(path)
        for batch in batches:
            for part in range(0, batch.num_rows, 512):
                some = batch.slice(part, 512)
                yield pa.RecordBatch.from_arrays([some.column("doc"), pa.array(own.encode([t or "" for t in some.column("text").to_pylist()]), pa.binary())], ["doc", "ids"])

    return run


def _decoded(path: str):
    def run(batches):
        own = encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("ids"), pa.array([own.decode(x) for x in batch.column("ids").to_pylist()], pa.string())], ["doc", "ids", "decoded"])

    return run


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, ids``: the token ids of each whole text as a binary of little-endian unsigned 32-bit numbers.

    ``vocabulary`` is the path of a byte-level BPE file in the tokenizers library's JSON form, readable on every node. A null or
    empty text has no ids; null and repeated document ids are passed on; other columns are ignored. One row out per row in.
    """
    texts = docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text"))
    return texts.mapInArrow(_encoded(vocabulary), f"doc {texts.schema['doc'].dataType.simpleString()}, ids binary").withColumnRenamed("doc", id_col)


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id") -> DataFrame:
    """Adds ``decoded``, the text of ``ids`` (bytes that are no UTF-8 become replacement signs)."""
    rows = encoded.select(F.col(f"`{id_col}`").alias("doc"), F.coalesce("ids", F.lit(b"")).alias("ids"))
    return rows.mapInArrow(_decoded(vocabulary), f"doc {rows.schema['doc'].dataType.simpleString()}, ids binary, decoded string").withColumnRenamed("doc", id_col)


def digest(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and SHA-256 digests of ids and text."""
    return decoded.select(
        F.col(id_col), F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
