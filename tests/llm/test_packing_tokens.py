"""Token ids of Latin-1 blocks against the library, and the order in which a shard fills its windows against plain BM25 sums."""

import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from gaugeline.llm import packing


def test_latin_blocks_equal_the_library(monkeypatch):
    own = packing.Words(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(7)
    signs = "aAbsStTrReEvVlLmMdD''''' \n\t\"-.,09²½éÉßµ×÷ªÿ\x85\xa0\x1c<>_"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(2500)]
    texts += ["", " ", "don't're''s 's's", "'", "'re", "'r", "x'l", "'tis 'twas", "Σας it's", "日本 we'll", "😀 'tis", "<|endoftext|> a", "ab" * 3000]
    want = [own.library.encode(t, add_special_tokens=False).ids for t in texts]
    for keep in (packing.KEEP, 50):  # also when pieces are forgotten again and again
        monkeypatch.setattr(packing, "KEEP", keep)
        for first in range(0, len(texts), 100):
            got = own.encode(texts[first : first + 100])
            assert [np.frombuffer(x, "<u2").tolist() for x in got] == want[first : first + 100]


def test_two_pieces_with_one_hash_are_told_apart(monkeypatch):
    own = packing.Words(public_tokenizers.path("word_bpe_49k.json"))
    monkeypatch.setattr(packing.B, "span_hash", lambda p, a, b: (b - a).astype(np.uint64))
    got = own.encode(["one two six", "ten"])
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [own.library.encode(t, add_special_tokens=False).ids for t in ("one two six", "ten")]
    # Also where the other piece came with an earlier block.
    for t in ("one", "six", "seven", "one six"):
        assert np.frombuffer(own.encode([t])[0], "<u2").tolist() == own.library.encode(t, add_special_tokens=False).ids


def test_long_pieces_with_one_hash_are_told_apart(monkeypatch):
    own = packing.Words(public_tokenizers.path("word_bpe_49k.json"))
    monkeypatch.setattr(packing, "piece_hash", lambda signs, starts, length: length.astype(np.uint64))
    # In one text, in one block, with an earlier block, and alone.
    for texts in (["elephants crocodile"], ["anteater", "aardvark"], ["crocodile"], ["elephants one"], ["antelope seven"], ["elephants"]):
        assert [np.frombuffer(x, "<u2").tolist() for x in own.encode(texts)] == [own.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_of_all_lengths_equal_the_library():
    """Lengths around those that the keys tell apart (7, 8, 64), alike but for one sign or the length, with zero bytes; capitals, other scripts."""
    own = packing.Words(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(11)
    texts = ["\x00", "\x00\x00", "\x00" * 8, "!\x00", "!"]
    for n in (1, 6, 7, 8, 9, 15, 16, 17, 63, 64, 65, 72, 130, 5000):
        word = "".join(rng.choice("abcdeé") for _ in range(n))
        texts += [word, word + "x", "x" + word[1:], word[:-1] + "x", word.upper(), "=" * n, word + " " + word[: n // 2], word + " мир " + word]
    want = [own.library.encode(t, add_special_tokens=False).ids for t in texts]
    for some in ([texts], [[t] for t in texts], [texts[::-1]]):
        got = [np.frombuffer(x, "<u2").tolist() for part in some for x in own.encode(part)]
        assert got == (want[::-1] if some[0][0] == texts[-1] else want)


def test_keys_keep_their_numbers():
    rng = np.random.default_rng(2)
    places, plain = packing.Places(), {}
    for n in (0, 5, 3000, 40_000):
        some = np.unique(np.concatenate((rng.integers(1, 1 << 63, n, dtype=np.uint64), np.arange(1, n + 1, dtype=np.uint64) << np.uint64(56))))
        some = some[[k not in plain for k in some.tolist()]] if n else some
        number = np.arange(len(plain) + 1, len(plain) + 1 + len(some), dtype=np.int32)
        places.put(some, number)
        plain.update(zip(some.tolist(), number.tolist()))
        asked = np.concatenate((np.array(list(plain), np.uint64), rng.integers(1, 1 << 63, 1000, dtype=np.uint64)))
        assert places.find(asked).tolist() == [plain.get(k, 0) for k in asked.tolist()] and 2 * len(plain) <= len(places.keys)


def test_new_pieces_go_to_the_library_many_at_a_time():
    """A call for each new piece was a third of the time of encoding."""
    own = packing.Words(public_tokenizers.path("word_bpe_49k.json"))
    seen = []

    class Counted:
        def __init__(self, merges):
            self.merges = merges

        def encode_batch_fast(self, texts, **more):
            seen.extend(texts)
            return self.merges.encode_batch_fast(texts, **more)

    own.merges = Counted(own.merges)
    rng = random.Random(4)
    words = ["".join(rng.choices("aeinorst", k=9)) for _ in range(3000)]
    for texts in ([" ".join(words)], ["мир " + " ".join(w + "ш" for w in words)]):
        seen.clear()
        got = own.encode(texts)
        assert [np.frombuffer(x, "<u2").tolist() for x in got] == [own.library.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(seen) < 100
        own.encode(texts)
        assert len(seen) < 100


def test_a_vocabulary_without_suffix(tmp_path):
    """Where no token tells a piece's end, the pieces are encoded one by one."""
    import json

    file = json.load(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8"))
    signs = [t for t in file["model"]["vocab"] if len(t) == 1]
    file["model"] |= {"end_of_word_suffix": None, "merges": [["a", "b"]], "vocab": {t: i for i, t in enumerate([*signs, "ab"])}}
    file["added_tokens"] = []
    (tmp_path / "plain.json").write_text(json.dumps(file), encoding="utf-8")
    own = packing.Words(str(tmp_path / "plain.json"))
    texts = ["abba cab don't", "", "cab, ab", "éa мab"]
    assert [np.frombuffer(x, "<u2").tolist() for x in own.encode(texts)] == [own.library.encode(t, add_special_tokens=False).ids for t in texts]


def plain_order(lengths, terms, weights, window):
    """The first window of a shard, every piece scored one by one."""
    seed = max(range(len(lengths)), key=lambda d: (lengths[d], -d))
    scores = {d: sum(w for t, w in zip(terms[d], weights[d]) if t in set(terms[seed])) for d in range(len(lengths)) if d != seed}
    out, room = [seed], window - lengths[seed]
    for d in sorted((d for d in scores if scores[d] > 0), key=lambda d: (-scores[d], d)):
        if lengths[d] <= room:
            out.append(d)
            room -= lengths[d]
    return out


def test_windows_are_filled_in_the_order_of_scores():
    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths = rng.integers(5, 60, 80)
        terms = [np.unique(rng.integers(0, 50, rng.integers(1, 12))) for _ in lengths]
        weights = [rng.integers(1, 99, len(t)).astype(float) for t in terms]
        rows = packing.pack(lengths, terms, weights, window=128)
        want = plain_order(lengths.tolist(), [t.tolist() for t in terms], [w.tolist() for w in weights], 128)
        got = [d for d, _, _ in rows[0]]
        assert got[: len(want)] == want  # behind them only a cut piece
        left = np.zeros(len(lengths), np.int64)
        for row in rows:
            for d, start, size in row:
                assert start == left[d]
                left[d] += size
        assert np.array_equal(left, lengths)


def test_shards_hold_topics_and_stay_bounded(monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 100)
    tokens = {5: 30, 6: 60, 7: 20, 9: 1000, 12: 40, 13: 100}
    first, parts = packing._shards(tokens)
    held = {}
    for t, n in tokens.items():
        for i in range(parts[t]):
            held[first[t] + i] = held.get(first[t] + i, 0) + n / parts[t]
    assert max(held.values()) <= 100 and sorted(held) == list(range(len(held))) and first[5] == first[6] and parts[9] == 10


def test_documents_on_one_matter_meet(spark, monkeypatch):
    """Eight texts on each of 40 matters, in shards of some matters each: windows hold whole matters. Null ids with one text are dealt out, too."""
    monkeypatch.setattr(packing, "SHARD", 1500)
    rng = random.Random(5)
    common = [f"{a}{b}" for a in "bcdfgh" for b in ("an", "en", "in")]
    matters = ["zebra", "quartz", "violin", "harbor", "cactus", "walrus", "saddle", "ginger"] * 5
    rows = [(i * 8 + j, " ".join([f"{m} {m}{'aeiou'[i // 8]}x"] * 4 + rng.choices(common, k=30))) for i, m in enumerate(matters) for j in range(8)]
    df = spark.createDataFrame(rows + [(None, "same words here " * 20)] * 200, "doc_id long, text string")
    got = packing.pack_documents(df, public_tokenizers.path("word_bpe_49k.json"))
    shards = got.groupBy(F.shiftright("sequence_id", 20).alias("s")).agg(F.sum("length").alias("n")).collect()
    assert len(shards) > 8 and max(r.n for r in shards) < 4 * 1500
    by = {r.doc_id: r.sequence_id >> 20 for r in got.where("doc_id is not null").collect()}
    apart = sum(by[i * 8 + j] == by[i * 8] for i in range(40) for j in range(8)) / 320
    assert apart > 0.6  # by chance about one in twenty would
