"""The operators for language-model data against brute force, round trips and held-out accuracy, with odd rows of all kinds."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import oracle
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from gaugeline.llm import bytesops as B
from gaugeline.llm import ann, bpe, embed_dedup, minhash, packing, ppm, quality, queries, suffixes, toxicity, warc

ODD = [(9001, None), (9002, ""), (9003, " \n\t"), (9004, "One"), (9005, "one"), (9006, "ab" * 300), (9007, "x" * 201), (9007, "é" * 150), (None, "left alone"), (9008, "loser " * 60000)]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    """The table, odd rows, repeated rows, and columns named like results."""
    base = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = base.union(spark.createDataFrame(ODD, base.schema)).union(base.where("doc_id < 3"))
    return rows.selectExpr("*", "1 as row", "'x' as component_id", "2 as score", "3 as doc", "4 as node").cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def words(text):
    return text.encode().lower().split()


def shingle_set(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def reachable(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x] = root[root[x]]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("n", [2, 5])
def test_minhash(docs, rows, n):
    sets, holds, pairs = [shingle_set(t, n) for _, t in rows], defaultdict(list), []
    for i, s in enumerate(sets):
        for x in s:
            holds[x].append(i)
    for i, s in enumerate(sets):
        for j, k in Counter(j for x in s for j in holds[x] if j < i).items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                pairs.append((i, j))
    root, least = reachable(len(rows), pairs), {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root[i]] = min(least.get(root[i], d), d)
    want = Counter((d, len(sets[i]), least.get(root[i]), d == least.get(root[i]) if d is not None else True) for i, (d, _) in enumerate(rows))
    assert Counter(tuple(r) for r in minhash.near_duplicates(docs, words=n).collect()) == want


def test_large_groups_of_near_copies(spark):
    """Texts around the limit in one large group: all links count, also those far from any pivot."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(f"e{rng.integers(9)}" if rng.random() < rate else w for w in base) for rate in rng.uniform(0, 0.16, 300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingle_set(t, 2) for t in texts]
    pairs = [(i, j) for i in range(300) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root, least = reachable(300, pairs), {}
    for i in range(300):
        least.setdefault(root[i], i)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()} == {i: least[root[i]] for i in range(300)}


def test_embeddings(spark, sf_dir):
    base = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    odd = [(10**6, None), (10**6 + 1, []), (10**6 + 2, [0.0] * 64), (10**6 + 3, [math.nan] * 64), (10**6 + 4, [1.0, None]), (10**6 + 5, [1.0, 2.0]), (10**6 + 6, [2.0, 4.0])]
    table = base.union(spark.createDataFrame(odd, base.schema)).union(base.limit(3).selectExpr("vec_id + 2000000", "embedding")).selectExpr("*", "1 as n", "2 as node")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(table).collect()}
    good = [r for r in table.collect() if r.embedding and len(r.embedding) == 64 and all(x is not None and math.isfinite(x) for x in r.embedding) and any(r.embedding)]
    x = np.array([r.embedding for r in good], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    root, least = reachable(len(good), zip(*np.nonzero(near))), {}
    for i, r in enumerate(good):
        least[root[i]] = min(least.get(root[i], r.vec_id), r.vec_id)
    want = {i: (0, i, True) for i, _ in odd[:5]} | {10**6 + 5: (1, 10**6 + 5, True), 10**6 + 6: (1, 10**6 + 5, False)}
    want |= {r.vec_id: (int(near[i].sum()), least[root[i]], r.vec_id == least[root[i]]) for i, r in enumerate(good)}
    assert got == want


def test_bpe(docs, rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = Counter(tuple(r) for r in bpe.digest(bpe.decode(bpe.encode(docs, path), path)).collect())
    want = Counter()
    for d, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert got == want
    own = bpe.encoder(path)
    for t in ("<|endoftext|>a<|endoftext|>", "it's  we'll\x85½ 12Ⅷ\x1c", "日本 😀\n\n  x", "%%%%====" * 50):
        assert np.frombuffer(own.encode([t])[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_warc_records(spark, sf_dir):
    assert oracle.compare(spark, oracle.connect(sf_dir), queries.QUERIES["op4_warc"], queries.ORACLE["op4_warc"], sf_dir)[1] is None
    body = "p" * 100
    rows = [(3, "u", body), (1, None, body), (2, "u", body), (4, "u", None), (5, "u", ""), (6, "u", "s"), (7, "u", "s"), (None, "u\r\n", body)]
    back = warc.read(warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in back} == {
        3: ("revisit", 1, 100), 1: ("response", None, 100), 2: ("revisit", 1, 100), 4: ("response", None, 0), 5: ("response", None, 0),
        6: ("response", None, 1), 7: ("response", None, 1), None: ("response", None, 100),
    }
    with pytest.raises(ValueError):
        warc.parse(warc.record(1, "u", b"abc", "0", None).replace(b"abc", b"abd"))


def test_nearest(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    table = table.union(spark.createDataFrame([(10**6, None), (10**6 + 1, [0.0] * 64)], table.schema)).union(table.limit(40).selectExpr("vec_id + 2000000", "embedding")).selectExpr("*", "1 as node")
    got = defaultdict(list)
    for r in ann.nearest(table, table.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    good = [r for r in table.collect() if r.embedding and any(r.embedding)]
    ids, x = np.array([r.vec_id for r in good]), np.array([r.embedding for r in good], float)
    found = 0
    for q in ids[ids % 20 == 0].tolist():
        score = x @ x[ids == q][0]
        order = [i for i in np.lexsort((ids, -np.round(score, 12))) if ids[i] != q][:20]
        assert len(got[q]) == 20 and [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
        found += len({int(ids[i]) for i in order} & {i for i, _ in got[q]})
    assert found >= 0.9 * 20 * (ids % 20 == 0).sum()


def test_classifiers(spark, docs, sf_dir):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    truth = {r.doc_id: r for r in labels.collect()}
    for module, name, least in ((quality, "quality", 0.97), (toxicity, "toxic", 0.93)):
        model = module.train(table, labels)
        held = [r for r in module.score(table, model).where("held_out").collect() if r.doc_id in truth]
        assert held and np.mean([r.predicted == truth[r.doc_id][name] for r in held]) >= least
        odd = module.score(docs, model).collect()
        assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
        none = module.train(docs, labels.limit(0))
        assert module.score(docs, none).count() == docs.count()


def test_ppm(docs, rows):
    count = Counter()
    for d, t in rows:
        if d is None or zlib.crc32(str(d).encode()) % 5 != 1:
            count.update(words(t) + ["end"])
    n, v = sum(count.values()), len(count)
    want = defaultdict(list)
    for d, t in rows:
        w = words(t) + ["end"]
        want[d].append((len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)))
    out = ppm.score(docs).collect()
    assert len(out) == len(rows) and all(r.score <= 0 for r in out)
    for r in out:
        assert any((r.n_tokens, r.n_known, r.train_tokens) == x[:3] and abs(r.base_score - x[3]) < 1e-6 for x in want[r.doc_id])


def test_ppm_chances_add_up(rows):
    block = next(B.blocks(pa.array([t for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 5 != 1]), 1 << 40))
    key, n = np.unique(ppm.runs(*ppm.canonical(block)[:2]), return_counts=True)
    trie = ppm.build([ppm._added([(key & np.uint64((1 << 8 * (k + 1)) - 1), n)]) for k in range(ppm.ORDER + 1)])
    for context in (b"\n\n\n\n\n", b" the ", b"zzzzz", "é e".encode() + b"q"):
        keys = np.array([int.from_bytes(context[-5:] + bytes([b]), "big") for b in range(256)], np.uint64)
        assert abs((10 ** trie.log10(keys)).sum() - 1) < 1e-9


def test_packing(docs, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    encoded = Counter()
    for d, t in rows:
        encoded[d, tuple(library.encode(t, add_special_tokens=False).ids + [2])] += 1
    out = packing.pack_documents(docs, path).collect()
    lengths, places = Counter(), defaultdict(list)
    for r in out:
        lengths[r.sequence_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert all(n <= 4096 and n & (n - 1) == 0 for n in lengths.values())
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == np.cumsum([0, *(n for _, n in p[:-1])]).tolist()
    pieces = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out)
    assert sum(n * k[2] for k, n in pieces.items()) == sum(n * len(k[1]) for k, n in encoded.items())
    by = defaultdict(list)
    for (d, ids), _ in encoded.items():
        by[d].append(ids)
    for d, start, length, crc, total in pieces:
        assert any(len(ids) == total and zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()) == crc for ids in by[d])


@pytest.mark.parametrize("hot", [5000, 2])
def test_repeats(spark, rows, hot, monkeypatch):
    some = [(d, t) for d, t in rows if len(t) < 20000]
    many, raw = Counter(), [(d, t.encode()) for d, t in some]
    for _, b in raw:
        many.update(b[p : p + 200] for p in range(len(b) - 199))
    want = Counter()
    for d, b in raw:
        gone = bytearray(len(b) + 1)
        for p in range(len(b) - 199):
            if many[b[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b)))
        want[d, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()] += 1
    plain = suffixes.repeats
    monkeypatch.setattr(suffixes, "repeats", lambda texts, length, gram: plain(texts, length, gram, hot))
    table = spark.createDataFrame(some, "doc_id long, text string").selectExpr("*", "1 as row", "2 as anchor")
    assert Counter(tuple(r) for r in suffixes.digest(suffixes.remove_repeats(table)).collect()) == want


def test_empty_tables(spark, sf_dir):
    docs = spark.createDataFrame([], "doc_id long, text string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert minhash.near_duplicates(docs).count() == embed_dedup.near_duplicates(vectors).count() == bpe.encode(docs, path).count() == 0
    assert warc.read(warc.write(spark.createDataFrame([], "page_id long, url string, html string"))).count() == ann.nearest(vectors, vectors).count() == 0
    assert ppm.score(docs).count() == packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).count() == suffixes.remove_repeats(docs).count() == 0


def test_pipeline(spark, docs, sf_dir):
    """Every stage alone over odd rows: what it drops and keeps."""
    full = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    table = docs.selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "cast(length(text) as bigint) as n_chars", "node")
    names = table.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, sf_dir)
        assert stage(spark, spark.createDataFrame([], full), sf_dir).count() == 0
        if name != "packing":
            assert out.columns == names and 0 < out.count() <= table.count()
    one = corpus_pipeline.one_of_each(spark, table, sf_dir)
    assert one.where("doc_id < 3").groupBy("doc_id").count().where("count > 1").isEmpty()
    assert one.where("doc_id is null").count() == 1 and one.where("doc_id = 9007").count() == 2
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
