"""Shards along a curve, codes of vectors and fill-in-the-middle texts: against SQL, plain versions and odd rows."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import oracle
import pyarrow as pa
import pytest

from gaugeline.llm import bytesops as B
from gaugeline.llm import codes, infill, queries, shards

CLASH = "'x' as shard, 1 as size, 2 as curve, 3 as row, 4 as n, 'y' as output, 5 as form, 6 as id, 7 as vector, 8 as code"


@pytest.mark.parametrize("name", ["op11_hilbert", "op12_vector_codes", "op13_fill_in_middle"])
def test_same_as_sql(spark, sf_dir, name):
    assert oracle.compare(spark, oracle.connect(sf_dir), queries.QUERIES[name], queries.ORACLE[name], sf_dir)[1] is None


@pytest.mark.parametrize("n, bits", [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_curve_visits_neighbours(spark, n, bits):
    cells = list(itertools.product(range(1 << bits), repeat=n))
    df = spark.createDataFrame(cells, ", ".join(f"c{i} int" for i in range(n)))
    at = {r["h"]: tuple(r)[:n] for r in df.withColumn("h", shards.hilbert([df[f"c{i}"] for i in range(n)], bits)).collect()}
    assert sorted(at) == list(range(len(cells)))
    assert all(sum(abs(a - b) for a, b in zip(at[i], at[i + 1])) == 1 for i in range(len(cells) - 1))


def odd_documents(spark):
    rows = [(i, f"text {i % 7}" * (i % 5), ["de", "en", None][i % 3], i % 4 and f"s{i % 11}" or None, i % 13) for i in range(200)]
    rows += [(7, "copy", "en", "s1", 4)] * 300 + [(None, None, None, None, None)] * 120 + [(None, "", "en", "s2", 0), (1000, "é" * 70000, "fr", "s3", 70000)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").selectExpr("*", "'x' as shard", "1 as curve", "2 as rank", "3 as _range")


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards_of_odd_rows(spark, law, monkeypatch):
    monkeypatch.setattr(shards, "RUN", 64)  # so that repeated rows take several tasks
    df = odd_documents(spark)
    got = shards.place(df, ["lang", "source", "n_chars"], law=law).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in df.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
        assert r.law == law and r.grown_shard is None
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    if law == "rows":
        assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and sorted(by) == list(range(16))
    else:
        total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
        assert all(sum(r["size"] for r in rows) <= total / 16 + largest for rows in by.values())
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in order] == sorted(r.curve for r in got)


def test_shards_of_few_and_no_rows(spark):
    df = odd_documents(spark)
    assert shards.place(df.limit(0), ["lang", "source", "n_chars"]).collect() == []
    assert sorted(r.shard for r in shards.place(df.where("doc_id < 5"), ["lang", "n_chars"], shards=4).collect()) == [0, 0, 1, 2, 3]
    with pytest.raises(ValueError):
        shards.place(df, ["lang"], law="key")


def test_written_shards_prune_by_every_dimension(spark, sf_dir, tmp_path):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    df = df.selectExpr("doc_id", "text", "lang", "source", "n_chars").repartition(4)
    shards.write(df, str(tmp_path / "out"), ["lang", "source", "n_chars"])
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(map(tuple, back.drop("shard").collect())) == Counter(map(tuple, df.collect()))
    spans = back.groupBy("shard").agg(*[f(c) for c in ("lang", "source", "n_chars") for f in (lambda c: _least(c), lambda c: _most(c))]).collect()
    for dim in ("lang", "source", "n_chars"):  # a shard covers a small range of each dimension
        values = sorted({r[dim] for r in df.select(dim).collect()})
        hits = [sum(s[f"min({dim})"] <= v <= s[f"max({dim})"] for s in spans) for v in values]
        assert np.mean(hits) < 0.75 * len(spans)
    with pytest.raises(ValueError):
        shards.write(df.withColumn("shard", df.lang), str(tmp_path / "other"), ["lang"])


def _least(c):
    from pyspark.sql import functions as F

    return F.min(c)


def _most(c):
    from pyspark.sql import functions as F

    return F.max(c)


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """rows: (id, vector of numbers, label)"""
    whole = [np.array([math.floor(4096 * x) for x in v], object).reshape(parts, -1) for _, v, _ in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))[:entries]
    books = [[list(whole[i][p]) for i in order] for p in range(parts)]
    assign = lambda: [[min((sum((a - b) ** 2 for a, b in zip(w[p], c)), e) for e, c in enumerate(books[p])) for p in range(parts)] for w in whole]
    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [whole[i][p] for i in range(len(rows)) if found[i][p][1] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    found, errors = assign(), defaultdict(int)
    for f, r in zip(found, rows):
        errors[r[2]] += sum(d for d, _ in f)
    sha = hashlib.sha256(",".join(str(x) for p in books for c in p for x in c).encode()).hexdigest()
    return Counter((r[0], "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), errors[r[2]], sha) for f, r in zip(found, rows))


def test_codes_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    good = [(i, rng.normal(size=16).round(2).tolist(), int(i % 3) or None) for i in range(90)]
    good += [(500, good[3][1], 1)] * 60 + [(None, [0.0] * 16, None), (None, [5.0] * 16, 9)]
    bad = [(600, None, 1), (601, [], 1), (602, [1.0] * 15 + [None], 1), (603, [math.nan] * 16, 1), (604, [math.inf] * 16, 2), (605, [1.0] * 8, 1)]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as row", "2 as id", "3 as x0", "4 as vector", "5 as code", "6 as _key")
    got = codes.digest(*codes.compress(df))
    assert Counter(tuple(r) for r in got.collect()) == plain_codes(good)


def test_codes_of_few_rows(spark):
    shape = "vec_id long, embedding array<float>, label int"
    assert codes.digest(*codes.compress(spark.createDataFrame([], shape))).collect() == []
    df = spark.createDataFrame([(2, [0.5] * 10, 1), (1, [-0.25] * 10, 1), (3, [1e30] * 10, 2)], shape)
    out, books = codes.compress(df)
    assert {r.vec_id: (r.code, r.error) for r in out.collect()} == {1: ("00" * 8, 0), 2: ("01" * 5 + "00" * 3, 0), 3: ("02" * 5 + "00" * 3, 0)}
    back = {r.vec_id: r.vector for r in codes.decode(out, books).collect()}
    assert back[1] == [-0.25] * 10 and back[2] == [0.5] * 10


def test_only_movers_are_shuffled(spark):
    """Members that keep their entry are written by the stage that tests them, without an exchange."""
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(50)], "id long, embedding array<double>")
    rows = codes.whole_numbers(df, "id", "embedding", 4096, [])
    shared = spark.sparkContext.broadcast(np.zeros((8, 2, 1), np.int64))
    members = rows.select("row", "vector").mapInArrow(codes._placed(shared, 8, 8, 1), codes.MEMBER)
    tested = members.mapInArrow(codes._tested(shared), codes.MEMBER + ", moves boolean")
    assert "Exchange" not in tested._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("error", [0, 3, 127])
def test_rank_index_is_exact(error):
    rng = np.random.default_rng(6)
    runs = [np.cumsum(rng.integers(0, rng.choice([2, 50, 5000]), n)) for n in (1, 2, 3, 400, 5000)]
    first = np.concatenate(([0], np.cumsum([len(r) for r in runs])))
    offsets = np.concatenate(runs)
    index = infill.RankIndex.fit(offsets, first, error)
    ranks = np.arange(len(offsets))
    assert np.abs(index.predict(ranks) - offsets).max() <= error
    assert np.array_equal(index.offset(ranks), offsets)
    straight = infill.RankIndex.fit(np.arange(0, 90000, 90), np.array([0, 1000]), error)
    assert len(straight.ranks) == 2  # one piece


def plain_middle(doc_id, text, rate=100, spm=50):
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h4 % 100 < spm else "psm"
    out = f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, form, len(prefix), len(middle), out


ODD = [None, "", "\n", "\n\n\n", "a", "a\nb", "é\nüß\n日本", "x <P> y\nz", "<S", "a\n<\n<\nS>", "one\r\ntwo\r\n", "P>\n<M\n<\n", "ab\n" * 40000, "w" * 300000, " \n" * 9]


@pytest.mark.parametrize("rate, spm", [(100, 50), (40, 0), (0, 50)])
def test_fill_in_middle_of_odd_rows(spark, rate, spm):
    rows = [(i, t) for i, t in enumerate(ODD * 6)] + [(3, "a\nb")] * 5 + [(None, "c\nd\ne\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *CLASH.split(", "))
    got = infill.fill_in_middle(df, rate=rate, spm=spm)
    assert Counter(tuple(r) for r in got.collect()) == Counter(plain_middle(d, t or "", rate, spm) for d, t in rows)
    back = infill.restored(got).collect()
    assert Counter((r.doc_id, r.restored) for r in back) == Counter((d, t or "") for d, t in rows)


def test_fill_in_middle_of_no_rows_and_broken_bytes(spark):
    assert infill.digest(infill.fill_in_middle(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
    df = spark.sql("select 5L as doc_id, cast(x'ff0a80c30a41' as string) as text")
    r = infill.digest(infill.fill_in_middle(df)).first()
    assert r.restored_sha256 == hashlib.sha256(b"\xff\n\x80\xc3\nA").hexdigest() and r.n == 3


def test_line_ends_of_a_block():
    texts = ["", "a\n", "b", "", "c\nd", "\n"]
    block = next(B.blocks(pa.array(texts)))
    ends, first = infill.line_ends(block)
    assert [ends[i:j].tolist() for i, j in zip(first, first[1:])] == [[0], [0, 2], [2, 3], [3], [3, 5, 6], [6, 7]]
