"""Each operator against brute force on small fixtures, and the awkward inputs that its docstring defines."""

import glob
import itertools
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tracewell.llm import bloom, bpe, chat, common, decontam, exact_dedup, graph, minhash, mixing, quality, textvec, token_counts, token_output, url_filter, warc
from tracewell.llm.textvec import grams, raw, slices, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


def awkward(spark, extra=True):
    """Nulls, empty and long texts, repeated rows, columns with names that operators use inside."""
    rng = random.Random(5)
    long = sentence(rng, 30000)
    rows = [(1, None, "a"), (None, "some words here", "a"), (2, "", "a"), (3, "   \n\t ", None), (4, long, "b"), (5, long + " end", "b"), (6, "one", "b"), (6, "one", "b"), (7, "one", "c"), (8, "größe ÉTÉ — x", "c"), (None, None, None)]
    df = docs(spark, rows)
    if extra:
        for name in ("row", "gone", "h", "hit", "key", "id", "sig", "level", "of", "at", "n", "place", "tokens", "x", "keep", "t1"):
            df = df.withColumn(name, F.lit(name))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return Counter(map(str, df.collect()))


# Shared parts.


def brute_words(text):
    """Words of any script, character by character."""
    import unicodedata

    out, now = [], ""
    for c in text:
        word = ord(c) >= 0x20000 or unicodedata.category(c)[0] in "LNM"
        alone = word and (ord(c) >= 0x20000 or any(a <= ord(c) <= b for a, b in textvec.ALONE))
        if word and not alone:
            now += c.lower() if len(c.lower()) == 1 else c
            continue
        out += [now] * bool(now) + [c] * alone
        now = ""
    return out + [now] * bool(now)


@pytest.mark.parametrize("most", [textvec.MOST, 64, 17])
def test_words_of_all_scripts(monkeypatch, most):
    monkeypatch.setattr(textvec, "MOST", most)
    rng = random.Random(3)
    parts = ["a", "B", "z", "9", " ", "\n", "!", "é", "É", "ß", "—", "“", "¿", "«", "Ж", "ж", "中", "文", "。", "か", "カ", "ー", "ก", "า", "่", "가", "İ", "ẞ", "𠀀", "😀", "Ω", "_", " ", "Hello", "größe"]
    known = {}
    for _ in range(300):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(rng.randrange(1, 6))]
        h, first, start, end = words(*raw(pa.array(texts)))
        want = [brute_words(t) for t in texts]
        assert np.diff(first).tolist() == list(map(len, want))
        data = "".join(texts).encode()
        assert [brute_words(data[s:e].decode()) for s, e in zip(start, end)] == [[w] for ws in want for w in ws]
        for w, x in zip([w for ws in want for w in ws], h.tolist()):
            assert known.setdefault(w, x) == x
    assert len(set(known.values())) == len(known)


def test_a_long_word_is_one_word(monkeypatch):
    monkeypatch.setattr(textvec, "MOST", 100)
    assert len(words(*raw(pa.array(["a" * 9000 + " b", "é" * 9000])))[0]) == 3
    one, two = (words(*raw(pa.array([t])))[0] for t in ("x" * 5000, "x" * 4999 + "y"))
    assert len(one) == len(two) == 1 and one[0] != two[0]


def test_slices_cover_everything_and_nulls_are_empty():
    arr = pa.array(["ab", None, "c" * 50, "", "d"])
    parts = list(slices(arr, 10))
    assert pa.concat_arrays([p for _, p in parts]).equals(arr)
    assert raw(arr)[1].tolist() == [0, 2, 2, 52, 52, 53]
    assert raw(arr.slice(2))[1].tolist() == [0, 50, 50, 51]


@pytest.mark.parametrize("hot", [common.HOT_ROWS, 20])
def test_components(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    # A node with very many neighbours, smaller and larger ones.
    edges += [(5000, i) for i in range(4000, 6000, 9) if i != 5000] + [(4000, 3999)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in {y for e in edges for y in e}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_large_buckets_compare_all_but_their_largest_label(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rows = [(1, i, 0) for i in range(50)] + [(1, i, i) for i in range(50, 60)] + [(2, i, i // 6) for i in range(100, 112)]
    units = minhash._blocks(spark.createDataFrame(rows, "key long, id long, label long")).collect()
    together = {}
    for r in units:
        together.setdefault(r.key, set()).add(r.id)
    met = {(a, b) for m in together.values() for a in m for b in m}
    for key, i, label in rows:
        for other, j, its in rows:
            assert label == its or ((i, j) in met) == (key == other)
    # 13 blocks of the largest label each meet 3 of the rest, whose members meet 13 + 3.
    assert sum(r.id < 50 for r in units) == 50 * 3 and sum(50 <= r.id < 60 for r in units) == 10 * 16


# 1 WARC.


def records(spark, rows):
    return spark.createDataFrame(rows, warc.RECORD)


def test_warc_round_trip_and_revisits(spark, tmp_path):
    body = [bytearray(b"<p>one</p>\r\n\r\nWARC/1.1"), bytearray(b"<p>two</p>"), bytearray(b"")]
    http = "HTTP/1.1 200 OK\r\nA: b\r\n\r\n"
    rows = [
        ("r1", "response", "http://a", "2024-01-02", "d1", http, body[0]), ("r2", "response", "http://b", "2024-01-01", "d1", http, body[0]), ("r3", "response", "http://c d", "2024-01-03", "d2", http, body[1]),
        ("v1", "revisit", "http://a", "2024-02-01", "d1", http, None), ("v2", "revisit", "http://z", "2024-02-01", "gone", http, None), ("n1", "response", None, None, None, None, None), ("n2", "metadata", "http://a", None, None, None, body[2]),
    ]
    path = str(tmp_path / "out")
    index = {r.record_id: r for r in warc.write_deduplicated(records(spark, rows), path).collect()}
    assert {k: (r.warc_type, r.status, r.refers_to) for k, r in index.items()} == {
        "r1": ("revisit", "duplicate", "r2"), "r2": ("response", "original", None), "r3": ("response", "original", None), "v1": ("revisit", "resolved", "r2"), "v2": ("revisit", "unresolved", None), "n1": ("response", "original", None), "n2": ("metadata", "other", None),
    }
    back = {r.record_id: r for r in warc.read_archive(spark, glob.glob(path + "/*.gz")).collect()}
    assert set(back) == set(index)
    assert bytes(back["r2"].payload) == bytes(body[0]) and back["r2"].http_headers == http and bytes(back["r3"].payload) == bytes(body[1])
    assert bytes(back["r1"].payload) == b"" and back["r1"].refers_to == back["v1"].refers_to == warc._urn("r2")
    assert back["r3"].target_uri == "http://c%20d" and back["v2"].refers_to is None
    for r in index.values():
        with open(f"{path}/{r.file}", "rb") as f:
            f.seek(r.offset)
            assert f.read(r.length)[:2] == b"\x1f\x8b"


def brute_captures(pages):
    """Index rows and whole payloads of the crawls of pages, record by record."""
    import hashlib

    rows, sha = [], lambda b: "sha256:" + hashlib.sha256(b.encode()).hexdigest()
    for p, url, html in pages:
        body, name = html or "", "" if p is None else str(p)
        rows.append((f"{name}/1", "response", url, "2024-01-01T00:00:00Z", sha(body), body))
        if p is not None and p % 5 == 0:
            rows.append((f"{name}/2", "response", url, "2024-02-01T00:00:00Z", sha(body + "\n<!-- changed -->"), body + "\n<!-- changed -->"))
        else:
            rows.append((f"{name}/2", "revisit", url, "2024-02-01T00:00:00Z", sha(f"lost {name}") if p is not None and p % 7 == 0 else sha(body), None))
        if p is not None and p % 3 == 0:
            rows.append((f"{name}/1", "response", url, "2024-03-01T00:00:00Z", sha(body), body))
    first = {}
    for r in sorted((r for r in rows if r[1] == "response"), key=lambda r: (r[3], r[0], r[2] or "")):
        first.setdefault(r[4], r)
    index = Counter()
    for r in rows:
        own = first.get(r[4])
        status = ("original" if r is own else "duplicate") if r[1] == "response" else "resolved" if own else "unresolved"
        index[r[0], "response" if status == "original" else "revisit", status, r[2], r[3], r[4], None if status in ("original", "unresolved") else own[0]] += 1
    return index, Counter(r[5].encode() for r in first.values())


@pytest.mark.parametrize("hot,mistaken", [(common.HOT_ROWS, warc.MOST_MISTAKEN), (2, 10)])
def test_warc_against_brute_force(spark, tmp_path, monkeypatch, hot, mistaken):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    monkeypatch.setattr(warc, "MOST_MISTAKEN", mistaken)
    if mistaken < 100:  # a filter that takes many originals for duplicates at first
        monkeypatch.setattr(warc, "BITS_PER_KEY", 1)
    rng = random.Random(13)
    pages = [(i, f"http://u{i}", rng.choice(["same", "", None, f"own {i}", f"pair {i // 2}", "long " * 20000])) for i in range(1, 160)] + [(None, None, None), (None, None, "same")]
    path = str(tmp_path / "a")
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    index = warc.write_deduplicated(warc.captures_of_pages(df).repartition(5), path)
    want, payloads = brute_captures(pages)
    assert Counter((r.record_id, r.warc_type, r.status, r.target_uri, r.warc_date, r.payload_digest, r.refers_to) for r in index.collect()) == want
    back = warc.read_archive(spark, glob.glob(path + "/*.gz")).collect()
    assert Counter(bytes(r.payload) for r in back if r.warc_type == "response") == payloads
    assert warc.write_deduplicated(warc.captures_of_pages(df.limit(0)), str(tmp_path / "c")).count() == 0


def test_warc_plan_moves_no_payload(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(i, f"u{i}", f"b{i % 9}") for i in range(60)], "page_id long, url string, html string")
    plans = []
    real = type(pages).mapInArrow

    def spy(df, f, schema, *more):
        if "payload" in df.columns:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, f, schema, *more)

    monkeypatch.setattr(type(pages), "mapInArrow", spy)
    pages.write.parquet(str(tmp_path / "p"))
    warc.write_deduplicated(warc.captures_of_pages(spark.read.parquet(str(tmp_path / "p"))), str(tmp_path / "w"))
    assert len(plans) == 1
    # What an exchange of the written rows shuffles, or sends to all, are headers.
    lines = plans[0].split("\n")
    moved = [lines[k:] for k, line in enumerate(lines) if "Exchange" in line]
    assert moved and not any("payload#" in block[0] or "html#" in block[1] for block in moved)


def test_warc_decides_each_row(spark, tmp_path):
    one, two, three = bytearray(b"one"), bytearray(b"two"), bytearray(b"three")
    rows = [
        # Null ids with different digests; the second is a duplicate of a named record.
        (None, "response", "u1", "2024-01-02", "d1", None, one), (None, "response", "u2", "2024-01-03", "d2", None, two), ("b", "response", "u2", "2024-01-01", "d2", None, two), (None, "revisit", "u1", "2024-02-01", "d1", None, None),
        # One id with two digests: one a duplicate, the other's payload is nowhere else.
        ("s", "response", "u3", "2024-01-04", "d2", None, two), ("s", "response", "u4", "2024-01-05", "d3", None, three), ("v", "revisit", "u4", "2024-02-01", "d3", None, None), ("t", "response", "u5", "2024-01-06", "d3", None, three),
        # A repeated original, a null digest, an original and a revisit of one id, other types of a known digest.
        ("p", "response", "u6", "2024-01-01", "d4", None, None), ("p", "response", "u6", "2024-01-01", "d4", None, bytearray(b"four")), ("p", "response", "u6", "2024-01-01", "d4", None, bytearray(b"four")), (None, "response", None, None, None, None, one),
        ("p", "revisit", "u6", "2024-01-01", "d4", None, None), ("p", "metadata", "u6", "2024-01-01", "d4", None, two), ("p", None, "u6", "2024-01-01", "d4", None, two),
    ]
    want = Counter([
        (None, "u1", "response", "original", None), (None, "u2", "revisit", "duplicate", "b"), ("b", "u2", "response", "original", None), (None, "u1", "revisit", "resolved", None),
        ("s", "u3", "revisit", "duplicate", "b"), ("s", "u4", "response", "original", None), ("v", "u4", "revisit", "resolved", "s"), ("t", "u5", "revisit", "duplicate", "s"),
        ("p", "u6", "response", "original", None), ("p", "u6", "revisit", "duplicate", "p"), ("p", "u6", "revisit", "duplicate", "p"), (None, None, "response", "original", None),
        ("p", "u6", "revisit", "resolved", "p"), ("p", "u6", "metadata", "other", None), ("p", "u6", "resource", "other", None),
    ])
    for hot in (common.HOT_ROWS, 1):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(common, "HOT_ROWS", hot)
            path = str(tmp_path / f"out{hot}")
            index = warc.write_deduplicated(records(spark, rows).withColumn("http_headers", F.lit("HTTP/1.1 200 OK\r\n\r\n")).repartition(3), path).collect()
        assert Counter((r.record_id, r.target_uri, r.warc_type, r.status, r.refers_to) for r in index) == want
        back = warc.read_archive(spark, glob.glob(path + "/*.gz")).collect()
        assert Counter(bytes(r.payload) for r in back if r.warc_type == "response") == Counter([b"one", b"one", b"two", b"three", b"four"])
        # A revisit of a record without an id points at the id that this record was given.
        made = {r.target_uri: r.record_id for r in back if r.warc_type == "response" and r.record_id.startswith("<urn")}
        assert len(set(made.values())) == 2 and [r.refers_to for r in back if r.warc_type == "revisit" and r.target_uri == "u1"] == [made["u1"]]


def test_warc_headers(spark):
    text = lambda *a: warc._record(*a)[0].decode()
    for kind, want in (("response", "application/http; msgtype=response"), ("request", "application/http; msgtype=request"), ("warcinfo", "application/warc-fields"), ("metadata", "application/warc-fields"), ("resource", "application/octet-stream")):
        assert f"Content-Type: {want}\r\n" in text("a", kind, "u", "d", "x", False, None, None, None, None, b"p")
    revisit = text("a", "revisit", "u", None, "x", True, "o", None, None, None, None)
    assert "WARC-Refers-To: " in revisit and "Refers-To-Date" not in revisit and "None" not in revisit and "WARC-Date: 1970-01-01T00:00:00Z" in revisit


# 2 Exact dedup.


@pytest.mark.parametrize("part_bits", [bloom.PART_BITS, 1 << 10])
def test_exact_dedup(spark, monkeypatch, part_bits):
    monkeypatch.setattr(bloom, "PART_BITS", part_bits)
    rng = random.Random(2)
    texts = [sentence(rng, 5) for _ in range(400)]
    rows = [(i, rng.choice(texts) if i % 3 else f"only {i}", "s") for i in range(900)] + [(5000, None, "s"), (5001, None, "s"), (5002, "", "s"), (5003, "", "s")]
    first = {}
    for i, t, _ in rows:
        if t is not None:
            first.setdefault(t, i)
    got = exact_dedup.distinct_texts(docs(spark, rows).repartition(7))
    assert sorted(r.doc_id for r in got.collect()) == sorted([*first.values(), 5000, 5001])
    assert got.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")


def test_exact_dedup_awkward(spark):
    df = awkward(spark)
    got = exact_dedup.distinct_texts(df).collect()
    assert Counter(r.doc_id for r in got) == Counter([1, None, 2, 3, 4, 5, 6, 8, None])
    assert got[0].asDict().keys() == set(df.columns)
    assert exact_dedup.distinct_texts(empty(spark)).count() == 0


def test_bloom_filters_miss_nothing(spark):
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    b = bloom.Bloom(bloom.bits_for(10000, 12), 3)
    assert b.seen(h).sum() < 100 and b.seen(h).all()
    assert bloom.Bloom(1 << 16, 3).seen(np.array([7, 7, 8], np.uint64)).tolist() == [False, True, False]
    # A filter of one part, of several parts, and of none.
    repeated = spark.createDataFrame([(int(x),) for x in h.view(np.int64)], "h long")
    for part_bits in (bloom.PART_BITS, 1 << 12):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(bloom, "PART_BITS", part_bits)
            made = bloom.write(repeated.repartition(3), 5000)
        assert (made.parts > 4) == (part_bits < 1 << 20)
        assert repeated.where(made.probe(F.col("h"))).count() == 5000
        assert spark.range(5000).select(F.xxhash64("id").alias("h")).where(made.probe(F.col("h"))).count() < 150
    none = bloom.write(repeated.limit(0), 0)
    assert repeated.where(none.probe(F.col("h"))).count() == 0


def test_hot_text_is_cut_before_the_shuffle(spark):
    rows = [(i, "the same words" if i % 2 else f"own {i}", "s") for i in range(3000)]
    df = docs(spark, rows).repartition(4)
    got = exact_dedup.distinct_texts(df)
    assert got.count() == 1501
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Exchange hashpartitioning" in plan[plan.index("WindowGroupLimit") : plan.rindex("WindowGroupLimit")]
    # Of a hash that fills a batch two go on to the shards.
    h = spark.range(20000).select(F.lit(5).cast("long").alias("h")).coalesce(1)
    shuffled = exact_dedup.possibly_repeated(h, 3)
    assert [r.h for r in shuffled.collect()] == [5]


# 3 Mixing.


def brute_mix(rows, weights=None, percent=100, tokens=lambda t: len(re.findall(r"[^ \t\r\n]+", t))):
    import hashlib

    d = [(i, s, tokens(t or ""), int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)) for i, t, s in rows]
    total = sum(x[2] for x in d)
    sources = {x[1] for x in d}
    w = {s: 1 for s in sources} if weights is None else {s: weights.get(s, 0) for s in sources}
    out = []
    for s in sources:
        own = [x for x in d if x[1] == s]
        for i, _, n, p in own:
            upto = sum(x[2] for x in own if x[3] <= p)
            level = next((k + 1 for k, share in enumerate(mixing.SHARES) if upto <= total * w[s] * percent * share // (10000 * sum(w.values()))), None)
            if level:
                out.append((i, s, n, level))
    return Counter(out)


@pytest.mark.parametrize("weights,percent", [(None, 100), ({"a": 5, "b": 1}, 60), ({"a": 1, "b": 0, "c": 3}, 30)])
def test_mixing_matches_brute_force(spark, weights, percent):
    rng = random.Random(3)
    rows = [(i, sentence(rng, rng.randrange(1, 60)), rng.choice("aaaaab") if i % 10 else "c") for i in range(500)] + [(7, "again and again", "a"), (None, "x y", "a"), (None, None, "b"), (900, "only", None)]
    w = None if weights is None else spark.createDataFrame(list(weights.items()), "source string, weight long")
    df = docs(spark, rows)
    for count, tokens in ((mixing.n_words, lambda t: len(t.split())), (mixing.n_tokens, lambda t: len(bpe.load().encoding.encode_ordinary(t)))):
        got = Counter(tuple(r) for r in mixing.mixed(df, w, percent, count).collect())
        assert got == brute_mix(rows, weights, percent, tokens)
    kept = mixing.keep_mixed(df.withColumn("place", F.lit(1)).withColumn("t1", F.lit(2)), w, percent)
    assert Counter((r.doc_id, r.source) for r in kept.collect()) == Counter((i, s) for i, s, _, _ in got.elements())


def test_mixing_caps_a_hot_source(spark):
    # Half of all tokens in one source of 21: the largest level caps it, and the target share isn't reached.
    rows = [(i, "x", "hot") for i in range(420)] + [(1000 + i, "x", f"s{i % 20}") for i in range(420)]
    got = mixing.mixed(docs(spark, rows), tokens=mixing.n_words).groupBy("source").agg(F.sum("tokens").alias("n"), F.sum(F.when(F.col("level") == 1, F.col("tokens"))).alias("low")).collect()
    share = {r.source: r.n / sum(x.n for x in got) for r in got}
    assert len(share) == 21 and round(share.pop("hot"), 3) == 0.087 and {round(v, 3) for v in share.values()} == {0.046}
    # Every source fills its part of the 25 % level, so the weights are met there.
    assert {r.low for r in got} == {10}


def test_mixing_awkward(spark):
    df = awkward(spark)
    assert mixing.keep_mixed(df).columns == df.columns
    assert mixing.mixed(df).count() >= 1
    assert mixing.mixed(empty(spark)).count() == 0 and mixing.keep_mixed(empty(spark)).count() == 0


# 4 Near duplicates.


def near_fixture():
    rng = random.Random(4)
    rows, i = [], 0
    for g in range(30):
        base = sentence(rng, rng.randrange(20, 200)).split()
        for _ in range(rng.choice([1, 1, 2, 3, 8])):
            edited = [w if rng.random() > rng.choice([0, 0.03, 0.08, 0.2]) else rng.choice(WORDS) for w in base]
            rows.append((i, " ".join(edited), "s"))
            i += 1
    rows += [(1000 + k, sentence(rng, 3), "s") for k in range(20)]
    return rows


def brute_groups(rows):
    sig = {}
    for i, t, _ in rows:
        have, s = minhash.signatures(*raw(pa.array([t])))
        if len(have):
            sig[i] = s[0]
    parent = {i: i for i in sig}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sig), 2):
        if (sig[a] != sig[b]).sum() <= minhash.DISTANCE:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in sig if Counter(map(find, sig))[find(i)] > 1}


@pytest.mark.parametrize("block,hot", [(minhash.BLOCK, common.HOT_ROWS), (3, 2)])
def test_near_groups_are_those_of_all_pairs(spark, monkeypatch, block, hot):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rows = near_fixture()
    got = {r.doc_id: r.group_id for r in minhash.near_groups(docs(spark, rows)).collect()}
    assert got == brute_groups(rows)
    kept = {r.doc_id for r in minhash.drop_near_duplicates(docs(spark, rows)).collect()}
    assert kept == {i for i, _, _ in rows} - {i for i, g in got.items() if i != g}


def test_index_guarantee():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**16, (400, minhash.HASHES), dtype=np.uint16)
    b = a.copy()
    for row in b:
        at = rng.choice(minhash.HASHES, minhash.DISTANCE, replace=False)
        row[at] ^= rng.integers(1, 2**16, minhash.DISTANCE, dtype=np.uint16)
    ka, kb = minhash.index_keys(a), minhash.index_keys(b)
    assert all(set(x) & set(y) for x, y in zip(ka.tolist(), kb.tolist()))
    other = minhash.index_keys(rng.integers(0, 2**16, (400, minhash.HASHES), dtype=np.uint16))
    assert not set(ka.ravel().tolist()) & set(other.ravel().tolist())


def test_buckets_with_a_far_centre(spark):
    # a and b are near each other, the bucket's smallest member c is near neither, so only the second round finds the pair.
    sig = np.zeros((3, minhash.HASHES), np.uint16)
    sig[1, 5:20] = 1
    sig[2, 5:20] = 1
    sig[2, 20:25] = 2
    rows = spark.createDataFrame([(1, i, i, bytearray(s.tobytes())) for i, s in enumerate(sig)], "key long, id long, label long, sig binary")
    assert [tuple(r) for r in minhash._crossing(rows.coalesce(1)).collect()] == [(1, 2)]


def test_signatures_agree_as_often_as_word_pairs_are_shared():
    # Against exact Jaccard similarities: the share of equal hashes is binomial around them.
    rng = random.Random(15)
    for swap in (0.0, 0.02, 0.1, 0.3, 1.0):
        off = []
        for _ in range(60):
            a = sentence(rng, 150).split()
            b = [w if rng.random() > swap else rng.choice(WORDS) + "x" for w in a]
            pairs = [set(zip(x, x[1:])) for x in (a, b)]
            jaccard = len(pairs[0] & pairs[1]) / len(pairs[0] | pairs[1])
            _, sig = minhash.signatures(*raw(pa.array([" ".join(a), " ".join(b)])))
            off.append((sig[0] == sig[1]).mean() - jaccard)
        assert abs(np.mean(off)) < 3 * 0.5 / np.sqrt(60 * minhash.HASHES) and np.std(off) < 0.12


def test_near_groups_of_other_ids_and_scripts(spark):
    rng = random.Random(16)
    a = sentence(rng, 80)
    zh = "".join(chr(0x4E00 + rng.randrange(800)) for _ in range(300))
    th = "".join(chr(0x0E01 + rng.randrange(40)) for _ in range(300))
    rows = [("x1", a), ("x2", a + " end"), ("z1", "序言" + zh), ("z2", zh + "。完"), ("t1", th), ("t2", th[:-3]), ("u", "".join(chr(0x4E00 + rng.randrange(800)) for _ in range(300)))]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert {r.doc_id: r.group_id for r in minhash.near_groups(df).collect()} == {"x1": "x1", "x2": "x1", "z1": "z1", "z2": "z1", "t1": "t1", "t2": "t1"}
    assert {r.doc_id for r in minhash.drop_near_rows(df).collect()} == {"x1", "z1", "t1", "u"}


def test_a_hot_group_stays_behind(spark):
    # Half of all rows are near copies of one text: a bucket has one row for each batch, and one group comes out.
    rng = random.Random(17)
    base = sentence(rng, 60).split()
    rows = [(i, " ".join(base + [str(i)]) if i % 2 else sentence(rng, 30), "s") for i in range(3000)]
    df = docs(spark, rows).repartition(4)
    got = {r.doc_id: r.group_id for r in minhash.near_groups(df).collect()}
    assert got == {i: 1 for i in range(1, 3000, 2)}
    nodes = minhash._nodes(minhash.signature_table(df)).select("id", "sig")
    most = minhash._centers(nodes).groupBy("key").count().agg(F.max("count")).head()[0]
    assert most <= nodes.rdd.getNumPartitions()


def test_near_awkward(spark):
    df = awkward(spark)
    got = {r.doc_id: r.group_id for r in minhash.near_groups(df).collect()}
    assert got == {4: 4, 5: 4, 6: 6, 7: 6}
    kept = minhash.drop_near_duplicates(df)
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, None, 2, 3, 4, 6, 6, 8, None]) and kept.columns == df.columns
    assert minhash.near_pairs(empty(spark)).count() == 0 and minhash.drop_near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("small", [common.SMALL_IDS, -1])
def test_near_rows(spark, monkeypatch, small):
    monkeypatch.setattr(common, "SMALL_IDS", small)
    monkeypatch.setattr(common, "HOT_ROWS", common.HOT_ROWS if small > 0 else 2)
    rng = random.Random(12)
    a, b, c, d = (sentence(rng, 60) for _ in range(4))
    # Copies under null ids, a repeated row, one id with two texts, a null id alone, and what has no words.
    rows = [(5, a, "s"), (None, a, "s"), (None, a + " end", "s"), (6, b, "s"), (6, b, "s"), (6, c, "s"), (7, c, "s"), (None, d, "t"), (None, d, "s"), (8, None, "s"), (8, None, "s"), (None, "", "s"), (None, None, "s")]
    kept = minhash.drop_near_rows(docs(spark, rows).withColumn("of", F.lit(1)).withColumn("id", F.lit(2)))
    assert Counter((r.doc_id, r.text, r.source) for r in kept.collect()) == Counter([(5, a, "s"), (6, b, "s"), (6, c, "s"), (None, d, "s"), (8, None, "s"), (8, None, "s"), (None, "", "s"), (None, None, "s")])
    rows = near_fixture()
    got = brute_groups(rows)
    assert sorted(r.doc_id for r in minhash.drop_near_rows(docs(spark, rows)).collect()) == sorted(i for i, *_ in rows if got.get(i, i) == i)
    assert minhash.drop_near_rows(awkward(spark)).columns == awkward(spark).columns and minhash.drop_near_rows(empty(spark)).count() == 0


# 5 URL filter.


@pytest.mark.parametrize("shard", [url_filter.SHARD_ENTRIES, 500])
def test_digest_list(spark, tmp_path, monkeypatch, shard):
    monkeypatch.setattr(url_filter, "SHARD_ENTRIES", shard)
    rng = random.Random(6)
    entries = [f"host{i}.example.com/p{rng.randrange(10**6)}" for i in range(3000)]
    path = str(tmp_path / "list")
    url_filter.build_list(spark.createDataFrame([(e,) for e in entries + entries[:50] + [None, ""]], "entry string"), path)
    d = url_filter.DigestList(path)
    parts = [d.shard(k) for k in range(1 << d.bits)]
    assert (len(parts) > 4) == (shard < 3000)
    keys = np.concatenate([p[0] for p in parts])
    assert len(keys) == 3000 and (np.diff(keys.astype(object)) > 0).all()
    import xxhash

    probes = entries[::7] + ["nowhere", "host1.example.com"]
    keys = np.array([xxhash.xxh64(p.encode(), seed=42).intdigest() for p in probes], np.uint64)
    assert d.has(keys, pa.array(probes)).tolist() == [True] * (len(probes) - 2) + [False, False]
    # Equal digests with other strings.
    at = next(k for k, p in enumerate(parts) if entries[5].encode() in p[2].tobytes())
    d.bits, d.shards = 0, {0: (np.full(len(parts[at][0]), 9, np.uint64), *parts[at][1:])}
    assert d.has(np.array([9, 9], np.uint64), pa.array([entries[5], "other"])).tolist() == [True, False]


def test_filter_urls(spark, tmp_path):
    path = str(tmp_path / "l")
    url_filter.build_list(spark.createDataFrame([("a.com/x?y=1",), ("bad.org",), ("shop.big.net",)], "entry string"), path)
    cases = [("https://www.A.com/x?utm_source=q&y=1#top", "a.com/x?y=1"), ("http://a.com/x", None), ("http://bad.org:80/any/", "bad.org"), ("https://u@sub.deep.bad.org/z", "bad.org"), ("http://m.shop.big.net", "shop.big.net"), ("http://big.net/", None), (None, None), ("", None), ("notaurl", None), ("http://a.com/" + "y" * 200_000, None), ("http://bad.org/" + "z/" * 100_000, "bad.org")]
    df = spark.createDataFrame([(u, "key") for u, _ in cases * 2], "url string, key string")
    got = url_filter.filter_urls(df, path)
    assert Counter((r.url, r.blocked_by) for r in got.collect()) == Counter(cases * 2)
    assert url_filter.filter_urls(df.limit(0), path).count() == 0
    none = str(tmp_path / "none")
    url_filter.build_list(spark.createDataFrame([], "entry string"), none)
    assert url_filter.filter_urls(df, none).where("blocked_by IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        url_filter.filter_urls(df.withColumn("blocked_by", F.lit(1)), path)


# 6 Quality.


def test_quality_held_out(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(600):
        t = sentence(rng, rng.randrange(20, 200)) + "."
        bad = i % 5 == 0
        if bad:
            t = rng.choice([t.upper().replace(" ", "!! "), t.replace(" ", "$$$ "), " ".join([t.split()[0]] * 60)])
        rows.append((i, t, "s"))
        if i < 300:
            labels.append((i, 0 if bad else 1))
    got = {r.doc_id: r.keep for r in quality.classify(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    wrong = [i for i in range(300, 600) if got[i] != (i % 5 != 0)]
    assert len(got) == 600 and len(wrong) <= 6


def plain_statistics(text):
    """The document statistics in plain Python, of a text in ASCII and Latin letters."""
    import math

    ws = brute_words(text)
    data, n, some = text.encode(), len(ws), max(len(ws), 1)
    size = max(len(data), 1)
    letter = [c for c in data if chr(c).isascii() and chr(c).isalpha() or c >= 128]
    symbols = [not (c >= 128 or chr(c).isalnum() or chr(c) in ".,;:?'\"-() \t\n\v\f\r") for c in data]
    spans = [m.span() for m in re.finditer(r"[^\W_]+", text)]
    spans = [(len(text[:a].encode()), len(text[:b].encode())) for a, b in spans]
    low = [text.encode()[a:b].decode().lower() for a, b in spans]
    assert low == ws
    seen, seen2, again, again2 = Counter(low), Counter(zip(low, low[1:])), 0, 0
    again, again2 = sum(v - 1 for v in seen.values()), sum(v - 1 for v in seen2.values())
    lines = [tuple(brute_words(x)) for x in text.split("\n") if brute_words(x)]
    root = math.sqrt
    return [
        math.log1p(n), math.log1p(sum(b - a for a, b in spans) / some), root(sum(c in range(65, 91) for c in data) / max(len(letter), 1)), root(sum(c in range(48, 58) for c in data) / size), root(sum(symbols) / size),
        root(sum(chr(c) in ".,;:?'\"-()" for c in data) / size), root(sum(b < len(data) and symbols[b] for _, b in spans) / some), math.log1p(n / (text.count("\n") + 1)), root(again / some), root(again2 / some),
        root(sum(v - 1 for v in Counter(lines).values()) / max(len(lines), 1)), root(max(seen.values(), default=0) / some), root(sum(b - a > 20 for a, b in spans) / some), root(sum(x and y for x, y in zip(symbols, symbols[1:])) / size),
    ]


def test_statistics_are_the_plain_ones():
    rng = random.Random(18)
    texts = ["", "One two\nONE two\n\nx", "$$$ !!! a$ b%% 12 34", "größe été Größe.", "word " * 30, "a" * 25 + " b"]
    texts += ["".join(rng.choice(["Word ", "word ", "12 ", "$", "#!", ".\n", "\n", "é", "x" * 22, ", "]) for _ in range(rng.randrange(60))) for _ in range(100)]
    got = quality.statistics(*raw(pa.array(texts)))
    for t, x in zip(texts, got):
        assert np.allclose(x, plain_statistics(t)), repr(t)


def test_shrunken_covariances_and_their_factors():
    rng = np.random.default_rng(4)
    x = [rng.normal(0, 1, (150, 4)) @ rng.normal(0, 1, (4, 4)), rng.normal(2, 3, (80, 4))]
    m = quality.model_of(np.array([150.0, 80.0]), np.stack([v.sum(0) for v in x]), np.stack([v.T @ v for v in x]), 0.2, 0.05)
    cov = [np.array([[np.mean((v[:, a] - v[:, a].mean()) * (v[:, b] - v[:, b].mean())) for b in range(4)] for a in range(4)]) for v in x]
    pooled = (150 * cov[0] + 80 * cov[1]) / 230
    y, want = rng.normal(1, 2, (20, 4)), np.zeros((2, 20))
    for k in (0, 1):
        c = 0.8 * cov[k] + 0.2 * pooled
        c = 0.95 * c + 0.05 * np.diag(np.diag(pooled))
        assert np.allclose(np.linalg.inv(m.factor[k]) @ np.linalg.inv(m.factor[k]).T, c)
        d = y - x[k].mean(0)
        want[k] = np.log([150 / 230, 80 / 230][k]) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.array([v @ np.linalg.inv(c) @ v for v in d])
    assert np.allclose(m.low_odds(y), want[0] - want[1])


def test_labels_are_bounded(spark, monkeypatch):
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(None, 1), (200, 7)], "doc_id long, quality int")
    assert quality.known_labels(labels).count() == 100
    monkeypatch.setattr(quality, "MOST_LABELS", 40)
    one, two = (sorted(map(tuple, quality.known_labels(labels.repartition(n)).collect())) for n in (1, 5))
    assert one == two and len(one) == 40


def test_quality_density_is_the_gaussian():
    rng = np.random.default_rng(3)
    x0, x1 = rng.normal(0, 1, (200, 3)), rng.normal(1, 2, (300, 3))
    m = quality.model_of(np.array([200.0, 300.0]), np.stack([x0.sum(0), x1.sum(0)]), np.stack([x0.T @ x0, x1.T @ x1]), 0, 0)
    y = rng.normal(0, 2, (10, 3))

    def log_density(x, own, prior):
        d, cov = x - own.mean(0), np.cov(own.T, bias=True)
        return np.log(prior) - 0.5 * np.log(np.linalg.det(cov)) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)

    assert np.allclose(m.low_odds(y), log_density(y, x0, 0.4) - log_density(y, x1, 0.6))


def test_quality_awkward(spark):
    df = awkward(spark)
    labels = spark.createDataFrame([(4, 1), (8, 0), (8, 0), (None, 1), (2, None), (5, 7)], "doc_id long, quality int")
    got = quality.classify(df, labels).collect()
    assert len(got) == df.count() and all(not r.keep for r in got if r.doc_id in (1, 2, 3))
    assert quality.keep_good(df, labels).columns == df.columns
    none = labels.limit(0)
    assert Counter(r.doc_id for r in quality.keep_good(df, none).collect()) == Counter([None, 4, 5, 6, 6, 7, 8])
    assert quality.classify(df, labels.where("quality = 1")).where("keep").count() == 7
    assert quality.classify(empty(spark), labels).count() == 0 and quality.keep_good(empty(spark), none).count() == 0


# 7 Chat.


def test_chat(spark):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(["hi", "größer", "x\ny", "", None])) for c in range(20) for t in range(rng.randrange(1, 9))]
    rows += [(50, 1, "assistant", "first"), (50, 1, "assistant", "first"), (50, 1, None, "who"), (None, 1, "assistant", "lost"), (51, None, "assistant", "lost")]
    key = lambda r: (r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    want = Counter()
    for c in {r[0] for r in rows if r[0] is not None}:
        turns = sorted((r for r in rows if r[0] == c and r[1] is not None), key=key)
        for k, (_, t, role, text) in enumerate(turns):
            if role == "assistant" and text:
                prompt = "".join(f"<|{r[2] or 'unknown'}|>\n{r[3] or ''}\n" for r in turns[:k]) + "<|assistant|>\n"
                want[(c, t, k, prompt, text + "\n", len(prompt), len(prompt) + len(text) + 1)] += 1
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("all", F.lit(1)).withColumn("shown", F.lit(2))
    assert Counter(tuple(r) for r in chat.prefix_examples(df).collect()) == want
    assert chat.prefix_examples(df.limit(0)).count() == 0


def test_a_long_conversation(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"turn {k} " + "x" * (300_000 if k == 4 else 20)) for k in range(400)]
    got = {r.turn: r for r in chat.prefix_examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == 200
    shown = "".join(f"<|{r}|>\n{t}\n" for _, _, r, t in rows[:399])
    assert got[399].prompt == shown + "<|assistant|>\n" and got[399].completion == rows[399][3] + "\n" and got[399].train_end - got[399].train_start == len(rows[399][3]) + 1


# 8 Decontamination.


def naive_tiles(item, doc, least):
    """Greedy string tiling as first published: all longest matches in each round."""
    used_i, used_d, out = set(), set(), []
    while True:
        best, found = least, []
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and i + k not in used_i and j + k not in used_d:
                    k += 1
                if k > best:
                    best, found = k, []
                if k >= least and k == best:
                    found.append((i, j))
        if not found:
            return out
        for i, j in found:
            if not any(x in used_i for x in range(i, i + best)) and not any(x in used_d for x in range(j, j + best)):
                out.append((i, j, best))
                used_i.update(range(i, i + best))
                used_d.update(range(j, j + best))


def test_tiles_are_the_naive_ones():
    rng = random.Random(9)
    for _ in range(150):
        item = [rng.randrange(5) for _ in range(rng.randrange(1, 25))]
        doc = [rng.randrange(5) for _ in range(rng.randrange(1, 40))]
        to = lambda v: np.array(v, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
        for least in (1, 2, 3):
            assert sorted(decontam.tiles(to(item), to(doc), least)) == sorted(naive_tiles(item, doc, least))


def test_tiles_of_repeated_words():
    to = lambda v: np.array(v, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    for item, doc in (([1] * 9, [1] * 30), ([1, 2] * 6, [2, 1] * 15), ([1] * 5 + [2] * 5, [2] * 20 + [1] * 3), ([1, 1, 2] * 5, [1] * 40 + [2, 1, 1] * 4)):
        for least in (1, 2, 4):
            assert sorted(decontam.tiles(to(item), to(doc), least)) == sorted(naive_tiles(item, doc, least))
    began = time.perf_counter()
    assert decontam.tiles(to([1] * 1000), to([1] * 1_000_000), 4) == [(0, 0, 1000)]
    assert decontam.tiles(to([1, 2, 3] * 300), to([3, 1, 2] * 300_000), 4) == [(0, 1, 900)]
    assert time.perf_counter() - began < 20
    mark = decontam.Benchmark(["x"], ["one " * 1000], 4, 0.5)
    h, first, _, _ = words(*raw(pa.array(["One, " * 1_000_000])))
    assert list(mark.scan(h, first)) == [(0, 0, 1, 1000, 1000)]
    assert time.perf_counter() - began < 40


@pytest.mark.parametrize("small", [decontam.SMALL_CHARS, -1])
def test_contamination_in_all_scripts(spark, small):
    items = {1: "机器学习是人工智能的一个重要分支。它研究如何让计算机从数据中学习。", 2: "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。", 3: "ประเทศไทยเป็นประเทศที่ตั้งอยู่ในเอเชียตะวันออกเฉียงใต้", 4: "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему", 5: "¿Dónde está la biblioteca municipal? «Está detrás del ayuntamiento»"}
    rows = [(10, "前言" + items[1] + "后记", "s"), (11, "昨日" + items[2], "s"), (12, "วันนี้" + items[3] + "ครับ", "s"), (13, "ВОТ: " + items[4].upper() + "!", "s"), (14, "dónde ESTÁ la biblioteca municipal, está detrás del ayuntamiento", "s"), (20, "今天天气很好，我们去公园散步吧。", "s"), (21, "Это совсем другой текст о погоде и о природе родного края", "s"), (22, "今日は天気がいいので散歩に行きましょう。", "s")]
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = decontam.contamination(docs(spark, rows), bench, small_chars=small).collect()
    want = {(i, k) for i, t, _ in rows for k, b in items.items() if sum(x[2] for x in naive_tiles(brute_words(b), brute_words(t), 4)) >= 0.5 * len(brute_words(b))}
    assert {(r.doc_id, r.item_id) for r in got} == want == {(10, 1), (11, 2), (12, 3), (13, 4), (14, 5)}


def test_running_hashes_depend_on_the_words_alone():
    h, first, _, _ = words(*raw(pa.array(["a b c d e", "x b c d y", "b c"])))
    g, whole = grams(h, first, 3)
    assert g[1] == g[6] and len(set(g[whole].tolist())) == whole.sum() - 1 and whole.sum() == 6


def leak_fixture():
    rng = random.Random(10)
    items = [(k, sentence(rng, rng.randrange(12, 40))) for k in range(12)] + [(90, "tiny item"), (91, None), (None, "x"), (92, "...")]
    rows = []
    for i in range(60):
        text = sentence(rng, rng.randrange(5, 80)).split()
        if i % 4 == 0:
            own = items[i % 12][1].split()
            cut = len(own) // 2
            own = own[cut:] + ["between"] + own[:cut] if i % 8 == 0 else own[: cut + 1]
            text[3:3] = [w.upper() + "," for w in own]
        rows.append((i, " ".join(text), "s"))
    return rows + [(100, "here is a Tiny, item.", "s"), (101, None, "s"), (None, items[0][1], "s"), (102, "", "s")], items


@pytest.mark.parametrize("small", [decontam.SMALL_CHARS, -1])
def test_contamination(spark, small):
    rows, items = leak_fixture()
    tok = lambda t: re.findall(r"[0-9a-z]+", t.lower())
    want = set()
    for i, t, _ in rows:
        for k, b in items:
            if i is not None and k is not None and t and b and tok(b):
                c = sum(x[2] for x in naive_tiles(tok(b), tok(t), min(decontam.TILE, len(tok(b)))))
                if c and c >= decontam.COVERAGE * len(tok(b)):
                    want.add((i, k, c, len(tok(b))))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    df = docs(spark, rows + rows[:3]).withColumn("item_id", F.lit(1))
    got = decontam.contamination(df, bench, small_chars=small)
    assert {(r.doc_id, r.item_id, r.covered, r.n_words) for r in got.collect()} == want and got.count() == len(want) >= 15
    kept = decontam.drop_contaminated(df, bench, small_chars=small)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, *_ in rows + rows[:3] if i not in {w[0] for w in want})


def test_contamination_awkward(spark):
    df, bench = awkward(spark), spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert {r.doc_id for r in decontam.contamination(df, bench).collect()} == {6, 7}
    assert decontam.drop_contaminated(df, bench).columns == df.columns
    assert decontam.contamination(df, bench.limit(0)).count() == 0 and decontam.contamination(empty(spark), bench).count() == 0


@pytest.mark.parametrize("small", [decontam.SMALL_CHARS, -1])
def test_contaminated_rows(spark, small):
    item = "the quick brown fox jumps over the lazy dog tonight"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, "so " + item, "s"), (None, "clean text", "s"), (3, item.upper(), "s"), (3, "another clean text", "s"), (4, None, "s"), (None, None, "s"), (None, "so " + item, "s")]
    kept = decontam.drop_contaminated_rows(docs(spark, rows), bench, small_chars=small)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(None, "clean text"), (3, "another clean text"), (4, None), (None, None)])


# 9 and 10 Tokens.


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_counts(spark, rule):
    texts = ["one two\nthree\n\nfour  \n five", "größe\r\nÉté \n\n\n x", "\n\n\n", "no line end", "", None, "a\n" * 300]
    coder, want = bpe.load(), Counter()
    for d, t in enumerate(texts):
        if not t:
            continue
        data = t.encode()
        starts = [0] + [i + 1 for i, c in enumerate(data[:-1]) if c == 10]
        ends = starts[1:] + [len(data)]
        n, shared, at = Counter(), Counter(), 0
        for token in coder.encoding.encode_ordinary(t):
            size = coder.token_bytes[token]
            over = {k: min(at + size, e) - max(at, s) for k, (s, e) in enumerate(zip(starts, ends)) if min(at + size, e) > max(at, s)}
            pick = min(over) if rule == "start" else max(over) if rule == "end" else min(over, key=lambda k: (-over[k], k))
            n[pick] += 1
            shared[pick] += len(over) > 1
            at += size
        for k, (s, e) in enumerate(zip(starts, ends)):
            want[(d, k, len(data[:s].decode()), len(data[:e].decode()), n[k], shared[k])] += 1
    df = docs(spark, [(d, t, "s") for d, t in enumerate(texts)])
    assert Counter(tuple(r) for r in token_counts.section_counts(df, rule).collect()) == want


def test_section_counts_awkward(spark):
    df = awkward(spark).withColumn("section", F.lit(1))
    got = token_counts.section_counts(df).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"))
    coder = bpe.load()
    assert {r.doc_id: r.n for r in got.collect()} == {k: v * len(coder.encoding.encode_ordinary(t)) for k, v, t in [(None, 1, "some words here"), (3, 1, "   \n\t "), (6, 2, "one"), (7, 1, "one"), (8, 1, "größe ÉTÉ — x")]} | {r.doc_id: r.n for r in got.where("doc_id IN (4, 5)").collect()}
    assert token_counts.section_counts(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        token_counts.section_counts(df, "half")


@pytest.mark.parametrize("encoding,marks", [("dictionary", {"RLE_DICTIONARY", "PLAIN_DICTIONARY"}), ("delta", {"DELTA_BINARY_PACKED"})])
def test_token_table(spark, tmp_path, encoding, marks):
    rng = random.Random(11)
    df = docs(spark, [(i, sentence(rng, 300), f"s{i % 3}") for i in range(400)]).orderBy("doc_id").coalesce(1)
    path = str(tmp_path / "t")
    out = token_output.tokenized_documents(spark, df, path, encoding, row_group_mb=1, page_kb=4, page_rows=50)
    coder = bpe.load()
    assert {r.doc_id: coder.decode(r.tokens) for r in out.collect()} == {r.doc_id: r.text for r in df.collect()}
    meta = pq.ParquetFile(glob.glob(path + "/*.parquet")[0]).metadata
    col = next(meta.row_group(0).column(i) for i in range(meta.row_group(0).num_columns) if meta.row_group(0).column(i).path_in_schema.startswith("tokens."))
    assert marks & set(col.encodings) and (encoding == "dictionary" or not set(col.encodings) & {"RLE_DICTIONARY", "PLAIN_DICTIONARY"})
    assert col.has_offset_index and meta.row_group(0).column(0).has_column_index
    assert token_output.read_metadata(spark, path).columns == ["doc_id", "source", "lang", "n_tokens"]
    plan = token_output.read_tokens(spark, path, "doc_id = 7")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,7)" in plan
    assert token_output.read_tokens(spark, path, "doc_id = 7").count() == 1
    with pytest.raises(ValueError):
        token_output.write_tokens(out, path, encoding="gzip")


def test_token_table_awkward(spark):
    df = awkward(spark)
    out = token_output.tokenized_documents(spark, df)
    assert out.count() == df.count()
    by = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    assert by[1].tokens is None and by[1].n_tokens == 0 and by[2].tokens == [] and by[8].n_tokens == len(by[8].tokens)
    assert token_output.tokenized_documents(spark, empty(spark)).count() == 0


def test_batches_encode_as_single_texts():
    coder = bpe.load()
    texts = ["Hello  world\n\n x", None, "", "naïve 'tis 12,345.6 <|endoftext|>", "  lead"]
    ids, off = coder.encode(pa.array(texts))
    assert [ids[off[i] : off[i + 1]].tolist() for i in range(len(texts))] == [coder.encoding.encode_ordinary(t or "") for t in texts]


def test_long_white_space(monkeypatch):
    coder = bpe.load()
    for run in (" ", "\n", " \n\t\u3000"):
        text = "a" + run * (5_000_000 // len(run)) + "x"
        ids = coder.ids(text)
        assert coder.decode(ids) == text and ids[0] == coder.ids("a")[0] and ids[-1] in (coder.ids("x")[0], coder.ids(" x")[0])
    # The same cuts on runs that the plain encoder can do.
    monkeypatch.setattr(bpe, "LONG_RUN", 1)
    monkeypatch.setattr(bpe, "_RUN", re.compile(bpe._RUN.pattern.replace("50000", "2")))
    rng = random.Random(14)
    for _ in range(3000):
        text = "".join(rng.choice([" ", "\n", "\t", "\x85", "\u3000", "\x1c", "\u200b", "a", "b1", "!", "'s", "中", "é"]) * rng.choice([1, 1, 1, 2, 5]) for _ in range(rng.randrange(1, 12)))
        assert coder.ids(text) == coder.encoding.encode_ordinary(text), repr(text)


def test_tokens_of_long_white_space(spark):
    df = docs(spark, [(1, "a" + " " * 1_000_000 + "x", "s"), (2, "b" + "\n" * 1_000_000 + "y\n", "s")])
    out = {r.doc_id: r.n_tokens for r in token_output.tokenized_documents(spark, df).collect()}
    assert out == {1: 1_000_001, 2: 500_004}
    by = {r.doc_id: r.n for r in token_counts.section_counts(df).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert by == out


# Shared folder.


def test_shared_folder_is_the_sessions(tmp_path):
    class Session:
        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:
            get = staticmethod(lambda key, default: {"spark.checkpoint.dir": f"file://{tmp_path}/"}.get(key, default))

    assert common.shared_dir(Session) == f"file://{tmp_path}"
    assert common.new_path(Session, "x").startswith(f"file://{tmp_path}/x-")
    Session.conf.get = staticmethod(lambda key, default: default)
    with pytest.raises(RuntimeError):
        common.shared_dir(Session)
    Session.sparkContext.getCheckpointDir = staticmethod(lambda: "hdfs://n/given")
    assert common.shared_dir(Session) == "hdfs://n/given"
    assert common.local_path("file:///x/y") == common.local_path("/x/y") == "/x/y" and common.local_path("hdfs://n/x") is None


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="text"):
        minhash.near_groups(spark.createDataFrame([(1,)], "doc_id long"))

