"""The corpus operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glotmill.llm import langid, linededup, mixing, mpeg, packing, sharding, simhash, sketches, toxicity, url_filters
from glotmill.llm.common import take
from glotmill.llm.graph import components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, TEXT string, fingerprint string, k string, path string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]
    make = lambda n: " ".join(rng.choices(vocabulary, k=n))
    base = [make(60) for _ in range(8)]
    out = ["", " \t\n ", None, "one", "One  two", "é ß 日本語 Ab", base[0], base[0], "\n".join(base[1:4]), base[1] + "\n" + make(30)]
    for i in range(30):
        words = base[i % 4].split()
        words[rng.randrange(60)] = make(1)
        if i % 3 == 0:
            del words[rng.randrange(len(words))]
        out.append(" ".join(words) + "\n" + make(rng.randint(0, 12)))
    return [*out, make(20_000), "line\n" * 50, "x" * 5000, "!!! 123 ..."]


@pytest.fixture(scope="module")
def rows():
    made = [(i * 3, t, ("en", "de", None)[i % 3], ("a", "b", None, "a", "a")[i % 5], 0, "clash", "f", "k", "p") for i, t in enumerate(texts())]
    return [*made, made[6], (None, "no key here at all", "en", "a", 0, "c", "f", "k", "p"), (3, "a tie of ids", "en", "b", 0, "c", "f", "k", "p")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_take_prefers_the_exact_name(docs):
    assert take(docs, "text").columns == ["text"] and take(docs, "TEXT").distinct().count() == 2
    with pytest.raises(ValueError, match="no column"):
        take(docs, "nothing")


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_url_filters(spark):
    urls = [None, "", "no scheme", "http://A.Net/x", "http://example.net/en/", "http://sub.EXAMPLE.net/en/x?y", "http://example.net/en", "http://notexample.com/de/x", "https://a.example.com/de/", "ftp://x.org/fr/a#b", "http://net", "http://net?x", "http://a.net#/", "x://y://z.net/", "http://example.com/de/" + "a" * 5000]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate([*urls, urls[3]])] + [(None, urls[4], "h", "r")], "page_id bigint, url string, host string, rule string")

    def judge(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h + p), h + p, v) for h, p, v in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *max(fits)[1:]) if fits else (host, path, None, "allow")

    got = url_filters.filter_urls(pages, url_filters.rule_table(spark, url_filters.RULES)).collect()
    want = [(r.page_id, *judge(r.url)) for r in pages.collect()]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert url_filters.filter_urls(pages.limit(0), url_filters.rule_table(spark, url_filters.RULES)).count() == 0
    assert {r.verdict for r in url_filters.filter_urls(pages, url_filters.rule_table(spark, [])).collect()} == {"allow"}


def slow_simhash(text):
    import xxhash

    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints, bits=4):
    values, root = sorted(set(prints)), {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in values}


def test_simhash(docs, rows, empty):
    got = simhash.near_duplicates(docs).withColumn("hex", simhash.fingerprint_hex("fp")).collect()
    prints = [slow_simhash(r[1]) for r in rows]
    root = linked(prints)
    low = {}
    for r, p in zip(rows, prints, strict=True):
        low[root[p]] = min(low.get(root[p], 1 << 60), r[0] if r[0] is not None else 1 << 60)
    want = [(r[0], f"{p:016x}", low[root[p]] if low[root[p]] < 1 << 60 else None) for r, p in zip(rows, prints, strict=True)]
    assert sorted(map(repr, ((r.doc_id, r.hex, r.component_id) for r in got))) == sorted(map(repr, want))
    assert simhash.near_duplicates(empty).count() == 0


def test_links_of_dense_and_distant_prints(spark):
    rng = random.Random(5)
    prints = []
    for _ in range(12):
        centre = rng.getrandbits(64)
        prints += [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7))) for _ in range(25)]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = dict(map(tuple, simhash.link(spark.createDataFrame([(p,) for p in signed], "fp bigint")).collect()))
    want = linked(prints)
    groups = lambda m, key: sorted(sorted(key(k) for k in m if m[k] == v) for v in set(m.values()))
    assert groups({k & (1 << 64) - 1: v for k, v in got.items()}, int) == groups(want, int)


def test_links_of_near_copies_take_few_rows(spark, monkeypatch):
    rng, made = random.Random(7), []
    centre = rng.getrandbits(64)
    flip = lambda p, bits: p ^ sum(1 << b for b in bits)
    prints = {flip(centre, rng.sample(range(64), rng.choice((1, 2, 3, 4, 7, 8, 9, 10, 11)))) for _ in range(1200)}
    for _ in range(40):  # one bit in each of four of seven fields
        lone = rng.getrandbits(64)
        prints |= {lone, flip(lone, [rng.randrange(64 * f // 7, 64 * (f + 1) // 7) for f in rng.sample(range(7), 4)])}

    def counted(f):
        def run(*a):
            made.append(f(*a).count())
            return f(*a)

        return run

    for name in ("_keys", "_looked"):
        if hasattr(simhash, name):
            monkeypatch.setattr(simhash, name, counted(getattr(simhash, name)))
    got = dict(map(tuple, simhash.link(spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp bigint")).collect()))
    same = lambda m: sorted(sorted(k & (1 << 64) - 1 for k in m if m[k] == v) for v in set(m.values()))
    assert same(got) == same(linked(prints))
    assert sum(made) < 120 * len(prints), (made, len(prints))


def test_unrelated_pairs_carry_no_texts(spark, monkeypatch):
    from glotmill.llm import resemblance

    rng, words, kept = random.Random(11), [f"w{i}" for i in range(12)], {}
    docs = [rng.choices(words, k=2000) for _ in range(40)]
    for n, cut in ((60, 48), (64, 52), (130, 112), (900, 760)):  # similar sets whose bitmaps may differ in size
        base = [f"u{n}-{i}" for i in range(n + 4)]
        docs += [base, base[: cut + 4]]
    docs = [" ".join(d) for d in docs]
    keep = resemblance.Scratch.keep

    def counted(self, df, name):
        out = keep(self, df, name)
        kept[name] = out.count()
        return out

    monkeypatch.setattr(resemblance.Scratch, "keep", counted)
    monkeypatch.setattr(resemblance, "FREQUENT", 0)  # as if the sample had not seen them
    monkeypatch.setattr(resemblance, "PASS_ROWS", 1000, raising=False)
    rows = spark.createDataFrame(list(enumerate(docs)), "key bigint, text string")
    got = {r.key: r.root for r in resemblance.groups(rows).collect()}
    sets = [set(resemblance.shingle_set(t).tolist()) for t in docs]
    for a in range(len(docs)):
        for b in range(a):
            same = 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))
            assert same == (got[a] == got[b]), (a, b)
    assert len(set(got.values())) == 44
    assert kept["star-texts"] + kept["across-texts"] <= 16, kept


def test_near_copies_go_though_lines_went_first(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(13)
    line = lambda: [f"v{rng.randrange(10**6)}" for _ in range(12)]
    base = [line() for _ in range(20)]
    near = [*base[:19], [*base[19][:3], "p", *base[19][4:7], "q", *base[19][8:]]]  # two words of one line: it stays
    half = [*base[:10], *(line() for _ in range(10))]
    texts = ["\n".join(map(" ".join, d)) for d in (base, near, half)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    left = corpus_pipeline.dedup_lines(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in left.collect()) == [0, 1, 2]
    out = corpus_pipeline.drop_near_copies(spark, left, str(tmp_path))
    assert out.columns == list(corpus_pipeline.COLUMNS)
    assert sorted((r.doc_id, r.text.count("\n") + 1) for r in out.collect()) == [(0, 20), (2, 10)]


def _documents(spark, texts, ids=None):
    rows = [(i, t, "en", "a", len(t)) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def _line(rng):
    return " ".join(f"v{rng.randrange(10**6)}" for _ in range(12))


def test_near_copies_where_no_documents_are(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(23)
    a = _line(rng) + " " + _line(rng)
    out = corpus_pipeline.drop_near_copies(spark, _documents(spark, [a, a + " p", _line(rng)]), str(tmp_path))
    assert sorted(r.doc_id for r in out.collect()) == [0, 2]


def test_near_copies_of_texts_at_hand_go(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(17)
    a = "\n".join(_line(rng) for _ in range(20))
    whole = [a + "\n" + _line(rng), "\n".join(_line(rng) for _ in range(30)) + "\n" + a + " p", _line(rng), _line(rng)]
    _documents(spark, whole).write.parquet(f"{tmp_path}/documents.parquet")
    # What is left of 0 and 1 is alike though the whole texts aren't; 2 and 3 are rows of other origin.
    left = _documents(spark, [a, a + " p", b := _line(rng) + " " + _line(rng), b + " q"])
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, left, str(tmp_path)).collect()) == [0, 2]


def test_near_copies_take_disk_for_a_range_at_a_time(spark, tmp_path, monkeypatch):
    import corpus_pipeline
    from glotmill.llm import resemblance

    rng, kept, read, keep = random.Random(29), {}, {}, resemblance.Scratch.keep
    lines = [[_line(rng) for _ in range(20)] for _ in range(6)]
    whole = ["\n".join(x) for x in lines]
    last = lines[5][19].split()
    whole.append("\n".join([*lines[5][:19], " ".join([*last[:3], "p", *last[4:]])]))  # resembles the one before
    _documents(spark, whole).write.parquet(f"{tmp_path}/documents.parquet")
    left = _documents(spark, ["\n".join(x.split("\n")[:19]) for x in whole[:5]] + whole[5:])  # five have lost a line

    def counted(self, df, name):
        read.setdefault(name, []).append({m[0] for f in df.inputFiles() if (m := re.search(r"/some\d", f))})
        out = keep(self, df, name)
        kept[name] = out.count()
        return out

    monkeypatch.setattr(resemblance.Scratch, "keep", counted)
    monkeypatch.setattr(resemblance, "FEW", 0, raising=False)
    monkeypatch.setattr(resemblance, "PASS_ROWS", 100)
    out = corpus_pipeline.drop_near_copies(spark, left, str(tmp_path))
    assert sorted(r.doc_id for r in out.collect()) == [0, 1, 2, 3, 4, 5]
    assert kept["tied"] == 5 and kept["star-pairs"] == 1 and kept["star-texts"] == 2, kept  # ties are not compared
    assert read["stars"] == [{f"/some{i}"} for i in range(resemblance.PASSES)]
    assert all(read[f"held{i}"] == [{f"/some{i}"}] for i in range(resemblance.PASSES))


def test_near_copies_of_whole_texts_with_repeated_ids_go(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(19)
    base = [_line(rng) for _ in range(20)]
    last = base[19].split()
    near = [*base[:19], " ".join([*last[:3], "p", *last[4:7], "q", *last[8:]])]
    docs = _documents(spark, ["\n".join(base), "\n".join(near), "\n".join(_line(rng) for _ in range(20))], [1, 7, 7])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    left = corpus_pipeline.dedup_lines(spark, docs, str(tmp_path))
    assert sorted(r.text.count("\n") for r in left.collect()) == [0, 19, 19]
    out = corpus_pipeline.drop_near_copies(spark, left, str(tmp_path))
    assert sorted((r.doc_id, r.text.count("\n")) for r in out.collect()) == [(1, 19), (7, 19)]


def test_few_links_take_one_task(spark, monkeypatch):
    from glotmill.llm import graph

    rng = random.Random(29)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(40)]
    df, name = spark.createDataFrame(edges, "a bigint, b bigint"), "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        one = graph.components(df)
        monkeypatch.setattr(graph, "FEW", 0, raising=False)
        assert sorted(one.collect()) == sorted(graph.components(df).collect())
        assert one.rdd.getNumPartitions() == 1 and graph.components(df.limit(0)).count() == 0
    finally:
        spark.conf.set(name, before)


def test_language_gradients_and_labels():
    rng = np.random.default_rng(0)
    m = langid.Model(["a", "b", "c"], {k: v.astype(float) for k, v in langid._init(3, 4, 3, rng).items()}, 4)
    words, target = [b"ab", b"xyz", b"q"], np.array([0, 2, 1])

    def loss():
        _, mask, _, _, p, _ = langid._forward(m, words)
        return -(np.log(p[:, np.arange(3), target]) * mask).sum() / mask.sum()

    for k, g in langid._backward(m, words, target).items():
        at = (97, 0) if k == "E" else (0,) * g.ndim
        m.w[k][at] += 1e-3
        up = loss()
        m.w[k][at] -= 2e-3
        down = loss()
        m.w[k][at] += 1e-3
        assert abs((up - down) / 2e-3 - g[at]) < 1e-4, k
    labeller, long = langid.Labeller(m), bytes(rng.integers(32, 250, 5000, np.uint8))
    for data in (b"q", b"abc xyz " * 40, long, long[:256], long[:257], long[:288]):
        made = langid.windows(data)
        assert [b for w in made for b in range(w[1], w[2])] == list(range(len(data)))
        alone = labeller.sums([data])[0]
        assert np.abs(alone - langid.position_probabilities(m, data).sum(axis=0)).max() < 1e-2
        assert (labeller.sums([long, data, b"", b"w"])[1] == alone).all()
    assert labeller([None, "", "12 !", "x"])[0][:3] == ["und"] * 3


def test_language(spark, docs, rows, empty):
    rng = random.Random(2)
    parts = {"xx": ["abra", "kada", "bra"], "yy": ["zuzo", "wywy", "qoqu"]}
    made = [(i, " ".join("".join(rng.choices(parts[lang], k=2)) for _ in range(rng.randint(5, 40))), lang) for i in range(160) for lang in [("xx", "yy")[i % 2]]]
    df = spark.createDataFrame(made, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    held = [r for r in made if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert held and all(got[r[0]].held_out for r in held) and sum(got[i].held_out for i in got) == len(held)
    assert np.mean([got[i].lang_pred == lang for i, _, lang in held]) >= 0.95
    odd = langid.identify(docs).collect()
    assert len(odd) == len(rows) and {r.lang_pred for r in odd} <= {"en", "de", "und"}
    assert {r.score for r in odd if r.lang_pred == "und"} == {0.0} and all(0 <= r.score <= 1 for r in odd)
    assert sum(r.lang_pred == "und" for r in odd) == sum(not any(map(str.isalpha, r[1] or "")) for r in rows)
    assert langid.identify(empty).count() == 0
    kept = langid.keep_identified(docs, ("doc_id", "text"))
    assert kept.columns == ["doc_id", "text"] and kept.where("text IS NULL OR text = ''").count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1399, 1417, 1418, 5000, 100_000])
def test_mpeg_round_trip(n):
    data = random.Random(n).randbytes(n)
    media = mpeg.encode(data)
    got = mpeg.decode(media)
    assert got["payload"] == data and got["ok"] and got["duration"] * 32_000 == got["frames"] * 1152
    assert got["table"]["frames"] == got["frames"] and all(media[i : i + 2] == b"\xff\xfa" for i in got["offsets"])


def test_mpeg_damage():
    data = b"\xff\xfa\xe8" * 3000
    media = mpeg.encode(data)
    third = mpeg.decode(media)["offsets"][2]
    noisy = mpeg.decode(media[:third] + b"\xff\xfbgarbage\xff" + media[third:])
    assert noisy["payload"] == data and noisy["skipped"] == 10 and not noisy["ok"]
    broken = bytearray(media)
    broken[third + 10] ^= 1
    got = mpeg.decode(bytes(broken))
    assert not got["ok"] and got["frames"] == mpeg.decode(media)["frames"] - 1


def test_mpeg_column(docs, rows, empty):
    got = sorted(mpeg.read_media(mpeg.store_texts(docs)).collect(), key=lambda r: (str(r.doc_id), r.payload_sha256))
    want = []
    for r in rows:
        n, data = mpeg.pad(r[1])
        want.append((r[0], n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:])))
    want.sort(key=lambda r: (str(r[0]), r[3]))
    assert [(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got] == want and all(r.intact for r in got)
    assert mpeg.read_media(mpeg.store_texts(empty)).count() == 0


def test_sharding(spark, docs, rows, empty, tmp_path):
    store = sharding.shard(docs, arrivals=5, root=f"{tmp_path}/s")
    got = sorted((str(r.doc_id), str(r.text)) for r in store.rows().collect())
    assert got == sorted((str(r[0]), str(r[1])) for r in rows)
    assert store.live().count() == 1 and len(store.versions()) > 5
    with pytest.raises(sharding.Conflict):
        store.commit(1, added="x")
    assert sharding.shard(empty, root=f"{tmp_path}/e") is None


def test_sharding_tiers(spark, tmp_path):
    store = sharding.ShardStore(spark, f"{tmp_path}/t")
    df = spark.range(4000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("x"))
    for i in range(4):
        store.append(df.where(F.col("id") % 4 == i).repartition(3))
    before = len(store.versions())
    assert before == 4 and store.live().count() == 12 and store.live(2).count() == 6
    size = store.live().agg(F.sum("bytes")).first()[0]
    store.compact(target=size // 3, fan_in=3, keep=True)
    assert store.rows().select("id").distinct().count() == store.rows().count() == 4000
    assert store.live().count() < 12 and store.rows(before).count() == 4000
    plan = store.plan(size // 3, 3)
    assert plan.groupBy("run").count().where("count < 2").count() == 0


def test_toxicity(spark, empty):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdef", k=5)) for _ in range(200)]
    bad = ["grumok", "zaffle", "trundo"]
    made, labels = [], []
    for i in range(400):
        toxic, low = i % 4 == 0, i % 3 == 0
        t = rng.choices(words, k=60)
        if toxic:
            t[rng.randrange(60)] = rng.choice(bad)
        made.append((i, (" | " if low else " ").join(t), "x"))
        if i < 300:
            labels += [(i, int(not low), int(toxic), "y")] * (1 + (i % 50 == 0))
    df = spark.createDataFrame([*made, (None, None, "x"), (7000, "", "x")], "doc_id bigint, text string, p_toxic string")
    lab = spark.createDataFrame([*labels, (None, 1, 1, "y"), (5, None, None, "y")], "doc_id bigint, quality int, toxic int, text string")
    got = {r.doc_id: r for r in toxicity.classify(df, lab).collect()}
    assert len(got) == 402
    assert np.mean([got[i].toxic == (i % 4 == 0) for i in range(300, 400)]) > 0.95
    assert np.mean([(got[i].p_low_quality > 0.5) == (i % 3 == 0) for i in range(300, 400)]) > 0.95
    assert toxicity.classify(empty, lab).count() == 0
    assert not any(r.toxic for r in toxicity.classify(df, lab.limit(0)).collect())


def edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return 2
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    if i == len(a) == len(b):
        return 0
    return 1 if any(a[i + x :] == b[i + y :] for x, y in ((1, 1), (1, 0), (0, 1))) else 2


def test_line_dedup(spark, empty):
    rng = random.Random(9)
    vocabulary = "a b c d e f g h".split()
    lines = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 8))) for _ in range(60)] + ["w " * 600 + x for x in ("p q", "p", "r q", "p q")]
    made = [(i, "\n".join(rng.choices([*lines, "", "  "], k=rng.randint(1, 6)))) for i in range(60)] + [(60, None), (61, ""), (62, "\n\n")]
    seen, want = [], []
    for i, t in made:
        kept = []
        for line in (t or "").split("\n") if t is not None else []:
            w = WORD.findall(line)
            gone = bool(w) and any(v == w or max(len(v), len(w)) >= 5 and edit(v, w) <= 1 for v in seen)
            if w:
                seen.append(w)
            if not gone:
                kept.append(line)
        want.append((i, None if t is None else "\n".join(kept), 0 if t is None else len(t.split("\n")), len(kept)))
    df = spark.createDataFrame([(i, t, "c", "n") for i, t in made], "doc_id bigint, text string, line string, n_lines string").repartition(4)
    got = linededup.dedup_lines(df)
    assert sorted(map(tuple, got.collect())) == want
    both = df.union(df)  # repeated rows are one document
    assert sorted(map(tuple, linededup.dedup_lines(both).collect())) == sorted(want * 2)
    assert linededup.dedup_lines(empty).count() == 0
    nulls = linededup.dedup_lines(df.withColumn("doc_id", F.when(F.col("doc_id") < 5, None).otherwise(F.col("doc_id"))))
    assert nulls.count() == len(made)


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_fingerprints(docs, rows, empty, monkeypatch):
    monkeypatch.setattr(sketches, "RANGE_ROWS", 7)
    got = sketches.compare_with_edits(docs).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_chars): r for r in got}
    keyed = sorted((r for r in rows if r[0] is not None and r[0] > 24), key=lambda r: r[0])
    for r, after in zip(keyed, keyed[1:], strict=False):
        x, new = by[r[0], len(r[1] or "")], sketches.edited(r[1], after[1])
        assert x.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        for value, other in ((x.near_edited, new), (x.near_next, after[1])):
            a, b = shingles(r[1]), shingles(other)
            assert abs(value - (len(a & b) / len(a | b) if a | b else 1)) < 0.2
    last = by[None, len("no key here at all")]
    assert last.edited_sha256 == hashlib.sha256(sketches.edited("no key here at all", "").encode()).hexdigest()
    assert sketches.compare_with_edits(empty).count() == 0
    assert sketches.compare_with_edits(docs.where("doc_id = 9")).first().near_next == 1.0


def test_sketches_merge():
    t = texts()[-4]
    words = t.split()
    whole = sketches.Sketch(sketches.shingle_hashes(t))
    parts = [sketches.Sketch(sketches.shingle_hashes(" ".join(words[i : i + 1004]))) for i in range(0, len(words) - 4, 1000)]
    assert sketches.merge_all(parts).hex() == whole.hex() == sketches.Sketch.parse(whole.hex()).hex()
    assert abs(whole.distinct() / len(shingles(t)) - 1) < 0.3 and whole.containment(whole) == 1.0
    half = sketches.Sketch(sketches.shingle_hashes(" ".join(words[:10_000])))
    assert half.containment(whole) > 0.8 and 0.35 < whole.containment(half) < 0.65


@pytest.mark.parametrize("seed", range(6))
def test_packing_plan(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 2047): rng.randint(1, 500) for _ in range(rng.choice((1, 5, 200, 1500)))}
    plan = packing.Plan(counts)
    length = np.repeat(np.array([*counts]), [*counts.values()])
    rank = np.concatenate([np.arange(n) for n in counts.values()])
    fill, done = [], np.zeros(len(length), int)
    for at, start, sequence, offset, taken in plan.place(length, rank):
        assert (start == done[at]).all()
        done[at] += taken
        fill += zip(sequence.tolist(), offset.tolist(), taken.tolist(), strict=True)
    assert (done == length).all()
    fill.sort()
    for (s, o, n), (s2, o2, _) in zip(fill, fill[1:], strict=False):
        assert o2 == (o + n if s == s2 else 0)
    assert fill[0][1] == 0 and max(o + n for _, o, n in fill) <= 2048
    assert plan.n <= -(-int(length.sum()) // 2048) * 1.02 + 1


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.pack(docs).collect()
    byseq = {}
    for r in got:
        assert r.length * 4 == len(r.ids) and zlib.crc32(r.ids) == r.ids_crc32
        byseq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in byseq.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts[:-1]]]).tolist() and sum(n for _, n in parts) <= 2048
    mine = {}
    for r in sorted(got, key=lambda r: r.start):
        mine.setdefault((r.doc_id, r.doc_tokens), []).append(bytes(r.ids))
    for r in rows:
        if r[0] in (None, 3, 18):
            continue
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        assert b"".join(mine[r[0], len(ids) // 4]) == ids
    assert sum(r.length for r in got) == sum(len(t.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)
    assert packing.pack(empty).count() == 0


def _held(spark):
    """MB that each Python worker holds, those of the daemons' children."""

    def look(frames):
        for f in frames:
            import os
            from pathlib import Path

            held = []
            for p in Path("/proc").glob("[0-9]*/status"):
                try:
                    said = dict(x.split(":", 1) for x in p.read_text().splitlines())
                except OSError:
                    continue
                if int(said["PPid"]) == os.getppid():
                    held.append(int(said["RssAnon"].split()[0]) / 1024)
            yield f.assign(id=[int(max(held))] * len(f))

    return spark.range(1).mapInPandas(look, "id long").first()["id"]


def test_workers_give_memory_back(spark):
    from glotmill.llm import packing

    words = F.transform(F.sequence(F.lit(1), F.lit(350)), lambda i: F.concat(F.lit("w"), F.conv(F.pmod(F.xxhash64("doc_id", i), F.lit(200_000)).cast("string"), 10, 36)))
    docs = spark.range(9_000).select(F.col("id").alias("doc_id")).select("doc_id", F.array_join(words, " ").alias("text")).coalesce(1)
    before = _held(spark)
    assert packing.pack(docs, with_ids=False).agg(F.sum("length")).first()[0] > 9_000 * 350
    assert _held(spark) < before + 110  # the tokenizer takes about 50


@pytest.mark.parametrize("text", ["İstanbul ΣΑΣ ß e\u0301 \u00a0x\u2003y <|endoftext|>a b", "<|ENDOFTEXT|> x", "T\u0308 a.", "a., .b ,. a.. a',b it's. IT'S, x1, 7. é,", "\x1c a\x85b", "", " \n\t"])
def test_tokenize_equals_the_tokenizer(text):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    assert next(packing.tokenize(pa.array([text]), path)).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_targets_and_permutations():
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0.0, 0.0]
    got = mixing.targets([10, 1000, 1000, 5])
    assert got[0] == 30 and got[3] == 15 and abs(sum(got) - 2015) < 1e-9 and abs(got[1] / got[2] - 2) < 1e-9
    for n in (1, 2, 3, 64, 1000):
        p = mixing.permute(np.arange(n), n, 12345)
        assert sorted(p.tolist()) == list(range(n))
        assert (mixing.permute(p, n, 12345, inverse=True) == np.arange(n)).all()


@pytest.mark.parametrize("block", [1, 7, 256])
def test_mixing(docs, rows, empty, block):
    got = mixing.mix_sizes(docs, block=block, shard=50).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix_sizes(docs.repartition(3), block=block, shard=50).collect()), key=repr)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.targets([sizes[s] for s in order]), strict=True))
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(r[0]), len(WORD.findall(r[1] or ""))) for r in rows)
    assert all(r.taken <= 3 * r.size for r in got)
    for s in order:
        mine = [r for r in got if abs(r.target - want[s]) < 1e-9]
        assert sum(r.taken for r in mine) == round(want[s]) and {r.source_size for r in mine} == {sizes[s]}
    assert mixing.mix_sizes(empty).count() == 0


def test_mixed_documents(docs, rows):
    columns = ("doc_id", "text", "source")
    got = mixing.mix_documents(docs, columns, block=16).collect()
    taken = sum(r.taken for r in mixing.mix_sizes(docs, block=16).collect())
    assert sum(len(WORD.findall(r.text)) for r in got) == taken
    known = {(r[0], w) for r in rows for w in WORD.findall(r[1] or "")}
    assert all((r.doc_id, w) in known for r in got for w in WORD.findall(r.text))
    again = mixing.mix_documents(docs, columns, block=16, shard=50, shard_column="to").collect()
    assert len({r.to for r in again}) > 2 and sum(len(WORD.findall(r.text)) for r in again) == taken
    made = mixing.Mix(docs, block=16, shard=50)
    by_shard = {r[0]: r[1] for r in made.draws.groupBy("out_shard").agg(F.sum("count")).collect()}
    assert sum(by_shard.values()) == made.slots.n.sum() and [by_shard[i] for i in range(len(by_shard) - 1)] == [50] * (len(by_shard) - 1)
    assert mixing.excerpt("a b\nc  d", [(0, 1), (1, 2), (3, 4)], 4) == "a b\nd" and mixing.excerpt(" a b ", [(0, 2)], 2) == " a b "


def test_pipeline_stages(spark, docs, rows, empty):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["language", "lines", "near_copies", "mix", "pack"]
    df = take(docs, *P.COLUMNS)
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, df, "")
        assert out.columns == list(P.COLUMNS)
        assert stage(spark, take(empty, *P.COLUMNS), "").count() == 0
        df = out.cache()
        assert df.count() > 0
    assert P.pack_sequences(spark, df, "").count() > 0


def test_edited_copies_are_dropped(spark, docs, rows):
    import corpus_pipeline as P

    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    passage = [word() for _ in range(40)]
    made = [r[1] for r in rows]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(30, 200))] + passage
        made.append(" ".join(base))
        for edits in (1, 2, 3, 6):
            words = list(base)
            for i in rng.sample(range(len(words)), edits):
                words[i] = word()
            made.append(" ".join(words))
    sets = [set(sketches.shingle_hashes(t).tolist()) for t in made]
    root = list(range(len(made)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 9 * len(a & b) >= 4 * (len(a) + len(b)) and root[i] != root[j]:
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(made)], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(5)
    got = dict(P.STAGES)["near_copies"](spark, df, "").collect()
    assert sorted(r.doc_id for r in got) == sorted(set(root))


def test_capitals_of_long_texts():
    assert toxicity.shapes("aBcd" * 4000)[0] == 0.25 and toxicity.shapes("")[0] == 0


def test_line_dedup_many_repeated_rows(spark):
    lines = "\n".join(" ".join(f"w{i}x{j}" for j in range(8)) for i in range(3)) + "\nw0x0 w0x1 w0x2 other w0x4 w0x5 w0x6 w0x7"
    got = linededup.dedup_lines(spark.createDataFrame([(1, lines)] * 400, "doc_id bigint, text string"))
    assert got.count() == 400
    assert set(map(tuple, got.collect())) == {(1, lines.rsplit("\n", 1)[0], 4, 3)}


def test_compactions_planned_on_one_version(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/store")
    for i in range(4):
        store.append(spark.range(i * 50, i * 50 + 50).coalesce(1))
    base, columns = len(store.versions()), spark.read.parquet(f"{tmp_path}/store/data/*").schema
    runs = [*sharding._some(store.plan(version=base).orderBy("run"))]
    store._merge(runs[0], columns, base)
    with pytest.raises(sharding.Conflict):
        store._merge(runs[0], columns, base)
    (tmp_path / "store" / "log" / "_left-by-a-dead-writer").write_text('{"ver')
    assert store.append(spark.range(200, 210)) == base + 2
    store.compact()
    assert sorted(r[0] for r in store.rows().select("id").collect()) == list(range(210))
