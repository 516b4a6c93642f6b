"""Small fixtures against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard

from terraframe.llm import byte_bpe, html_text, language_id, media, mixing, quality, resemblance, simhash, substring_dedup, vafile, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def corpus():
    r = random.Random(7)
    some = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    shared = some(40)
    base = some(300)
    texts = [some(r.randrange(1, 120)) for _ in range(30)]
    texts += [some(10) + " " + shared + "\n" + some(10) for _ in range(6)]
    texts += [base, base, base.upper(), base.replace("alpha", "ALPHA"), base + " tail"]
    texts += [None, "", " \t\n", "one", "x" * 5000, shared * 30, "\x0b\x0c", "é ß 漢字 " * 40]
    rows = [(i, t, "en" if i % 3 else "fr", f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in enumerate(texts)]
    return rows + [(3, texts[3], "en", "s0", 1), (None, "null id here", "en", "s1", 2), (None, base, None, "s1", 2)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# simhash


def brute_fingerprint(text):
    w = split(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    g = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    bits = [sum(xxhash.xxh64_intdigest(x.encode(), 42) >> b & 1 for x in g) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(g))


def test_simhash(docs):
    rows, fps = corpus(), [brute_fingerprint(r[1]) for r in corpus()]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), 1 << 60), r[0])
    want = sorted((str(r[0]), f"{fps[i]:016x}", least.get(find(i))) for i, r in enumerate(rows))
    got = simhash.near_duplicates(docs.withColumnRenamed("n_chars", "fp")).collect()
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want
    kept = simhash.one_of_each(docs).collect()
    assert len(kept) == len({find(i) for i in range(len(rows))}) and len({find(next(i for i, x in enumerate(rows) if x[:2] == r[:2])) for r in kept}) == len(kept)


def test_simhash_majority_long_runs():
    r = np.random.default_rng(0)
    h = r.integers(0, 2**63, 100_000, dtype=np.uint64) * np.uint64(2) + r.integers(0, 2, 100_000, dtype=np.uint64)
    lengths = np.array([0, 70_000, 1, 0, 29_999])
    got, at = simhash.majority(h, lengths), 0
    for n, g in zip(lengths, got, strict=True):
        part = h[at : at + n]
        at += n
        assert int(g) == sum(1 << b for b in range(64) if 2 * int((part >> np.uint64(b) & np.uint64(1)).sum()) > n)


@pytest.mark.parametrize("small", [False, True])
def test_simhash_links(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(simhash, "FEW", 4)
        monkeypatch.setattr(simhash, "HOT", 8)
    r = random.Random(3)
    seeds = [r.getrandbits(64) for _ in range(12)]
    fps = set(seeds)
    for s in seeds[:6]:
        for k in range(12):
            for b in r.sample(range(64), k % 7):
                s ^= 1 << b
            fps.add(s)
    fps = sorted(fps)
    parent = {f: f for f in fps}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                parent[find(a)] = find(b)
    want = {frozenset(f for f in fps if find(f) == root) for root in set(map(find, fps))}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    edges = simhash.ball_links(spark.createDataFrame([(signed(f),) for f in fps], "fp long")).collect()
    again = {f: f for f in fps}

    def root(f):
        while again[f] != f:
            f = again[f]
        return f

    for e in edges:
        again[root(e.fp & (2**64 - 1))] = root(e.root & (2**64 - 1))
    assert {frozenset(f for f in fps if root(f) == x) for x in set(map(root, fps))} == want
    # a task that splits its variants finds the same
    if small:
        monkeypatch.setattr(simhash, "VARIANTS", 1 << 8)

        one = pa.table({"fp": [signed(f) for f in fps], "used": pa.array([0] * len(fps), pa.int32()), "key": pa.array([0] * len(fps), pa.int64())})
        whole = simhash._forest(one, 0, 2, 4)
        lab = dict(zip(whole["fp"].to_pylist(), whole["root"].to_pylist(), strict=True))
        assert {frozenset(f for f in fps if lab.get(signed(f), signed(f)) == x) for x in {lab.get(signed(f), signed(f)) for f in fps}} == want


# substring dedup


def brute_substrings(rows, width):
    """Every row is a document; ``rows`` come in the documents' order."""
    seen, out = set(), []
    for r in rows:
        w, gone = split(r[1]), set()
        for k in range(len(w) - width + 1):
            t = tuple(w[k : k + width])
            if t in seen:
                gone.update(range(k, k + width))
            seen.add(t)
        keep = [x for i, x in enumerate(w) if i not in gone]
        out.append((str(r[0]), len(w), len(w) - len(keep), hashlib.sha256(" ".join(keep).encode()).hexdigest()))
    return sorted(out)


def in_order(spark, rows, schema, also):
    """Null ids first, then by id; rows of one id by the operator's hash, so that only their order is taken from it."""
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], f"n long, {schema}")
    keep = substring_dedup.nested(("doc_id", *also))
    h = {x.n: x.h for x in df.select("n", substring_dedup.F.xxhash64(substring_dedup.utf8("text"), keep).alias("h")).collect()}
    return [r for _, r in sorted(enumerate(rows), key=lambda x: (-(2**63) if x[1][0] is None else x[1][0], h[x[0]]))]


@pytest.mark.parametrize("block", [1 << 23, 300])
def test_substrings(docs, spark, monkeypatch, block):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", block)
    digest = lambda got: sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got)
    got = substring_dedup.dedup(docs.withColumnRenamed("lang", "_lang")).collect()
    assert digest(got) == brute_substrings(in_order(spark, corpus(), DOCS, ()), 20)
    got = substring_dedup.dedup(docs, width=6).collect()
    assert digest(got) == brute_substrings(in_order(spark, corpus(), DOCS, ()), 6)


def test_substrings_by_row(spark):
    """Rows of one id, null ids and equal rows are documents of their own."""
    w, u = ([f"{k}{i}" for i in range(30)] for k in "wu")
    rows = [(5, " ".join(w)), (5, " ".join(u)), (None, " ".join(u[:25])), (None, " ".join(w[:24])), (7, " ".join(w[2:29])), (8, "q " * 25), (8, "q " * 25), (9, "z " * 12), (9, "z " * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in substring_dedup.dedup(docs).collect())
    # the null ids come first: 25 of u and 24 of w are theirs
    assert got == sorted([("5", 30, 24), ("5", 30, 25), ("None", 25, 0), ("None", 24, 0), ("7", 27, 27), ("8", 25, 24), ("8", 25, 25), ("9", 12, 0), ("9", 12, 0)])
    assert substring_dedup.dedup(docs.where("false")).count() == 0


def test_clashing_names(spark, docs):
    """Columns called like an operator's own pass through ``also``, or leave where the result has that name."""
    own = ["id", "th", "body", "row", "keep", "n", "i", "copy", "many", "spans", "_k", "_id", "_t", "_n", "_i", "_th", "_body", "fp", "component", "size", "slice", "draw", "source_size", "n_words", "kept", "node", "times"]
    few = docs.where("doc_id < 12 and doc_id is not null").dropDuplicates(["doc_id"])
    odd = few.select("*", *[simhash.F.concat(simhash.F.lit(f"{c}-"), "doc_id").alias(c) for c in own])
    whole = lambda rows, names: all(r[c] == f"{c}-{r.doc_id}" for r in rows for c in names)
    got = simhash.near_duplicates(odd, also=tuple(own)).collect()
    assert len(got) == few.count() and whole(got, set(own) - {"component"})
    got = mixing.mix(odd, also=tuple(own)).collect()
    assert len(got) == few.count() and whole(got, set(own) - set(mixing.MIXED))
    got = substring_dedup.dedup(odd, also=tuple(own)).collect()
    assert len(got) == few.count() and whole(got, set(own) - {"n_words", "kept"})
    for one in (simhash.one_of_each(odd), mixing.mixed(odd), resemblance.one_of_each(odd)):
        assert one.columns == odd.columns and whole(one.collect(), own)
    got = media.encode(odd).collect()
    assert whole(got, own)


def test_window_hash_clash(monkeypatch):
    """Windows that share a hash but not their words stay apart."""
    text = " ".join(WORDS[:20])
    monkeypatch.setattr(substring_dedup, "rolling", lambda h, n: np.zeros(max(0, len(h) - n + 1), np.uint64))
    w = substring_dedup.Windows("\n".join([text, text, " ".join(WORDS[4:24]), text]).encode(), np.arange(4), np.zeros(4, np.int64), np.zeros(4, np.int64), np.array([20] * 4), 20)
    assert np.flatnonzero(w.repeats()).tolist() == [20, 60]


def test_word_hashes_slices(monkeypatch):
    buf = np.frombuffer(b" ".join(w.encode() for w in WORDS) + b" " + b"y" * 900 + b" alpha", np.uint8)
    s, e = substring_dedup.words(buf)
    whole = substring_dedup.word_hashes(buf, s, e)
    assert whole[0] == whole[-1] and len(set(whole.tolist())) == len(s) - 1
    monkeypatch.setattr(substring_dedup, "SLICE_BYTES", 64)
    substring_dedup._slice_powers.cache_clear()
    assert (substring_dedup.word_hashes(buf, s, e) == whole).all()
    substring_dedup._slice_powers.cache_clear()


@pytest.mark.parametrize("distance", [1, 2, 3, 4])
def test_simhash_distances(distance):
    """The forest of a few close fingerprints spans the classes of all their pairs, at even and odd distances."""
    rng = np.random.default_rng(5)
    for _ in range(60):
        centre, bits = int(rng.integers(0, 1 << 63)), rng.choice(64, 9, replace=False)
        fp = np.array(sorted({centre ^ sum(1 << int(b) for b in rng.choice(bits, int(rng.integers(0, 4)), replace=False)) for _ in range(7)}), np.uint64)
        n = len(fp)
        got = simhash._forest(pa.table({"fp": fp.view(np.int64), "used": np.zeros(n, np.int32), "key": np.zeros(n, np.int64)}), 0, (distance + 1) // 2, distance)
        at = {v: k for k, v in enumerate(fp.view(np.int64).tolist())}

        def classes(edges, n=n):
            lab = list(range(n))
            for _ in range(n):
                for a, b in edges:
                    lab[a] = lab[b] = min(lab[a], lab[b])
            return lab

        near = [(a, b) for a in range(n) for b in range(a) if int(fp[a] ^ fp[b]).bit_count() <= distance]
        assert classes([(at[a], at[b]) for a, b in zip(got["fp"].to_pylist(), got["root"].to_pylist(), strict=True)]) == classes(near)


# media


def test_media(docs, spark):
    got = media.read(media.encode(docs.withColumnRenamed("lang", "payload"))).collect()
    want = {str(r[:2]): (r[1] or "").encode() for r in corpus()}
    assert len(got) == len(corpus())
    by = {}
    for r in got:
        by.setdefault(r.n_bytes, []).append(r)
    for b in want.values():
        p = b + b"\xff" * (-len(b) % 576 if b else 576)
        same = [r for r in by[len(b)] if r.payload_sha256 == hashlib.sha256(p).hexdigest()]
        assert same and len({r.feature for r in same}) == 1
        r = same[0]
        assert r.payload_bytes == len(p) and r.tail_crc32 == zlib.crc32(p[-32:]) and r.media_sha256 == hashlib.sha256(media.to_wav(p)).hexdigest()
        assert len(r.pair_times) == len(r.pair_codes) and list(r.pair_times) == sorted(r.pair_times)


def test_media_tone():
    t = np.arange(576 * 6)
    x = (128 + 60 * np.sin(2 * np.pi * t * 40 / 576)).astype(np.uint8).tobytes()
    times, bins = media.peaks(media.from_wav(media.to_wav(x)))
    strongest = {f: bins[times == f] for f in set(times.tolist())}
    assert len(strongest) == 11 and all(40 in b for b in strongest.values())


def test_media_feature_brute():
    """Peaks and pairs by plain loops over a transform written out."""
    rng = np.random.default_rng(11)
    for n in (1, 2, 5):
        x = rng.integers(0, 256, 576 * n).astype(np.uint8)
        wave_ = np.exp(-2j * np.pi * np.outer(np.arange(289), np.arange(576)) / 576)
        want = []
        for f in range(1 + (len(x) - 576) // 288):
            power = np.abs(wave_ @ ((x[f * 288 : f * 288 + 576].astype(float) - 128) * np.hanning(576))) ** 2
            tops = [k for k in range(1, 288) if power[k] > power[k - 1] and power[k] >= power[k + 1] and power[k] > 1e-3]
            want += [(f, k) for k in sorted(sorted(tops, key=lambda k: -power[k])[:3])]
        times, bins = media.peaks(x.tobytes())
        assert list(zip(times.tolist(), bins.tolist(), strict=True)) == want
        codes = sorted((t, a << 13 | b << 3 | u - t) for t, a in want for u, b in want if t < u <= t + 4)
        at, got = media.pairs(times, bins)
        assert list(zip(at.tolist(), got.tolist(), strict=True)) == codes


# WARC


def test_warc(spark, tmp_path):
    big, other = "<p>" + "x" * 1200, "<p>" + "é" * 600
    rows = [(1, "http://a/1", big), (2, "http://a/2?x=ü", big), (9, None, big), (3, "http://b/", "small"), (4, "http://b/", "small"), (5, "c", None), (6, "http://d/", other), (7, "http://d/", other), (7, "http://d/", other), (None, "http://e/", big), (8, "http://\r\nf/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = tmp_path / "pages.parquet"
    pages.repartition(3).write.parquet(str(path))
    got = warc.op1_warc(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    leader = {big: 9, other: 7}
    for page, _, html in rows:
        p = (html or "").encode()
        mine = [r for r in got if r.page_id == page and r.payload_digest == hashlib.sha1(p).hexdigest()]
        assert mine and all(r.payload_bytes == len(p) for r in mine)
        kinds = sorted((r.record_type, r.refers_to) for r in mine)
        if page == 7:
            assert kinds == [("response", None), ("revisit", 7)]
        elif html in leader and page != leader[html]:
            assert kinds == [("revisit", leader[html])]
        else:
            assert kinds == [("response", None)]


def test_warc_records_and_links(spark):
    rec = lambda id, kind, to=(): (id, kind, list(to), None, None, None, None, {}, None)
    rows = [rec("r1", "response"), rec("q1", "request", ["r1"]), rec("m1", "metadata", ["q1"]), rec("r2", "response", ["q2"]), rec("q2", "request"), rec("q3", "request", ["nowhere"]), rec("r1", "response")]
    got = {r.capture_id: r for r in warc.assemble(spark.createDataFrame(rows, warc.RECORD)).collect()}
    assert set(got) == {"r1", "r2"}
    assert [x.record_id for x in got["r1"].requests] == ["q1"] and [x.record_id for x in got["r1"].metadata] == ["m1"]
    assert [x.record_id for x in got["r2"].requests] == ["q2"]
    members = warc.transaction("1", "http://a/", b"body", None, {"k": "v"})
    parsed = list(warc.parse(members))
    assert [p[1] for p in parsed] == ["request", "response", "metadata"] and parsed[1][8] == b"body" and dict(parsed[2][7]) == {"k": "v"}
    with pytest.raises(ValueError):
        list(warc.parse(members[:-9]))


def test_warc_empty(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert warc.op1_warc(spark, str(tmp_path)).count() == 0


# quality


def test_quality(spark):
    r = random.Random(1)
    good = lambda: " ".join(r.choice(WORDS) for _ in range(60)).capitalize() + "."
    bad = lambda: " ".join(r.choice(WORDS).upper() + "!!" for _ in range(60))
    rows = [(i, good() if i % 2 else bad()) for i in range(400)] + [(1000, None), (1001, ""), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)] + [(5, None, 0), (7, 3, 0)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality.classify(docs, labels).collect()}
    assert len(got) == len(rows)
    held = [x for i, x in got.items() if i is not None and i < 400 and x.held_out]
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, x in got.items() if i is not None)
    assert len(held) > 80 and np.mean([x.predicted == x.doc_id % 2 for x in held]) > 0.97
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got.values())
    # without labels the score says nothing
    assert {x.score for x in quality.classify(docs, labels.where("false")).collect()} == {0.5}
    assert quality.classify(docs.where("false"), labels).count() == 0


def test_normal_equations(spark, monkeypatch):
    """The sums are those of one loop over all rows, however many partitions and lanes."""
    monkeypatch.setattr(quality, "LANES", 3)
    r = np.random.default_rng(6)
    x, y = r.normal(size=(90, quality.N_STATS)), r.integers(0, 2, 90)
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(90)], "id long, x array<double>, y int").repartition(7)
    phi = quality.Fourier(x.mean(axis=0), x.std(axis=0))
    sums, n = quality.normal_equations(df, phi)
    want = np.zeros_like(sums)
    for i in range(90):
        z = np.append(phi(x[i : i + 1])[0], y[i])
        want[zlib.crc32(b"fold%d" % i) % quality.FOLDS] += np.outer(z, z)
    assert n == 90 and np.allclose(sums, want)
    weights, without = quality.ridge(sums, n)
    total = want.sum(axis=0)
    fits = []
    for p in quality.PENALTIES:
        reg = p * 90 * np.diag([1e-9] + [1.0] * (len(total) - 2))
        each = [np.linalg.solve((total - s)[:-1, :-1] + reg, (total - s)[:-1, -1]) for s in want]
        error = sum((y[i] - phi(x[i : i + 1])[0] @ each[zlib.crc32(b"fold%d" % i) % quality.FOLDS]) ** 2 for i in range(90))
        fits.append((error, np.linalg.solve(total[:-1, :-1] + reg, total[:-1, -1])))
    best = min(fits, key=lambda f: f[0])[1]
    assert np.allclose(weights, best, atol=1e-6)


def test_isotonic():
    k, v = quality.isotonic(np.array([1.0, 2, 3, 4]), np.array([10.0, 10, 10, 10]), np.array([1.0, 5, 3, 9]))
    assert (np.diff(v) >= 0).all() and len(k) == 3 and k[1] == 2.5


# vectors


def brute_search(rows, queries, k=5):
    """rows: (id, vector); every query row against every other row, in plain integers."""
    from fractions import Fraction

    ok = [(i, [int(Fraction(x) * 256 // 1) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    big = lambda s: max(-(2**63), min(2**63 - 1, s))
    want = []
    for n, (q, a) in enumerate(ok):
        if queries(q):
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), -(2**63) if c is None else c, c) for m, (c, b) in enumerate(ok) if m != n and len(a) == len(b))
            want += [(q, j + 1, c, big(-s)) for j, (s, _, c) in enumerate(scored[:k])]
    return sorted(map(str, want))


def found(got):
    return sorted(map(str, ((x.query_id, x.rank, x.vec_id, x.score) for x in got.collect())))


@pytest.mark.parametrize("block", [7, 2048])
def test_vafile(spark, monkeypatch, block):
    monkeypatch.setattr(vafile, "BLOCK", block)
    monkeypatch.setattr(vafile, "QUERIES_BLOCK", block)
    r = np.random.default_rng(5)
    vs = r.normal(size=(260, 6)).tolist()
    vs[60], vs[61] = vs[50], vs[50]
    for i in range(130, 160):
        vs[i] = vs[100]
    rows = [(i, v, 0) for i, v in enumerate(vs)] + [(500, None, 1), (550, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (600, [float("nan")] * 6, 1), (650, [1e30] * 6, 1), (50, vs[50], 0), (700, [1.0, 2.0], 1), (701, [3.0, -2.0], 1), (None, [0.5] * 6, 2), (750, [], 3), (751, [], 3), (752, [1.7e308] * 6, 4), (753, [-1e300] * 6, 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x int")
    ints = vafile.integers(df)
    asked = lambda q: q is not None and q % 50 == 0
    got = vafile.search(ints.where("id % 50 = 0 and id < 10000000"), ints)
    assert found(got) == brute_search([x[:2] for x in rows], asked)
    assert vafile.search(ints.where("false"), ints).count() == 0 and vafile.search(ints.where("id = 0"), ints.where("false")).count() == 0


def test_vafile_large_components(spark):
    """Components and scores beyond 64 bits rank exactly."""
    rows = [(0, [1.0, 0.0]), (1, [1e16, 0.0]), (2, [2e16, 0.0]), (3, [2e16, 1.0]), (4, [-3e200, 5e199]), (50, [1 / 256, 0.0])]
    ints = vafile.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = vafile.search(ints.where("id % 50 = 0"), ints)
    assert found(got) == brute_search(rows, lambda q: q % 50 == 0)
    by = {(x.query_id, x.vec_id): x for x in got.collect()}
    assert by[0, 2].rank == 1 and by[0, 3].rank == 2 and by[0, 1].rank == 3 and by[50, 1].score == 2560000000000000000


def test_vafile_reads_few_exact_vectors(spark):
    r = np.random.default_rng(9)
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(3000, 16)))]
    ints = vafile.integers(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got, read = vafile.searched(ints.where("id % 50 = 0"), ints)
    assert got.count() == 300 and read.count() < 0.01 * 60 * 3000


def test_sortable():
    some = [0, 1, -1, 255, 256, -255, -256, 10**40, -(10**40), 2**64, -(2**64)]
    assert sorted(some, key=vafile.sortable) == sorted(some)


def test_bounds_hold():
    r = np.random.default_rng(2)
    v, q = r.normal(size=(500, 12)), r.normal(size=(9, 12))
    a = vafile.Approximation(v)
    for x in (a, vafile.Approximation.unpack(a.pack(), 500, 12)):
        low, up = x.bounds(q)
        assert (low <= q @ v.T).all() and (q @ v.T <= up).all() and (up - low).mean() < 0.1 * np.abs(q @ v.T).mean()


# mixing


def brute_targets(sizes, weights, most):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, held = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in held]
        left = total - sum(held.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return held | share
        held |= {s: most * sizes[s] for s in over}


def test_mixing(docs, none):
    rows, got = corpus(), mixing.mix(docs.withColumnRenamed("lang", "slice")).collect()
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(split(r[1]))
    want = brute_targets(sizes, (5, 2, 1), 3)
    assert len(got) == len(rows)
    by_size = {v: k for k, v in sizes.items()}
    taken = {}
    for r in got:
        s = by_size[r.source_size]
        assert abs(r.target - want[s]) < 1e-6 and r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0
        taken[s] = taken.get(s, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(2, 0.02 * want[s]), s
    key = lambda x: sorted((str(r.doc_id), r.size, r.taken) for r in x)
    assert key(mixing.mix(docs.repartition(3)).collect()) == key(got)
    assert mixing.mix(none).count() == 0
    assert sum(len(split(r.text)) for r in mixing.mixed(docs).collect()) == sum(taken.values())


def test_mixed_keeps_columns_of_rows_alike_in_id_and_text(spark):
    rows = [(1, "a b c d", "en", "s0", 7), (1, "a b c d", "de", "s1", 7), (1, "a b c d", None, "s1", 7), (2, "e f", "en", "s0", 3), (3, "g h i", "en", "s1", 5)]
    docs = spark.createDataFrame(rows, DOCS)
    # one weight of each source's own size: every row once
    got = mixing.mixed(docs, weights=(6, 11)).collect()
    assert sorted(map(str, got)) == sorted(map(str, docs.collect()))


def test_knapsack():
    r = np.random.default_rng(4)
    for _ in range(60):
        n = int(r.integers(1, 6))
        lengths, counts = np.unique(r.integers(0, 30, n)), None
        counts = r.integers(0, 5, len(lengths))
        budget = int(r.integers(0, 120))
        sums = {0}
        for x, c in zip(lengths.tolist(), counts.tolist(), strict=True):
            sums = {s + x * k for s in sums for k in range(c + 1)}
        best = max(s for s in sums if s <= budget)
        take = mixing._knapsack(lengths, counts, budget)
        assert (take <= counts).all() and (take >= 0).all() and int((take * lengths).sum()) == best
        take = mixing.fit(lengths, counts, budget)
        assert (take <= counts).all() and (take >= 0).all() and int((take * lengths).sum()) <= budget


# byte BPE


@pytest.mark.parametrize("leaf", [2, 17, 4096])
def test_bpe(leaf):
    import public_tokenizers as P

    c = byte_bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, leaf)
    r = random.Random(leaf)
    alphabet = list("aab '’s  \n\t.,1é中 　_🙂ß'Ll don't\r\n!?<|endoftext|>")
    for n in range(400):
        t = "".join(r.choice(alphabet) for _ in range(r.randrange(200)))
        assert c.encode(t) == c.core.encode_ordinary(t) and c.decode(c.encode(t)) == t.encode()


def test_bpe_table(docs, none):
    import public_tokenizers as P

    c = byte_bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = byte_bpe.digests(docs.withColumnRenamed("lang", "n_tokens")).collect()
    want = sorted((len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in corpus() for i in [c.core.encode_ordinary(r[1] or "")])
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    back = byte_bpe.decode(byte_bpe.encode(docs.select("text", "doc_id"))).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back)
    assert byte_bpe.digests(none).count() == 0


# HTML


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script></head><body class="has-sidebar"><header>Site</header>
<nav>menu</nav><div class="cookie-notice">cookies</div><article><header><h1>Title &amp; more</h1></header><p>one <b>two<br>three<p class=x>four&nbsp;five &#233;
<div class="ad">buy</div><aside>side</aside><form>search</form><p>six</p><footer>by me</footer>
<section id="comments"><article class="comment">nice</article><p>indeed</p></section><p>seven</article><div id=sidebar>more</div><footer>&copy; me"""


def test_html_blocks():
    assert html_text.choose([html_text.blocks(PAGE)], [1]) == ["Title & more\none two three\nfour five é\nsix\nseven"]
    for odd in ("", "plain", "<", "<p", "<p>a<", "<!-- x", "<script>x", "a<b", "<a href='x>y'>z", '<p title="a>b">c'):
        html_text.blocks(odd)
    assert [t for _, t in html_text.blocks('<p title="a>b">c')] == ["c"]


def test_html_repeats(spark):
    chrome, rows = "Read our weekly letter and stay in touch with us today", []
    for i in range(6):
        rows.append((i, f"http://h.example/{i}", f"<body><div>{chrome}</div><p>{' '.join(f'w{i}x{k}' for k in range(30))}</p></body>"))
    rows += [(9, "http://other.example/", f"<body><div>{chrome}</div></body>"), (10, None, None), (None, "bad", PAGE), (3, "http://h.example/3", rows[3][2])]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r.text for r in got}
    assert by[0] == " ".join(f"w0x{k}" for k in range(30)) and by[9] == chrome and by[10] == "" and by[None].startswith("Title & more")


def test_html_copies(spark):
    """Copies of a plain page are one page as evidence."""
    body = " ".join(f"w{k}" for k in range(30))
    rows = [(i, f"http://h.example/{i}", f"<body><p>{body}</p></body>") for i in range(3)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r.text for r in got] == [body] * 3


def test_html_repeats_over_shards(spark, monkeypatch):
    """What repeats on a host goes, however many shards it has; copies are one page there too."""
    monkeypatch.setattr(html_text, "SHARD_BYTES", 400)
    chrome, own = "Read our weekly letter and stay in touch with us today", lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [(i, f"http://h.example/{i}", f"<body><div>{chrome if i < 3 else ''}</div><p>{own(i)}</p></body>") for i in range(24)]
    rows += [(100 + i, f"http://h.example/{100 + i}", f"<body><p>{own(99)}</p></body>") for i in range(6)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: own(i) for i in range(24)} | {100 + i: own(99) for i in range(6)}


def page_text(html):
    return html_text.choose([html_text.blocks(html)], [1])[0]


def test_html_names():
    """Names that say what they name decide, names that hold a word are hints, and main elements keep what stands beside their articles."""
    assert page_text('<body><div class="main-menu"><a>Home</a></div><div id="content"><p>real</p></div></body>') == "real"
    assert page_text('<div class="main-nav">Home</div><p>real</p>') == "real"
    assert page_text('<div id="main"><div class="sidebar-left">side</div><p>real</p></div><p>other</p>') == "real"
    assert page_text('<article><p>a</p><section class="related-work"><p>b</p></section><div class="search-methods">c</div></article>') == "a\nb\nc"
    assert page_text("<main><p>lead</p><article>card</article></main>") == "lead\ncard"
    assert page_text('<article>a<div class="related">x</div><div class="share-links top">y</div><div role="search">z</div></article>') == "a"
    assert page_text('<div role="main">a<div role="complementary">b</div></div><div>c</div>') == "a"
    assert page_text('<div itemprop="articleBody"><p>a</p></div><p>b</p>') == "a"


def test_html_deep():
    """Time grows with the page, not with its depth."""
    began = time.time()
    n = 60_000
    assert page_text("<div>" * n + "<article>text</article>" + "</p></section>" * n) == "text"
    assert page_text("<article>" + "<p>x" * n + "</article>").count("x") == n
    assert time.time() - began < 10


def test_html_without_marks(spark):
    """Pages that mark nothing keep what is theirs; a marked article stays whole; hints need evidence."""
    menu, note, tail = "Home News Sports Weather Culture Travel Food Contact Help", "We use small files to make this site work for you", "All rights reserved by the people who made this site"
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(40))
    rows = [(i, f"http://plain.example/{i}", f"<body><div><div>{menu}</div></div><div><div>T{i}</div><div>{own(i)}</div></div><div>{tail}</div></body>") for i in range(5)]
    rows += [(10 + i, f"http://marked.example/{i}", f"<body><nav>{note}</nav><article><p>{own(10 + i)}</p><p>{note if i == 0 else 'more'}</p><p>{tail}</p><div class='related-work'>{menu}</div></article></body>") for i in range(5)]
    rows += [(20, "http://single.example/", f"<body><nav>{note}</nav><article><p>{note}</p><div class='related-work'>{menu}</div></article></body>")]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"T{i}\n{own(i)}" for i in range(5))
    # tail and note are the articles' own text, though other articles and menus hold them too; the hinted menu repeats
    assert got[10] == f"{own(10)}\n{note}\n{tail}" and all(got[10 + i] == f"{own(10 + i)}\nmore\n{tail}" for i in range(1, 5))
    assert got[20] == f"{note}\n{menu}"


def brute_html(rows):
    """(page_id, text): every page of a host against every other, run by run."""
    cut = [[(z, t.split(" ")) for z, t in html_text.blocks(h or "")] for _, _, h in rows]
    host = [re.match(r"\w+://([^/?#]*)", u or "")[1].lower() if re.match(r"\w+://", u or "") else "" for _, u, _ in rows]
    page = [r[0] if r[0] is not None else r[1] for r in rows]
    fate, stream = [], []
    for p in cut:
        zones = {z for z, _ in p}
        keep = {"A": "own", "M": "open", "H": "open"} if "A" in zones else {"M": "own", "H": "open"} if zones & {"M", "H"} else {"P": "open"}
        fate.append([keep.get(z, "gone") for z, w in p for _ in w])
        stream.append([x for _, w in p for x in w])
    # of rows with equal blocks on a host one page counts, which one is no matter
    counts = [min((page[j] for j in range(len(rows)) if host[j] == host[i] and cut[j] == cut[i]), key=str) for i in range(len(rows))]
    out = []
    for i, p in enumerate(cut):
        gone = [f == "gone" for f in fate[i]]
        for k in range(len(stream[i]) - 7):
            run, any_ = stream[i][k : k + 8], set()
            for j in range(len(rows)):
                if host[j] == host[i]:
                    for n in range(len(stream[j]) - 7):
                        if stream[j][n : n + 8] == run:
                            any_.add(counts[j])
            for n in range(k, k + 8):
                gone[n] |= fate[i][n] == "open" and len(any_) >= 3
        at, texts = 0, []
        for _, w in p:
            if left := [x for n, x in enumerate(w) if not gone[at + n]]:
                texts.append(" ".join(left))
            at += len(w)
        out.append((str(rows[i][0]), "\n".join(texts)))
    return sorted(out)


@pytest.mark.parametrize("shard", [1 << 21, 900])
def test_html_by_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(html_text, "SHARD_BYTES", shard)
    r = random.Random(13)
    passages = [" ".join(r.choice(WORDS) for _ in range(r.randrange(8, 14))) for _ in range(5)]
    some = lambda: r.choice(passages) if r.random() < 0.5 else " ".join(r.choice(WORDS) for _ in range(r.randrange(1, 16)))
    shapes = [
        "<nav>{}</nav><article><p>{}</p><p>{}</p></article><footer>{}</footer>",
        "<div>{}</div><div><p>{}</p>{}</div><div>{}</div>",
        "<aside>{}</aside><main><p>{}</p><article>{}</article></main><div class=ad>{}</div>",
        "<header>{}</header><article><p>{}</p><div class='related-work'>{}</div></article><form>{}</form>",
    ]
    rows = [(i, f"http://h{i % 3 if i % 2 else 0}.example/{i}", f"<body>{r.choice(shapes).format(some(), some(), some(), some())}</body>") for i in range(36)]
    rows += [(100 + i, "http://h0.example/x", rows[0][2]) for i in range(3)] + [(5, rows[5][1], rows[5][2]), (200, None, None), (None, "odd", rows[1][2]), (None, "http://h1.example/n", rows[3][2])]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((str(x.page_id), x.text) for x in got) == brute_html(rows)
    assert all(x.n_chars == len(x.text) for x in got)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_repeated_runs():
    r = np.random.default_rng(0)
    for _ in range(200):
        n, long, least = int(r.integers(0, 60)), int(r.integers(2, 8)), int(r.integers(2, 4))
        tokens, page = r.integers(0, 3, n), np.sort(r.integers(0, 4, n))
        want, at = np.zeros(n, bool), {}
        for i in range(n - long + 1):
            if page[i] == page[i + long - 1]:
                at.setdefault(tuple(tokens[i : i + long]), []).append(i)
        for v in at.values():
            if len({page[i] for i in v}) >= least:
                for i in v:
                    want[i : i + long] = True
        assert (html_text.repeated(tokens, page, long, least) == want).all()


# language


def brute_language(text, learned):
    """(language, score, rejected) by plain zstandard over every dictionary."""
    t = " ".join(re.findall(r"[^\W\d_]+", (text or "").lower()))
    if not t or not learned:
        return "und", 0.0, not t
    b, sizes = f" {t} ".encode(), []
    ends = [*range(0, max(1, len(b) - 2047), 2048), len(b)] if len(b) >= 2048 else [0, len(b)]
    for n, (lang, raw) in enumerate(learned.items()):
        p = zstandard.ZstdCompressionParameters.from_level(5, min_match=4, window_log=max(10, (len(raw) + 4096).bit_length()), write_content_size=False, write_checksum=False, write_dict_id=False)
        c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=p)
        sizes.append((sum(len(c.compress(b[i:j])) for i, j in zip(ends, ends[1:], strict=False) if j > i), n, lang))
    sizes.sort()
    gap = (sizes[1][0] - sizes[0][0]) / sizes[1][0] if len(sizes) > 1 else 1.0
    return sizes[0][2], gap / (gap + 0.004) if len(sizes) > 1 else 1.0, gap < 0.004


def test_language_by_brute_force(spark, docs):
    """Dictionaries hold the sampled documents whole; sizes are plain zstandard's; ties are rejected at any length."""
    learned = language_id.train(docs.where("doc_id is not null"))
    assert set(learned) == {"en", "fr"}
    for k, raw in learned.items():
        mine = [r[1] for r in corpus() if r[0] is not None and r[2] == k and re.search(r"[^\W\d_]", r[1] or "")]
        assert sorted(raw.decode().split("\n")) == sorted(" ".join(re.findall(r"[^\W\d_]+", t.lower())) for t in mine)
        assert language_id.train(docs, sample=3)[k].count(b"\n") == 2
    got = language_id.identify(docs, learned).collect()
    for r in got:
        lang, score, rejected = brute_language(r.text, learned)
        assert (r.lang_pred, r.lang_rejected) == (lang, rejected) and abs(r.lang_score - score) < 1e-9
    twice = {"a": learned["en"], "b": learned["en"]}
    assert language_id.classify("tie", language_id.compressors(twice)) == ("a", 0.0, True)


def test_language(spark, none):
    words = {"en": "the and of with this that from have were been which their would there could".split(), "de": "der die und nicht eine werden haben sich auch durch zwischen über müssen können".split(), "fr": "les des une dans pour avec cette être sont nous vous leur très après même".split()}
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(words[k]) for _ in range(r.randrange(30, 90))), k) for i, k in enumerate(["en", "de", "fr"] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = language_id.learned(docs)
    assert set(learned) == set(words)
    more = docs.unionByName(spark.createDataFrame([(900, None, None), (901, "12 345 !!", "en"), (902, "", "de"), (None, rows[0][1], "en"), (903, "the and of with this " * 4000, "en")], docs.schema))
    got = language_id.identify(more.withColumnRenamed("lang", "lang_score"), learned).collect()
    right = [x.lang_pred == rows[x.doc_id][2] for x in got if x.doc_id is not None and x.doc_id < 900]
    assert np.mean(right) > 0.98 and all(0 <= x.lang_score <= 1 for x in got)
    by = {x.doc_id: x for x in got}
    assert all(by[i].lang_pred == "und" and by[i].lang_rejected and by[i].lang_score == 0 for i in (900, 901, 902))
    assert by[903].lang_pred == "en"
    unlearned = {x.doc_id: x for x in language_id.identify(more.where("doc_id >= 900"), {}).collect()}
    assert unlearned[901].lang_rejected and not unlearned[903].lang_rejected and {x.lang_pred for x in unlearned.values()} == {"und"}
    assert language_id.learned(none) == {} and language_id.identify(none, {}).count() == 0
