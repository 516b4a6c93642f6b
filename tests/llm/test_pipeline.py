"""The pipeline against a plain version of its stages, and the entry module without it."""

import os
import random
import re
import shutil
import subprocess
import sys

import pytest

import corpus_pipeline
from terraframe.llm import byte_bpe, language_id, mixing, resemblance
from tests.llm.test_operators import brute_language, brute_targets

HERE = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
LANGS = {
    "en": "the and of with this that from have were been which their would there could should about".split(),
    "de": "der die und nicht eine werden haben sich auch durch zwischen über müssen können wurde nach".split(),
}


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    text = lambda lang, n: " ".join(r.choice(LANGS[lang]) + (str(r.randrange(90)) if r.random() < 0.3 else "") for _ in range(n))
    passage = text("en", 60)
    out = []
    for i in range(160):
        lang = "en" if i % 3 else "de"
        t = text(lang, r.randrange(40, 160))
        if i % 10 == 5:
            t += "\n" + passage
        out.append([i, t, lang, f"s{i % 4}", len(t)])
    for i in range(8):
        out.append([200 + i, out[i][1], out[i][2], "s1", out[i][4]])
    return [*map(tuple, out), (300, None, None, None, None), (301, "", "en", "s0", 0), (302, "123 456", "en", "s0", 7), (303, out[3][1].upper(), "en", "s2", 5)]


def shingle_set(text):
    w = split(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain(spark, rows):
    """(doc_id: times, texts) by loops over the rows; of the operators only the dictionaries of language ID are used."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    langs = language_id.learned(docs)
    rows = [r for r in rows if not brute_language(r[1], langs)[2]]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [shingle_set(r[1]) for r in rows]
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b, key=lambda k: rows[k][0])] = min(a, b, key=lambda k: rows[k][0])
    kept = [r for i, r in enumerate(rows) if find(i) == i]
    first, texts = {}, {}
    for r in sorted(kept):
        w = split(r[1])
        gone = set()
        for k in range(len(w) - 19):
            t = tuple(w[k : k + 20])
            if t in first:
                gone.update(range(k, k + 20))
            first.setdefault(t, r[0])
        texts[r[0]] = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else r[1]
    return {r[0]: (r[3], texts[r[0]]) for r in kept}


def test_pipeline(spark, rows, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    want = plain(spark, rows)
    assert 300 not in want and 302 not in want and not {200 + i for i in range(8)} & set(want)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), str(tmp_path / name))
        if n < 4:
            assert set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars"}
        if n == 2:
            assert {r.doc_id: (r.source, r.text) for r in docs.collect()} == want
            assert all(r.n_chars == len(r.text) for r in docs.collect())
    codec, got = byte_bpe.codec(), docs.collect()
    assert all(r.round_trip and list(r.ids) == codec.core.encode_ordinary(want[r.doc_id][1]) and r.n_tokens == len(r.ids) for r in got)
    sizes, taken = {}, {}
    for s, t in want.values():
        sizes[s] = sizes.get(s, 0) + len(split(t))
    for r in got:
        s, t = want[r.doc_id]
        taken[s] = taken.get(s, 0) + len(split(t))
    goal = brute_targets(sizes, mixing.WEIGHTS, mixing.MOST)
    assert all(abs(taken.get(s, 0) - goal[s]) <= max(2, 0.02 * goal[s]) for s in sizes)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in whole) == sorted((r.doc_id, r.n_tokens) for r in got)


@pytest.mark.parametrize("side", [2, 512])
def test_near_duplicates_by_similarity(spark, monkeypatch, side):
    """The stage links 5-word shingle sets at 0.8 or more, and no others, whatever the blocks of a bucket."""
    monkeypatch.setattr(resemblance, "SIDE", side)
    r, texts = random.Random(5), []
    for _ in range(12):
        w = [f"w{r.randrange(5000)}" for _ in range(r.randrange(60, 200))]
        for k in range(8):
            v = list(w)
            for _ in range(k):
                v[r.randrange(len(v))] = f"x{r.randrange(5000)}"
            texts.append(" ".join(v))
    texts += [texts[0].upper(), "a b", "a b", "A  b", "a c", "", None]
    sets = [shingle_set(t) for t in texts]
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    first = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if alike(sets[i], sets[j]) and first[i] != first[j]:
                lo, hi = sorted((first[i], first[j]))
                first = [lo if f == hi else f for f in first]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert len(set(first)) > 20 and sum(alike(a, b) and a != b for a in sets for b in sets) > 50
    assert sorted(x.doc_id for x in got) == sorted(set(first))


def test_buckets_are_settled(spark, monkeypatch):
    """Every two nodes of a bucket are of one component or compared, also where the leader is like nobody."""
    monkeypatch.setattr(resemblance, "SIDE", 3)
    r, texts = random.Random(8), []
    for _ in range(6):
        w = [f"w{r.randrange(5000)}" for _ in range(80)]
        texts += [" ".join(w), " ".join([*w, "tail"]), " ".join([*w[:-1], "end"])]
    texts += [" ".join(f"z{r.randrange(5000)}" for _ in range(40)) for _ in range(5)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    # one bucket for all
    one = resemblance.written(resemblance._sets(docs.selectExpr("doc_id + 1 as node", "cast(text as binary) as body"), 5))
    met = one.selectExpr("node", "1L as band")
    comps = spark.createDataFrame([(2, 1), (1, 1)], "node long, comp long")
    late = resemblance._split(met, comps).join(one, "node").groupBy("band", "i", "j").applyInArrow(lambda g: resemblance._met(g, resemblance.LEAST), "a long, b long").collect()
    parent = {i + 1: i + 1 for i in range(len(texts))}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in [(1, 2), *((x.a, x.b) for x in late)]:
        parent[find(a)] = find(b)
    classes = {frozenset(j for j in parent if find(j) == find(i)) for i in parent}
    assert classes == {frozenset((3 * k + 1, 3 * k + 2, 3 * k + 3)) for k in range(6)} | {frozenset((i + 1,)) for i in range(18, 23)}


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_library_stands_alone(tmp_path):
    """Without this subpackage and the pipeline the entry module still imports and has the other queries."""
    skip = shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache")
    shutil.copytree(HERE, tmp_path / "repo", ignore=skip)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'threshold_sweep' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    env = {**os.environ, "PYTHONPATH": ""}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=env, check=True, timeout=120)
