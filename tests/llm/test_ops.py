"""Every operator against a plain version, and with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nacre.llm import langid, lines, minhash, mixing, packing, quality, rules, shards, substrings, vectors
from nacre.llm.common import components, held_out, held_out_py
from nacre.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard string, cut int"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
LINES = "alpha beta gamma\ndelta epsilon\nzeta eta theta iota\nkappa lambda"


def frame(spark, texts, ids=None, sources=None):
    """Rows of odd texts, with extra columns whose names clash with the operators' own."""
    rows = [(i if ids is None else ids[i], t, "en", None if sources is None else sources[i], None, 9.0, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [None, "", " \n\t", "one", LINES, LINES, LINES + "\nmore words here", LONG, "ünï çödé — 漢字 \x00   end", "a " * 300, "!!! *** %%%\n\n\n"]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD, sources=["s1", None, "s1", "s2", "s1", None, "s2", "s3", "s3", "s1", "s1"])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_hold_out(spark):
    ids = [0, 1, 2, 77, 10**15]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", held_out().alias("h")).collect()
    assert all(r.h == held_out_py(r.doc_id) == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_components(spark):
    edges = [(1, 2), (3, 2), (9, 8), (8, 7), (7, 20), (5, 5), (30, 31), (31, 30)] + [(100, k) for k in range(101, 160)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {k: got[k] for k in (1, 2, 3, 7, 8, 9, 20, 30, 31)} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 20: 7, 30: 30, 31: 30}
    assert all(got[k] == 100 for k in range(100, 160))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    a, b = QUERIES[name](spark, DATA).toPandas(), c.sql(SQL[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


# 1
def test_quality(spark, odd, empty):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    out = quality.classify(docs, labels.where(~held_out())).join(labels, "doc_id").where(held_out()).select("score", "predicted", "quality").toPandas()
    assert (out.predicted == out.quality).mean() > 0.9 and out.score.between(0, 1).all() and ((out.score >= 0.5) == (out.predicted == 1)).all()
    got = quality.classify(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert quality.classify(empty, labels).count() == 0
    none = quality.classify(odd, labels.limit(0)).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]


# 2
def test_packing(spark, odd, empty):
    got = packing.pack(odd).toPandas()
    tok = packing.WordTokenizer(packing.default_tokenizer(), 2)
    check_pack(got, {i: b for i, b in enumerate(tok(ODD))})
    assert packing.pack(empty).count() == 0
    docs = spark.read.parquet(f"{DATA}/documents.parquet").repartition(7)
    got = packing.pack(docs, group=4).toPandas()
    texts = {r.doc_id: r.text for r in docs.collect()}
    whole = {d: np.array(e.ids + [2], dtype="<u4").tobytes() for d, e in zip(texts, tok.tok.encode_batch([t or "" for t in texts.values()], add_special_tokens=False), strict=True)}
    check_pack(got, whole)
    used = got.groupby("sequence_id").length.sum()
    assert used.sum() / (4096 * len(used)) > 0.97


def check_pack(got, ids):
    for d, g in got.sort_values("start").groupby("doc_id"):
        assert g.start.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() == len(ids[d]) // 4 == g.doc_tokens.iloc[0]
        for r in g.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[d][4 * r.start : 4 * (r.start + r.length)])
    assert set(got.doc_id) == set(ids)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 4096


def test_pack_balances_cost():
    seqs = packing.assign([4000, 10, 3000, 3000, 96, 2000], 3, 4096)
    assert sum(n for s in seqs for _, _, n in s) == 12106 and all(sum(n for _, _, n in s) <= 4096 for s in seqs)


def test_pack_cuts_only_what_nothing_holds():
    """70 cheap sequences are left with room for 96; the dearest one has room for 1096 and takes the last item whole."""
    seqs = packing.assign([3000] + [400] * 701, 71, 4096)
    assert sorted((i, at, n) for s in seqs for i, at, n in s) == [(0, 0, 3000)] + [(i, 0, 400) for i in range(1, 702)]
    rng = np.random.default_rng(4)
    for _ in range(20):  # against trying every sequence
        lengths, k = rng.integers(1, 900, 600).tolist(), int(rng.integers(70, 90))
        room, spent, plain, todo = [4096] * k, [0.0] * k, [[] for _ in range(k)], sorted((-n, i, 0) for i, n in enumerate(lengths))
        while todo and any(room):
            left, i, at = todo.pop(0)
            s = min((s for s in range(k) if room[s] >= -left), key=lambda s: (spent[s], s), default=None)
            s = min((s for s in range(k) if room[s]), key=lambda s: (spent[s], s)) if s is None else s
            n = min(-left, room[s])
            plain[s].append((i, at, n))
            room[s], spent[s] = room[s] - n, spent[s] + packing.cost(n)
            if n < -left:
                todo = sorted([*todo, (left + n, i, at + n)])
        assert packing.assign(lengths, k, 4096) == plain


# 3
def test_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8))
    x[10:30] = x[0] + 0.15 * rng.normal(size=(20, 8))
    x[41] = x[40]
    rows = [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(x)]
    rows += [(60, None, 0), (61, [0.0] * 8, 0), (62, [1.0, None] * 4, 0), (63, [float("nan")] + [1.0] * 7, 0), (64, [float("inf")] * 8, 0), (65, [], 0), (66, [1.0, 2.0], 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in vectors.near_duplicates(d.withColumn("rep", F.lit(1)), 0.95).collect()}
    y = np.array([r[1] for r in rows[:60]], dtype=np.float32).astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    link = y @ y.T >= 0.95
    np.fill_diagonal(link, False)
    assert [got[i].n_links for i in range(60)] == link.sum(1).tolist() and got[40].n_links >= 1
    reach = np.linalg.matrix_power(link.astype(float) + np.eye(60), 60) > 0
    assert [got[i].component_id for i in range(60)] == [int(np.flatnonzero(r)[0]) for r in reach]
    assert all(got[i].n_links == 0 and got[i].kept and got[i].component_id == i for i in range(60, 67))
    assert vectors.near_duplicates(d.limit(0)).count() == 0


# 4
def test_rules(spark, odd, empty):
    got = {r.doc_id: r for r in rules.apply_rules(odd).collect()}
    assert len(got) == len(ODD)
    for i, t in enumerate(ODD):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        g = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        n = Counter(g)
        twice = {k + j for k, x in enumerate(g) if n[x] > 1 for j in range(8)}
        inked = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(inked) - len(set(inked)), len(twice))
        assert r.base_failed == (len(w) < 20 or 100 * len(twice) > 30 * len(w)) and (not r.kept or not r.base_failed)
    assert rules.apply_rules(empty).count() == 0


def test_bad_host_goes(spark):
    good = [" ".join(f"u{i}v{j}" for j in range(40)) for i in range(60)]
    bad = [" ".join(f"*{i}** #{j}" for j in range(40)) for i in range(30)]
    d = frame(spark, good + bad + good[:1], sources=["good"] * 60 + ["bad"] * 30 + ["bad"])
    got = rules.apply_rules(d).groupBy("host").agg(F.max(F.col("kept").cast("int")).alias("k"), F.max("rate").alias("rate")).collect()
    assert {r.host: r.k for r in got} == {"good": 1, "bad": 0}


# 5
def test_lines_odd(spark, odd, empty):
    got = {r.doc_id: r for r in lines.dedup(odd).collect()}
    assert got[0].text is None and got[4].text == LINES and got[5].text == "" and got[6].text == "more words here"
    assert got[6].n_removed == 4 and got[6].n_runs == 1 and got[7].text == LONG and got[10].text == ODD[10]
    assert lines.dedup(empty).count() == 0
    twice = lines.dedup(odd.union(odd)).where("doc_id = 4").collect()
    assert [r.text for r in twice] == [LINES, LINES]


def test_lines_short_runs(spark):
    """A repeated passage of two lines that has 50 words together goes, alone or among others; one of 49 words stays."""
    from corpus_pipeline import line_stage

    say = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    two, less = say("a", 30) + "\n" + say("b", 20), say("c", 30) + "\n" + say("d", 19)
    mixed = "head\n" + say("e", 60)
    texts = [two, less, mixed, f"own one\n{two}\nown two", f"own three\n \n{less}", f"{mixed}\nown four", two, say("a", 30) + "\n \n" + say("b", 20) + "\nend"]
    got = {r.doc_id: r.text for r in line_stage(spark, frame(spark, texts), DATA).collect()}
    assert got == {0: two, 1: less, 2: mixed, 3: "own one\nown two", 4: texts[4], 5: "own four", 7: " \nend"}


# 6
def test_shards(spark, odd, empty, tmp_path):
    s = shards.Store(spark, f"file://{tmp_path}/store", target=400_000)
    with pytest.raises(ValueError):
        s.read()
    for k in range(6):
        s.append(odd.where(F.col("doc_id") % 6 == k).coalesce(1))
    before = s.manifest()
    assert before["version"] == 6 and len(before["files"]) == 6
    s.compact(all_tiers=True)
    after = s.manifest()
    assert after["version"] > 6 and len(after["files"]) < 6
    assert sorted((r.doc_id, r.text or "") for r in s.read().collect()) == sorted((i, t or "") for i, t in enumerate(ODD))
    assert s.read(6).count() == len(ODD)  # older versions stay readable until vacuum
    assert s.vacuum() > 0 and s.read().count() == len(ODD)
    s.append(empty)
    other = shards.Store(spark, f"file://{tmp_path}/store", target=400_000)
    assert other.manifest()["version"] == s.manifest()["version"]


# 7
@pytest.mark.parametrize(("k", "num"), [(3, 85), (5, 80)])
def test_minhash(spark, k, num):
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 500, 120)]
    texts = list(ODD)
    for _ in range(60):
        w = list(base)
        for p in rng.integers(0, 120, int(rng.integers(0, 7))):
            w[p] = f"e{rng.integers(0, 9999)}"
        texts.append(" ".join(w))
    texts += [texts[20], texts[21].upper()]
    got = {r.doc_id: r for r in minhash.near_duplicates(frame(spark, texts), k, num, 100).collect()}

    def shingle(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    s = [shingle(t) for t in texts]
    part = list(range(len(s)))
    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= num * len(s[i] | s[j]) and part[i] != part[j]:
                lo, hi = sorted((part[i], part[j]))
                part = [lo if p == hi else p for p in part]
    assert [got[i].n_shingles for i in range(len(s))] == list(map(len, s))
    assert [got[i].component_id for i in range(len(s))] == part and all(got[i].kept == (part[i] == i) for i in range(len(s)))


@pytest.mark.parametrize("threshold", [0.8, 0.85])
def test_minhash_margin(threshold):
    """Links at the threshold pass the estimate unless it is off by six standard deviations, as the docstring says."""
    p = 0.25 + 0.75 * threshold
    assert minhash.margin(threshold) >= 6 * (p * (1 - p) / minhash.HASHES) ** 0.5 / 0.75 - 1e-12


def test_minhash_empty(spark, empty):
    assert minhash.near_duplicates(empty).count() == 0


# 8
def test_mixing(spark, odd, empty):
    got = mixing.mix(odd).toPandas()
    assert len(got) == len(ODD) and (got.taken <= 3 * got["size"]).all()
    by = got.groupby(got.source.fillna("~")).agg(target=("target", "first"), taken=("taken", "sum"), size=("size", "sum"))
    assert ((by.target - by.taken).abs() <= 1).all() and (by.target <= 3 * by["size"] + 1e-9).all() and by.target.sum() == pytest.approx(got["size"].sum())
    assert mixing.mix(odd).toPandas().sort_values("doc_id").equals(mixing.mix(odd.repartition(5)).toPandas().sort_values("doc_id"))
    assert mixing.mix(empty).count() == 0
    words = mixing.materialise(odd).select(F.coalesce("source", F.lit("~")).alias("s"), mixing.n_words().alias("n")).groupBy("s").agg(F.sum("n").alias("n")).collect()
    assert {r.s: r.n for r in words} == {k: v for k, v in by.taken.items() if v}
    assert mixing.materialise(odd).columns == odd.columns


def test_water_fill_of_many_sources(spark):
    """Ranks and targets of hundreds of sources against clamping round by round in plain fractions."""
    from fractions import Fraction

    rng = np.random.default_rng(6)
    for n in (1, 2, 400):
        letters = [c for c in rng.integers(65, 0x10FFF, 2 * n) if not 0xD800 <= c <= 0xDFFF]  # no surrogates
        names = [*(f"{chr(c)}{i}" for i, c in enumerate(letters[: n - 1])), None]
        size = {s: int(10 ** rng.uniform(0, 6)) * int(rng.integers(0, 5) > 0) for s in names}
        d = spark.createDataFrame(list(size.items()), "source string, source_size long").repartition(3)
        rank = {r.source: r["rank"] for r in mixing.numbered(d).collect()}
        assert rank == {s: i + 1 for i, s in enumerate(sorted(names, key=lambda s: (s is None, s)))}
        weight = {s: (k - 1) % 3 + 1 for s, k in rank.items()}
        got = {r.source: r.target for r in mixing.water_fill(spark.createDataFrame([(s, size[s], weight[s]) for s in names], "source string, source_size long, weight long")).collect()}
        full, total = set(), sum(size.values())
        while True:
            left, open_ = total - 3 * sum(size[s] for s in full), [s for s in names if s not in full]
            share = {s: Fraction(left * weight[s], sum(weight[x] for x in open_)) for s in open_}
            if not (more := {s for s in open_ if share[s] > 3 * size[s]}):
                break
            full |= more
        assert got == {s: float(3 * size[s]) if s in full else float(share[s]) for s in names} and (n < 400 or full)


# 9
def test_language(spark, odd, empty):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    train = docs.where(~held_out())
    out = langid.identify(docs, train).where(held_out()).toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.95 and out.score.between(0, 1).all()
    got = {r.doc_id: r for r in langid.identify(odd, train).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2, 10))
    assert langid.identify(empty, train).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, empty).collect()} == {"und"}


def test_language_spans():
    model = langid.Model([("aa", "kaka moka kamo mako oka " * 40), ("bb", "lilu relu lire luri ilu " * 40), ("ru", "привет мир да нет " * 40)])
    label = langid.Labeller(model)
    text = "kaka moka mako " * 20 + "relu lire ilu " * 20 + "привет мир " * 20
    lang, score, spans = label([text])[0]
    assert [(a, b) for a, b, _ in spans] == [(0, 60), (60, 60), (120, 40)] and [x for *_, x in spans] == ["aa", "bb", "ru"] and lang == "aa"
    rng = np.random.default_rng(0)
    for _ in range(30):  # the short cut and the full pass agree with trying every path
        s = rng.normal(size=(7, 3)) * rng.choice([1, 8])
        import itertools

        value = lambda p: sum(s[i, k] for i, k in enumerate(p)) - 4.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        assert value(langid.viterbi(s, 4.0)) == pytest.approx(max(map(value, itertools.product(range(3), repeat=7))))


def test_language_two_parts():
    """A then B, of which a third language C is the best single one: each part gains less than one switch, both together more."""
    import itertools

    s = np.array([[3.0, -9.0, 0.0], [0.0, -9.0, 0.0], [-9.0, 0.0, 0.0], [-9.0, 3.0, 0.0]])
    assert langid.viterbi(s, 4.0).tolist() == [0, 0, 1, 1]
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = 7
        s = np.where(np.arange(n)[:, None] < rng.integers(1, n), [1.0, -1.0, 0.4], [-1.0, 1.0, 0.4]) + rng.normal(size=(n, 3)) * 0.5
        value = lambda p: sum(s[i, k] for i, k in enumerate(p)) - 4.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        assert value(langid.viterbi(s, 4.0)) == pytest.approx(max(map(value, itertools.product(range(3), repeat=n))))


def test_language_fit(spark, monkeypatch):
    """Every language is learned, however many there are, and whole texts; of each language the lowest hashes' rows."""
    rows = [(i, f"word{chr(97 + i // 26)}{chr(97 + i % 26)} " * 9, f"l{i:03}") for i in range(230)] + [(230, "filler " * 700 + "beyond " * 9, "l000")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == [f"l{i:03}" for i in range(230)] and "beyond" in model.common
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text"), F.lit("en").alias("lang"))
    lowest = rows.orderBy(F.xxhash64("doc_id", F.lit(9))).limit(50).collect()
    seen = []
    monkeypatch.setattr(langid, "Model", seen.extend)
    langid.fit(rows, 50)
    assert sorted(t for _, t in seen) == sorted(r.text for r in lowest)
    seen.clear()
    langid.fit(rows.withColumn("doc_id", F.lit(None).cast("long")), 50)
    assert len(seen) == 50


def test_language_long_words():
    """All letters of a text without spaces count, not the first 40."""
    model = langid.Model([("aa", "kaka moka kamo mako oka " * 40), ("bb", "lilu relu lire luri ilu " * 40)])
    text = "lilurelulire" * 3 + "lilu" + "kakamokakamo" * 30
    assert "".join(langid.words(text)) == text and langid.words("x" * 40 + "y") == ["x" * 40, "y"]
    lang, _, spans = langid.Labeller(model)([text])[0]
    assert lang == "aa" and spans[-1][2] == "aa" and sum(n for _, n, _ in spans) == len(langid.words(text)) == 10


# 10
def plain_substrings(docs):
    first = defaultdict(lambda: 1 << 62)
    raw = [(d, (t or "").encode()) for d, t in docs]
    for d, b in raw:
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first[b[i : i + 50]], d)
    out = {}
    for d, b in raw:
        gone = set()
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone |= set(range(i, i + 50))
        kept = bytes(c for i, c in enumerate(b) if i not in gone)
        out[d] = (len(b), len(gone), sum(i - 1 not in gone for i in gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("small", [False, True])
def test_substrings(spark, empty, small, monkeypatch):
    rng = np.random.default_rng(2)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage, other = word(180), word(90)
    texts = [word(100) + passage + word(70), None, "", word(49), passage[20:120], word(60) + passage, "ab" * 200, "ab" * 200, word(30) + other + word(30) + passage[:70], other + "é" * 60, "é" * 40, passage + passage + other]
    texts += [word(20) + other[:60] + word(20) for _ in range(30)]
    ids = [5, 9, 2, 4, 7, 1, 11, 10, 3, 8, 6, 20, *range(30, 60)]
    if small:  # several blocks a shard, hot keys, tiny batches
        monkeypatch.setattr(substrings, "BLOCK_BYTES", 300)
        monkeypatch.setattr(substrings, "HOT_DOCS", 3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.dedup(frame(spark, texts, ids)).collect()}
    assert got == plain_substrings(list(zip(ids, texts, strict=True)))
    assert substrings.dedup(empty).count() == 0
    twice = substrings.dedup(frame(spark, [passage, passage], [1, 1])).select("n_removed").collect()
    assert [r.n_removed for r in twice] == [0, 0]


@pytest.mark.parametrize("letters", [1, 2, 4, 26])
def test_suffix_array(letters):
    rng = np.random.default_rng(letters)
    t = rng.integers(97, 97 + letters, 700).astype(np.uint8)
    t[350:500] = t[:150]
    sa, b = substrings.suffix_array(t, 200), t.tobytes()
    keys = [b[i : i + 200] for i in sa]
    assert keys == sorted(keys) and sorted(sa) == list(range(700))

    def common(x, y):
        k = 0
        while max(x, y) + k < 700 and b[x + k] == b[y + k]:
            k += 1
        return k

    assert substrings.common_prefixes(t, sa).tolist() == [0] + [common(x, y) for x, y in zip(sa[:-1], sa[1:], strict=True)]


def test_sorted_strings():
    """Only the strings asked for are sorted, by exactly the bytes that count; spans of all documents are merged at once."""
    rng = np.random.default_rng(5)
    for _ in range(60):
        t = rng.integers(97, 99, rng.integers(51, 300)).astype(np.uint8)
        t[len(t) // 2 :] = t[: len(t) - len(t) // 2]
        at = np.sort(rng.choice(len(t) - 49, rng.integers(1, len(t) - 48), replace=False))
        sa, first = substrings._sorted_suffixes(t, 50, at)
        names = [t.tobytes()[i : i + 50] for i in sa]
        assert names == sorted(names) and sorted(sa) == at.tolist()
        assert first.tolist() == [True] + [x != y for x, y in zip(names, names[1:], strict=False)]
    for _ in range(60):
        doc, mark, start = (rng.integers(0, k, 9) for k in (3, 2, 30))
        end = start + rng.integers(1, 9, 9)
        got = {(d, m): np.frombuffer(x, np.int64).reshape(2, -1).T.tolist() for d, m, x in substrings._span_rows(doc, mark, start, end)}
        assert set(got) == set(zip(doc.tolist(), mark.tolist(), strict=True))
        for (d, m), spans in got.items():
            covered = {i for a, b in zip(start[(doc == d) & (mark == m)], end[(doc == d) & (mark == m)], strict=True) for i in range(a, b)}
            assert {i for a, b in spans for i in range(a, b)} == covered and sum(i - 1 not in covered for i in covered) == len(spans)


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before, d = docs.count(), docs
    for name, stage in p.STAGES[:-1]:
        d = spark.createDataFrame(stage(spark, d, DATA).toPandas(), docs.schema)
        assert d.columns == docs.columns, name
    assert 0 < d.count() <= 3 * before
    pieces = p.STAGES[-1][1](spark, d, DATA)
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_pipeline_stages(spark):
    """Each stage after the classifier (which test_quality holds) against a plain version of its rule."""
    import corpus_pipeline as p

    rng = np.random.default_rng(8)
    say = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 9999, n))
    block, pair, long = [say(4) for _ in range(4)], [say(26), say(27)], say(55)
    texts = ["\n".join([say(30), *x, say(30)]) for x in (block, pair, [long], block[1:], block[:2], pair, ["", long, " "], pair[:1], block[::-1])]
    base = say(150).split()
    for k in (0, 2, 6, 40, 80):  # copies of one text with ever more words changed
        texts.append(" ".join(f"x{i}y{k}" if i < k else w for i, w in enumerate(base)))
    texts += ["\n".join(pair), texts[0], say(90), say(400)]
    ids = [int(x) for x in rng.permutation(len(texts))]
    docs = frame(spark, texts, ids, sources=[["a", "b", None][i % 3] if i < 15 else "c" for i in range(len(texts))]).select(*p.COLUMNS)
    now = {r.doc_id: r for r in docs.collect()}

    ink = lambda x: bool(x.strip(" \t\v\f\r"))
    seen, plain = set(), {}
    for d in sorted(now):
        at = [i for i, x in enumerate(now[d].text.split("\n")) if ink(x)]
        all_ = now[d].text.split("\n")
        gone = set()
        for n in (1, 2, 3):
            for i in range(len(at) - n + 1):
                run = tuple(all_[j] for j in at[i : i + n])
                if n == 3 or sum(len(x.split()) for x in run) >= 50:
                    gone |= set(at[i : i + n]) if run in seen else set()
                    seen.add(run)
        if len(gone) < len(at):
            plain[d] = "\n".join(x for i, x in enumerate(all_) if i not in gone)
    docs = spark.createDataFrame(p.line_stage(spark, docs, DATA).collect(), docs.schema)
    now = {r.doc_id: r for r in docs.collect()}
    assert {d: r.text for d, r in now.items()} == plain and len(plain) < len(texts)

    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, r in now.items() for w in [r.text.split()]}
    part = {d: d for d in now}
    for x in now:
        for y in now:
            if 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                lo, hi = sorted((part[x], part[y]))
                part = {d: lo if k == hi else k for d, k in part.items()}
    docs = spark.createDataFrame(p.near_duplicate_stage(spark, docs, DATA).collect(), docs.schema)
    assert {r.doc_id: r.text for r in docs.collect()} == {d: now[d].text for d in now if part[d] == d} and any(part[d] != d for d in now)

    now = {r.doc_id: r for r in docs.collect()}
    n = Counter()
    for r in now.values():
        n[r.source] += len(r.text.split())
    weight = {x: i % 3 + 1 for i, x in enumerate(sorted(n, key=lambda x: (x is None, x)))}
    target, open_ = {}, set(n)
    while True:
        left = sum(n.values()) - sum(target.values())
        share = {x: left * weight[x] / sum(weight[y] for y in open_) for x in open_}
        full = {x for x in open_ if share[x] > 3 * n[x]}
        if not full:
            break
        target |= {x: 3 * n[x] for x in full}
        open_ -= full
    target |= share
    mixed = p.mixing_stage(spark, docs, DATA).collect()
    took = Counter()
    for r in mixed:
        took[r.source] += len(r.text.split())
        assert now[r.doc_id].text.startswith(r.text) and r.source == now[r.doc_id].source
    assert set(took) == set(n) and all(abs(took[x] - target[x]) <= 1 for x in n)
    short = Counter(r.source for r in mixed if r.text != now[r.doc_id].text)
    assert all(k <= 1 for k in short.values())  # of a source, one copy at most is cut

    tok = packing.WordTokenizer(packing.default_tokenizer(), 2).tok
    whole = {d: np.array(tok.encode(r.text, add_special_tokens=False).ids + [2], dtype="<u4").tobytes() for d, r in now.items()}
    check_pack(p.packing_stage(spark, docs, DATA).toPandas(), whole)


# repeated rows, and what the operators' docstrings promise about them
def test_quality_vote_by_brute_force(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet").toPandas(), spark.read.parquet(f"{DATA}/labels.parquet").toPandas()
    known = docs.merge(labels.dropna(subset=["quality"]), on="doc_id").head(120)
    model = quality.Model(np.stack([quality.features(t) for t in known.text]), known.quality.to_numpy(float))
    texts = [*docs.text.head(60), None, "", "  ", "a"]
    want = []
    for t in texts:
        x = quality.features(t)[None]
        if not x.any():
            want.append(0.0)
            continue
        v = model.project(quality._weigh(x, model.idf))[0].astype(float)
        votes = sorted(((float(v @ u.astype(float)), k) for k, u in zip(model.labels, model.vectors, strict=True)), key=lambda z: -z[0])[: quality.NEIGHBOURS]
        weight = [max(c, 0) ** quality.SHARPNESS + 1e-9 for c, _ in votes]
        want.append(sum(w * k for w, (_, k) in zip(weight, votes, strict=True)) / sum(weight))
    assert model.score(texts, block=7) == pytest.approx(want, abs=0.08) and np.abs(model.score(texts) - want).mean() < 1e-3


def test_quality_words_count():
    """Texts of one shape that differ in their words alone are told apart."""
    good, bad = ["river stone", "stone cloud", "cloud river"], ["spam offer", "offer click", "click spamy"]
    texts = [f"{a} {b}" for g in (good, bad) for a in g for b in g]
    model = quality.Model(np.stack([quality.features(t) for t in texts]), np.array([1.0] * 9 + [0.0] * 9))
    assert (model.score(["cloud stone river stone", "spamy click offer click"]) >= 0.5).tolist() == [True, False]


@pytest.mark.parametrize("languages", [2, 3, 4, 5, 6])
def test_viterbi_by_brute_force(languages):
    import itertools

    rng = np.random.default_rng(languages)
    n = {2: 9, 3: 7, 4: 6, 5: 5, 6: 5}[languages]
    for _ in range(60):
        s = rng.normal(size=(n, languages)) * rng.choice([2, 6, 12])
        value = lambda p: sum(s[i, k] for i, k in enumerate(p)) - langid.SWITCH * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        assert value(langid.viterbi(s)) == pytest.approx(max(map(value, itertools.product(range(languages), repeat=n))))
    assert langid.viterbi(np.array([[0, 10, -20], [0, -20, 10]]), 12.0).tolist() == [1, 2]


def test_letters(spark):
    assert langid.words("½ ² ① Ⅷ 12 _ !") == [] and langid.words("हिन्दी में") == ["हिन्दी", "में"] and langid.words("ภาษาไทย") == ["ภาษาไทย"]
    rows = [(i, x) for i, x in enumerate(["½ ² ①", "漢字かな交じり文です", "สวัสดีครับ", "नमस्ते दुनिया", "kaka moka"])]
    train = [(10, "kaka moka mako " * 9, "aa"), (11, "今日は漢字とかなの文です" * 9, "ja"), (12, "สวัสดีครับภาษาไทย " * 9, "th"), (13, "नमस्ते दुनिया हिन्दी " * 9, "hi")]
    out = langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert [r.lang_pred for r in out.orderBy("doc_id").collect()] == ["und", "ja", "th", "hi", "aa"]


def test_compaction_by_two_writers(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    a, b = shards.Store(spark, root), shards.Store(spark, root)
    for _ in range(5):
        a.append(spark.range(10).repartition(1))
    commit, turns = a._commit, []

    def late(change):  # the other writer merges the same runs just before this one commits
        if not turns:
            turns.append(b.compact())
        return commit(change)

    monkeypatch.setattr(a, "_commit", late)
    assert a.compact() == 0 and turns == [1] and a.read().count() == 50
    version = a.manifest()["version"]
    assert a.append(spark.range(0))["version"] == version and shards.Store(spark, str(tmp_path / "other")).append(spark.range(0))["version"] == 1


def test_materialise_repeated_ids(spark):
    rows = [(7, "a b c d e f g h i j", "s")] * 4 + [(7, "k l m n o p q r s t", "s")] * 4 + [(None, "x y", "s"), (None, "x y", "t")] + [(i, "u v w", "t") for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    took = {r.source: r.n for r in mixing.mix(d).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    made = {r.source: r.n for r in mixing.materialise(d).withColumn("n", mixing.n_words()).groupBy("source").agg(F.sum("n").alias("n")).collect()}
    assert took == made


def test_minhash_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text), (5, "something else that nobody has at all"), (9, text), (3, text + " more"), (5, text), (2, "something else that nobody has at all")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=3, num=85).collect())
    assert got == [(2, 5, 2, True), (3, 59, 3, True), (5, 5, 2, False), (5, 58, 3, False), (5, 58, 3, False), (9, 58, 3, False)]


def test_near_duplicate_stage_keeps_unique_texts_of_repeated_ids(spark):
    import corpus_pipeline as p

    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "en", "s", 9), (2, text, "en", "s", 9), (2, "something of its own in seven words", "en", "s", 9), (4, "one two", "en", "s", 7), (4, "one two", "en", "s", 7), (None, None, None, None, None)]
    out = p.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), DATA)
    assert sorted((r.doc_id or 0, (r.text or "")[:9]) for r in out.collect()) == [(0, ""), (1, text[:9]), (2, "something"), (4, "one two")]


def test_pack_takes_the_cheapest_with_room():
    """Each item against a plain search of all sequences: the cheapest that holds it whole, else the cheapest with any room."""
    rng = np.random.default_rng(5)
    for _ in range(20):
        lengths, n, capacity = rng.integers(1, 400, 60).tolist(), int(rng.integers(20, 45)), 300
        room, spent, want = [capacity] * n, [0.0] * n, [[] for _ in range(n)]
        todo = sorted((-x, i, 0) for i, x in enumerate(lengths))
        while todo and any(room):
            left, i, at = todo.pop(0)
            left = -left
            fit = [s for s in range(n) if room[s] >= left] or [s for s in range(n) if room[s]]
            s = min(fit, key=lambda s: (spent[s], s))
            k = min(left, room[s])
            want[s].append((i, at, k))
            room[s] -= k
            spent[s] += packing.cost(k)
            if k < left:
                todo = sorted([*todo, (k - left, i, at + k)])
        assert packing.assign(lengths, n, capacity) == want


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op9"])
def test_repeated_rows(spark, name, odd):
    """Rows that come twice are judged alike, and each comes back."""
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(11)], "doc_id long, quality int, toxic int")
    twice = odd.union(odd)
    run = {
        "op1": lambda d: quality.classify(d, labels).select("doc_id", "score"),
        "op2": lambda d: packing.pack(d).groupBy("doc_id").agg(F.sum("length").alias("n")).select("doc_id", "n"),
        "op3": lambda d: vectors.near_duplicates(d.select(F.col("doc_id").alias("vec_id"), F.array(F.col("doc_id") + 1.0, F.lit(1.0)).alias("embedding"))).select("vec_id", "component_id"),
        "op4": lambda d: rules.apply_rules(d).select("doc_id", "n_repeat_words"),
        "op5": lambda d: lines.dedup(d).select("doc_id", "n_removed"),
        "op9": lambda d: langid.identify(d, d).select("doc_id", "lang_pred"),
    }[name]
    a, b = Counter(map(tuple, run(odd).collect())), Counter(map(tuple, run(twice).collect()))
    if name == "op2":
        assert b == Counter({(i, 2 * n): c for (i, n), c in a.items()})
    else:
        assert b == Counter({k: 2 * c for k, c in a.items()})
