"""Each operator against a plain restatement on small awkward inputs, then its edge cases."""

from __future__ import annotations


import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from foliolink.llm import chat, common, components, decontaminate, html_text, language, lines, mixing, quality, queries, simhash, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, fp string, id string, dropped int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron".split()
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, texts, sources=None, ids=None):
    """Documents with extra columns whose names the operators use inside."""
    n = len(texts)
    rows = [((ids or range(n))[k], texts[k], "en", (sources or ["s"] * n)[k], "x", "y", 1) for k in range(n)]
    return spark.createDataFrame(rows, DOCS)


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def awkward():
    rng = random.Random(3)
    base = [sentence(rng, rng.randrange(5, 200)) for _ in range(25)]
    near = [b.replace("alpha", "alph", 1) for b in base[:10]]
    lined = ["\n".join(sentence(rng, 4) for _ in range(6)) + "\nshared line of text\n  Shared LINE of text \nshort" for _ in range(8)]
    return base + near + base[:5] + lined + [None, "", " \t\n", "one", "one two", "\n\n", "É ümlaut\x85x", sentence(rng, 30000), "a " * 4000, "###", "[INST] x </s> \\ [/INST]"]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_join_spread_is_the_join(spark, monkeypatch, how):
    """Hot keys, dealt to parts, give what the plain join gives."""
    monkeypatch.setattr(common, "LIGHT", 4)
    rng = random.Random(1)
    big = spark.createDataFrame([(rng.choice([1, 1, 1, 1, 2, 3, k, None]), k) for k in range(300)], "key int, row int")
    small = spark.createDataFrame([(k % 7, f"v{k}") for k in range(20)] + [(None, "x")], "key int, value string")
    counts = big.groupBy("key").agg(F.count("*").alias("n"))
    got = common.join_spread(big, small, ["key"], ["row"], counts, how)
    want = big.join(small, ["key"], how)
    assert got.columns == want.columns and Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_join_spread_runs_no_python(spark):
    """The table of hot keys is local: made of Python rows it would start Python workers on the executors."""
    big = spark.range(200).select((F.col("id") % 2).alias("key"), F.col("id").alias("row"))
    for counts in (big.groupBy("key").agg(F.count("*").alias("n")), big.groupBy("key").agg(F.lit(1).alias("n"))):  # both keys hot, none
        got = common.join_spread(big, big.select("key").distinct(), ["key"], ["row"], counts, "left")
        assert got.count() == 200
        assert "ExistingRDD" not in got._jdf.queryExecution().executedPlan().toString()


def test_rows_without_a_key_are_dealt(spark):
    """Most keys null: a left join keeps their rows, and no task has most of them."""
    big = spark.range(20_000).select(F.when(F.col("id") % 4 == 0, F.col("id") % 50).alias("key"), F.col("id").alias("row"))
    small = spark.range(50).select(F.col("id").alias("key"), (F.col("id") * 2).alias("value"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(kept, ("-1", "8", "false")):
            spark.conf.set(k, v)
        joined = common.join_spread(big, small, ["key"], ["row"], big.where("key is not null").groupBy("key").agg(F.count("*").alias("n")), "left")
        sizes = [r.n for r in joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == 20_000 and max(sizes) < 5_000
        assert joined.where("key is null").agg(F.count("*"), F.count("value")).first()[:] == (15_000, 0) and joined.where("value = 2 * key").count() == 5_000
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


# ---- 1 SimHash ---------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    ones = Counter(b for s in shingles for h in [xxhash.xxh64_intdigest(s.encode(), seed=42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b, n in ones.items() if 2 * n > len(shingles))


def plain_components(keys, linked):
    root = {k: k for k in keys}
    changed = True
    while changed:
        changed = False
        for a in keys:
            for b in keys:
                if linked(a, b) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return root


def test_simhash_matches_brute_force(spark, awkward):
    prints = [plain_fingerprint(t) for t in awkward]
    root = plain_components(range(len(awkward)), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs(spark, awkward)).collect()}
    assert got == {k: (prints[k], root[k]) for k in root}


@pytest.mark.parametrize("seed,crowded", [(0, 1024), (1, 1024), (2, 3), (3, 10), (4, 0)])
def test_multi_index_pairs(spark, seed, crowded):
    rng = random.Random(seed)
    centre = rng.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 6))) for _ in range(120)} | {0, 2**64 - 1, 1 << 63, 7}
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    got = [tuple(sorted((r.a % 2**64, r.b % 2**64))) for r in simhash.near_pairs(spark.createDataFrame([(p,) for p in signed], "fp long"), crowded=crowded).collect()]
    want = {(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3}
    assert len(got) == len(set(got)) and set(got) == want


def test_components_of_chains_and_stars(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1100)] + [(5000, 5000), (None, 3), (7, 6), (7, 6)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(201)} | {k: 1000 for k in range(1000, 1100)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_edges(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    rows = docs(spark, ["a b c", "a b c", None, "", "a b c"], ids=[None, 4, 9, 8, 4])
    got = sorted((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(rows).collect())
    assert got == [("4", 4), ("4", 4), ("8", 8), ("9", 8), ("None", 4)]
    assert sorted(str(r.doc_id) for r in simhash.keep_one(rows).collect()) == ["4", "4", "8", "None"]
    assert simhash.keep_one(rows).columns == rows.columns


def plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b) > 0


def test_near_duplicate_stage_finds_all_at_similarity(spark, awkward):
    """The stage against brute force over 5-word shingles: texts at 0.8 to 1, chains and a crowded group, of which SimHash's 3 bits miss most."""
    import corpus_pipeline

    rng = random.Random(9)
    texts = list(awkward)
    for k in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(6, 150))]
        texts.append(" ".join(words))
        for _ in range(2):
            words = list(words)
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    base = [f"g{k}" for k in range(80)]
    texts += [" ".join(base[:at] + [f"x{at}"] + base[at + 1 :]) for at in range(0, 80, 2)]
    sets = [plain_shingles(t) for t in texts]
    root = plain_components(range(len(texts)), lambda a, b: alike(sets[a], sets[b]))
    rows = docs(spark, texts)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(rows).collect()}
    assert got == root
    kept = corpus_pipeline.near_duplicate_stage(spark, rows, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root.values())) and kept.columns == rows.columns


@pytest.mark.parametrize("brief", [1, 16])
def test_shared_passages_are_no_near_copies(spark, monkeypatch, brief):
    """Nothing is known of frequencies, so passages that many texts share lie in their prefixes; the dealt join loses no pair of them."""
    rng = random.Random(12)
    passages = [" ".join(f"p{k}w{rng.randrange(10**4)}" for _ in range(30)) for k in range(3)]
    texts = []
    for k in range(120):
        own = [f"own{rng.randrange(10**7)}" for _ in range(rng.randrange(5, 60))]
        texts.append(" ".join([*own, passages[k % 3], *own[:3]]))
        if k % 4 == 0:
            own[rng.randrange(len(own))] = "changed"
            texts.append(" ".join([*own, passages[k % 3], *own[:3]]))
    monkeypatch.setattr(simhash, "common_shingles", lambda *_: (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    monkeypatch.setattr(simhash, "BRIEF", brief)
    monkeypatch.setattr(common, "HEAVY", 64)
    stored = {}
    keep = simhash.store
    monkeypatch.setattr(simhash, "store", lambda df, name: stored.setdefault(name, []).append(keep(df, name)) or stored[name][-1])
    sets = [plain_shingles(t) for t in texts]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs(spark, texts)).collect()}
    assert got == plain_components(range(len(texts)), lambda a, b: alike(sets[a], sets[b]))
    if brief == 16:  # passages alone make no pairs: of some 3 * 50**2 / 2 only what the sketches can't tell
        assert stored["candidates"][-1].count() < 300


def test_common_shingles_count_every_text(spark):
    rng = random.Random(2)
    texts = [f"{sentence(rng, 30)} a b c d e" for _ in range(40)] + ["copy of the same words"] * 30
    found, n = simhash.common_shingles(docs(spark, texts).coalesce(1), "text", 5, 42)
    counts = Counter(h for t in set(texts) for h in simhash.shingle_hashes(t).tolist())
    assert dict(zip(found.tolist(), n.tolist())) == {h: k for h, k in counts.items() if k >= 8}


def test_repeated_shingles():
    for texts in ([], [None], ["", ""], ["a", "a"], ["a b"] * 3 + ["c"], ["a b c d e f g", "b c d e f q", "A b c d e"], ["x y", "z", None, "x y", "w", "z", "z"]):
        counts = Counter(h for t in texts for h in simhash.shingle_hashes(t).tolist())
        found, n = simhash.repeated_shingles(pd.Series(texts, dtype=object))
        assert list(zip(found.tolist(), n.tolist())) == sorted((h, k) for h, k in counts.items() if k > 1)


def test_near_copies_take_one_python_worker_a_task(spark, monkeypatch):
    """Two Python functions in one task are two workers, which an executor keeps."""
    plans = {}

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return common.store(df, name)

    monkeypatch.setattr(simhash, "store", kept)
    text = " ".join(f"w{k}" for k in range(60))
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs(spark, [text, f"{text} more", "another text"])).collect()}
    assert got == {0: 0, 1: 0, 2: 2}
    found = {name: len(re.findall("ArrowEvalPython|BatchEvalPython|MapInPandas", plan)) for name, plan in plans.items()}
    assert found["shingle_sets"] == found["shingles"] == 1 and max(found.values()) == 1


def test_near_copies_edges(spark):
    assert simhash.near_copies(docs(spark, [])).count() == 0
    rows = docs(spark, ["a b c", "A b\tc", None, "", "a b c"], ids=[None, 4, 9, 8, 4])
    got = sorted((str(r.doc_id), r.component_id) for r in simhash.near_copies(rows).collect())
    assert got == [("4", 4), ("4", 4), ("8", 8), ("9", 8), ("None", 4)]


def test_parity_sketches_lose_no_pair(spark):
    rng = np.random.default_rng(4)
    rows = []
    for n in (1, 3, 63, 64, 65, 130, 500, 2049):
        for gone in (0, 1, n // 10, n // 2):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**63, rng.integers(0, n), dtype=np.uint64)]))
            differ = len(np.setxor1d(a, b))
            rows.append((simhash.parity_sketch(a).tolist(), simhash.parity_sketch(b).tolist(), differ))
            rows.append((rows[-1][1], rows[-1][0], differ))
    got = spark.createDataFrame(rows, "a array<long>, b array<long>, differ int").select("differ", simhash._apart(F.col("a"), F.col("b")).alias("apart")).collect()
    assert len(got) == len(rows) and all(r.apart <= r.differ and (r.apart - r.differ) % 2 == 0 for r in got)
    assert any(r.apart > r.differ / 2 > 20 for r in got)


# ---- 2 mixing ----------------------------------------------------------------------------


def plain_targets(sizes, total, cap=2.0):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full = set()
    while True:
        open_weight = sum(weight[s] for s in order if s not in full)
        level = (total - sum(cap * sizes[s] for s in full)) / open_weight if open_weight else 0
        more = {s for s in order if s not in full and level * weight[s] > cap * sizes[s]}
        if not more:
            return {s: cap * sizes[s] if s in full else level * weight[s] for s in order}
        full |= more


def test_mixing(spark, awkward):
    rng = random.Random(2)
    names = [rng.choice(["a", "b", "B", "é", None, "zz", "z"]) for _ in awkward]
    rows = docs(spark, awkward, names)
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in awkward]
    of = defaultdict(int)
    for s, n in zip(names, size):
        of[s] += n
    target = plain_targets(of, 1.5 * sum(size))
    got = mixing.mix(rows).collect()
    assert len(got) == len(awkward)
    taken = Counter()
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == of[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken == r.repeats * r.size and 0 <= r.repeats <= 2
        taken[r.source] += r.taken
    for s, n in target.items():
        assert abs(taken[s] - n) <= max(k for k, name in zip(size, names) if name == s)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(rows.repartition(7)).collect()), key=str)


def test_mixed_rows_are_the_mix(spark, awkward):
    """Each row as often as mix says, and nothing, empty texts included, more than max_epochs times."""
    rng = random.Random(7)
    names = [rng.choice(["a", "b", "B", None, "zz"]) for _ in awkward]
    rows = docs(spark, awkward, names).withColumnRenamed("fp", "slot").withColumnRenamed("id", "of")
    want = Counter({r.doc_id: r.repeats for r in mixing.mix(rows).collect()})
    got = mixing.mixed_rows(rows)
    assert got.columns == [*rows.columns, "repetition"]
    made = got.collect()
    assert Counter(r.doc_id for r in made) == +want and max(want.values()) <= 2
    assert all(r.text == awkward[r.doc_id] and r.source == names[r.doc_id] for r in made)
    empty = docs(spark, ["a b c d e f"] * 3 + [""] * 3000, ["x"] * 3003)
    assert {r.repeats for r in mixing.mix(empty, epochs=5.0).collect()} == {2}


def test_mixing_edges(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    assert {r.taken for r in mixing.mix(docs(spark, [None, "", " "])).collect()} == {0}
    rows = docs(spark, ["a b c d"] * 8, ["x"] * 4 + [None] * 4, [1, 1, 1, None, 2, 3, 4, 5])
    out = mixing.mixed_rows(rows)
    assert out.columns == [*rows.columns, "repetition"]
    assert 10 <= out.count() <= 16
    capped = mixing.water_fill(spark.createDataFrame([("a", 10, 1.0), ("b", 0, 1.0), ("c", 5, 0.0)], "source string, source_size long, weight double"), 100.0)
    assert {r.source: r.target for r in capped.collect()} == {"a": 20.0, "b": 0.0, "c": 0.0}


# ---- 3 language --------------------------------------------------------------------------

TEXT = {
    "en": "the cat sat on the mat and then it went out of the house with another animal",
    "de": "der hund und die katze gehen nicht aus dem haus weil es schon sehr spät ist",
    "es": "el perro y la gata no quieren salir de la casa porque está lloviendo mucho",
}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(k, " ".join(random.Random(k).sample(t.split(), 10)), lang) for lang, t in TEXT.items() for k in range(30)]
    return language.train(spark.createDataFrame(rows + [(99, None, "en"), (98, "x", None), (97, "x", " ")], "doc_id long, text string, lang string"))


def test_language(spark, model):
    pages = [
        (1, "https://a.example.de/x", f'<html lang="en"><p>{TEXT["de"]}</p></html>'),
        (2, "https://a.example.de/y", f"<html><p>{TEXT['de']}</p></html>"),
        (3, "https://a.example.de/z", "<html><p></p></html>"),
        (4, None, None),
        (5, "nonsense", f"<script>{TEXT['es']}</script><p>{TEXT['en']}</p>"),
        (5, "nonsense", f"<script>{TEXT['es']}</script><p>{TEXT['en']}</p>"),
        (None, "http://B.example.ES:80/", f'<HTML LANG=es-MX><p>{TEXT["es"]}'),
    ] + [(10 + k, f"https://a.example.de/{k}", f'<html lang="de">{TEXT["de"]}</html>') for k in range(20)]
    rows = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, score string")
    got = defaultdict(list)
    for r in language.page_languages(rows, model).collect():
        got[r.page_id].append(r)
    assert got[1][0].lang == got[2][0].lang == "de" and got[1][0].declared == "en" and got[1][0].host == "a.example.de"
    assert got[3][0].lang == "de" and got[3][0].text_lang is None  # the host's prior alone
    assert got[4][0].lang == "und" and got[4][0].n_grams == 0
    assert [r.lang for r in got[5]] == ["en", "en"]
    assert got[None][0].lang == "es" and got[None][0].declared == "es" and got[None][0].suffix == "es"
    assert language.page_languages(rows.limit(0), model).count() == 0


def test_language_posterior_is_bayes(spark, model):
    """One row without host or suffix: text times overall prior times declared table, by hand."""
    import numpy as np

    texts = [TEXT["en"], TEXT["de"], TEXT["es"], TEXT["en"] + " y la"]
    rows = spark.createDataFrame([(k, t, d) for k, (t, d) in enumerate(zip(texts, ["en", "de", "es", "es"]))], "doc_id long, text string, d string")
    got = {r.doc_id: r.confidence for r in language.identify(rows, model, "doc_id", "text", F.col("d"), effective=5).collect()}
    scores = [model.score(t, 5)[0] for t in texts]
    post = np.array([np.exp(s - s.max()) / np.exp(s - s.max()).sum() for s in scores])
    base = (post.sum(0) + 1) / (post.sum() + 3)
    declared = {d: post[[k for k, x in enumerate(["en", "de", "es", "es"]) if x == d]].sum(0) for d in ("en", "de", "es")}
    for k, d in enumerate(["en", "de", "es", "es"]):
        p = np.exp(scores[k] - scores[k].max()) * base * (declared[d] + 0.5) / (post.sum(0) + 0.5 * 4)
        assert got[k] == pytest.approx((p / p.sum()).max(), abs=2e-5)


def test_language_priors_are_hierarchical(spark, model):
    """Host and suffix evidence by hand: the suffix's prior smoothed with the overall one, the host's with the suffix's, a row's own part taken out."""
    import numpy as np

    rng = random.Random(12)
    rows = []
    for k in range(40):
        suffix = rng.choice(["de", "es", None])
        host = rng.choice([f"a.{suffix}", f"b.{suffix}", None])
        rows.append((k, rng.choice([*TEXT.values(), ""]), rng.choice(["en", "de", None]), suffix, host))
    table = spark.createDataFrame(rows, "doc_id long, text string, d string, s string, h string")
    got = {r.doc_id: r for r in language.identify(table, model, "doc_id", "text", F.col("d"), F.col("s"), F.col("h"), effective=4).collect()}
    score = np.array([model.score(t, 4)[0] for _, t, *_ in rows])
    seen = np.array([float(model.score(t, 4)[1] > 0) for _, t, *_ in rows])
    post = np.exp(score - score.max(1, keepdims=True))
    post = post / post.sum(1, keepdims=True) * seen[:, None]
    base = (post.sum(0) + 1) / (post.sum() + 3)
    kinds = len({d for _, _, d, *_ in rows if d})
    for k, (_, text, d, s, h) in enumerate(rows):
        same = lambda test: post[[j for j, r in enumerate(rows) if j != k and test(r)]].sum(0)
        prior = base
        if s is not None:
            left = same(lambda r: r[3] == s)
            prior = (left + 20 * prior) / (left.sum() + 20)
        if h is not None:
            left = same(lambda r: r[4] == h and r[3] == s)
            prior = (left + 20 * prior) / (left.sum() + 20)
        p = np.exp(score[k] - score[k].max()) * prior
        if d is not None:
            told = post[[j for j, r in enumerate(rows) if r[2] == d]].sum(0)
            total = post[[j for j, r in enumerate(rows) if r[2]]].sum(0)
            p = p * (told + 0.5) / (total + 0.5 * (kinds + 1))
        p = p / p.sum()
        assert got[k].confidence == pytest.approx(p.max(), abs=2e-5), rows[k]
        known = bool(text) or d or s or h
        assert got[k].lang == (model.languages[int(p.argmax())] if p.max() >= 0.5 and known else "und")


def test_language_filter(spark):
    texts = [TEXT["en"]] * 10 + [TEXT["de"]] * 10 + [None, "", "12 !!"]
    rows = spark.createDataFrame([(k, t, "de" if t == TEXT["de"] else "en", None) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    kept = language.keep_identified(rows)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(20)) and kept.columns == rows.columns
    assert language.keep_identified(rows.limit(0)).count() == 0


#: Texts in no language of TEXT: other languages and scripts, random letters.
FOREIGN = [
    "日本語の文章です。これはテストです、よろしくお願いします",
    "Привет мир, это русский текст для проверки языка",
    "xkcd qwrtz bcdfg hjklm pqrst vwxzk lmnbv gfdsq zxcvb",
    "tämä on suomenkielinen lause jota malli ei ole nähnyt",
]


def test_language_open_set(spark, model):
    """Texts of no trained language are und in documents and pages, whatever is declared; a text of garbage among the labelled changes nothing."""
    texts = [t for t in TEXT.values() for _ in range(10)] + FOREIGN
    langs = [k for k in TEXT for _ in range(10)] + ["en"] * len(FOREIGN)
    rows = spark.createDataFrame([(k, t, d, "s") for k, (t, d) in enumerate(zip(texts, langs))], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in language.identify(rows, model, "doc_id", "text", F.col("lang"), None, F.col("source")).collect()}
    assert [got[k].lang for k in range(30)] == langs[:30]
    assert {(got[k].lang, got[k].confidence, got[k].text_lang) for k in range(30, len(texts))} == {("und", 0.0, None)}
    pages = spark.createDataFrame([(k, "http://a.example.de/", f'<html lang="de"><p>{t}') for k, t in enumerate([TEXT["de"], *FOREIGN])], "page_id long, url string, html string")
    assert [r.lang for r in language.page_languages(pages, model).orderBy("page_id").collect()] == ["de"] + ["und"] * len(FOREIGN)
    assert {r.doc_id for r in language.keep_identified(rows).collect()} == set(range(30))


def test_language_beyond_the_bound(spark):
    """Rows in labels beyond max_languages are und, not one of the languages within."""
    more = TEXT | {"fi": "tämä on suomenkielinen lause jota malli oppii vain yhteisenä muiden kanssa tässä", "tr": "bu cümle türkçe yazılmış ve dil tanıma için kullanılan bir örnektir"}
    rows = spark.createDataFrame([(100 * i + k, t, lang) for i, (lang, t) in enumerate(more.items()) for k in range(20 - i)], "doc_id long, text string, lang string")
    model = language.train(rows, max_languages=3)
    got = {(r.text, r.lang) for r in language.identify(rows, model, "doc_id", "text").join(rows.select("doc_id", "text"), "doc_id").collect()}
    assert got == {(t, lang if lang in TEXT else "und") for lang, t in more.items()} and len(model.languages) == 4


# ---- 4 chat ------------------------------------------------------------------------------


def test_chat_round_trip(spark, awkward):
    rng = random.Random(1)
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\[INST]", "[[INST]]", "<<s>", "[/ROLE", "<\\/s>", "", None, "[", "a\n[ANS]b</s", "$1 \\2"] + awkward
    rows, want = [], defaultdict(list)
    for conv in range(60):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "system", "tool", None, "[INST]", ""])
            text = rng.choice(nasty)
            rows.append((conv, turn, role, text, "x"))
            want[conv].append((role or "", text or ""))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    made = chat.format_conversations(df.repartition(5))
    got = made.select("conv_id", "n_turns", "valid", "state", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("segments")).alias("loss")).collect()
    assert len(got) == 60
    for r in got:
        turns = want[r.conv_id]
        assert [tuple(t) for t in r.t] == turns and r.n_turns == len(turns)
        assert r.loss == "".join(t for role, t in turns if role == "assistant")
        roles = [role for role, _ in turns]
        legal = re.fullmatch(r"s?(ua)+", "".join({"system": "s", "user": "u", "assistant": "a"}.get(x, "?") for x in roles)) is not None
        assert r.valid == legal, roles


def test_chat_edges(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(df).count() == 0
    ties = spark.createDataFrame([(None, 1, "user", "b"), (None, 1, "user", "a"), (None, None, "user", "z")], df.schema)
    r = chat.format_conversations(ties).first()
    assert r.n_turns == 3 and r.conv_id is None and re.findall(r"\[INST\](.)", r.formatted) == ["z", "a", "b"] and r.state == "error"


# ---- 5 URLs ------------------------------------------------------------------------------

RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def test_urls(spark):
    listed = spark.createDataFrame([(f"bad.net/{k}",) for k in range(500)] + [(None,), ("bad.net/1",)], "url_key string")
    cases = [
        ("https://www.example.org/es/x", "www.example.org", "/es/x", "example.org/es/", "block"),
        ("HTTP://Sub.EXAMPLE.org/en/12?q#f", "sub.example.org", "/en/12", "example.org/en/1", "block"),
        ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        ("http://example.org", "example.org", "", None, "allow"),
        ("http://a.com/de/1#x://y", "a.com", "/de/1", "com/de/", "block"),
        ("http://www.bad.net/7/?utm=1", "www.bad.net", "/7/", None, "block"),
        ("https://bad.net/777", "bad.net", "/777", None, "allow"),
        ("bad.net/7", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("x://", "", "", None, "allow"),
    ]
    rows = spark.createDataFrame([(k, c[0], "h", True) for k, c in enumerate(cases)] * 2, "page_id long, url string, host string, listed boolean")
    got = urls.judge(rows, listed, RULES).collect()
    assert len(got) == 2 * len(cases)
    for r in got:
        assert (r["_host"], r["path"], r["rule"], r["verdict"]) == cases[r.page_id][1:] and r.host == "h"
    assert {r.verdict for r in urls.judge(rows, listed.limit(0), RULES).where("rule is null").collect()} == {"allow"}
    assert urls.judge(rows.limit(0), listed, RULES).count() == 0


def test_bloom_never_misses(spark):
    keys = spark.range(3000).select(F.concat(F.lit("h/"), F.col("id")).alias("k"))
    words, blocks = urls.bloom_filter(keys, "k")
    assert words.count() <= blocks
    probe = spark.range(6000).select(F.concat(F.lit("http://h/"), F.col("id")).alias("url"), "id")
    hit = urls.listed_hits(probe, keys, "url", "k")
    assert hit.where("listed <> (id < 3000)").count() == 0 and hit.count() == 6000


def test_bloom_false_hits_are_few(spark):
    """Of keys that aren't in the list, the filter alone lets through a few in a hundred; the exact join takes those out."""
    keys = spark.range(20000).select(F.concat(F.lit("h/"), F.col("id")).alias("k"))
    words, blocks = urls.bloom_filter(keys, "k")
    others = spark.range(20000, 60000).select(F.concat(F.lit("h/"), F.col("id")).alias("k"))
    both = others.join(words, urls._block(F.col("k"), blocks) == words["block"], "left")
    need = urls._bits(F.col("k"))
    assert both.where(F.col("word").bitwiseAND(need) == need).count() < 0.05 * 40000
    probe = others.select(F.concat(F.lit("http://"), "k").alias("url"))
    assert urls.listed_hits(probe, keys, "url", "k").where("listed").count() == 0


# ---- 6 toxicity --------------------------------------------------------------------------


def test_toxicity_learns_and_holds_out(spark):
    rng = random.Random(4)
    texts, labels = [], []
    for k in range(600):
        bad = k % 4 == 0
        words = [rng.choice(WORDS) for _ in range(rng.randrange(5, 60))]
        for _ in range(3 if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["nasty", "vile", "foul"]))
        texts.append(" ".join(words))
        labels.append((k, int(bad)))
    rows = docs(spark, texts + [None, "", "123"], ids=[*range(600), 600, 601, None])
    label = spark.createDataFrame([*labels, (None, 1), (3, None), (3, 0)], "doc_id long, toxic int")
    got = toxicity.score_documents(rows, label).collect()
    assert len(got) == 603
    by_id = {r.doc_id: r for r in got}
    wrong = [k for k, y in labels if by_id[k].held_out and by_id[k].predicted != y]
    assert sum(by_id[k].held_out for k, _ in labels) > 60 and len(wrong) <= 3
    assert all(0 <= r.score <= 1 for r in got) and by_id[600].score == by_id[601].score == by_id[None].score and not by_id[None].held_out
    flipped = label.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.score_documents(rows, flipped).collect()}
    assert again == {k: r.score for k, r in by_id.items()}  # held-out labels change nothing


def plain_features(text, bits=20):
    """Distinct buckets, word by word, with integers."""
    mix, full = 0x9E3779B97F4A7C15, 2**64
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    h = [xxhash.xxh3_64_intdigest(w) for w in words]
    raw = set(h)
    for gap, mark in ((1, 1), (2, 2)):
        raw |= {(a * mix % full) ^ (b >> 1) ^ mark for a, b in zip(h, h[gap:])}
    raw |= {xxhash.xxh3_64_intdigest(w[:n], n) for w in words for n in (4, 6) if len(w) > n}
    return {x * mix % full >> (64 - bits) for x in raw}


def test_toxicity_features_and_updates(awkward):
    """Features by integers, and weights by the textbook loop over single coordinates."""
    import math

    for text in awkward:
        assert set(toxicity.features(text).tolist()) == plain_features(text)
    rng = random.Random(3)
    model = toxicity.FTRL(bits=6, alpha=0.7, beta=1.5, l1=0.8, l2=0.2)
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= 0.8:
            return 0.0
        return -(z[i] - math.copysign(0.8, z[i])) / ((1.5 + math.sqrt(n[i])) / 0.7 + 0.2)

    import numpy as np

    for _ in range(200):
        at, label, times = sorted(rng.sample(range(64), 6)), rng.randrange(2), rng.choice([1.0, 3.0])
        model.learn(np.array(at), label, times)
        here = [*at, 64]
        p = 1 / (1 + math.exp(-sum(map(weight, here))))
        old = {i: weight(i) for i in here}
        for i in here:
            g = times * (p - label)
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.7 * old[i]
            n[i] += g * g
    got = model.weights(np.arange(65))
    assert got == pytest.approx([weight(i) for i in range(65)], abs=1e-9) and 0 < (got == 0).sum() < 65


def test_toxicity_edges(spark):
    label = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score_documents(docs(spark, ["a", None]), label).collect()} == {0.5}
    assert toxicity.score_documents(docs(spark, []), label).count() == 0


# ---- 7 quality ---------------------------------------------------------------------------


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    twice = Counter(windows)
    covered = {k + d for k, w in enumerate(windows) if twice[w] > 1 for d in range(3)}
    full = [ln for ln in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", ln)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)), len(covered)


def test_quality_measures(spark, awkward):
    texts = awkward + ["a b c a b c", "a a a a", "x y z\nx y z\n\n \n\n", "q w e r t y q w e"]
    got = quality.measures(docs(spark, texts)).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_measures(texts[r.doc_id]), texts[r.doc_id]


def test_quality_cascade(spark, awkward):
    rows = docs(spark, awkward)
    measured, rules = quality.measures(rows), quality.default_rules()
    alone = {r.name: {x.doc_id for x in measured.where(r.rejects).collect()} for r in rules}
    got = {r.doc_id: r.rejected_by for r in quality.apply_rules(rows).collect()}
    assert {k for k, v in got.items() if v} == set().union(*alone.values())
    assert all(k in alone[v] for k, v in got.items() if v)
    planned = quality.plan_cascade(measured, rules)
    gain = [planned.rejected[r.name] / planned.cost[r.name] for r in planned.rules]
    assert gain == sorted(gain, reverse=True) and planned.rejected == pytest.approx({k: len(v) / len(awkward) for k, v in alone.items()})
    assert quality.apply_rules(rows.limit(0)).count() == 0
    clash = rows.withColumnRenamed("fp", "n_words").withColumnRenamed("id", "rejected_by")
    assert {r.doc_id: r._rejected_by is None for r in quality.apply_rules(clash).collect()} == {k: v is None for k, v in got.items()}


def test_quality_order_follows_cost_and_rejections(spark):
    """A dear rule goes behind a cheap one with as many rejections; one that rejects more goes first."""
    rows = docs(spark, ["a b c d " * 400] * 40)
    dear = F.length(F.regexp_replace(F.concat_ws(" ", *[F.col("text")] * 60), r"(?:[a-z] )+(?=d)", "")) > 0
    rules = [quality.Rule("dear", dear), quality.Rule("cheap", F.col("doc_id") >= 0), quality.Rule("rare", F.col("doc_id") == 3)]
    planned = quality.plan_cascade(quality.measures(rows), rules)
    assert planned.cost["dear"] > planned.cost["cheap"] and [r.name for r in planned.rules][0] == "cheap"
    seen = quality.apply_rules(rows, rules).select("rejected_by").distinct().collect()
    assert [r.rejected_by for r in seen] == ["cheap"]


# ---- 8 decontamination -------------------------------------------------------------------


def plain_tiles(doc, item, least):
    """The textbook loop: longest unmarked match, mark it, again."""
    used_d, used_i, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and i + n not in used_i and j + n not in used_d:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return out
        used_i |= set(range(i, i + n))
        used_d |= set(range(j, j + n))
        out.append((j, i, n))


@pytest.mark.parametrize("seed", range(6))
def test_tiles_match_brute_force(seed):
    import numpy as np

    rng = random.Random(seed)
    doc = [rng.choice("abcd" if seed % 2 else "ab") for _ in range(40)]
    item = [rng.choice("abcd" if seed % 2 else "ab") for _ in range(15)] + doc[10:20]
    as_hash = lambda s: np.array([ord(c) for c in s], np.uint64)
    got = decontaminate.tiles(as_hash(doc), as_hash(item), 3)
    assert sum(n for *_, n in got) == sum(n for *_, n in plain_tiles(doc, item, 3))
    assert all(doc[j : j + n] == item[i : i + n] for j, i, n in got)


def test_decontamination(spark):
    rng = random.Random(8)
    items = [sentence(rng, 40) for _ in range(5)] + ["too short", None]
    bench = spark.createDataFrame([(k, t, "x") for k, t in enumerate(items)], "item_id long, text string, seed string")
    w = items[0].split()
    halves = " ".join(w[20:]) + " middle words " + " ".join(w[:20])
    filler = " ".join(f"w{k}" for k in range(20000))
    texts = [f"before {items[0].upper()}, after", halves, f"{filler} {items[1]} {filler}", " ".join(w[:20]), filler, None, "", "too short", f"{items[2]} {items[3]}"]
    rows = docs(spark, texts)
    got = {(r.doc_id, r.item_id): (r.n_covered, r.n_words) for r in decontaminate.overlaps(rows, bench).collect()}
    assert set(got) == {(0, 0), (1, 0), (2, 1), (7, 5), (8, 2), (8, 3)} and all(a >= 0.8 * b for a, b in got.values())
    kept = decontaminate.decontaminate(rows, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6] and kept.columns == rows.columns
    assert decontaminate.overlaps(rows, bench.limit(0)).count() == 0
    assert decontaminate.overlaps(rows.limit(0), bench).count() == 0
    again = docs(spark, [items[0], "clean", items[0]], ids=[1, 1, None])
    assert sorted(str(r.doc_id) for r in decontaminate.decontaminate(again, bench).collect()) == ["None"]


@pytest.mark.parametrize("seed", range(2))
def test_overlaps_against_brute_force(spark, seed):
    """Every pair is tiled by the textbook loop: string ids, short items, cut and reordered passages, repeated items."""
    rng = random.Random(seed)
    items = {f"test-{k}": [rng.choice("abcdefghij") for _ in range(rng.randrange(1, 30))] for k in range(12)}
    items["copy"] = items["test-3"]
    rows = {}
    for k in range(40):
        words = [rng.choice("abcdefghij") for _ in range(rng.randrange(25))]
        for _ in range(rng.randrange(3)):
            item = items[rng.choice(sorted(items))]
            a = rng.randrange(len(item))
            cut = [item[a:] + item[:a], item[: max(1, len(item) - rng.randrange(8))], item[a:] + ["zz"] + item[:a]][rng.randrange(3)]
            at = rng.randrange(len(words) + 1)
            words = words[:at] + cut + words[at:] if rng.random() < 0.8 else list(item)
        rows[f"doc-{k}"] = words
    frame = lambda d, name: spark.createDataFrame([(k, " ".join(w)) for k, w in d.items()], f"{name} string, text string")
    got = {(r.doc_id, r.item_id): r.n_covered for r in decontaminate.overlaps(frame(rows, "doc_id"), frame(items, "item_id")).collect()}
    want = {}
    for d, words in rows.items():
        for i, item in items.items():
            n = sum(m for *_, m in plain_tiles(words, item, 5)) if len(item) >= 5 else len(item) * (words == item)
            if n and n >= 0.8 * len(item):
                want[d, i] = n
    assert got == want and len(want) > 5


# ---- 9 lines -----------------------------------------------------------------------------


def plain_line_dedup(texts):
    key = lambda ln: ln.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holder = {}
    for k, t in enumerate(texts):
        for ln in (t or "").split("\n"):
            if len(key(ln)) >= 10:
                holder.setdefault(key(ln), k)
    out = []
    for k, t in enumerate(texts):
        kept = [ln for ln in (t or "").split("\n") if len(key(ln)) < 10 or holder[key(ln)] == k]
        out.append((len((t or "").split("\n")), len((t or "").split("\n")) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 2)])
def test_line_dedup(spark, awkward, batches, fanout):
    odd = ["0123456789 abc \x85", "0123456789 abc\x85", "0123456789 ABC\u2028 ", "\x0b0123456789 abc\u2028\r", "É ÀÖ lines of text", "É Àö lines of text", "é ÀÖ lines OF text"]
    texts = awkward + odd
    want = plain_line_dedup(texts)
    rows = docs(spark, texts).repartition(5)
    got = lines.dedup_lines(rows, least_batches=batches, fanout=fanout)
    assert got.columns == [*rows.columns, "n_lines", "n_dropped"]
    for r in got.collect():
        assert (r.n_lines, r.n_dropped, r.text) == want[r.doc_id]


def test_line_dedup_of_other_ids(spark):
    """Ids that are text or dates keep the smallest holder."""
    texts = ["a shared line here\nown a line here", "a shared line here", "a shared line here\nown b line here"]
    rows = spark.createDataFrame([(f"id-{k}", t) for k, t in zip("bac", texts)], "doc_id string, text string")
    want = {"id-a": (0, texts[1]), "id-b": (1, "own a line here"), "id-c": (1, "own b line here")}
    assert {r.doc_id: (r.n_dropped, r.text) for r in lines.dedup_lines(rows).collect()} == want
    dates = rows.withColumn("doc_id", F.date_add(F.lit("2020-01-01").cast("date"), F.ascii(F.substring("doc_id", 4, 1))))
    assert sorted(r.n_dropped for r in lines.dedup_lines(dates).collect()) == [0, 1, 1]


def test_runs_are_merged_without_sorting(spark):
    """A batch meets each stored run by a merge join with no shuffle and no sort on either side; full levels are compacted."""
    runs = lines.Runs(spark, 2)
    part = lambda a, b: spark.range(a, b).select(F.col("id").alias("h1"), (-F.col("id")).alias("h2")).repartition(runs.buckets, *lines.KEY)
    for at in range(0, 50, 10):
        runs.compact()
        batch = runs.lay_out(part(at - 3, at + 10))
        with lines._sorted_scans(spark):
            new = runs.unseen(batch)
            plan = new._jdf.queryExecution().executedPlan().toString()
            assert sorted(r.h1 for r in new.collect()) == list(range(at - (3 if at == 0 else 0), at + 10))
        assert "Exchange" not in plan and "Sort [" not in plan and plan.count("SortMergeJoin") == sum(map(len, runs.levels))
        runs.add(runs.lay_out(new))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    runs.close()


def test_line_dedup_edges(spark):
    assert lines.dedup_lines(docs(spark, [])).count() == 0
    text = "a line long enough\nb line long enough"
    rows = docs(spark, [text, text, text, text.replace("b", "c")], ids=[5, 5, None, None])
    got = sorted((str(r.doc_id), r.n_dropped, r.text) for r in lines.dedup_lines(rows).collect())
    assert got == [("5", 0, text), ("5", 0, text), ("None", 1, "c line long enough"), ("None", 2, "")]


# ---- 10 HTML -----------------------------------------------------------------------------


@pytest.mark.parametrize(
    "page,want",
    [
        ("<body><nav>m</nav><article><h1>T &amp; u</h1><p>a  <b>b\nc</b><p>d</article><footer>f</footer>", "T & u\na b c\nd"),
        ("<main><p>x</p><aside>s</aside><div class='post-comments'><p>c<div>d</div></p></div><p>y</main>z", "x\ny"),
        ("<article>a<article class=comment>no</article><div role=banner>no</div><form>no</form>b</article>", "a\nb"),
        ("<article><p class='ad'>no<p>yes</article>", "yes"),
        ("<article><script>if (a<b) '</p>'</script><style>x</style><!-- c -->t&#8364;<br>u</article>", "t€ u"),
        ("<article>1 < 2 &lt;b&gt; &am</article>", "1 < 2 <b> &am"),
        ("<div class='main-content with-sidebar'><article>ok</article></div>", "ok"),
        ("<header>h</header><article><header>h</header>t<table><tr><td>c<td>d</table></article>", "t\nc\nd"),
        ("<article><script>never closed", ""),
        ("", ""),
        (None, ""),
    ],
)
def test_html_structure(page, want):
    assert "\n".join(t for k, t in html_text.blocks_of(page) if k != html_text.NOISY) == want


@pytest.mark.parametrize(
    "page,want",
    [
        ("<article>a<datalist><option>x<option>y</datalist><p>b</article>", "a\nb"),
        ("<article>a<select><option>x<option>y</select><p>b<select><option>z</option></select></article>", "a\nb"),
        ("<article>a<video src=v><p>b</article>", "a\nb"),
        ("<article>a<svg><p>b</article>", "a\nb"),
        ("<article>a<style>x<p>b</article>", "a"),
    ],
)
def test_html_unclosed(page, want):
    assert "\n".join(t for k, t in html_text.blocks_of(page) if k != html_text.NOISY) == want


def test_html_host_boilerplate(spark):
    boiler = " ".join(f"word{k}" for k in range(20))
    pages = [(k, "http://h.example/x", f"<body><p>{boiler}</p><p>{k} is the own text of this page</p></body>") for k in range(3)]
    pages += [(7, "http://other.example/", f"<body><p>{boiler}</p></body>"), (8, None, None), (9, "http://h.example/", f"<body><article><p>{boiler}</p></article></body>")]
    pages += [(10, "http://twin.example/", f"<p>{boiler}</p>")] * 2
    rows = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, text string")
    got = defaultdict(list)
    for r in html_text.main_text(rows).collect():
        got[r.page_id].append(r.text)
    assert [got[k] for k in range(3)] == [[f"{k} is the own text of this page"] for k in range(3)]
    assert got[7] == [boiler] and got[8] == [""] and got[9] == [boiler] and got[10] == [boiler, boiler]
    assert html_text.main_text(rows.limit(0)).count() == 0


def test_html_copies_are_no_boilerplate(spark):
    """Copies and near copies under different ids and addresses keep their text; a passage of two pages stays; a run of three contents goes."""
    rng = random.Random(4)
    boiler = " ".join(f"menu{k}" for k in range(15))
    article = [f"art{k}" for k in range(200)]
    near = [" ".join(article[: 40 * k] + [f"edit{k}"] + article[40 * k + 1 :]) for k in range(5)]
    passage = " ".join(f"quote{k}" for k in range(30))
    own = [" ".join(f"own{rng.randrange(10**6)}" for _ in range(60)) for _ in range(5)]
    texts = [" ".join(article)] * 4 + near + [f"{passage} {own[0]}", f"{own[1]} {passage}"] + own[2:]
    pages = [(k, f"http://h.example/{k}", f"<body><div>{boiler}</div><div>{t}</div></body>") for k, t in enumerate(texts)]
    pages += [(50 + k, f"http://copies.example/{k}", f"<p>{near[0]}</p>") for k in range(4)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == dict(enumerate(texts)) | {50 + k: near[0] for k in range(4)}


def plain_depths(streams, least, min_pages, window):
    """For each suffix the longest prefix that min_pages contents of its host have, found by counting every prefix."""
    holders = defaultdict(set)
    for host, content, stream in streams:
        for k in range(len(stream)):
            for n in range(least, min(window, len(stream) - k) + 1):
                holders[host, tuple(stream[k : k + n])].add(content)
    return {
        (host, tuple(stream[k : k + window])): depth
        for host, _, stream in streams
        for k in range(len(stream) - least + 1)
        for depth in [max((n for n in range(least, min(window, len(stream) - k) + 1) if len(holders[host, tuple(stream[k : k + n])]) >= min_pages), default=0)]
        if depth
    }


@pytest.mark.parametrize("seed,crowded,min_pages", [(0, 10_000, 3), (1, 10_000, 2), (2, 10_000, 3)])
def test_suffix_array_matches_brute_force(spark, monkeypatch, seed, crowded, min_pages):
    rng = random.Random(seed)
    runs = [[rng.choice("abcdef") for _ in range(rng.randrange(3, 20))] for _ in range(6)]
    streams = []
    for content in range(30):
        stream = [x for _ in range(rng.randrange(1, 5)) for x in rng.choice(runs)[rng.randrange(3) :] + [rng.choice("ghijkl")]]
        streams.append((rng.choice(["h1", "h2", ""]), content, stream))
    streams += [("h1", 100, ["a"] * 40), ("h1", 101, ["a"] * 30)]
    rows = [(h, c, bytearray(s)) for h, c, stream in streams for s in html_text.suffixes(html_text._tokens(stream), 3, 7)]
    got = html_text.repeated_runs(spark.createDataFrame(rows, "host string, content long, suffix binary").repartition(4), 3, min_pages, 7).collect()
    want = {(h, html_text._tokens(list(key)).tobytes()): d for (h, key), d in plain_depths(streams, 3, min_pages, 7).items()}
    assert {(r.host, bytes(r.suffix)): r.depth for r in got} == want and len(got) == len(want)


def test_suffix_array_in_smaller_pieces(spark, monkeypatch):
    """Pieces cut further lose no suffix of a repeated prefix."""
    rng = random.Random(3)
    streams = [(c, ["a", "b", "c", *(rng.choice("xyz") for _ in range(6))]) for c in range(200)]
    rows = [("h", c, bytearray(s)) for c, stream in streams for s in html_text.suffixes(html_text._tokens(stream), 3, 7)]
    table = spark.createDataFrame(rows, "host string, content long, suffix binary")
    whole = {bytes(r.suffix): r.depth for r in html_text.repeated_runs(table, 3, 3, 7).collect()}
    monkeypatch.setattr(html_text, "CROWDED", 20)
    cut = {bytes(r.suffix): r.depth for r in html_text.repeated_runs(table, 3, 3, 7).collect()}
    assert set(cut) == set(whole) and all(3 <= cut[k] <= whole[k] for k in whole)


NOTICE = "please sign up to our weekly letter and never miss a story again"


def notice_pages(n):
    """Articles with a notice that no name marks; other pages of the host have it below their articles."""
    own = [" ".join(f"own{k}w{j}" for j in range(30)) for k in range(n + 3)]
    inner = [(k, f"http://n.example/{k}", f"<article><h1>t{k}</h1><p>{own[k]}</p><div>{NOTICE}</div><p>end {k}</p></article>") for k in range(n)]
    outer = [(n + k, f"http://n.example/{n + k}", f"<article><p>{own[n + k]}</p></article><div>{NOTICE}</div>") for k in range(3)]
    want = {k: f"t{k}\n{own[k]}\nend {k}" for k in range(n)} | {n + k: own[n + k] for k in range(3)}
    return inner + outer, want


def test_array_decides_within_articles(spark, monkeypatch):
    pages, want = notice_pages(4)
    pages += [(90, "http://else.example/", pages[0][2])]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string")
    want[90] = want[0].replace("\nend", f"\n{NOTICE}\nend")  # another host has no such run
    assert {r.page_id: r.text for r in html_text.main_text(rows, within_main=True).collect()} == want
    whole = {r.page_id: (r.text.count(NOTICE), r.n_repeated) for r in html_text.main_text(rows).collect()}
    assert whole == {k: (0, 13) if 4 <= k < 7 else (1, 0) for k in want}  # by default the main element is whole
    none = spark.createDataFrame([], "host string, suffix binary, depth int")
    monkeypatch.setattr(html_text, "repeated_runs", lambda *_: none)
    without = {r.page_id: r.text for r in html_text.main_text(rows, within_main=True).collect()}
    assert without != want and all(NOTICE in without[k] for k in range(4))


@pytest.mark.parametrize("part", ["<a ", "<script ", '<a "', '<a b=">', "<svg>", "<a<", "<!--", "<", "<p class='", "<html ", "<option>", "&", "<div>", "<p class=ad>", "<style>x</style "])
def test_long_broken_markup(part):
    import time

    from foliolink.llm import markup

    page = part * (1_000_000 // len(part))
    began = time.perf_counter()
    html_text.blocks_of(page)
    markup.text_of(page)
    assert time.perf_counter() - began < 8


def test_array_decides_on_pages_without_structure(spark, monkeypatch):
    """Unnamed divs: only the array tells a site's frame from a page's own text, and it leaves what two pages share."""
    rng = random.Random(6)
    frame = [" ".join(f"frame{k}w{rng.randrange(99)}" for _ in range(9)) for k in range(2)]
    own = [" ".join(f"own{rng.randrange(10**6)}" for _ in range(40)) for _ in range(6)]
    quote = " ".join(f"quote{k}" for k in range(12))
    texts = [f"{own[k]} {quote}" if k < 2 else own[k] for k in range(6)]
    pages = [(k, "http://p.example/", f"<body><div>{frame[0]}</div><div>{texts[k]}</div><div>{frame[1]}</div></body>") for k in range(6)]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.page_id: (r.text, r.n_repeated) for r in html_text.main_text(rows).collect()} == {k: (t, 18) for k, t in enumerate(texts)}
    monkeypatch.setattr(html_text, "repeated_runs", lambda *_: spark.createDataFrame([], "host string, suffix binary, depth int"))
    assert {r.page_id: r.text for r in html_text.main_text(rows).collect()} == {k: f"{frame[0]}\n{t}\n{frame[1]}" for k, t in enumerate(texts)}


def test_op10_moves_no_texts_and_uses_the_array(spark, tmp_path, monkeypatch):
    """Where counts are too many to broadcast, no shuffle of the query's result has blocks or texts; without the array texts and counts differ."""
    rng = random.Random(7)
    frame, own = " ".join(f"frame{k}" for k in range(12)), [" ".join(f"own{rng.randrange(10**6)}" for _ in range(40)) for _ in range(8)]
    pages = [(k, "http://p.example/", f"<div>{frame}</div><div>{own[k]}</div>") for k in range(4)]
    pages += [(k, "http://q.example/", f"<div>{frame}</div><article>{own[k]}</article>") for k in range(4, 8)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = queries.op10_html_text(spark, str(tmp_path))
        plan = done._jdf.queryExecution().executedPlan().toString()
        assert {r.page_id: (r.text, r.n_repeated) for r in done.collect()} == {k: (t, 12) for k, t in enumerate(own)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Join" in plan and plan.count("Exchange hashpartitioning") == 2  # of the counts for pages with and without an article
    monkeypatch.setattr(html_text, "repeated_runs", lambda *_: spark.createDataFrame([], "host string, suffix binary, depth int"))
    got = {r.page_id: (r.text, r.n_repeated) for r in queries.op10_html_text(spark, str(tmp_path)).collect()}
    assert got == {k: (f"{frame}\n{t}" if k < 4 else t, 0) for k, t in enumerate(own)}


def test_long_page(spark):
    text = " ".join(f"w{k}" for k in range(200_000))
    rows = spark.createDataFrame([(1, "http://a.example/", f"<article><p>{text}</p></article>"), (2, None, f"<p>{text}</p>")], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.main_text(rows).collect()} == {1: text, 2: text}


# ---- queries and pipeline ----------------------------------------------------------------


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs_in = spark.read.parquet(f"{sf}/documents.parquet")
    counts = []
    kept = docs_in
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs_in.columns, name
        kept = corpus_pipeline.store(out, name)
        counts.append(kept.count())
    assert docs_in.count() >= counts[0] >= counts[2] >= counts[3] > 0 and counts[0] == counts[1]
    empty = docs_in.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_queries_with_sql(spark, sf):
    from compare import same

    from foliolink.llm.queries import ORACLES, QUERIES

    for name, sql in ORACLES.items():
        same(QUERIES[name](spark, sf), sql, sf)


def test_main_text_of_pages_that_leave_out_end_tags():
    """without ``</head>`` a page lost its whole text, and after an advert's ``li`` or ``td`` without its end all that followed."""
    from foliolink.llm.html_text import CONTENT, blocks_of

    said = lambda markup: [text for kind, text in blocks_of(markup) if kind == CONTENT]
    assert said("<html><head><title>T</title><meta name=a><body><article><p>hello</p></article></body></html>") == ["hello"]
    assert said("<head><title>T</title><article><p>hello</p></article>") == ["hello"]
    assert said("<article><ul><li class=ad>buy<ul><li>more</ul>now<li>keep<li class=ad>buy</ul><p>and this</p></article>") == ["keep", "and this"]
    assert said("<article><table><tr><td class=ad>x<table><tr><td>y</table>z<td>keep</table><p>tail</p></article>") == ["keep", "tail"]
    assert said("<article><ul><li class=ad>buy</li><li>keep</li></ul><p>tail</p></article>") == ["keep", "tail"]
