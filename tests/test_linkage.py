"""Joins of like names and the folds found by joins, against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from foliolink import scratch
from foliolink.functions import similarity as S
from foliolink.operators import chunk, linkage, resolve

FIRST = ["jane", "jan", "john", "jon", "ann", "anne", "christopher", "christophe", "maria", "x"]
LAST = ["sample", "samp1e", "sampler", "lee", "leigh", "smith", "smyth", "o", "de la cruz", "j"]
PAGE = "doc_id string, pos int, page_number int, sig_name string, sig_dob string, full_name string, first_name string, middle_name string, last_name string, dob string, confidence double"


def some_name(rng):
    first, last = rng.choice(FIRST), rng.choice(LAST)
    return rng.choice([f"{first} {last}", first, last, f"{first} {rng.choice('abcx')} {last}", f"{last} {first}", f"{first} mary ann {last}"])


def signed_rows(rng, docs, most):
    rows = []
    for d in range(docs):
        for p in range(rng.randrange(1, most)):
            name, dob = some_name(rng), rng.choice(["", "1980-01-02", "1981-01-02", None])
            full = rng.choice([name, name, name.title() + " ", "", "Maria Lee"])
            rows.append((f"d{d}", p, p + 1, name, dob, full, full.split(" ")[0], "", full.strip().split(" ")[-1], rng.choice([dob, dob, ""]), 1.0))
    return rows


@pytest.mark.parametrize("need_dob", [True, False])
def test_groups_by_joins_are_those_of_the_fold(spark, need_dob):
    rows = signed_rows(random.Random(3 + need_dob), 6, 60)
    pages = spark.createDataFrame(rows, PAGE)
    of = lambda folded: {(r.doc_id, r.pos): r.group_no for r in resolve.greedy_groups(pages, need_dob=need_dob, folded=folded).collect()}
    want = of(10**9)
    assert len(want) == len(rows) and of(0) == want


def test_large_and_small_documents_together(spark):
    """Only documents beyond the bound go through the joins; their rows lie in many tasks."""
    rows = signed_rows(random.Random(8), 6, 12)
    rows += [("big", k, k + 1, f"first{k % 40} last{k % 37}", "", f"First{k % 40} Last{k % 37}", "", "", "", "", 1.0) for k in range(600)]
    pages = spark.createDataFrame(rows, PAGE)
    got = resolve.greedy_groups(pages, folded=50)
    want = {(r.doc_id, r.pos): r.group_no for r in resolve.greedy_groups(pages, folded=10**9).collect()}
    assert {(r.doc_id, r.pos): r.group_no for r in got.collect()} == want
    assert resolve.greedy_groups(pages.limit(0), folded=0).count() == 0


@pytest.mark.parametrize("threshold", [0.7, 0.8])
def test_like_names_loses_no_pair(spark, threshold):
    rng = random.Random(int(threshold * 100))
    names = sorted({(k % 2, some_name(rng)) for k in range(160)} | {(0, "same name"), (0, "name same"), (0, "a"), (0, "a b")})
    got = {(r.k, r.a, r.b) for r in linkage.like_names(spark.createDataFrame(names, "k int, name string"), ["k"], threshold).collect()}
    assert got == {(k, a, b) for k, a in names for m, b in names if k == m and S.blend_of(a, b) >= threshold}
    assert linkage.like_names(spark.createDataFrame([], "k int, name string"), ["k"], threshold).count() == 0


def test_like_names_refuses_low_thresholds(spark):
    with pytest.raises(ValueError):
        linkage.like_names(spark.createDataFrame([(1, "a")], "k int, name string"), ["k"], 0.5)


def test_common_words_alone_make_no_pairs(spark):
    """Names that share only a word that all have never meet, where two words must be shared."""
    names = spark.createDataFrame([("d", f"john w{k}") for k in range(300)], "doc_id string, name string")
    assert linkage.like_names(names, ["doc_id"], 0.8).count() == 300  # each with itself
    need = spark.range(1).select(linkage.shared_words(0.8, F.lit(2), F.lit(2)), linkage.shared_words(0.8, F.lit(2), F.lit(1)), linkage.shared_words(0.7, F.lit(3), F.lit(3))).first()
    assert tuple(need) == (2, 1, 1)


def test_first_independent_set(spark):
    rng = random.Random(1)
    for n in (1, 60):
        edges = {(i, j) for i in range(n) for j in range(i) if rng.random() < 2 / n}
        settled = {k for k in range(n) if rng.random() < 0.1}
        opens = []
        for i in range(n):
            if i not in settled and not any((i, j) in edges for j in opens):
                opens.append(i)
        got = linkage.members_of_first(spark.createDataFrame(sorted(edges), "node long, earlier long"), spark.createDataFrame([(k,) for k in settled], "node long"))
        assert {r.node for r in got.collect()} == set(range(n)) - set(opens)


def test_components_and_numbers(spark):
    links = [(1, 2), (3, 2), (5, 4), (9, 8), (8, 7), (7, 6), (6, 10)]
    got = {r.node: r.root for r in linkage.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 6, 9: 6, 10: 6}
    rows = [(k % 3, (k * 7919) % 1000) for k in range(500)]
    got = linkage.numbered(spark.createDataFrame(rows, "k int, v int"), ["k"], ["v"], "no").collect()
    for k in range(3):
        mine = sorted((r.no, r.v) for r in got if r.k == k)
        assert [n for n, _ in mine] == list(range(1, len(mine) + 1)) and [v for _, v in mine] == sorted(v for _, v in mine)


def plain_merge(rows, strict):
    """The fold over every row."""
    known, out = {}, {}
    for doc, chunk_id, no, name, dob in sorted(rows, key=lambda r: r[:3]):
        mine = known.setdefault(doc, [])
        words, parts = set((name or "").lower().split()), (name or "").lower().split()
        date = dob or ""
        need = min(2, len(parts) - 1)
        need = max(1, need) if strict else need
        hit = [k for k, (n, d, _) in enumerate(mine) if (n, d) == (" ".join(parts), date)]
        hit = hit or [k for k, (_, d, w) in enumerate(mine) if len(words & w) >= need and (not date or not d or d == date)]
        if not hit:
            mine.append((" ".join(parts), date, words))
        out[doc, chunk_id, no] = (hit[0] if hit else len(mine) - 1) + 1
    return out


@pytest.mark.parametrize("strict", [False, True])
def test_merge_by_joins_is_the_fold(spark, strict):
    """One-word, empty and repeated names, pages with and without dates; repeated rows; every document by both ways."""
    rng = random.Random(4 + strict)
    word = lambda: rng.choice("ann bo cy di ed flo guy".split())
    rows = []
    for d in range(8):
        for c in range(rng.randrange(1, 10)):
            for p in range(rng.randrange(4)):
                name = rng.choice([" ".join(word() for _ in range(rng.choice([1, 2, 2, 3, 4]))), "", None] if d % 3 else [" ".join(word() for _ in range(rng.choice([2, 3])))])
                rows.append((f"d{d}", c, p, name, rng.choice(["", "1980-01-02", "1981-01-02", None])))
    frame = spark.createDataFrame(rows, "doc_id string, chunk_id int, person_no int, full_name string, dob string")
    want = plain_merge(rows, strict)
    for folded in (0, 10**9, 6):
        got = {(r.doc_id, r.chunk_id, r.person_no): r.merged_no for r in chunk.merge_chunks(frame, strict, folded).collect()}
        assert got == want, folded
    assert chunk.merge_chunks(frame.limit(0), strict, 0).count() == 0


def signed_people(seed):
    """Repeated names of one to four words in any case and spacing, empty and null ones; dates alike, different and missing."""
    rng, rows = random.Random(seed), []
    for doc in range(12):
        for person in range(rng.randrange(1, 25)):
            name = " ".join(rng.choice(("ann", "bo", "cy")) for _ in range(rng.randrange(1, 5)))
            name = rng.choice([name, name, name.upper(), f"  {name.replace(' ', chr(9) + ' ')} ", "", None])
            rows.append((doc, person, name, rng.choice(["1980-01-02", "1981-01-02", "", None])))
    return rows


def signature(name, dob):
    return " ".join((name or "").lower().split()), dob or ""


def test_classes_hold_every_pair_of_one_signature(spark):
    rows = signed_people(5)
    got = resolve.signature_classes(spark.createDataFrame(rows, "doc_id int, person_id int, name string, dob string")).collect()
    same = {(d, x, y) for d, x, *a in rows for e, y, *b in rows if d == e and signature(*a) == signature(*b)}
    assert len(got) == len(rows)
    assert {(r.doc_id, r.person_id, q.person_id) for r in got for q in got if (r.doc_id, r.class_id) == (q.doc_id, q.class_id)} == same
    for r in got:
        assert r.n_links == r.class_size - 1 == sum((d, x) == (r.doc_id, r.person_id) for d, x, _ in same) - 1


@pytest.mark.parametrize("strict", [False, True])
def test_token_links_hold_every_pair(spark, strict):
    """Links between classes with their members are the pairs of all people, copies too, by brute force."""
    rows = signed_people(6 + strict)
    want = {}
    for d, x, *one in rows:
        for e, y, *two in rows:
            (a, a_dob), (b, b_dob) = signature(*one), signature(*two)
            common, need = len(set(a.split()) & set(b.split())), min(2, len(a.split(" ")) - 1)
            if d == e and x < y and common >= max(need, 1 if strict else 0) and common and (not a_dob or not b_dob or a_dob == b_dob):
                want[d, x, y] = common
    got = resolve.token_block_links(spark.createDataFrame(rows, "doc_id int, person_id int, name string, dob string"), strict).collect()
    members = {}
    for r in got:
        if r.kind == "member":
            members.setdefault((r.doc_id, r.b), []).append(r.a)
    assert sorted((d, x) for (d, _), xs in members.items() for x in xs) == sorted((d, x) for d, x, *_ in rows)
    pairs = [((r.doc_id, x, y), r.common) for r in got if r.kind == "link" for x in members[r.doc_id, r.a] for y in members[r.doc_id, r.b] if x < y]
    assert len(pairs) == len(dict(pairs)) and dict(pairs) == want


def plain_score(x, y, fields):
    total = weight = 0.0
    for f in S.FIELD_WEIGHTS:
        if f in fields and (x[f] or y[f]):
            a, b, w = x[f], y[f], S.FIELD_WEIGHTS[f]
            exact = f in ("dob", "phone")
            total, weight = total + w * ((float(a == b) if a and b else 0.0) if exact else S.blend_of(a, b)), weight + w
    return total / weight if weight else 0.0


@pytest.mark.parametrize("fields", [["full_name", "first_name", "dob", "phone"], ["full_name", "email"]])
def test_best_matches_by_brute_force(spark, fields):
    rng = random.Random(len(fields))
    person = lambda: {"full_name": rng.choice(["", some_name(rng)]), "first_name": rng.choice(FIRST), "dob": rng.choice(["", "1980-01-02", "1981-01-02"]), "phone": rng.choice(["", "5551234567", "5559999999"]), "email": ""}
    schema = "block int, person_id long, info struct<full_name:string,first_name:string,dob:string,phone:string,email:string>"
    ours = [(k % 3, k, person()) for k in range(60)]
    theirs = [(k % 3, 100 + k, person()) for k in range(60)]
    ours += [(0, 200 + k, ours[0][2]) for k in range(5)]
    theirs += [(0, 300 + k, theirs[0][2]) for k in range(5)]
    got = resolve.best_matches(spark.createDataFrame(ours, schema), spark.createDataFrame(theirs, schema), fields).collect()
    assert len(got) == len(ours)
    found = {r.target_id: (r.match_id, r.score) for r in got}
    for block, k, x in ours:
        scored = [(-plain_score(x, y, fields), m) for b, m, y in theirs if b == block]
        best = min((s for s in scored if -s[0] >= 0.7), default=None)
        if best is None:
            assert found[k] == (None, None)
        else:
            assert found[k][0] == best[1] and found[k][1] == pytest.approx(-best[0])


def test_best_matches_dont_meet_by_block_alone(spark, sf):
    from foliolink.plans import queries

    plan = queries.best_match(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "info" in plan and "Cartesian" not in plan
    for line in plan.splitlines():
        if "Join Inner" in line and "block" in line:
            assert "key" in line or "name" in line or " a" in line or " b" in line or "word" in line, line


def test_merge_leaves_no_sets_of_words_on_disk(spark, tmp_path, monkeypatch):
    """each round's tables and every person's sets of words stayed in the shared folder."""
    rows = [(d, c, 1, f"Part {('Ann', 'Bo', 'Cy', 'Di')[(d + c) % 4]} {'FO'[c % 2]}", ("", "1980-01-02")[c % 2]) for d in range(20) for c in range(8)]
    people = spark.createDataFrame(rows, "doc_id int, chunk_id int, person_no int, full_name string, dob string")
    want = sorted(map(tuple, chunk.merge_chunks(people).select("doc_id", "chunk_id", "merged_no").collect()))
    monkeypatch.setattr(scratch, "root", lambda _: str(tmp_path))
    got = chunk.merge_chunks(people, folded=0).select("doc_id", "chunk_id", "merged_no")
    assert sorted(map(tuple, got.collect())) == want
    left = sum(spark.read.parquet(str(p)).count() for p in tmp_path.iterdir() if list(p.glob("*.parquet")))
    assert left <= 4 * len(rows), left


def test_no_side_of_joined_groups_goes_through_the_driver(spark):
    """kept files of ids looked small, so sides of some million rows were built up in the driver."""
    rows = [("d", k, k + 1, f"{('ann', 'bo', 'cy')[k % 3]} {('lee', 'lea', 'poe')[k % 2]}", "") for k in range(12)]
    pages = spark.createDataFrame(rows, "doc_id string, pos int, page_number int, sig_name string, sig_dob string")
    pages = pages.selectExpr("*", "sig_name as full_name", "split(sig_name, ' ')[0] as first_name", "'' as middle_name", "split(sig_name, ' ')[1] as last_name", "'' as dob")
    for made in (resolve.greedy_groups(pages, folded=0), linkage.members_of_first(spark.createDataFrame([(2, 1), (3, 2)], "node long, earlier long"))):
        made.collect()
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
