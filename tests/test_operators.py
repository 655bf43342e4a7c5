from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from foliolink.functions import similarity as S
from foliolink.functions import text as X
from foliolink.operators import chunk, compare, consolidate, extract, layout, models, resolve, route
from foliolink.plans import matcher
from foliolink.sources import pages as sources


def one(spark, make, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(make(*[F.col(f"c{i}") for i in range(len(values))]).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "raw,want",
    [
        ("01/15/1980", "1980-01-15"), ("01151980", "1980-01-15"), ("01/15/80", "1980-01-15"), ("01/15/49", "2049-01-15"),
        ("1/15/1980", "1/15/1980"), ("1/15/80", "1/15/80"), ("15/01/1980", "15/01/1980"), ("1/1/1980", "1980-11-19"),
        ("02/30/1980", "1980-02-30"), ("", ""), (None, ""), (" May 5 ", "may 5"),
    ],
)
def test_dob(spark, raw, want):
    assert one(spark, X.normalize_dob, raw) == want


@pytest.mark.parametrize(
    "raw,want",
    [("Mr. John  Smith Jr.", "john smith jr."), ("O'Neil, Ann", "o neil ann"), ("Dr Mary - Ann", "mary-ann"), (None, ""), ("  ", ""), ("Jane Doe,ii", "jane doe ii")],
)
def test_name(spark, raw, want):
    assert one(spark, X.normalize_name, raw) == want


def test_scalars(spark):
    assert one(spark, X.normalize_phone, "1 (555) 123-4567") == "555-123-4567"
    assert one(spark, X.normalize_phone, "123 4567") == "123-4567"
    assert one(spark, X.normalize_mrn, "MRN: ab-12/3") == "AB-123"
    assert one(spark, X.normalize_address, "1 Main Street, West Virginia") == "1 main street, west VA"
    assert one(spark, X.chunk_dob, "1/2/80") == "1980-01-02"
    assert one(spark, X.chunk_dob, "1980.1.2") == "1980-01-02"
    assert one(spark, X.title, "mary-ann o'neil") == "Mary-Ann O'Neil"
    assert one(spark, X.name_variants, "Bill Smith") == ["Bill Smith", "william smith"]
    assert one(spark, X.name_signature, "Jane Smith") == "jsmith|Jane Smith"
    assert one(spark, X.normalize_dob_strict, "02/30/1980") is None
    assert one(spark, X.dates_of_birth, "DOB: 1/2/1980, seen 3/4/2020") == ["1/2/1980", "3/4/2020"]
    assert one(spark, lambda c: X.estimate_tokens(c), "abcd  efgh\n") == 2


def test_json_in_text(spark):
    assert one(spark, X.fenced_json, 'x ```json\n{"a": 1}\n``` y') == '{"a": 1}'
    assert one(spark, X.fenced_json, ' {"a": {"b": 1}} tail }') == '{"a": {"b": 1}}'
    assert one(spark, X.fenced_json, '{"a": ') is None
    assert one(spark, X.fenced_json, "none") is None
    assert one(spark, X.greedy_json, "a {b} c} d") == "{b} c}"
    rng = random.Random(2)
    for body in ("{" + "".join(rng.choice("{}a ") for _ in range(rng.randrange(12))) for _ in range(25)):
        depth = [body[: k + 1].count("{") - body[: k + 1].count("}") for k in range(len(body))]
        assert one(spark, X.fenced_json, body) == (body[: depth.index(0) + 1] if 0 in depth else None)


def test_similarities(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abo01l |") for _ in range(rng.randrange(0, 9))) for _ in range(120)]
    pairs = list(zip(words, reversed(words)))
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = df.select("a", "b", S.jaro_winkler_similarity(a, b).alias("jw"), S.ocr_similarity(a, b).alias("ocr"), S.token_similarity(a, b).alias("tok"), S.fuzzy_similarity(a, b, "difflib").alias("d"), S.levenshtein_similarity(a, b).alias("lev")).collect()
    for r in got:
        assert r.ocr == pytest.approx(S.ocr_of(r.a, r.b))
        assert r.tok == pytest.approx(S.token_of(r.a, r.b))
        assert 0 <= r.d <= 1
        assert 0 <= r.lev <= 1
    assert S.jaro_winkler_of("x", "x") == 0.0
    assert S.ocr_of("8", "b") == 0.8 and S.ocr_of("b", "8") == 0.0
    with pytest.raises(ValueError):
        S.fuzzy_similarity(a, b, "soundex")


def plain_jaro_winkler(a, b):
    """The published formula on lists: common characters within the window, half the transpositions, the prefix bonus."""
    if a == "" or b == "":
        return 1.0 if a == b else 0.0
    s, t = list(a.lower()), list(b.lower())
    window = max(len(s), len(t)) // 2 - 1
    free, mine, theirs = [True] * len(t), [], []
    for i in range(len(s)):
        for j in range(len(t)):
            if free[j] and abs(i - j) <= window and s[i] == t[j]:
                free[j] = False
                mine.append(s[i])
                break
    theirs = [t[j] for j in range(len(t)) if not free[j]]
    if not mine:
        return 0.0
    m, out = len(mine), sum(x != y for x, y in zip(mine, theirs)) / 2
    jaro = (m / len(s) + m / len(t) + (m - out) / m) / 3
    prefix = 0
    while prefix < min(4, len(s), len(t)) and s[prefix] == t[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def test_jaro_winkler_by_the_formula(spark):
    rng = random.Random(5)
    pairs = [tuple("".join(rng.choice("abcAB 1") for _ in range(rng.randrange(0, 12))) for _ in range(2)) for _ in range(300)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", S.jaro_winkler_similarity(F.col("a"), F.col("b")).alias("jw")).collect()
    for r in got:
        assert r.jw == pytest.approx(plain_jaro_winkler(r.a, r.b)), (r.a, r.b)


def plain_greedy(pages, threshold=0.8, merge_at=0.95):
    """The fold over pages one by one, then groups pair by pair."""
    def name_like(x, y):
        x, y = " ".join(x.lower().split()), " ".join(y.lower().split())
        if not x or not y:
            return float(x == y)
        n = max(len(x), len(y))
        ocr = sum(1.0 if p == q else 0.8 if (p, q) in S.CONFUSED else 0.0 for p, q in zip(x.ljust(n), y.ljust(n))) / n
        u, v = set(x.split()), set(y.split())
        return 0.4 * plain_jaro_winkler(x, y) + 0.3 * ocr + 0.3 * len(u & v) / len(u | v)

    found, of = [], []
    for _, name, dob in pages:
        hit = [k for k, (n, d) in enumerate(found) if name_like(name, n) >= threshold and (not dob or d == dob)]
        if not hit:
            found.append((name, dob))
        of.append(hit[0] if hit else len(found) - 1)
    root = list(range(len(found)))
    stand = list(found)
    for i in range(len(found)):
        for j in range(i + 1, len(found)):
            if root[i] == i and root[j] == j:
                (n, d), (m, e) = stand[i], stand[j]
                parts = [(40, name_like(n, m)), (20, name_like(n, m))] + ([(30, float(d == e))] if d or e else [])
                if sum(w * x for w, x in parts) / sum(w for w, _ in parts) >= merge_at:
                    root[j] = i
                    if bool(e) > bool(d):
                        stand[i] = stand[j]
    numbers = {r: k + 1 for k, r in enumerate(sorted(set(root)))}
    return [numbers[root[k]] for k in of]


@pytest.mark.parametrize("seed", range(3))
def test_greedy_groups_by_brute_force(spark, seed):
    rng = random.Random(seed)
    names = ["jane sample", "jane samp1e", "jane sampler", "john sample", "ann lee", "anne lee", "an lee", "bo"]
    docs = {f"d{k}": [(p, rng.choice(names), rng.choice(["", "1980-01-02", "1981-01-02"])) for p in range(rng.randrange(1, 25))] for k in range(12)}
    rows = [(d, p, p + 1, n, b) for d, pages in docs.items() for p, n, b in pages]
    got = defaultdict(list)
    for r in resolve.greedy_groups(signed(spark, rows)).orderBy("doc_id", "pos").collect():
        got[r.doc_id].append(r.group_no)
    assert got == {d: plain_greedy(pages) for d, pages in docs.items()}


PAGE = "doc_id string, pos int, page_number int, sig_name string, sig_dob string, full_name string, first_name string, middle_name string, last_name string, dob string, confidence double"


def signed(spark, rows):
    return spark.createDataFrame([(d, p, n, s, b, s, s, "", "", b, 1.0) for d, p, n, s, b in rows], PAGE)


def groups(df):
    return [r.group_no for r in resolve.greedy_groups(df).orderBy("doc_id", "pos").collect()]


def test_greedy_groups(spark):
    first = [("d", 0, 1, "jane sample", ""), ("d", 1, 2, "jane sample", "1980-01-15")]
    assert groups(signed(spark, first)) == [1, 2]  # a date needs a group with the same
    assert groups(signed(spark, [(d, 1 - p, n, s, b) for d, p, n, s, b in first])) == [1, 1]
    assert groups(signed(spark, [("d", 0, 1, "x", ""), ("d", 1, 2, "x", "")])) == [1, 2]  # one letter isn't like itself
    assert groups(signed(spark, [("d", 0, 1, "", "")])) == []
    assert groups(signed(spark, [])) == []


def test_islands_and_ranges(spark):
    rows = [("d", k, n, "a", "") for k, n in enumerate([4, 5, 1, 2])] + [("d", 9, 3, "b", "")]
    placed = resolve.islands(resolve.exact_groups(signed(spark, rows)))
    assert [(r.group_no, r.page_range) for r in resolve.entries(placed).orderBy("group_no", "entry_no").collect()] == [(1, "4-5"), (1, "1-2"), (2, "3")]
    assert [r.page_range for r in resolve.page_ranges(placed).orderBy("group_no").collect()] == ["1-2, 4-5", "3"]
    assert resolve.entries(placed).orderBy("group_no", "entry_no").first()["entry_id"] == "patient_001_entry_1"


def test_chunk_goldens(spark):
    sizes = spark.createDataFrame([("d", 435, 195571)], "doc_id string, total_pages long, estimated_tokens long")
    for config, legacy, current in (
        (chunk.ChunkConfig(128000, 0.80, 0.10), [227, 227, 25, 22], [227, 227, 25]),
        (chunk.ChunkConfig(70000, 0.85, 0.05), [132, 132, 132, 57, 6], [132, 132, 132, 57]),
        (chunk.ChunkConfig(32000, 0.75, 0.15), [53] * 9 + [21, 7], [53] * 9 + [21]),
    ):
        plans = chunk.plan(sizes, config)
        assert [r.n_pages for r in chunk.chunk_list(plans).orderBy("chunk_id").collect()] == current
        assert [r.n_pages for r in chunk.chunk_list(plans, legacy=True).orderBy("chunk_id").collect()] == legacy
    assert chunk.ChunkConfig.of("nobody").limit == 32000


def test_one_page_chunks_move_on(spark):
    sizes = spark.createDataFrame([("d", 5, 50000)], "doc_id string, total_pages long, estimated_tokens long")
    plans = chunk.plan(sizes, chunk.ChunkConfig(10000, 0.8, 0.1))
    pages = spark.range(5).select(F.lit("d").alias("doc_id"), F.col("id").cast("int").alias("pos"))
    assert sorted((r.pos, r.chunk_id) for r in chunk.members(pages, plans).collect()) == [(k, k) for k in range(5)]


def test_stitch_gap(spark):
    rows = [("d", 1, 1, 2, 0.4), ("d", 1, 3, 3, 0.8), ("d", 1, 5, 6, 1.0), ("d", 1, 9, 9, 0.2)]
    got = chunk.stitch(spark.createDataFrame(rows, "doc_id string, group_no int, first_page int, last_page int, confidence double")).orderBy("session").collect()
    assert [(r.page_range, round(r.confidence, 6)) for r in got] == [("1-6", 0.8), ("9", 0.2)]


def test_merge_chunks(spark):
    rows = [("d", 0, 1, "Jane Q Sample", "1/2/1980"), ("d", 1, 1, "sample jane", ""), ("d", 1, 2, "Bob Other", ""), ("d", 2, 1, "Jane Sample", "3/4/1990")]
    df = spark.createDataFrame(rows, "doc_id string, chunk_id int, person_no int, full_name string, dob string")
    strict = {(r.chunk_id, r.person_no): r.merged_no for r in chunk.merge_chunks(df, strict=True).collect()}
    assert strict[(1, 1)] == strict[(0, 1)] and strict[(1, 2)] != strict[(0, 1)] and strict[(2, 1)] != strict[(0, 1)]


def test_compare(spark):
    runs = spark.createDataFrame([("a", "x", 3), ("a", "y", 3), ("a", "z", 5), ("b", "x", 1), ("b", "y", 10)], "doc_id string, algorithm string, total_patients int")
    got = {r.doc_id: (r.consensus_patients, round(r.agreement_percentage, 2)) for r in compare.consensus(runs).collect()}
    assert got == {"a": (3, 66.67), "b": (1, 50.0)}


def test_route_bounds(spark):
    rows = [("none", 1, ""), ("short", 1, "x" * 49), ("just", 1, "x" * 50), ("mixed", 1, "x" * 99), ("mixed", 2, None), ("mixed", 3, " ")]
    df = spark.createDataFrame(rows, "doc_id string, page_number int, text string")
    got = {r.doc_id: (r.method, r.confidence) for r in route.route(route.page_coverage(df), prefer_scanned=False).collect()}
    assert got == {"none": ("ocr", 0.8), "short": ("ocr", 0.8), "just": ("scanned", 0.9), "mixed": ("scanned", 0.7)}


def test_extract_and_identify(spark):
    text = "Patient Name: Jane Q. Sample\nDOB: 01/15/1980 Sex: F\nclinic visit note"
    rows = [("d", 0, 1, text, 90.0, True), ("d", 1, 2, text, 80.0, True), ("d", 2, 3, "12 34", 70.0, True), ("d", 3, 4, text, 60.0, True)]
    pages = spark.createDataFrame(rows, "doc_id string, pos int, page_number int, text string, confidence double, success boolean")
    found = pages.select(extract.name_candidates(F.col("text")).alias("n"), extract.dob_candidates(F.col("text")).alias("b")).first()
    assert "Jane Q. Sample" in found["n"] and found["b"][0] == "01/15/1980"
    made = matcher.identify(pages)
    assert [r.page_range for r in made["entries"].orderBy("entry_no").collect()] == ["1-2", "4"]
    assert [r.page_number for r in made["unassigned"].collect()] == [3]
    s = made["summary"].first()
    assert (s.total_patients, s.total_entries, s.assigned_pages, s.unassigned_pages, s.average_confidence) == (1, 2, 3, 1, 1.0)


def test_models_offline(spark):
    text = "Patient Name: jane sample\nDOB: 01/15/1980\nPhone: 555.123.4567\nNPI: 1234567890"
    df = spark.createDataFrame([(1, text), (2, None)], "id int, prompt string")
    got = {r.id: r for r in models.parse_replies(models.run_model(df, models.OfflineModel)).collect()}
    assert got[1].record.patient.full_name == "jane sample" and got[1].record.doctor.npi == "1234567890"
    assert got[2].record.patient.full_name == ""

    class Failing:
        name = "failing"

        def call(self, prompt):
            raise models.ModelError("rate")

    assert {r.error for r in models.run_model(df, Failing).collect()} == {"rate"}


def test_layout(spark):
    cells = spark.createDataFrame([("t", "b", 50.0, 0.0), ("t", "a", 1.0, 8.0), ("t", "c", 1.0, 16.0), ("t", "d", 9.0, 17.0)], "table_id string, text string, x double, y double")
    grid = layout.grid_rows(cells)
    assert grid.first()["grid"] == [["a", "b"], ["c", "d"]]
    assert grid.select(layout.markdown(F.col("grid")).alias("m")).first()["m"] == "| a | b |\n| --- | --- |\n| c | d |"


def test_grid_rows_are_those_of_the_fold(spark):
    """Random tables, one long, with ties, exact distances and cells without y."""
    rng = random.Random(6)
    cells = [(f"t{k % 4}", f"c{k}", float(rng.randrange(6)), rng.choice([None, float(rng.randrange(60)), rng.random() * 60])) for k in range(150)]
    cells += [("long", f"c{k}", float(k % 3), k * 2.5) for k in range(400)]
    want = {}
    for table in {c[0] for c in cells}:
        rows, anchor = [], None
        for _, text, x, y in sorted((c for c in cells if c[0] == table), key=lambda c: (c[3] is not None, c[3] or 0.0, c[2], c[1])):
            if anchor is None or abs(y - anchor) > 10:
                rows.append([])
                anchor = y
            rows[-1].append((x, text))
        want[table] = [[t for _, t in sorted(r)] for r in rows]
    got = layout.grid_rows(spark.createDataFrame(cells, "table_id string, text string, x double, y double"))
    assert {r.table_id: r.grid for r in got.collect()} == want


def test_better_reading_is_a_fold(spark):
    df = spark.createDataFrame([([("aa", 0.9), ("aaa", 0.1), ("a", 0.5)],)], "r array<struct<text:string,confidence:double>>")
    assert df.select(compare.better_reading(F.col("r")).alias("x")).first()["x"]["text"] == "a"


def test_consolidate(spark):
    rows = [("d", 0, "", "a"), ("d", 1, "x", ""), ("d", 2, "y", "b"), ("d", 3, "z", "c")]
    df = spark.createDataFrame(rows, "doc_id string, pos int, p string, q string")
    assert tuple(consolidate.fullest(df, ["p", "q"]).first()) == ("d", "y", "b")
    assert tuple(consolidate.first_filled(df, ["p", "q"]).first()) == ("d", "x", "a")


def test_json_source(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"extraction_info": {"pdf_name": "a.pdf", "extraction_timestamp": "2"}, "pages": [{"text": "hi", "success": true}, {"page_number": 7}]}')
    (tmp_path / "bad.json").write_text("{nope")
    files = sources.extracted_files(spark, str(tmp_path))
    pages = sources.pages_of(files).orderBy("pos").collect()
    assert [(r.doc_id, r.page_number, r.text, r.success) for r in pages] == [("a.json", 1, "hi", True), ("a.json", 7, "", False)]
    assert sources.cached_files(files).count() == 1
    assert sorted(r.page_number for r in sources.selected_pages(sources.pages_of(files), "1,3-7").collect()) == [1, 7]


def test_no_python_in_built_in_plans(spark, sf):
    from foliolink.registry import QUERIES

    for name in ("page_islands", "run_summary", "chunk_members", "norm_dob", "ocr_similarity", "json_whitelist"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan, name


def test_matcher_searches_each_page_once(spark):
    """patterns ran over every page again for the groups and for the summary."""
    from foliolink.plans import matcher

    pages = spark.createDataFrame([("d", 0, 1, "Patient Name: Ann Lee\nDOB: 01/02/1980\n", 0.9, True), ("d", 1, 2, "7 / 12", 0.9, True)], "doc_id string, pos int, page_number int, text string, confidence double, success boolean")
    found = matcher.identify(pages)
    for name in ("pages", "summary", "unassigned"):
        assert "regexp_extract_all" not in found[name]._jdf.queryExecution().optimizedPlan().toString(), name
    assert [(r.page_number, r.group_no) for r in found["pages"].collect()] == [(1, 1)] and [r.page_number for r in found["unassigned"].collect()] == [2]
