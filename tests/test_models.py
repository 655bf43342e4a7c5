"""Model calls side by side: deadlines, order, bounds, kinds of failure; runs over chunks."""

from __future__ import annotations

import sys
import threading
import time

import pytest
from pyspark import cloudpickle

from foliolink.operators import chunk, models
from foliolink.plans import chunked

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have the tests


class Slow:
    """Takes as long as the prompt says; fails on some."""

    name = "slow"

    def __init__(self):
        self.now = self.most = 0
        self.lock = threading.Lock()

    def call(self, prompt):
        with self.lock:
            self.now += 1
            self.most = max(self.most, self.now)
        try:
            if prompt.startswith("status"):
                raise models.ModelError.of_status(int(prompt.split()[1]))
            if prompt == "late":
                raise TimeoutError
            if prompt == "broken":
                raise KeyError("x")
            time.sleep(float(prompt or 0))
            return f"slept {prompt}"
        finally:
            with self.lock:
                self.now -= 1


def test_order_and_bound():
    model = Slow()
    prompts = ["0.2", "0", "0.1", "0", "0.05", "0", "0", "0.1"]
    began = time.perf_counter()
    got = list(models.overlapped(model, prompts, 3, 5.0))
    assert [r for r, _, _ in got] == [f"slept {p}" for p in prompts] and all(e is None for _, e, _ in got)
    assert 2 <= model.most <= 3 and time.perf_counter() - began < 0.45


def test_a_deadline_ends_only_its_call():
    got = list(models.overlapped(Slow(), ["0", "30", "0.01", "30", "0"], 2, 0.3))
    assert [e for _, e, _ in got] == [None, "timeout", None, "timeout", None]
    assert all(s < 1 for _, _, s in got)


def test_kinds_of_failure():
    prompts = ["status 401", "status 429", "status 400", "status 503", "late", "broken", ""]
    assert [e for _, e, _ in models.overlapped(Slow(), prompts, 4, 5.0)] == ["auth", "rate", "request", "other", "timeout", "other: 'x'", None]


def test_short_calls_share_threads():
    """a thread for each call took most of the time of short calls."""
    seen = set()

    class Quick:
        name = "quick"

        def call(self, prompt):
            seen.add(threading.current_thread())
            return prompt

    prompts = [str(k) for k in range(5000)]
    assert [r for r, _, _ in models.overlapped(Quick(), prompts, 4, 5.0)] == prompts
    assert len(seen) <= 4


def test_rows_out_equal_rows_in(spark):
    prompts = ["0", None, "0.01", "status 429", "9", "broken"] * 20
    rows = spark.createDataFrame([(k, p, "z") for k, p in enumerate(prompts)], "id int, prompt string, seconds_before string").repartition(3)
    got = models.run_model(rows, Slow, in_flight=8, deadline=0.2).collect()
    assert sorted(r.id for r in got) == list(range(120))
    want = {None: None, "0": None, "0.01": None, "status 429": "rate", "9": "timeout", "broken": "other: 'x'"}
    assert all(r.error == want[r.prompt] and (r.reply is None) == (r.error is not None) for r in got)
    assert models.run_model(rows.limit(0), Slow).count() == 0
    with pytest.raises(ValueError):
        models.run_model(rows, Slow, in_flight=0)


PAGES = "doc_id string, pos int, page_number int, text string, confidence double"


def person(name, born="01/02/1980"):
    return f"Patient Name: {name}\nDOB: {born}\n" + "y" * 60


class Moody(models.OfflineIdentifier):
    def call(self, prompt):
        if "refuse" in prompt:
            raise models.ModelError.of_status(401)
        return "no idea" if "mumble" in prompt else super().call(prompt)


def test_chunked_run(spark):
    """One chunk refused, one without structure, a document without any that succeeds, one in a single chunk."""
    text = [person("Ann Lee")] * 3 + [person("Bo Yu")] * 2 + [person("Ann Lee") + " refuse"] + [person("Cy Zed")] * 3
    rows = [("long", k, k + 1, t, 0.9) for k, t in enumerate(text)]
    rows += [("bad", k, k + 1, person("Di Orr") + (" mumble" if k != 1 else " refuse"), 0.9) for k in range(2)]
    rows += [("short", 0, 1, person("Ed Poe"), 0.9), ("blank", 0, 1, None, 0.9)]
    pages = spark.createDataFrame(rows, PAGES)
    sizes = chunk.document_sizes(pages.where("doc_id = 'long'")).first()
    per_page = sizes.estimated_tokens / sizes.total_pages
    config = chunk.ChunkConfig(limit=int(3.6 * per_page / 0.8), usable=0.8, overlap=0.1)
    made = chunked.identify_in_chunks(pages, Moody, config)
    chunks = {(r.doc_id, r.chunk_id): r for r in made["chunks"].collect()}
    assert [(k, chunks["long", k].error, chunks["long", k].page_numbers) for k in range(4)] == [(0, None, [1, 2, 3]), (1, None, [3, 4, 5]), (2, "auth", [5, 6, 7]), (3, None, [7, 8, 9])]
    assert chunks["bad", 0].error == "auth" and chunks["short", 0].error is None and chunks["blank", 0].error is None
    people = {(r.doc_id, r.full_name): r for r in made["persons"].collect()}
    assert people["long", "Ann Lee"].all_pages == [1, 2, 3] and people["long", "Bo Yu"].all_pages == [4, 5] and people["long", "Cy Zed"].all_pages == [7, 8, 9]
    assert [people["long", n].merged_no for n in ("Ann Lee", "Bo Yu", "Cy Zed")] == [1, 2, 3]
    summary = {r.doc_id: r for r in made["summary"].collect()}
    s = summary["long"]
    assert (s.total_pages, s.total_patients, s.total_entries, s.assigned_pages, s.unassigned_pages, s.total_chunks, s.successful_chunks, s.failed_chunks) == (9, 3, 3, 8, 1, 4, 3, [2])
    assert s.processed_in_chunks and s.average_confidence == pytest.approx(0.9)
    s = summary["bad"]
    assert (s.total_patients, s.assigned_pages, s.unassigned_pages, s.average_confidence, s.successful_chunks, s.failed_chunks) == (0, 0, 2, 0.0, 0, [0])
    assert (summary["blank"].total_patients, summary["short"].total_patients, summary["short"].processed_in_chunks) == (0, 1, False)


def test_replies_without_groups(spark):
    rows = spark.createDataFrame([(1, '{"summary": {"total_patients": "0"}}', None), (2, '{"other": 1}', None), (3, None, "rate"), (4, '{"patient_groups": {}}', None)], "id int, reply string, error string")
    got = {r.id: (r.error, r.persons) for r in models.parse_persons(rows).collect()}
    assert got == {1: (None, None), 2: ("shape", None), 3: ("rate", None), 4: (None, [])}


def test_settings_and_keys(spark):
    spark.conf.set("foliolink.m.limit", "many")
    spark.conf.set("foliolink.default.limit", "7")
    with pytest.warns(UserWarning, match="no number"):
        assert models.setting(spark, "m", "limit", 3) == 7.0
    spark.conf.set("foliolink.m.limit", "5")
    assert models.setting(spark, "m", "limit", 3) == 5.0 and models.setting(spark, "m", "other", 3) == 3
    for k in ("foliolink.m.limit", "foliolink.default.limit"):
        spark.conf.unset(k)
    assert models.service_key("acme", {"ACME_KEY": " k ", "API_KEY": "x"}) == "k"
    with pytest.warns(UserWarning, match="shared"):
        assert models.service_key("acme", {"ACME": " ", "API_KEY": "x"}) == "x"
    with pytest.raises(KeyError, match="ACME_API_KEY"):
        models.service_key("acme", {})


def test_whole_records(spark):
    """Failed and blank pages are told of; a document without any good page is there."""
    from foliolink.plans import records

    class Reader(models.OfflineModel):
        def call(self, prompt):
            if "refuse" in prompt:
                raise models.ModelError.of_status(401)
            if "odd" in prompt:
                return "NPI 1234567890, call 555-123-4567"
            return super().call(prompt)

    text = "Patient Name: jane sample\nDOB: 01/15/1980\nPhone: 555.123.4567\nNPI: 1987654321"
    rows = [("a", 0, 1, "DOB: 01/15/1980"), ("a", 1, 2, text), ("a", 2, 3, "refuse"), ("a", 3, 4, " "), ("a", 4, 5, "odd"), ("b", 0, 1, "refuse"), ("c", 0, 1, None)]
    made = records.document_records(spark.createDataFrame(rows, "doc_id string, pos int, page_number int, text string"), Reader)
    got = {r.doc_id: r for r in made["documents"].collect()}
    a = got["a"]
    assert (a.patient.full_name, a.patient.dob, a.patient.phone, a.npi, a.n_npis) == ("jane sample", "01/15/1980", "555-123-4567", "1987654321", 2)
    assert (a.total_pages, a.successful_pages, a.blank_pages, [tuple(p) for p in a.failed_pages]) == (5, 3, 1, [(3, "auth")]) and a.extraction_confidence > 0
    assert [tuple(p) for p in got["b"].failed_pages] == [(1, "auth")] and got["b"].patient.full_name == "" and got["b"].extraction_confidence == 0.0
    assert (got["c"].blank_pages, got["c"].items, got["c"].npi) == (1, [], "")
    assert sorted((r.doc_id, r.pos, r.status) for r in made["pages"].collect()) == [("a", 0, "ok"), ("a", 1, "ok"), ("a", 2, "auth"), ("a", 3, "blank"), ("a", 4, "ok"), ("b", 0, "auth"), ("c", 0, "blank")]


def test_sizes_of_a_chunked_run_are_found_once(spark):
    """F8: the summary measured every page's text again, and told chunks by a second pass over all pages."""
    pages = spark.createDataFrame([("a", k, k + 1, person("Ann Lee"), 0.9) for k in range(4)], PAGES)
    found = chunked.identify_in_chunks(pages, models.OfflineIdentifier, chunk.ChunkConfig(100, 0.8, 0.1))
    for name in ("summary", "chunks"):
        assert "regexp_replace" not in found[name]._jdf.queryExecution().optimizedPlan().toString(), name
    assert found["summary"].first().total_pages == 4
