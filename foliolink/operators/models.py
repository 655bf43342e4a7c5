"""Plugging in text recognition and language models: one map-style interface, an offline default.

A model is any object with ``name`` and ``call(prompt)``; it is built once per task. Calls of a
task overlap, each with its own deadline. Failures become rows with an ``error``, never failed tasks.
"""

from __future__ import annotations

import json
import re
import threading
import time
import warnings
from collections.abc import Callable, Iterable, Iterator, Mapping
from itertools import groupby
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schemas import RECORD


class Model(Protocol):
    """What a model needs."""

    name: str

    def call(self, prompt: str) -> str:
        """The reply to one prompt; raise :class:`ModelError` for a known kind of failure."""


#: Kinds of failure by HTTP status.
ERROR_KINDS = {401: "auth", 429: "rate", 400: "request"}


class ModelError(Exception):
    """A failed call of a known ``kind``: ``auth``, ``rate``, ``request``, ``timeout`` or ``other``; :meth:`of_status` tells it from an HTTP status."""

    def __init__(self, kind: str, message: str = ""):
        super().__init__(message or kind)
        self.kind = kind

    @classmethod
    def of_status(cls, status: int, message: str = "") -> ModelError:
        return cls(ERROR_KINDS.get(status, "other"), message or f"status {status}")


class OfflineModel:
    """Deterministic stand-in without a network: replies with the fields that labels in the prompt show."""

    def __init__(self, name: str = "offline"):
        self.name = name

    def call(self, prompt: str) -> str:
        find = lambda pattern: next(iter(re.findall(pattern, prompt)), "")
        patient = {
            "full_name": find(r"(?m)^Patient Name:[ \t]*(.*?)[ \t]*$"),
            "dob": find(r"DOB:\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})"),
            "phone": find(r"Phone:\s*([\d().\- ]{7,})").strip(),
        }
        record = {"patient": patient, "doctor": {"npi": find(r"NPI:\s*(\d{10})")}, "insurance": {}, "dme": {"dme_id": "", "items": []}}
        return "```json\n" + json.dumps(record) + "\n```"


REGISTRY: dict[str, Callable[[], Model]] = {"offline": OfflineModel}


def register(name: str, make: Callable[[], Model]) -> None:
    """Adds a model under a name; ``make`` runs in each task."""
    REGISTRY[name] = make


def outcome(model: Model, prompt: str) -> tuple[str | None, str | None]:
    """Reply and error of one call; every failure is an error."""
    try:
        return model.call(prompt), None
    except ModelError as e:
        return None, e.kind
    except TimeoutError:
        return None, "timeout"
    except Exception as e:  # noqa: BLE001  a failed call is a row
        return None, f"other: {e}"


def overlapped(model: Model, prompts: Iterable[str], in_flight: int, deadline: float | None) -> Iterator[tuple[str | None, str | None, float]]:
    """Results in the order of the prompts, of at most ``in_flight`` calls at a time, given up ones not counted.

    A thread takes the next prompt once its call has ended, so that short calls cost no thread each. A call that
    takes longer than ``deadline`` seconds is given up: another thread goes on, and its own ends whenever the call does.
    """
    prompts = list(prompts)
    found: list[tuple[str | None, str | None, float]] = [(None, "timeout", 0.0)] * len(prompts)
    numbers = iter(range(len(prompts)))
    running: dict[int, tuple[object, float]] = {}  # whose each call is and when it began; who takes it out settles it, without a lock
    threads: set[object] = set()
    ended = threading.Event()

    def work(me: object) -> None:
        for number in numbers:
            began = time.perf_counter()
            running[number] = (me, began)
            reply, error = outcome(model, prompts[number])
            if running.pop(number, None) is None:  # given up
                return
            found[number] = (reply, error, time.perf_counter() - began)
        threads.discard(me)
        ended.set()

    def another() -> None:
        me = object()
        threads.add(me)
        threading.Thread(target=work, args=(me,), daemon=True).start()

    for _ in range(min(in_flight, len(prompts))):
        another()
    while threads:
        at = time.perf_counter()
        for number, (me, began) in running.copy().items() if deadline is not None else ():
            if at - began >= deadline and running.pop(number, None) is not None:
                found[number] = (None, "timeout", at - began)
                threads.discard(me)
                another()
        if threads:
            ends = [began + deadline - at for _, began in running.copy().values()] if deadline is not None else []
            ended.wait(deadline if not ends else max(0.0, min(ends)))
            ended.clear()
    yield from found


def run_model(prompts: DataFrame, make: Callable[[], Model], text_col: str = "prompt", in_flight: int = 4, deadline: float | None = 60.0) -> DataFrame:
    """``prompts`` with ``reply, error, seconds``: one call per row, ``error`` null where it succeeded.

    A task has up to ``in_flight`` calls under way, so a model must bear calls from several
    threads; a call that takes longer than ``deadline`` seconds is a ``timeout`` row and the task
    goes on. Rows keep their order within a task. A null prompt is an empty one.
    """
    if in_flight < 1:
        raise ValueError("one call at least has to be in flight")
    schema = ", ".join(f"`{c}` {kind}" for c, kind in prompts.dtypes) + ", reply string, error string, seconds double"

    def call(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for part in parts:
            rows = list(overlapped(model, (p or "" for p in part[text_col]), in_flight, deadline))
            reply, error, seconds = zip(*rows) if rows else ((), (), ())
            yield part.assign(reply=list(reply), error=list(error), seconds=list(seconds))

    return prompts.mapInPandas(call, schema)


#: What a model tells about a run of pages; ``patient_groups`` by id, in order of the ids.
PERSONS = (
    "patient_groups map<string, struct<patient_info: struct<full_name: string, dob: string>, "
    "entries: array<struct<pages: array<int>, confidence: double>>, group_confidence: double>>, summary map<string, string>"
)


def parse_persons(replies: DataFrame) -> DataFrame:
    """Adds ``persons``, an array in order of their ids, and turns replies without groups or summary into the error ``shape``."""
    parsed = F.from_json(X.fenced_json(F.col("reply")), PERSONS)
    staged = replies.withColumn("_told", parsed)
    shaped = F.col("_told.patient_groups").isNotNull() | F.col("_told.summary").isNotNull()
    error = F.when(F.col("error").isNull() & ~F.coalesce(shaped, F.lit(False)), "shape").otherwise(F.col("error"))
    groups = F.array_sort(F.map_entries("_told.patient_groups"), lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0))
    persons = F.transform(groups, lambda g: g["value"])
    return staged.withColumn("error", error).withColumn("persons", F.when(error.isNull(), persons)).drop("_told")


class OfflineIdentifier:
    """Deterministic stand-in for a model that tells persons apart: by the name and date under each page's banner."""

    name = "offline_identifier"

    def call(self, prompt: str) -> str:
        pages: dict[tuple[str, str], list[int]] = {}
        for number, body in re.findall(r"(?ms)^=== PAGE (\d+) [^\n]*===\n(.*?)(?=^=== PAGE |\Z)", prompt):
            name = re.search(r"(?m)^Patient Name:[ \t]*(.+?)[ \t]*$", body)
            if name:
                born = re.search(r"DOB:\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})", body)
                pages.setdefault((name[1], born[1] if born else ""), []).append(int(number))
        groups = {}
        for k, ((name, born), numbers) in enumerate(pages.items(), 1):
            runs = [[p for _, p in run] for _, run in groupby(enumerate(numbers), lambda x: x[1] - x[0])]
            groups[f"patient_{k:03d}"] = {"patient_info": {"full_name": name, "dob": born}, "entries": [{"pages": r, "confidence": 0.9} for r in runs], "group_confidence": 0.9}
        return json.dumps({"patient_groups": groups, "summary": {"total_patients": str(len(groups))}})


def parse_replies(replies: DataFrame, simple: bool = False) -> DataFrame:
    """Adds the fixed record ``record`` and ``parse_ok``.

    JSON comes from a fence or balanced braces (``simple``: from the first to the last
    brace). Where none parses, phones, NPI and date are looked for in the text; the record is
    never null.
    """
    found = X.greedy_json(F.col("reply")) if simple else X.fenced_json(F.col("reply"))
    parsed = F.col("_parsed")
    plain = X.text_fallback(F.col("reply"))
    ok = F.coalesce(parsed["patient"].isNotNull() | parsed["doctor"].isNotNull(), F.lit(False))
    patient = F.struct(*[F.when(F.col("_ok"), X.strip(F.col("_parsed.patient")[f])).otherwise(F.col("_plain")[f] if f in ("phone", "mobile_landline", "dob") else F.lit("")).alias(f) for f in _fields("patient")])
    doctor = F.struct(F.when(F.col("_ok"), X.record_npi(F.col("_parsed.doctor.npi"))).otherwise(X.record_npi(F.col("_plain.npi"))).alias("npi"))
    insurance = F.struct(*[X.strip(F.col("_parsed.insurance")[f]).alias(f) for f in _fields("insurance")])
    dme = F.struct(X.strip(F.col("_parsed.dme.dme_id")).alias("dme_id"), F.coalesce(F.col("_parsed.dme.items"), F.array().cast("array<struct<item_name:string,item_quantity:string>>")).alias("items"))
    staged = replies.withColumn("_found", found).withColumn("_parsed", F.from_json("_found", RECORD)).withColumns({"_plain": F.when(~ok, plain), "_ok": ok})
    staged = staged.withColumn("record", F.struct(patient.alias("patient"), doctor.alias("doctor"), insurance.alias("insurance"), dme.alias("dme")))
    return staged.withColumn("record", tidy_record(F.col("record"))).withColumnRenamed("_ok", "parse_ok").drop("_found", "_parsed", "_plain")


def _fields(part: str) -> tuple[str, ...]:
    from ..schemas import INSURANCE_FIELDS, PATIENT_FIELDS

    return PATIENT_FIELDS if part == "patient" else INSURANCE_FIELDS


def tidy_record(record: Column) -> Column:
    """Phones with dashes, state code, ten-digit NPI, names in title case, a full name from its parts."""
    p = record["patient"]
    first, middle, last = (X.title(X.strip(p[f])) for f in ("first_name", "middle_name", "last_name"))
    changed = {f: X.record_phone(p[f]) for f in ("phone", "mobile_landline", "fax")}
    changed |= {"first_name": first, "middle_name": middle, "last_name": last, "state_code": X.record_state_code(p["state_code"], p["state"])}
    changed["full_name"] = X.record_full_name(p["full_name"], first, middle, last)
    patient = F.struct(*[changed.get(f, p[f]).alias(f) for f in _fields("patient")])
    return F.struct(patient.alias("patient"), record["doctor"].alias("doctor"), record["insurance"].alias("insurance"), record["dme"].alias("dme"))


def has_content(response: Column) -> Column:
    """Whether a reply ``struct<choices: array<struct<message: struct<content>>>>`` has text in it."""
    return ~X.is_blank(content(response))


def content(response: Column) -> Column:
    return X.text(F.get(response["choices"], F.lit(0))["message"]["content"])


def capability_report(available: dict[str, str]) -> list[tuple[str, str]]:
    """Engines and versions as rows, by name."""
    return sorted(available.items())


#: What a prompt asks for: one page's record, or the persons of a run of pages.
RECORD_PROMPT = "Return the persons' data on this page as one JSON object with the keys patient, doctor, insurance and dme. Leave unknown values empty.\n\n%s"
PERSONS_PROMPT = "List every person on these pages with name, date of birth and page numbers, as one JSON object.\n\n%s"


def prompts(texts: DataFrame, template: str = RECORD_PROMPT, text_col: str = "text") -> DataFrame:
    """``texts`` with ``prompt``."""
    return texts.withColumn("prompt", F.format_string(template, F.col(text_col)))


def setting(spark, model: str, name: str, default: float) -> float:
    """``foliolink.<model>.<name>`` of the session as a number, else ``foliolink.default.<name>``, else the default; a value that is no number is warned of and passed over."""
    for key in (f"foliolink.{model}.{name}", f"foliolink.default.{name}"):
        value = spark.conf.get(key, None)
        try:
            if value:
                return float(value)
        except ValueError:
            warnings.warn(f"{key} is no number: {value!r}", stacklevel=2)
    return default


#: Names under which a service's key is looked for, in this order.
KEY_NAMES = ("{service}_API_KEY", "{service}_KEY", "{service}", "API_KEY")


def service_key(service: str, environment: Mapping[str, str]) -> str:
    """The key of a service from the first of :data:`KEY_NAMES` that is set, without white space around it; the shared name is warned of.

    Read it on the driver and hand it to ``make``; it is never part of a table or a plan.
    """
    names = [n.format(service=service.upper()) for n in KEY_NAMES]
    found = next((n for n in names if environment.get(n, "").strip()), None)
    if found is None:
        raise KeyError(f"no key for {service}; looked for {', '.join(names)}")
    if found == names[-1]:
        warnings.warn(f"{service} uses the shared key {found}", stacklevel=2)
    return environment[found].strip()
