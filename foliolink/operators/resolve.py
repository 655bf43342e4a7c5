"""Which pages belong to whom: groups, page runs, confidence, leftovers.

Tables carry ``doc_id``, ``pos`` (place of a page in its document), ``page_number``, the
signature ``sig_name, sig_dob`` and ``confidence``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions import similarity as S
from ..functions.similarity import FIELD_WEIGHTS, blend_of
from ..functions import text as X
from . import linkage

INFO = ("full_name", "first_name", "middle_name", "last_name", "dob")


def exact_groups(pages: DataFrame) -> DataFrame:
    """Adds ``group_no``: pages of a document with equal signatures, numbered by first appearance; pages without a name are left out."""
    named = pages.where("sig_name <> ''")
    first = named.groupBy("doc_id", "sig_name", "sig_dob").agg(F.min("pos").alias("first_pos"))
    numbered = first.withColumn("group_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("first_pos", "sig_name", "sig_dob"))).drop("first_pos")
    return named.join(numbered, ["doc_id", "sig_name", "sig_dob"])


def _record_score(a: dict, b: dict, alike: Callable[[str, str], float]) -> float:
    """Weighted similarity of two persons' fields."""
    total = weight = 0.0
    for field in INFO:
        x, y, w = a[field] or "", b[field] or "", FIELD_WEIGHTS.get(field)
        if w is None or not (x or y):
            continue
        total, weight = total + w * (float(x == y) if field == "dob" else alike(x, y)), weight + w
    return total / weight if weight else 0.0


def _absorbed(person: list[dict], alike: Callable[[str, str], float], merge_at: float) -> list[int]:
    """For each person in order the one that it becomes: an earlier one that agrees to ``merge_at``, the fuller of both standing for it, the earlier on a tie."""
    person, goes_to = list(person), list(range(len(person)))
    filled = lambda p: sum(bool((p[f] or "").strip()) for f in INFO)
    for i in range(len(person)):
        for j in range(i + 1, len(person)) if goes_to[i] == i else ():
            if goes_to[j] == j and _record_score(person[i], person[j], alike) >= merge_at:
                goes_to[j] = i
                person[i] = max(person[i], person[j], key=filled)
    return goes_to


def _numbered(rows: list[dict], alike: Callable[[str, str], float], threshold: float, need_dob: bool, merge_at: float) -> list[tuple]:
    """``(doc_id, sig_name, sig_dob, lone, group_no)`` of one document's signatures, in order of first appearance.

    A page without a date fits any group of its name; a page with one needs the group to have the same.
    """
    opened: list[dict] = []
    number = []
    for row in rows:
        dob = row["sig_dob"]
        fits = (k for k, g in enumerate(opened) if alike(row["sig_name"], g["sig_name"]) >= threshold and (not (need_dob and dob) or dob == g["sig_dob"]))
        at = next(fits, len(opened))
        if at == len(opened):
            opened.append(row)
        number.append(at)
    goes_to = _absorbed(opened, alike, merge_at)
    kept = {g: k + 1 for k, g in enumerate(dict.fromkeys(goes_to))}
    return [(r["doc_id"], r["sig_name"], r["sig_dob"], r["lone"], kept[goes_to[k]]) for r, k in zip(rows, number)]


SIGNATURE = ["doc_id", "sig_name", "sig_dob", "lone"]
#: Signatures of a document that are folded in one task, at most; beyond, the same groups are found by joins.
FOLDED = 256


def greedy_groups(pages: DataFrame, threshold: float = 0.8, need_dob: bool = True, merge_at: float = 0.95, folded: int = FOLDED) -> DataFrame:
    """Adds ``group_no``: each page joins the first group whose opening signature it resembles, else opens one.

    Groups whose persons agree to ``merge_at`` then become one, the earlier number staying;
    the person with more filled fields stands for it, the earlier on a tie. Only the distinct
    signatures of a document matter, in order of first appearance, which gives the groups
    that page order gives. A one-letter name doesn't resemble itself, so each of its
    pages opens a group. Pages without a name are left out; a null date is an empty one.
    ``pages`` has the columns of :func:`extract.with_person`.

    Documents of up to ``folded`` signatures are folded, many in a task; larger ones go through
    rounds of joins (:mod:`linkage`), so that no document is one task. Both give the same
    groups. Thresholds of 0.7 or less, and merging at 0.9 or less, are always folded, since the joins
    rest on common words.
    """
    named = pages.where("sig_name <> ''")
    lone = F.when(F.length("sig_name") == 1, F.col("pos")).otherwise(F.lit(-1))
    keyed = named.withColumns({"sig_dob": X.text(F.col("sig_dob")), "lone": lone})
    opening = F.min_by(F.struct(*INFO), F.col("pos")).alias("info")
    seen = keyed.groupBy(*SIGNATURE).agg(F.min("pos").alias("first_pos"), opening).select(*SIGNATURE, "first_pos", "info.*")
    if threshold <= linkage.LETTERS or merge_at <= 0.9:
        return keyed.join(_folded(seen, threshold, need_dob, merge_at), SIGNATURE).drop("lone")
    seen = scratch.keep(seen, "signatures")
    large = linkage.wide(seen.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > folded).select("doc_id"))
    if large.isEmpty():
        groups = _folded(seen, threshold, need_dob, merge_at)
    else:
        small = seen.join(large, "doc_id", "left_anti")
        groups = _folded(small, threshold, need_dob, merge_at).unionByName(_joined(seen.join(large, "doc_id", "left_semi"), threshold, need_dob, merge_at))
    return keyed.join(linkage.wide(groups), SIGNATURE).drop("lone")


def _folded(seen: DataFrame, threshold: float, need_dob: bool, merge_at: float) -> DataFrame:
    """``SIGNATURE`` and ``group_no``: rows stream through sorted; a task holds one document's signatures at a time."""

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        alike = lru_cache(1 << 16)(blend_of)  # documents repeat names
        now, rows = object(), []
        for part in parts:
            out = []
            for row in part.to_dict("records"):
                if row["doc_id"] != now:
                    out += _numbered(rows, alike, threshold, need_dob, merge_at)
                    now, rows = row["doc_id"], []
                rows.append(row)
            yield pd.DataFrame(out, columns=named_columns)
        yield pd.DataFrame(_numbered(rows, alike, threshold, need_dob, merge_at), columns=named_columns)

    named_columns = [*SIGNATURE, "group_no"]
    doc = dict(seen.dtypes)["doc_id"]
    lone = dict(seen.dtypes)["lone"]
    ordered = seen.repartition("doc_id").sortWithinPartitions("doc_id", "first_pos", "sig_name", "sig_dob")
    return ordered.mapInPandas(fold, f"doc_id {doc}, sig_name string, sig_dob string, lone {lone}, group_no int")


def _joined(seen: DataFrame, threshold: float, need_dob: bool, merge_at: float) -> DataFrame:
    """What :func:`_folded` gives, by joins.

    Pages with a date only join groups opened with the same date, so they are settled first;
    then each page without one joins the earliest opening page of a like name.
    """
    place = F.struct("first_pos", "sig_name", "sig_dob")
    date = F.col("sig_dob") if need_dob else F.lit("")
    made = seen.groupBy("doc_id", "sig_name", date.alias("date"), "lone").agg(F.min(place).alias("place"), F.min_by(F.struct(*INFO), place).alias("info"))
    nodes = scratch.keep(made.withColumn("node", F.monotonically_increasing_id()), "nodes")
    like = scratch.keep(linkage.like_names(nodes.select("doc_id", F.col("sig_name").alias("name")).distinct(), ["doc_id"], threshold), "like").select("doc_id", "a", "b")
    rows = nodes.select("doc_id", F.col("sig_name").alias("a"), "date", "node", "place")
    others = nodes.select("doc_id", F.col("sig_name").alias("b"), "date", F.col("node").alias("earlier"), F.col("place").alias("opened"))

    def edges(which: str) -> DataFrame:
        met = rows.where(which).join(linkage.wide(like), ["doc_id", "a"]).join(linkage.wide(others.where(which)), ["doc_id", "b", "date"])
        return met.where("opened < place").select("node", "earlier", "opened")

    dated = scratch.keep(edges("date <> ''"), "dated")
    joins = linkage.members_of_first(dated)
    opening = others.where("date <> ''").join(linkage.wide(joins.select(F.col("node").alias("earlier"))), "earlier", "left_anti")
    first_of = opening.groupBy("doc_id", "b").agg(F.min(F.struct("opened", "earlier")).alias("first"))
    near = like.join(linkage.wide(first_of), ["doc_id", "b"]).groupBy("doc_id", "a").agg(F.min("first").alias("first"))
    late = rows.where("date = ''").join(linkage.wide(near), ["doc_id", "a"]).where("first.opened < place")
    late = scratch.keep(late.select("node", "first.earlier", "first.opened"), "late")
    undated = scratch.keep(edges("date = ''"), "undated")
    joins = scratch.keep(joins.unionByName(linkage.members_of_first(undated, late)), "joins")

    possible = dated.unionByName(undated).join(linkage.wide(joins.select(F.col("node").alias("earlier"))), "earlier", "left_anti").select("node", "earlier", "opened")
    home = possible.unionByName(late).join(linkage.wide(joins), "node", "left_semi").groupBy("node").agg(F.min(F.struct("opened", "earlier"))["earlier"].alias("opener"))
    openers = scratch.keep(nodes.join(linkage.wide(joins), "node", "left_anti").select("doc_id", "node", "place", "info"), "openers")
    into = scratch.keep(_merged_openers(openers, merge_at), "into")
    stays = linkage.numbered(openers.join(linkage.wide(into.select("node")), "node", "left_anti").select("doc_id", "place", "node"), ["doc_id"], ["place"], "group_no")
    every = openers.select("node", F.col("node").alias("opener")).unionByName(home)
    moved = every.join(linkage.wide(into.select(F.col("node").alias("opener"), "root")), "opener", "left").select("node", F.coalesce("root", "opener").alias("opener"))
    of = nodes.join(linkage.wide(moved), "node").join(linkage.wide(stays.select(F.col("node").alias("opener"), "group_no")), "opener").select("doc_id", "sig_name", "date", "lone", "group_no")
    return seen.withColumn("date", date).join(linkage.wide(of), ["doc_id", "sig_name", "date", "lone"]).select(*SIGNATURE, "group_no")


def _merged_openers(openers: DataFrame, merge_at: float) -> DataFrame:
    """``(node, root)`` of the openers that become an earlier one.

    Persons can only agree to ``merge_at`` if their dates are the same and so are their full
    names to a bound that leaves the rest of the weight; so only persons linked by that can
    ever meet, and each such set is folded by itself.
    """
    whole = FIELD_WEIGHTS["full_name"] + FIELD_WEIGHTS["first_name"] + FIELD_WEIGHTS["last_name"] + FIELD_WEIGHTS["dob"]
    bound = 1 - (1 - merge_at) * whole / FIELD_WEIGHTS["full_name"]
    used = [F.nullif(X.text(F.col(f"info.{f}")), F.lit("")) for f in ("full_name", "first_name", "last_name")]
    kind = F.when(used[0].isNotNull(), 0).when(used[1].isNotNull(), 1).when(used[2].isNotNull(), 2).otherwise(3)
    keys = ["doc_id", "born", "kind"]
    named = openers.select("doc_id", "node", X.text(F.col("info.dob")).alias("born"), kind.alias("kind"), F.coalesce(*used, F.lit("")).alias("name"))
    named = scratch.keep(named.withColumn("least", F.min("node").over(Window.partitionBy(*keys, "name"))), "named")
    names = named.select(*keys, "name", "least").distinct()
    like = linkage.like_names(names.select(*keys, "name"), keys, max(linkage.LETTERS, bound - 1e-6)).where("a < b")
    links = like.join(linkage.wide(names.select(*keys, F.col("name").alias("a"), F.col("least").alias("x"))), [*keys, "a"]).join(linkage.wide(names.select(*keys, F.col("name").alias("b"), F.col("least").alias("y"))), [*keys, "b"])
    pairs = links.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(named.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")))
    sets = linkage.components(pairs)
    people = openers.join(linkage.wide(sets), "node").select("root", "node", "place", "info.*")

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.assign(_order=[tuple(p.values()) if isinstance(p, dict) else tuple(p) for p in group["place"]]).sort_values("_order")
        goes_to = _absorbed(ordered.to_dict("records"), lru_cache(1 << 12)(blend_of), merge_at)
        nodes = ordered["node"].tolist()
        return pd.DataFrame([(nodes[k], nodes[g]) for k, g in enumerate(goes_to) if g != k], columns=["node", "root"])

    return people.groupBy("root").applyInPandas(fold, "node long, root long")


def islands(pages: DataFrame, keys: tuple[str, ...] = ("doc_id", "group_no"), order: str = "pos") -> DataFrame:
    """Adds ``entry_no``: a page goes on with its group's last entry if its number is the next one, else begins an entry."""
    w = Window.partitionBy(*keys).orderBy(order)
    begins = F.when(F.col("page_number") == F.lag("page_number").over(w) + 1, 0).otherwise(1)
    return pages.withColumn("_begins", begins).withColumn("entry_no", F.sum("_begins").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_begins")


def entries(pages: DataFrame, keys: tuple[str, ...] = ("doc_id", "group_no")) -> DataFrame:
    """One row per entry of :func:`islands`: first and last page, number of pages, range text, mean confidence, id."""
    made = pages.groupBy(*keys, "entry_no").agg(
        F.min("page_number").alias("first_page"),
        F.max("page_number").alias("last_page"),
        F.count("*").alias("n_pages"),
        F.avg("confidence").alias("confidence"),
    )
    same = F.col("first_page") == F.col("last_page")
    text = F.when(same, F.col("first_page").cast("string")).otherwise(F.format_string("%d-%d", "first_page", "last_page"))
    made = made.withColumn("page_range", text)
    return made.withColumn("entry_id", F.concat(patient_id(F.col("group_no")), F.lit("_entry_"), F.col("entry_no"))) if "group_no" in keys else made


def patient_id(number: Column) -> Column:
    """``patient_001`` for 1."""
    return F.format_string("patient_%03d", number)


def page_ranges(pages: DataFrame, keys: tuple[str, ...] = ("doc_id", "group_no")) -> DataFrame:
    """Per group the pages as ``1-3, 5``, and how many there are."""
    one = pages.select(*keys, "page_number").distinct()
    run = F.col("page_number") - F.row_number().over(Window.partitionBy(*keys).orderBy("page_number"))
    runs = one.withColumn("_run", run).groupBy(*keys, "_run").agg(F.min("page_number").alias("a"), F.max("page_number").alias("b"), F.count("*").alias("n"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.format_string("%d-%d", "a", "b"))
    ordered = F.sort_array(F.collect_list(F.struct("a", text.alias("t"))))
    return runs.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda r: r["t"]), ", ").alias("page_range"), F.sum("n").alias("total_pages"))


def group_confidence(entry_rows: DataFrame, keys: tuple[str, ...] = ("doc_id", "group_no")) -> DataFrame:
    """Per group the mean of its entries' confidence, plus 0.05 for each further entry up to 0.1, at most 1."""
    bonus = F.least(F.lit(0.1), (F.count("*") - 1) * 0.05)
    return entry_rows.groupBy(*keys).agg(
        F.count("*").alias("total_entries"),
        F.sum("n_pages").alias("total_pages"),
        F.least(F.lit(1.0), F.coalesce(F.avg("confidence"), F.lit(0.0)) + bonus).alias("group_confidence"),
    )


def unassigned(pages: DataFrame, assigned: DataFrame) -> DataFrame:
    """Pages of the document that no group has."""
    return pages.join(assigned.select("doc_id", "page_number").distinct(), ["doc_id", "page_number"], "left_anti")


def run_summary(pages: DataFrame, group_rows: DataFrame) -> DataFrame:
    """One row per document: patients, entries, assigned and unassigned pages, mean confidence; zeros where there are no groups."""
    per_doc = group_rows.groupBy("doc_id").agg(
        F.count("*").alias("total_patients"), F.sum("total_entries").alias("total_entries"), F.sum("total_pages").alias("assigned_pages"), F.avg("group_confidence").alias("average_confidence")
    )
    all_pages = pages.groupBy("doc_id").agg(F.count("*").alias("total_pages"))
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("total_patients", "total_entries", "assigned_pages")}
    return (
        all_pages.join(per_doc, "doc_id", "left")
        .withColumns(zero | {"average_confidence": F.coalesce("average_confidence", F.lit(0.0))})
        .withColumn("unassigned_pages", F.col("total_pages") - F.col("assigned_pages"))
    )


def patient_confidence(filled: Column, required: int, ocr: Column, share: float = 0.7) -> Column:
    """``share`` of the filled part and the rest of the reading confidence, kept within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), share * filled / required + (1 - share) * ocr))


def signature_classes(people: DataFrame) -> DataFrame:
    """``people`` with ``class_id``, the least ``person_id`` of the document with the same name and date, ``class_size`` and ``n_links``, to how many others.

    Names are the same whatever their case and white space; null is empty.
    """
    keyed = people.withColumns({"_name": X.collapse(F.col("name")), "_dob": X.text(F.col("dob"))})
    keys = ["doc_id", "_name", "_dob"]
    classes = keyed.groupBy(*keys).agg(F.min("person_id").alias("class_id"), F.count("*").alias("class_size"))
    return keyed.join(classes, keys).withColumn("n_links", F.col("class_size") - 1).drop("_name", "_dob")


def token_block_links(people: DataFrame, strict: bool = True) -> DataFrame:
    """All pairs of a document's people (``person_id, name, dob``) that share enough name words and don't differ in date, as ``(doc_id, kind, a, b, common)``.

    People of one name and date are a class, named by the least ``person_id`` of them as in
    :func:`signature_classes`, so copies don't multiply rows. A ``member`` row tells that person ``a`` is in class ``b``. A ``link`` row tells that
    every member of class ``a`` is linked with every later member of class ``b`` by ``common`` words; ``a`` and ``b`` may be one class.

    A pair needs ``min(2, words of the earlier one - 1)`` common words (at least one if
    ``strict``), so classes may be linked one way alone; rows meet by a word that they share, so names without a common word never meet.
    """
    keyed = people.select("doc_id", "person_id", X.collapse(F.col("name")).alias("name"), X.text(F.col("dob")).alias("dob"))
    keys = ["doc_id", "name", "dob"]
    classes = keyed.groupBy(*keys).agg(F.min("person_id").alias("class_id"), F.max("person_id").alias("last"))
    parts = F.split("name", " ")
    need = F.least(F.lit(2), F.size(parts) - 1)
    words = classes.select("doc_id", "class_id", "last", "dob", (F.greatest(need, F.lit(1)) if strict else need).alias("need"), F.explode(F.array_distinct(parts)).alias("word")).where("word <> ''")
    a, b = words.alias("a"), words.alias("b")
    later = F.col("a.class_id") < F.col("b.last")  # some member of b comes after one of a
    dates = (F.col("a.dob") == "") | (F.col("b.dob") == "") | (F.col("a.dob") == F.col("b.dob"))
    met = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.word") == F.col("b.word")) & later & dates)
    common = met.groupBy(F.col("a.doc_id").alias("doc_id"), F.col("a.class_id").alias("a"), F.col("b.class_id").alias("b"), F.col("a.need").alias("need")).agg(F.count("*").alias("common"))
    links = common.where("common >= need").select("doc_id", F.lit("link").alias("kind"), "a", "b", "common")
    members = keyed.join(classes, keys).select("doc_id", F.lit("member").alias("kind"), F.col("person_id").alias("a"), F.col("class_id").alias("b"), F.lit(None).cast("long").alias("common"))
    return links.unionAll(members)


def best_matches(targets: DataFrame, candidates: DataFrame, fields: list[str], threshold: float = 0.7) -> DataFrame:
    """For each target the candidate of its block with the highest record similarity of at least ``threshold``.

    Both have ``block`` (only rows of a block are compared), ``person_id`` and a struct
    ``info``; ties go to the smaller id. Targets without a match have a null ``match_id``.

    A mean of ``threshold`` or more needs a field that scores as much: an equal date or phone, or
    names or addresses that are alike to it. Different records meet by these alone, copies of
    a record as one; a bound without Python leaves out most pairs before they are scored. Below
    0.7, or with fields of other kinds, all records of a block meet instead.
    """
    wanted = [f for f in FIELD_WEIGHTS if f in fields]
    fuzzy = [f for f in wanted if f in S.NAME_FIELDS or f in S.ADDRESS_FIELDS]
    exact = [f for f in wanted if S.exact_key(f, F.lit("")) is not None]
    ours = scratch.keep(targets.select("block", "info").distinct().withColumn("t", F.monotonically_increasing_id()), "targets")
    theirs = scratch.keep(candidates.groupBy("block", "info").agg(F.min("person_id").alias("match_id")).withColumn("c", F.monotonically_increasing_id()), "candidates")
    if threshold < linkage.LETTERS or set(wanted) - {*fuzzy, *exact} or not wanted:
        pairs = ours.select("block", "t").join(theirs.select("block", "c"), "block").select("t", "c")
    else:
        found = []
        for field in exact:
            key = S.exact_key(field, F.col(f"info.{field}")).alias("key")
            found.append(ours.select("block", "t", key).join(theirs.select("block", "c", key), ["block", "key"]).select("t", "c"))
        for field in fuzzy:
            mine, other = (side.select("block", k, X.text(F.col(f"info.{field}")).alias("name")).where("name <> ''") for side, k in ((ours, "t"), (theirs, "c")))
            names = mine.select("block", "name").unionByName(other.select("block", "name")).distinct()
            like = linkage.like_names(names, ["block"], max(linkage.LETTERS, threshold - 1e-6)).select("block", "a", "b")
            found.append(mine.withColumnRenamed("name", "a").join(like, ["block", "a"]).join(other.withColumnRenamed("name", "b"), ["block", "b"]).select("t", "c"))
        pairs = reduce(DataFrame.unionByName, found).distinct()
    met = pairs.join(ours.select("t", F.col("info").alias("x")), "t").join(theirs.select("c", "match_id", F.col("info").alias("y")), "c")
    likely = met.where(S.record_bound(F.col("x"), F.col("y"), fields) >= threshold)
    scored = likely.withColumn("score", S.record_similarity(F.col("x"), F.col("y"), fields)).where(F.col("score") >= threshold)
    best = scored.groupBy("t").agg(F.max(F.struct("score", (-F.col("match_id")).alias("minus"))).alias("best"))
    told = ours.join(best, "t").select("block", "info", (-F.col("best.minus")).alias("match_id"), F.col("best.score").alias("score"))
    return targets.join(told, ["block", "info"], "left").select(F.col("person_id").alias("target_id"), "match_id", "score")


def cohesion(people: DataFrame, fields: list[str]) -> DataFrame:
    """Mean pairwise record similarity per group (``group_id, person_id, info``); 1 for one person.

    The mean is over every pair of the group, near or far, so no index can spare any: groups are meant to be one person's records.
    """
    a, b = people.alias("a"), people.alias("b")
    pairs = a.join(b, (F.col("a.group_id") == F.col("b.group_id")) & (F.col("a.person_id") < F.col("b.person_id"))).select(
        F.col("a.group_id").alias("group_id"), S.record_similarity(F.col("a.info"), F.col("b.info"), fields).alias("s")
    )
    mean = pairs.groupBy("group_id").agg(F.avg("s").alias("cohesion"))
    return people.select("group_id").distinct().join(mean, "group_id", "left").withColumn("cohesion", F.coalesce("cohesion", F.lit(1.0)))
