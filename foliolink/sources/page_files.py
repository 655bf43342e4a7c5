"""A data source of mixed files: extracted-page JSON, page images and documents, by suffix.

``spark.dataSource.register(PageFiles)``, then ``spark.read.format("page_files").load(folder)``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

#: Kinds of files by suffix; others are never listed.
KINDS = {"json": "pages", "pdf": "document", "png": "image", "jpg": "image", "jpeg": "image", "tif": "image", "tiff": "image", "bmp": "image", "webp": "image"}
SCHEMA = (
    "path string, stem string, suffix string, kind string, length long, modified timestamp, pos int, page_number int, text string, "
    "confidence double, success boolean, content binary, error string"
)
#: Bytes of files that a task reads, unless ``partitionBytes`` says otherwise.
PARTITION_BYTES = 64 << 20


class Files(InputPartition):
    """Files of one task."""

    def __init__(self, files: list[tuple[str, str, str, int, float]]):
        self.files = files


def _compare(filter_: Filter, value) -> bool | None:
    """Whether a file's value passes; None for a kind of filter that isn't known."""
    if isinstance(filter_, In):
        return value in filter_.value
    if isinstance(filter_, StringStartsWith):
        return value.startswith(filter_.value)
    for kind, holds in ((EqualTo, value.__eq__), (GreaterThan, value.__gt__), (GreaterThanOrEqual, value.__ge__), (LessThan, value.__lt__), (LessThanOrEqual, value.__le__)):
        if isinstance(filter_, kind):
            return holds(filter_.value)
    return None


class PageFilesReader(DataSourceReader):
    """Lists the files once on the driver, leaves out what filters rule out, and packs the rest into tasks by size."""

    def __init__(self, options: dict[str, str]):
        if not options.get("path"):
            raise ValueError("a folder is needed: load(path)")
        self.root = options["path"]
        self.size = int(options.get("partitionbytes", PARTITION_BYTES))
        wanted = options.get("suffixes")
        self.suffixes = {s.strip().lower().lstrip(".") for s in wanted.split(",")} if wanted else set(KINDS)
        if unknown := self.suffixes - set(KINDS):
            raise ValueError(f"unknown suffixes: {', '.join(sorted(unknown))}")
        self.content = options.get("content", "true").lower() == "true"
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on the files' own columns prune the list; others stay with Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            sample = {"path": "", "stem": "", "suffix": "", "kind": "", "length": 0}.get(column)
            try:
                known = sample is not None and _compare(f, sample) in (True, False)
            except TypeError:
                known = False
            if known:
                self.filters.append(f)
            else:
                yield f

    def _passes(self, file: tuple[str, str, str, int, float]) -> bool:
        path, stem, suffix, length, _ = file
        values = {"path": path, "stem": stem, "suffix": suffix, "kind": KINDS[suffix], "length": length}
        return all(_compare(f, values[f.attribute[0]]) for f in self.filters)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), self.root)
        found = []
        for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
            stem, _, suffix = info.base_name.rpartition(".")
            if info.type == fs.FileType.File and suffix.lower() in self.suffixes and not info.base_name.startswith((".", "_")):
                when = info.mtime.timestamp() if info.mtime else 0.0
                found.append((info.path, stem, suffix.lower(), info.size or 0, when))
        parts: list[list] = []
        room = 0
        for file in sorted(f for f in found if self._passes(f)):
            if room <= 0:
                parts.append([])
                room = self.size
            parts[-1].append(file)
            room -= max(file[3], 1 << 12)
        return [Files(p) for p in parts] or [Files([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        scheme = self.root.split("://")[0] + "://" if "://" in self.root else None
        store = fs.FileSystem.from_uri(self.root)[0] if scheme else fs.LocalFileSystem()
        for path, stem, suffix, length, modified in partition.files:
            kind = KINDS[suffix]
            head = (path, stem, suffix, kind, length, datetime.fromtimestamp(modified, timezone.utc))
            try:
                if kind == "pages" or self.content:
                    with store.open_input_stream(path) as f:
                        body = f.read()
                if kind != "pages":
                    yield (*head, None, None, None, None, None, body if self.content else None, None)
                    continue
                pages = list(self._pages(json.loads(body)))
            except Exception as e:  # noqa: BLE001  a broken file is a row
                yield (*head, None, None, None, None, False, None, f"{type(e).__name__}: {e}"[:300])
                continue
            for page in pages:
                yield (*head, *page, None, None)

    @staticmethod
    def _pages(file: dict) -> Iterator[tuple]:
        if not isinstance(file, dict) or not isinstance(file.get("pages"), list):
            raise ValueError("no list of pages")
        for pos, page in enumerate(file["pages"]):
            number, sure = page.get("page_number"), page.get("confidence")
            yield pos, int(pos + 1 if number is None else number), str(page.get("text") or ""), float(sure or 0.0), bool(page.get("success", False))


class PageFiles(DataSource):
    """Rows of files by suffix: a row per page of extracted-page JSON, a row per image or document with its bytes.

    Options: ``suffixes`` (comma-separated, all known ones by default), ``partitionBytes``, and
    ``content`` (``false`` leaves bytes unread). A file that can't be read or lacks pages is one row with
    its ``error``. Missing page fields have the defaults of :func:`pages.pages_of`. Hidden files and other suffixes are passed over.
    """

    @classmethod
    def name(cls) -> str:
        return "page_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PageFilesReader(self.options)
