"""Pages of large files as a source: each file is read by as many tasks as its size asks for, each page by one of them."""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator
from itertools import islice

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from docforge.operators.convert import ITEM, LEAST_LAYER, drawn, visible_units
from docforge.options import Options
from docforge.sources.sinks import HELD

#: Bytes of a file for each task that reads it, about.
SLICE_BYTES = 32 << 20
#: Bytes of whole small files for a task, about, and what opening one counts as; a folder of less than LEAST_TASKS such tasks is dealt over as many.
TASK_BYTES, OPEN_BYTES, LEAST_TASKS = 32 << 20, 64 << 10, 16


class PageSource(DataSource):
    """The source ``docforge_pages``: path, page_no, items, content, error of the pages of a folder's files.

    Options: ``path``, a URI that all tasks reach; ``reader``, module:function of an adapter as in ``operators.convert``, which should read
    a page's content only when it is asked for; ``extension`` (.pdf); ``slice_bytes``; ``options``, the fields of Options as JSON.

    A file of k slices is read by as many tasks, each of which takes its own run of page numbers, so no page is read twice; slices of many files share a
    task, where they are small, so tasks grow with the bytes and not with the files. A page whose text layer is
    enough has its items and no content; any other has its drawn, enhanced image at once, so nothing is read again to draw it. A file
    that can't be read gives one row with its error (of its first slice), a page that can't be read or drawn one with its own; a file without pages gives
    none. With the option ``parts`` the files lie in the folders that ``path`` holds (``sinks.publish`` by parts): each is listed by the tasks that read it, so
    the driver holds the names of the folders only; slices of one file still go to as many tasks, in turn. With the option ``pushdown`` (needs spark.sql.python.filterPushdown.enabled) bounds on page_no keep other pages unread; rows of
    unread files, whose page_no is null, never pass such bounds.
    """

    @classmethod
    def name(cls) -> str:
        return "docforge_pages"

    def schema(self) -> str:
        return f"path string, page_no int, items array<{ITEM}>, content binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return (_NarrowedReader if self.options.get("pushdown") == "true" else _PageReader)(self.options)


class _Slice(InputPartition):
    """Slices, each a path, the slice's number and how many the file has."""

    def __init__(self, slices: list[tuple[str, int, int]]):
        self.slices = slices


class _Share(InputPartition):
    """Every ``of``-th slice of a part's files, from the ``number``-th on."""

    def __init__(self, part: str, number: int, of: int):
        self.part, self.number, self.of = part, number, of


class _PageReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.adapter = options["path"], options["reader"]
        self.extension, self.slice_bytes = options.get("extension", ".pdf").lower(), int(options.get("slice_bytes", SLICE_BYTES))
        self.options = Options(**json.loads(options.get("options", "{}")))
        self.parts = options.get("parts") == "true"
        self.low, self.high = 1, None

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.folder)
        if self.parts:
            return self._shares(store, root)
        sized = self._sized(store, root)
        whole = sum(size + OPEN_BYTES * of for _, size, of in sized)
        room = min(TASK_BYTES, whole // LEAST_TASKS)
        # the slices of one file go to tasks of different turns, so that a large file is never read by one task alone
        turns: dict[int, list] = {}
        for path, size, of in sized:
            for k in range(of):
                turns.setdefault(k, []).append((path, k, of, size // of + OPEN_BYTES))
        parts: list[_Slice] = []
        for own in turns.values():
            held = room
            for path, k, of, cost in own:
                if held + cost > room:
                    parts.append(_Slice([]))
                    held = 0
                parts[-1].slices.append((path, k, of))
                held += cost
        return sorted(parts, key=lambda p: p.slices[0])

    def _sized(self, store, folder: str) -> list[tuple[str, int, int]]:
        """Path, bytes and slices of a folder's files, by path."""
        from pyarrow import fs

        found = [i for i in store.get_file_info(fs.FileSelector(folder)) if i.type == fs.FileType.File and i.base_name.lower().endswith(self.extension) and not i.base_name.startswith(".")]
        return [(i.path, i.size, max(1, -(-i.size // self.slice_bytes))) for i in sorted(found, key=lambda i: i.path)]

    def _shares(self, store, root: str) -> list[_Share]:
        """As many tasks for each part as its bytes ask for. What a part holds is told by its own note, or by a list of it alone that isn't kept."""
        from pyarrow import fs

        held = {}
        for part in sorted(i.path for i in store.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.Directory and not i.base_name.startswith((".", "_"))):
            if store.get_file_info(f"{part}/{HELD}").type == fs.FileType.NotFound:
                sized = self._sized(store, part)
                files, size = len(sized), sum(x[1] for x in sized)
            else:
                with store.open_input_stream(f"{part}/{HELD}") as f:
                    files, size = map(int, f.read().split())
            held[part] = size + OPEN_BYTES * (files + size // self.slice_bytes)
        room = max(1, min(TASK_BYTES, sum(held.values()) // LEAST_TASKS))
        return [_Share(part, k, of) for part, cost in held.items() for of in [max(1, -(-cost // room))] for k in range(of)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.folder)
        module, function = self.adapter.split(":")
        adapter = getattr(importlib.import_module(module), function)()
        slices = partition.slices if isinstance(partition, _Slice) else islice(((path, k, of) for path, _, of in self._sized(store, partition.part) for k in range(of)), partition.number, None, partition.of)
        for own in slices:
            yield from self._slice(store, adapter, *own)

    def _slice(self, store, adapter, path: str, number: int, of: int) -> Iterator[tuple]:
        said = path.rsplit("/", 1)[-1]
        try:
            with store.open_input_file(path) as f:
                pages = adapter(f.read())
            n = len(pages)
        except Exception as e:  # noqa: BLE001  (kept as a value of the row)
            if number == 0:
                yield said, None, None, None, str(e)
            return
        first, last = n * number // of + 1, n * (number + 1) // of
        for k in range(max(first, self.low), min(last, self.high if self.high is not None else last) + 1):
            try:
                yield self._page(said, k, pages[k - 1])
            except Exception as e:  # noqa: BLE001  (kept as a value of the row)
                yield said, k, None, None, str(e)

    def _page(self, said: str, k: int, page) -> tuple:
        items = [{"str": i.get("str"), "transform": i.get("transform"), "width": i.get("width"), "height": i.get("height")} for i in page.items]
        if self.options.pdf_text and visible_units(i["str"] for i in items) >= LEAST_LAYER:
            return said, k, [tuple(i.values()) for i in items], None, None
        return said, k, None, drawn(page, self.options), None


class _NarrowedReader(_PageReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  (Spark's name)
        for f in filters:
            bounds = {EqualTo: (0, 0), GreaterThan: (1, None), GreaterThanOrEqual: (0, None), LessThan: (None, -1), LessThanOrEqual: (None, 0)}.get(type(f))
            if bounds is None or getattr(f, "attribute", None) != ("page_no",) or not isinstance(f.value, int):
                yield f
                continue
            if bounds[0] is not None:
                self.low = max(self.low, f.value + bounds[0])
            if bounds[1] is not None:
                self.high = min(self.high if self.high is not None else f.value + bounds[1], f.value + bounds[1])
