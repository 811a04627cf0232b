"""Portable pixmaps: a decoder for whole ones, and large ones as a source of strips, of which each task reads its own lines alone."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docforge.operators.strips import STRIP_BYTES

#: Bytes of a file for each task that reads it, about.
SLICE_BYTES = 64 << 20
#: What opening a file counts for, in bytes, when slices are dealt to tasks; slices' bytes in a task, where slices are small.
OPEN_BYTES, TOGETHER = 128 << 10, 2048
#: The most bytes of a header, comments included.
HEAD_BYTES = 4096
_APART = rb"(?:\s|#[^\n]*\n)+"
_PLAIN = re.compile(rb"P([56])" + _APART + rb"(\d+)" + _APART + rb"(\d+)" + _APART + rb"(\d+)\s")
_NAMED = re.compile(rb"P7\n(?:[^\n]*\n)*?ENDHDR\n")


def header(head: bytes) -> tuple[int, int, int, int]:
    """Width, height, channels and the offset of the first pixel; binary grey, colour and arbitrary maps of one byte a channel."""
    if m := _PLAIN.match(head):
        w, h, most = (int(m[k]) for k in (2, 3, 4))
        n = 1 if m[1] == b"5" else 3
    elif m := _NAMED.match(head):
        said = dict(line.split(None, 1) for line in m[0].splitlines()[1:-1] if line and not line.startswith(b"#") and b" " in line)
        w, h, n, most = (int(said[k]) for k in (b"WIDTH", b"HEIGHT", b"DEPTH", b"MAXVAL"))
    else:
        raise ValueError("no binary pixmap")
    if most != 255 or n not in (1, 3, 4):
        raise ValueError(f"{n} channels up to {most} are not read")
    return w, h, n, m.end()


def decoder():
    """An adapter as ``operators.convert`` takes it."""

    def decode(content: bytes) -> np.ndarray:
        w, h, n, at = header(content[:HEAD_BYTES])
        if len(content) < at + w * h * n or not w * h:
            raise ValueError("the pixels end early")
        pixels = np.frombuffer(content, np.uint8, w * h * n, at).reshape(h, w, n)
        return pixels if n > 1 else np.repeat(pixels, 3, axis=2)

    return decode


class StripSource(DataSource):
    """The source ``docforge_strips``: path, y, w, h, channels, pixels, error of the portable pixmaps of a folder.

    Options: ``path``, a URI that all tasks reach; ``slice_bytes``; ``strip_bytes``. A file of k slices is in k partitions; each seeks to its
    own lines, so no task holds more than a strip. Slices of many files share a partition, up to SLICE_BYTES (or TOGETHER slices where these are small), with OPEN_BYTES for each. A file whose header can't be read or whose pixels end early gives one row with its error and no
    strips; one without pixels gives none.
    """

    @classmethod
    def name(cls) -> str:
        return "docforge_strips"

    def schema(self) -> str:
        return "path string, y long, w long, h long, channels int, pixels binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return _StripReader(self.options)


class _Slices(InputPartition):
    """Slices of files, each a path, its size, the slice's number and how many the file has."""

    def __init__(self, slices: list[tuple[str, int, int, int]]):
        self.slices = slices


class _StripReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.slice_bytes, self.strip_bytes = int(options.get("slice_bytes", SLICE_BYTES)), int(options.get("strip_bytes", STRIP_BYTES))

    def partitions(self) -> list[_Slices]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.folder)
        found = [i for i in store.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.File and re.search(r"(?i)\.(pnm|p[gpa]m)\Z", i.base_name)]
        slices = [(i.path, i.size, k, of) for i in sorted(found, key=lambda i: i.path) for of in [max(1, -(-i.size // self.slice_bytes))] for k in range(of)]
        whole = sum(i.size for i in found) + OPEN_BYTES * len(slices)
        parts = max(-(-whole // min(SLICE_BYTES, TOGETHER * self.slice_bytes)), max((of for _, _, _, of in slices), default=0))
        return [_Slices(slices[k::parts]) for k in range(parts)]  # slices of one file follow each other, so no two share a partition

    def read(self, partition: _Slices) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.folder)
        for own in partition.slices:
            yield from self._strips(store, *own)

    def _strips(self, store, path: str, size: int, number: int, of: int) -> Iterator[tuple]:
        said = path.rsplit("/", 1)[-1]
        with store.open_input_file(path) as f:
            try:
                w, h, n, at = header(f.read(HEAD_BYTES))
                if size < at + w * h * n:
                    raise ValueError("the pixels end early")
            except ValueError as e:
                if number == 0:
                    yield said, None, None, None, None, None, str(e)
                return
            first, last = h * number // of, h * (number + 1) // of
            lines = max(1, self.strip_bytes // max(1, w * n))
            for y in range(first, last if w else first, lines):
                f.seek(at + y * w * n)
                yield said, y, w, h, n, f.read(min(lines, last - y) * w * n), None
