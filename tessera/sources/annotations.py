"""Data sources of annotation folders and image sizes: groups of small files as partitions.

A file that holds no box still gives a row, so a label without a usable line isn't lost. Images are measured by their
headers; pixels stay undecoded."""

from __future__ import annotations

from pathlib import PurePosixPath
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of the files that one partition reads, a file counting for 4 KB at least.
GROUP_BYTES = 16 << 20

BOXES = {
    "yolo": "image string, path string, box_index int, line int, category string, cx double, cy double, w double, h double",
    "voc": "image string, path string, box_index int, category string, x0 int, y0 int, x1 int, y1 int, width int, height int",
    "size": "image string, path string, width int, height int",
}
ENDINGS = {"yolo": (".txt",), "voc": (".xml",), "size": (".png", ".jpg", ".jpeg")}


def _fs(at: str):
    from pyarrow import fs

    if at.startswith("file:"):
        return fs.LocalFileSystem(), "/" + at.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(at) if "://" in at else (fs.LocalFileSystem(), at)


def yolo_rows(text: str):
    """(box_index, line, category, cx, cy, w, h) of the lines of at least five fields; box_index counts those lines."""
    n = 0
    for i, line in enumerate(text.splitlines()):
        parts = line.split()
        if len(parts) >= 5:
            yield (n, i, parts[0], *map(_number, parts[1:5]))
            n += 1


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def voc_rows(content: bytes):
    """(box_index, category, x0, y0, x1, y1, width, height) of the objects that have a box; box_index counts those.
    An object without a name is unknown; without a stated size, width and height are null."""
    root = ElementTree.fromstring(content)
    size = [root.findtext(f"size/{c}") for c in ("width", "height")]
    size = [int(float(s)) for s in size] if all(size) else [None, None]
    n = 0
    for o in root.findall("object"):
        box = o.find("bndbox")
        if box is not None:
            name = o.findtext("name")
            yield (n, name.strip() if name else "unknown", *[int(float(box.findtext(c))) for c in ("xmin", "ymin", "xmax", "ymax")], *size)
            n += 1


def size_of(f) -> tuple[int, int] | None:
    """Width and height that a PNG or JPEG file's header states, read from its first bytes; None of another file."""
    head = f.read(24)
    if head[:8] == b"\x89PNG\r\n\x1a\n" and len(head) == 24:
        return int.from_bytes(head[16:20]), int.from_bytes(head[20:24])
    if head[:2] != b"\xff\xd8":
        return None
    at = 2
    while True:  # from one segment's head to the next one's
        f.seek(at)
        part = f.read(9)
        if len(part) < 9 or part[0] != 0xFF:
            return None
        if part[1] == 0xFF or part[1] == 0x01 or 0xD0 <= part[1] <= 0xD8:
            at += 1 if part[1] == 0xFF else 2
        elif 0xC0 <= part[1] <= 0xCF and part[1] not in (0xC4, 0xC8, 0xCC):  # a frame's head
            return int.from_bytes(part[7:9]), int.from_bytes(part[5:7])
        else:
            at += 2 + int.from_bytes(part[2:4])


class Group(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class Reader(DataSourceReader):
    def __init__(self, kind: str, paths: list[str]):
        self.kind, self.paths = kind, paths

    def partitions(self) -> list[Group]:
        from pyarrow import fs

        groups, size = [[]], 0
        for at in self.paths:
            files, path = _fs(at)
            prefix = at[: len(at) - len(path)] if at.endswith(path) else "file://"
            one = files.get_file_info(path)
            found = [one] if one.is_file else files.get_file_info(fs.FileSelector(path, recursive=True))
            for info in sorted(found, key=lambda i: i.path):
                if info.is_file and info.extension.lower() in [e[1:] for e in ENDINGS[self.kind]]:
                    if size and size + max(info.size, 4096) > GROUP_BYTES:
                        groups.append([])
                        size = 0
                    groups[-1].append(prefix + info.path)
                    size += max(info.size, 4096)
        return [Group(g) for g in groups]

    def read(self, partition: Group):
        for at in partition.files:
            files, path = _fs(at)
            stem = PurePosixPath(path).stem
            if self.kind == "size":
                with files.open_input_file(path) as f:
                    if (size := size_of(f)) is not None:
                        yield (stem, at, *size)
                continue
            with files.open_input_stream(path) as f:
                content = f.read()
            n = 0
            for row in yolo_rows(content.decode("utf-8", "replace")) if self.kind == "yolo" else voc_rows(content):
                yield (stem, at, *row)
                n += 1
            if not n:
                yield (stem, at, -1, *[None] * (BOXES[self.kind].count(",") - 2))


class Annotations(DataSource):
    """``kind``: yolo, voc or size; ``path``: a folder or a file, or several with a line break between them."""

    @classmethod
    def name(cls) -> str:
        return "annotations"

    def schema(self) -> str:
        return BOXES[self.options["kind"]]

    def reader(self, schema) -> Reader:
        return Reader(self.options["kind"], self.options["path"].split("\n"))


def scan(spark: SparkSession, kind: str, paths: str | list[str]) -> DataFrame:
    """Rows of all files of the kind below the folders. Files without a box have one row, with box_index -1."""
    spark.dataSource.register(Annotations)
    return spark.read.format("annotations").option("kind", kind).option("path", paths if isinstance(paths, str) else "\n".join(paths)).load()


def sizes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """image (stem), path, width, height of PNG and JPEG files, by their headers."""
    return scan(spark, "size", paths)
