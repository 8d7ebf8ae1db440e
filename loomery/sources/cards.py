"""Cards as a source and a sink of Spark: Markdown files with front matter, one a card.

``spark.dataSource.register(CardSource)``, then ``df.write.format("cards").save(root)`` and
``spark.read.format("cards").load(root)``.  A card has stage, layer, artifact_id, title and content; stage and layer are
folders below a folder a writing task.  A task writes below ``_pending``, where no reader looks;
the commit moves each task's folder as a whole to its place, so what becomes visible is as many
moves as there were tasks, and a failed or repeated task leaves nothing behind.  Readers get a
task's folder each.

``root`` is a path that driver and executors share (any file system that pyarrow knows by its address).
Other parts of a name than letters, digits, ``.``, ``_`` and ``-`` are written as ``%`` and their code.

Defined results: a null title is left out and a null content empty; a null stage, layer or id raises;
a card of the same name from another write stands beside the first (``overwrite`` removes the others).
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "stage string, layer string, artifact_id string, title string, content string"
_RULE = "---\n"


def _system(root: str):
    from pyarrow import fs

    if re.match(r"^[a-z0-9]+://", root):
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), root.removeprefix("file:")


def _safe(name: str) -> str:
    return quote(name, safe="").replace("~", "%7E") if name not in (".", "..") else name.replace(".", "%2E")


def card_text(title: str | None, content: str | None) -> str:
    head = f"title: {json.dumps(title, ensure_ascii=False)}\n" if title is not None else ""
    return f"{_RULE}{head}{_RULE}\n{content or ''}"


def parsed_card(text: str) -> tuple[str | None, str]:
    """(title, content); a file without front matter is content alone."""
    if not text.startswith(_RULE) or (end := text.find(_RULE, len(_RULE))) < 0:
        return None, text
    title = None
    for line in text[len(_RULE) : end].splitlines():
        if line.startswith("title: "):
            title = json.loads(line[7:])
    return title, text[end + len(_RULE) :].removeprefix("\n")


@dataclass
class _Folder(InputPartition):
    path: str


@dataclass
class _Written(WriterCommitMessage):
    folder: str | None


class CardReader(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root = root

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, base = _system(self.root)
        found = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
        folders = [x.path for x in found if x.type == fs.FileType.Directory and x.base_name[:1] not in ("_", ".")]
        return [_Folder(p) for p in sorted(folders)] or [_Folder("")]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        from pyarrow import fs

        if not partition.path:
            return
        system, _ = _system(self.root)
        files = [x for x in system.get_file_info(fs.FileSelector(partition.path, recursive=True)) if x.type == fs.FileType.File and x.extension == "md"]
        for x in sorted(files, key=lambda x: x.path):
            stage, layer, name = map(unquote, x.path.removesuffix(".md").split("/")[-3:])
            with system.open_input_stream(x.path) as f:
                yield (stage, layer, name, *parsed_card(f.read().decode("utf-8", "replace")))


class CardWriter(DataSourceWriter):
    def __init__(self, root: str, overwrite: bool) -> None:
        self.root, self.overwrite, self.job = root, overwrite, uuid.uuid4().hex

    def _pending(self, base: str) -> str:
        return f"{base}/_pending/{self.job}"

    def write(self, iterator) -> WriterCommitMessage:
        system, base = _system(self.root)
        own = TaskContext.get()
        folder = f"{self._pending(base)}/{self.job}-{own.partitionId()}-{own.taskAttemptId()}"
        count, known = 0, set()
        for row in iterator:
            if row.stage is None or row.layer is None or row.artifact_id is None:
                raise ValueError("a card needs a stage, a layer and an id")
            place = f"{folder}/{_safe(row.stage)}/{_safe(row.layer)}"
            if place not in known:
                system.create_dir(place, recursive=True)
                known.add(place)
            with system.open_output_stream(f"{place}/{_safe(row.artifact_id)}.md") as f:
                f.write(card_text(row.title, row.content).encode("utf-8", "surrogatepass"))
            count += 1
        return _Written(folder if count else None)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        system, base = _system(self.root)
        system.create_dir(base, recursive=True)
        old = [x.path for x in system.get_file_info(fs.FileSelector(base)) if x.type == fs.FileType.Directory and x.base_name[:1] != "_"]
        for m in messages:
            if m is not None and m.folder:
                system.move(m.folder, f"{base}/{m.folder.rsplit('/', 1)[1]}")
        if self.overwrite:
            for path in old:
                system.delete_dir(path)
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        system, base = _system(self.root)
        if system.get_file_info(self._pending(base)).type != fs.FileType.NotFound:
            system.delete_dir(self._pending(base))


class CardSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> CardReader:
        return CardReader(self.options["path"].rstrip("/"))

    def writer(self, schema: StructType, overwrite: bool) -> CardWriter:
        return CardWriter(self.options["path"].rstrip("/"), overwrite)
