"""A folder tree as a data source: one row per file, listed by the tasks."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "path string, extension string, size bigint"


def extension(name: str) -> str:
    """Everything from the last dot on, in lower case; `""` without a dot."""
    return name[name.rfind("."):].lower() if "." in name else ""


class Folders(InputPartition):
    """The folders of one task: some with all below them, some of which the planner knows the subfolders already."""

    def __init__(self, whole: list[str], alone: list[str]):
        super().__init__(None)
        self.whole, self.alone = whole, alone


class TreeReader(DataSourceReader):
    """Folders are listed while planning until there are enough for the tasks, which list what lies below.

    The planner holds names of folders alone, not of files: at most `tasks` and the subfolders of
    one folder more. Files of other extensions are left out while listing if the query filters on `extension`.
    """

    def __init__(self, root: str, excluded: set[str], skip_hidden: bool, tasks: int):
        self.root, self.excluded, self.skip_hidden, self.tasks = root, excluded, skip_hidden, tasks
        self.extensions: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 (name of the interface)
        for condition in filters:
            if isinstance(condition, (EqualTo, In)) and condition.attribute == ("extension",):
                asked = {condition.value} if isinstance(condition, EqualTo) else set(condition.value)
                self.extensions = asked if self.extensions is None else self.extensions & asked
            else:
                yield condition

    def _store(self):
        from pyarrow import fs as arrow_fs

        return arrow_fs.FileSystem.from_uri(self.root)

    def entries(self, store, folder: str) -> tuple[list[str], list]:
        """The subfolders to enter and the wanted files of one folder."""
        from pyarrow import fs as arrow_fs

        folders, files = [], []
        for info in store.get_file_info(arrow_fs.FileSelector(folder)):
            if info.type == arrow_fs.FileType.Directory:
                hidden = self.skip_hidden and info.base_name.startswith(".")
                linked = store.type_name == "local" and os.path.islink(info.path)
                if not (info.base_name in self.excluded or hidden or linked):
                    folders.append(info.path)
            elif info.type == arrow_fs.FileType.File and (self.extensions is None or extension(info.base_name) in self.extensions):
                files.append(info)
        return folders, files

    def partitions(self) -> list[Folders]:
        store, top = self._store()
        whole, alone = [top], []
        while whole and len(whole) < self.tasks:
            folder = whole.pop(0)
            whole += self.entries(store, folder)[0]
            alone.append(folder)
        parts = [Folders(whole[k :: self.tasks], alone[k :: self.tasks]) for k in range(self.tasks)]
        return [p for p in parts if p.whole or p.alone]

    def read(self, partition: Folders) -> Iterator[tuple]:
        store = self._store()[0]
        open_folders = [(f, False) for f in partition.alone] + [(f, True) for f in partition.whole]
        while open_folders:
            folder, deeper = open_folders.pop()
            folders, files = self.entries(store, folder)
            for info in files:
                yield info.path, extension(info.base_name), info.size
            if deeper:
                open_folders += [(f, True) for f in folders]


class FolderTree(DataSource):
    """Options: `path`; `exclude`, names of folders not to enter, parted by `/`; `skipHidden`; `tasks`."""

    @classmethod
    def name(cls) -> str:
        return "folder_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TreeReader:
        o = self.options
        excluded = {name for name in o.get("exclude", "").split("/") if name}
        return TreeReader(o["path"], excluded, o.get("skipHidden", "false").lower() == "true", int(o.get("tasks", "8")))
