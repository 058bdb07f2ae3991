"""Files that tasks write and read themselves, in any folder that pyarrow's file systems reach and the cluster shares."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.fs


def located(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI (file:/x as Hadoop writes it, too) and the path within it."""
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return pyarrow.fs.LocalFileSystem(), path
    return pyarrow.fs.FileSystem.from_uri(path)


def listed(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """(path, bytes) of the files below a folder, or of a file."""
    files, at = located(path)
    info = files.get_file_info(at)
    found = [info] if info.type == pyarrow.fs.FileType.File else files.get_file_info(pyarrow.fs.FileSelector(at, allow_not_found=True, recursive=True))
    return sorted((x.path, x.size) for x in found if x.type == pyarrow.fs.FileType.File and x.path.endswith(suffix) and not x.base_name.startswith((".", "_")))


def there(path: str) -> bool:
    files, at = located(path)
    return files.get_file_info(at).type == pyarrow.fs.FileType.File


def opened(path: str):
    """A file to read from any place."""
    files, at = located(path)
    return files.open_input_file(at)


def read(path: str) -> bytes:
    with opened(path) as f:
        return f.read()


def written(path: str, data: bytes) -> None:
    """The file as a whole or not at all: it is written beside and moved, in place of one that is there."""
    files, at = located(path)
    folder, name = at.rsplit("/", 1)
    files.create_dir(folder, recursive=True)
    beside = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(beside) as f:
        f.write(pa.py_buffer(data))
    files.move(beside, at)
