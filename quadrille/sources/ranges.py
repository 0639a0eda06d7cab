"""Files read by range, through Arrow's file systems."""

from __future__ import annotations

from pyarrow import fs


class RangeFile:
    """Bytes of a file by place; counts what it reads. Local paths, and the stores that Arrow knows by their scheme."""

    def __init__(self, path: str):
        store, inside = fs.FileSystem.from_uri(path) if "://" in path or path.startswith(("/", "file:")) else (fs.LocalFileSystem(), path)
        self.file, self.bytes_read = store.open_input_file(inside), 0

    def __call__(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(n)
        self.bytes_read += len(data)
        return data

    def size(self) -> int:
        return self.file.size()
