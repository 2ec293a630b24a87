"""Files of own formats in a folder that all machines share, by its URI: whole writes and range reads from tasks."""

from __future__ import annotations

import uuid

from pyarrow import fs


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(uri)
    return system, path.rstrip("/")


class Writer:
    """A new file under a name of its own. A task that is run again writes another; readers know only files that a finished task named."""

    def __init__(self, uri: str, stem: str, ending: str):
        system, folder = open_store(uri)
        system.create_dir(folder, recursive=True)
        self.name = f"{stem}-{uuid.uuid4().hex}{ending}"
        self.stream = system.open_output_stream(f"{folder}/{self.name}", compression=None)
        self.size = 0

    def write(self, data: bytes) -> int:
        """The offset at which the data begins."""
        at = self.size
        self.stream.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        self.stream.close()


class Reader:
    def __init__(self, uri: str):
        self.system, self.folder = open_store(uri)
        self.open: dict[str, object] = {}

    def read(self, name: str, offset: int, length: int) -> bytes:
        f = self.open.get(name)
        if f is None:
            if len(self.open) > 16:
                self.close()
            f = self.open[name] = self.system.open_input_file(f"{self.folder}/{name}")
        f.seek(offset)
        return f.read(length)

    def close(self) -> None:
        for f in self.open.values():
            f.close()
        self.open = {}
