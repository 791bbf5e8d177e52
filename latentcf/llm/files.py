"""Binary files in the shared folder, written by tasks (Spark itself has no writer for them)."""

from __future__ import annotations

import uuid


def filesystem(uri: str):
    """pyarrow file system and path of a URI (file:, hdfs:, s3:, gs: ...) or an absolute path."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


class Publisher:
    """A file that appears under its name only when it is whole: tasks that are lost or run
    twice leave nothing under the name but one attempt's complete file."""

    def __init__(self, folder: str, name: str):
        self.fs, path = filesystem(folder)
        self.fs.create_dir(path, recursive=True)
        self.name, self.path = name, f"{path.rstrip('/')}/{name}"
        self.attempt = f"{path.rstrip('/')}/_attempt-{uuid.uuid4().hex}"
        self.stream = self.fs.open_output_stream(self.attempt, compression=None)
        self.size = 0

    def write(self, data: bytes) -> tuple[int, int]:
        """Offset and length of what was written."""
        at = self.size
        self.stream.write(data)
        self.size += len(data)
        return at, len(data)

    def publish(self) -> None:
        self.stream.close()
        self.fs.move(self.attempt, self.path)

    def discard(self) -> None:
        self.stream.close()
        self.fs.delete_file(self.attempt)
