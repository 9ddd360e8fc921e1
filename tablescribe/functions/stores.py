"""Small files in shared storage, written and read by tasks: by the same URIs that Spark uses."""

from __future__ import annotations

import re

from pyarrow import fs


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, and the path in it. ``s3a`` and ``s3n`` are S3, no scheme is a local path."""
    if re.match(r"file:|/", uri):
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", uri)
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


def write_bytes(uri: str, data: bytes) -> None:
    system, path = store(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path, compression=None) as f:
        f.write(data)


def exists(uri: str) -> bool:
    system, path = store(uri)
    return system.get_file_info(path).type != fs.FileType.NotFound


def read_folder(uri: str) -> list[bytes]:
    """The content of each file in a folder; none if there is no such folder."""
    system, path = store(uri)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return [system.open_input_stream(f.path, compression=None).read() for f in found if f.is_file]
