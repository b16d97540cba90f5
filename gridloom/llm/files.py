"""Files in the shared folder, as workers open them."""

from __future__ import annotations

import re

import pyarrow.fs as pafs


def file_system(uri: str):
    """(file system, path) of a URI or a local path; any store that pyarrow knows."""
    return pafs.FileSystem.from_uri(uri if re.match(r"^[a-z][a-z0-9+.-]*:", uri) else f"file://{uri}")
