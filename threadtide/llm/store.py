"""Files of an operator's own format in the session's shared folder."""

from __future__ import annotations

import re

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path in it; any scheme that pyarrow knows, such as file, hdfs, s3 or gs."""
    local = re.match(r"(?:file:/*)?(/.*)|file:/*(.*)", path)
    if local:
        return fs.LocalFileSystem(), local[1] or "/" + local[2]
    return fs.FileSystem.from_uri(path)
