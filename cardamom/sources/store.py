"""Files that Spark names, opened inside tasks."""

from __future__ import annotations

import re
from urllib.parse import urlsplit

from pyarrow import fs

#: Schemes under which Hadoop knows stores that pyarrow knows by another name.
SAME = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "wasb": "abfs"}
#: Schemes that are mounted below a folder of their own on every node.
MOUNTED = {"dbfs": "/dbfs"}


def located(uri: str) -> str:
    """The URI or path under which pyarrow finds what Spark calls ``uri``."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", uri)
    if not scheme:
        return uri
    name = scheme[1].lower()
    if name in MOUNTED:
        return MOUNTED[name] + urlsplit(uri).path
    return SAME.get(name, name) + uri[scheme.end(1) :]


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it (local or mounted, hdfs, s3, gcs, abfs)."""
    try:
        return fs.FileSystem.from_uri(located(uri))
    except ValueError as error:
        raise OSError(f"{uri}: tasks read files through pyarrow, which knows no such scheme; use a folder on hdfs, s3a, gs, abfss or a mounted one") from error
