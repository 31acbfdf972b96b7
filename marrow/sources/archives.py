"""Documents in archives: zip, tar and compressed tar, read where they lie, a row per document.

An archive with an unsafe entry (absolute or climbing path, link, special file, too large) is refused as a whole.
"""

from __future__ import annotations

import io
import os
import posixpath
import stat
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Fixed limits.
MOST_ARCHIVE, MOST_ENTRY = 50 * 1024 * 1024, 10 * 1024 * 1024
ENDINGS = (".zip", ".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tbz2", ".tar.xz", ".txz")


class ArchiveError(ValueError):
    """An archive that is refused."""


def is_archive(path: str) -> bool:
    return path.lower().endswith(ENDINGS)


def check_name(name: str) -> None:
    clean = posixpath.normpath(name.replace("\\", "/"))
    if name.startswith(("/", "\\")) or clean.startswith("/") or (len(name) > 1 and name[1] == ":"):
        raise ArchiveError(f"absolute path entry rejected: {name}")
    if clean == ".." or clean.startswith("../") or "/../" in clean:
        raise ArchiveError(f"path traversal entry rejected: {name}")


def _wanted(name: str) -> bool:
    return name.lower().endswith(".md")


def entries(path: str) -> list[tuple[str, bytes]]:
    """(name, content) of the documents of an archive, in order; raises ArchiveError if any entry is unsafe."""
    if os.path.getsize(path) > MOST_ARCHIVE:
        raise ArchiveError(f"archive exceeds {MOST_ARCHIVE} bytes: {path}")
    out: list[tuple[str, bytes]] = []
    try:
        if path.lower().endswith(".zip"):
            with zipfile.ZipFile(path) as z:
                for e in z.infolist():
                    check_name(e.filename)
                    if stat.S_ISLNK(e.external_attr >> 16):
                        raise ArchiveError(f"symlink entry rejected: {e.filename}")
                    if e.file_size > MOST_ENTRY:
                        raise ArchiveError(f"entry exceeds {MOST_ENTRY} bytes: {e.filename}")
                    if not e.is_dir() and _wanted(e.filename):
                        out.append((e.filename, _bounded(z.open(e), e.filename)))
        else:
            with tarfile.open(path, "r:*") as t:
                for e in t:
                    check_name(e.name)
                    if e.issym() or e.islnk():
                        raise ArchiveError(f"link entry rejected: {e.name}")
                    if not (e.isreg() or e.isdir()):
                        raise ArchiveError(f"special file entry rejected: {e.name}")
                    if e.size > MOST_ENTRY:
                        raise ArchiveError(f"entry exceeds {MOST_ENTRY} bytes: {e.name}")
                    if e.isreg() and _wanted(e.name):
                        out.append((e.name, _bounded(t.extractfile(e), e.name)))
    except (zipfile.BadZipFile, tarfile.TarError, EOFError, OSError) as e:
        raise ArchiveError(f"corrupt archive {path}: {e}") from e
    return out


def _bounded(f: io.BufferedIOBase, name: str) -> bytes:
    with f:
        data = f.read(MOST_ENTRY + 1)
    if len(data) > MOST_ENTRY:
        raise ArchiveError(f"entry exceeds {MOST_ENTRY} bytes: {name}")
    return data


def load_archives(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(archive, file_path, source_path, text, error): a row per document, or one with the error of a refused archive.

    ``source_path`` is the identity of an entry, ``archive::entry``.
    """
    listed = spark.createDataFrame([(os.path.abspath(p),) for p in paths], "archive string").repartition(max(1, len(paths)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for archive in pdf["archive"]:
                try:
                    rows = [(archive, posixpath.normpath(n), f"{archive}::{posixpath.normpath(n)}", d.decode("utf-8", "replace"), None) for n, d in entries(archive)]
                except (ArchiveError, OSError) as e:
                    rows = [(archive, None, None, None, str(e))]
                yield pd.DataFrame(rows, columns=["archive", "file_path", "source_path", "text", "error"])

    return listed.mapInPandas(read, "archive string, file_path string, source_path string, text string, error string")
