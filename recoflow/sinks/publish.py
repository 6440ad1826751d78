"""Versioned publishing.

A published folder holds one sub-folder per version and a manifest that names the current one. A
new version is written beside the old ones and the manifest is switched last, by one rename, so
a DataFrame over an older version keeps its files and a crashed write is never seen. Versions
beyond the newest ``keep`` are deleted by the next publish.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from recoflow.sources.files import delete, folders, join, path_exists, read_text, replace_text

MANIFEST, VERSION = "_CURRENT", "version_"
KEPT_VERSIONS = 2


def current(spark: SparkSession, path: str) -> str:
    """The folder of the current version; ``path`` itself if it is not a published folder."""
    manifest = join(path, MANIFEST)
    return join(path, read_text(spark, manifest).strip()) if path_exists(spark, manifest) else path


def publish(spark: SparkSession, path: str, write: Callable[[str], None], keep: int = KEPT_VERSIONS) -> str:
    """``write(folder)`` fills a new version, which then becomes the current one."""
    versions = [f for f in folders(spark, path) if f.startswith(VERSION)]
    name = f"{VERSION}{1 + max([int(v[len(VERSION):]) for v in versions], default=0):08d}"
    write(join(path, name))
    replace_text(spark, join(path, MANIFEST), name)
    for old in sorted(versions)[: max(0, len(versions) + 1 - keep)]:
        delete(spark, join(path, old))
    return join(path, name)
