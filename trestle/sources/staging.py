"""Materialise the model tables once, as Parquet, in the shared folder.

The dashboards load their tables once and answer every page from memory; the
Spark equivalent is to write the cleaned model tables (scorecard, process
scores, KPI facts, action items) as Parquet and let every query read them.
That also cuts the lineage of the derived tables: a lost executor re-reads a
file instead of recomputing the joins that produced it.

* Location: ``spark.checkpoint.dir`` from the session (a shared filesystem
  on a cluster); only when it is unset (local tests) does
  ``trestle.session.ensure_checkpoint_dir`` choose one.
* Layout: KPI facts and process scores partitioned by ``phase`` (a phase
  page prunes the other phases), rows sorted by ``projectId`` inside each
  file so Parquet min/max statistics skip row groups for project filters.
  No repartition by ``phase`` (four values, one task each would be skew):
  every write task writes its own slice of each phase.
* Publish: each table is written to a private directory, and only after the
  write has ended a small marker file names that directory.  Nothing is
  renamed (an object store would copy file by file), and a reader that finds
  no marker sees no table.  The marker is created once: of two concurrent
  writers one wins, the other reads the winner's table.
* Key: a hash of the input files' paths, sizes and modification times plus
  the layout version, so new input data or a new layout gets a new staging
  directory and stale files are never read.
* Clean-up: ``clean_stages`` removes stages that are older than a given age;
  it is a call for the deployment to make, as other sessions may still read.
"""

from __future__ import annotations

import hashlib
import re
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from trestle.session import ensure_checkpoint_dir

STAGE_DIR = "trestle-stage"
# Version of the staged layout: part of every staging key, so tables written
# by an older layout are never read by newer code.
STAGE_VERSION = "v16"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


# Input listings are re-checked on every call; a deployment that refreshes its
# data on a timer may raise this to reuse a listing for so many seconds.
SIGNATURE_TTL_SECONDS = 0.0
_SIGNATURES: dict[tuple[str, ...], tuple[float, str]] = {}


def input_signature(spark: SparkSession, paths: list[str], ttl: float | None = None) -> str:
    """Hash of (path, length, modification time) of every file under the
    given paths; metadata only, the data is not read.  A listing younger
    than ``ttl`` seconds (default ``SIGNATURE_TTL_SECONDS``) is reused, so a
    burst of page queries lists a large input once."""
    key = tuple(sorted(paths))
    limit = SIGNATURE_TTL_SECONDS if ttl is None else ttl
    hit = _SIGNATURES.get(key)
    now = time.monotonic()
    if hit is not None and now - hit[0] < limit:
        return hit[1]
    sig = _list_signature(spark, list(key))
    _SIGNATURES[key] = (now, sig)
    return sig


def _list_signature(spark: SparkSession, paths: list[str]) -> str:
    h = hashlib.sha256()
    for path in sorted(paths):
        fs, p = _fs(spark, path)
        if not fs.exists(p):
            h.update(f"{path}:absent".encode())
            continue
        it = fs.listFiles(p, True)
        entries = []
        while it.hasNext():
            st = it.next()
            entries.append(f"{st.getPath().toString()}:{st.getLen()}:{st.getModificationTime()}")
        for e in sorted(entries):
            h.update(e.encode())
    return h.hexdigest()[:16]


def staging_root(spark: SparkSession) -> str:
    """Where staged tables go: under ``spark.checkpoint.dir``.

    Unset, a local master gets a temporary folder; any other master raises, as
    a folder of one machine isn't seen by the others.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = configured or ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{STAGE_DIR}"


def writable(spark: SparkSession) -> bool:
    """Whether the staging folder can be created and written (an error other than that is raised)."""
    fs, probe = _fs(spark, f"{staging_root(spark)}/.probe-{uuid.uuid4().hex}")
    try:
        fs.create(probe, True).close()
    except Py4JJavaError as error:
        kind = error.java_exception.getClass().getName()
        if re.search(r"AccessControl|AccessDenied|ReadOnly|PermissionDenied", kind) or re.search(
            r"Permission denied|Read-only|Mkdirs failed|Not a directory", str(error.java_exception.getMessage())
        ):
            return False
        raise
    fs.delete(probe, False)
    return True


MARKER = "_staged"


def staged_path(spark: SparkSession, path: str) -> str | None:
    """The directory of the table that was published under ``path``, if any."""
    fs, marker = _fs(spark, f"{path}/{MARKER}")
    if not fs.exists(marker):
        return None
    stream = fs.open(marker)
    try:
        name = bytes(stream.readNBytes(4096)).decode()
    finally:
        stream.close()
    # a marker is created and filled in two steps; an empty one isn't there yet
    return f"{path}/{name}" if name else None


def _publish(spark: SparkSession, path: str, name: str) -> bool:
    """Name ``name`` as the table of ``path``; False if another one was first."""
    fs, marker = _fs(spark, f"{path}/{MARKER}")
    try:
        stream = fs.create(marker, False)
    except Py4JJavaError:
        if fs.exists(marker):
            return False
        raise
    try:
        stream.write(bytearray(name.encode()))
    finally:
        stream.close()
    return True


def stage_table(
    spark: SparkSession,
    df: DataFrame,
    path: str,
    partition_by: str | None = None,
    sort_by: str | None = None,
    even: bool = True,
) -> DataFrame:
    """Write ``df`` under ``path`` unless a complete table was published there;
    return the frame read back from the files.

    ``even=False`` is for a frame whose last step is a shuffle of its own (a
    join or an aggregate): AQE sizes those partitions already.
    """
    if done := staged_path(spark, path):
        return spark.read.parquet(done)
    # Rebalance before writing: one shuffle without a key, after which
    # AQE sizes the partitions (coalescing tiny ones, splitting skewed
    # ones), so files are even at any scale and a tiny input read as one
    # split is still written in parallel.  (Asking the frame for its
    # partition count instead would execute its shuffles twice.)
    out = df.hint("rebalance") if even else df
    # The partition column leads the sort, so the writer keeps this order.
    keys = [k for k in (partition_by, sort_by) if k]
    out = out.sortWithinPartitions(*keys) if keys else out
    name = f"data-{uuid.uuid4().hex}"
    writer = out.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(f"{path}/{name}")
    if not _publish(spark, path, name):
        # another writer was first; its marker may not be filled yet, and the
        # table written here is complete, so it serves this session
        return spark.read.parquet(staged_path(spark, path) or f"{path}/{name}")
    return spark.read.parquet(f"{path}/{name}")


def clean_stages(spark: SparkSession, older_than_hours: float) -> list[str]:
    """Remove stages that were last written longer ago than that; their paths."""
    fs, root = _fs(spark, staging_root(spark))
    if not fs.exists(root):
        return []
    limit = (time.time() - older_than_hours * 3600) * 1000
    old = [s.getPath() for s in fs.listStatus(root) if s.getModificationTime() < limit]
    return [p.toString() for p in old if fs.delete(p, True)]
