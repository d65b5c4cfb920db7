"""Change feed: file snapshots as a stream, the last digest of each path as state.

An extension: the state of a path is one short string, kept by applyInPandasWithState, so a stream of any length needs memory
for distinct paths only.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SNAPSHOT = "path string, lang string, cksum string, mtime double"
OUT = "path string, change string, cksum string"


def _changes(key, frames, state: GroupState):
    last = state.get[0] if state.exists else None
    rows = pd.concat(list(frames)).sort_values("mtime", kind="stable")
    out = []
    for r in rows.itertuples():
        gone = r.cksum is None or pd.isna(r.cksum)
        if gone and last is not None:
            out.append((key[0], "removed", None))
        elif not gone and r.cksum != last:
            out.append((key[0], "added" if last is None else "modified", r.cksum))
        last = None if gone else r.cksum
    if last is None:
        if state.exists:
            state.remove()
    else:
        state.update((last,))
    yield pd.DataFrame(out, columns=["path", "change", "cksum"])


def change_stream(snapshots: DataFrame) -> DataFrame:
    """added / modified / removed events from a stream of (path, lang, cksum, mtime); a null cksum is a deletion."""
    return snapshots.groupBy("path").applyInPandasWithState(_changes, OUT, "cksum string", "append", GroupStateTimeout.NoTimeout)


def watch(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshots that arrive as JSON lines files in a folder."""
    return spark.readStream.schema(SNAPSHOT).json(folder)
