"""Documents that arrive again: unchanged ones are dropped, changed ones are marked.

A stream remembers, for each document of each corpus name, a hash of what it
held last, and forgets it some time after the document was last seen. Texts are
not kept in the state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEYS = ["document_name", "doc_id"]
STATE = "digest string, seen timestamp"
NEW, CHANGED = "new", "changed"


def digest(text: str | None) -> str:
    return "" if text is None else hashlib.sha256(text.encode()).hexdigest()


def new_uploads(
    documents: DataFrame, arrived: str = "arrived", delay: str = "1 hour", remember_days: float = 30.0, text: str = "text"
) -> DataFrame:
    """The arriving documents that are new or hold something else than before, with the ``change``.

    ``documents`` is a stream with ``doc_id``, ``document_name``, ``text`` and the
    time each one ``arrived``. What arrives more than ``delay`` after later ones
    is not looked at. A document that is not seen for ``remember_days`` is
    forgotten, and new when it comes again. Rows without name or id are a
    document like any other of that name or id; a missing text differs from an
    empty one.
    """
    fields = [f for f in documents.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", change string"
    names = [f.name for f in fields]
    kept_for = pd.Timedelta(days=remember_days)

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, seen = state.get if state.exists else (None, None)
        # nearly every document comes alone: no more pandas than one row needs
        parts = list(batches)
        rows = parts[0] if len(parts) == 1 else pd.concat(parts)
        if len(rows) > 1:
            rows = rows.sort_values(arrived, kind="stable")
        changes = []
        for when, body in zip(rows[arrived], rows[text]):
            # a clock behind the watermark does not run out on its own
            forgotten = seen is not None and when - pd.Timestamp(seen) > kept_for
            own = digest(None if body is None or body is pd.NA or body != body else body)
            first = last is None or forgotten
            changes.append(NEW if first else None if own == last else CHANGED)
            last, seen = own, max(when, pd.Timestamp(seen)) if seen is not None else when
        state.update((last, pd.Timestamp(seen).to_pydatetime()))
        end = pd.Timestamp(seen) + kept_for
        end = end.tz_localize("UTC") if end.tzinfo is None else end
        state.setTimeoutTimestamp(max(int(end.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        if any(changes):
            made = (rows if list(rows.columns) == names else rows[names]).assign(change=changes)
            yield made if all(changes) else made[made["change"].notna()]

    waiting = documents.withWatermark(arrived, delay)
    return waiting.groupBy(*KEYS).applyInPandasWithState(judge, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def arrival(documents: DataFrame, name: str = "arrived") -> DataFrame:
    """Documents with the time of the file they came in, for streams of files that have no time of their own."""
    return documents.withColumn(name, F.col("_metadata.file_modification_time"))
