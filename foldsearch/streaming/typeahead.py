"""Type-ahead as a stream: what each keystroke of each session asks for, and answers for each micro-batch.

The state of a session is the folded text it last asked for, so it stays small however many matches there are. An answer is one pass over
the stored search texts for all queries of a micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foldsearch.operators.search import DEFAULT_LIMIT, Query, batch_search
from foldsearch.runtime import ship_package

STEPS = "session_id string, step_no long, folded string, kind string"


def step_kind(was: str, folded: str, trimmed: str) -> str:
    """clear: nothing is asked; same: as before; narrow: the last text goes on; fresh: a new search."""
    if not trimmed:
        return "clear"
    if was and folded == was:
        return "same"
    return "narrow" if was and folded.startswith(was) else "fresh"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, idle_ms: int | None = None) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    was = state.get[0] if state.exists else ""
    seen = pd.concat(list(batches), ignore_index=True).sort_values("step_no", kind="stable")
    out = []
    for step, text in zip(seen["step_no"], seen["text"]):
        q = Query.of(text or "")
        kind = step_kind(was, q.folded, q.trimmed)
        out.append((key[0], int(step), q.folded, kind))
        was = "" if kind == "clear" else q.folded
    if was:
        state.update((was,))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
    elif state.exists:  # nothing asked, nothing kept
        state.remove()
    yield pd.DataFrame(out, columns=["session_id", "step_no", "folded", "kind"])


def typeahead_steps(keystrokes: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """(session_id, step_no, folded, kind) for a stream of (session_id, step_no, text); steps of a session in order within a micro-batch.

    ``idle_ms``: a session without a keystroke for so long is forgotten (for streams that run on; with a trigger that ends when all is read, Spark goes on
    waiting for the time to pass). A cleared session is forgotten at once. A null text counts as empty. Rows with a null session are left out.
    """
    ship_package(keystrokes.sparkSession)
    return (
        keystrokes.where(F.col("session_id").isNotNull())
        .select("session_id", F.col("step_no").cast("long").alias("step_no"), "text")
        .groupBy("session_id")
        .applyInPandasWithState(partial(_advance, idle_ms=idle_ms), STEPS, "folded string", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)
    )


def answer_into(fields: DataFrame, sink: Callable[[DataFrame, int], None], limit: int = DEFAULT_LIMIT) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: gives ``sink`` (folded, pos, rank, rank_no) of the micro-batch's distinct questions.

    The distinct questions of a micro-batch are brought to the driver; its size is the stream's own setting.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        asked = [r["folded"] for r in batch.where("kind <> 'clear'").select("folded").distinct().orderBy("folded").collect()]
        found = batch_search(fields, asked, limit)
        names = F.lit(asked).cast("array<string>") if asked else F.array().cast("array<string>")
        sink(found.select(F.try_element_at(names, F.col("query_no") + 1).alias("folded"), "pos", "rank", "rank_no"), epoch)

    return run
