"""Stateful operators on message streams: bounded history with expiry, and a tail buffer."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RETAINED, TAIL = 100, 192
#: The heading of a list of references that a model appends.
REFERENCES = re.compile(r"\n\s*(?:#{1,6}\s*)?(?:参考(?:资料|文献)|引用来源|references|sources)\s*[:：]?\s*\n", re.I)


def bounded_history(messages: DataFrame, most: int = RETAINED, expiry: str = "2592000 seconds") -> DataFrame:
    """(session_id, n, last): a stream of session sizes after each batch, with at most the last most messages kept.

    messages has session_id, seq, content.  A session without messages for expiry (processing time) is forgotten.
    """
    milliseconds = int(expiry.split()[0]) * 1000

    def update(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = json.loads(state.get[0]) if state.exists else []
        for batch in batches:
            kept += [[int(s), c] for s, c in zip(batch["seq"], batch["content"])]
        kept = sorted(kept)[-most:]
        state.update((json.dumps(kept, ensure_ascii=False),))
        state.setTimeoutDuration(milliseconds)
        yield pd.DataFrame({"session_id": [key[0]], "n": [len(kept)], "last": [kept[-1][1]]})

    return messages.groupBy("session_id").applyInPandasWithState(update, "session_id string, n int, last string", "kept string", "update", GroupStateTimeout.ProcessingTimeTimeout)


def without_references(deltas: DataFrame, tail: int = TAIL) -> DataFrame:
    """(reply_id, text): text of replies as it arrives, held back by tail characters so that a list of references never shows.

    deltas has reply_id, seq, delta, final (boolean).
    """

    def update(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, stopped = state.get if state.exists else ("", False)
        final = False
        for batch in batches:
            batch = batch.sort_values("seq")
            held += "" if stopped else "".join(batch["delta"].fillna(""))
            final |= bool(batch["final"].any())
        found = REFERENCES.search(held)
        if found:
            out, held, stopped = held[: found.start()], "", True
        elif final:
            out, held = held, ""
        else:
            cut = max(0, len(held) - tail)
            out, held = held[:cut], held[cut:]
        state.update((held, stopped))
        if out:
            yield pd.DataFrame({"reply_id": [key[0]], "text": [out]})

    return deltas.groupBy("reply_id").applyInPandasWithState(update, "reply_id string, text string", "held string, stopped boolean", "append", GroupStateTimeout.NoTimeout)
