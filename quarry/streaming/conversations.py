"""T4: the state of a conversation (confirmed brand, serial and model, and whether a choice is awaited), folded over its calls in order.

Calls: conv, seq, kind (user, find, choose, search), brand (canonical, null if unknown), declared, another (the customer speaks of another machine), serial,
model, selected, uncertain. A user's turn ends the wait. `find` forgets the machine if another is spoken of, confirms a declared brand, takes
what it selected, and waits if it is uncertain. `choose` and `search` are blocked while a choice is awaited; a search for a machine other than the active
one is blocked and forgets its serial and model.

The batch form streams each conversation's calls through one fold with bounded state; the streaming form keeps that state by key. Both use `step`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.functions import machines as M
from quarry.functions import serials as S

FIELDS = ["brand", "serial", "model", "words", "waiting"]
NOTHING = (None, None, None, [], False)
STATE = "brand string, serial string, model string, words array<string>, waiting boolean"
OUT = "conv long, seq long, brand string, serial string, model string, waiting boolean, blocked boolean, brand_sure boolean"


def _apart(a: list[str], b: list[str]) -> bool:
    return bool(a) and bool(b) and not set(a) & set(b)


def step(state: tuple, call: dict) -> tuple[tuple, bool, bool]:
    """The state after a call, whether the call is blocked, and whether its brand is sure."""
    brand, serial, model, words, waiting = state
    blocked = sure = False
    if call["kind"] == "user":
        waiting = False
    elif call["kind"] == "find":
        if call["another"]:
            brand, serial, model, words = None, None, None, []
        if call["brand"] is not None:
            sure = bool(call["declared"]) or call["brand"] == brand
            brand = call["brand"] if call["declared"] else brand
        waiting = bool(call["uncertain"])
        if call["selected"]:
            model, words, serial = call["selected"], call["selected_words"], call["serial"] or serial
    elif waiting:
        blocked = True
    elif call["kind"] == "choose":
        if call["selected"]:
            model, words = call["selected"], call["selected_words"]
    elif call["kind"] == "search":
        numbers = lambda ws: [w for w in ws if w.isdigit()]
        other = bool(call["serial"]) and bool(serial) and call["serial"] != serial
        if other or _apart(call["model_words"], words) or _apart(numbers(call["model_words"]), numbers(words)):
            serial, model, words, blocked = None, None, [], True
    return (brand, serial, model, list(words), waiting), blocked, sure


def _prepared(calls: DataFrame, brands: list[str]) -> DataFrame:
    return calls.select(
        F.col("conv").cast("long").alias("conv"), F.col("seq").cast("long").alias("seq"), "kind", "brand", "declared", "another", F.nullif(S.cleaned(F.col("serial")), F.lit("")).alias("serial"),
        M.model_words(F.col("model"), brands).alias("model_words"), "selected", M.model_words(F.col("selected"), brands).alias("selected_words"), "uncertain",
    ).where("conv is not null")


def _row(call: dict, state: tuple, blocked: bool, sure: bool) -> dict:
    return {"conv": call["conv"], "seq": call["seq"], "brand": state[0], "serial": state[1], "model": state[2], "waiting": state[4], "blocked": blocked, "brand_sure": sure}


def call_states(calls: DataFrame, brands: list[str] | None = None) -> DataFrame:
    """Each call with the state after it. A conversation is one key's rows in order; a task holds one state, whatever their number."""
    schema = pa.schema([("conv", pa.int64()), ("seq", pa.int64()), ("brand", pa.string()), ("serial", pa.string()), ("model", pa.string()), ("waiting", pa.bool_()), ("blocked", pa.bool_()), ("brand_sure", pa.bool_())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, NOTHING
        for batch in batches:
            out = []
            for call in batch.to_pylist():
                if call["conv"] != conv:
                    conv, state = call["conv"], NOTHING
                state, blocked, sure = step(state, call)
                out.append(_row(call, state, blocked, sure))
            yield pa.RecordBatch.from_pylist(out, schema)

    return _prepared(calls, brands or []).repartition("conv").sortWithinPartitions("conv", "seq").mapInArrow(fold, OUT)


def call_state_stream(calls: DataFrame, brands: list[str] | None = None) -> DataFrame:
    """The same for a stream whose batches bring each conversation's calls on in order; a batch's calls of one conversation are sorted by seq."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else NOTHING
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for call in pa.Table.from_pandas(rows, preserve_index=False).to_pylist():
            now, blocked, sure = step(tuple(now), call)
            out.append(_row(call, now, blocked, sure))
        state.update(now)
        yield pd.DataFrame(out)

    return _prepared(calls, brands or []).groupBy("conv").applyInPandasWithState(fold, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
