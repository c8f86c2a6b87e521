"""Response streams put together: fragments by request and number, as a table or as a stream."""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.answers import Reassembly

_TOOLS = "array<struct<index: int, id: string, name: string, arguments: string>>"
ANSWER = f"request long, status string, content string, tool_calls {_TOOLS}"


def reassembled(fragments: DataFrame) -> DataFrame:
    """request, status, content, tool_calls from fragments (request, seq, data binary). Fragments of a request stream
    through one task in their order; what is held of it is bounded by the size of an answer."""
    tools = pa.list_(pa.struct([("index", pa.int32()), ("id", pa.string()), ("name", pa.string()), ("arguments", pa.string())]))
    types = [pa.int64(), pa.string(), pa.string(), tools]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for request, pieces in itertools.groupby(rows, key=lambda r: r[0]):
            answer = Reassembly()
            for _, data in pieces:
                answer.feed(data or b"")
            answer.end()
            yield pa.record_batch([pa.array([v], t) for v, t in zip((request, *answer.row()), types)], ["request", "status", "content", "tool_calls"])

    return fragments.repartition("request").sortWithinPartitions("request", "seq").select("request", "data").mapInArrow(run, ANSWER)


def reassembled_stream(fragments: DataFrame) -> DataFrame:
    """As reassembled(), of a stream of fragments (request, seq from 0, data, last boolean): a row as soon as an answer
    is over, or its last fragment has come. Fragments may come in any order; early ones wait in the request's state."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else {"next": 0, "early": {}, "answer": None, "told": False}
        answer = Reassembly(held["answer"])
        for frame in frames:
            for r in frame.itertuples():
                if r.seq >= held["next"]:
                    held["early"][int(r.seq)] = (bytes(r.data), bool(r.last))
        ended = False
        while held["next"] in held["early"] and not ended:
            data, ended = held["early"].pop(held["next"])
            held["next"] += 1
            answer.feed(data)
        if ended:
            answer.end()
        if answer.over and not held["told"]:
            status, content, tools = answer.row()
            yield pd.DataFrame({"request": [key[0]], "status": [status], "content": [content], "tool_calls": [tools]})
            held["told"] = True
        if ended:
            state.remove()
        else:
            # once an answer is told, only that it was is kept until its last fragment
            state.update((pickle.dumps({**held, "answer": {**answer.s, "content": "", "tools": {}, "rest": b""} if held["told"] else answer.s}),))

    return fragments.groupBy("request").applyInPandasWithState(run, ANSWER, "held binary", "append", GroupStateTimeout.NoTimeout)
