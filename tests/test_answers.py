"""Response streams, previews and resumable batches."""

import json
import random

import pytest
from pyspark.sql import functions as F

from penforge.functions.answers import MOST_BYTES, Reassembly, summary_preview
from penforge.streaming import answers, batches


def event(delta=None, end=None, **more):
    return f"data: {json.dumps({'choices': [{'delta': delta or {}, 'finish_reason': end}], **more}, ensure_ascii=False)}\n\n"


GOOD = event({"content": "héllo "}) + ": note\n\n" + event({"content": "😀\n\"x\"", "reasoning_content": "no"}) + event({"tool_calls": [{"index": 1, "id": "b", "function": {"name": "f", "arguments": "{\"a\""}}]}) + event(
    {"tool_calls": [{"index": 0, "id": "a", "function": {"name": "g"}}, {"index": 1, "function": {"arguments": ":1}"}}]}) + "data: {\"choices\":\ndata: []}\r\n\r\n" + event(end="tool_calls") + "data: [DONE]\n\nrubbish"
TOOLS = [{"index": 0, "id": "a", "name": "g", "arguments": ""}, {"index": 1, "id": "b", "name": "f", "arguments": '{"a":1}'}]
WANT = {
    GOOD: ("done", "héllo 😀\n\"x\"", TOOLS),
    event({"content": "a"}, "stop"): ("done", "a", []),
    event({"content": "a"}, "stop").rstrip(): ("done", "a", []),
    event({"content": "a"}): ("interrupted", None, []),
    "": ("interrupted", None, []),
    event({"content": "a"}, "length"): ("truncated", None, []),
    event({"content": 1}): ("malformed", None, []),
    event({"content": "a"}, "stop") + "data: {]\n\n": ("malformed", None, []),
    event({"tool_calls": [{"index": True}]}): ("malformed", None, []),
    event({"tool_calls": [{"index": 32}]}): ("malformed", None, []),
    'data: {"error": 1}\n\n': ("malformed", None, []),
    'data: [1]\n\n': ("malformed", None, []),
    "x" * (MOST_BYTES + 1): ("too_large", None, []),
}


def cut(data, rng):
    at = sorted(rng.randrange(len(data) + 1) for _ in range(rng.randrange(8)))
    return [data[a:b] for a, b in zip([0, *at], [*at, len(data)])]


@pytest.mark.parametrize("text", WANT, ids=range(len(WANT)))
def test_cuts_change_nothing(text):
    rng = random.Random(1)
    data = text.encode()
    ways = [[data]] + [cut(data, rng) for _ in range(60 if len(data) < 10_000 else 3)] + ([[bytes([b]) for b in data]] if len(data) < 10_000 else [])
    for pieces in ways:
        answer = Reassembly()
        for piece in pieces:
            answer.feed(piece)
            answer = Reassembly(answer.s)
        answer.end()
        assert answer.row() == WANT[text]


def test_bad_bytes():
    answer = Reassembly()
    answer.feed(b"data: \xff\n\n")
    assert answer.row()[0] == "not_utf8"


def fragments(spark, rng, shuffled=True):
    rows = []
    for i, text in enumerate(WANT):
        pieces = cut(text.encode(), rng)
        rows += [(i, n, p, n == len(pieces) - 1) for n, p in enumerate(pieces)]
    if shuffled:
        rng.shuffle(rows)
    return spark.createDataFrame(rows, "request long, seq int, data binary, last boolean")


def as_row(r):
    return r.status, r.content, [t.asDict() for t in r.tool_calls]


def test_a_table_of_fragments(spark):
    got = {r.request: as_row(r) for r in answers.reassembled(fragments(spark, random.Random(2)).repartition(5)).collect()}
    assert [got[i] for i in range(len(WANT))] == list(WANT.values())


def test_a_stream_of_fragments(spark, tmp_path):
    given = fragments(spark, random.Random(3))
    given.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(given.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = answers.reassembled_stream(stream).writeStream.format("memory").queryName("answers").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    rows = spark.table("answers").collect()
    assert len(rows) == len(WANT) and {r.request: as_row(r) for r in rows} == dict(enumerate(WANT.values()))


def test_previews_grow(spark):
    rng = random.Random(4)
    bits = ["a", "é", "\n", '"', "\\", "\t", "/", "\b", "中", "😀", "\\u00e9", "}"]
    rows, whole = [], {}
    for i in range(1000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(25)))
        answer = json.dumps({"other": 1, "summary": text}, ensure_ascii=bool(i % 2) and "😀" not in text)
        whole[i] = text
        rows += [(i, n, answer[:n]) for n in range(len(answer) + 1)]
    got = spark.createDataFrame(rows, "id int, n int, content string").select("id", "n", summary_preview(F.col("content")).alias("p")).orderBy("id", "n").collect()
    last = {}
    for r in got:
        assert whole[r.id].startswith(r.p) and r.p.startswith(last.get(r.id, ""))
        last[r.id] = r.p
    assert last == whole


@pytest.mark.parametrize("content, want", [
    ('{"summary" :\n "ab', "ab"), ('{"summary": 5', ""), (r'{"summary": "a\q', "a"), (r'{"summary": "a\qlonger than six', ""), ('{"summary": "' + "x" * 700, "x" * 500),
    (" " * 5_995 + '{"summary": "abc"}', ""), ('{"summary": "a\nb', "a"), (r'{"summary": "\u00e', ""), ("", ""), (None, ""),
])
def test_previews_at_the_edges(spark, content, want):
    assert spark.createDataFrame([(content,)], "content string").select(summary_preview(F.col("content"))).first()[0] == want


# --- batches -----------------------------------------------------------------------------------------------------------

ANSWERS = "session long, segment int, calls int, seconds double, ok boolean"


def one_by_one(recorded, sessions, n, budget=batches.Budget()):
    """Progress after n batches, segment after segment."""
    out = {}
    for s in sessions:
        done = calls = 0
        for _ in range(n):
            used, seconds = 0, 0.0
            for _ in range(budget.segments):
                if (s, done + 1) not in recorded or budget.seconds - seconds < 1 or used >= budget.calls or calls >= budget.session_calls:
                    break
                need, took, ok = recorded[s, done + 1]
                room = min(budget.calls - used, budget.session_calls - calls)
                spent = min(need, room)
                used, calls, seconds = used + spent, calls + spent, seconds + took
                if need > room or not ok or seconds > budget.seconds:
                    break
                done += 1
        out[s] = done, calls
    return out


@pytest.fixture(scope="module")
def recorded():
    rng = random.Random(9)
    return {(s, i): (rng.randrange(1, 14), float(rng.randrange(0, 90)), rng.random() < 0.9) for s in range(60) for i in range(1, rng.randrange(2, 40))}


def test_batches_keep_their_budgets(spark, recorded):
    table = spark.createDataFrame([(s, i, *v) for (s, i), v in recorded.items()], ANSWERS)
    progress = spark.createDataFrame([(s, 0, 0) for s in range(60)], batches.PROGRESS)
    for n in range(1, 4):
        progress = spark.createDataFrame(batches.advanced(progress, batches.attempts(progress, table)).collect(), batches.PROGRESS)
        assert {r.session: (r.completed, r.calls) for r in progress.collect()} == one_by_one(recorded, range(60), n)


def test_broken_off_and_taken_up_again(spark, recorded, tmp_path):
    table = spark.createDataFrame([(s, i, *v) for (s, i), v in recorded.items()], ANSWERS).cache()
    for i in range(6):
        spark.createDataFrame([(s,) for s in range(60) if (s + i) % 3] * 2, "session long").coalesce(1).write.mode("append").parquet(str(tmp_path / "asked"))

    def run(name, step):
        asked = spark.readStream.schema("session long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "asked"))
        return asked.writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / name / "checkpoint")).trigger(availableNow=True).start()

    whole = batches.ReviewLog(spark, str(tmp_path / "whole"), table)
    run("whole", whole.step).awaitTermination(200)
    broken = batches.ReviewLog(spark, str(tmp_path / "broken"), table)

    def failing(requests, batch):
        if batch == 3:
            now = broken.progress(batch)  # what a batch leaves behind that ends between its two writes
            batches.attempts(now, table).where("committed").select("session", "segment", "n_calls").write.mode("overwrite").parquet(f"{broken.path}/segments/batch={batch}")
            raise RuntimeError("lost")
        broken.step(requests, batch)

    with pytest.raises(Exception, match="lost"):
        run("broken", failing).awaitTermination(200)
    run("broken", broken.step).awaitTermination(200)
    rows = lambda log: (sorted(map(tuple, log.progress().collect())), sorted(map(tuple, log.committed().collect())))
    assert rows(whole) == rows(broken)
    done = rows(whole)
    assert sum(p[1] for p in done[0]) == len(done[1]) > 100
