"""The pairs of one part of the lists leave in batches, whatever their number."""

from collections import Counter
from itertools import combinations

import pyarrow as pa

from penforge.llm import ngram_join


def test_cross_pairs_of_common_lists_leave_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(ngram_join, "PAIRS", 100)
    rows = [(key, rec) for key in range(6) for rec in range(60) if (rec + key) % 5]
    keys, recs = zip(*rows)
    n = len(rows)
    part = pa.table({"list": keys, "rec": recs, "n": pa.array([20] * n, pa.int32()), "cls": recs, "most": pa.array([9] * n, pa.int32())})
    batches = list(ngram_join._cross(80)(iter(part.to_batches(max_chunksize=50))))
    assert len(batches) > 10 and max(b.num_rows for b in batches) < 100 + 60
    want = Counter(pair for key in range(6) for pair in combinations([rec for k, rec in rows if k == key], 2))
    got = pa.Table.from_batches(batches).to_pylist()
    assert {(r["q"], r["c"]): r["votes"] for r in got} == dict(want) and len(got) == len(want)
