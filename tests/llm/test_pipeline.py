"""The pipeline on the small tables: each stage against brute force on its own input, run() against the stages."""

import hashlib
import re

import public_tokenizers as P
import pyarrow.parquet as pq
import tiktoken

import corpus_pipeline
from penforge.llm import bpe, quality
from penforge.llm.common import fresh_path

DATA = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def classes(docs):
    """The smallest doc_id that links reach from each document."""
    sets, found = {d: shingles(t) for d, t in docs.items()}, {d: d for d in docs}
    pairs = [(a, b) for a in docs for b in docs if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            least = min(found[a], found[b])
            changed |= found[a] != least or found[b] != least
            found[a] = found[b] = least
    return found


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        kept.append({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
        path = fresh_path(spark, "pipeline-test")
        stage(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
    everything, good, single, apart, clean = kept
    assert set(good) == {r.doc_id for r in quality.op1_quality_qda(spark, DATA).collect() if r.predicted == 1}

    groups = {}
    for d, t in good.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d))
    assert set(single) == {min(g)[1] for g in groups.values()}

    of = classes(single)
    assert len(apart) == len(set(of.values())) and {of[d] for d in apart} == set(of.values()) and set(apart) <= set(single)

    items = [t for t in pq.read_table(f"{DATA}/benchmark.parquet")["text"].to_pylist() if t and len(t) >= 40]
    assert set(clean) <= set(apart) and not any(i in (t or "") for i in items for t in clean.values())
    assert all(len(everything[d] or "") >= 20 for d in set(apart) - set(clean))

    ranks = bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).ranks
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for d, t in clean.items():
        ids = encoding.encode_ordinary(t or "")
        want[d] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    row = lambda r: (r.n_tokens, r.ids_sha256, r.decoded_sha256)
    assert {r.doc_id: row(r) for r in docs.collect()} == want
    assert {r.doc_id: row(r) for r in corpus_pipeline.run(spark, DATA).collect()} == want
