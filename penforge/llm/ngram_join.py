"""N-gram Jaccard join by T-occurrence search, dealt over the cluster.

A document is its set of distinct word shingles. Equal sets are collapsed first. Two sets that reach the overlap T
share a shingle among the first |set| - T + 1 of each under one order of all shingles; these are the short inverted
lists, and grouping postings by shingle merges them. The order puts heavy shingles (counted over all documents) last,
so common passages make no lists that grow with the corpus; any order gives the same result. Of every list, members
first vote for one leader, the one with the least of its prefix to itself and so the fewest edits of its own; verified
links contract the sets into classes. Of the lists on which several classes still meet, the merged counts of every query are
held against the overlap of the two prefixes that its size and the other's ask for; the pairs that reach it are
verified. Verification is DivideSkip over a block of candidates of one query: the shorter inverted
lists are merged and counted, candidates that can still reach T are probed for in the longest lists by binary search.

Defined cases: a null or empty text, or one of white space only, has an empty set, links with nothing and is its own
class; with fewer words than a shingle the whole sequence is one; repeated rows and equal sets share a class; a null
doc_id takes part but never names a class, unless no member has an id (then null); further columns are not read.
Shingles are compared by 64-bit hashes, sets by 128-bit digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .bpe import slices
from .common import connected_components, read_table, released, stored, whole_text

WORDS = 5
#: Bytes of text and postings that are worked on at once.
BATCH_BYTES, BUCKET_POSTINGS, PART_POSTINGS = 1_000_000, 500_000, 500_000
#: A shingle in more sets is heavy; the most heavy shingles that each of two counts broadcasts (8 bytes each).
HEAVY, MOST_HEAVY = 50, 4_000_000
#: Candidates that one block of a query holds, by their number and their shingles.
BLOCK, BLOCK_SHINGLES = 1_000, 2_000_000
#: Pairs that one part of the lists holds before they leave its task.
PAIRS = 500_000
#: As many ids of wanted documents are broadcast; more are joined by shuffle.
WANTED = 1_000_000

_random = np.random.default_rng(20240607)
_R = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
_R[65:91] = _R[97:123]  # A-Z as a-z
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Postings hold half a shingle: what two shingles of one half share is verified away.
POSTING = np.dtype([("token", "<u4"), ("rec", "<i8"), ("n", "<i4")])


def clear_state() -> None:
    _powers.clear()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0][0]) < n:
        size = 1 << max(16, n.bit_length())
        ones = np.ones(size, np.uint64)
        _powers[0] = tuple(np.multiply.accumulate(np.where(np.arange(size) == 0, ones, base)) for base in (_P, _P_INVERSE))
    return _powers[0][0][:n], _powers[0][1][:n]


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not len(data):
        return [np.zeros(0, np.uint64) for _ in texts]
    begins = np.cumsum(sizes) - sizes
    solid = ~_BLANK[data]
    first = np.zeros(len(data) + 1, bool)
    first[begins] = True
    first[-1] = True
    starts = np.flatnonzero(solid & np.concatenate([[True], ~solid[:-1] | first[1:-1]]))
    ends = np.flatnonzero(solid & (np.concatenate([~solid[1:], [True]]) | first[1:])) + 1
    up, down = _power(len(data))
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_R[data] * up)])
        hashes = _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        at = np.searchsorted(starts, begins)
        till = np.searchsorted(starts, begins + sizes)
        rolled = np.zeros(len(hashes), np.uint64)
        weight = np.uint64(1)
        for j in range(min(words, len(hashes))):
            rolled[: len(hashes) - j] += hashes[j:] * weight
            weight = weight * _Q
        rolled = _mix(rolled)
        out = []
        for a, b in zip(at.tolist(), till.tolist()):
            if b - a >= words:
                out.append(np.unique(rolled[a : b - words + 1]))
            elif b > a:
                whole = np.uint64(b - a)
                for h in hashes[a:b]:
                    whole = _mix(np.array([whole * _Q + h], np.uint64))[0]
                out.append(np.array([whole], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def needed(n: int, percent: int) -> int:
    """The least overlap of a set of n with any set it links with."""
    return -(-n * percent // 100)


def extra(n: int) -> int:
    """With so many shingles more in each prefix, a linked pair shares so many more than one of them."""
    return n // 20


def shared_prefix(n, m, percent: int) -> np.ndarray:
    """How many shingles of both their prefixes two sets of n and m share at least if they link."""
    n, m = np.asarray(n, np.int64), np.asarray(m, np.int64)
    least = -(-(n + m) * percent // (100 + percent))
    part = [np.minimum(x, x + (-x * percent // 100) + 1 + extra(x)) - (x - least) for x in (n, m)]
    return np.maximum(1, np.minimum(*part))


def _shared_prefix(percent: int):
    """shared_prefix as a column of n and m."""
    least = f"((n + m) * {percent} + {99 + percent}) div {100 + percent}"
    part = [f"least({x}, {x} - ({x} * {percent} + 99) div 100 + 1 + {x} div 20) - ({x} - {least})" for x in ("n", "m")]
    return F.expr(f"greatest(1, least({part[0]}, {part[1]}))")


def _batched(batch: pa.RecordBatch, column: int) -> Iterator[tuple[slice, list[bytes]]]:
    texts = batch.column(column).cast(pa.binary()).to_pylist()
    for part in slices([len(t) for t in texts], BATCH_BYTES):
        yield part, texts[part]


def _row_key() -> Column:
    """What tells rows apart that have another doc_id or another text; never null."""
    name = F.coalesce(F.concat(F.lit("0"), F.col("doc_id").cast("string")), F.lit("1"))
    return F.unhex(F.md5(F.concat(name, F.lit(":"), whole_text()).cast("binary")))


def _digested(docs: DataFrame, words: int, percent: int, keyed: bool = False) -> DataFrame:
    """doc_id, n, sig, low: the lowest shingles, a prefix by hash with room for heavy ones; keyed: key too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _batched(batch, 1):
                sets = shingle_sets(texts, words)
                low = []
                for s in sets:
                    p = len(s) - needed(len(s), percent) + 1
                    low.append(s[: p + max(32, len(s) // 10)].tobytes())
                sig = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                key = [batch.column(2)[part]] if keyed else []
                yield pa.record_batch([batch.column(0)[part], pa.array([len(s) for s in sets], pa.int32()), pa.array(sig, pa.binary()), pa.array(low, pa.binary()), *key], names)

    key = [_row_key().alias("key")] if keyed else []
    names = ["doc_id", "n", "sig", "low", *["key"] * keyed]
    return docs.select("doc_id", whole_text().alias("text"), *key).mapInArrow(released(run, __name__), "doc_id long, n int, sig binary, low binary" + ", key binary" * keyed)


def _dealt(parts: list[np.ndarray], key: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, data): the records of parts, packed by bucket of the key."""
    rows = np.concatenate(parts)
    bucket = (key >> np.uint64(32)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    some = np.split(rows, cuts)
    yield pa.record_batch([pa.array([int(bucket[i]) for i in [0, *cuts]], pa.int32()), pa.array([x.tobytes() for x in some], pa.binary())], ["bucket", "data"])


def _packed(table: pa.Table, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table["data"].to_pylist()), kind)


def _heavy(reps: DataFrame, total: int, buckets: int) -> np.ndarray:
    """Sorted shingles that stand in the low part of more sets than HEAVY; counted over all of them."""
    least = max(HEAVY, total // MOST_HEAVY)  # so there are at most MOST_HEAVY

    def deal(batches):
        for batch in batches:
            tokens = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u8")
            if len(tokens):
                yield from _dealt([tokens], tokens, buckets)

    def count(table: pa.Table) -> pa.Table:
        tokens, n = np.unique(_packed(table, "<u8"), return_counts=True)
        return pa.table({"tokens": [tokens[n > least].tobytes()]}, pa.schema([("tokens", pa.binary())]))

    found = reps.select("low").mapInArrow(released(deal, __name__), "bucket int, data binary").groupBy("bucket").applyInArrow(count, "tokens binary")
    return np.sort(np.frombuffer(b"".join(bytes(r.tokens) for r in found.toLocalIterator()), "<u8"))


def _postings(sets: DataFrame, heavy, percent: int, buckets: int, lacking: bool) -> DataFrame:
    """(bucket, data) of the prefix postings of sets (rec, n, low); lacking: instead the recs whose low part is too short."""

    def run(batches):
        known = heavy.value
        for batch in batches:
            recs, ns = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            kept, keys, short = [], [], []
            for rec, n, low in zip(recs, ns, batch.column(2)):
                s = np.frombuffer(low.as_buffer(), "<u8")
                p = min(n, n - needed(n, percent) + 1 + extra(n))
                if len(known):
                    common = known[np.minimum(np.searchsorted(known, s), len(known) - 1)] == s
                    light = s[~common][:p]
                    if len(light) < p:
                        if len(s) < n:
                            short.append(rec)
                            continue
                        light = np.concatenate([light, s[common][: p - len(light)]])
                else:
                    light = s[:p]
                row = np.empty(len(light), POSTING)
                row["token"], row["rec"], row["n"] = (light & np.uint64(0xFFFFFFFF)), rec, n
                kept.append(row)
                keys.append(light)
            if lacking:
                yield pa.record_batch([pa.array(short, pa.int64())], ["rec"])
            elif kept:
                yield from _dealt(kept, np.concatenate(keys), buckets)

    return sets.select("rec", "n", "low").mapInArrow(released(run, __name__), "rec long" if lacking else "bucket int, data binary")


def _lists(table: pa.Table) -> pa.Table:
    """Of one bucket, the postings of shingles that several sets have."""
    rows = _packed(table, POSTING)
    rows = rows[np.argsort(rows["token"], kind="stable")]
    group = np.cumsum(np.concatenate([[0], rows["token"][1:] != rows["token"][:-1]]))
    rows = rows[np.bincount(group)[group] > 1]
    return pa.table({"bucket": pa.array(np.full(len(rows), table["bucket"][0].as_py(), np.int32)), "token": rows["token"].astype(np.int64), "rec": rows["rec"], "n": rows["n"]})


def _votes(table: pa.Table) -> pa.Table:
    """Of one bucket's lists, for each set and leader the lists where it votes for it: the least (alone, n, rec)."""
    token, rec, n, alone = (table[c].to_numpy() for c in ("token", "rec", "n", "alone"))
    order = np.lexsort((rec, n, alone, token))
    token, rec, n = token[order], rec[order], n[order]
    new = np.concatenate([[True], token[1:] != token[:-1]])
    leader = rec[np.flatnonzero(new)][np.cumsum(new) - 1]
    pairs = np.stack([rec, leader, n.astype(np.int64)], axis=1)[rec != leader]
    pairs, votes = np.unique(pairs, axis=0, return_counts=True)
    return pa.table({"rec": pairs[:, 0], "leader": pairs[:, 1], "n": pairs[:, 2].astype(np.int32), "votes": votes})


def _several_classes(table: pa.Table) -> pa.Table:
    """Of one bucket, the lists on which several classes meet."""
    token, cls = table["token"].to_numpy(), table["cls"].to_numpy()
    order = np.lexsort((cls, token))
    token, cls = token[order], cls[order]
    new = np.concatenate([[True], token[1:] != token[:-1]])
    group, first = np.cumsum(new) - 1, np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(token)]]) - 1
    return table.take(order[(cls[first] != cls[last])[group]])


def _cross(percent: int):
    kind = pa.schema([("q", pa.int64()), ("c", pa.int64()), ("n", pa.int32()), ("m", pa.int32()), ("votes", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of one part of the lists, the pairs of different classes that can still reach the overlap of their prefixes.

        q, c: the smaller and the larger set, n and m their sizes, votes the lists of this part that they share.
        most is on how many lists of all parts a set stands; what stands outside this part is granted to the pair.
        Pairs grow with the square of a list's length, so they leave in batches of about PAIRS.
        """
        table = pa.Table.from_batches(list(batches))
        key, rec, n, cls, most = (table[c].to_numpy() for c in ("list", "rec", "n", "cls", "most"))
        order = np.lexsort((rec, n))
        key, rec, n, cls, most = key[order], rec[order], n[order], cls[order], most[order]
        new = np.concatenate([[True], rec[1:] != rec[:-1]])
        place, at = np.cumsum(new) - 1, np.flatnonzero(new)
        recs, sizes, classes = rec[at], n[at].astype(np.int64), cls[at]
        elsewhere = most[at] - np.bincount(place)
        by_list = np.argsort(key, kind="stable")  # each list in the order of places
        members = place[by_list]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(key[by_list])) + 1, [len(key)]])
        where = np.empty(len(key), np.int64)  # of each posting, its place among members
        where[by_list] = np.arange(len(key))
        end = cuts[np.searchsorted(cuts, where, side="right")]
        largest = np.searchsorted(sizes, 100 * sizes // percent, side="right")
        found: list[list[np.ndarray]] = [[], [], []]
        held = 0

        def batch() -> pa.RecordBatch:
            x, y, votes = (np.concatenate(f) if f else np.zeros(0, np.int64) for f in found)
            for f in found:
                f.clear()
            return pa.record_batch([recs[x], recs[y], sizes[x].astype(np.int32), sizes[y].astype(np.int32), votes.astype(np.int32)], schema=kind)

        bounds = [*at.tolist(), len(key)]
        for x in range(len(recs)):
            a, b = bounds[x], bounds[x + 1]
            merged = np.concatenate([members[i + 1 : j] for i, j in zip(where[a:b].tolist(), end[a:b].tolist())])
            merged = merged[merged < largest[x]]
            merged = merged[classes[merged] != classes[x]]
            if len(merged):
                y, votes = np.unique(merged, return_counts=True)
                can = votes + np.minimum(elsewhere[x], elsewhere[y]) >= shared_prefix(sizes[x], sizes[y], percent)
                if can.any():
                    for to, values in zip(found, (np.full(int(can.sum()), x), y[can], votes[can])):
                        to.append(values)
                    held += int(can.sum())
                    if held >= PAIRS:
                        yield batch()
                        held = 0
        yield batch()

    return run


def divide_skip(query: np.ndarray, candidates: list[np.ndarray], percent: int) -> np.ndarray:
    """Which candidates link with the query; all sets are sorted arrays."""
    sizes = np.array([len(c) for c in candidates])
    union_of = len(query) + sizes
    least = -(-union_of * percent // (100 + percent))  # the overlap T that each needs
    flat, owner = np.concatenate(candidates), np.repeat(np.arange(len(candidates)), sizes)
    place = np.minimum(np.searchsorted(query, flat), len(query) - 1)
    hit = query[place] == flat
    place, owner = place[hit], owner[hit]
    lengths = np.bincount(place, minlength=len(query))
    longest = int(lengths.max(initial=0))
    n_long = 0 if longest < 8 else int(min(least.min() - 1, least.min() / (0.1 * np.log2(longest) + 1)))
    order = np.argsort(-lengths, kind="stable")
    long_lists = order[:n_long]
    is_long = np.zeros(len(query), bool)
    is_long[long_lists] = True
    count = np.bincount(owner[~is_long[place]], minlength=len(candidates))
    alive = np.flatnonzero(count >= least - n_long)
    if n_long and len(alive):
        by_list = np.lexsort((owner, place))
        place, owner = place[by_list], owner[by_list]
        ends = np.cumsum(lengths)
        for i in long_lists:
            members = owner[ends[i] - lengths[i] : ends[i]]
            if len(members):
                at = np.minimum(np.searchsorted(members, alive), len(members) - 1)
                count[alive] += members[at] == alive
    out = np.zeros(len(candidates), bool)
    out[alive] = 100 * count[alive] >= percent * (union_of[alive] - count[alive])
    return out


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (q, c) that link. sets: rec, n, low with whole sets."""

    def run(batches):
        query, held, total = None, [], 0
        found: list[tuple[int, int]] = []

        def settle():
            if held:
                keep = divide_skip(query[1], [x for _, x in held], percent)
                found.extend((query[0], rec) for (rec, _), ok in zip(held, keep) if ok)
                held.clear()

        for batch in batches:
            for q, kind, rec, low in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)):
                s = np.frombuffer(low.as_py(), "<u8")
                if kind == 0:
                    settle()
                    query, total = (q, s), 0
                else:
                    held.append((rec, s))
                    total += len(s)
                    if total > BLOCK_SHINGLES:
                        settle()
                        total = 0
            yield pa.record_batch([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["q", "c"])
            found.clear()
        settle()
        yield pa.record_batch([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["q", "c"])

    blocks = pairs.groupBy("q").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    keyed = pairs.join(blocks, "q").withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    heads = blocks.select("q", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"), F.col("q").alias("rec"))
    rows = heads.unionByName(keyed.select("q", "block", F.lit(1).alias("kind"), F.col("c").alias("rec"))).join(sets.select("rec", "low"), "rec")
    rows = rows.select("q", "block", "kind", "rec", "low").repartition("q", "block").sortWithinPartitions("q", "block", "kind")
    return rows.mapInArrow(released(run, __name__), "q long, c long")


def _whole_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """rec, n, low (whole sets) of the wanted (rec, sig, any_id)."""

    def run(batches):
        for batch in batches:
            for part, texts in _batched(batch, 2):
                sets = shingle_sets(texts, words)
                own = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                # rows that share a doc_id may hold other texts
                right = [a == b for a, b in zip(own, batch.column(1)[part].to_pylist())]
                yield pa.record_batch([x.filter(pa.array(right)) for x in (batch.column(0)[part], pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary()))], ["rec", "n", "low"])

    wanted = wanted.select("rec", "sig", "any_id")
    if wanted.count() <= WANTED:
        wanted = F.broadcast(wanted)
    rows = docs.select("doc_id", whole_text().alias("text")).join(wanted, F.col("doc_id").eqNullSafe(F.col("any_id")))
    return rows.select("rec", "sig", "text").mapInArrow(released(run, __name__), "rec long, n int, low binary").dropDuplicates(["rec"])


def join_classes(docs: DataFrame, words: int = WORDS, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs. Linked: 100 * overlap >= percent * union."""
    rows, by_sig, n_rows = _classes(docs, words, percent)
    hot_size = max(2, int((n_rows or 0) * 0.001))  # at most 1000 sets are that common
    hot, rest = F.broadcast(by_sig.where(F.col("size") >= hot_size)), by_sig.where(F.col("size") < hot_size)
    filled, empty = rows.where("n > 0").select("doc_id", "n", "sig"), rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = filled.join(hot.select("sig", "component_id"), "sig").unionByName(filled.join(hot.select("sig"), "sig", "left_anti").join(rest.select("sig", "component_id"), "sig"))
    return out.select("doc_id", "n", "component_id").unionByName(empty).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def _classes(docs: DataFrame, words: int, percent: int, keyed: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """The digested rows, each set's sig, size, cls and component_id, and the number of rows."""
    spark = docs.sparkSession
    rows = stored(_digested(docs, words, percent, keyed).withColumn("rec", F.monotonically_increasing_id()), "shingles")
    # one row stands for its set; the others are few next to all rows and are left out by their numbers
    first_row = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rec"))
    reps = rows.groupBy("sig").agg(first_row.alias("best"), F.count("*").alias("size"), F.first("n").alias("n"))
    reps = stored(reps.select("sig", "size", "n", F.col("best.doc_id").alias("any_id"), F.col("best.rec").alias("rec")), "shingle-sets")
    others = stored(rows.select("rec").join(reps.select("rec"), "rec", "left_anti"), "copies")
    own = rows.where("n > 0").join(F.broadcast(others) if others.count() <= WANTED else others, "rec", "left_anti").select("rec", "n", "low")
    named_sets = reps.select("rec", "sig", "any_id")
    n_rows = rows.count()
    total = int(own.agg(F.sum(F.octet_length("low") / 8)).first()[0] or 0)
    buckets = max(12, -(-total // BUCKET_POSTINGS))
    known = _heavy(own, total, buckets) if total else np.zeros(0, "<u8")
    heavy = spark.sparkContext.broadcast(known)
    broadcasts = [heavy]
    short = stored(_postings(own, heavy, percent, buckets, True), "short")
    if short.head(1):
        # what is common among the sets that heavy shingles fill is common in their other parts too
        whole = stored(_whole_sets(docs, named_sets.join(short, "rec"), words), "short-sets")
        heavy = spark.sparkContext.broadcast(np.union1d(known, _heavy(whole, int(whole.agg(F.sum("n")).first()[0]), buckets)))
        broadcasts.append(heavy)
        more = stored(_postings(own, heavy, percent, buckets, True).join(short, "rec", "left_anti"), "short")
        whole = whole.unionByName(_whole_sets(docs, named_sets.join(more, "rec"), words)) if more.head(1) else whole
        postings = _postings(own, heavy, percent, buckets, False).unionByName(_postings(whole, heavy, percent, buckets, False))
    else:
        postings = _postings(own, heavy, percent, buckets, False)
    kind = "bucket int, token long, rec long, n int"
    lists = stored(postings.groupBy("bucket").applyInArrow(_lists, kind), "lists")
    for sent in broadcasts:
        sent.destroy()  # what was made with them is written

    def links_of(pairs: DataFrame) -> DataFrame:
        members = pairs.select(F.explode(F.array("q", "c")).alias("rec")).distinct()
        sets = stored(_whole_sets(docs, named_sets.join(members, "rec", "left_semi"), words), "whole-sets")
        return stored(_verified(pairs.select("q", "c"), sets, percent), "links")

    # the part, in 1000ths, of a set's prefix that stands on no list
    prefix = f"least(n, n - (n * {percent} + 99) div 100 + 1 + n div 20)"
    alone = lists.groupBy("rec").agg(F.count("*").alias("most"), F.first("n").alias("n")).select("rec", F.expr(f"cast(1000 - 1000 * most div {prefix} as int)").alias("alone"))
    votes = lists.join(alone, "rec").groupBy("bucket").applyInArrow(_votes, "rec long, leader long, n int, votes long")
    votes = votes.groupBy("rec", "leader").agg(F.sum("votes").alias("votes"), F.min("n").alias("n"))
    first = votes.groupBy("rec").agg(F.max(F.struct("votes", (-F.col("leader")).alias("least"), "n")).alias("best"))
    first = first.select((-F.col("best.least")).alias("q"), F.col("rec").alias("c"), "best.votes", "best.n")
    links = links_of(stored(first.where(F.col("votes") > F.col("n") / 25), "first-pairs"))
    classes = connected_components(links, "q", "c")
    # only lists of several classes can still link any; a linked pair shares more than extra() of them
    cls = F.coalesce("component", "rec").alias("cls")
    marked = lists.select("bucket", "token", "rec", "n").join(classes, F.col("rec") == F.col("node"), "left").select("bucket", "token", "rec", "n", cls)
    mixed = stored(marked.groupBy("bucket").applyInArrow(_several_classes, "bucket int, token long, rec long, n int, cls long"), "mixed-lists")
    most = mixed.groupBy("rec").agg(F.count("*").cast("int").alias("most"), F.first("n").alias("n")).where("most > n div 20").select("rec", "most")
    meeting = stored(mixed.join(most, "rec").select(F.xxhash64("bucket", "token").alias("list"), "rec", "n", "cls", "most"), "meeting")
    parts = max(1, -(-meeting.count() // PART_POSTINGS))
    apart = meeting.withColumn("part", F.pmod("list", F.lit(parts))).groupBy("part").applyInArrow(_cross(percent), "q long, c long, n int, m int, votes int")
    apart = stored(apart.groupBy("q", "c", "n", "m").agg(F.sum("votes").alias("votes")).where(F.col("votes") >= _shared_prefix(percent)), "cross-pairs")
    more = links_of(apart)
    classes = connected_components(links.unionByName(more), "q", "c")
    named = reps.select("sig", "size", "any_id", "rec").join(classes, F.col("rec") == F.col("node"), "left").select("sig", "size", "any_id", "rec", F.coalesce("component", "rec").alias("cls"))
    named = stored(named, "named")
    least = named.groupBy("cls").agg(F.min("any_id").alias("component_id"))
    by_sig = stored(named.join(least, "cls").select("sig", "size", "cls", "component_id"), "by-sig")
    return rows, by_sig, n_rows


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = 80) -> DataFrame:
    """One row of each class, of those with the smallest doc_id, and every row of an empty set.

    A row is known by its doc_id and its text, so a clean row stays beside a near copy that shares its doc_id, and rows
    without an id go like others. Of rows that agree in both, one stays.
    """
    rows, by_sig, _ = _classes(docs, words, percent, True)
    # one row for each set first: of a set that many rows share, few meet in a task
    kept = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("best")
    best = rows.where("n > 0").groupBy("sig").agg(kept).join(by_sig.select("sig", "cls"), "sig").groupBy("cls").agg(F.min("best").alias("best"))
    best = stored(best.select(F.col("best.key").alias("key")), "class-rows")
    times = rows.where("n > 0").groupBy("key").agg(F.count("*").alias("times")).join(best.withColumn("stays", F.lit(True)), "key", "left")
    marked = stored(times.where("stays IS NULL OR times > 1").select("key", F.col("stays").isNotNull().alias("stays")), "near-copies")
    # the columns of docs go as one, so no name can clash
    own = docs.select(_row_key().alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"))
    out = own.join(marked, "key", "left_anti")
    tied = marked.where("stays").select("key")
    if tied.head(1):
        out = out.unionByName(own.join(tied, "key", "left_semi").dropDuplicates(["key"]))
    return out.select("own.*")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_classes(read_table(spark, sf_dir, "documents"))
