"""Long exact spans shared between records, by fixed-block anchors.

Every text is cut into non-overlapping reference blocks of a third of the least span, so any span of the least
length holds at least two whole neighbouring blocks of the other text. The hashes of all blocks form the index; its
membership filter has a size bounded by a parameter and goes to every task. Every rolling window of every text probes
the filter; two hits one block apart are an anchor, so chance hits must coincide to cost anything. Around anchors only, windows of the full least length are hashed and
grouped: a window found in two texts is shared, and overlapping shared windows join to maximal spans. Texts that
are exact copies are one class with one representative; they never meet as pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.runtime import Workspace, fold

_BASE = 0x9E3779B97F4A7C15
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Characters hashed at once; a longer text is still hashed whole, alone.
CHUNK_CHARS = 1 << 19
#: Most ids (8 bytes each) that are broadcast.
BROADCAST_IDS = 1_000_000


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


class Roller:
    """Rolling hashes of all windows of a code-point array, by prefix sums of a polynomial modulo 2^64."""

    def __init__(self):
        self.n = 0

    def _grow(self, n: int) -> None:
        if n > self.n:
            m = max(n, 2 * self.n, 1 << 16)
            one = np.ones(1, np.uint64)
            self.p = np.cumprod(np.concatenate([one, np.full(m, _BASE, np.uint64)]))
            self.q = np.cumprod(np.concatenate([one, np.full(m, pow(_BASE, -1, 1 << 64), np.uint64)]))
            self.n = m

    def prefix(self, codes: np.ndarray) -> np.ndarray:
        self._grow(len(codes) + 1)
        out = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_mix(codes + np.uint64(7)) * self.p[: len(codes)], out=out[1:])
        return out

    def windows(self, prefix: np.ndarray, width: int) -> np.ndarray:
        n = len(prefix) - width
        return _mix((prefix[width:] - prefix[:-width]) * self.q[:n]) if n > 0 else np.zeros(0, np.uint64)

    def at(self, prefix: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
        return _mix((prefix[starts + width] - prefix[starts]) * self.q[starts])


def _chunks(ids, texts):
    """Runs of whole texts as one array of code points: (ids, starts, lengths, codes)."""
    part, size = [], 0
    for i, t in zip(ids, texts):
        if part and size + len(t) > CHUNK_CHARS:
            yield _joined(part)
            part, size = [], 0
        part.append((i, t))
        size += len(t)
    if part:
        yield _joined(part)


def _joined(part):
    lengths = np.array([len(t) for _, t in part], np.int64)
    codes = np.frombuffer("".join(t for _, t in part).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return np.array([i for i, _ in part], np.int64), np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64), lengths, codes


def _grid(starts, lengths, block):
    """Places of all whole non-overlapping blocks, and the text each is in."""
    n = lengths // block
    owner = np.repeat(np.arange(len(n)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return starts[owner] + k * block, owner


def _filter_bits(blocks: int, most: int) -> int:
    bits = 1 << 16
    while bits < 12 * blocks and bits < most:
        bits *= 2
    return bits


_SHIFTS = (0, 17, 34)


def _slots(h: np.ndarray, shift: int, bits: int) -> np.ndarray:
    return (h >> np.uint64(shift)) & np.uint64(bits - 1)


def _probe(bitmap: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Which hashes the filter holds; later slots are read only where the earlier ones are set."""
    at = np.arange(len(h))
    for shift in _SHIFTS:
        x = _slots(h[at], shift, bits)
        at = at[(bitmap[x >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8)) & 1 > 0]
    hit = np.zeros(len(h), bool)
    hit[at] = True
    return hit


def _bitmap_parts(bits: int, word_bits: int = 1 << 15):
    """Turns hashes into set words of the filter: (segment, bitmap of the segment), one row a segment a task."""

    def run(batches):
        bitmap = np.zeros(bits // 8, np.uint8)
        for pdf in batches:
            h = pdf["h"].to_numpy(np.int64).view(np.uint64)
            for shift in _SHIFTS:
                x = _slots(h, shift, bits)
                np.bitwise_or.at(bitmap, x >> np.uint64(3), np.uint8(1) << (x & np.uint64(7)).astype(np.uint8))
        for s in range(0, bits // 8, word_bits // 8):
            w = bitmap[s : s + word_bits // 8]
            if w.any():
                yield pd.DataFrame({"seg": [s // (word_bits // 8)], "bits": [w.tobytes()]})

    return run


def _or_segments(batches):
    """ORs the bitmaps of each segment that this task holds."""
    acc: dict[int, np.ndarray] = {}
    for pdf in batches:
        for s, b in zip(pdf["seg"], pdf["bits"]):
            w = np.frombuffer(b, np.uint8)
            acc[s] = acc[s] | w if s in acc else w.copy()
    for s, w in acc.items():
        yield pd.DataFrame({"seg": [s], "bits": [w.tobytes()]})


def _membership(hashes: DataFrame, bits: int) -> np.ndarray:
    """The filter over a column ``h``, of exactly ``bits`` bits however many hashes there are."""
    parts = hashes.mapInPandas(_bitmap_parts(bits), "seg int, bits binary").repartition("seg").mapInPandas(_or_segments, "seg int, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    step = min(1 << 15, bits) // 8
    for r in parts.toLocalIterator():
        out[r.seg * step : r.seg * step + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return out


def _packed(cols: list[np.ndarray], bucket: np.ndarray, names: tuple) -> pd.DataFrame:
    """Columns split by bucket, each part one binary value: what travels is columns, which compress, not rows. A column
    without values is empty in every part."""
    o = np.argsort(bucket, kind="stable")
    b = bucket[o]
    cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, int)
    parts = {n: [x.tobytes() for x in np.split(c[o], cut[1:])] if len(c) else [b""] * len(cut) for n, c in zip(names, cols)}
    return pd.DataFrame({"bucket": b[cut], **parts})


def _unpacked(col: pd.Series, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in col if x is not None), kind)


def _runs(ids: np.ndarray, first: np.ndarray, last: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts (id, first, last) joined where the texts of two of them touch; windows are ``least`` long."""
    o = np.lexsort((first, ids))
    ids, first, last = ids[o], first[o].astype(np.int64), last[o].astype(np.int64)
    if not len(ids):
        return ids, first.astype(np.int32), last.astype(np.int32)
    new = np.concatenate([[True], ids[1:] != ids[:-1]])
    shift = np.cumsum(new).astype(np.int64) << 33  # keeps the ends of one text apart from the next one's
    upto = np.maximum.accumulate(last + shift)
    new[1:] |= (first + shift)[1:] - upto[:-1] > least
    at = np.flatnonzero(new)
    return ids[at], first[at].astype(np.int32), (upto - shift)[np.append(at[1:], len(ids)) - 1].astype(np.int32)


#: Windows that a task holds at once.
HELD = 1 << 20
_PART = "bucket int, kind int, h binary, id binary, first binary, last binary"


def shared_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 200, most_filter_bits: int = 1 << 28) -> DataFrame:
    """``(id, span_start, span_end)``: each longest unbroken range of characters that lie in a run of ``least``
    characters which also occurs in another record's text. Offsets are 0-based code points, ends exclusive.

    Null, empty and short texts have no span; a text that another record repeats exactly is one span over its
    whole length; a passage repeated only inside its own text is not shared. Ids must be unique; other columns
    are ignored, an empty table gives no rows. ``most_filter_bits`` bounds what is broadcast (32 MB by default):
    beyond some 30 million blocks the filter passes more windows on to the exact grouping, it never loses one.

    A passage that a third of all texts hold is settled where it is read: windows that two texts of a slice of HELD
    windows hold are shared at once, leave the task as runs, and only one of them stands for the slice in the group of
    its hash.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "spans")
    block = (least + 1) // 3
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.length("text") >= least)
    # only keys are grouped; texts stay where they are read
    keys = ws.cut(d.select("id", F.unhex(F.sha2("text", 256)).alias("key"), F.length("text").alias("n")), "keys")
    several = keys.groupBy("key").agg(F.min("id").alias("rep"), F.max("id").alias("top")).where("rep <> top").select("key", "rep")
    copies = ws.cut(keys.join(several, "key").select("id", "rep", "n"), "copies")
    others = copies.where("id <> rep").select("id")
    # the ids of copies go to the texts while they are few, so that no text moves; beyond that both sides shuffle
    reps = d.join(F.broadcast(others) if copies.count() <= BROADCAST_IDS else others, "id", "left_anti")
    blocks = int(fold(keys, b=F.sum(F.floor(F.col("n") / block)))["b"] or 0)
    bits = _filter_bits(blocks, most_filter_bits)

    def index(batches):
        roll = Roller()
        for pdf in batches:
            for ids, starts, lengths, codes in _chunks(pdf["id"], pdf["text"]):
                at, owner = _grid(starts, lengths, block)
                yield pd.DataFrame({"h": roll.at(roll.prefix(codes), at, block).view(np.int64), "id": ids[owner]})

    ref = reps.mapInPandas(index, "h long, id long")
    buckets = max(12, blocks // 40_000 + 1)
    everywhere = spark.sparkContext.broadcast(_membership(ref.select("h"), bits))
    twice = ref.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("h")
    repeated = spark.sparkContext.broadcast(_membership(twice, bits))

    def packed(kind, h, ids, first, last, by_id):
        slot = _mix(ids.view(np.uint64)) if by_id else h
        return _packed([h, ids, first, last], (slot % np.uint64(buckets)).astype(np.int32), ("h", "id", "first", "last")).assign(kind=kind)

    def settled(h, ids, told):
        """Of windows sorted by hash: those that two texts hold and that are not told yet, and the first of each such."""
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
        two = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first) if len(h) else np.zeros(0, bool)
        return np.repeat(two, np.diff(np.append(first, len(h)))) & ~told, first[two]

    def flush(held):
        h, ids, at = (np.concatenate(c) for c in zip(*held))
        o = np.argsort(h, kind="stable")
        h, ids, at = h[o], ids[o], at[o]
        yes, lead = settled(h, ids, np.zeros(len(h), bool))
        i, f, e = _runs(ids[yes], at[yes], at[yes], least)
        none = np.zeros(0, np.uint64)
        parts = [(0, h[~yes], ids[~yes], at[~yes], at[:0], False), (2, h[lead], ids[lead], at[:0], at[:0], False), (1, none, i, f, e, True)]
        return pd.concat([packed(k, *x) for k, *x in parts if len(x[1])], ignore_index=True)[["bucket", "kind", "h", "id", "first", "last"]]

    def probe(batches):
        roll = Roller()
        held: list[tuple] = []
        n = 0
        for pdf in batches:
            for ids, starts, lengths, codes in _chunks(pdf["id"], pdf["text"]):
                prefix = roll.prefix(codes)
                h = roll.windows(prefix, block)
                hit = _probe(everywhere.value, h, bits)
                own, _ = _grid(starts, lengths, block)
                hit[own] = _probe(repeated.value, h[own], bits)
                at = np.flatnonzero(hit[:-block] & hit[block:]) if len(hit) > block else np.zeros(0, int)
                if not len(at):
                    continue
                # starts of full windows that hold the anchor's two blocks
                edge = np.zeros(len(codes) + 2, np.int32)
                np.add.at(edge, np.maximum(at - (least - 2 * block), 0), 1)
                np.add.at(edge, at + 1, -1)
                w = np.flatnonzero(np.cumsum(edge[: len(codes)]) > 0)
                owner = np.searchsorted(starts, w, side="right") - 1
                inside = w + least <= starts[owner] + lengths[owner]
                w, owner = w[inside], owner[inside]
                held.append((roll.at(prefix, w, least), ids[owner], (w - starts[owner]).astype(np.int32)))
                n += len(w)
                if n > HELD:
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)

    def shared(pdf):
        done = pdf["kind"] == 1
        run = pdf[done]
        rows = {k: pdf[pdf["kind"] == k] for k in (0, 2)}
        h = np.concatenate([_unpacked(rows[k]["h"], np.uint64) for k in (0, 2)])
        ids = np.concatenate([_unpacked(rows[k]["id"], np.int64) for k in (0, 2)])
        at = _unpacked(rows[0]["first"], np.int32)
        told = np.arange(len(h)) >= len(at)
        at = np.concatenate([at, np.zeros(len(h) - len(at), np.int32)])
        o = np.argsort(h, kind="stable")
        h, ids, at, told = h[o], ids[o], at[o], told[o]
        yes, _ = settled(h, ids, told)
        i = np.concatenate([ids[yes], _unpacked(run["id"], np.int64)])
        f, e = np.concatenate([at[yes], _unpacked(run["first"], np.int32)]), np.concatenate([at[yes], _unpacked(run["last"], np.int32)])
        i, f, e = _runs(i, f, e, least)
        return _packed([i, f, e], (_mix(i.view(np.uint64)) % np.uint64(buckets)).astype(np.int32), ("id", "first", "last"))

    def joined(pdf):
        i, f, e = _runs(_unpacked(pdf["id"], np.int64), _unpacked(pdf["first"], np.int32), _unpacked(pdf["last"], np.int32), least)
        return pd.DataFrame({"id": i, "span_start": f, "span_end": e + least})

    windows = reps.mapInPandas(probe, _PART)
    hits = windows.groupBy("bucket").applyInPandas(shared, "bucket int, id binary, first binary, last binary")
    runs = hits.groupBy("bucket").applyInPandas(joined, "id long, span_start int, span_end int")
    whole = copies.select("id", F.lit(0).alias("span_start"), F.col("n").cast("int").alias("span_end"))
    alone = runs.join(copies.where("id = rep").select("id"), "id", "left_anti")
    return alone.union(whole).withColumnRenamed("id", id_col)


def shared_share(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_chars, shared_chars, shared_share, n_spans)`` of every record; null and empty texts have share 0."""
    per = spans.groupBy(id_col).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"), F.count("*").alias("n_spans"))
    return (
        docs.select(F.col(id_col), F.coalesce(F.length(text_col), F.lit(0)).alias("n_chars"))
        .join(per, id_col, "left")
        .select(id_col, "n_chars", F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), F.coalesce(F.col("shared_chars") / F.col("n_chars"), F.lit(0.0)).alias("shared_share"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"))
    )
