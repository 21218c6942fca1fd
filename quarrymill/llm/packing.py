"""Containers of fixed capacity, filled with related texts by lexical retrieval packing."""

from __future__ import annotations

import bisect
import re
import zlib
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.tokens import FOLDER, RANKS, encoder
from quarrymill.runtime import Workspace, fold

_GAP = re.compile(r"\W")
#: Term buckets; document frequencies are a table of this fixed size, counted over all documents.
BUCKETS = 1 << 18
K1, B = 1.2, 0.75


#: Characters whose words are hashed at once.
CHUNK = 1 << 20
#: Bytes up to which the words of a chunk are hashed together; longer words are hashed one by one.
LONG = 64
#: One step of CRC-32, by the low byte of the register.
_STEP = np.array([zlib.crc32(bytes([i ^ 0xFF])) ^ 0xFF000000 for i in range(256)], np.uint32)


@cache
def _word_chars() -> np.ndarray:
    r"""Whether ``\w`` matches, by code point."""
    out = np.strings.isalnum(np.arange(0x110000, dtype=np.uint32).view("<U1"))
    out[ord("_")] = True
    return out


def _hashed(low: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The text's number and the CRC-32 of the UTF-8 bytes, for every word of the lowered texts."""
    joined = "\n".join(low)  # no word goes on in the next text
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    raw = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
    on = np.zeros(len(chars) + 2, bool)
    on[1:-1] = _word_chars()[chars]
    edge = np.flatnonzero(on[1:] != on[:-1])
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in low]), edge[::2], "right")
    if len(raw) > len(chars):
        edge = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))[edge]
    start, n = edge[::2], edge[1::2] - edge[::2]
    # shortest first: the words that have a byte at a position are the last ones
    o = np.argsort(np.minimum(n, LONG + 1).astype(np.uint8), kind="stable")
    start, n = start[o], n[o]
    crc = np.full(len(o), 0xFFFFFFFF, np.uint32)
    for at, k in enumerate(np.searchsorted(n, np.arange(LONG), "right")):
        if k == len(o):
            break
        c = crc[k:]
        crc[k:] = _STEP[(c ^ raw[start[k:] + at]) & 0xFF] ^ (c >> 8)
    crc ^= 0xFFFFFFFF
    for j in range(np.searchsorted(n, LONG, "right"), len(o)):
        crc[j] = zlib.crc32(raw[start[j] : start[j] + n[j]])
    out = np.empty_like(crc)
    out[o] = crc
    return owner, out


def _chunks(texts: list[str]):
    """Slices of about CHUNK characters, of one text at least."""
    begin = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK or k == len(texts) - 1:
            yield slice(begin, k + 1)
            begin, size = k + 1, 0


def _pieces(text: str):
    """The text in pieces of about CHUNK characters; no word is cut."""
    begin = 0
    while len(text) - begin > CHUNK:
        gap = _GAP.search(text, begin + CHUNK)
        end = gap.start() if gap else len(text)
        yield text[begin:end]
        begin = end
    yield text[begin:]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    r"""The text's number and the CRC-32 of the UTF-8 bytes, for every match of ``\w+`` in the lowered texts."""
    owner, pieces = [], []
    for k, t in enumerate(texts):
        for piece in _pieces(t.lower()):
            owner.append(k)
            pieces.append(piece)
    owner, out = np.array(owner, np.int64), [(np.zeros(0, np.int64), np.zeros(0, np.uint32))]
    for part in _chunks(pieces):
        at, crc = _hashed(pieces[part])
        out.append((owner[part][at], crc))
    return np.concatenate([at for at, _ in out]), np.concatenate([crc for _, crc in out])


def features(docs: DataFrame, id_col: str, text_col: str, folder: str = FOLDER, ranks: str = RANKS) -> DataFrame:
    """``(id, n_tokens, terms, tf)`` of every text with tokens: its size and its term counts."""

    def run(batches):
        enc = encoder(folder, ranks)
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for part in _chunks(texts):
                own = texts[part]
                tokens = np.fromiter((len(enc.encode_ordinary(t)) for t in own), np.int32, len(own))
                owner, crc = word_hashes(own)
                key, tf = np.unique(owner * BUCKETS + (crc & (BUCKETS - 1)), return_counts=True)
                ends = pa.array(np.searchsorted(key, np.arange(len(own) + 1) * BUCKETS).astype(np.int32))
                terms, tf = (key & (BUCKETS - 1)).astype(np.int32), np.minimum(tf, 32767).astype(np.int16)
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (terms, tf)]
                yield pa.RecordBatch.from_arrays([ids[part], pa.array(tokens), *lists], ["id", "n_tokens", "terms", "tf"])

    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    return d.mapInArrow(run, "id long, n_tokens int, terms array<int>, tf array<short>")


def document_frequencies(feats: DataFrame) -> np.ndarray:
    """Documents that hold each term bucket: an array of BUCKETS counts."""

    def run(batches):
        acc = np.zeros(BUCKETS, np.int64)
        for pdf in batches:
            if len(pdf):
                acc += np.bincount(np.concatenate(pdf["terms"].to_numpy()), minlength=BUCKETS)
        at = np.flatnonzero(acc)
        yield pd.DataFrame({"at": at.astype(np.int32), "n": acc[at]})

    out = np.zeros(BUCKETS, np.int64)
    slots = feats.select("terms").mapInPandas(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).groupBy((F.col("at") / 4096).cast("int").alias("slot")).agg(F.collect_list(F.struct("at", "n")).alias("c"))
    for r in slots.toLocalIterator():
        for c in r.c:
            out[c["at"]] = c["n"]
    return out


class Shard:
    """BM25 index over the documents of one shard; a seed asks with all its terms.

    Terms of few documents are posting lists; terms of more than one document in ``common`` are rows of a dense
    matrix, whose part of the scores is one matrix product a block of seeds. Terms no other document of the shard
    holds can retrieve nothing and are left out. Blocks are scored as they are asked for and kept.
    """

    def __init__(self, terms: list[np.ndarray], tf: list[np.ndarray], length: np.ndarray, idf: np.ndarray, mean: float, common: int = 32, block: int = 256):
        n = np.array([len(t) for t in terms], np.int64)
        doc, term, f = np.repeat(np.arange(len(terms)), n), np.concatenate(terms), np.concatenate(tf).astype(np.float32)
        w = (idf[term] * f * (K1 + 1) / (f + K1 * (1 - B + B * length[doc] / mean))).astype(np.float32)
        o = np.argsort(term, kind="stable")
        doc, w = doc[o], w[o]
        df = np.unique(term[o], return_counts=True)[1]
        self.size, self.block = len(terms), block
        many, few = (df > 1) & (df * common > len(terms)), (df > 1) & (df * common <= len(terms))
        on = np.repeat(many, df)
        self.dense = np.zeros((many.sum(), self.size), np.float32)
        self.dense[np.repeat(np.arange(many.sum()), df[many]), doc[on]] = w[on]
        # posting lists of the other shared terms, and for each document the lists its terms name
        on = np.repeat(few, df)
        self.doc, self.weight, self.count = doc[on], w[on], df[few]
        self.start = np.cumsum(self.count) - self.count
        lists = np.repeat(np.arange(len(self.count)), self.count)
        o = np.argsort(self.doc, kind="stable")
        self.named = lists[o]
        self.bounds = np.searchsorted(self.doc[o], np.arange(self.size + 1))
        self.kept: dict[int, np.ndarray] = {}

    def scores(self, seed: int) -> np.ndarray:
        """The BM25 score of every document of the shard for all terms of the seed; 0 where they share none."""
        k = seed // self.block
        if k not in self.kept:
            self.kept[k] = self._scored(k * self.block, min(self.size, (k + 1) * self.block))
        return self.kept[k][seed - k * self.block]

    def _scored(self, s: int, e: int) -> np.ndarray:
        out = (self.dense[:, s:e] > 0).T.astype(np.float32) @ self.dense
        lists = self.named[self.bounds[s] : self.bounds[e]]
        who = np.repeat(np.arange(e - s), np.diff(self.bounds[s : e + 1]))
        count = self.count[lists]
        at = np.repeat(self.start[lists] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return out + np.bincount(np.repeat(who, count) * self.size + self.doc[at], self.weight[at], out.size).reshape(out.shape).astype(np.float32)


def fill(sizes: np.ndarray, owner: np.ndarray, scores, capacity: int) -> list[list[int]]:
    """Containers of item numbers. Each is opened by the largest item left, takes the unused items of the documents
    nearest to the seed's while they fit, and is closed with the largest unused items that still fit."""
    by_size = sorted((int(s), i) for i, s in enumerate(sizes))
    used = np.zeros(len(sizes), bool)
    out = []

    def largest(most: int) -> int | None:
        k = bisect.bisect_right(by_size, (most, len(sizes)))
        while k and used[by_size[k - 1][1]]:
            by_size.pop(k - 1)
            k -= 1
        return by_size[k - 1][1] if k else None

    least = int(sizes.min()) if len(sizes) else 0
    while (seed := largest(capacity)) is not None:
        used[seed] = True
        box, room = [seed], capacity - int(sizes[seed])
        if room >= least:
            # an item that does not fit now never will: room only shrinks
            at = np.flatnonzero(~used & (sizes <= room))
            score, size = scores(int(owner[seed]))[owner[at]], sizes[at]
            while len(at) and score[j := int(score.argmax())] > 0:
                used[at[j]] = True
                box.append(int(at[j]))
                room -= int(size[j])
                score[j] = 0
                if room < least:
                    break
                score[size > room] = 0
        while room >= least and (i := largest(room)) is not None:
            used[i] = True
            box.append(i)
            room -= int(sizes[i])
        out.append(box)
    return out


_OUT = "spec_id int, container string, position int, id long, part int, start_token int, n_tokens int"


def pack(docs: DataFrame, specs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_shard: int = 4000, folder: str = FOLDER, ranks: str = RANKS) -> DataFrame:
    """``(spec_id, container, position, id, part, start_token, n_tokens)``: every token of every text in one
    container of each capacity.

    A text larger than the capacity is cut into whole containers and one remainder; no other text is cut. Documents
    are hashed into shards of about ``per_shard``, each an inverted index in a task of its own, with document
    frequencies of the whole corpus; only the last container of a shard can be left half empty. Null and empty texts
    take no part, repeated texts are packed each; capacities that are null or below 1 are left out; an empty table
    gives no rows. The list of capacities is read to the driver after a check of its size.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "packing")
    caps = [(int(r[0]), int(r[1])) for r in specs.select("spec_id", "capacity_tokens").where("capacity_tokens >= 1").distinct().limit(1001).collect()]
    if len(caps) > 1000:
        raise ValueError("more than 1000 capacities")
    caps.sort()
    feats = ws.cut(features(docs, id_col, text_col, folder, ranks), "features")
    stats = fold(feats, n=F.count("*"), mean=F.avg("n_tokens"))
    df = document_frequencies(feats)
    idf = np.log(1 + (stats["n"] - df + 0.5) / (df + 0.5)).astype(np.float32)
    shared = spark.sparkContext.broadcast((idf, float(stats["mean"] or 1.0)))
    shards = max(1, -(-stats["n"] // per_shard))

    def run(pdf):
        idf_, mean = shared.value
        pdf = pdf.sort_values("id", ignore_index=True)
        length = pdf["n_tokens"].to_numpy(np.int64)
        index = Shard(list(pdf["terms"]), list(pdf["tf"]), length, idf_, mean)
        ids, shard = pdf["id"].to_numpy(), int(pdf["shard"].iloc[0])
        for spec, cap in caps:
            whole, rest = length // cap, length % cap
            full = np.repeat(np.arange(len(length)), whole)
            part = np.arange(len(full)) - np.repeat(np.cumsum(whole) - whole, whole)
            rows = [(spec, f"{spec}-{shard}-w{ids[d]}-{p}", 0, ids[d], int(p), int(p) * cap, cap) for d, p in zip(full, part)]
            owner = np.flatnonzero(rest)
            for c, box in enumerate(fill(rest[owner], owner, index.scores, cap)):
                for at, i in enumerate(box):
                    d = owner[i]
                    rows.append((spec, f"{spec}-{shard}-{c}", at, ids[d], int(whole[d]), int(whole[d]) * cap, int(rest[d])))
            yield pd.DataFrame(rows, columns=["spec_id", "container", "position", "id", "part", "start_token", "n_tokens"])

    def one(pdf):
        return pd.concat(list(run(pdf)), ignore_index=True)

    placed = feats.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    if not caps:
        return spark.createDataFrame([], _OUT).withColumnRenamed("id", id_col)
    return placed.groupBy("shard").applyInPandas(one, _OUT).withColumnRenamed("id", id_col)


def fill_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """``(spec_id, capacity_tokens, containers, tokens, fill)`` of each capacity."""
    got = packed.groupBy("spec_id").agg(F.count_distinct("container").alias("containers"), F.sum("n_tokens").alias("tokens"))
    return specs.select("spec_id", "capacity_tokens").distinct().join(got, "spec_id").withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))
