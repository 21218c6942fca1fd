"""New batches against all history: incremental record linkage over persisted blocking keys.

History is a folder of runs. A run holds its rows (id, batch, text class, shingle set, field hashes), the blocking keys of
its classes, packed, and the union-find mappings it changed; a run counts once its last table is written. Blocking keys
are bands of minimum hashes, ROWS to a band: unrelated texts of one domain, which share a tenth of their shingles,
meet in one of a hundred thousand pairs, while a pair of similarity 0.6 escapes all BANDS bands with probability 0.002
and one of 0.7 with less than a millionth. A batch probes the key tables of all runs; scores are exact set similarities
plus learned weights of the fields.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.operators.components import connected_components
from quarrymill.operators.ledger import survivors
from quarrymill.runtime import Workspace, fold

_WORDS = re.compile(r"[^\W_]+")
BANDS, ROWS = 128, 6
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Rows whose classes and keys are packed together; keys that a task holds at once (a multiple of BANDS below 2^23).
CHUNK, SLICE = 2_000, 1 << 20
#: Members of one key in a slice beyond which they are not gathered by their key.
HOT = 4_096
#: Keys a bucket holds on average; most buckets, bounded by the 16 bits that 48-bit keys leave.
BUCKET_KEYS, MOST_BUCKETS = 1_000_000, 1 << 16
#: Batches of one call, whose names go to every task.
MOST_BATCHES = 100_000
#: Most class ids (8 bytes each) that are broadcast.
BROADCAST_IDS = 1_000_000


def words(text: str) -> list[str]:
    """Runs of letters and digits after NFKC and lower-casing."""
    return _WORDS.findall(unicodedata.normalize("NFKC", text).lower())


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def shingle_set(ws: list[str], k: int, memo: dict[str, int]) -> np.ndarray:
    """The sorted set of hashed runs of ``k`` words; empty for shorter texts."""
    if len(ws) < k:
        return np.zeros(0, np.int32)
    h = np.array([memo[w] if w in memo else memo.setdefault(w, xxhash.xxh64_intdigest(w)) for w in ws], np.uint64)
    acc = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        acc = _mix(acc + h[i : len(h) - k + 1 + i] + np.uint64(i + 1))
    return np.unique((acc >> np.uint64(32)).astype(np.uint32).view(np.int32))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Blocking keys ``(sets, BANDS)`` of 48 bits each."""
    rng = np.random.default_rng(29)
    mul = (rng.integers(1 << 31, size=BANDS * ROWS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
    add = rng.integers(1 << 32, size=BANDS * ROWS, dtype=np.uint32)
    band = _mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    out = np.empty((len(sets), BANDS), np.uint64)
    for i, s in enumerate(sets):
        low = np.full(BANDS * ROWS, (1 << 32) - 1, np.uint32)
        for c in range(0, len(s), 512):  # texts of any length, in bounded memory
            x = _mix(s[c : c + 512].view(np.uint32).astype(np.uint64)).astype(np.uint32)
            np.minimum(low, (x[:, None] * mul + add).min(0), out=low)
        h = band.copy()
        for r in range(ROWS):
            h = _mix(h + low[r::ROWS])
        out[i] = h
    return out >> np.uint64(16)


def _six(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _keys(data: bytes) -> np.ndarray:
    six = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view("<u8").ravel()


_FIELDS = {"id": pa.string(), "o": pa.int32(), "cls": pa.int64(), "n": pa.int32(), "shingles": pa.list_(pa.int32()), "title": pa.int64(), "company": pa.int64(), "keys": pa.binary(), "who": pa.binary(), "os": pa.binary()}
_SCHEMA = "id string, o int, cls long, n int, shingles array<int>, title long, company long, keys binary, who binary, os binary"


def _signed(names: dict[str, int], k: int):
    """Rows of kind 0 (a row with its class and shingle set) and of kind 1 (the packed keys of up to CHUNK classes)."""

    def table(kind: int, height: int, **cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(height, kind, np.int32)), *[cols[c] if c in cols else pa.nulls(height, t) for c, t in _FIELDS.items()]], ["kind", *_FIELDS])

    def run(batches):
        memo: dict[str, int] = {}
        for whole in batches:
            for s in range(0, whole.num_rows, CHUNK):
                b = whole.slice(s, CHUNK)
                if len(memo) > 200_000:
                    memo.clear()
                sets = [shingle_set(words(t), k, memo) if t else np.zeros(0, np.int32) for t in b.column("text").to_pylist()]
                n = np.array([len(x) for x in sets], np.int32)
                cls = np.array([xxhash.xxh64_intdigest(x.tobytes()) - (1 << 63) for x in sets], np.int64)
                o = np.array([names[x] for x in b.column("batch").to_pylist()], np.int32)
                ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets)))
                yield table(0, len(sets), id=b.column("id"), o=pa.array(o), cls=pa.array(cls), n=pa.array(n), shingles=lists, title=b.column("title"), company=b.column("company"))
                # a class of this chunk once, at its first batch
                at = np.lexsort((o, cls))
                at = at[n[at] > 0]
                at = at[np.concatenate([[True], cls[at][1:] != cls[at][:-1]])] if len(at) else at
                if len(at):
                    keys = signatures([sets[i] for i in at])
                    yield table(1, 1, keys=pa.array([_six(keys.ravel())]), who=pa.array([cls[at].tobytes()]), os=pa.array([o[at].tobytes()]))

    return run


_PART = "bucket int, salt int, kind int, key binary, at binary, who binary, os binary, fresh binary"


def _split(buckets: int):
    """Packed keys by bucket: sorted slices of (key, class, batch).

    A key with more than HOT members in a slice is hot: its members go to a group of their own slice (kind 2), and
    only the earliest of them to the key's bucket (kind 1), which thus stays small however many members a key has.
    """

    def rows(kind, salt, key, idx, who, os, fresh):
        bucket = (key * np.uint64(buckets)) >> np.uint64(48)
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(key) else np.zeros(0, int)
        for s, e in zip(cut, np.append(cut[1:], len(key))):
            u, at = np.unique(idx[s:e], return_inverse=True)
            yield int(bucket[s]), salt, kind, _six(key[s:e]), at.astype(np.uint16).tobytes(), who[u].tobytes(), os[u].tobytes(), fresh[u].tobytes()

    def flush(held):
        n = np.cumsum([0, *[len(h[1]) for h in held]])
        key, who, os = (np.concatenate([h[i] for h in held]) for i in range(3))
        fresh = np.concatenate([np.full(len(h[1]), h[3]) for h in held])
        idx = np.repeat(np.arange(n[-1]), BANDS)
        at = np.argsort(key, kind="stable")
        key, idx = key[at], idx[at]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        out = []
        if (size > HOT).any():
            hot = np.repeat(size > HOT, size)
            salt = int(xxhash.xxh32_intdigest(who.tobytes()) >> 1) | 1
            out += rows(2, salt, key[hot], idx[hot], who, os, fresh)
            o = np.lexsort((who[idx[hot]], os[idx[hot]], key[hot]))
            k, i = key[hot][o], idx[hot][o]
            lead = np.concatenate([[True], k[1:] != k[:-1]])
            out += rows(1, 0, k[lead], i[lead], who, os, fresh)
            key, idx = key[~hot], idx[~hot]
        out += rows(0, 0, key, idx, who, os, fresh)
        return pd.DataFrame(out, columns=["bucket", "salt", "kind", "key", "at", "who", "os", "fresh"])

    def run(batches):
        held, n = [], 0
        for pdf in batches:
            for k, w, o, fresh in zip(pdf["keys"], pdf["who"], pdf["os"], pdf["fresh"]):
                who = np.frombuffer(w, np.int64)
                if n and n + len(who) * BANDS > SLICE:
                    yield flush(held)
                    held, n = [], 0
                held.append((_keys(k), who, np.frombuffer(o, np.int32), bool(fresh)))
                n += len(who) * BANDS
        if n:
            yield flush(held)

    return run


_LED = "kind int, key long, cls long, o int, leader long, lead_o int, fresh boolean"


def _leaders(pdf: pd.DataFrame) -> pd.DataFrame:
    """The leader of each key of a bucket, its earliest class, beside each other member of the key (kind 0).

    Keys without a second member or without a fresh one drop out. Of hot keys the leader is told (kind 1); the group
    of a hot slice passes its members on (kind 2).
    """
    parts = []
    for kind, k, a, w, o, f in zip(pdf["kind"], pdf["key"], pdf["at"], pdf["who"], pdf["os"], pdf["fresh"]):
        at = np.frombuffer(a, np.uint16)
        parts.append((_keys(k), np.frombuffer(w, np.int64)[at], np.frombuffer(o, np.int32)[at], np.frombuffer(f, bool)[at], np.full(len(at), kind == 1)))
    key, cls, o, fresh, told = (np.concatenate(x) for x in zip(*parts))
    if pdf["salt"].iloc[0]:
        return pd.DataFrame({"kind": 2, "key": key.view(np.int64), "cls": cls, "o": o, "leader": cls, "lead_o": o, "fresh": fresh})
    at = np.argsort(key, kind="stable")
    size = np.diff(np.append(np.flatnonzero(np.concatenate([[True], key[at][1:] != key[at][:-1]])), len(key)))
    at = at[np.repeat(size > 1, size) | told[at]]
    at = at[np.lexsort((o[at], cls[at], told[at], key[at]))]
    same = (key[at][1:] == key[at][:-1]) & (cls[at][1:] == cls[at][:-1]) & (told[at][1:] == told[at][:-1])
    at = at[np.concatenate([[True], ~same])] if len(at) else at
    at = at[np.lexsort((cls[at], o[at], key[at]))]
    key, cls, o, fresh, told = key[at], cls[at], o[at], fresh[at], told[at]
    if not len(key):
        return pd.DataFrame({c: pd.Series(dtype=t) for c, t in zip(("kind", "key", "cls", "o", "leader", "lead_o", "fresh"), ("int32", "int64", "int64", "int32", "int64", "int32", "bool"))})
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(first, len(key)))
    leader, lead_o = np.repeat(cls[first], size), np.repeat(o[first], size)
    live = np.repeat(np.logical_or.reduceat(fresh, first), size)
    keep = told | (live & (cls != leader))
    return pd.DataFrame({"kind": told.astype(np.int32), "key": key.view(np.int64), "cls": cls, "o": o, "leader": leader, "lead_o": lead_o, "fresh": fresh})[keep]


FIELDS = ("title", "company")


class History:
    """Everything accepted so far, as runs in a folder; see the module. ``ingest`` checks batches and adds them.

    Clusters are a union-find over text classes: a run writes the representatives of the classes its links touch, and
    one row for each older representative that it merges into another; ``representatives`` follows them.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, weights: dict[str, tuple[float, float]] | None = None, k: int = 3, threshold: float = 0.6):
        self.spark, self.k, self.t = spark, k, threshold
        self.ws = Workspace(spark, "linkage")
        self.folder = (folder or f"{self.ws.root}/history").rstrip("/")
        self.weights = weights

    # -- tables -------------------------------------------------------------------------------------------------------

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def runs(self) -> list[str]:
        """Folders of the runs that count: numbered from 0, without a gap."""
        out: list[str] = []
        while self._exists(f"{self.folder}/run-{len(out):06d}/done/_SUCCESS"):
            out.append(f"{self.folder}/run-{len(out):06d}")
        return out

    def _read(self, runs: list[str], name: str, schema: str) -> DataFrame:
        at = [f"{r}/{name}" for r in runs if self._exists(f"{r}/{name}")]
        return self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)

    def rows(self, runs: list[str] | None = None) -> DataFrame:
        """``(id, o, cls, n, shingles, title, company)``: every delivered row, ``o`` being its batch's number."""
        return self._read(self.runs() if runs is None else runs, "rows/kind=0", _SCHEMA).drop("keys", "who", "os")

    def packed_keys(self, runs: list[str]) -> DataFrame:
        return self._read(runs, "rows/kind=1", _SCHEMA).select("keys", "who", "os")

    def batches(self, runs: list[str] | None = None) -> DataFrame:
        return self._read(self.runs() if runs is None else runs, "done", "name string, o int, weights string")

    def mappings(self, runs: list[str] | None = None) -> DataFrame:
        return self._read(self.runs() if runs is None else runs, "reps", "node long, rep long")

    def representatives(self, runs: list[str] | None = None) -> DataFrame:
        """``(cls, rep)`` of every class that a link touched: mappings of representatives are followed to their end."""
        runs = self.runs() if runs is None else runs
        m = self.mappings(runs)
        if len(runs) < 2:
            return m.toDF("cls", "rep")
        got = survivors(m.where("node <> rep"), "node", "rep").select(F.col("node").alias("cls"), F.col("survivor").alias("rep"))
        alone = m.select(F.col("node").alias("cls")).distinct().join(got.select("cls"), "cls", "left_anti").select("cls", F.col("cls").alias("rep"))
        return got.union(alone)

    def clusters(self) -> DataFrame:
        """``(id, cluster, size)``: every id with a text, the smallest id of its cluster and the number of its ids."""
        d = self.rows().where("id is not null and n > 0").select("id", "cls").distinct().join(self.representatives(), "cls", "left").select("id", F.coalesce("rep", "cls").alias("rep")).distinct()
        per = d.groupBy("rep").agg(F.min("id").alias("cluster"), F.count("*").alias("size"))
        return d.join(per, "rep").select("id", "cluster", "size")

    # -- probing ------------------------------------------------------------------------------------------------------

    def _jaccard(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """``(a, b, jac)`` of pairs of classes, by exact set overlap; only sets that a pair names travel."""
        named = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        few = named.count() <= BROADCAST_IDS
        used = sets.join(F.broadcast(named) if few else named, "cls", "left_semi").groupBy("cls").agg(F.any_value("shingles").alias("s"))
        both = pairs.join(used.toDF("a", "sa"), "a").join(used.toDF("b", "sb"), "b")
        common = F.size(F.array_intersect("sa", "sb"))
        return both.select("a", "b", (common / (F.size("sa") + F.size("sb") - common)).alias("jac"))

    def _links(self, fresh: DataFrame, old: DataFrame | None, sets: DataFrame, keys: int) -> DataFrame:
        """``(a, b, jac)``: links of similar classes, at least one of them fresh; what they join is all that is similar.

        Every key has a leader, its earliest class, and all members are scored against it: a family of near copies,
        however large, meets its few leaders instead of itself. Two members that are both similar to their leader are
        joined by it. Other two members meet if the triangle inequality of the Jaccard distance leaves them possible:
        |d(a, leader) - d(b, leader)| must not exceed 1 - threshold. So a class that is similar to one of an earlier
        batch has a link to such a one, or both have one to the leader, which is no later.
        """
        packed = fresh.withColumn("fresh", F.lit(True))
        if old is not None:
            packed = packed.union(old.withColumn("fresh", F.lit(False)))
        buckets = min(MOST_BUCKETS, max(12, -(-keys // BUCKET_KEYS)))
        led = self.ws.cut(packed.mapInPandas(_split(buckets), _PART).groupBy("bucket", "salt").applyInPandas(_leaders, _LED), "led")
        lead = led.where("kind = 0").drop("kind")
        if not led.where("kind = 2").isEmpty():
            told = led.where("kind = 1").groupBy("key").agg(F.min(F.struct("lead_o", "leader")).alias("l")).select("key", "l.leader", "l.lead_o")
            hot = led.where("kind = 2").select("key", "cls", "o", "fresh").join(told, "key").where("cls <> leader")
            lead = lead.unionByName(hot)
        scored = self.ws.cut(self._jaccard(lead.select(F.col("cls").alias("a"), F.col("leader").alias("b")).distinct(), sets), "scored")
        far = scored.select(F.col("a").alias("cls"), F.col("b").alias("leader"), (1 - F.col("jac")).alias("d"))
        member = lead.join(far, ["cls", "leader"]).select("key", "cls", "fresh", "d")
        x, y = member.where("fresh").toDF("key", "a", "fa", "da"), member.toDF("key", "b", "fb", "db")
        most = 1 - self.t
        once = F.when(F.col("fb"), F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b"))
        near = x.join(y, "key").where(once & ~((F.col("da") <= most) & (F.col("db") <= most)) & (F.abs(F.col("da") - F.col("db")) <= most + 1e-9)).select("a", "b").distinct()
        more = self._jaccard(self.ws.cut(near, "near"), sets)
        return scored.union(more).where(F.col("jac") >= self.t)

    # -- weights ------------------------------------------------------------------------------------------------------

    @staticmethod
    def learned(rows: DataFrame) -> dict[str, tuple[float, float]]:
        """Log odds that a field agrees or differs, of a pair that is one record against a random pair.

        Pairs known to be one record are the first and last version of every id whose text changed; the chance that a
        random pair agrees is the sum of squares of the shares of the field's values, over all rows. Shares are smoothed
        by one case; missing values are no evidence.
        """
        v = F.struct("o", "cls")
        per = rows.where("id is not null and n > 0").groupBy("id").agg(*[f(F.col(c), v).alias(f"{c}_{i}") for c in FIELDS for i, f in enumerate((F.min_by, F.max_by))], (F.min("cls") != F.max("cls")).alias("changed"))
        same = fold(per.where("changed"), **{f"{c}_{k}": F.count_if(F.col(f"{c}_0") == F.col(f"{c}_1") if k else F.col(f"{c}_0") != F.col(f"{c}_1")) for c in FIELDS for k in (0, 1)})
        out = {}
        for c in FIELDS:
            got = fold(rows.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").cast("double").alias("x")), s=F.sum(F.col("x") * F.col("x")), n=F.sum("x"))
            n = got["n"] or 0.0
            u = ((got["s"] or 0.0) + 1) / (n * n + 2)
            m = (same[f"{c}_1"] + 1) / (same[f"{c}_0"] + same[f"{c}_1"] + 2)
            out[c] = (float(np.log(m / u)), float(np.log((1 - m) / (1 - u))))
        return out

    # -- batches ------------------------------------------------------------------------------------------------------

    def ingest(self, df: DataFrame, id_col: str, batch_col: str, text_col: str, title_col: str, company_col: str) -> DataFrame:
        """Checks batches against the history and each other, then adds them: ``(batch, id, seen, score)``.

        ``seen`` says that an earlier batch has the id or a text of a similarity of ``threshold`` or more; the score is
        that of the best earlier text: its similarity plus the learned weights of the fields, null where there is none.
        Batches of one call count in the order of their names, those of later calls after all before; a known batch
        keeps its place. Taking batches in one call or in several gives the same rows. Rows of one batch do not count
        against each other; rows without a batch take no part, rows without an id only as texts; a null text or one
        shorter than a shingle is similar to nothing; repeated rows come once; an empty table gives no rows. Field
        weights are learned in the first call, from all its rows, and kept.
        """
        spark, ws, before = self.spark, self.ws, self.runs()
        run = f"{self.folder}/run-{len(before):06d}"
        fs, p = self._fs(run)
        fs.delete(p, True)  # what a call that failed has left
        norm = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))))
        d = df.select(F.col(id_col).cast("string").alias("id"), F.col(batch_col).cast("string").alias("batch"), F.col(text_col).alias("text"), norm(title_col).alias("title"), norm(company_col).alias("company")).where("batch is not null")
        fresh_names = [r[0] for r in d.groupBy("batch").count().select("batch").limit(MOST_BATCHES + 1).collect()]
        if len(fresh_names) > MOST_BATCHES:
            raise ValueError(f"more than {MOST_BATCHES} batches in one call")
        known = {r["name"]: r["o"] for r in self.batches(before).where(F.col("name").isin(fresh_names)).collect()} if before else {}
        last = fold(self.batches(before), o=F.max("o"))["o"] if before else None
        order = {n: i for i, n in enumerate(sorted(set(fresh_names) - set(known)), 0 if last is None else last + 1)}
        d.mapInArrow(_signed({**known, **order}, self.k), "kind int, " + _SCHEMA).write.option("compression", "zstd").partitionBy("kind").parquet(f"{run}/rows")
        new, old = self.rows([run]), self.rows(before)
        every = new.union(old)
        if self.weights is None:
            kept = self.batches(before).where("weights is not null").select("weights").limit(1).collect() if before else []
            self.weights = {c: tuple(w) for c, w in json.loads(kept[0][0]).items()} if kept else self.learned(new)
        texts, earlier = every.where("n > 0"), old.where("n > 0")
        keys = (new.count() + (old.count() if before else 0)) * BANDS
        near = ws.cut(self._links(self.packed_keys([run]), self.packed_keys(before) if before else None, texts.select("cls", "shingles"), keys), "links")

        # scores: the best similar text of an earlier batch, with the fields of its first row
        fresh_cls, fresh_ids = new.where("n > 0").select("cls").distinct(), new.where("id is not null").select("id").distinct()
        named = near.select(F.explode(F.array("a", "b")).alias("cls")).union(fresh_cls).distinct()
        by_cls = (texts if not before else texts.join(named, "cls", "left_semi")).groupBy("cls").agg(F.min("o").alias("first"), F.min_by(F.struct(*FIELDS), F.struct("o", "id")).alias("f"))
        by_id = (every.where("id is not null") if not before else every.join(fresh_ids, "id", "left_semi")).groupBy("id").agg(F.min("o").alias("born"), F.min_by(F.when(F.col("n") > 0, F.col("cls")), F.when(F.col("n") > 0, F.struct("o", "cls"))).alias("first_cls"))
        rows_ = new.where("id is not null").select("id", "o", F.when(F.col("n") > 0, F.col("cls")).alias("cls"), F.struct(*FIELDS).alias("fa")).distinct()
        w = lambda a, b, c: F.when(F.col(f"{a}.{c}") == F.col(f"{b}.{c}"), self.weights[c][0]).when(F.col(f"{a}.{c}") != F.col(f"{b}.{c}"), self.weights[c][1]).otherwise(0.0)
        plus = lambda a, b: sum((w(a, b, c) for c in FIELDS), F.lit(0.0))
        # links lead from the later class to the earlier one, so a leader with many links looks none of them up;
        # an exact repeat has similarity 1, and a row counts against texts of earlier batches only
        x, y = by_cls.toDF("a", "oa", "fa"), by_cls.toDF("b", "ob", "fb")
        met = near.join(x, "a").join(y, "b").where("oa <> ob")
        later = F.col("oa") > F.col("ob")
        texts_of = met.select(F.when(later, F.col("a")).otherwise(F.col("b")).alias("cls"), F.least("oa", "ob").alias("first"), F.when(later, F.col("fb")).otherwise(F.col("fa")).alias("fb"), "jac").union(by_cls.select("cls", "first", "f", F.lit(1.0)))
        score = F.when(F.col("o") > F.col("first"), F.col("jac") + plus("fa", "fb"))
        mine = rows_.join(by_id.select("id", "born"), "id").join(texts_of, "cls", "left")
        out = mine.groupBy("id", "o").agg(F.max((F.col("o") > F.col("born")) | score.isNotNull()).alias("seen"), F.round(F.max(score), 6).alias("score"))

        # union-find: links of texts and of versions of an id; of older clusters only those a link touches are read
        versions = new.where("id is not null and n > 0").select("id", F.col("cls").alias("a")).distinct().join(by_id.select("id", F.col("first_cls").alias("b")), "id").where("a <> b").select("a", "b")
        links = near.select("a", "b").union(versions)
        if before:
            reps = self.representatives(before)
            touched = links.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(reps, "cls")
            links = links.union(touched.where("cls <> rep").select("cls", "rep"))
        connected_components(links, ws=ws).toDF("node", "rep").write.option("compression", "zstd").parquet(f"{run}/reps")
        done = [(n, o, json.dumps(self.weights)) for n, o in order.items()] or [(None, None, None)]
        spark.createDataFrame(done, "name string, o int, weights string").coalesce(1).write.parquet(f"{run}/done")
        names = self.batches([*before, run]).where("name is not null").select("o", F.col("name").alias(batch_col))
        return out.join(names, "o").select(batch_col, F.col("id").alias(id_col), "seen", "score")
