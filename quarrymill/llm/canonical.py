"""Free-entered values mapped to a reference list, over BK-trees under a true edit metric."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most reference entries that are broadcast whole; longer lists are matched shard by shard.
BROADCAST_ENTRIES = 50_000


def _masks(q: str) -> dict[str, int]:
    """Bit i of the mask of a letter is set where ``q`` has it."""
    m: dict[str, int] = {}
    for i, c in enumerate(q):
        m[c] = m.get(c, 0) | 1 << i
    return m


def _distance(masks: dict[str, int], n: int, t: str) -> int:
    """Levenshtein distance of a text to the ``n`` letters of ``masks``, a column at once in the bits of an integer."""
    if not n:
        return len(t)
    full = (1 << n) - 1
    high, pv, mv, score = 1 << (n - 1), full, 0, n
    for c in t:
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 | 1
        pv = (mh << 1 | ~(xv | ph)) & full
        mv = ph & xv & full
    return score


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, a true metric."""
    return _distance(_masks(a), len(a), b)


class BKTree:
    """Entries by their distance to their parent; a query visits only children the triangle inequality allows."""

    def __init__(self, entries):
        self.entries: list[str] = []
        self.children: list[dict[int, int]] = []
        for e in dict.fromkeys(entries):
            self._add(e)

    def _add(self, e: str) -> None:
        at = 0
        masks = _masks(e)
        while self.entries:
            d = _distance(masks, len(e), self.entries[at])
            if d not in self.children[at]:
                self.children[at][d] = len(self.entries)
                break
            at = self.children[at][d]
        self.entries.append(e)
        self.children.append({})

    def within(self, q: str, most: int) -> list[tuple[int, str]]:
        """Every entry within ``most`` edits, nearest first, then in the order of the alphabet."""
        out, todo, masks = [], [0] if self.entries else [], _masks(q)
        while todo:
            at = todo.pop()
            d = _distance(masks, len(q), self.entries[at])
            if d <= most:
                out.append((d, self.entries[at]))
            todo += [c for e, c in self.children[at].items() if d - most <= e <= d + most]
        return sorted(out)


class ShardedTree:
    """One BK-tree for each length of entry: only lengths within the threshold of the query's are searched."""

    def __init__(self, entries):
        by: dict[int, list[str]] = defaultdict(list)
        for e in sorted(set(entries)):
            by[len(e)].append(e)
        self.trees = {n: BKTree(es) for n, es in by.items()}

    def within(self, q: str, most: int) -> list[tuple[int, str]]:
        return sorted(x for n in range(len(q) - most, len(q) + most + 1) if n in self.trees for x in self.trees[n].within(q, most))


def match_values(values: DataFrame, value_col: str, entries: DataFrame, entry_col: str, most: int = 2, shard_entries: int = BROADCAST_ENTRIES, block_values: int = 100_000) -> DataFrame:
    """``(value, entry, distance, candidates)``: for each distinct value its nearest entry, or null beyond ``most``.

    The list is split by hash into shards of about ``shard_entries``, each a BK-tree in a task of its own that meets
    blocks of about ``block_values`` values; winners of the shards are merged by distance, then entry. ``candidates`` counts all
    entries within ``most``. Null values and entries drop out; an empty list leaves all values unmatched.
    """
    n = entries.where(F.col(entry_col).isNotNull()).count()
    shards = max(1, -(-n // shard_entries))
    vals = values.select(F.col(value_col).alias("value")).where("value is not null").distinct()
    refs = entries.select(F.col(entry_col).alias("entry")).where("entry is not null").distinct().withColumn("shard", F.pmod(F.xxhash64("entry"), F.lit(shards)).cast("int"))
    blocks = max(64, -(-vals.count() // block_values))
    spread = vals.withColumn("block", F.pmod(F.xxhash64("value"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    placed = refs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(key, left, right):
        tree = BKTree(sorted(right["entry"]))
        out = []
        for v in left["value"]:
            got = tree.within(v, most)
            if got:
                out.append((v, got[0][1], got[0][0], len(got)))
        return pd.DataFrame(out, columns=["value", "entry", "distance", "candidates"])

    won = spread.groupBy("shard", "block").cogroup(placed.groupBy("shard", "block")).applyInPandas(search, "value string, entry string, distance int, candidates int")
    best = won.groupBy("value").agg(F.min(F.struct("distance", "entry")).alias("b"), F.sum("candidates").alias("candidates"))
    return vals.join(best, "value", "left").select("value", F.col("b.entry").alias("entry"), F.col("b.distance").alias("distance"), F.coalesce("candidates", F.lit(0)).alias("candidates"))


# -- values of several words --------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[^\W\d_]+")
# Words that tell a rank or a form of employment, not a job.
RANKS = frozenset("senior sr junior jr lead deputy chief principal assistant trainee intern level part time full all genders".split())
# Words without a meaning of their own in names of jobs.
FUNCTION = frozenset("of for the in and at a an de del la el los las du des le les l d et en für im bereich und der die das van voor het".split())
# Verbs of the same activity; the first of each line names it.
ACTIVITIES = (
    "archive, file, put on file, store away",
    "count, tally, add up, take stock of",
    "inspect, examine, look over, check",
    "maintain, service, keep in good order, look after",
    "order, purchase, buy, procure",
    "prepare, put together, draft, compile",
    "record, register, log, document",
    "schedule, plan, timetable, arrange",
)
# Words that introduce a task.
LEADS = frozenset("you will we shall must responsible for help helps helping the team to each every all a an of our your and be is are".split())


def tokens(text: str | None) -> list[str]:
    if not text:
        return []
    return _TOKEN.findall(unicodedata.normalize("NFKC", text).lower())


def allowed(word: str) -> int:
    """Edits a word may hold and still be taken for an entry's word."""
    return 0 if len(word) < 4 else 1 if len(word) < 6 else 2


def swapped(word: str) -> set[str]:
    """The word with any two neighbouring letters changed over."""
    return {word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)}


class Corrector:
    """Words corrected to a vocabulary by its BK-tree; what is near nothing is None. Remembers bounded many."""

    def __init__(self, vocabulary):
        self.vocabulary = frozenset(vocabulary)
        self.tree = ShardedTree(self.vocabulary)
        self.memo: dict[str, str | None] = {}

    def __call__(self, word: str) -> str | None:
        if word in self.vocabulary:
            return word
        if word not in self.memo:
            if len(self.memo) > 100_000:
                self.memo.clear()
            # two neighbouring letters changed over are one slip of the hand, and a long word may hold two
            once = swapped(word) if len(word) > 3 else set()
            got = [(1, s) for s in sorted(once & self.vocabulary)] or self.tree.within(word, allowed(word))
            if not got and len(word) > 6:
                got = [(2, s) for s in sorted({t for o in once for t in swapped(o)} & self.vocabulary)]
            if not got and len(word) > 11:  # three slips in a long word, if one word alone is that near
                got = [g for g in self.tree.within(word, 3) if g[1][0] == word[0]]
                got = got if len(got) == 1 else []
            # of words as near, the one of the same first letter and nearest length
            self.memo[word] = min(got, key=lambda g: (g[0], g[1][0] != word[0], abs(len(g[1]) - len(word)), g[1]))[1] if got else None
        return self.memo[word]


class LabelMatcher:
    """Names made of a kind and a field (``battery adviser``), in several languages, mapped to their entries.

    What each word means is read off the list: a word all of whose entries end in the same word of the preferred
    label stands for that kind, one all of whose entries share the rest stands for that field. A value matches if it
    names one kind, and for the field all words of one of its forms in some language.
    """

    def __init__(self, entries: list[tuple[str, str, str | None]]):
        kinds, fields = defaultdict(set), defaultdict(set)
        forms: dict[str, set[frozenset]] = defaultdict(set)
        self.by_parts: dict[tuple[str, str], str] = {}
        labels = []
        for ident, label, alts in sorted(entries):
            words = tokens(label)
            if not words:
                continue
            kind, field = words[-1], " ".join(words[:-1])
            self.by_parts.setdefault((kind, field), ident)
            for form in [label, *(alts or "").split("\n")]:
                ws = tokens(form)
                labels.append((field, ws))
                for w in ws:
                    kinds[w].add(kind)
                    fields[w].add(field)
        self.kind_of = {w: next(iter(k)) for w, k in kinds.items() if len(k) == 1 and (len(fields[w]) > 1 or len(k) == len(fields[w]) == 1 and w in next(iter(k))) and w not in RANKS | FUNCTION}
        self.field_of = {w: next(iter(f)) for w, f in fields.items() if len(f) == 1 and w not in self.kind_of and w not in FUNCTION}
        for field, ws in labels:
            form = frozenset(w for w in ws if w in self.field_of)
            if form:
                forms[field].add(form)
        self.forms = dict(forms)
        self.kinds = sorted({k for k, _ in self.by_parts})
        self.correct = Corrector([*self.kind_of, *self.field_of])
        self.by_form: dict[str, str] = {}
        of_kind: dict[str, list[str]] = defaultdict(list)
        for (kind, field), ident in sorted(self.by_parts.items()):
            for form in [frozenset(field.split()), *sorted(forms.get(field, ()), key=sorted)]:
                text = self._form(kind, form)
                if text not in self.by_form:
                    self.by_form[text] = ident
                    of_kind[kind].append(text)
        self.trees = {k: BKTree(fs) for k, fs in of_kind.items()}
        self.kind_words = ShardedTree(self.kind_of)

    @staticmethod
    def _form(kind: str, words) -> str:
        return f"{kind}: {' '.join(sorted(words))}"

    def _word(self, w: str) -> str | None:
        """The word of the list that ``w`` is: itself, another gender, a misspelling or a short form of a kind."""
        known = self.correct.vocabulary
        if w in known:
            return w
        if w in RANKS:
            return None
        for end, new in (("in", ""), ("innen", ""), ("e", ""), ("a", "o"), ("a", ""), ("trice", "teur"), ("euse", "eur"), ("ère", "er"), ("enne", "en"), ("ne", "")):
            if w.endswith(end) and w[: -len(end)] + new in known:
                return w[: -len(end)] + new
        got = self.correct(w)
        if got is None and w.endswith("in") and len(w) > 6:
            got = self.correct(w[:-2])
        if got is None and 3 <= len(w) <= 6:
            short = [k for k in self.kinds if _short_form(w, k)]
            got = short[0] if len(short) == 1 else None
        return got

    def _kind(self, others: list[str], sure: bool) -> tuple[str, str] | None:
        """``(word, kind)`` of the one kind that a word abbreviates or spells with a slip.

        Beside a field that is ``sure`` any short form with one slip counts, and words of up to three edits.
        """
        got = {}
        for w in others:
            if 3 <= len(w) <= 6:
                forms = swapped(w) | ({w[:i] + w[i + 1 :] for i in range(len(w))} if sure and len(w) > 3 else set())
                for k in self.kinds:
                    longer = sure and any(k.startswith(w[:i] + k[i : i + 1] + w[i:]) for i in range(1, len(w)))
                    if longer or any(len(v) > 2 and v[-1] == k[-1] and _short_form(v, k) and (sure or len(v) * 2 >= len(k)) for v in forms) or sure and any(len(v) > 2 and k.startswith(v) for v in forms):
                        got[k] = w
        if len(got) != 1 and sure:
            near = [(d, self.kind_of[f], w) for w in others if len(w) >= 5 for d, f in self.kind_words.within(w, 3 if len(w) > 6 else 2) if f[0] == w[0] or d < 2]
            least = min(near, default=(0,))[0]
            got = {k: w for d, k, w in near if d == least}
        return next(((w, k) for k, w in got.items()), None) if len(got) == 1 else None

    def _nearest(self, kind: str, words: list[str], sure: bool) -> list[tuple[int, str]]:
        """``(distance, entry)`` of the entries near to a form, the nearest of each; nearer ones of short words where
        the kind is not ``sure``."""
        form = self._form(kind, words)
        if form in self.by_form:
            return [(0, self.by_form[form])]
        n = sum(map(len, words))
        best: dict[str, int] = {}
        for d, f in self.trees[kind].within(form, 3 if sure and n >= 10 else 2 if n >= (5 if sure else 8) else 1 if n >= 4 + (not sure) else 0):
            best[self.by_form[f]] = min(d, best.get(self.by_form[f], d))
        return sorted((d, i) for i, d in best.items())

    def __call__(self, text: str | None) -> str | None:
        kinds, words, known, unknown, exact = Counter(), defaultdict(set), [], [], set()
        for t in tokens(text):
            w = self._word(t) if t not in FUNCTION else None
            if w in self.kind_of:
                kinds[self.kind_of[w]] += 1
                if w == t:
                    exact.add(self.kind_of[w])
            elif w in self.field_of:
                words[self.field_of[w]].add(w)
                known.append((w, t))
            elif t not in FUNCTION | RANKS:
                unknown.append(t)
        full = [f for f, ws in words.items() if any(form <= ws for form in self.forms.get(f, ()))]
        if not kinds and len(full) < 2:
            # words of another field than the one named may be the kind, misread
            misread = [t for w, t in known if w != t and full and self.field_of[w] != full[0]]
            if got := self._kind(unknown + misread, bool(full)):
                kinds[got[1]] += 1
                unknown = [w for w in unknown if w != got[0]]
        # a kind as it is written counts before one that is read into another word
        if len(exact) == 1:
            kinds = Counter(exact)
        if len(kinds) != 1 or len(full) > 1:
            return None
        kind = next(iter(kinds))
        if full:
            return self.by_form.get(self._form(kind, full[0].split()))
        parts = [w for w, _ in known]
        tries = [parts + unknown, *(parts + unknown[:i] + unknown[i + 1 :] for i in range(len(unknown)))]
        got = sorted({x for ws in tries if ws for x in self._nearest(kind, ws, bool(exact))})
        return got[0][1] if got and (len({i for _, i in got}) == 1 or got[0][0] < min(d for d, i in got if i != got[0][1])) else None


def _short_form(w: str, k: str) -> bool:
    """``w`` abbreviates ``k``: its beginning, or some of its letters from the first to the last."""
    if len(w) >= len(k) or w[0] != k[0]:
        return False
    if k.startswith(w):
        return True
    it = iter(k)
    return w[-1] == k[-1] and all(c in it for c in w)


#: A verb phrase known by its first words; the word after them, however it is spelt, belongs to it.
_CUT = (["keep", "in", "good"], ["keeping", "in", "good"])


def _stem(w: str) -> str:
    w = w[:-3] + "y" if w.endswith("ies") else w[:-1] if w.endswith("s") and not w.endswith("ss") else w
    return w[:-1] if w.endswith("e") else w


def _gerund(v: str) -> str:
    head, *rest = v.split()
    head = head[:-1] if head.endswith("e") else head
    return " ".join([head + "ing", *rest])


def _gerunds(v: str) -> set[str]:
    """Forms of a verb phrase: plain, third person, gerund and gerund with a doubled consonant."""
    head, *rest = v.split()
    return {v, _gerund(v), " ".join([head + "s", *rest]), " ".join([head + head[-1] + "ing", *rest])}


class TaskMatcher:
    """Short task sentences mapped to entries with the same activity on the same object.

    The circumstances are read off the list: endings that several entries with different objects share. They, lead-in
    words and numbers are dropped, words are corrected by the BK-tree of all words that count, a verb of any spelling
    becomes its activity and the object becomes its sorted stems. The metric between such forms is the edit distance
    of the objects plus a large constant for different activities; the BK-tree over the entries' forms returns every
    entry within threshold.
    """

    def __init__(self, entries: list[tuple[str, str]], shared: int = 5):
        self.verbs: dict[tuple[str, ...], str] = {}
        for line in ACTIVITIES:
            name, *others = line.split(", ")
            for v in (name, *others):
                for f in _gerunds(v):
                    self.verbs[tuple(f.split())] = name
        self.verbs.update({tuple(c): "maintain" for c in _CUT})
        texts = [(i, tokens(t)) for i, t in sorted(entries)]
        ends = Counter(tuple(t[k:]) for _, t in texts for k in range(2, len(t) - 1))
        self.tails = {e for e, n in ends.items() if n >= shared}
        # only the longest: an ending whose longer form is as frequent is part of it
        self.tails = {e for e in self.tails if not any(len(o) > len(e) and o[-len(e) :] == e and ends[o] == ends[e] for o in self.tails)}
        vocabulary = set(LEADS) | {w for v in self.verbs for w in v} | {w for _, t in texts for w in t} | {"per", "month"}
        circumstances = {w for e in self.tails for w in e}
        vocabulary |= {w[:-1] for _, t in texts for w in t if w.endswith("s") and len(w) > 4 and w not in circumstances}
        self.correct = Corrector(vocabulary)
        self.by_form: dict[str, str] = {}
        for i, t in texts:
            form = self.form(" ".join(t))
            if form:
                self.by_form.setdefault(form, i)
        self.trees: dict[str, BKTree] = {}
        forms = defaultdict(list)
        for f in self.by_form:
            forms[f.split(":", 1)[0]].append(f)
        self.trees = {a: BKTree(sorted(fs)) for a, fs in forms.items()}

    def form(self, text: str | None) -> str | None:
        """``activity:sorted stems of the object``; None without an activity or object."""
        # a colon one letter early still ends a word
        ws = [self.correct(w) or w for w in tokens(re.sub(r"(?<=\w):(?=\w\s)", "", text or ""))]
        ws = [w for i, w in enumerate(ws) if not (w == "per" and ws[i + 1 : i + 2] == ["month"] or w == "month" and ws[i - 1 : i] == ["per"])]
        for tail in sorted(self.tails, key=lambda t: (-len(t), t)):
            n = len(tail)
            for i in range(len(ws) - n, -1, -1):
                if tuple(ws[i : i + n]) == tail:
                    del ws[i : i + n]
        best = None
        for n in (4, 3, 2, 1):
            at = [i for i in range(len(ws) - n + 1) if tuple(ws[i : i + n]) in self.verbs]
            if at:
                # the verb stands first or last; inside an object the same word is no verb
                body = [i for i, w in enumerate(ws) if w not in LEADS or any(i - k in at for k in range(n))]
                edge = [i for i in at if i == body[0] or i + n - 1 == body[-1]]
                if edge:
                    best = (edge[0], n)
                    break
        if best is None:
            return None
        i, n = best
        activity = self.verbs[tuple(ws[i : i + n])]
        n += ws[i : i + n] in _CUT and i + n < len(ws)
        rest = [w for w in ws[:i] + ws[i + n :] if w not in LEADS]
        return f"{activity}:{' '.join(sorted(map(_stem, rest)))}" if rest else None

    def __call__(self, text: str | None) -> str | None:
        form = self.form(text)
        if form is None:
            return None
        if form in self.by_form:
            return self.by_form[form]
        tree = self.trees.get(form.split(":", 1)[0])
        got = tree.within(form, 2) if tree else []
        return self.by_form[got[0][1]] if got and (len(got) == 1 or got[0][0] < got[1][0]) else None


def mapped(df: DataFrame, id_col: str, value_col: str, matcher, field: str) -> DataFrame:
    """``(field_name, record_id, reference_id)``, one row an id; 'none' where no entry covers any of its values.

    ``matcher`` holds the bounded reference list and travels to every task. Of several values of an id the matched
    ones win, then the smallest reference id. Null ids and values give no row.
    """
    b = df.sparkSession.sparkContext.broadcast(matcher)

    @F.pandas_udf("string")
    def match(s: pd.Series) -> pd.Series:
        memo = {v: b.value(v) for v in s.unique()}
        return s.map(memo)

    rows = df.select(F.col(id_col).alias("record_id"), F.col(value_col).alias("v")).where("record_id is not null and v is not null")
    ref = rows.select("record_id", match("v").alias("r")).groupBy("record_id").agg(F.min("r").alias("r"))
    return ref.select(F.lit(field).alias("field_name"), "record_id", F.coalesce("r", F.lit("none")).alias("reference_id"))


def entries_of(df: DataFrame, *cols: str) -> list[tuple]:
    """The reference list on the driver, after a check of its size."""
    got = df.select(*cols).limit(BROADCAST_ENTRIES + 1).collect()
    if len(got) > BROADCAST_ENTRIES:
        raise ValueError(f"the list has more than {BROADCAST_ENTRIES} entries: match it by match_values, shard by shard")
    return [tuple(r) for r in got]
