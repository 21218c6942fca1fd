"""Text functions: column expressions where the JVM has them, Arrow UDFs where it has not (NFKC, entities, offsets)."""

from __future__ import annotations

import difflib
import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no content in statements.
STOPWORDS = tuple(
    """a an the and or of to for in on with by at from as is are be been being this that these those
our your their its it we you they will would can could should may must including include includes such
other others all any each within across into via using use used per etc e g i ie able ability strong
good excellent proven solid working work knowledge experience skills skill understanding related
responsible responsibility responsibilities duties tasks help ensure well both new""".split()
)
# Suffixes cut from a word that keeps more than three letters, the first that fits.
SUFFIXES = ("ations", "ation", "ments", "ment", "ings", "ing", "ies", "ied", "ers", "er", "ed", "es", "s", "al", "ly")
# Levels named by words of a title; the first rule that fits.
TITLE_LEVELS = (
    ("intern_student", r"\b(intern|internship|praktikum|praktikant\w*|werkstudent\w*|working student|student)\b"),
    ("executive", r"\b(chief|vp|vice president|cxo|ceo|cto|cfo|coo|commissioner|executive director|geschäftsführ\w*)\b"),
    ("manager", r"\b(director|head of|leiter\w*|leitung)\b"),
    ("manager", r"\b(manager|supervisor|team lead|teamleiter\w*)\b"),
    ("senior", r"\b(senior|sr\.?|principal|staff|lead|expert)\b"),
    ("entry", r"\b(junior|jr\.?|entry[- ]level|graduate|trainee|associate|assistant|einsteiger\w*)\b"),
)
# The order of the levels, lowest first.
LEVELS = ("intern_student", "entry", "experienced", "senior", "manager", "executive")
# Formats of dates, tried in this order.
DATE_FORMATS = ("MM/dd/yyyy", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd")
# Typographic signs and their plain forms.
PLAIN_SIGNS = str.maketrans({"’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-", " ": " ", "•": " "})

_TAG = re.compile(r"</?[a-zA-Z][a-zA-Z0-9]*(?:\s[^<>]*)?/?>")
_HIDDEN = re.compile(r"<(script|style)\b[^>]*>.*?</\1>|<!--.*?-->", re.S | re.I)


def plain_text(text: str | None, passes: int = 6) -> str | None:
    """Text without tags and entities, however often they were escaped; NFC, one space between words, at most one
    empty line between paragraphs; None when nothing is left."""
    if text is None:
        return None
    for _ in range(passes):
        bare = _TAG.sub("\n", _HIDDEN.sub("\n", text)) if "<" in text else text
        done = html.unescape(bare) if "&" in bare else bare
        if done == text:
            break
        text = done
    text = unicodedata.normalize("NFC", text).replace("\r\n", "\n").replace("\r", "\n")
    lines = (" ".join(re.split(r"[ \t  -​]+", line)).strip() for line in text.split("\n"))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip() or None


def _mapped(f):
    def run(s: pd.Series) -> pd.Series:
        return s.map(f)

    return run


def arrow(kind: str, f):
    """A column function from a Python function of one value, run over Arrow batches; made at its first use."""
    made = []

    def column(*cols):
        if not made:
            made.append(F.pandas_udf(_mapped(f), kind))
        return made[0](*cols)

    return column


_plain = arrow("string", plain_text)
_nfkc = arrow("string", lambda t: unicodedata.normalize("NFKC", t) if t is not None else None)
_nfkd = arrow("string", lambda t: unicodedata.normalize("NFKD", t) if t is not None else None)
ASCII_ONLY = r"^[\x00-\x7F]*$"


def clean(c: Column) -> Column:
    """``plain_text``; texts without a tag, entity or non-ASCII letter never leave the JVM."""
    simple = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(c, r"\r\n?", "\n")), r"(?m)^[ \t]+|[ \t]+$", ""), r"[ \t]+", " ")
    simple = F.nullif(F.trim(F.regexp_replace(simple, r"\n{3,}", "\n\n")), F.lit(""))
    return F.when(c.rlike(ASCII_ONLY) & ~c.rlike("[<&]"), simple).otherwise(_plain(c))


def nfkc(c: Column) -> Column:
    return F.when(c.rlike(ASCII_ONLY), c).otherwise(_nfkc(c))


def normal_title(c: Column) -> Column:
    """A title in NFKC and lower case without gender tags and punctuation other than ``- / & + # .``."""
    tags = r"\(\s*(?:[mwdfxi]\s*[/|,]\s*){1,3}[mwdfxi]\s*\)|\(\s*all genders?\s*\)|\(\s*gn\*?\s*\)"
    loose = r"(?<!\w)(?:m/w/d|w/m/d|m/f/d|f/m/d|f/m/x|m/w/x|all genders)(?!\w)"
    t = F.lower(nfkc(c))
    for p in (tags, "(?U)" + loose, r"(?U)[^\w\s\-/&+#.]", r"(?U)\s+"):
        t = F.regexp_replace(t, p, " ")
    return F.nullif(F.regexp_replace(t, r"^[ \-/]+|[ \-/]+$", ""), F.lit(""))


def dup_key(*cols: Column, sep: str = "|") -> Column:
    """Letters a-z and digits of the lower-cased NFKD forms, joined; null counts as empty."""
    one = lambda c: F.regexp_replace(F.when(c.rlike(ASCII_ONLY), F.lower(c)).otherwise(_nfkd(F.lower(c))), "[^a-z0-9]+", "")
    return F.concat_ws(sep, *[F.coalesce(one(c), F.lit("")) for c in cols])


def ascii_key(*cols: Column, sep: str = "|") -> Column:
    """``dup_key`` without the decomposition: other letters are dropped, all inside the JVM."""
    return F.concat_ws(sep, *[F.coalesce(F.regexp_replace(F.lower(c), "[^a-z0-9]+", ""), F.lit("")) for c in cols])


def hash_id(*cols: Column, n: int = 20, sep: str = "|") -> Column:
    """The first ``n`` hex digits of the SHA-256 of the joined values."""
    return F.substring(F.sha2(F.concat_ws(sep, *cols), 256), 1, n)


def word_count(c: Column) -> Column:
    """Runs of non-blank characters; null for null and blank texts."""
    return F.nullif(F.size(F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")), F.lit(0))


def level_of_title(c: Column, rules=TITLE_LEVELS) -> Column:
    """The level of the first rule that fits the lower-cased title; null if none does."""
    out = None
    for level, pattern in rules:
        hit = F.lower(c).rlike("(?U)" + pattern)
        out = F.when(hit, F.lit(level)) if out is None else out.when(hit, F.lit(level))
    return out


def highest_level(levels: Column) -> Column:
    """Of an array of levels: intern_student if any is, else the highest of LEVELS."""
    order = F.array(*[F.lit(x) for x in LEVELS])
    ranked = F.array_max(F.transform(levels, lambda x: F.array_position(order, x)))
    return F.when(F.array_contains(levels, "intern_student"), F.lit("intern_student")).when(ranked > 0, F.element_at(order, ranked.cast("int")))


def level_and_basis(given: Column, derived: Column) -> Column:
    """Struct of the level and where it comes from."""
    return F.struct(F.coalesce(given, derived).alias("level"), F.when(given.isNotNull(), "source").when(derived.isNotNull(), "title").otherwise("none").alias("basis"))


def first_rule(c: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The name of the first regular expression that fits; for classifiers whose rules are a parameter."""
    out = F
    for name, pattern in rules:
        out = out.when(c.rlike(pattern), F.lit(name))
    return out.otherwise(F.lit(default)) if rules else F.lit(default)


def to_date_any(c: Column) -> Column:
    """The date of the first format that reads the first 26 characters; null where none does."""
    s = F.substring(F.trim(c), 1, 26)
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)).cast("date") for f in DATE_FORMATS])


def epoch_date(c: Column) -> Column:
    return F.timestamp_seconds(c).cast("date")


def number(c: Column) -> Column:
    """A number with thousands commas and dollar signs; null for NaN and what is none."""
    v = F.regexp_replace(c, "[,$]", "").try_cast("double")
    return F.when(~F.isnan(v), v)


def joined_text(*cols: Column, sep: str = "\n\n") -> Column:
    return F.concat_ws(sep, *cols)


def normal_statement(c: Column) -> Column:
    """Quotes and dashes made plain, lower case, one space, no closing punctuation."""
    t = F.translate(c, "’‘“”–— •", "''\"\"--  ")
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(t), r"\s+", " ")), r"^[ .;:,]+|[ .;:,]+$", "")


def content_tokens(c: Column) -> Column:
    """Tokens of letters, digits and ``+#./-`` without stopwords, in order, repeats kept."""
    t = F.lower(F.translate(F.coalesce(c, F.lit("")), "’‘“”–— •", "''\"\"--  "))
    toks = F.transform(F.regexp_extract_all(t, F.lit(r"([a-z0-9][a-z0-9+#./\-]*)"), 1), lambda x: F.regexp_replace(x, r"^[.\-/]+|[.\-/]+$", ""))
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(toks, lambda x: (x != "") & ~F.array_contains(stop, x))


def stem(x: Column) -> Column:
    """``x`` without its first fitting suffix."""
    out = None
    for s in SUFFIXES:
        hit = (F.length(x) > len(s) + 3) & x.endswith(s)
        cut = F.left(x, F.length(x) - len(s))
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return out.otherwise(x)


def stems(c: Column) -> Column:
    return F.transform(content_tokens(c), stem)


def set_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token arrays as sets; 0 where either is empty."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), common / (F.size(a) + F.size(b) - common)).otherwise(F.lit(0.0))


def set_containment(small: Column, big: Column) -> Column:
    small = F.array_distinct(small)
    return F.when(F.size(small) > 0, F.size(F.array_intersect(small, big)) / F.size(small)).otherwise(F.lit(0.0))


def support(statement: Column, evidence: Column) -> Column:
    """Share of the statement's stems found in the evidence's, exactly or by their first five letters."""
    st, ev = stems(statement), stems(evidence)
    near = lambda t: F.exists(ev, lambda e: (e == t) | ((F.length(t) >= 5) & e.startswith(F.left(t, F.lit(5))) & t.startswith(F.left(e, F.lit(5)))))
    return F.when(F.size(st) > 0, F.round(F.size(F.filter(st, near)) / F.size(st), 3)).otherwise(F.lit(0.0))


def section_at(text: Column, pos: Column) -> Column:
    """The last ``[section]`` marker at or before a 0-based place."""
    return F.nullif(F.regexp_extract(F.substr(text, F.lit(1), pos + 1), r"(?s).*\[([A-Za-z_ ]+)\]", 1), F.lit(""))


def scrub(c: Column) -> Column:
    """Credentials replaced: long tokens behind key-like names and bearer headers."""
    return F.regexp_replace(c, r"(?i)((?:api[_-]?key|token|secret|authorization)[\"'=:\s]+(?:bearer\s+)?)[A-Za-z0-9_\-]{12,}", "$1***")


def parsed_json(c: Column, schema: str) -> Column:
    """JSON of an answer that may stand between fences or prose and hold trailing commas; null if it is none."""
    body = F.regexp_extract(c, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.from_json(F.regexp_replace(body, r",(\s*[\]}])", "$1"), schema)


def token_estimate(c: Column) -> Column:
    return F.ceil(F.length(c) / 3.5) + 4


def snake(name: str) -> str:
    """Column names in snake case: camel humps and signs become one underscore."""
    s = re.sub(r"O\*NET", "onet", name)
    s = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", s)
    return re.sub(r"[^A-Za-z0-9]+", "_", s).strip("_").lower()


# -- evidence ---------------------------------------------------------------------------------------------------------

_PIECE = re.compile(r"[^\n.;!?•]+[.;!?]?")


def normal_with_places(s: str) -> tuple[str, list[int]]:
    """Lower-cased text with plain signs and single spaces, and the place in ``s`` of each of its characters."""
    out: list[str] = []
    at: list[int] = []
    for i, ch in enumerate(s.translate(PLAIN_SIGNS)):
        blank = ch.isspace()
        if blank and (not out or out[-1] == " "):
            continue
        low = " " if blank else ch.lower()
        out.append(low)
        at += [i] * len(low)
    return "".join(out), at


def locate(source: str | None, evidence: str | None, least: float = 0.90) -> dict:
    """Where evidence stands in a source: exactly, up to case, signs and blanks, or as a near copy of one sentence.

    Offsets are 0-based and half-open, into the source. Match type ``none`` has no offsets.
    """
    none = {"match_type": "none", "start": None, "end": None, "ratio": None}
    ev = (evidence or "").strip()
    if not source or not ev:
        return none
    at = source.find(ev)
    if at >= 0:
        return {"match_type": "exact", "start": at, "end": at + len(ev), "ratio": 1.0}
    text, places = normal_with_places(source)
    want = normal_with_places(ev)[0].strip(" .;:,")
    if len(want) >= 3 and (at := text.find(want)) >= 0:
        return {"match_type": "normalized", "start": places[at], "end": places[at + len(want) - 1] + 1, "ratio": 1.0}
    best, where = 0.0, None
    for m in _PIECE.finditer(source):
        if abs(len(m.group()) - len(ev)) > max(40, len(ev)):
            continue
        sm = difflib.SequenceMatcher(None, normal_with_places(m.group())[0].strip(" .;:,"), want)
        # the two quick ratios bound the real one from above
        if sm.real_quick_ratio() > best and sm.quick_ratio() > best and (r := sm.ratio()) > best:
            best, where = r, m
    if where is not None and best >= least:
        lead = len(where.group()) - len(where.group().lstrip())
        return {"match_type": "fuzzy", "start": where.start() + lead, "end": where.end(), "ratio": round(best, 3)}
    return none | {"ratio": round(best, 3) if best else None}


LOCATED = "struct<match_type:string,start:int,end:int,ratio:double>"


def _located(source: pd.Series, evidence: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([locate(s, e) for s, e in zip(source, evidence)], columns=["match_type", "start", "end", "ratio"]).astype({"start": "Int32", "end": "Int32", "ratio": "Float64"})


def located(source, evidence) -> Column:
    """``locate`` over two columns, as a struct."""
    return F.pandas_udf(_located, LOCATED)(source, evidence)


def language_by_words(words: Column, common: dict[str, str]) -> Column:
    """The language most of whose frequent words are among ``words``; null without any or with a tie."""
    score = lambda ws: F.size(F.filter(words, lambda x: x.isin(*ws.split())))
    ranked = F.reverse(F.array_sort(F.array(*[F.struct(score(ws).alias("n"), F.lit(lang).alias("l")) for lang, ws in common.items()])))
    first, second = F.element_at(ranked, 1), F.element_at(ranked, 2)
    return F.when((first["n"] > 0) & (first["n"] != second["n"]), first["l"])


def tells_a_count(c: Column, nouns: list[str]) -> Column:
    """Whether a text names a number of one of the nouns."""
    return F.coalesce(F.lower(c).rlike(rf"\b[0-9]+ ({'|'.join(nouns)})\b"), F.lit(False))
