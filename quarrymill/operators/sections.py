"""Sections of documents by their headings, as spans into the untouched text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What headings (lower case, letters only) stand for which section; the first that fits the whole heading.
HEADINGS = (
    ("excluded", r"benefits?|what we offer|why (us|join( us)?|you should work for us)|compensation|salary( range)?|about (us|the company|the agency|the office|the team|the division)|who we are|our (global )?structure|(to|how to) apply|interview process|note|please note|important note|hours(/shift|/schedule)?|work location|additional information|fees|residency|work from home policy|perks|your benefits|equal opportunity|diversity|location|for more information.*|all applicants.*|search for job id.*|click on the job.*|special working conditions|how we work|what success looks like"),
    ("responsibilities", r".*responsibilit.*|.*duties.*|what (you('ll| will)|you would) (do|be doing|own)|your (role|mission|tasks|impact|day)|tasks|the role|about the role|role overview|in this role( you will)?|job description|position summary|the opportunity|deine aufgaben|ihre aufgaben|aufgaben|what you.ll work on"),
    ("preferred_qualifications", r".*nice[- ]?to[- ]?haves?.*|.*preferred.*|bonus( points)?|pluses|it.s a plus.*|wünschenswert"),
    ("skills", r"skills|key skills|technical skills|tech stack|our stack"),
    ("requirements", r"requirements|qualifications|minimum (required )?qualifications|what (you bring|we.re looking for|you.ll bring|makes you a great fit)|who you are|about you|your profile|you|experience|must[- ]haves?|dein profil|ihr profil"),
)
# The order in which sections are worth reading.
PRIORITY = ("responsibilities", "requirements", "skills", "preferred_qualifications", "general_description")

_RULES = [(s, re.compile(p)) for s, p in HEADINGS]
_OWN_LINE = re.compile(r"(?m)^[ \t]*([^\n]{2,70}?)[ \t]*:?[ \t]*$")
_IN_LINE = re.compile(r"(?:(?<=^)|(?<=\n)|(?<=\.\s)|(?<=\s{2}))([A-Z][A-Za-z/&' ,\-]{2,60}):")


def kind_of(heading: str) -> str | None:
    """The section a heading opens; None for long lines and those no rule fits."""
    h = re.sub(r"[^a-zäöüß' /&\-]", " ", heading.lower().replace("’", "'").strip(" :\t-*#"))
    h = " ".join(h.split())
    if not h or len(h) > 60:
        return None
    return next((s for s, p in _RULES if p.fullmatch(h)), None)


def spans(text: str | None) -> list[tuple[str, int, int, str]]:
    """``(section, start, end, method)`` in order; text before the first heading, or without any, is general."""
    if not text or not text.strip():
        return []
    heads: dict[int, tuple[int, str]] = {}
    for pattern, most in ((_OWN_LINE, 8), (_IN_LINE, 99)):
        for m in pattern.finditer(text):
            kind = kind_of(m.group(1))
            if kind and m.start(1) not in heads and len(m.group(1).split()) <= most:
                heads[m.start(1)] = (m.end(), kind)
    if not heads:
        return [("general_description", 0, len(text), "no_heading")]
    at = sorted(heads)
    out = [("general_description", 0, at[0], "heading_rule")] if text[: at[0]].strip() else []
    for i, h in enumerate(at):
        body, kind = heads[h]
        end = at[i + 1] if i + 1 < len(at) else len(text)
        if text[body:end].strip():
            out.append((kind, body, end, "heading_rule"))
    return out


_TYPE = "array<struct<section:string,start:int,end:int,method:string>>"


def _spans(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [dict(zip(("section", "start", "end", "method"), s)) for s in spans(t)])


def section_spans(text) -> Column:
    """``spans`` over a column, as an array of structs."""
    return F.pandas_udf(_spans, _TYPE)(text)


def detect(df: DataFrame, id_cols: list[str], text: str, fields: dict[str, str] | None = None) -> DataFrame:
    """One row a section: ids, section, start, end, method and origin; ``fields`` maps columns that are sections."""
    rows = df.select(*id_cols, F.explode(section_spans(text)).alias("s")).select(*id_cols, "s.*", F.lit(text).alias("origin"))
    for c, section in (fields or {}).items():
        extra = df.where(F.length(c) > 0).select(*id_cols, F.lit(section).alias("section"), F.lit(0).alias("start"), F.length(c).alias("end"), F.lit("source_field").alias("method"), F.lit(c).alias("origin"))
        rows = rows.unionByName(extra)
    return rows


def _budgeted(texts: pd.Series, most: pd.Series) -> pd.Series:
    def one(parts, cap):
        out, used = [], 0
        for section, text in sorted(((p["section"], p["text"]) for p in parts if p["section"] in PRIORITY), key=lambda p: PRIORITY.index(p[0])):
            room = cap - used
            if room < 200:
                break
            piece = text if len(text) <= room else text[:room].rsplit(" ", 1)[0]
            out.append(f"[{section}]\n{piece}")
            used += len(piece)
        return "\n\n".join(out)

    return pd.Series([one(p, int(m)) for p, m in zip(texts, most)])


def reading_input(parts: Column, most: int) -> Column:
    """Sections for a reader with room for ``most`` characters: by priority, cut at a word, none below 200 of room.

    ``parts`` is an array of (section, text) structs of one document, a bounded number.
    """
    return F.pandas_udf(_budgeted, "string")(parts, F.lit(most))
