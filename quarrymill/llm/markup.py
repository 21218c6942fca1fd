"""Markup residue: which kinds a text holds, and the clean text with its structure kept."""

from __future__ import annotations

import html
import re
from html.entities import html5

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML element names.
_TAGS = (
    "a abbr address article aside b big blockquote body br button caption center cite code col dd del details div dl dt em "
    "figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark meta nav "
    "noscript ol option p param pre q s samp script section select small span strike strong style sub sup svg table tbody td "
    "template textarea tfoot th thead time title tr tt u ul var video wbr"
)
# LaTeX commands that stand without an argument in braces.
_COMMANDS = "item hline newline linebreak par noindent centering maketitle large Large small tiny bf it em sum prod int frac cdot times leq geq neq approx pm infty alpha beta gamma delta eta theta lambda mu sigma omega quad ldots dots"

TAG = re.compile(r"<!--.*?(?:-->|$)|<!DOCTYPE[^>]*>|</?(?:%s)(?:\s[^<>]*)?/?>" % "|".join(_TAGS.split()), re.I | re.S)
REFERENCE = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|([A-Za-z][A-Za-z0-9]{1,30}));")
MARKDOWN = re.compile(
    r"(?m)^ {0,3}#{1,6} +\S"  # heading
    r"|^ {0,3}\S[^\n]*\n={3,}[ \t]*$"  # underlined heading
    r"|^ {0,3}(?:```|~~~)"  # fence
    r"|(?<!`)`(?!`)[^`\n]+`(?!`)"  # code
    r"|!?\[[^\[\]\n]*\]\([^()\s]+(?: \"[^\"\n]*\")?\)"  # link, image
    r"|(?<![\w*])\*\*(?=[^\s*])[^\n]{0,400}?(?<=[^\s*])\*\*"  # strong
    r"|(?<![\w_])__(?=[^\s_])[^\n]{0,400}?(?<=[^\s_])__(?![\w_])"
    r"|(?<![\w*\\])\*(?=[^\s*])[^*\n]{1,200}(?<=[^\s*])\*(?![\w*])"  # emphasis
    r"|(?<![\w_\\$])_(?=[^\s_])[^_\n]{1,200}(?<=[^\s_])_(?![\w_$])"
    r"|~~(?=\S)[^~\n]+~~"
    r"|^ {0,3}\|?(?: *:?-{3,}:? *\|)+ *(?::?-{3,}:? *)?$"  # table
)
WIKI = re.compile(
    r"(?<!')'''?(?=[^'\s])[^\n]{1,400}?(?<=[^'\s])'''?(?!')"
    r"|\[\[[^\[\]\n]+\]\]|\{\{[^{}]+\}\}"
    r"|(?m:^ *={2,6} *[^=\s][^\n]*? *={2,6} *$)"
    r"|(?m:^ *\{\||^ *\|\} *$|^ *\|- *$)"
    r"|\[(?:https?|ftp)://[^\s\]]+ +[^\]\n]+\]|<ref[ >/]|</ref>|<nowiki>|__(?:NO)?TOC__"
)
LATEX = re.compile(
    r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{"
    r"|\\(?:%s)(?![A-Za-z])"
    r"|\{\\[A-Za-z]+[ }]"
    r"|\\\[.+?\\\]|\\\(.+?\\\)|(?m:\\\\ *$)"
    r"|\$\$[^$]+\$\$|\$(?![\s\d])(?=[^$\n]*(?:\\[A-Za-z]|[A-Za-z0-9}][_^][A-Za-z0-9{]))[^$\n]+(?<!\s)\$" % "|".join(_COMMANDS.split()),
    re.S,
)
#: A text without any of these characters holds no markup; the scan of the table tests it inside the JVM.
HINT = r"[<&*_`#\[{\\'=~|$]"
KINDS = ("html", "markdown", "wiki", "latex")


def unescape(text: str, most: int = 8) -> str:
    """Character references resolved until nothing changes; unknown names stay."""
    for _ in range(most):
        new = html.unescape(text) if "&" in text else text
        if new == text:
            break
        text = new
    return text


def kinds(text: str | None) -> list[str]:
    """The kinds of markup in ``text``, in the order of KINDS; none for null, empty and plain texts."""
    if not text:
        return []
    plain = unescape(text)
    refs = any(not m.group(1) or m.group(1) + ";" in html5 for m in REFERENCE.finditer(text))
    found = [refs or bool(TAG.search(plain))]
    found += [bool(p.search(plain)) for p in (MARKDOWN, WIKI, LATEX)]
    return [k for k, f in zip(KINDS, found) if f]


def residue(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """``(id, field_name, markup)``: one row for each kind of markup in each field, over all rows of an id.

    Null ids and texts give no row. Texts of any length are scanned whole.
    """
    long = df.select(F.col(id_col), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields])).alias("x"))
    hinted = long.select(id_col, "x.field_name", "x.text").where(F.col(id_col).isNotNull() & F.col("text").rlike(HINT))

    @F.pandas_udf("array<string>")
    def scan(s: pd.Series) -> pd.Series:
        return s.map(kinds)

    return hinted.select(id_col, "field_name", F.explode(scan("text")).alias("markup")).distinct()


_BLOCK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|caption|dd|div|dl|dt|figure|footer|form|head|header|hr|html|main|nav|ol|p|section|table|tbody|tfoot|thead|title|ul)(?:\s[^<>]*)?/?>", re.I)
_STEPS = [  # in this order: (pattern, what takes its place)
    (re.compile(r"<!--.*?(?:-->|$)|<(script|style)\b[^>]*>.*?</\1>", re.S | re.I), " "),
    (re.compile(r"<pre\b[^>]*>(?:\s*<code\b[^>]*>)?(.*?)(?:</code>\s*)?</pre>", re.S | re.I), "\n```\n\\1\n```\n"),
    (re.compile(r"\\begin\{(?:verbatim|lstlisting)\}(.*?)\\end\{(?:verbatim|lstlisting)\}", re.S), "\n```\\1```\n"),
    (re.compile(r"\\begin\{(?:equation|align|displaymath)\*?\}(.*?)\\end\{(?:equation|align|displaymath)\*?\}", re.S), "\n$\\1$\n"),
    (re.compile(r"\\\[(.+?)\\\]|\\\((.+?)\\\)", re.S), lambda m: f" ${(m.group(1) or m.group(2)).strip()}$ "),
    (re.compile(r"<h([1-6])\b[^>]*>(.*?)(?:</h\1>|$)", re.S | re.I), lambda m: "\n\n" + "#" * int(m.group(1)) + " " + m.group(2).strip() + "\n\n"),
    (re.compile(r"(?m)^ *(={2,6}) *([^=\n]+?) *={2,6} *$"), lambda m: "\n" + "#" * len(m.group(1)) + " " + m.group(2) + "\n"),
    (re.compile(r"(?m)^(\S[^\n]*)\n={3,}[ \t]*$"), "# \\1\n"),
    (re.compile(r"\\(sub)?(sub)?section\*?\{([^{}]*)\}"), lambda m: "\n" + "#" * (1 + bool(m.group(1)) + bool(m.group(2))) + " " + m.group(3) + "\n"),
    (re.compile(r"<li\b[^>]*>", re.I), "\n- "),
    (re.compile(r"(?m)^ *\\item\b *"), "- "),
    (re.compile(r"(?m)^ *[*#]{1,4} +(?=\S)(?<!\n#)"), lambda m: m.group(0) if m.group(0).lstrip().startswith("#") and "*" not in m.group(0) else "- "),
    (re.compile(r"</t[dh]>\s*<t[dh]\b[^>]*>", re.I), " | "),
    (re.compile(r"</?tr\b[^>]*>", re.I), "\n"),
    (re.compile(r"(?m)^ *\{\|.*$|^ *\|\} *$|^ *\|- *$|^ *\|?(?: *:?-{3,}:? *\|)+ *$"), ""),
    (re.compile(r"(?m)^ *[!|](?!\|) *(.*?)(?: *\|)? *$"), lambda m: re.sub(r" *(?:\|\||!!|\|) *", " | ", m.group(1))),
    (_BLOCK, "\n"),
    (TAG, ""),
    (re.compile(r"!?\[([^\[\]\n]*)\]\([^()\s]+(?: \"[^\"\n]*\")?\)"), "\\1"),
    (re.compile(r"\[\[(?:Category|File|Image):[^\[\]\n]*\]\]", re.I), ""),
    (re.compile(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]+)\]\]"), "\\1"),
    (re.compile(r"\[(?:https?|ftp)://[^\s\]]+ +([^\]\n]+)\]"), "\\1"),
    (re.compile(r"\{\{[^{}]*\}\}"), ""),
    (re.compile(r"'''''|'''|(?<!')''(?!')"), ""),
    (re.compile(r"~?\\(?:cite|ref|label|footnote)\{[^{}]*\}"), ""),
    (re.compile(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?"), ""),
    (re.compile(r"\{\\[A-Za-z]+ +([^{}]*)\}"), "\\1"),
    (re.compile(r"\\(?:textbf|textit|emph|underline|texttt|text)\{([^{}]*)\}"), "\\1"),
    (re.compile(r"\\\\ *(?=\n|$)"), ""),
    (re.compile(r"\*\*(?=[^\s*])([^\n]{0,400}?)(?<=[^\s*])\*\*|(?<!\w)__(?=[^\s_])([^\n]{0,400}?)(?<=[^\s_])__(?!\w)|~~(?=\S)([^~\n]+)~~"), lambda m: m.group(1) or m.group(2) or m.group(3) or ""),
    (re.compile(r"(?<!`)`([^`\n]+)`(?!`)"), "\\1"),
    (re.compile(r"[ \t\u00a0]+"), " "),
    (re.compile(r" *\n *"), "\n"),
    (re.compile(r"\n{3,}"), "\n\n"),
]


def clean(text: str | None) -> str | None:
    """Plain text with headings as ``#`` lines, lists as ``-`` lines, code between fences, table cells split by
    `` | `` and formulas between dollars. Null stays null; a text of markup alone becomes empty."""
    if text is None:
        return None
    out = unescape(text)
    for pattern, to in _STEPS:
        out = pattern.sub(to, out)
    return out.strip()


def cleaned(df: DataFrame, id_cols: list[str], fields: list[str]) -> DataFrame:
    """``df``'s id columns with ``<field>_clean`` and counts of the structure kept in it, one row a row."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(clean)

    out = df.select(*id_cols, *[F.when(F.col(f).rlike(HINT), run(f)).otherwise(F.trim(f)).alias(f + "_clean") for f in fields])
    body = F.col(fields[-1] + "_clean")
    count = lambda p: F.coalesce(F.regexp_count(body, F.lit(p)), F.lit(0))
    return out.withColumns({"headings": count(r"(?m)^#{1,6} "), "list_items": count(r"(?m)^- "), "code_blocks": (count(r"(?m)^```") / 2).cast("int"), "table_rows": count(r"(?m)^[^\n]* \| "), "formulas": (count(r"\$") / 2).cast("int")})
