"""Columns over text: lines, hashes, identifiers, keywords, slugs, complexity, vectors."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

#: Fixed value: keywords and signs that branch, in the subset of patterns that all engines know.
BRANCHES = r"\b(?:if|elif|elsif|else\s+if|for|foreach|while|until|unless|case|when|match|catch|rescue|except)\b|&&|\|\|"
TERNARY = r"(?<![?:])\?(?![?.:])"


def line_count(content: Column) -> Column:
    return F.when(content == "", 0).otherwise(F.size(F.split(content, "\n")))


def short_hash(s: Column, n: int = 8) -> Column:
    return F.substring(F.sha1(s), 1, n)


def _plain(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFKD", c) if not "\u0300" <= x <= "\u036f")


def _fold_tables() -> tuple[str, str, list[tuple[str, str]]]:
    """By rule: letters that fold to one, then the marks, which fold to none; and letters that fold to several."""
    letters = [(c, p) for i in range(0x80, 0x2E80) if (p := _plain(c := chr(i))) != c]
    ligatures = [(c, p) for i in range(0x80, 0xFB07) if not 0xD800 <= i < 0xE000 and unicodedata.category(c := chr(i)) in ("Lu", "Ll", "Lt") and (p := _plain(c)).isascii() and len(p) > 1]
    one = [(c, p) for c, p in letters if len(p) == 1]
    marks = "".join(chr(i) for i in range(0x300, 0x370))
    return "".join(c for c, _ in one) + marks, "".join(p for _, p in one), ligatures


FROM, TO, _LIGATURES = _fold_tables()


def folded(s: Column) -> Column:
    """Letters without their marks, compatibility letters as plain ones. ASCII texts are left alone."""
    out = F.translate(s, FROM, TO)
    for c, p in _LIGATURES:
        out = F.replace(out, F.lit(c), F.lit(p))
    return F.when(s.rlike(r"[^\x00-\x7F]"), F.when(s.rlike("[" + "".join(c for c, _ in _LIGATURES) + "]"), out).otherwise(F.translate(s, FROM, TO))).otherwise(s)


#: Where a word has parts other than itself: between letters, at an underline, at capitals.
_INNER = r"[A-Za-z0-9][^A-Za-z0-9]+[A-Za-z0-9]|_|[a-z0-9][A-Z]|[A-Z]{2}[a-z]"


_SIGNS = "".join(c for c in map(chr, range(1, 128)) if not (c.isalnum() or c == "_"))


def _parts(raw: Column) -> Column:
    f = folded(raw)
    apart = F.regexp_replace(F.regexp_replace(f, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    low = F.lower(f)
    bare = F.when(low.rlike(r"[^\x01-\x7F]"), F.regexp_replace(low, "[^a-z0-9_]+", "")).otherwise(F.translate(low, _SIGNS, ""))
    whole = F.when(~F.trim(raw).rlike(r"\s"), bare).otherwise("")
    several = F.array_distinct(F.concat(F.array(whole), F.split(F.lower(apart), "[^a-z0-9]+")))
    # most words have one part, which splitting finds without a replacement
    return F.when(f.rlike(_INNER), several).otherwise(F.split(F.lower(f), "[^a-z0-9]+"))


def subtokens(raw: Column) -> Column:
    """Lower-case parts of an identifier and itself, without marks, of two letters at least, in order and once each."""
    return F.filter(_parts(raw), lambda t: F.length(t) >= 2)


def exploded_subtokens(raw: Column) -> Column:
    """As ``subtokens``, for explode: short parts are still in it, so that no lambda keeps it out of generated code."""
    return _parts(raw)


def keywords(question: str) -> list[str]:
    text = _plain(question)
    out: dict[str, str] = {}
    word = ""
    for c in text + " ":
        if c.isascii() and (c.isalnum() or c == "_"):
            word += c
        else:
            if len(word) >= 2 and word.lower() not in K.STOPWORDS:
                out.setdefault(word.lower(), word)
            word = ""
    return list(out.values())


def keyword_weight(word: Column) -> Column:
    """How distinctive a keyword is: digits, mixed case, underscores and length count. The weights are fixed values."""
    mixed = word.rlike("[A-Z]") & ~word.rlike("^[A-Z0-9]+$")
    size = F.when(F.length(word) >= 8, 1.5).when(F.length(word) >= 5, 0.5).otherwise(0.0)
    return F.when(word.rlike("[0-9]"), 3.0).otherwise(0.0) + F.when(mixed, 2.0).otherwise(0.0) + F.when(word.contains("_"), 2.0).otherwise(0.0) + size


def slug(s: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(s), "^https?://", ""), "^git@", ""), r"\.git$", "")
    return F.substring(F.regexp_replace(F.regexp_replace(s, "[^a-z0-9._-]+", "-"), "^-+|-+$", ""), 1, 120)


def clip(s: Column, most: int) -> Column:
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.substring(s, 1, most), F.lit("\n… [truncated "), (F.length(s) - most).cast("string"), F.lit(" chars]")))


def distinctive(name: Column) -> Column:
    return (F.length(name) >= 5) & name.rlike("[a-z][A-Z]|[A-Z]{2}|_|[0-9]")


def complexity(source: Column, ternary: bool = True) -> Column:
    return F.lit(1) + F.regexp_count(source, F.lit(BRANCHES + ("|" + TERNARY if ternary else "")))


def body(content: Column, line: Column, end_line: Column) -> Column:
    return F.array_join(F.slice(F.split(content, "\n"), line, F.coalesce(end_line, line) - line + 1), "\n")


def trigrams(term: Column) -> Column:
    """The distinct runs of three letters of a term with two marks at each end."""
    p = F.concat(F.lit("^^"), term, F.lit("$$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: p.substr(i, F.lit(3))))


def quantised(v: Column) -> Column:
    """A vector of unit length in 8-bit steps, halves to even; a zero vector stays zero."""
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    step = lambda x: F.greatest(F.lit(-K.QUANTUM), F.least(F.lit(K.QUANTUM), F.rint(x / norm * K.QUANTUM).cast("int")))
    return F.when(norm == 0, F.transform(d, lambda _: F.lit(0))).otherwise(F.transform(d, step))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("bigint") * y), F.lit(0).cast("bigint"), lambda s, x: s + x)
