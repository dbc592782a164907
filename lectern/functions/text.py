"""Column functions on text: folding, normal forms for matching, snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with a mark and the letters they fold to, one to one.
MARKED = "àáâãäåāăąçćčďèéêëēĕęěìíîïīįłñńňòóôõöøōőŕřśšşťţùúûüūůűýÿźżž"
PLAIN = "aaaaaaaaacccdeeeeeeeeiiiiiilnnnoooooooorrsssttuuuuuuuyyzzz"
assert len(MARKED) == len(PLAIN)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(c: Column) -> Column:
    """Lower case without marks; null stays null. Texts without such letters are spared the slower translation."""
    return F.when(c.rlike("[\u00c0-\u017f]"), F.translate(F.lower(c), MARKED, PLAIN)).otherwise(F.lower(c))


def ascii_lower(c: Column) -> Column:
    """Lower case of the ASCII letters only."""
    return F.translate(c, _UPPER, _LOWER)


def tokens(c: Column) -> Column:
    """Folded runs of letters and digits, in order."""
    return F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def padded(c: Column) -> Column:
    """The tokens as one string, each between single spaces: `` a  b ``. A phrase occurs in it as often as the string `` x  y ``
    does; the empty string where there is no token or the text is null."""
    body = F.trim(F.regexp_replace(fold(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", "  "))
    return F.when(body == "", "").otherwise(F.concat(F.lit(" "), body, F.lit(" ")))


def occurrences(text: Column, needle: str) -> Column:
    """How often a literal occurs, without overlap."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def token_count(p: Column) -> Column:
    """Number of tokens of a padded string."""
    return F.when(p == "", 0).otherwise(occurrences(p, "  ") + 1)


def like_contains(c: Column, needle: str) -> Column:
    """LIKE '%needle%' with ASCII case folding and no wildcards."""
    return F.contains(ascii_lower(c), F.lit(needle.translate(str.maketrans(_UPPER, _LOWER))))


def html_escape(c: Column, quotes: bool = True) -> Column:
    out = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(F.replace(out, F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;")) if quotes else out


def _quoted(term: str) -> str:
    return "".join(ch if ch.isalnum() or ord(ch) > 127 else "\\" + ch for ch in term)


def highlight(c: Column, terms: list[str]) -> Column:
    """HTML-escape, then wrap each distinct term, the longest first, whatever its case."""
    out = html_escape(c)
    for t in sorted(dict.fromkeys(t for t in terms if t), key=lambda t: (-len(t), t)):
        out = F.regexp_replace(out, "(?i)(" + _quoted(t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")) + ")", "<mark>$1</mark>")
    return out


def snippet(text: Column, rest: Column, terms: list[str], before: int = 60, size: int = 220) -> Column:
    """A window around the first term that occurs (in the order of the terms), highlighted; ``rest`` where the text is empty."""
    low = F.lower(text)
    at = F.lit(0)
    for t in reversed(terms):
        found = F.locate(t.lower(), low)
        at = F.when(found > 0, found).otherwise(at)
    start = F.greatest(at - 1 - before, F.lit(0))
    cut = F.concat(F.when(start > 0, "… ").otherwise(""), F.substring(text, start + 1, F.lit(size)))
    return F.when(F.coalesce(text, F.lit("")) == "", highlight(F.coalesce(rest, F.lit("")), terms)).otherwise(highlight(cut, terms))
