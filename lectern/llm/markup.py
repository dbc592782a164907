"""Markup residue in text documents (problem 5).

Method: a linear-chain conditional random field over the leaves of a document's tree, trained on labelled pages and decoded by Viterbi.

* *Leaves.* A lexer cuts a document into leaves: every place that could be markup of some language (an angle-bracketed run, a run
  of asterisks, a backslash word, a dollar pair, a line of dashes, a pipe, ...) and the plain text between them. It doesn't judge:
  prices, paths, comparisons and names with underscores give the same kinds of leaves.
* *Tree.* HTML elements, code fences, TeX environments, wiki tables and templates that are open at a leaf are its ancestors.
* *Features.* Shape, neighbouring characters, attributes, contents, place in the line, partner of a delimiter, ancestors.
* *Labels.* ``text``, ``code`` or language and role (``wiki:link``). The labels alone tell which languages a document holds
  and how its clean text is made; no pattern is asked afterwards.

The labelled pages are written by a seeded generator (``training_pages``) that knows the label of every piece it writes; the number
of pages and the rounds of training are parameters. ``tests/llm`` measures the model on other pages and on lines labelled by hand.

Null texts give no row; empty ones hold no markup. Clean text keeps headings as ``#`` lines, list items as ``-``, code in fences,
formulas in ``$``, and tables as cells parted by `` | ``. Line ends become ``\\n``.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from html.entities import html5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.crf import CRF, Chains

LANGS = ("html", "markdown", "wiki", "latex")
#: The elements of HTML, current and obsolete.
_ELEMENTS = frozenset(
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo big blockquote body br button canvas caption center "
    "cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form "
    "frame frameset h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark math menu meta "
    "meter nav noframes noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp script section select "
    "small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u "
    "ul var video wbr".split()
)
#: Elements without an end tag.
_VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())

# What can be markup. Alternatives are tried in this order at each place; each is linear in the length of what it reads.
_MARK = re.compile(
    r"""
    ^(?=[ \t]*[`~=\-|{*+0-9\#>!\[])(?:
    (?P<fence>^\ {0,3}(?:`{3,}[^`\n]*|~{3,}[^\n]*)$)
  | (?P<under>^(?:={2,}|-{2,})[ \t]*$)
  | (?P<rule>^[ \t]*\|?[ \t]*:?-+:?[ \t]*\|[-:| \t]*$)
  | (?P<wtab>^[ \t]*(?:\{\|[^\n]*|\|\}|\|-[^|\n]*$))
  | (?P<task>^[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]+\[[ xX]\](?=[ \t]))
  | (?P<atx>^\ {0,3}\#{1,6}(?=[ \t]+\S))
  | (?P<quote>^\ {0,3}>(?:\ ?>)*)
  | (?P<whead>^={1,6}(?=[^=\n]))
  | (?P<bang>^!(?=[ \t]))
  | (?P<refdef>^\ {0,3}\[[^\]\n]+\]:[ \t]+\S+)
  )
  | (?=[<&$\\`!\[{}*_~'=\#|])(?:
    (?P<comment><!--(?:[^-]|-(?!->))*-->|<!--)
  | (?P<decl><![A-Za-z][^<>]*>)
  | (?P<auto><[a-z]{2,9}:[^<>\s]+>|<[^<>\s@]+@[^<>\s@]+>)
  | (?P<tag></?[A-Za-z][A-Za-z0-9:_-]*(?:[\s/][^<>]*)?>)
  | (?P<ref>&(?:amp;)*(?:[A-Za-z][A-Za-z0-9]{1,30}|\#\d{1,7}|\#[xX][0-9a-fA-F]{1,6});)
  | (?P<display>\$\$(?:[^$<]|<(?![A-Za-z/!]))+\$\$|\\\[(?:[^\\\n<]|\\(?!\])|\n(?!\n)|<(?![A-Za-z/!]))*\\\])
  | (?P<dollar>\$(?:[^$\n<]|<(?![A-Za-z/!]))+\$)
  | (?P<paren>\\\((?:[^\\\n<]|\\(?!\))|<(?![A-Za-z/!]))*\\\))
  | (?P<env>\\(?:begin|end)[ \t]*\{[^{}\n]*\}(?:\{[^{}\n]*\}|\[[^\]\n]*\])*)
  | (?P<break>\\\\(?=[ \t]*$|[ \t]*\[))
  | (?P<cmd>\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})*\{?)
  | (?P<tick>(?<!`)(?P<ticks>`+)(?!`)[^`\n]+(?P=ticks)(?!`))
  | (?P<link>!?\[[^\[\]\n]*\](?:\([^()\s]*(?:\([^()\s]*\)[^()\s]*)?(?:[ \t]+"[^"\n]*")?\)|\[[^\[\]\n]*\]))
  | (?P<wlink>\[\[[^\[\]\n]+\]\])
  | (?P<topen>\{\{)
  | (?P<tclose>\}\})
  | (?P<run>\*+|_+|~~+|'{2,5})
  | (?P<wclose>={1,6}[ \t]*$)
  | (?P<hashes>(?<=[ \t])\#+[ \t]*$)
  | (?P<pipe>\|\|?|!!)
  )
    """,
    re.M | re.X,
)
_LINE_ENDS = re.compile("\r\n|[\r\x85\u2028\u2029]")
_BULLET = re.compile(r"(?:[-*+\u2022]|\d{1,9}[.)])[ \t]")
_ATTRS = re.compile(r"(?:\s+[a-zA-Z_:@][-\w:.]*\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=]+))+\s*/?")
_LONG_WORD = re.compile(r"[^\W\d_]{3,}")
_ROWS = {"rule", "pipe"}

LABELS = (
    "text code html:tag html:ref html:comment markdown:heading markdown:em markdown:code markdown:fence markdown:link markdown:quote markdown:task "
    "markdown:table wiki:heading wiki:em wiki:link wiki:template wiki:table latex:command latex:env latex:formula latex:table"
).split()
_AT = {x: i for i, x in enumerate(LABELS)}
_MASK = [next((1 << i for i, g in enumerate(LANGS) if x.startswith(g + ":")), 0) for x in LABELS]


def _kind(c: str) -> str:
    """Class of a character beside a leaf."""
    if not c or c.isspace():
        return "s"
    if c.isdigit():
        return "d"
    if c.isalpha():
        return "c" if "\u3040" <= c <= "\u9fff" or "\uac00" <= c <= "\ud7af" else "a"
    return c if c in "\\$_*:<>{}[]|#~" else "p"


def _inside(x: str) -> str:
    """Class of what stands between two delimiters."""
    if not x.strip():
        return "empty"
    out = "-" if x[0].isspace() or x[-1].isspace() else "+"
    if not any(c.isalpha() for c in x):
        return out + ("digit" if any(c.isdigit() for c in x) else "sign")
    return out + ("many" if len(x) > 200 else "words" if " " in x else "one")


def _formula(x: str) -> str:
    """Class of what stands between two dollars."""
    out = "-" if x[:1].isspace() or x[-1:].isspace() else "+"
    out += "\\" if "\\" in x else ""
    out += "^" if "^" in x or "_" in x else ""
    out += "=" if any(c in x for c in "=+<>*/") else ""
    out += "d" if x[:1].isdigit() else ""
    return out + ("w" if len(_LONG_WORD.findall(x)) > ("\\" in x) + x.count("\\") else "l" if len(x.strip()) == 1 else "")


class Page:
    """The leaves of one document: ``spans`` (start, end), ``shapes`` and ``feats`` (names of features)."""

    def __init__(self, text: str):
        self.text = text = _LINE_ENDS.sub("\n", text)
        self.spans: list[tuple[int, int]] = []
        self.shapes: list[str] = []
        self.feats: list[list[str]] = []
        self.inside: list[tuple[str, ...]] = []
        at = 0
        for m in _MARK.finditer(text):
            s, e = m.span()
            if s > at and not text[at:s].isspace():
                self.spans.append((at, s))
                self.shapes.append("words")
            self.spans.append((s, e))
            self.shapes.append(m.lastgroup)
            at = e
        if at < len(text) and not text[at:].isspace():
            self.spans.append((at, len(text)))
            self.shapes.append("words")
        self._features()

    def _lines(self) -> list[tuple[int, int]]:
        """Start and end of the line in which each leaf starts."""
        text, out, lo, hi = self.text, [], 0, -1
        for s, _ in self.spans:
            if s > hi:
                lo = text.rfind("\n", 0, s) + 1
                hi = text.find("\n", s)
                hi = len(text) if hi < 0 else hi
            out.append((lo, hi))
        return out

    def _partners(self, lines: list[tuple[int, int]]) -> dict[int, int]:
        """Delimiter runs of one line that open and close the same span, both ways."""
        text, out, line = self.text, {}, -1
        open_: dict[str, list[int]] = {}
        for i, ((s, e), shape) in enumerate(zip(self.spans, self.shapes, strict=True)):
            if shape != "run":
                continue
            if lines[i][0] != line:
                line, open_ = lines[i][0], {}
            run = text[s:e]
            waiting = open_.setdefault(run, [])
            if waiting and s and not text[s - 1].isspace() and text[s - 1] not in "([{":
                j = waiting.pop()
                out[i], out[j] = j, i
            elif e < len(text) and not text[e].isspace():
                waiting.append(i)
        return out

    def _features(self) -> None:
        text, spans, shapes = self.text, self.spans, self.shapes
        lines = self._lines()
        partner = self._partners(lines)
        n = len(spans)
        ruled = {lines[i][0] for i in range(n) if shapes[i] == "rule"}
        tabled: set[int] = set()  # lines of pipes above or below a rule
        row = False
        for way in (range(n), range(n - 1, -1, -1)):
            last = None
            for i in way:
                if shapes[i] not in _ROWS:
                    continue
                lo, hi = lines[i]
                near = last is not None and (lo == last[0] or lo == last[1] + 1 or hi + 1 == last[0])
                row = lo in ruled or (row and near)
                if row:
                    tabled.add(lo)
                last = (lo, hi)
            row = False
        heads = {lines[i][0] for i in range(n) if shapes[i] == "whead"}
        closes = {lines[i][0] for i in range(n) if shapes[i] == "wclose"}
        inside: Counter = Counter()
        stack: list[str] = []
        fence = ""

        def open_(x: str) -> None:
            stack.append(x)
            inside[x] += 1

        def close(x: str) -> bool:
            if not inside[x]:
                return False
            while stack:
                y = stack.pop()
                inside[y] -= 1
                if not inside[y]:
                    del inside[y]
                if y == x:
                    break
            return True

        for i, ((s, e), shape) in enumerate(zip(spans, shapes, strict=True)):
            lo, hi = lines[i]
            left, right = _kind(text[s - 1 : s]), _kind(text[e : e + 1])
            raw = text[s:e] if e - s < 400 else text[s : s + 200] + text[e - 200 : e]
            f = ["bias", "s=" + shape]
            if not text[lo:s].strip():
                f.append("first")
            if not text[e:hi].strip():
                f.append("last")
            # a fence hides everything until its end
            shut = False
            if fence and shape == "fence":
                mark = raw.strip()
                if mark[0] == fence[0] and len(mark) >= len(fence) and not mark.strip(mark[0]):
                    shut = True
                    close("fence")
            names = tuple(inside)
            f += ["in:" + x for x in names]
            f += [shape + "^" + x for x in ("fence", "pre", "code", "verbatim", "script", "comment", "wtab", "template", "tabular") if x in inside]
            if shape == "words":
                body = raw.strip()
                f.append("len=" + ("s" if e - s < 60 else "m" if e - s < 400 else "l"))
                if _BULLET.match(body):
                    f.append("bullet")
                if any(c.isalpha() for c in body):
                    f.append("letters")
            elif shape == "fence":
                mark = raw.strip()
                f.append("fence=" + ("end" if shut else "in" if fence else mark[0]))
                if shut:
                    fence = ""
                elif not fence:
                    fence = mark[: len(mark) - len(mark.lstrip(mark[0]))]
                    open_("fence")
            elif shape == "under":
                above = text[text.rfind("\n", 0, max(0, lo - 1)) + 1 : max(0, lo - 1)].strip() if lo else ""
                what = "blank" if not above else "row" if "|" in above else "line" if set(above) <= set("=-") else "list" if _BULLET.match(above) else "words"
                f += ["under=" + what, f"under={what}{text[s]}", f"under={what}{min(3, e - s)}"]
            elif shape in _ROWS:
                body = text[lo:hi].strip()
                ends = body[:1] + body[-1:]
                f.append(f"row={lo in tabled}:{'wtab' in inside}:{'template' in inside}")
                f += [f"row:{shape}:{ends if set(ends) <= set('|:-') else 'x'}", f"row:{lo in tabled}:{raw}"]
            elif shape in ("whead", "wclose"):
                pair = lo in heads and lo in closes
                body = text[lo:hi].strip()
                same = pair and len(body) - len(body.lstrip("=")) == len(body) - len(body.rstrip("="))
                f.append(f"{shape}={pair}:{same}:{min(3, len(raw.strip()))}")
            elif shape == "tag":
                m = re.match(r"</?([A-Za-z][A-Za-z0-9:_-]*)", raw)
                name = m[1].lower()
                rest = raw[m.end() : -1].rstrip("/ \n\t")
                attrs = "none" if not rest.strip() else "kv" if _ATTRS.fullmatch(" " + rest.strip()) else "words" if len(rest.split()) > 1 else "word"
                known = name in _ELEMENTS
                f += [f"tag={known}", f"tag={known}:{attrs}", f"tag={known}:{raw[1] == '/'}:{attrs}", "attrs=" + attrs]
                if known:
                    f.append(f"tag={name if len(name) > 1 else 'letter'}:{attrs}")
                    if raw[1] == "/":
                        f.append(f"tag:shut={close(name)}")
                    elif name not in _VOID and not raw.endswith("/>") and attrs != "words":
                        open_(name)
            elif shape == "ref":
                name = raw[1:-1]
                f.append("ref=" + ("num" if "#" in name else "known" if name.split(";")[-1] + ";" in html5 else "other"))
                f.append(f"ref:{left}")
            elif shape in ("dollar", "paren", "display"):
                body = raw[2:-2] if shape != "dollar" else raw[1:-1]
                what = _formula(body)
                f += [f"{shape}={what}", f"{shape}={left}:{right}", f"{shape}={what}:{right}", f"{shape}={what[0]}:{what[1:].strip('wdl') != ''}"]
                f.append(f"{shape}:{'w' in what}:{'d' in what}")
            elif shape == "env":
                name = raw[raw.index("{") + 1 : raw.index("}")].rstrip("*")
                begin = raw.startswith("\\begin")
                f += ["env", f"env={name}", f"env:{begin}"]
                if begin:
                    open_(name)
                else:
                    close(name)
            elif shape == "cmd":
                m = re.match(r"\\([A-Za-z]+)\*?", raw)
                arg = "{" if "{" in raw else "[" if "[" in raw else "-"
                f += ["cmd=" + m[1], f"cmd:{arg}:{left}", f"cmd:{arg}:{left}:{right}", f"cmd={m[1]}:{arg}:{left in 'a:'}:{right}", f"cmd:arg={arg}"]
            elif shape == "tick":
                f += [f"tick={_inside(raw.strip('`'))}", f"tick:{left}:{right}"]
            elif shape == "link":
                f += [f"link={raw[0] == '!'}:{raw[-1]}", "link:empty" if raw.endswith("()") or raw.endswith("[]") else "link:full", f"link:{left}"]
                inner = raw[raw.index("[") + 1 : raw.index("]")]
                target = raw[raw.index("]") + 2 : -1]
                f.append(f"link:{raw[-1]}:{_inside(inner)}:{'x' if not target.strip() else 'd' if target.isdigit() else 'u' if re.search('[./#]', target) else 'w'}")
            elif shape == "wlink":
                f += [f"wlink={_inside(raw[2:-2])}", f"wlink:{'|' in raw}", f"wlink:{left}:{right}"]
            elif shape == "topen":
                shut_at = text.find("}}", e)
                body = text[e : min(shut_at, e + 60)] if shut_at >= 0 else ""
                f += [f"tpl={shut_at >= 0}:{right}", f"tpl:{'|' in body}:{_inside(body) if body else ''}"]
                if shut_at >= 0 and right in "ac":
                    open_("template")
            elif shape == "tclose":
                f.append(f"tpl={close('template')}")
            elif shape == "wtab":
                mark = raw.strip()[:2]
                f += [f"wtab={mark}", f"wtab={mark}:{'wtab' in inside}", f"wtab:{mark}:{'class' in raw}"]
                if mark == "{|":
                    open_("wtab")
                elif mark == "|}":
                    close("wtab")
            elif shape == "run":
                run = raw[0] + str(min(6, len(raw)))
                if i in partner:
                    j = partner[i]
                    a, b = (i, j) if i < j else (j, i)
                    (s1, e1), (s2, e2) = spans[a], spans[b]
                    what, l, r = _inside(text[e1:s2]), _kind(text[s1 - 1 : s1]), _kind(text[e2 : e2 + 1])
                    f += [f"run={run}:{what}", f"run={run}:{l}:{r}", f"run={run}:{what}:{l}:{r}", f"run={raw[0]}:{what}:{l in 'ad'}:{r in 'ad'}", f"run:{len(raw) > 3}:{l in 'ad' and r in 'ad'}", f"run={raw[0]}:{l in 'ad'}:{r in 'ad'}"]
                else:
                    f += [f"run={run}:alone", f"run={raw[0]}:alone:{left}:{right}", "run:alone"]
            elif shape in ("quote", "task", "atx", "bang", "hashes", "break", "auto", "refdef"):
                f.append(f"{shape}:{right}")
                if shape == "hashes":
                    f.append(f"hashes:{text[lo:hi].lstrip().startswith('#')}")
                if shape == "auto":
                    f.append(f"auto:{'//' in raw}")
                if shape == "bang":
                    f.append(f"bang:{'wtab' in inside}")
            self.feats.append(f)
            self.inside.append(names)


class Model:
    """A trained field with the names of its features."""

    def __init__(self, names: dict[str, int], crf: CRF):
        self.names, self.crf = names, crf

    @staticmethod
    def chains(pages: list[Page], names: dict[str, int]) -> Chains:
        """Leaves with equal features share one row."""
        rows: dict[tuple[str, ...], int] = {}
        at = [rows.setdefault(tuple(f), len(rows)) for p in pages for f in p.feats]
        ids = [[names[x] for x in f if x in names] or [0] for f in rows]
        ends = np.cumsum([len(x) for x in ids]).astype(np.int64) if ids else np.empty(0, np.int64)
        return Chains(np.array([x for row in ids for x in row], np.int64), ends, np.array(at, np.int64), np.array([len(p.spans) for p in pages], np.int64))

    def labels(self, pages: list[Page]) -> list[list[int]]:
        """Label of each leaf of each page."""
        flat = self.crf.decode(self.chains(pages, self.names)).tolist()
        out, at = [], 0
        for p in pages:
            out.append(flat[at : at + len(p.spans)])
            at += len(p.spans)
        return out


# --- labelled pages ---

Piece = tuple[str, str]
#: Names of commands, environments and elements that the pages use.
_CMD_ARG = "textit textbf emph underline texttt textsc footnote caption label ref cite eqref pageref url section subsection chapter paragraph title author usepackage documentclass input includegraphics mbox text".split()
_CMD_BARE = "item maketitle tableofcontents LaTeX TeX ldots dots cdot times leq geq alpha beta gamma delta lambda pi infty hline centering noindent newpage clearpage par bigskip medskip quad qquad toprule midrule bottomrule appendix today bf it em small large textbackslash to in".split()


def training_pages(pages: int, seed: int) -> list[list[Piece]]:
    """Labelled pages as pieces (text, label), which make up the page one after the other."""
    r = random.Random(seed)
    scripts = ["abdegiklmnoprstuvz", "абвгдежиклмнопрст", "日本語書類検索印刷写真記録目次一覧", "äöüéèñçãõabdelnrst"]
    latin = scripts[0]

    def word(s: str) -> str:
        w = "".join(r.choice(s) for _ in range(r.randint(1 if r.random() < 0.2 else 2, 9)))
        return w.capitalize() if r.random() < 0.2 else w

    def words(s: str, lo: int, hi: int) -> str:
        return ("" if s[0] == "日" else " ").join(word(s) for _ in range(r.randint(lo, hi)))

    def name() -> str:
        return word(latin) + r.choice("_-_") + word(latin) + r.choice([".txt", ".md", "", "_" + word(latin), f"_{r.randint(1, 999)}", ".sh", "_" + word(latin) + ".py"])

    def num(hi: int = 999) -> int:
        return r.randint(1, hi)

    def odd(s: str) -> str:
        """Something that looks like markup and is none."""
        a, b, c = word(s), word(latin), word(latin)
        return r.choice([
            f" costs ${num()} to ${num()}, R&D & {a}", f" ${num()}.{num(99)} and ${num()}", f" ${num()}, ${num()} or ${num()}.", f" C:\\Users\\{b}\\temp\\{num()}.log", f" D:\\{b}\\{c}.txt", f" \\\\{b}\\{c}\\{num()}", f" C:\\new\\{b}\\item\\ref",
            f" {num()} * {num()} = {num()}", f" {num(9)}*{num(9)}*{num(9)}", f" {b}*{c}*{num(9)}", f" a < {num()} and b > {num()}, else a == {num()}", f" {b}<{c} or {c}>{b}", f" if a<b and c>d", f" see #{num()} and #{num()}",
            f" {name()} and {name()}", f" {name()}", f" {name()}", f" my_{b}_name", f" __ are names", f" {b}__{c}__{b}", f" [{num(30)}]", f" [{num(30)}][{num(30)}]", f" [{b}] ({c})", f" [A-{num()}] {{{num()}}} ~{num()} min", f" use <{b}-{c}> as {a}, see [{num(30)}]", f" <{b}{c}>", f" <{num()} {b}>",
            f" {{{b}}}", f" {{{{}}}}", f" {b} | {c} | {num()}", f" a | {num()}", f" Q&A; {b}", f" AT&T", f" {b} & {c} & {num()} \\\\", f" x^{num(9)}", f" {b}~{c}", f" `{b}", f" {b}'s and {c}'s", f" 2**{num(9)} and 3**{num(9)}", f" * {b} * {c}", f" *{b} {c}", f" **{num(9)}", f" _{b}", f" {b}_", f" $HOME/{b}:$PATH",
            f" {name()} {b}_, {c}", f" {b}_{c}_. {b}", f" {b}_\u201a{c} \u0192{b}_\u201a{c}", f" \u2039{b}*\u0178 {c}*\u201e", f" {b}_table.csv {a} x_{{{num(9)}}}",
            f" Ã©{b} Ã¼", f" ’{b}â€", f" {b}``", f" C# {c}", f" {b}!! {c}", f" {b} || {c}", f" {b} != {c}", f" x == {num()}", f" -- {c} ---", f" \\{b}\\", f" {b}/{c}\\{num()}", f" <- {b} ->", f" {b}=>{c}", f" ''", f" ~~", f" {num()}% of {num()}~{num()}",
        ])

    def sentence(s: str) -> str:
        text = words(s, 3, 14)
        if r.random() < 0.35:
            text += odd(s) + r.choice(["", " " + words(s, 1, 5)])
        return text + r.choice([".", ".", "。", "?", ":", ""])

    def around(s: str, mid: list[Piece]) -> list[Piece]:
        glue = "" if s[0] == "日" else " "
        a = words(s, 0, 6) if r.random() < 0.9 else sentence(s)
        b = words(s, 0, 6) if r.random() < 0.8 else odd(s)
        a, b = a + glue if a else "", glue + b if b else r.choice(["", ".", ","])
        return [(a, "text"), *mid, (b, "text")]

    def attrs() -> str:
        return "".join(r.choice(["", "", f' class="{word(latin)}"', f" id='{word(latin)}'", f' href="{word(latin)}.html"', f" width={num()}", f" style='color:#{num()}'", f'\nsrc="{word(latin)}.png"', f" title=\"{words(latin, 1, 3)}\"", f" href='{word(latin)}.html'", " data-x=1"]) for _ in range(2))

    def tag(n: str, inner: list[Piece]) -> list[Piece]:
        up = n.upper() if r.random() < 0.08 else n
        return [(f"<{up}{attrs()}>", "html:tag"), *inner, (f"</{up}>", "html:tag")]

    def phrase(s: str) -> str:
        x = words(s, 1, 4)
        if r.random() < 0.3:
            x = r.choice([f"{x}, {word(s)}", f"{num()}", f"{word(s)}. {word(s)}", f"{x}:", f"{num()} {x}", f"{x}?", word(s)[0]])
        return x

    def em(run: str, lang: str, s: str) -> list[Piece]:
        return [(run, lang + ":em"), (phrase(s), "text"), (run, lang + ":em")]

    def formula() -> str:
        v = lambda: r.choice("abcdkmnqrsuvxyz")
        return r.choice([
            f"{v()}_{v()} = {num(99)}", f"{v()}^2 + {v()}^2 \\le {num(99)}", f"\\frac{{{num()}}}{{{v()}+1}}", f"\\sum_{{{v()}=1}}^{{{num()}}} {v()}_{v()}^2", f"\\sqrt{{{v()}{v()}}} + {num(99)}", f"{v()}_{{{v()}}} = {num(9)}{v()}",
            f"{v()} + {v()} = {num(99)}", f"{v()}", f"{v()}(x)", f"O({v()} \\log {v()})", f"\\alpha \\times {num(9)}", f"{v()}_{num(9)} > {num(9)}", f"{num(9)}{v()}^{num(9)}", f"{v()}={num()}", f"{v()}/{v()}", f"\\mathbf{{{v()}}} \\cdot {v()}", f"{num(9)} \\cdot 10^{{{num(9)}}}", f"{v()}-{v()}",
        ])

    def inline(lang: str, s: str) -> list[Piece]:
        if lang == "html":
            return r.choice([
                lambda: tag(r.choice("b i a em strong span code sub sup u small q p td font mark kbd cite del".split()), [(phrase(s), "text")]),
                lambda: [(f"<{r.choice('br br hr img input wbr'.split())}{attrs()}{r.choice(['', '/', ' /'])}>", "html:tag")],
                lambda: [(r.choice(["&nbsp;", "&amp;", "&lt;", "&mdash;", "&#160;", "&#x2014;", "&amp;lt;", "&amp;amp;", "&quot;", "&eacute;", "&hellip;", "&copy;"]), "html:ref")],
                lambda: [(r.choice(["&lt;", "&amp;lt;"]), "html:ref"), (word(latin), "text"), ("&gt;", "html:ref")],
                lambda: [(f"<!-- {phrase(s)} -->", "html:comment")],
                lambda: [(f"</{r.choice('p div span li td b'.split())}>", "html:tag")],
                lambda: [(f"<{r.choice('p div span li td b'.split())}{attrs()}>", "html:tag")],
                lambda: [(f"<{r.choice(['input disabled', 'option selected', 'script async', 'input checked'])}>", "html:tag")],
            ])()
        if lang == "markdown":
            return r.choice([
                lambda: em(r.choice(["**", "*", "~~", "__", "_", "***", "**", "__", "~~"]), "markdown", s), lambda: em(r.choice(["**", "*", "~~", "__", "_"]), "markdown", s),
                lambda: [(f"`{r.choice([phrase(s), name(), '<b>', 'x = $1'])}`", "markdown:code")], lambda: [(f"``{word(s)}``", "markdown:code")],
                lambda: [(f"{r.choice(['', '', '!'])}[{phrase(s)}]({r.choice([f'docs/{word(latin)}.md', f'img/{word(latin)}.png', 'https://x.org/' + name(), '#' + word(latin)])})", "markdown:link")],
                lambda: [(f"[{phrase(s)}][{r.choice(['', word(latin), str(num(9))])}]", "markdown:link")],
                lambda: [(f"<https://{word(latin)}.org/{word(latin)}>", "markdown:link")],
            ])()
        if lang == "wiki":
            return r.choice([
                lambda: em(r.choice(["''", "'''", "'''''", "''", "'''"]), "wiki", s),
                lambda: [(f"[[{r.choice([phrase(s), f'{word(s)}|{phrase(s)}', f'File:{word(latin)}.png|thumb', f'{word(latin)}#{word(latin)}', f'Category:{word(s)}', f':{word(s)}:{word(s)}'])}]]", "wiki:link")],
                lambda: [("{{", "wiki:template"), (word(latin), "text"), ("|", "wiki:template"), (r.choice([phrase(s), f"a = {num()}"]), "text"), ("}}", "wiki:template")],
                lambda: [("{{", "wiki:template"), (words(latin, 1, 2), "text"), ("}}", "wiki:template")],
                lambda: [("{{", "wiki:template"), (word(latin), "text"), ("|", "wiki:template"), (word(s), "text"), ("|", "wiki:template"), (f"x={num()}", "text"), ("}}", "wiki:template")],
            ])()
        return r.choice([
            lambda: [(f"\\{r.choice(_CMD_ARG)}{{{r.choice([phrase(s), 'fig:' + word(latin), word(latin) + '.png'])}}}", "latex:command")],
            lambda: [(f"\\{word(latin) + 'x'}{{{phrase(s)}}}", "latex:command")],
            lambda: [("~", "text"), (f"\\{r.choice(['ref', 'cite', 'eqref'])}{{{word(latin)}:{word(latin)}}}", "latex:command")],
            lambda: [(f"\\{r.choice(_CMD_BARE)}", "latex:command")],
            lambda: [("\\" + r.choice(["alpha", "beta", "lambda", "pi"]), "latex:command"), (f"_{{{num(9)}}} ", "text"), ("\\times", "latex:command"), (f" x_{num(9)} ", "text"), ("\\" + r.choice(["beta", "infty"]), "latex:command")],
            lambda: [(f"${formula()}$", "latex:formula")], lambda: [(f"${formula()}$", "latex:formula")], lambda: [(f"\\({formula()}\\)", "latex:formula")], lambda: [(f"$${formula()}$$", "latex:formula")], lambda: [(f"\\[ {formula()} \\]", "latex:formula")],
        ])()

    nl: Piece = ("\n", "text")

    def lines(rows: list[list[Piece]]) -> list[Piece]:
        return [p for row in rows for p in (*row, nl)]

    def code_line() -> str:
        return r.choice([f"{word(latin)} --{word(latin)} = {num()};", f"{word(latin)}-tool run {word(latin)}.cfg", f"x = a[{num(9)}] * {word(latin)}_y", f"# {word(latin)}", f"if (a < b && c > d) {{ $x = '{word(latin)}'; }}", f"<b>{word(latin)}</b>", f"echo \"$HOME\" | grep '{word(latin)}'", "- " + word(latin), f"**{word(latin)}**", f"\\{word(latin)}{{x}}", f"{word(latin)}"])

    def block(s: str, lang: str) -> list[Piece]:
        k = r.randrange(30)
        if k < 8:
            return lines([[(sentence(s), "text")] for _ in range(num(3))])
        if k < 14:
            return lines([around(s, inline(lang, s) + (inline(r.choice([lang, lang, *LANGS]), s) if r.random() < 0.3 else [])) for _ in range(num(3))])
        if k == 14:
            return lines([[(r.choice(["- ", "* ", "1. ", "2) ", "+ "]) + sentence(s), "text")] for _ in range(3)])
        if k == 15:
            return lines([[(r.choice(["---", "-----", "=====", f"== {word(s)}", f"{word(s)} ==", f"| {word(s)} | {num()}", f"> {num()}", f"! {word(s)}", f"#{num()}", f"|{word(s)}|", f"* * *", f"-- {word(s)}", f"{word(s)} #"]) if False else r.choice(["---", "- - -", f"== {word(s)}", f"{word(s)} {num()} ==", f"{word(s)} | {num()}", f"#{num()} {word(s)}", f"! {word(s)}", f"{word(s)} | {word(s)} | {word(s)}"]), "text")], []]) if r.random() < 0.5 else lines([[(sentence(s) + odd(s), "text")]])
        if lang == "html":
            n = r.randrange(9)
            if n == 0:
                return lines([tag(f"h{r.randint(1, 6)}", [(phrase(s), "text")])])
            if n == 1:
                return lines([[(f"<{(u := r.choice(['ul', 'ol']))}>", "html:tag")], *[tag("li", around(s, [] if r.random() < 0.7 else inline("html", s))) for _ in range(2)], [(f"</{u}>", "html:tag")]])
            if n == 2:
                rows = [[("<tr>", "html:tag"), *tag("td", [(phrase(s), "text")]), *tag(r.choice(["td", "th"]), [(str(num()), "text")]), ("</tr>", "html:tag")] for _ in range(2)]
                flat = [("<table>", "html:tag"), *[p for x in rows for p in x], ("</table>", "html:tag")]
                return lines([flat]) if r.random() < 0.5 else lines([flat[:1], *rows, flat[-1:]])
            if n == 3:
                body = "\n".join(code_line().replace("<b>", "").replace("</b>", "") for _ in range(2))
                return lines([[("<pre>", "html:tag"), ("<code>", "html:tag"), (body, "code"), ("</code>", "html:tag"), ("</pre>", "html:tag")]])
            if n == 4:
                return lines([[(r.choice(["<!DOCTYPE html>", "<!doctype html>", f"<!-- {phrase(s)} -->", f"<!--\n{phrase(s)}\n-->"]), "html:comment")]])
            if n == 5:
                return lines([[("<script>", "html:tag")], [(f"var {word(latin)} = {num()};", "code")], [("</script>", "html:tag")]])
            if n == 6:
                return lines([[("<html>", "html:tag"), ("<head>", "html:tag"), *tag("title", [(phrase(s), "text")]), ("</head>", "html:tag")], [("<body>", "html:tag")]])
            if n == 7:
                return lines([tag("div", around(s, inline("html", s)))])
            return lines([tag("p", around(s, inline("html", s) if r.random() < 0.5 else inline("latex", s))), *([[("</body>", "html:tag"), ("</html>", "html:tag")]] if r.random() < 0.3 else [])])
        if lang == "markdown":
            n = r.randrange(8)
            if n == 0:
                return lines([[("#" * r.randint(1, 6), "markdown:heading"), (" " + r.choice([phrase(s), sentence(s)]), "text"), (r.choice(["", "", " " + "#" * r.randint(1, 3)]), "markdown:heading")]])
            if n in (1, 2):
                return lines([[(r.choice([phrase(s), words(s, 2, 5)]), "text")], [(r.choice("=-") * r.randint(3, 30), "markdown:heading")]])
            if n == 3:
                return lines([[(f"{r.choice('-*+')} [{r.choice(' xX')}]", "markdown:task"), (" " + sentence(s), "text")] for _ in range(2)])
            if n == 4:
                return lines([[(">" * r.choice([1, 1, 2]), "markdown:quote"), (" " + sentence(s), "text")] for _ in range(num(3))])
            if n in (5, 6):
                mark = r.choice(["```", "~~~", "````"])
                return lines([[(mark + r.choice(["", "sh", "python", " js"]), "markdown:fence")], *[[(code_line(), "code")] for _ in range(num(4))], [(mark, "markdown:fence")]])
            cells = r.randint(2, 4)
            rule = "|".join(r.choice(["---", ":-:", "--:", ":--", "----"]) for _ in range(cells))

            def row() -> list[Piece]:
                out: list[Piece] = [("|", "markdown:table")]
                for _ in range(cells):
                    out += [(f" {r.choice([phrase(s), str(num())])} ", "text"), ("|", "markdown:table")]
                return out

            return lines([row(), [(f"|{rule}|", "markdown:table")], *[row() for _ in range(num(3))]])
        if lang == "wiki":
            n = r.randrange(5)
            if n < 2:
                e = "=" * r.randint(2, 4)
                gap = r.choice(["", " "])
                return lines([[(e, "wiki:heading"), (gap + phrase(s) + gap, "text"), (e, "wiki:heading")]])
            if n == 2:
                return lines([[(r.choice(["* ", "# ", ": "]) + words(s, 2, 6) + " ", "text"), *inline("wiki", s), (" " + word(s), "text")] for _ in range(2)]).__class__(p for p in lines([[("* " + words(s, 2, 6) + " ", "text"), *inline("wiki", s)] for _ in range(2)]))
            if n == 3:
                rows: list[list[Piece]] = [[(r.choice(['{| class="wikitable"', "{|"]), "wiki:table")]]
                if r.random() < 0.5:
                    rows.append([("!", "wiki:table"), (" " + phrase(s) + " ", "text"), ("!!", "wiki:table"), (" " + word(s), "text")])
                for _ in range(num(3)):
                    rows += [[("|-", "wiki:table")], [("|", "wiki:table"), (" " + phrase(s) + " ", "text"), ("||", "wiki:table"), (" " + str(num()), "text")]]
                return lines([*rows, [("|}", "wiki:table")]])
            return lines([[("{{", "wiki:template"), ("Infobox", "text")], *[[("|", "wiki:template"), (f" {word(latin)} = {phrase(s)}", "text")] for _ in range(2)], [("}}", "wiki:template")]])
        n = r.randrange(7)
        if n == 0:
            return lines([[(f"\\{r.choice(['section', 'subsection', 'section*', 'chapter', 'paragraph'])}{{{phrase(s)}}}", "latex:command")]])
        if n == 1:
            e = r.choice(["itemize", "enumerate"])
            return lines([[(f"\\begin{{{e}}}", "latex:env")], *[[("\\item", "latex:command"), (" " + sentence(s), "text")] for _ in range(2)], [(f"\\end{{{e}}}", "latex:env")]])
        if n == 2:
            e = r.choice(["verbatim", "lstlisting"])
            return lines([[(f"\\begin{{{e}}}", "latex:env")], *[[(code_line(), "code")] for _ in range(2)], [(f"\\end{{{e}}}", "latex:env")]])
        if n == 3:
            return lines([[("\\begin{tabular}{ll}", "latex:env")], *[[(f"{phrase(s)} & {word(s)} & {num()} ", "text"), ("\\\\", "latex:table")] for _ in range(2)], [("\\end{tabular}", "latex:env")]])
        if n == 4:
            e = r.choice(["equation", "align", "equation*", "theorem", "abstract", "document", "figure", "quote"])
            return lines([[(f"\\begin{{{e}}}", "latex:env")], [(words(s, 1, 4), "text")], [(f"\\end{{{e}}}", "latex:env")]])
        if n == 5:
            a, b = r.choice([("$$", "$$"), ("\\[", "\\]")])
            return lines([[(f"{a}\n{formula()}\n{b}", "latex:formula")]])
        return lines([[("\\documentclass{article}", "latex:command")], [("\\usepackage{" + word(latin) + "}", "latex:command")]])

    out = []
    for _ in range(pages):
        s = r.choice(scripts)
        main = r.choice(LANGS)
        page: list[Piece] = []
        for _ in range(r.randint(3, 9)):
            page += block(s, main if r.random() < 0.7 else r.choice(LANGS))
            if r.random() < 0.8:
                page.append(nl)
        out.append([p for p in page if p[0]])
    return out


def labelled(page: list[Piece]) -> tuple[Page, list[str]]:
    """A page and the label of each leaf: that of the piece in which the leaf's first character that is no space lies."""
    text = "".join(p for p, _ in page)
    ends = np.cumsum([len(p) for p, _ in page])
    doc = Page(text)
    first = [s + len(text[s:e]) - len(text[s:e].lstrip()) for s, e in doc.spans]
    return doc, [page[i][1] for i in np.searchsorted(ends, first, side="right")]


@cache
def model(pages: int = 800, rounds: int = 60, seed: int = 5) -> Model:
    """The trained model; the same on every machine for the same parameters. ``pages`` bounds the labelled pages that it is fitted on."""
    made = [labelled(p) for p in training_pages(pages, seed)]
    seen = Counter(x for p, _ in made for f in p.feats for x in f)
    names = {x: i for i, x in enumerate(["bias", *sorted(x for x, n in seen.items() if n > 1 and x != "bias")])}
    gold = np.array([_AT[x] for _, labels in made for x in labels])
    return Model(names, CRF(len(names), len(LABELS)).fit(Model.chains([p for p, _ in made], names), gold, rounds))


# --- clean text ---

_HEAD_DEPTH = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "title": 1}
_SILENT = frozenset("label ref cite pageref eqref usepackage documentclass input includegraphics bibliography bibliographystyle vspace hspace".split())
_FORMULAS = frozenset("equation align displaymath gather multline math".split())
_CODES = frozenset("verbatim lstlisting minted".split())


def clean(page: Page, labels: list[int]) -> str:
    """The document's text without markup, structure kept: each leaf is rewritten by its label."""
    text, out, at = page.text, [], 0
    dropped = "\x00"  # marks what was taken out: a line of nothing else goes

    def heading_above() -> None:
        """Puts a heading's mark before the last line that is not blank; looks back no further than that line."""
        i = len(out) - 1
        while i >= 0 and not out[i].strip("\n"):
            i -= 1
        while i >= 0 and "\n" not in out[i].rstrip("\n"):
            i -= 1
        if i < 0:
            out.insert(0, "# ")
        else:
            cut = out[i].rstrip("\n").rfind("\n") + 1
            out[i] = out[i][:cut] + "# " + out[i][cut:].lstrip()

    for (s, e), shape, label, inside in zip(page.spans, page.shapes, labels, page.inside, strict=True):
        out.append(text[at:s])
        at = e
        raw, name = text[s:e], LABELS[label]
        lang, _, role = name.partition(":")
        new = raw
        if name == "text":
            if shape == "words":
                if "tabular" in inside:
                    new = re.sub(r"\s*(?<!\\)&\s*", " | ", raw)
                elif any(x in _FORMULAS for x in inside) and raw.strip():
                    new = raw.replace(raw.strip(), f"${raw.strip()}$")
        elif name == "code":
            pass
        elif role == "tag":
            m = re.match(r"<(/?)([A-Za-z0-9]+)", raw)
            end, tag = bool(m[1]), m[2].lower()
            new = dropped
            if tag == "br":
                new = "\n"
            elif tag in ("pre", "textarea"):
                new = "\n```\n"
            elif tag == "code" and "pre" not in inside:
                new = dropped
            elif len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
                new = "\n" if end else "#" * int(tag[1]) + " "
            elif tag in ("li", "dt", "dd") and not end:
                new = "- "
            elif tag in ("td", "th"):
                new = " | " if end else dropped
        elif role == "ref":
            new = html.unescape(html.unescape(raw)).replace("\xa0", " ")
        elif role == "comment":
            new = dropped
        elif role == "fence":
            new = "```"
        elif role == "heading":
            if shape == "atx" or shape == "whead":
                new = "#" * len(raw.strip()) + ("" if text[e : e + 1].isspace() else " ")
            else:
                new = dropped
                if shape == "under":
                    heading_above()
        elif role == "code":
            new = raw.strip("`")
        elif role == "link":
            if lang == "wiki":
                new = raw[2:-2].rsplit("|", 1)[-1]
            elif shape == "link":
                new = raw[raw.index("[") + 1 : raw.index("]")]
            else:
                new = raw.strip("<>") if shape == "auto" else dropped
        elif role == "task":
            new = "-"
        elif role == "table":
            first, last = not text[text.rfind("\n", 0, s) + 1 : s].strip(), not text[e : (text.find("\n", e) + 1 or len(text) + 1) - 1].strip()
            new = dropped if shape in ("rule", "wtab", "break") or first or last else "|"
        elif role == "template":
            new = " " if shape == "pipe" else dropped
        elif role == "command":
            m = re.match(r"\\([A-Za-z]+)\*?(?:\[[^\]\n]*\])?((?:\{[^{}\n]*\})*)", raw)
            args = " ".join(re.findall(r"\{([^{}]*)\}", m[2]))
            if m[1] in _HEAD_DEPTH and args:
                new = "#" * _HEAD_DEPTH[m[1]] + " " + args
            elif m[1] == "item":
                new = "-"
            elif m[1] in _SILENT:
                new = dropped
            else:
                new = args or {"LaTeX": "LaTeX", "TeX": "TeX", "ldots": "...", "dots": "...", "textbackslash": "\\"}.get(m[1], dropped)
        elif role == "env":
            new = "```" if re.search(r"\{(\w+)", raw)[1] in _CODES else dropped
        elif role == "formula":
            new = "$" + (raw[2:-2] if shape != "dollar" else raw[1:-1]).strip() + "$"
        else:  # emphasis, quotes
            new = dropped
        out.append(new)
    out.append(text[at:])
    rows = []
    for line in "".join(out).split("\n"):
        bare = line.replace(dropped, "")
        if not bare.strip(" |") and dropped in line:
            continue
        rows.append(bare.strip(" |") if dropped in line and "|" in bare else bare.strip() if line.startswith(dropped) else bare)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(rows))


def analyse(texts: list[str], trained: Model) -> list[tuple[Page, list[int], int]]:
    """(page, labels, languages as bits) of each text."""
    pages = [Page(t) for t in texts]
    out = []
    for p, own in zip(pages, trained.labels(pages), strict=True):
        mask = 0
        for l in own:
            mask |= _MASK[l]
        out.append((p, own, mask))
    return out


def analyse_markup(texts: DataFrame, trained: Model, with_text: bool) -> DataFrame:
    """(id, markups array<string>, clean string) of ``texts`` (id, text); clean is null unless asked for."""
    key, text = texts.columns[:2]
    rows = texts.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).filter("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                part = b.slice(lo, 200)
                found = analyse(part.column(1).to_pylist(), trained)
                names = [[g for i, g in enumerate(LANGS) if m >> i & 1] for _, _, m in found]
                new = [clean(p, l) if with_text and m else None for p, l, m in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.list_(pa.string())), pa.array(new, pa.string())], ["id", "markups", "clean"])

    return rows.mapInArrow(run, "id long, markups array<string>, clean string")
