"""Text layer of PDF files: objects found by scanning, object streams, the page tree, text operators, ToUnicode maps."""

from __future__ import annotations

import re
import zlib

from lectern.sources.office import Unsupported

STREAM_MOST, PAGES_MOST = 32 << 20, 5000
_OBJ = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _inflate(data: bytes) -> bytes:
    d = zlib.decompressobj()
    try:
        return d.decompress(data, STREAM_MOST)
    except zlib.error:
        return b""


class _File:
    def __init__(self, data: bytes):
        if not data.lstrip()[:5].startswith(b"%PDF-"):
            raise Unsupported("no PDF")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise Unsupported("encrypted")
        self.objects: dict[int, bytes] = {int(n): body for n, body in _OBJ.findall(data)}
        for body in list(self.objects.values()):
            if b"/ObjStm" in body[:400]:
                flat = self.stream(body)
                first, count = (int(m[1]) if (m := re.search(rb"/%s\s+(\d+)" % k, body)) else 0 for k in (b"First", b"N"))
                head = list(map(int, re.findall(rb"\d+", flat[:first])))[: 2 * count]
                starts = head[1::2]
                for n, a, b in zip(head[::2], starts, [*starts[1:], len(flat)], strict=True):
                    self.objects.setdefault(n, flat[first + a : first + b])

    def stream(self, body: bytes) -> bytes:
        m = re.search(rb"stream\r?\n", body)
        if not m:
            return b""
        raw = body[m.end() : body.rfind(b"endstream")]
        return _inflate(raw) if b"/FlateDecode" in body[: m.start()] else raw[:STREAM_MOST]

    def get(self, ref: int) -> bytes:
        return self.objects.get(ref, b"")

    def pages(self) -> list[tuple[bytes, bytes]]:
        """(page, inherited resources) in the order of the page tree."""
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), b"")
        m = re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", root)
        out: list[tuple[bytes, bytes]] = []
        todo, seen = ([(int(m[1]), b"")] if m else []), set()
        while todo and len(out) < PAGES_MOST:
            ref, given = todo.pop()
            if ref in seen:
                continue
            seen.add(ref)
            body = self.get(ref)
            own = body if b"/Resources" in body else given
            kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
            if kids:
                todo += [(int(r), own) for r in reversed(_REF.findall(kids[1]))]
            elif re.search(rb"/Type\s*/Page\b", body):
                out.append((body, own))
        return out or [(b, b) for b in self.objects.values() if re.search(rb"/Type\s*/Page\b", b)]


class _Font:
    def __init__(self, file: _File, body: bytes):
        self.map: dict[int, str] = {}
        self.wide = b"/Type0" in body
        if m := re.search(rb"/ToUnicode\s+(\d+)\s+\d+\s+R", body):
            cmap = file.stream(file.get(int(m[1])))
            text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
            for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
                for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                    self.map[int(a, 16)] = text(b)
            for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
                for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                    for i in range(min(int(b, 16) - int(a, 16) + 1, 65536)):
                        self.map[int(a, 16) + i] = chr(int(c, 16) + i)
        if self.wide and not self.map:
            raise Unsupported("a font without a map to text")

    def text(self, raw: bytes) -> str:
        if self.wide:
            return "".join(self.map.get(int.from_bytes(raw[i : i + 2], "big"), "") for i in range(0, len(raw), 2))
        return "".join(self.map.get(b) or bytes([b]).decode("cp1252", "replace") for b in raw)


def _literal(tok: bytes) -> bytes:
    if tok[:1] == b"<":
        digits = re.sub(rb"\s", b"", tok[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], m[1]), tok[1:-1], flags=re.S)


#: Fixed value: the move, in thousandths of the font size, from which on two pieces of text are two words.
GAP = -180


def _page_text(content: bytes, fonts: dict[bytes, _Font]) -> str:
    out: list[str] = []
    stack: list[bytes] = []
    font = None
    show = lambda raw: out.append(font.text(raw) if font else raw.decode("cp1252", "replace"))
    for tok in _TOKEN.findall(content):
        c = tok[:1]
        if not (c.isalpha() or c in b"'\"*") or c in b"(<[]/":
            stack.append(tok)
            continue
        if tok == b"Tf":
            font = next((fonts[t[1:]] for t in stack if t[:1] == b"/" and t[1:] in fonts), font)
        elif tok in (b"Tj", b"TJ", b"'", b'"'):
            if tok in (b"'", b'"'):
                out.append("\n")
            for t in stack:
                if t[:1] in (b"(", b"<"):
                    show(_literal(t))
                elif tok == b"TJ" and t[:1] not in (b"[", b"]", b"/") and float(t) < GAP:
                    out.append(" ")
        elif tok in (b"Td", b"TD", b"T*", b"Tm", b"ET"):
            out.append("\n")
        stack = []
    return re.sub(r"\s*\n\s*", "\n", "".join(out)).strip()


def pdf(data: bytes) -> tuple[str, list[tuple[str, int, str, str]]]:
    """(text, pages)."""
    file = _File(data)
    units = []
    for i, (page, given) in enumerate(file.pages(), 1):
        res = given
        if m := re.search(rb"/Resources\s+(\d+)\s+\d+\s+R", given):
            res = file.get(int(m[1]))
        block = re.search(rb"/Font\s*<<(.*?)>>", res, re.S)
        if not block and (m := re.search(rb"/Font\s+(\d+)\s+\d+\s+R", res)):
            block = re.search(rb"<<(.*?)>>", file.get(int(m[1])), re.S)
        fonts = {n: _Font(file, file.get(int(r))) for n, r in re.findall(rb"/([^\s/]+)\s+(\d+)\s+\d+\s+R", block[1])} if block else {}
        m = re.search(rb"/Contents\s*(?:\[(.*?)\]|(\d+\s+\d+\s+R))", page, re.S)
        refs = _REF.findall(m[1] or m[2]) if m else []
        text = _page_text(b"\n".join(file.stream(file.get(int(r))) for r in refs), fonts)
        if text:
            units.append(("page", i, "", text))
    if not units:
        raise Unsupported("no text layer")
    return "\n".join(u[3] for u in units), units
