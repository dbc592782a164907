"""Decoding of file bytes: byte-order marks, strict UTF-8, then the best scored of UTF-16 and the legacy charsets."""

from __future__ import annotations

import codecs
import unicodedata

_BOMS = [(codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")]
_LEGACY = ["gb18030", "big5", "shift_jis", "euc-kr", "cp1251", "cp1252"]
_WIDE = ["utf-16-le", "utf-16-be"]
_SAMPLE = 20_000
#: Frequent characters that real text can't do without: of simplified and of traditional Chinese, of both, and of Korean.
_SIMPLE = set("这为来个们说国时会对发经当学种将还两开关问门间书东车见长马语题应实现")
_TRADITIONAL = set("這為來個們說國時會對發經當學種將還兩開關問門間書東車見長馬語題應實現")
_HANGUL = set("이다의는에을를가고하지로한서도어사기니나시인리스은자보해그대수일과전")
_BOTH = set("的一是不了在人有我他之大以中上到和地也子道出而要于就下得可你年生自那后能着事其里所去行过家十用天如然作方成者多日都三小二无同么法起与好看进此心前面又定只主没公从")


def nul_ratio(data: bytes) -> float:
    return data.count(0) / len(data) if data else 0.0


def score(text: str, codec: str = "") -> float:
    """How much a decoded text looks like one: shares of letters and frequent characters, less controls, rare blocks and mixtures. A charset
    made for one script has to show that script: kana, Hangul, or the frequent characters of its kind of Chinese."""
    sample = text[:_SAMPLE]
    if not sample:
        return 0.0
    points = 0.0
    kana = any(0x3041 <= ord(c) <= 0x30FF for c in sample)
    for before, c, after in zip(" " + sample, sample, sample[1:] + " ", strict=False):
        o = ord(c)
        if o < 0x80:
            points += 1 if o >= 32 or c in "\t\n\r" else -5
        elif c == "\ufffd" or 0xE000 <= o <= 0xF8FF or unicodedata.category(c) in ("Cc", "Cn", "Cs"):
            points -= 5
        elif 0x4E00 <= o <= 0x9FFF:
            if codec == "euc-kr" or (codec == "shift_jis" and not kana):
                points += 0.1
            elif c in _BOTH:
                points += 2
            elif c in _SIMPLE or c in _TRADITIONAL:
                points += 2.2 if codec != {True: "big5", False: "gb18030"}[c in _SIMPLE] else 0.4
            else:
                points += 0.8
        elif 0x3041 <= o <= 0x30FF:
            points += 2 if codec in ("shift_jis", *_WIDE) else 0.6
        elif 0xAC00 <= o <= 0xD7A3:
            points += (2 if c in _HANGUL else 0.5) if codec in ("euc-kr", *_WIDE) else 0.2
        elif 0x3000 <= o <= 0x303F or 0xFF00 <= o <= 0xFF5E:
            points += 0.8
        elif 0x400 <= o <= 0x45F:
            mixed = (before.isascii() and before.isalpha()) or (after.isascii() and after.isalpha())
            points += -1 if mixed else 1.2 if c.islower() else 0.6
        elif 0xC0 <= o <= 0x24F:
            points += 1.0 if c.islower() else 0.3
        else:
            points += 0.2
    return points / len(sample)


def decode(data: bytes) -> tuple[str, str]:
    """(encoding, text); the text is complete whatever the encoding.

    Text in UTF-16 without a mark is told by decoding it: both byte orders compete with the legacy charsets, and with UTF-8 where the
    bytes are valid as such only because they hold zeros."""
    for bom, name in _BOMS:
        if data.startswith(bom):
            return name, data.decode(name, "replace")
    head = data[: 4 * _SAMPLE]
    wide = _WIDE if len(data) % 2 == 0 else []
    try:
        text = data.decode("utf-8")
        if "\0" not in text[:_SAMPLE]:
            return "utf-8", text
        rivals = ["utf-8", *wide]
    except UnicodeDecodeError:
        rivals = [*_LEGACY, *wide]
    best = max(rivals, key=lambda codec: _wide_score(head, codec) if codec in wide else score(head.decode(codec, "replace"), codec))
    return best, data.decode(best, "replace")


def _wide_score(head: bytes, codec: str) -> float:
    """The score of a UTF-16 reading; none for one that is poor, or that has neither a character of one byte nor enough frequent ones: any
    bytes read in pairs give some characters."""
    text = head.decode(codec, "replace")
    usual = sum(c in _BOTH or c in _SIMPLE or c in _TRADITIONAL or "\u3041" <= c <= "\u30ff" for c in text[:_SAMPLE])
    points = score(text, codec)
    return points if points >= 0.5 and (0 in head or usual >= 0.2 * min(len(text), _SAMPLE)) else float("-inf")
