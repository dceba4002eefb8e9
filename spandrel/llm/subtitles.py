"""Dialogue of subtitle files: what is spoken, with its places in the file's text.

A file is a list of cues: an optional number, a line of times, lines of text.  What isn't spoken is
blanked: markup, sound descriptions in brackets, speaker names before a colon, adverts and credits.
UTF-8 that was read as a single-byte encoding is read rightly first.  All of this keeps lines as they
are, so that line k of the dialogue is line k of the file.  A text without any line of times is one cue.
"""

from __future__ import annotations

import re

#: Stands in the dialogue for a line of times; so a new cue begins.
CUE = "\x1e"
#: Markup and sound descriptions, and speakers.  Fixed shapes of subtitle files.
MARKED = re.compile(r"[<{\[(](?:(?<=<)[^<>\n]{0,80}>|(?<=\{)[^{}\n]{0,80}\}|(?<=\[)[^\[\]\x1e]{0,120}\]|(?<=\()[^()\x1e]{0,120}\))")
SPEAKER = re.compile(r"[ \t]*(?:[-–—][ \t]*)?[^\W\d_][\w'’.]{0,30}(?:[ ][^\W\d_][\w'’.]{0,30})?:(?=\s|$)")
#: Parts of adverts and credits in the languages of subtitle sites, and of addresses.
NOTICES = ("www", "http", ".example", ".com", "-subs.", "subtitle", "captions", "sous-titres", "untertitel", "ondertitel", "legendas", "sottotitol", "napis", "subt", "synced", "synchro", "corrected by")
_NOTICE = re.compile(r"www\b|https?:|\.example\b|\.com\b|-subs\.|\bsubtitles? (?:by|from)\b|\bcaptions? (?:at|by|on|from)\b|sous-titres|untertitel|ondertitel|\blegendas\b|sottotitol|\bnapis(?:y|ów)\b|\bsubt\S{1,3}tulos|\bsynced\b|\bsynchro\b|\bcorrected by\b")
INVISIBLE = {ord(c): None for c in "\xad\u200b\u200c\u200d\u2060\ufeff\u180e\u200e\u200f"}
#: UTF-8 read as a single-byte encoding: a lead byte and its continuation bytes, as characters.
GARBLED = re.compile("[\xc2-\xf4][\x80-\xbfŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™]{1,3}")
_GARBLED_SIGNS = ("Ã", "Â", "Å", "Ä", "â€", "ï»")
_BYTES = {chr(b): bytes([b]) for b in range(0x80, 0x100)} | {bytes([b]).decode("cp1252", "ignore"): bytes([b]) for b in range(0x80, 0x100)}


def _regained(m: re.Match) -> str:
    try:
        return b"".join(_BYTES[c] for c in m[0]).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return m[0]


def ungarbled(text: str) -> str:
    """The text with UTF-8 that was read as a single-byte encoding, once or twice, read rightly."""
    if text.isascii():
        return text
    for _ in range(2):
        if not any(s in text for s in _GARBLED_SIGNS):
            break
        text = GARBLED.sub(_regained, text)
    return text


def ungarbled_places(line: str) -> list[int]:
    """The place in the line of each character of ``ungarbled(line)``."""
    places = list(range(len(line)))
    for _ in range(2):
        if not any(s in line for s in _GARBLED_SIGNS):
            break
        text, at, i = [], [], 0
        for m in GARBLED.finditer(line):
            right = _regained(m)
            text += line[i : m.start()], right
            at += places[i : m.start()]
            at += places[m.start() : m.end()] if right == m[0] else [places[m.start()]] * len(right)
            i = m.end()
        line, places = "".join(text) + line[i:], at + places[i:]
    return places


def _blank(m: re.Match) -> str:
    return " " * len(m[0]) if "\n" not in m[0] else "\n".join(" " * len(x) for x in m[0].split("\n"))


def file_lines(text: str) -> list[str]:
    """The file's lines, each as long as it stands there; a carriage return ends a line too."""
    if "\r" in text:
        text = text.replace("\r\n", " \n").replace("\r", "\n")
    return text.split("\n")


def spoken(text: str) -> list[str]:
    """The dialogue, line by line: blanks for all that isn't spoken, CUE for a line of times."""
    lines = file_lines(ungarbled(text))
    times = [i for i, x in enumerate(lines) if "-->" in x]
    for i in times:
        lines[i] = CUE
        k = i - 1
        while k >= 0 and not lines[k].strip():
            k -= 1
        if k >= 0 and lines[k].strip().isdigit():
            lines[k] = ""
    for i in range(times[0] if times else 0):
        lines[i] = ""
    whole = "\n".join(lines)
    if "[" in whole or "(" in whole or "<" in whole or "{" in whole:
        whole = MARKED.sub(_blank, whole)
        lines = whole.split("\n")
    if ":" in whole:
        lines = [" " * m.end() + x[m.end() :] if ":" in x and (m := SPEAKER.match(x)) else x for x in lines]
    low = whole.lower()
    if signs := [n for n in NOTICES if n in low]:
        for i, x in enumerate(low.split("\n")):
            for n in signs:
                if n in x:
                    if _NOTICE.search(x):
                        lines[i] = ""
                    break
    return lines
