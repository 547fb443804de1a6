"""Cutting of one packed string into stretches whose inner breaks are still open.

``lex`` applies only rules that hold without statistics: quoted spans and brackets are
atomic, a mark between two digits belongs to its value, numbering and separator marks end a
value. What stays open, single white space, is left to the lattice of ``operators.unpack``.
"""

from __future__ import annotations

import re

# Marks that separate values, pairs that enclose them.
SEPARATORS = frozenset(",，;；、|｜/／+＋\t\r\n")
QUOTES = {"“": "”", "「": "」", "『": "』", '"': '"', "‘": "’", "'": "'", "«": "»", "„": "“"}
OPENERS = frozenset("(（[［【〔《〈{｛")
CLOSERS = frozenset(")）]］】〕》〉}｝")
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"

_NUMBER = re.compile(r"(?:[(（](\d{1,3})[)）]|(\d{1,3})(?:[、)）:：]|[.．](?!\d)))[ \t　]*")
_BULLET = re.compile(r"[•●■◆·*\-–—▪]\s+")


def _digit(text: str, i: int) -> bool:
    return 0 <= i < len(text) and text[i].isdigit()


def _close_bracket(text: str, i: int) -> int:
    """Index after the bracket that closes the one at i, or -1 if none does."""
    depth = 0
    for j in range(i, len(text)):
        if text[j] in OPENERS:
            depth += 1
        elif text[j] in CLOSERS:
            depth -= 1
            if depth == 0:
                return j + 1
    return -1


def _close_quote(text: str, i: int) -> int:
    """Index of the mark that closes the quote at i and is followed by the end of a value, or -1."""
    end, j = QUOTES[text[i]], i + 1
    while j < len(text):
        if text[j] == end:
            if j + 1 < len(text) and text[j + 1] == end:
                j += 2
                continue
            k = j + 1
            if k == len(text) or text[k].isspace() or text[k] in SEPARATORS or text[k] in QUOTES or text[k] in CIRCLED:
                return j
        j += 1
    return -1


def lex(text: str | None) -> list[tuple[int, str, bool]]:
    """(stretch, atom, quoted) in order; atoms of one stretch were parted by single white space only."""
    if not text:
        return []
    out: list[tuple[int, str, bool]] = []
    stretch, buf, i, n, fresh, due, numbered = 0, [], 0, len(text), True, 1, False

    def flush(quoted: bool = False) -> None:
        word = "".join(buf).strip()
        buf.clear()
        if word:
            out.append((stretch, word, quoted))

    while i < n:
        ch = text[i]
        if fresh and (m := _NUMBER.match(text, i)) and int(m[1] or m[2]) == due and (due > 1 or m.end() < n):
            # numbering counts up from one; the numbers part the values, white space inside them doesn't
            flush()
            stretch, due, i, numbered = stretch + 1, due + 1, m.end(), True
            continue
        if ch in CIRCLED and CIRCLED.index(ch) == due - 1:
            flush()
            stretch, due, i, numbered, fresh = stretch + 1, due + 1, i + 1, True, True
            continue
        if fresh and not buf and (m := _BULLET.match(text, i)) and ch != "*":
            stretch, i = stretch + 1, m.end()
            continue
        if ch in QUOTES and not buf and fresh and (j := _close_quote(text, i)) > 0:
            end = QUOTES[ch]
            inner = text[i + 1 : j].replace(end * 2, end).strip()
            flush()
            if inner:
                out.append((stretch + 1, inner, True))
            stretch, i, fresh = stretch + 2, j + 1, True
            continue
        if ch in OPENERS and (j := _close_bracket(text, i)) > 0:
            buf.append(text[i:j])
            i, fresh = j, False
            continue
        if ch in SEPARATORS and not (_digit(text, i - 1) and _digit(text, i + 1)):
            flush()
            stretch, i, fresh = stretch + 1, i + 1, True
            continue
        if ch.isspace():
            j = i
            while j < n and text[j].isspace():
                j += 1
            wide = j - i > 1 or "\n" in text[i:j]
            if wide:
                flush()
                stretch += 1
            elif numbered:
                buf.append(" ")
            else:
                flush()
            i, fresh = j, True
            continue
        buf.append(ch)
        i, fresh = i + 1, False
    flush()
    return out
