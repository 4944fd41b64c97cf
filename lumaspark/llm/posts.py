"""Plain words of forum posts: markup, quoting and invisible characters taken off."""

from __future__ import annotations

import html
import re

_INLINE = "b|i|u|s|em|strong|span|font|sup|sub|tt|code|mark|small|big|a|del|ins|strike|color|size"
_TAG_IN = re.compile(rf"</?(?:{_INLINE})(?:\s[^<>]*)?>|\[/?(?:{_INLINE})(?:=[^\[\]]*)?\]", re.I)
_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>|\[/?[A-Za-z]+(?:=[^\[\]\n]*)?\]", re.S)
#: Invisible characters that join what stands on either side; line and paragraph separators are white space.
_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\U0001d173-\U0001d17a\U000e0000-\U000e0fff]")
_WORD = re.compile(r"[^\W_]+")


def unmarked(text: str) -> str:
    """The text without tags, entities and invisible characters."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text or "[" in text:
        text = _TAG.sub(" ", _TAG_IN.sub("", text))
    return _INVISIBLE.sub("", text)


def words_of(text: str) -> list[str]:
    """Lower-case words (runs of letters and digits) of a text."""
    return _WORD.findall(unmarked(text).casefold())


_QUOTE = re.compile(r"^[ \t]*(?:[>|»][ \t]?)+")
_END = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+")
_ENDS = re.compile(r"[.!?…](?!$)")
_RULE = re.compile(r"[-_*=~]{2,}")
_QUOTES, _RULES = (">", "|", "»"), ("-", "_", "*", "=", "~")
#: A line is taken for wrapped if the next word would have made it longer than this.
WRAP = 60


def sentences_of(text: str) -> list[str]:
    """Sentences of a post, quoted ones too.

    A line ends a sentence unless a mailer has wrapped it, which shows by the next line's first word
    not having had room on it.
    """
    out: list[str] = []
    open_, length = "", 0
    for raw in unmarked(text).split("\n"):
        line = raw.strip()
        if line[:1] in _QUOTES:
            line = _QUOTE.sub("", line).strip()
        if not line or line[0] in _RULES and _RULE.fullmatch(line):
            if open_:
                out.append(open_)
            open_ = ""
            continue
        first = line.split(None, 1)[0]
        if open_ and length + 1 + len(first) <= WRAP:
            out.append(open_)
            open_ = ""
        open_ = f"{open_} {line}" if open_ else line
        length = len(raw.rstrip())
    if open_:
        out.append(open_)
    return [" ".join(words) for part in out for s in (_END.split(part) if _ENDS.search(part) else (part,)) if (words := s.split())]
