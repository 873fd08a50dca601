"""Which paragraphs of a notebook's recorded cells are running prose: a small helper that labels the training documents, and only those."""

from __future__ import annotations

import re
from collections.abc import Iterator

_BULLET = re.compile(r"(?:[-*+•–]|\d{1,3}[.)])\s+(?:\[[ xX]\]\s+)?")
_PROMPT = re.compile(r"Out ?\[[ \d]*\]: ?")
_CODE = re.compile(r"(?:%|!|@|\$ |>>>|```|In ?\[|import \w|from \w+ import|def |class |return |assert |print\(|for \w+ in .*:$|if .*:$|elif |else:|try:|except|raise |File \"|[\w.]+ ?[-+*/]?= |[\w.]+\[|[\w.]+\()")
_MARKUP = re.compile(r"!?\[([^\]\[]*)\]\((?:https?://)?[^)\s]*\)|[*_`]+")
_END = ".!?…。！？:;"
_AROUND = ".,;:!?…()[]\"'«»„“”‚‘’—–-"
_KANA = re.compile("[぀-ヿ]")
_PAUSE = re.compile(r"[.,;:]")
_SENTENCE = re.compile(r"(?<=[.!?]) +")


def units(lines: Iterator[str]) -> Iterator[str]:
    """Paragraphs whose lines are wrapped as one text each, all other lines one by one."""
    held: list[str] = []
    for line in lines:
        if not line or line.isspace() or line.startswith(("```", "%%", '{"cell_type')):
            yield from _unwrapped(held)
            held = []
        else:
            held.append(line)
    yield from _unwrapped(held)


def _unwrapped(lines: list[str]) -> list[str]:
    width = max(map(len, lines), default=0)
    if len(lines) < 2 or not 24 <= width < 100 or 3 * sum(bool(_CODE.match(x.lstrip())) for x in lines) >= len(lines):
        return lines
    # in wrapped text the next line's first word would have been too much for the line
    full = sum(len(a) + 1 + len(b.split(None, 1)[0]) > width and not _BULLET.match(b) for a, b in zip(lines, lines[1:]))
    return [" ".join(lines)] if full >= 0.8 * (len(lines) - 1) else lines


def is_prose(unit: str, common: frozenset[str]) -> bool:
    """Whether a unit reads as sentences: enough words, common words or the case and pauses of sentences, no sign of lists, tables or code."""
    s = unit.strip()
    if len(s) < 12:
        return False
    if not s.isascii():
        kana = len(_KANA.findall(s))
        if kana >= 6 and kana >= 0.25 * len(s):
            return s[0] != "|"
    s = _PROMPT.sub("", s, count=1) if s.startswith("Out") else s
    bullet = _BULLET.match(s)
    body = s[bullet.end() :] if bullet else s
    plain = _MARKUP.sub(r"\1", body).strip()
    if not plain or len(plain) < 0.6 * len(body):  # mostly links
        return False
    if plain[0] in "|<{[+=#\x1b" or " | " in s or " > " in s or "\t" in s or _CODE.match(plain):
        return False
    tokens = plain.split()
    n = len(tokens)
    if n < 4 or len(plain) > 14 * n:
        return False
    words = [t for t in (x.strip(_AROUND) for x in tokens) if t and (t.isalpha() or "'" in t or "’" in t or "-" in t)]
    if len(words) < max(4, 0.45 * n) or (n >= 8 and len({w.lower() for w in words}) <= 4):  # numbers, or one thing over and over
        return False
    share = sum(w.lower() in common for w in words) / len(words)
    ends = plain[-1] in _END
    if share >= 0.13:
        if bullet:  # items of lists are mostly no sentences
            return n >= 9 or (ends and "," in plain and n >= 7)
        return n >= 10 or (ends and plain[-1] not in ";:" and n >= 5 and not plain[0].islower())
    if bullet or len(words) < 0.8 * n:
        return False
    if plain.isupper():
        return n >= 8
    if not _PAUSE.search(plain):
        return n >= 14
    # terse sentences: each begins with a capital and goes on in lower case
    sentences = _SENTENCE.split(plain)
    capitals = sum(w[0].isupper() for w in words) / len(words)
    begun = sum(x[0].isupper() for x in sentences) / len(sentences)
    return begun >= 0.8 and capitals < 0.34 and len(words) >= 4 * len(sentences)


def solid(text: str) -> int:
    """The number of non-blank characters."""
    return len("".join(text.split()))


def prose_chars_of_cells(text: str, cells: list[dict], common: frozenset[str]) -> int:
    """Non-blank characters of a notebook's recorded cells that are running prose; cells of code have none."""
    total = 0
    for c in cells:
        if c and c["cell_kind"] != "code" and c["char_from"] is not None and c["char_len"] is not None:
            part = text[c["char_from"] : c["char_from"] + c["char_len"]]
            if part.startswith('["'):
                part = part.strip('[]"').replace('\\n", "', "\n").replace("\\n", "\n").replace('\\"', '"')
            lines = [x.rstrip() for x in part.split("\n")]
            if "# %%" in text and all(x.startswith("#") or not x for x in lines):
                lines = [x[2:] for x in lines]
            total += sum(solid(u) for u in units(iter(lines)) if is_prose(u, common))
    return total
