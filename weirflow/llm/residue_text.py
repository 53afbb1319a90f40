"""Texts as a template sees them: masked words in segments, so that what was made from one template is equal or alike.

Numbers, names, markup and the many words for scripts are masked; a text falls into lines and sentences. Segments of mock Latin,
of keys of one row of the keyboard, or of one word over and over are masked as a whole: each kind is one family.
"""

from __future__ import annotations

import re
from collections import Counter

#: Words of the customary mock Latin and its generators (fixed values).
LATIN = frozenset(
    "ad adipiscing aliqua aliquip amet anim aute cillum commodo consectetur consequat culpa cupidatat deserunt do dolor dolore duis ea eiusmod elit enim esse est et eu "
    "ex excepteur exercitation fugiat id in incididunt ipsum irure labore laboris laborum lorem magna minim mollit nisi non nostrud nulla occaecat officia pariatur "
    "proident qui quis reprehenderit sed sint sit sunt tempor ullamco ut velit veniam voluptate "
    "accumsan aenean aliquam aliquet ante arcu auctor augue bibendum blandit condimentum congue cras cubilia curabitur curae cursus dapibus diam dictum dignissim donec dui egestas "
    "eleifend elementum erat eros euismod facilisis faucibus felis fermentum feugiat finibus fringilla fusce gravida hendrerit iaculis imperdiet interdum justo lacinia lacus laoreet "
    "lectus leo libero ligula lobortis luctus maecenas malesuada massa mattis mauris metus molestie mollis morbi nam nec neque nibh nunc odio orci ornare pellentesque pharetra "
    "phasellus porta porttitor posuere praesent pretium proin pulvinar purus quisque rhoncus risus rutrum sagittis sapien scelerisque sem semper sodales sollicitudin suscipit "
    "tellus tincidunt tortor tristique turpis ultrices urna varius vehicula vel vestibulum vitae vivamus viverra volutpat vulputate".split()
)
#: Letters of a word that tell its stem: forms of a mock Latin word are mock Latin too.
STEM = 4
_STEMS = frozenset(w[:STEM] for w in LATIN if len(w) > STEM)
#: The rows of a keyboard.
ROWS = tuple(map(frozenset, ("qwertyuiop", "asdfghjkl", "zxcvbnm")))
#: Share of a segment's words that makes it one of a family.
MOST = 0.7

_TAG = re.compile(r"</?[a-z!][^<>]{0,500}>|&lt;[^&\n]{1,100}&gt;")
HEADING = re.compile(r"^[ \t]*#[^\n]*", re.M)
_BLOCK_QUOTE = re.compile(r"^[ \t]*>", re.M)
_SCRIPT = re.compile(r"(?<!\w)(?:java ?scripts?|js|(?:client-side |browser )?(?:scripts?|scripting))(?!\w)")
_TOKEN = re.compile(r"\w+(?:['’./@:_-]+\w+)*|[.!?:;]\Z|[\"“”`]")
_HEX = re.compile(r"[0-9a-f]{6,}\Z")
_PLAIN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*\Z")
END, QUOTE, NUMBER, NAME = "\n", '"', "0", "§"
_MEMO = 500_000


def _mask(token: str) -> str:
    if token.isalpha():
        return token
    if _PLAIN.match(token):
        return token.replace("’", "'")
    first = token[0]
    if first in '"“”`':
        return QUOTE
    if len(token) == 1 and not token.isalnum():
        return END
    return NUMBER if _HEX.match(token) or not any(c.isalpha() for c in token) else NAME


def tokens_of(word: str) -> tuple[str, ...]:
    """Masked tokens of what stands between two blanks."""
    return (END,) if word == "-" else tuple(map(_mask, _TOKEN.findall(word)))


class Memo(dict):
    """A function of words, remembered; forgotten when there are too many."""

    def __init__(self, of, most: int = _MEMO):
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, word):
        if len(self) > self.most:
            self.clear()
        out = self[word] = self.of(word)
        return out


def masks() -> Memo:
    """The masked tokens of what stands between two blanks, with blanks between them."""
    return Memo(lambda word: " ".join(tokens_of(word)))


def masked(text: str, memo: Memo) -> list[str]:
    """Segments: masked tokens with a blank between them. Headings are left out; a quote character stays as a token, also where a line
    is quoted."""
    low = text.lower()
    if "<" in low or "&lt;" in low:
        low = _TAG.sub("\n", low)
    if "#" in low:
        low = HEADING.sub("", low)
    if ">" in low:
        low = _BLOCK_QUOTE.sub('"', low)
    if "script" in low or "js" in low:
        low = _SCRIPT.sub("js", low)
    # a dash between blanks ends a segment, as a line's end does
    words = " - ".join(low.splitlines()).split()
    return [s for x in " ".join(filter(None, map(memo.__getitem__, words))).split(END) if (s := x.strip(" "))]


def _latin(w: str) -> bool:
    return w in LATIN or (len(w) > STEM and w[:STEM] in _STEMS)


def _mashed(w: str) -> bool:
    return len(w) > 1 and any(r.issuperset(w) for r in ROWS)


def family(segment: list[str]) -> str | None:
    """``lat``, ``key`` or ``rep`` if the segment is mock Latin, mashed keys or one word over and over."""
    words = [w for w in segment if w not in (NUMBER, NAME)]
    n = len(words)
    if n < 2 or QUOTE in words:
        return None
    if n >= 4 and len(set(words)) <= 0.5 * n:
        most = Counter(words).most_common(1)[0][1]
        if most > (0.6 if n >= 8 else 0.9) * n:
            return "rep"
    if sum(map(_latin, words)) >= MOST * n:
        return "lat"
    if n >= 3 and sum(map(len, words)) >= 12 and sum(map(_mashed, words)) >= 0.9 * n:
        return "key"
    return None


def size(segment: str) -> int:
    """Words of a segment: masked numbers and quote characters are none, and no other token holds these characters."""
    return segment.count(" ") + 1 - segment.count(NUMBER) - segment.count(QUOTE)


def kinds() -> Memo:
    """Whether a word may be one of a family's."""
    return Memo(lambda w: _latin(w) or _mashed(w))


def family_of(segment: str, suspect: Memo) -> str | None:
    """``family`` after a cheap test: of a family's segments a word stands twice, or two of the first four are of the family's kind."""
    s = segment.split(" ")
    n = len(s)
    if sum(map(suspect.__getitem__, s[:4])) >= min(2, n) or (n > 3 and len(set(s)) <= 0.5 * n + 1):
        return family(s)
    return None


def read(text: str, memo: Memo, suspect: Memo) -> list[tuple[str, int, list[str]]]:
    """(text, words, tokens) of a text's segments; the text of one of a family is the family's name, of one with a quote empty: what
    is quoted is shown or discussed."""
    out = []
    for s in masked(text, memo):
        f = family_of(s, suspect)
        out.append((f, size(s), [f]) if f else ("" if QUOTE in s else s, size(s), s.split(" ")))
    return out
