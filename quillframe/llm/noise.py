"""What scanning does to characters: the confusions, a fold that undoes them, and the shape of tokens."""

from __future__ import annotations

import functools
import re

#: (as printed, as read) pairs that recognition engines are known to confuse, in lower case.
CONFUSIONS = (
    ("e", "c"), ("a", "@"), ("t", "f"), ("s", "5"), ("i", "!"), ("n", "ri"), ("l", "|"), ("l", "1"), ("o", "0"),
    ("d", "cl"), ("m", "rn"), ("u", "ii"), ("ü", "ii"), ("g", "9"), ("h", "b"), ("f", "t"), ("b", "6"), ("é", "6"),
    ("ö", "6"), ("ó", "6"), ("w", "vv"), ("rn", "m"), ("i", "1"), ("i", "l"), ("t", "7"), ("b", "8"), ("z", "2"),
    ("s", "$"), ("q", "9"), ("i", "|"), ("l", "!"), ("g", "q"), ("o", "6"), ("s", "8"), ("y", "v"),
)

#: Letters that stand for digits inside a number.
DIGIT_LETTERS = "OoQDIl|!iZzSsbGBgqAT"

_SINGLE = str.maketrans(
    {
        "0": "o", "1": "l", "!": "l", "|": "l", "i": "l", "5": "s", "$": "s", "6": "b", "8": "b", "h": "b", "@": "a",
        "9": "g", "q": "g", "7": "t", "f": "t", "e": "c", "2": "z", "3": "c", "4": "a", "é": "c", "è": "c", "ê": "c",
        "ü": "u", "ö": "o", "ó": "o", "ô": "o", "ä": "a", "á": "a", "à": "a", "â": "a", "í": "l", "ï": "l", "ú": "u",
        "ñ": "n", "ç": "c", "ß": "b",
    }
)
_NUMBER = re.compile(rf"(?=[^\W_]*[\d{DIGIT_LETTERS}])[\d{re.escape(DIGIT_LETTERS)}]*\d[\d{re.escape(DIGIT_LETTERS)}.,]*")
TOKEN = re.compile(r"\S+")


@functools.lru_cache(1 << 17)
def fold(word: str) -> str:
    """One form for a word and all its misreadings: words that scanning may confuse fold to the same string."""
    word = word.lower().translate(_SINGLE)
    before = ""
    while before != word:  # "rri" is an m read in two steps
        before = word
        for many, one in (("rn", "m"), ("vv", "w"), ("cl", "d"), ("rl", "n"), ("ll", "u")):
            word = word.replace(many, one)
    return word


_READ: dict[str, list[str]] = {}
for _printed, _read in CONFUSIONS:
    _READ.setdefault(_read, []).append(_printed)


def confusions(seen: str, meant: str, most: int = 4) -> int | None:
    """The least number of confusions that turn ``meant`` into ``seen``; None if more than ``most`` or impossible."""
    best = {(0, 0): 0}
    queue = [(0, 0)]
    while queue:
        i, j = queue.pop()
        cost = best[i, j]
        steps = []
        if i < len(seen) and j < len(meant) and seen[i] == meant[j]:
            steps.append((i + 1, j + 1, cost))
        if cost < most:
            for read in (seen[i : i + 1], seen[i : i + 2]):
                for printed in _READ.get(read, ()) if read else ():
                    if meant.startswith(printed, j):
                        steps.append((i + len(read), j + len(printed), cost + 1))
        for a, b, c in steps:
            if c < best.get((a, b), most + 1):
                best[a, b] = c
                queue.append((a, b))
    return best.get((len(seen), len(meant)))


def number_like(token: str) -> bool:
    """Digits with separators, possibly with letters that scanning puts in place of digits."""
    core = token.strip(".,;:()[]%€$")
    return bool(core) and bool(_NUMBER.fullmatch(core)) and sum(c.isdigit() for c in core) * 2 >= len(core.replace(",", "").replace(".", ""))


@functools.lru_cache(1 << 17)
def shape(token: str) -> str:
    """A token without case, noise and edge punctuation; numbers become ``#``."""
    if number_like(token):
        return "#"
    core = token.strip(".,;:!?()[]“”\"'’")
    return fold(core) if core else token
