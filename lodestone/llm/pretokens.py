"""Splitting text as byte-level tokenizers do, before any merge."""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

#: Letters and numbers among U+0000 to U+024F, as Unicode's L and N have them (fixed values).
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼-¾"
#: White space among them, as the pattern libraries of the tokenizers have it.
SPACES = "\t\n\x0b\x0c\r \x85\xa0"

_beyond = re.compile("[^\x00-ɏ]|[\x1c-\x1f]")


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """A function that returns a text's pre-tokens by ``pattern``.

    Texts of Latin letters alone take the standard library's faster engine with the classes written out;
    all others take the general one. Both give the same parts.
    """
    general = regex.compile(pattern).findall
    latin = re.compile(pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{SPACES}{LETTERS}{NUMBERS}]").replace(r"\p{L}", f"[{LETTERS}]").replace(r"\p{N}", f"[{NUMBERS}]").replace(r"\s", f"[{SPACES}]").replace(r"\S", f"[^{SPACES}]")).findall
    beyond = _beyond.search
    return lambda text: general(text) if beyond(text) else latin(text)


class Generations(dict):
    """A cache of bounded size: what was not used since the last turn goes when it is full."""

    def __init__(self, make: Callable, most: int = 300_000) -> None:
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        found = self.old.pop(key, None)
        if found is None:
            found = self.make(key)
        if not isinstance(key, str) or len(key) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = found
        return found
