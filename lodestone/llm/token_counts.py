"""Token counts: prefix dynamic programming over byte-level BPE.

For each byte prefix of a pre-token the table holds the last token of that prefix's encoding; the exact
token count of the prefix is one more than that of the prefix before that token. A token may end a prefix
if it and the last token of what is before it encode to themselves side by side; exactly one candidate
does. A text's prefix counts are then running sums over its pre-tokens, from which any truncation or
budget question is answered without encoding again: a cut within a pre-token reads that pre-token's table, and only cuts
within its first characters, which may change how the text before is split, are split anew.

Null text counts as empty. A pre-token's table takes time in proportion to its bytes, however long it is; a text is held
whole by its task.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .pretokens import Generations, splitter
from .words import small_batches, texts_of

#: Characters of a pre-token within which a cut may change how the text before it is split: a blank and a contraction.
EDGE = 4
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, limit_chars long"


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Exact token counts of prefixes under the vocabulary of a byte-level BPE file."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        self.ids = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if all(c in letters for c in t)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        vocab = spec["model"]["vocab"]
        self.merges = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(pairs)}
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(pairs):
            self.made.setdefault(vocab[a + b], (r, vocab[a], vocab[b]))
        self.endless = len(pairs)
        self.left_spines, self.right_spines = Generations(lambda t: self._spine(t, 0)), Generations(lambda t: self._spine(t, 1))
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        for s in special:  # names like <|end|> hold only printable ASCII, so they also stand in the vocabulary
            self.ids.pop(s.encode(), None)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.split = splitter(pattern)
        self.ending = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.ending.add_word(token.decode("latin-1"), (len(token), i))
        self.ending.make_automaton()
        self.beside: dict[tuple[int, int], bool] = {}
        self.prefixes = Generations(self._prefixes)

    def _spine(self, token: int, side: int) -> tuple[list[int], list[int]]:
        """Tokens along the first or last bytes of a token, smallest first, and the ranks at which each is absorbed by the next."""
        nodes, ranks = [token], [self.endless]
        while (made := self.made.get(nodes[-1])) is not None:
            nodes.append(made[1 + side])
            ranks.append(made[0])
        return nodes[::-1], ranks[::-1]

    def side_by_side(self, a: int, b: int) -> bool:
        """Whether two tokens encode to themselves side by side: no merge across their border comes first.

        The tokens at the border grow along the right edge of one and the left edge of the other. A merge of
        the two comes before the left one grows if its rank is lower, and before the right one does if it is not higher.
        """
        known = self.beside.get((a, b))
        if known is None:
            if len(self.beside) > 500_000:
                self.beside.clear()
            (left, grow), (right, widen) = self.right_spines[a], self.left_spines[b]
            i = j = 0
            known = True
            while True:
                across = self.merges.get((left[i], right[j]))
                if across is not None and across < grow[i] and across <= widen[j]:
                    known = False
                    break
                if grow[i] == widen[j] == self.endless:
                    break
                if grow[i] <= widen[j]:
                    i += 1
                else:
                    j += 1
            self.beside[a, b] = known
        return known

    def _prefixes(self, piece: str) -> list[int]:
        """Token counts of the byte prefixes of a pre-token, the empty one first."""
        raw = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        last, count = [-1] * (len(raw) + 1), [0] * (len(raw) + 1)
        for end, (size, token) in self.ending.iter(raw):  # at each end the longest token first
            i = end + 1
            if not count[i] and (size == i or self.side_by_side(last[i - size], token)):
                last[i], count[i] = token, count[i - size] + 1
        return count

    def parts(self, text: str) -> list[tuple[str, bool]]:
        """A text's pre-tokens and special strings in order, with whether each is special."""
        if not self.special or "<" not in text and not self.special.search(text):
            return [(p, False) for p in self.split(text)]
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [*((p, False) for p in self.split(text[at : m.start()])), (m[0], True)]
            at = m.end()
        return out + [(p, False) for p in self.split(text[at:])]

    def count(self, text: str) -> int:
        if self.special and self.special.search(text):
            return sum(1 if s else self.prefixes[p][-1] for p, s in self.parts(text))
        known = self.prefixes
        return sum([known[p][-1] for p in self.split(text)])

    def index(self, text: str) -> PrefixIndex:
        return PrefixIndex(self, text, self.parts(text))

    def measure(self, text: str, budget: int) -> tuple[int, int]:
        """Tokens of a text, and the characters that fit a budget."""
        if self.special and self.special.search(text):
            index = self.index(text)
            return index.tokens[-1], index.fitting(budget)
        known = self.prefixes
        parts = self.split(text)
        counts = [known[p][-1] for p in parts]
        n = sum(counts)
        if n <= budget:
            return n, len(text)
        k = bisect_right([*accumulate(counts)], budget) + 2  # the part in which the budget is passed, and the one after
        return n, PrefixIndex(self, text, [(p, False) for p in parts[:k]]).fitting(budget)


class PrefixIndex:
    """Answers of one text: token counts of its prefixes, and the prefix that fits a budget."""

    def __init__(self, counter: PrefixCounter, text: str, parts: list[tuple[str, bool]]) -> None:
        self.counter, self.text, self.parts = counter, text, parts
        self.chars = [0, *accumulate(len(p) for p, _ in self.parts)]
        self.tokens = [0, *accumulate(1 if s else counter.prefixes[p][-1] for p, s in self.parts)]
        self.open, self.by_char = -1, []

    def count(self, chars: int) -> int:
        """Tokens of text[:chars], as if that prefix were encoded alone."""
        k = min(bisect_right(self.chars, chars), len(self.parts)) - 1
        if k < 0:
            return 0
        inside = chars - self.chars[k]
        if inside > EDGE and not self.parts[k][1]:
            return self.tokens[k] + self.table(k)[inside]
        return self._split_anew(chars)

    def table(self, k: int) -> list[int]:
        """Token counts of the prefixes of a pre-token, by characters."""
        if self.open != k:
            piece = self.parts[k][0]
            by_byte = self.counter.prefixes[piece]
            self.open = k
            self.by_char = by_byte if piece.isascii() else [by_byte[n] for n in accumulate((len(c.encode("utf-8", "surrogatepass")) for c in piece), initial=0)]
        return self.by_char

    def _split_anew(self, chars: int) -> int:
        """For cuts beside the border of two parts: a cut may part a contraction or end white space, so those beside it are split again."""
        k = bisect_right(self.chars, chars) - 1
        while k and (k >= len(self.parts) or self.chars[k] > 0) and (self.text[self.chars[k] - 1 : self.chars[k]].isspace() or self.chars[k] == chars or (k < len(self.parts) and self.text[self.chars[k] : self.chars[k] + 1].isspace())):
            k -= 1
            if not self.text[self.chars[k] : self.chars[k + 1]].isspace():
                break
        return self.tokens[k] + self.counter.count(self.text[self.chars[k] : chars])

    def fitting(self, budget: int) -> int:
        """Characters of the longest prefix, up to the part in which the budget is passed, with at most ``budget`` tokens.

        Counts of prefixes may fall as a prefix grows, so the table of the part is read from its end.
        """
        if self.tokens[-1] <= budget:
            return len(self.text)
        k = bisect_right(self.tokens, budget) - 1
        start, size = self.chars[k], self.chars[k + 1] - self.chars[k]
        if not self.parts[k][1] and size > EDGE:
            table, room = self.table(k), budget - self.tokens[k]
            for inside in range(size, EDGE, -1):
                if table[inside] <= room:
                    return start + inside
            size = EDGE
        for inside in range(size, 0, -1):
            if self.count(start + inside) <= budget:
                return start + inside
        return start


@lru_cache(2)
def counter(path: str, pattern: str) -> PrefixCounter:
    return PrefixCounter(path, pattern)


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int) -> DataFrame:
    """For each text its bytes, its tokens, whether they pass ``limit``, and the characters that fit it.

    Nulls count as empty; repeated rows give repeated rows; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path, pattern)
        for b in batches:
            out: list[tuple[int, int, bool, int]] = []
            for text in (t or "" for t in b.column("text").to_pylist()):
                n, fit = own.measure(text, limit)
                out.append((len(text.encode("utf-8", "surrogatepass")), n, n > limit, fit))
            size, n, over, fit = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(over, pa.bool_()), pa.array(fit, pa.int64())], names=["doc_id", "n_bytes", "n_tokens", "over_limit", "limit_chars"])

    return texts_of(docs).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, 512)
