"""Token ids of whole texts with a tokenizers file, word by word from a memo.

Both tokenizer kinds used here split texts into words before any merge, so a word's ids do not depend on its
neighbours, and a closing full stop or comma after a letter is a piece of its own; the library is asked once per letter
whether it is, as lower-casing leaves a combining mark after some. Texts with white space other than single spaces and single
line ends, and texts in which an added token of the vocabulary stands, go to the library whole.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable
from itertools import accumulate, chain, compress, filterfalse

import numpy as np

from .common import kept, one_thread

#: Words that a worker keeps, some 200 bytes each.
WORDS = 1_200_000
#: White space other than the space and the line end, in any reading of the term.
_CODES = [*range(0x09, 0x0A), *range(0x0B, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]
_ODD = re.compile("[" + "".join(map(chr, _CODES)) + "]")


class WordMemo(dict):
    """word -> id bytes, with a prefix before the word. Keeps up to `cap` words; others are looked up in `new`, made batch by batch."""

    def __init__(self, encode, prefix: str, cap: int):
        super().__init__()
        self.encode, self.prefix, self.cap, self.new = encode, prefix, cap, {}
        self.apart: dict[str, bool] = {}

    def _closes(self, word: str) -> bool:
        """Whether a full stop or comma after the last letter is a piece of its own."""
        if not word.endswith((".", ",")) or not word[-2:-1].isalpha():
            return False
        end = word[-2:]
        if end not in self.apart:
            heads = [end[0], f"a{end[0]}", f"A{end[0]}"]
            *own, mark = self.encode([*heads, end[1]], "")
            self.apart[end] = self.encode([h + end[1] for h in heads], "") == [x + mark for x in own]
        return self.apart[end]

    def learn(self, words: set[str], made: dict[str, bytes]) -> None:
        """Ids of words that are not kept, beside those made elsewhere."""
        words = list(filterfalse(self.__contains__, words))
        closed = list(filter(self._closes, words))
        stems = set(words).difference(closed)
        stems.update(filterfalse(self.__contains__, [w[:-1] for w in closed]))
        if _ODD.search(" ".join(stems)):
            stems = {s for s in stems if not _ODD.search(s)}
        found = dict(zip(stems, self.encode(list(stems), self.prefix), strict=True))
        ends = {e: self.encode([e], "")[0] for e in ".,"}
        for w in closed:
            stem = found.get(w[:-1]) or self.get(w[:-1])
            if stem is not None:
                found[w] = stem + ends[w[-1]]
        found |= made
        if len(self) + len(found) <= self.cap:
            self.update(found)
            self.new = {}
        else:
            self.new = found

    def __missing__(self, word: str) -> bytes | None:
        """None if the word holds white space: its text has to be encoded whole."""
        return self.new.get(word)


def single_pieces(tokenizer):
    """The merges of one piece by tiktoken, for byte-level vocabularies whose ids follow the order of the merges; else none."""
    import tiktoken

    kind = json.loads(tokenizer.to_str())
    model = kind["model"]
    pre = kind["pre_tokenizer"] or {}
    merges = [m if isinstance(m, str) else " ".join(m) for m in model.get("merges", [])]
    plain = pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"] and not kind["normalizer"]
    if not plain or model.get("end_of_word_suffix") or any(model["vocab"].get(m.replace(" ", "")) != 256 + i for i, m in enumerate(merges)):
        return None
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves in a byte-level vocabulary
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    ranks = {bytes(byte_of[c] for c in w): i for w, i in model["vocab"].items() if w not in special}
    return tiktoken.Encoding("pieces", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class WordIds:
    def __init__(self, file: str, cap: int = WORDS):
        one_thread()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with_space, without = self._bytes([" a b", "a b"])
        self.spaces_count = with_space != without  # whether a leading space is part of a word
        self.bare = WordMemo(self._words, "", cap if not self.spaces_count else cap // 8)
        self.spaced = WordMemo(self._words, " ", cap)
        self.piece = single_pieces(self.tokenizer) if self.spaces_count else None
        self.newline = self._bytes(["\n"])[0] if self.spaces_count else b""

    def _bytes(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str], prefix: str) -> list[bytes]:
        """Ids of words, each with the prefix before it. Letters alone are one piece, which needs the merges only."""
        if self.piece is None:
            return self._bytes([prefix + w for w in words] if prefix else words)
        one = list(map(str.isalpha, words))
        lead = prefix.encode()
        pieces = list(map(self.piece, [lead + x for x in map(str.encode, compress(words, one))]))
        flat = array("I", chain.from_iterable(pieces)).tobytes()
        ends = [0, *accumulate(4 * len(p) for p in pieces)]
        letters = map(flat.__getitem__, map(slice, ends, ends[1:]))
        others = iter(self._bytes([prefix + w for w, x in zip(words, one, strict=True) if not x]))
        return [next(letters) if x else next(others) for x in one]

    def encode(self, texts: list[str | None], end_id: int) -> list[np.ndarray]:
        """Ids of each text, then the end id."""
        end = np.array([end_id], "<u4").tobytes()
        memo, words_of = (self.spaced, self._by_line) if self.spaces_count else (self.bare, self._by_word)
        lists = [words_of(t) if t and not any(map(t.__contains__, self.added)) else None for t in texts]
        self._learn(set(filterfalse(memo.__contains__, set().union(*filter(None, lists)))))
        joined = [b"" if words is None else self._joined(map(memo.__getitem__, words)) for words in lists]
        out = []
        for t, ids in zip(texts, joined, strict=True):
            if ids:  # lines begin with their line end, and the first has none
                out.append(np.frombuffer(ids + end, "<u4", offset=len(self.newline)))
            else:
                out.append(np.frombuffer((self._bytes([t])[0] if t else b"") + end, "<u4"))
        return out

    def _learn(self, words: set[str]) -> None:
        if not self.spaces_count:
            self.bare.learn(words, {})
            return
        heads = {w for w in words if w[0] == "\n"}
        self.bare.learn({w[1:] for w in heads}, {})
        first = {w: self.bare[w[1:]] for w in heads}
        self.spaced.learn(words - heads, {w: self.newline + ids for w, ids in first.items() if ids is not None})

    @staticmethod
    def _joined(ids: Iterable[bytes | None]) -> bytes:
        """Empty if one of them is None."""
        try:
            return b"".join(ids)
        except TypeError:
            return b""

    def _by_word(self, text: str) -> list[str]:
        return text.replace("\n", " ").split(" ")

    def _by_line(self, text: str) -> list[str] | None:
        """The words of the text, the first of each line with a line end before it; none if white space comes in runs or at an end."""
        if any(map(text.__contains__, ("  ", " \n", "\n ", "\n\n"))) or text[0] in " \n" or text[-1] in " \n":
            return None
        return ("\n" + text.replace("\n", " \n")).split(" ")


def word_ids(file: str, cap: int = WORDS) -> WordIds:
    return kept(f"words {file} {cap}", lambda: WordIds(file, cap))
