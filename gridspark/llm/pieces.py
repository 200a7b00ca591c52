"""A fixed public piece vocabulary: matches of its pieces in words, by an Aho-Corasick automaton.

A text is read as the tokenizer reads it: a mark is put before it and spaces become marks. No piece
has a mark after another character, so a segmentation never crosses from one word to the next, and whatever
is summed or maximised over segmentations is computed once for each distinct word.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import numpy as np

MARK = "▁"
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Below the least score, for a character that no piece covers.
UNKNOWN_PENALTY = 10.0
#: Words that a worker remembers, and the length up to which it does.
CACHE, CACHE_LENGTH = 400_000, 48


def words_of(text: str) -> list[str]:
    """The words of a text, each without its first mark."""
    if "  " in text or MARK in text or text[:1] == " " or text[-1:] == " ":
        return [w[1:] for w in _WORDS.findall(MARK + text.replace(" ", MARK))]
    return text.split(" ") if text else []


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.scores = np.array([sp.get_score(i) for i in range(n)])
        usual = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        if any(MARK in self.pieces[i].lstrip(MARK) for i in usual):
            raise ValueError("a piece crosses words")
        self.unknown_score = float(self.scores[usual].min()) - UNKNOWN_PENALTY
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.lengths = np.array([len(p) for p in self.pieces])
        self.singles = {self.pieces[i] for i in usual if len(self.pieces[i]) == 1}
        self.automaton = ahocorasick.Automaton()
        for i in usual:
            self.automaton.add_word(self.pieces[i], i)
        self.automaton.make_automaton()

    def __len__(self) -> int:
        return len(self.pieces)

    def byte_ids(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8", "replace") if b in self.bytes]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)
