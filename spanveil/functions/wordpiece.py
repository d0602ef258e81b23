"""WordPiece with source offsets: token spans in UTF-16 units of the text as it was given, not as it was normalised."""

from __future__ import annotations

import json
import unicodedata
from dataclasses import dataclass, field
from itertools import accumulate

import regex

CLUSTER = regex.compile(r"\X")
PRETOKEN = regex.compile(r"[\p{P}$+<=>^`|~]|[^\s\p{P}$+<=>^`|~]+")


def composed(text: str) -> tuple[str, list[tuple[int, int]]]:
    """NFC of a text, and for each of its characters the range of code points it came from.

    A composed character covers every source character that gave it a part; as canonical order may
    move marks, ranges need not rise.
    """
    out, ranges = [], []
    for cluster in CLUSTER.finditer(text):
        at, raw = cluster.start(), cluster[0]
        normal = unicodedata.normalize("NFC", raw)
        if normal == raw:
            ranges += [(at + i, at + i + 1) for i in range(len(raw))]
        else:
            parts = [(a, at + i) for i, c in enumerate(raw) for a in unicodedata.normalize("NFD", c)]
            for c in normal:
                places = []
                for a in unicodedata.normalize("NFD", c):
                    k = next(k for k, (b, _) in enumerate(parts) if a == b)
                    places.append(parts.pop(k)[1])
                ranges.append((min(places), max(places) + 1))
        out.append(normal)
    return "".join(out), ranges


@dataclass
class WordPiece:
    vocabulary: dict[str, int]
    unknown: str = "[UNK]"
    first: str = "[CLS]"
    last: str = "[SEP]"
    prefix: str = "##"
    longest: int = 100
    added: list[str] = field(default_factory=list)

    def __post_init__(self):
        for name in (self.unknown, self.first, self.last):
            if name not in self.vocabulary:
                raise ValueError(f"the vocabulary lacks {name}")
        names = sorted(self.added, key=len, reverse=True)
        self.literal = regex.compile("|".join(map(regex.escape, names))) if names else None

    @classmethod
    def read(cls, path: str) -> WordPiece:
        """From a tokenizer file, refused if it isn't NFC, BERT pre-tokens and WordPiece."""
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        kinds = [(data.get(k) or {}).get("type") for k in ("normalizer", "pre_tokenizer", "model")]
        if kinds != ["NFC", "BertPreTokenizer", "WordPiece"]:
            raise ValueError(f"unsupported tokenizer: {kinds}")
        model = data["model"]
        return cls(model["vocab"], model["unk_token"], prefix=model.get("continuing_subword_prefix", "##"), longest=model.get("max_input_chars_per_word", 100), added=[t["content"] for t in data.get("added_tokens", [])])

    def _word(self, word: str) -> list[tuple[int, int, int]]:
        """(id, start, stop) of a word's pieces, longest first; one unknown piece if any part is unknown."""
        out, at = [], 0
        while at < len(word) and len(word) <= self.longest:
            stop = next((s for s in range(len(word), at, -1) if (self.prefix if at else "") + word[at:s] in self.vocabulary), 0)
            if not stop:
                break
            out.append((self.vocabulary[(self.prefix if at else "") + word[at:stop]], at, stop))
            at = stop
        return out if word and at == len(word) else [(self.vocabulary[self.unknown], 0, len(word))]

    def _plain(self, text: str, base: int) -> list[tuple[int, int, int]]:
        normal, ranges = composed(text)
        out = []
        for m in PRETOKEN.finditer(normal):
            for i, a, b in self._word(m[0]):
                own = ranges[m.start() + a : m.start() + b]
                out.append((i, base + min(x for x, _ in own), base + max(y for _, y in own)))
        return out

    def encode(self, text: str) -> list[tuple[int, int, int]]:
        """(id, start, stop) of a text's tokens, without the model's start and end tokens."""
        out, at = [], 0
        for m in self.literal.finditer(text) if self.literal else ():
            out += self._plain(text[at : m.start()], at)
            out.append((self.vocabulary[m[0]], m.start(), m.end()))
            at = m.end()
        out += self._plain(text[at:], at)
        units = [0, *accumulate(1 + (c > "￿") for c in text)]
        return [(i, units[a], units[b]) for i, a, b in out]
