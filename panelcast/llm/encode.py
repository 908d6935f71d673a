"""Token ids by the tokenizers library, word by word with a bounded memory of words already encoded.

Text repeats its words, so most of the library's work is asked for again and again. Where the tokenizer's
own rules say that words are encoded one by one, each distinct word goes through the library once per worker
and the ids of a text are joined from them. Other tokenizers get whole texts.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from functools import lru_cache

#: Words held per generation; two generations are alive, the older one is dropped when the newer is full.
REMEMBERED = 450_000
#: Longer words are encoded afresh each time.
LONGEST = 64

#: A space between two characters that are not white space: byte-level words always begin there.
BOUNDARY = re.compile(r"(?<=\S) (?=\S)")


#: Bytes that stand for themselves in byte-level vocabularies.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a vocabulary file: itself if printed, else the next from 256 on."""
    spare = iter(range(256, 512))
    printed = set(PRINTED)
    return [chr(byte if byte in printed else next(spare)) for byte in range(256)]


class Memory(dict):
    """Word -> ids as little-endian unsigned 32-bit numbers, or None where a word can't stand alone.

    A line break between words, and a mark after what is a letter once normalised, are always tokens of their own, so words
    are looked up without them. Only letters that every version of Unicode has always counted as such are taken for one.
    """

    MARKS = frozenset(",.;:!?")

    def __init__(self, encode, stands_alone, letters=None, remembered: int = REMEMBERED):
        super().__init__()
        self.encode, self.stands_alone, self.older, self.remembered = encode, stands_alone, {}, remembered
        self.letters = letters or encode
        self.line_break = encode("\n")

    def __missing__(self, word: str) -> bytes | None:
        ids = self.older.get(word)
        if ids is None:
            letters = word[1:]
            if letters.isalpha() and (word[0] == " " or word[0].isalpha()):
                ids = self.letters(word)
            else:
                ids = self.parts(word)
        if len(self) >= self.remembered:
            self.older = dict(self)
            self.clear()
        if len(word) <= LONGEST:
            self[word] = ids
        return ids

    def parts(self, word: str) -> bytes | None:
        if word[-1:] in self.MARKS and word[1:-1].isalpha() and (word[0] == " " or word[0].isalpha()):
            # The lower case of a capital I with a dot ends in a combining dot, which goes with the mark.
            end = unicodedata.normalize("NFC", word[:-1]).lower()[-1]
            if end < "\u0530" and end.isalpha():
                return self[word[:-1]] + self[word[-1]]
        if not self.stands_alone(word):
            return None
        before, line, after = word.partition("\n")
        if line and after[:1].isalpha() and before and not before[-1].isspace():
            first, second = self[before], self[after]
            return None if first is None or second is None else first + self.line_break + second
        return self.encode(word)


class Encoder:
    """``encode(text)`` gives the ids of the library's ``encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        with open(path, encoding="utf-8") as file:
            self.kind = _kind(json.load(file))
        if self.kind == "spaced":
            self.memory = Memory(self.whole, stands_alone, self.word, remembered)
        elif self.kind == "dropped":
            self.memory = Memory(self.whole, lambda word: True, self.word, remembered)

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def word(self, word: str) -> bytes:
        """Ids of letters, perhaps after a space. Latin ones need none of the rules around the library's model, which cost most of its time."""
        if max(word) > "\xff":
            return self.whole(word)
        plain = word if self.kind == "spaced" else word.lower()
        symbols = plain if word.isascii() else plain.encode().decode("latin-1")
        return array("I", [token.id for token in self.model.tokenize(symbols.translate(self.letters))]).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if self.kind == "dropped":
            return b"".join(map(self.memory.__getitem__, text.split(" ")))
        if self.kind == "spaced":
            try:
                return b"".join(map(self.memory.__getitem__, spaced_words(text)))
            except TypeError:  # white space beside a space: fewer places to cut
                found = ((word, self.memory[word]) for word in safe_words(text))
                return b"".join(self.whole(word) if ids is None else ids for word, ids in found)
        return self.whole(text)


def stands_alone(word: str) -> bool:
    """Whether no white space but one leading space touches the ends of a word."""
    return not (word[-1:].isspace() or word[1:2].isspace() and word[:1] == " " or word[:1] != " " and word[:1].isspace())


def spaced_words(text: str) -> list[str]:
    """The text cut before every space; its words, joined, are the text."""
    if "\0" in text:
        parts = text.split(" ")
        return parts[:1] + [" " + part for part in parts[1:]]
    return text.replace(" ", "\0 ").split("\0")  # faster than putting the spaces back one by one


def safe_words(text: str) -> list[str]:
    """The text cut only before spaces that touch no other white space."""
    parts = BOUNDARY.split(text)
    return parts[:1] + [" " + part for part in parts[1:]]


def _kind(rules: dict) -> str:
    """How words stand apart: "spaced" takes its leading space along, "dropped" loses white space, else "whole"."""
    before, normal = rules.get("pre_tokenizer") or {}, rules.get("normalizer")
    added = rules.get("added_tokens") or []
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"]) for t in added)
    if not plain or (rules.get("model") or {}).get("type") != "BPE":
        return "whole"
    if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and normal is None:
        return "spaced"
    steps = [step.get("type") for step in (normal or {}).get("normalizers", [])]
    cuts = before.get("pretokenizers") or [{}]
    drops = cuts[0].get("type") == "Split" and cuts[0].get("behavior") == "Removed" and cuts[0].get("invert")
    if steps == ["NFC", "Replace", "Lowercase"] and drops and "[^\\s" in str(cuts[0]["pattern"].get("Regex")):
        return "dropped"
    return "whole"


@lru_cache(maxsize=2)
def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    """One encoder per worker process, file and bound of words held."""
    return Encoder(path, remembered)
