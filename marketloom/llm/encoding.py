"""Token ids of whole texts with a public tokenizer, reusing what was encoded before.

Both tokenizers in use never join characters across a lone space or line feed, so a text is cut there and each
distinct piece is encoded once by the library. A text with any other white space, or two in a row, goes to
the library whole. Either way the ids are those of the library on the whole text.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

CACHE = 400_000  # pieces in each of a worker's two generations, about 200 bytes each
SLICE = 1_000_000  # characters encoded at once
LETTERS_MARKS = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]*)")
_LOADED: dict[str, ChunkEncoder] = {}


def byte_letters() -> dict[int, str]:
    """Fixed values of byte-level vocabularies: printable bytes stand for themselves, the others for letters from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ChunkEncoder:
    """Keys of the cache are pieces without the space before them; one after a line feed has that, a text's first one has NUL."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        # A byte-level tokenizer ties a space to the word after it; the other one drops white space.
        self.spaced = self.tokenizer.encode(" a", add_special_tokens=False).ids != self.tokenizer.encode("a", add_special_tokens=False).ids
        self.folds = self.library(["Aé"]) == self.library(["aÉ"])
        self.letters = byte_letters()
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        self.feed = self.library(["\n"])[0]
        self.odd: set[str] = set()  # pieces with other white space in them

    def library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def word(self, letters: str, space: bool) -> bytes:
        """A run of Latin letters, perhaps after a space: one unit of the vocabulary's merges, so normalising is not needed."""
        text = (" " + letters if space else letters) if self.spaced else letters.lower()
        text = text.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(text)]).tobytes()

    def learn(self, pieces: list[str]) -> None:
        """Encode unseen pieces; Latin letters, perhaps before ASCII marks, by the merges alone, any other by the whole library."""
        known, old, rest = self.known, self.old, []
        for p in pieces:
            lead = p[0] if self.spaced and p[0] in "\n\0" else ""
            m = LETTERS_MARKS.fullmatch(p, len(lead))
            letters = m and m[1]
            if not (letters and (letters.isascii() or max(letters) < "̀" and (self.spaced or letters.lower().isalpha()))):
                rest.append(p)
                continue
            body, marks = lead + letters, m[2]
            ids = known.get(body) or old.get(body)
            if ids is None:
                ids = known[body] = (self.feed if lead == "\n" else b"") + self.word(letters, not lead)
            if marks not in self.marks:
                if len(self.marks) > CACHE // 8:
                    self.marks = {"": b""}
                self.marks[marks] = self.library([marks])[0]
            known[p] = ids + self.marks[marks]
        for p in rest:
            if p[p[0] in "\n\0" :].split() != [p[p[0] in "\n\0" :]]:
                self.odd.add(p)
        for at in range(0, len(rest), 8192):
            part = rest[at : at + 8192]
            known.update(zip(part, self.library([p if p[0] == "\n" else p[1:] if p[0] == "\0" else " " + p for p in part] if self.spaced else part)))

    def each(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null is empty. Holds those of SLICE characters at a time."""
        part, size = [], 0
        for t in texts:
            part.append(t)
            size += len(t or "")
            if size > SLICE:
                yield from self.slice(part)
                part, size = [], 0
        yield from self.slice(part)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return list(self.each(texts))

    def slice(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > CACHE:
            self.known, self.old = {}, {p: x for p, x in self.known.items() if p not in self.odd}
            self.odd = set()
        out: list[bytes] = [b""] * len(texts)
        cut: list[tuple[int, list[str], list, list[int]]] = []  # place, pieces, their ids, places of unseen ones
        whole: list[int] = []
        get, new = self.known.get, set()
        for i, t in enumerate(texts):
            if not t:
                continue
            if "\0" in t or "  " in t or " \n" in t or "\n " in t or "\n\n" in t or t[0].isspace() or t[-1].isspace():
                whole.append(i)
                continue
            if not self.spaced and self.folds:
                try:  # letters up to U+00FF have one lower case, so cased forms share an entry
                    t.encode("latin-1")
                    t = t.lower()
                except UnicodeEncodeError:
                    pass
            words = ("\0" + t.replace("\n", " \n") if self.spaced else t.replace("\n", " ")).split(" ")
            ids, unseen, at = list(map(get, words)), [], -1
            try:
                while True:
                    at = ids.index(None, at + 1)
                    unseen.append(at)
            except ValueError:
                cut.append((i, words, ids, unseen))
            new.update([words[k] for k in unseen])
        for w in [w for w in new if w in self.old] if self.old else ():
            self.known[w] = self.old[w]
            new.discard(w)
        self.learn(list(new))
        for i, words, ids, unseen in cut:
            if self.odd and not self.odd.isdisjoint(words):
                whole.append(i)
                continue
            for k in unseen:
                ids[k] = get(words[k])
            out[i] = b"".join(ids)
        for i, ids in zip(whole, self.library([texts[i] for i in whole])):
            out[i] = ids
        return out


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each vocabulary file and worker."""
    if path not in _LOADED:
        _LOADED[path] = ChunkEncoder(path)
    return _LOADED[path]
