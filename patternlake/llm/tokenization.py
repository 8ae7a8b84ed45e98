"""Exact tokenizer ids at the cost of a dictionary look-up a word.

Both tokenizers split at white space before they merge, so the ids of a text are the ids of its chunks joined. Each
distinct chunk goes to the tokenizers library once and is then kept. Texts with characters on whose class the
libraries might differ (controls, odd spaces, unassigned) are encoded whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable
from functools import lru_cache

KEEP = 400_000  # chunks of a table's newer half; the older half is dropped once the newer is full
#: What may follow a word in its chunk without any ado.
MARKS = ".,;:!?*$%&#|)"
#: With a leading space a chunk keeps it; of a run of white space the last character goes to what follows.
SPACED = re.compile(r" ?\S+|\s+(?!\S)|\s+")


def resolve(tokenizer: str) -> str:
    """A path stays; a bare name is looked up among the installed public tokenizers."""
    if "/" in tokenizer:
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


def byte_letters() -> dict[int, str]:
    """The letters by which byte-level BPE writes bytes: printable ones are themselves, the rest follow from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


def latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Known(dict):
    """Ids of chunks, made when first asked for."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make, self.old = make, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.make(chunk)
        self[chunk] = ids
        return ids

    def age(self) -> None:
        if len(self) > KEEP:
            self.old = dict(self)
            self.clear()


class ChunkEncoder:
    """spaces: whether words carry the space before them (byte-level BPE), or white space and case are dropped (word BPE)."""

    def __init__(self, tokenizer: str, spaces: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(resolve(tokenizer))
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model, self.spaces, self.letters = self.tokenizer.model, spaces, byte_letters()
        self.first = Known(lambda chunk: self._chunk("", chunk, self.first))
        self.inner = Known(lambda chunk: self._chunk(" ", chunk, self.inner)) if spaces else self.first

    def _whole(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _chunk(self, lead: str, chunk: str, known: Known) -> bytes:
        word = chunk.rstrip(MARKS)
        if not word.isalpha() or not word.isascii() and max(word) > "\xff":
            return self._whole(lead + chunk)
        if word != chunk:
            return known[word] + self.first[chunk[len(word) :]]
        text = word if self.spaces else word.lower()
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(self.letters[32] + text if lead else text)]).tobytes()

    def _encode(self, text: str) -> bytes:
        if not text.replace("\n", "").isprintable():
            return self._whole(text)
        if not self.spaces:
            if text.isascii() or latin(text):
                text = text.lower()  # once for all words; of other letters, lower case may differ from the library's
            return b"".join(map(self.first.__getitem__, text.split()))
        if not text or text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text or "\n\n" in text:
            return b"".join(self.inner[c[1:]] if c[0] == " " and len(c) > 1 and not c.isspace() else self.first[c] for c in SPACED.findall(text))
        out, inner, line_end = [], self.inner.__getitem__, self.first["\n"]
        for line in text.split("\n"):
            chunks = line.split(" ")
            out.append(self.first[chunks[0]])
            out += map(inner, chunks[1:])
            out.append(line_end)
        return b"".join(out[:-1])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null counts as empty."""
        out = []
        for text in texts:
            self.inner.age()
            self.first.age()
            out.append(self._encode(text or ""))
        return out


@lru_cache(maxsize=2)
def encoder(tokenizer: str, spaces: bool) -> ChunkEncoder:
    """One for each worker process: it outlives a task."""
    return ChunkEncoder(tokenizer, spaces)
