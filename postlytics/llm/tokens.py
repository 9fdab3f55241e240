"""Token ids of texts by the tokenizers library, unit by unit.

A text is cut into units at borders that no token of the model reaches across; its
ids are those of its units one after another.  Each unit is encoded once and its
ids are kept as bytes in a bounded table of the Python worker; a text is then a
join of table entries."""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Callable

import numpy as np

ID = np.dtype("<u4")
assert sys.byteorder == "little" and array("I").itemsize == ID.itemsize


class UnitCache:
    """``encode(units)`` gives the ids of each unit, as little-endian 32-bit bytes;
    it is called with the distinct units that the table lacks.  A table that holds
    ``most`` units is put aside for a new one, which takes over what it needs of it."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], most: int = 150_000):
        self.encode, self.most, self.table, self.old = encode, most, {}, {}

    def ids(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of each text, given as its units."""
        if len(self.table) > self.most:
            self.table, self.old = {}, self.table
        table, old = self.table, self.old
        missing = []
        for unit in set().union(*texts).difference(table):
            if unit in old:
                table[unit] = old[unit]
            else:
                missing.append(unit)
        for at in range(0, len(missing), 10_000):
            part = missing[at:at + 10_000]
            table.update(zip(part, self.encode(part)))
        return [b"".join(map(table.__getitem__, units)) for units in texts]


_BORDER = re.compile(r"(?<=\S) ")
_ODD = re.compile(r"\s ")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_UNSURE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \t\n\v\f\r"]
FRONT = "\0"  # marks a unit without a space in front
MARKS = "!#$%&()*+,-./:;<=>?@[]^_{|}~"  # always cut off from a letter in front of them


def byte_level_alphabet() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if
    it is printable Latin-1, else the next character from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class ByteBpe(dict):
    """A byte-level tokenizers file as a table of units: what stands between spaces,
    with the space in front.  The models' pattern always cuts in front of a space
    that follows another character than white space, so a text's ids are those of
    its units.  A unit that the table lacks is encoded by the library: a word by its
    model alone (the pattern leaves it whole), a word and marks behind it as those
    two, both sides of a line end on their own, any other unit as a text.  A table that holds ``most`` units is put
    aside for a new one, which takes over what it needs of it."""

    def __init__(self, path: str, most: int = 350_000):
        super().__init__()
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model, self.alphabet = self.tok.model, byte_level_alphabet()
        self.most, self.old = most, {}

    def __missing__(self, unit: str) -> bytes:
        found = self.old.get(unit)
        if found is None:
            found = self.unit_ids(unit)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[unit] = found
        return found

    def unit_ids(self, unit: str) -> bytes:
        front = unit[:1] == FRONT
        word, space = (unit[1:], "") if front else (unit, " ")
        if word.isalpha():
            seen = (space + word).encode().decode("latin-1").translate(self.alphabet)
            return array("I", [t.id for t in self.model.tokenize(seen)]).tobytes()
        head, line_end, tail = word.partition("\n")
        if head and tail and not head[-1].isspace() and not tail[0].isspace():
            return self[unit[:front] + head] + self[FRONT + line_end] + self[FRONT + tail]
        stem = word.rstrip(MARKS)
        if len(stem) < len(word) and stem.isalpha():
            return self[unit[:front] + stem] + self[FRONT + word[len(stem):]]
        if not space + word:
            return b""
        return array("I", self.tok.encode(space + word, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        """The ids of a text, as little-endian 32-bit bytes."""
        units = _BORDER.split(text) if _ODD.search(text) else text.split(" ")
        units[0] = FRONT + units[0]
        return b"".join(map(self.__getitem__, units))


class WordBpe(ByteBpe):
    """A tokenizers file whose words end in a mark and which drops white space and
    capitals (splits at white space, then between letters, digits and other signs),
    as a table of units: what stands between white space.  White space has no
    canonical composition, so every unit is normalised as it is in the text.  A unit
    of plain letters is encoded by the model alone, letters and marks behind them as
    those two, any other unit as a text."""

    def unit_ids(self, unit: str) -> bytes:
        if unit.isalpha() and max(unit) <= "\xff":
            seen = unit.lower().encode().decode("latin-1").translate(self.alphabet)
            return array("I", [t.id for t in self.model.tokenize(seen)]).tobytes()
        stem = unit.rstrip(MARKS)
        if len(stem) < len(unit) and stem.isalpha():
            return self[stem] + self[unit[len(stem):]]
        return array("I", self.tok.encode(unit, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        # only what both Python and the file's pattern take for white space may part units
        units = _WORD.findall(text) if any(c in text for c in _UNSURE) else text.split()
        return b"".join(map(self.__getitem__, units))
