"""Whole texts to byte-level BPE ids, each distinct piece encoded once per worker.

A byte-level pre-tokenizer never joins a character that is not white space with a
space behind it, so a text may be cut in front of every such space. It may also be cut on both sides of a
line break that stands between other characters than white space, and between a letter and a mark with nothing but
white space behind it. The ids of a text are those of its pieces in a row. Pieces come back again and
again; their ids are kept.

A batch of texts is cut and its pieces are numbered by Arrow, so Python sees a piece once per batch
and not once per place; the ids of all places are gathered at once into one array.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# White space, of which Arrow's expressions know only the ASCII part by name.
WHITE = "\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
MARKS = ".,;:!?"

# Stands in front of a mark that is cut off; a text that holds it, or two white spaces side by side, is cut by CUT alone.
CUT_OFF = "\x01"
ODD = f"[{WHITE}] |[{WHITE}]\n|\n[{WHITE}]|{CUT_OFF}"
CUT = re.compile(r"(?<=\S)(?= )")
MARK_BEHIND = f"([{LETTERS}])([{MARKS}])( |\n|$)"

# Pieces that are one pre-token: a word of Latin letters, a mark, a line break.
WORD = re.compile(f" ?[{LETTERS}]+|[{MARKS}]|\n")
# A piece with one space, in front, and no other white space at its ends.
SINGLE = re.compile(r" [^\s]+(?:[^ ]*[^\s])?")
SENTENCE_END = (".", "!", "?")


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in the vocabulary: itself if it prints, else the next one from U+0100."""
    printing = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printing)
    return {b: chr(b) for b in printing} | {b: chr(256 + k) for k, b in enumerate(others)}


# The public format of byte-level vocabularies.
BYTE_CHARACTERS = _byte_characters()
SPACED = BYTE_CHARACTERS[32]


@dataclass(frozen=True)
class Encoded:
    """The ids of a batch of texts, in one array, and the pieces they come from."""

    ids: np.ndarray  # of all texts, in order
    counts: np.ndarray  # ids per text
    pieces: np.ndarray  # pieces per text
    lengths: np.ndarray  # ids per piece
    sentence_ends: np.ndarray  # whether a sentence or line ends in the piece


class _Memo(dict):
    """Numbers pieces in the order they are met. A number among them is an id by itself, such as the end mark."""

    def __init__(self):
        super().__init__()
        self.new: list[str | int] = []

    def __missing__(self, piece: str | int) -> int:
        number = self[piece] = len(self)
        self.new.append(piece)
        return number


class PieceEncoder:
    """``encode_batch(texts)`` gives the ids of a batch of texts and the lengths of their pieces.

    ``limit`` bounds the pieces kept between calls and ``budget`` the characters a single
    call of the library gets. A piece that is one pre-token goes to the library's BPE model as
    such; any other piece goes through the whole tokenizer.
    """

    def __init__(self, path: str, limit: int = 600_000, budget: int = 1 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit, self.budget = limit, budget
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.spaced[[number for token, number in vocabulary.items() if token.startswith(SPACED)]] = True
        probe = [" Été", "The", " a", ",", "\n", "x"]
        self.plain = [self._merged(p) for p in probe] == list(self._whole(probe))
        self._reset()

    def _reset(self) -> None:
        self.memo = _Memo()
        self.ids = np.zeros(1 << 16, dtype=np.int32)
        self.used = 0
        self.starts = np.zeros(1 << 12, dtype=np.int64)
        self.lengths = np.zeros(1 << 12, dtype=np.int64)
        self.ends = np.zeros(1 << 12, dtype=bool)

    def _merged(self, pretoken: str) -> bytes:
        """The ids of a pre-token as bytes of 32-bit integers."""
        if pretoken.isascii() and pretoken.isprintable():
            spelled = pretoken.replace(" ", SPACED)
        else:
            spelled = pretoken.encode().decode("latin-1").translate(BYTE_CHARACTERS)
        return array("i", [t.id for t in self.tokenizer.model.tokenize(spelled)]).tobytes()

    def _whole(self, pieces: list[str]) -> Iterator[bytes]:
        at = 0
        while at < len(pieces):
            size, end = 0, at
            while end < len(pieces) and (size < self.budget or end == at):
                size += len(pieces[end])
                end += 1
            for found in self.tokenizer.encode_batch_fast(pieces[at:end], add_special_tokens=False):
                yield array("i", found.ids).tobytes()
            at = end

    def _together(self, pieces: list[str]) -> list[bytes | None]:
        """The ids of pieces with one space, in front of a character that is none, many in one call.

        One behind the other they are a text that is cut in front of each of them, and the ids of
        each begin where an id brings a space. None if a call's ids don't come apart like this.
        """
        out: list[bytes | None] = []
        while len(out) < len(pieces):
            size, end = 0, len(out)
            while end < len(pieces) and (size < self.budget or end == len(out)):
                size += len(pieces[end])
                end += 1
            (found,) = self.tokenizer.encode_batch_fast(["".join(pieces[len(out) : end])], add_special_tokens=False)
            ids = np.array(found.ids, dtype=np.int32)
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) == end - len(out):
                held, bounds = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
                out += [held[bounds[k] : bounds[k + 1]] for k in range(len(starts))]
            else:
                out += [None] * (end - len(out))
        return out

    def _learn(self) -> None:
        """Encode the pieces met since the last call."""
        new, self.memo.new = self.memo.new, []
        if not new:
            return
        first = len(self.memo) - len(new)
        while len(self.starts) < len(self.memo):
            self.starts, self.lengths, self.ends = (
                np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.lengths, self.ends))
        coded: list[bytes | None] = [
            array("i", [piece]).tobytes() if isinstance(piece, int)
            else self._merged(piece) if self.plain and WORD.fullmatch(piece) else None
            for piece in new]
        single = [k for k, ids in enumerate(coded) if ids is None and SINGLE.fullmatch(new[k])]
        for k, ids in zip(single, self._together([new[k] for k in single])):
            coded[k] = ids
        whole = self._whole([piece for piece, ids in zip(new, coded) if ids is None])
        coded = [next(whole) if ids is None else ids for ids in coded]
        lengths = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded)) // 4
        ids = np.frombuffer(b"".join(coded), dtype=np.int32)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        part = slice(first, first + len(new))
        self.starts[part], self.lengths[part] = self.used + np.cumsum(lengths) - lengths, lengths
        self.ends[part] = [isinstance(p, str) and (p.endswith(SENTENCE_END) or "\n" in p) for p in new]
        self.used += len(ids)

    def _cut(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all pieces in order, and the pieces of each text, of texts that are not odd."""
        memo = self.memo
        if self.plain:
            texts = pc.replace_substring_regex(texts, MARK_BEHIND, rf"\1 {CUT_OFF}\2\3")
            texts = pc.replace_substring(texts, "\n", " \n ")
        # Every space stands alone: the parts are the words without the space in front, marks and line breaks.
        parts = pc.split_pattern(texts, " ")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        words = parts.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        offsets -= offsets[0]
        place, known = words.indices.to_numpy(), words.dictionary.to_numpy(zero_copy_only=False).tolist()
        # No space stands in front of a text's first part, of marks and breaks, and of what is behind a break.
        bare = np.array([word == "\n" or word[:1] == CUT_OFF for word in known])[place]
        if "\n" in known:
            bare[1:] |= place[:-1] == known.index("\n")
        bare[offsets[:-1]] = True
        codes = np.zeros(len(place), dtype=np.int64)
        for chosen, front in ((~bare, " "), (bare, "")):
            own = place[chosen]
            met = np.zeros(len(known), dtype=bool)
            met[own] = True
            numbers = np.full(len(known), -1, dtype=np.int64)
            numbers[met] = [
                memo[front + word.removeprefix(CUT_OFF)] if front or word else -1
                for word, here in zip(known, met.tolist()) if here]
            codes[chosen] = numbers[own]
        held = codes >= 0
        running = np.concatenate([[0], np.cumsum(held)])
        return codes[held], np.diff(running[offsets])

    def _codes(self, texts: pa.StringArray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all pieces in order, and the pieces of each text; with ``end`` each text has one more."""
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False).astype(bool)
        cut: dict[int, list[int]] = {}
        if odd.any():
            for k in np.flatnonzero(odd).tolist():
                cut[k] = [self.memo[piece] for piece in CUT.split(texts[k].as_py())]
            texts = pc.if_else(pa.array(odd), pa.scalar("", pa.string()), texts)
        codes, counts = self._cut(texts)
        if not cut and end is None:
            return codes, counts
        sizes = counts.copy()
        for k, own in cut.items():
            sizes[k] = len(own)
        totals = sizes + (end is not None)
        starts = np.cumsum(totals) - totals
        out = np.empty(int(totals.sum()), dtype=np.int64)
        out[np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(len(codes))] = codes
        for k, own in cut.items():
            out[starts[k] : starts[k] + len(own)] = own
        if end is not None:
            out[starts + sizes] = self.memo[end]
        return out, totals

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per text: ids, ids per piece, and whether a sentence or line ends in the piece."""
        found = self.encode_batch(pa.array(texts, pa.string()))
        ids, pieces = np.cumsum(found.counts), np.cumsum(found.pieces)
        for k in range(len(texts)):
            part = slice(pieces[k] - found.pieces[k], pieces[k])
            yield found.ids[ids[k] - found.counts[k] : ids[k]], found.lengths[part], found.sentence_ends[part]

    def encode_batch(self, texts: pa.Array, end: int | None = None) -> Encoded:
        """The ids of all texts, each with the id ``end`` behind it if given; a null text is empty."""
        if len(self.memo) > self.limit or self.used > 16 * self.limit:
            self._reset()
        if not len(texts):
            nothing = np.zeros(0, dtype=np.int64)
            return Encoded(nothing.astype(np.int32), nothing, nothing, nothing, nothing.astype(bool))
        codes, pieces = self._codes(pc.fill_null(texts.cast(pa.string()), ""), end)
        self._learn()
        lengths = self.lengths[codes]
        before = np.cumsum(lengths) - lengths
        places = np.repeat(self.starts[codes] - before, lengths)
        places += np.arange(len(places))
        bounds = np.concatenate([[0], np.cumsum(pieces)])
        running = np.concatenate([[0], np.cumsum(lengths)])
        return Encoded(self.ids[places], np.diff(running[bounds]), pieces, lengths, self.ends[codes])


_held: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process."""
    if path not in _held:
        _held[path] = PieceEncoder(path)
    return _held[path]
