"""Token counts of whole texts, huge ones in overlapping chunks that are spliced together.

A sentencepiece BPE model merges neighbouring pieces as long as the merged string is in
its vocabulary. Two characters that no piece holds side by side can therefore never
end up in one token, and nothing on one side of such a place changes the tokens on
the other: it is a stable boundary. A document longer than ``chunk`` characters is encoded
in chunks that overlap; where both encodings have a token boundary at the same character of the
overlap and the place is stable, the first is followed up to it and the second from it on.
If there is no such place the overlap is doubled, in the end up to the whole document.

Defined cases: a null text counts as empty (0 tokens, 0 bytes); null and repeated ids
pass through row by row; an empty table gives no rows; other columns are not read. A model whose
normalizer changes characters proves no boundaries, so its texts are encoded whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspark.llm.common import arrow_rows, texts

MARK = "▁"  # stands for a space inside pieces


class SpliceCounter:
    """Counts tokens of one sentencepiece model."""

    def __init__(self, path: str, chunk: int = 1 << 14, overlap: int = 256):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        self.joined: set[str] = set()
        self.widened = 0
        size = self.model.get_piece_size()
        self.width = np.zeros(size, dtype=np.int64)
        for k in range(size):
            piece = self.model.id_to_piece(k)
            if self.model.is_byte(k):
                # A character in bytes is as wide as its first byte; the others have no width.
                self.width[k] = not 0x80 <= int(piece[3:5], 16) <= 0xBF
            elif not self.model.is_control(k) and not self.model.is_unknown(k):
                self.width[k] = len(piece)
                self.joined.update(piece[i : i + 2] for i in range(len(piece) - 1))
        # A dummy space in front, and nothing else, is what these models may add.
        probe = "Åﬁ ①  가 x\tÅ "
        self.plain = self.model.normalize(probe).removeprefix(MARK) == probe.replace(" ", MARK)
        self.prefix = len(self.model.normalize("x")) - 1

    def stable(self, text: str, place: int) -> bool:
        """No token can reach over ``place``."""
        return text[place - 1 : place + 1].replace(" ", MARK) not in self.joined

    def boundaries(self, text: str, start: int, end: int) -> np.ndarray | None:
        """Characters of ``text`` where tokens of its part from ``start`` to ``end`` begin; None if widths don't add up."""
        ids = np.array(self.model.encode(text[start:end]), dtype=np.int64)
        after = np.cumsum(self.width[ids])
        if len(ids) and after[-1] != end - start + self.prefix:
            return None
        # Bytes after the first of a character begin no character: they keep their token, but are no place to splice.
        return start - self.prefix + np.concatenate([[0], after[:-1]])

    def count(self, text: str) -> int:
        if len(text) <= self.chunk or not self.plain:
            return len(self.model.encode(text))
        total, taken, size, overlap = 0, 0, self.chunk, self.overlap
        left_start, left_end = 0, size
        left = self.boundaries(text, 0, left_end)
        while left is not None and left_end < len(text):
            start = left_end - overlap
            end = min(start + size, len(text))
            right = self.boundaries(text, start, end)
            if right is None:
                return len(self.model.encode(text))
            common = np.intersect1d(left[left > max(start, taken)], right)
            splice = next((int(b) for b in common if b < left_end and self.stable(text, int(b))), None)
            if splice is None:
                self.widened += 1
                overlap *= 2
                if overlap >= left_end - max(left_start, taken):
                    # The overlap is the whole left chunk: encode a longer one in its place.
                    size *= 2
                    left_end = min(left_start + size, len(text))
                    left = self.boundaries(text, left_start, left_end)
                    overlap = self.overlap
                continue
            total += int(((left >= taken) & (left < splice)).sum()) if taken else int((left < splice).sum())
            taken, left, left_start, left_end = splice, right, start, end
            size, overlap = self.chunk, self.overlap
        if left is None:
            return len(self.model.encode(text))
        return total + int((left >= taken).sum() if taken else len(left))

    def counts(self, group: list[str], budget: int = 1 << 19) -> list[int]:
        """Short texts go to the library together, ``budget`` characters at a time."""
        out, held, size = [0] * len(group), [], 0
        for k, text in enumerate(group):
            if len(text) > self.chunk:
                out[k] = self.count(text)
                continue
            held.append(k)
            size += len(text)
            if size >= budget:
                self._whole(group, held, out)
                held, size = [], 0
        self._whole(group, held, out)
        return out

    def _whole(self, group: list[str], held: list[int], out: list[int]) -> None:
        if held:
            for k, ids in zip(held, self.model.encode([group[k] for k in held], num_threads=1)):
                out[k] = len(ids)


_held: dict[tuple, SpliceCounter] = {}


def count_tokens(docs: DataFrame, model: str, *, limit: int = 4096, chunk: int = 1 << 14,
                 overlap: int = 256) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for ``docs`` (doc_id, text); no row moves."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (model, chunk, overlap)
        if key not in _held:
            _held[key] = SpliceCounter(*key)
        rows = arrow_rows([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
        for batch in batches:
            group = texts(batch)
            yield rows(batch.column("doc_id"), [len(t.encode()) for t in group], _held[key].counts(group))

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return read.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit)
