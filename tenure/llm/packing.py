"""Hierarchical multi-length packing of tokenised documents.

Every document (its ids and one end id) is routed by length: whole windows of
the longest tier are cut off, and what is left goes to the smallest context
tier that holds it.  Tiers are packed from the longest down: a piece opens a
sequence of its tier, and the gap is filled with the longest shorter pieces
that fit, the last of them cut so that the sequence is exactly full.  The tiers
are powers of two, so a full sequence of any tier has no padding; what is left
at the end of a task's input is laid out in descending powers of two.

Sequences of one tier are gathered into step groups of equal token counts
(``step_tokens``), so that every training step of any tier costs the same.

A task packs its own input split as a stream: nothing is shuffled, and memory
is one window of ``window`` tokens.  Sequence ids are unique over all tasks
(task number, then a counter).

Defined results for odd input: a null or empty text is the end id alone; a null
id is kept on its pieces; repeated rows are packed as often as they occur; a
document of any length lies in as many pieces as needed; empty input gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.llm.common import small_batches

TIERS = (256, 512, 1024, 2048)
END_ID = 1
TOKENIZER = "byte_bpe_50k.json"
#: The same vocabulary as ranks, and the special token that only the first file knows.
RANKS, SPECIAL = "byte_bpe_50k.tiktoken", "<|endoftext|>"

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "tier int, step_group long")

# Both libraries split these characters alike (Unicode classes that no version has changed) and neither
# slows down on short runs; all other texts take the reference tokenizer.
_PLAIN = re.compile("[ -~\t\n\r¡-ſ]*")
_RUN = re.compile(r"\S{1000}|\s{200}")


@lru_cache(maxsize=4)
def tokenizers(name: str, ranks: str | None):
    """(reference tokenizer, faster tokenizer of the same vocabulary or None), once per worker."""
    import base64
    import os

    import public_tokenizers as P
    import tiktoken
    from tokenizers import Tokenizer
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    ref = Tokenizer.from_file(P.path(name))
    if ranks is None:
        return ref, None
    with open(P.path(ranks), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return ref, tiktoken.Encoding("ranks", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={})


def encode(text: str, name: str = TOKENIZER, ranks: str | None = RANKS) -> np.ndarray:
    """Ids of a text as the reference tokenizer gives them (without added special tokens)."""
    ref, fast = tokenizers(name, ranks)
    if fast is not None and _PLAIN.fullmatch(text) and SPECIAL not in text and not _RUN.search(text):
        return fast.encode_to_numpy(text, disallowed_special=())
    return np.array(ref.encode(text, add_special_tokens=False).ids, np.uint32)


class Packer:
    """Packs a stream of documents; finished pieces gather in ``rows``."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, window: int = 1 << 20, step_tokens: int = 1 << 16, first_id: int = 0):
        self.tiers, self.window, self.step_tokens = sorted(tiers), window, step_tokens
        self.top = self.tiers[-1]
        self.pool: list[deque] = [deque() for _ in range(self.top + 1)]  # pieces by length
        self.mask = 0  # bit n: there is a piece of length n
        self.held = 0
        self.next_id = self.first_id = first_id
        self.in_tier = {t: 0 for t in self.tiers}
        self.rows: list[tuple] = []
        self.ids: list[np.ndarray] = []

    def _put(self, piece: tuple) -> None:
        n = len(piece[2])
        self.pool[n].append(piece)
        self.mask |= 1 << n
        self.held += n

    def _take(self, n: int) -> tuple:
        piece = self.pool[n].popleft()
        if not self.pool[n]:
            self.mask &= ~(1 << n)
        self.held -= n
        return piece

    def add(self, doc_id, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.top:
            self._emit(self.top, [(doc_id, at, ids[at:at + self.top], total)])
            at += self.top
        if at < total:
            self._put((doc_id, at, ids[at:], total))
        if self.held >= self.window:
            self._pack()

    def _emit(self, tier: int, pieces: list[tuple]) -> None:
        """One finished sequence."""
        if tier in self.in_tier:
            k = self.in_tier[tier]
            self.in_tier[tier] += 1
            step = (k // max(1, self.step_tokens // tier)) * len(self.tiers) + self.tiers.index(tier)
        else:
            step = None  # a last sequence, shorter than any tier
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next_id,
                              offset, tier, None if step is None else self.first_id + step))
            self.ids.append(ids)
            offset += len(ids)
        self.next_id += 1

    def _fill(self, size: int, pieces: list[tuple]) -> None:
        """Fill up to ``size``: the longest piece that fits, and at last a cut through the shortest that doesn't."""
        gap = size - sum(len(p[2]) for p in pieces)
        while gap and self.mask:
            if fits := self.mask & ((2 << gap) - 1):
                piece = self._take(fits.bit_length() - 1)
            else:
                doc_id, start, ids, total = self._take((self.mask & -self.mask).bit_length() - 1)
                self._put((doc_id, start + gap, ids[gap:], total))
                piece = (doc_id, start, ids[:gap], total)
            pieces.append(piece)
            gap -= len(piece[2])

    def _pack(self) -> None:
        """Pack until less than one sequence of the tier on hand is left."""
        for tier in reversed(self.tiers):
            low = tier // 2 if tier != self.tiers[0] else 0
            while self.held >= tier and (n := self.mask.bit_length() - 1) > low:
                pieces = [self._take(n)] if n <= tier else []
                self._fill(tier, pieces)
                self._emit(tier, pieces)

    def close(self) -> None:
        self._pack()
        while self.held:
            size = 1 << (self.held.bit_length() - 1)
            pieces: list[tuple] = []
            self._fill(size, pieces)
            self._emit(size, pieces)


def pack(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS,
         tokenizer: str = TOKENIZER, ranks: str | None = RANKS, end_id: int = END_ID, window: int = 1 << 20,
         step_tokens: int = 1 << 16, with_ids: bool = False) -> DataFrame:
    """One row per piece: document, place in it, sequence, place there, tier and step group (``SCHEMA``).

    ``with_ids`` adds the piece's token ids as ``ids``.
    """
    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext
        packer = Packer(tiers, window, step_tokens, TaskContext.get().partitionId() << 33)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        types = [pa.int64()] * 7 + [pa.int32(), pa.int64()]

        def out():
            cols = [pa.array(c, t) for c, t in zip(zip(*packer.rows), types)]
            if with_ids:
                at = np.concatenate(([0], np.cumsum([len(x) for x in packer.ids]))).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(packer.ids).astype(np.int32))))
            packer.rows.clear()
            packer.ids.clear()
            return pa.RecordBatch.from_arrays(cols, names=names + ["ids"] * with_ids)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                ids = np.append(encode(text, tokenizer, ranks), end_id) if text else np.array([end_id])
                packer.add(doc_id, ids.astype(np.uint32))
                if len(packer.rows) >= 4096:
                    yield out()
        packer.close()
        if packer.rows:
            yield out()
    rows = documents.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.transform(small_batches).mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))
