"""Packing token sequences: bounded-space online best fit.

Each partition keeps a fixed number of open windows. A document's tokens fill whole windows first; the rest is placed
in the open window that it fills best, a new window is opened while there is room for one, and when none fits, the
fullest window is topped up with the head of the piece and emitted. At the end the partition's leftovers are merged:
their pieces are laid end to end and cut anew into whole windows, and the last, shorter run into sequences whose
lengths are powers of two, which need no padding.

Defined cases: a null text is an empty one, and an empty one is the end token alone; a text of any length is cut into
as many pieces as it takes; repeated rows and null ids are documents of their own; an empty table gives no rows; only
``doc_id`` and ``text`` are read, so extra columns don't matter.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 1024
OPEN_WINDOWS = 16
#: The id that ends each document.
END = 0
#: Fixed value: the split pattern of byte-level pre-tokenizers.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters outside common Latin text, on which libraries may differ in what is a letter or white space.
_RARE = re.compile("[^\\t\\n\\r\\x20-\\x7e\\xa1-\\u017f\\u2013\\u2014\\u2018-\\u201f\\u2022\\u2026\\u20ac]")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _core(path: str):
    """A ``tiktoken`` encoding of the byte-level BPE in the file, or None where ranks and ids don't agree."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if spec.get("normalizer") or not plain or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    vocab, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    if [vocab.get(a + b) for a, b in merges] != list(range(256, 256 + len(merges))):
        return None
    letter = {c: b for b, c in enumerate(_byte_letters())}
    ranks = {bytes(letter[c] for c in token): i for token, i in vocab.items() if i < 256 + len(merges)}
    return tiktoken.Encoding("packing", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})


def _byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class TextTokenizer:
    """Ids of texts, as the ``tokenizers`` file gives them.

    Texts of common characters are encoded by the faster byte-pair core of ``tiktoken``, built from the same file where
    its merges rank as its ids do; both libraries then give the same ids. Texts with any other character, or with the
    string of an added token, go to ``tokenizers`` itself, as all do where that core can't be built.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.core = _core(path)

    def __call__(self, text: str) -> np.ndarray:
        if self.core is None or _RARE.search(text) or any(a in text for a in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.core.encode_ordinary(text), np.uint32)


_tokenizers: dict[str, TextTokenizer] = {}


def tokenizer_of(path: str) -> TextTokenizer:
    """The worker's tokenizer, which lives as long as the worker."""
    if path not in _tokenizers:
        _tokenizers[path] = TextTokenizer(path)
    return _tokenizers[path]


class Piece(NamedTuple):
    """Ids ``start`` to ``start + len(ids) / 4`` of a document of ``total`` ids."""

    doc_id: int | None
    start: int
    ids: memoryview
    total: int

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return self._replace(ids=self.ids[: 4 * n]), self._replace(start=self.start + n, ids=self.ids[4 * n :])


class Packer:
    """Bounded-space online best fit over windows of ``size`` tokens; full windows go to ``emit``."""

    def __init__(self, emit: Callable[[list[Piece]], None], size: int = WINDOW, open_windows: int = OPEN_WINDOWS):
        self.emit, self.size, self.most = emit, size, open_windows
        self.windows: list[tuple[int, list[Piece]]] = []  # (free, pieces)

    def add(self, piece: Piece) -> None:
        while _size(piece) >= self.size:
            head, piece = piece.cut(self.size)
            self.emit([head])
        while n := _size(piece):
            fits = [(free, k) for k, (free, _) in enumerate(self.windows) if free >= n]
            if fits:
                free, k = min(fits)
                self._fill(k, piece)
                return
            if len(self.windows) < self.most:
                self.windows.append((self.size - n, [piece]))
                return
            free, k = min((free, k) for k, (free, _) in enumerate(self.windows))
            head, piece = piece.cut(free)
            self._fill(k, head)

    def _fill(self, k: int, piece: Piece) -> None:
        free, pieces = self.windows[k]
        pieces.append(piece)
        if free == _size(piece):
            del self.windows[k]
            self.emit(pieces)
        else:
            self.windows[k] = free - _size(piece), pieces

    def close(self) -> None:
        """Merge what the open windows hold: whole windows, then powers of two."""
        rest = [p for _, pieces in sorted(self.windows, key=lambda w: w[0]) for p in pieces]
        self.windows = []
        left = sum(map(_size, rest))
        while left:
            want = self.size if left >= self.size else 1 << (left.bit_length() - 1)
            left -= want
            sequence: list[Piece] = []
            while want:
                piece = rest.pop(0)
                if _size(piece) > want:
                    piece, later = piece.cut(want)
                    rest.insert(0, later)
                sequence.append(piece)
                want -= _size(piece)
            self.emit(sequence)


def _size(piece: Piece) -> int:
    return len(piece.ids) // 4


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """One row per piece (``SCHEMA``) of the packed documents; ``tokenizer`` is a file's path on every executor.

    Nothing is shuffled: a partition is packed as it is read, holding ``open_windows`` windows. Sequence ids hold the
    partition's number in their upper bits.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokenizer_of(tokenizer)
        rows: list[tuple] = []
        sequence = TaskContext.get().partitionId() << 33

        def emit(pieces: list[Piece]) -> None:
            nonlocal sequence
            offset = 0
            for p in pieces:
                rows.append((p.doc_id, p.start, _size(p), zlib.crc32(p.ids), p.total, sequence, offset))
                offset += _size(p)
            sequence += 1

        def taken() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(FIELDS)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(FIELDS))

        packer = Packer(emit, window, open_windows)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(tokens(text or ""), END).astype("<u4").tobytes()
                packer.add(Piece(doc_id, 0, memoryview(ids), len(ids) // 4))
                if len(rows) >= 50_000:
                    yield taken()
            yield taken()
        packer.close()
        yield taken()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
