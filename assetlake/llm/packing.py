"""Sum-of-squares packing of tokenised documents into windows of fixed length."""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

WINDOW = 2048
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_COLUMNS = [c.split()[0] for c in _PIECES.split(", ")]


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printing ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordTokens(dict):
    """Token ids of whole texts, word by word through a memory of the words met.

    The tokenizer drops white space and joins nothing across it, so the ids of a text are those of its
    words in order. Words are cut at the six ASCII spaces only, where all of this holds whatever
    the characters beside them. A sign after an ASCII letter begins a part of its own, so
    end signs are looked up apart. A word of lower-case Latin letters needs no normalising and is
    one part: it goes to the tokenizer's model at once. All others take the whole tokenizer. A text
    that may hold a special token, which matches capitals exactly, is tokenized as it is. When the
    memory has reached ``most_bytes`` it is put aside and words met again come back from there, so that at most
    twice as much is held; this costs time and changes nothing.
    """

    _SIGNS = b".,!?;:*$#%&|"
    _LATIN = re.compile("[a-zß-öø-ÿ]+")

    def __init__(self, path: str, most_bytes: int = 60_000_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.letters = Tokenizer.from_file(path), most_bytes, _byte_letters()
        self.used, self.aside = 0, {}
        self.model = self.tokenizer.model

    def _ids(self, word: bytes) -> bytes:
        stem = word.rstrip(self._SIGNS)
        if stem and len(stem) < len(word) and stem[-1:].isalpha():
            return self[stem] + self[word[len(stem):]]
        text = word.decode()
        small = text.lower()
        if self._LATIN.fullmatch(small):
            found = [t.id for t in self.model.tokenize(small.encode().decode("latin-1").translate(self.letters))]
        else:
            found = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(found, dtype="<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        ids = self.aside.get(word) or self._ids(word)
        if self.used > self.most:
            self.aside, self.used = dict(self), 0
            self.clear()
        self[word] = ids
        self.used += 200 + len(word) + len(ids)
        return ids

    def of(self, text: bytes | None) -> bytes:
        """The ids of a text in UTF-8 as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if b"<|" in text:
            return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.__getitem__, text.lower().split()))


@functools.cache
def word_tokens(path: str, most_bytes: int = 60_000_000) -> WordTokens:
    """One memory for all tasks of a Python worker."""
    return WordTokens(path, most_bytes)


def word_tokens_of(path: str, most_bytes: int = 60_000_000) -> Callable[[bytes | None], bytes]:
    return word_tokens(path, most_bytes).of


class Windows:
    """Open windows by fill level, and the rule that places a piece.

    ``count[h]`` windows are filled to ``h``. A piece of ``s`` tokens goes to the level whose
    choice leaves the least sum of squared counts over the levels 1 .. size-1; a new window is
    level 0, and a full one is not counted. Ties take the fullest level.
    """

    def __init__(self, size: int = WINDOW):
        self.size, self.count = size, np.zeros(size + 1, dtype=np.int64)
        self.open: list[list[list]] = [[] for _ in range(size + 1)]

    def level_for(self, s: int) -> int:
        # Taking a window from level h changes the sum by 1 - 2 count[h], adding one to h + s by 1 + 2 count[h + s].
        levels = self.count[: self.size - s + 1]
        change = 1 - 2 * levels
        change[0] = 0
        change = change + 1 + 2 * self.count[s:]
        change[self.size - s] -= 1 + 2 * self.count[self.size]
        allowed = levels > 0
        allowed[0] = True
        change = np.where(allowed, change, np.iinfo(np.int64).max)
        return int(self.size - s - np.argmin(change[::-1]))

    def place(self, piece: tuple, s: int) -> list | None:
        """Put a piece in a window; the window's pieces if that filled it."""
        h = self.level_for(s)
        window = self.open[h].pop() if h else []
        self.count[h] -= h > 0
        window.append(piece)
        if h + s == self.size:
            return window
        self.open[h + s].append(window)
        self.count[h + s] += 1
        return None

    def rest(self) -> Iterator[list]:
        """The windows still open at the end: the emptiest give pieces, cut where needed, to fill the fullest."""
        left = [w for level in self.open for w in level]
        spare: list[tuple] = []  # of windows taken apart
        while left:
            window = left.pop()
            room = self.size - sum(p[2] for p in window)
            while room and (spare or left):
                spare = spare or left.pop(0)
                doc, start, length, *more = spare.pop()
                if length > room:
                    spare.append((doc, start + room, length - room, *more))
                window.append((doc, start, min(length, room), *more))
                room -= min(length, room)
            yield window
        while spare:
            window, room = [], self.size
            while room and spare:
                doc, start, length, *more = spare.pop()
                if length > room:
                    spare.append((doc, start + room, length - room, *more))
                window.append((doc, start, min(length, room), *more))
                room -= min(length, room)
            yield window


def pack(docs: DataFrame, ids_of: Callable[[], Callable], end_id: int = 1, size: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``ids_of`` makes, in each task, the function from a text in UTF-8 to its ids. A document is its ids and
    ``end_id``. Whole windows are cut from its head; what remains is placed by ``Windows``. A task
    packs the documents of its own input partition as they come: no text or id is shuffled, and
    memory holds the open windows of one task. At the end of a partition the open windows fill each
    other, so that only its last one is padded. A window's number is unique over all tasks, and
    the same input splits give the same result.

    A null or empty text is the end id alone. Null and repeated keys are kept. Other columns are
    ignored. An empty input has no pieces.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_in, windows = ids_of(), Windows(size)
        number, out = TaskContext.get().partitionId() << 33, []

        def emit(window: list) -> None:
            nonlocal number
            at = 0
            for doc, start, length, ids, base, total in window:
                crc = zlib.crc32(ids[4 * (start - base): 4 * (start - base + length)])
                out.append((doc, start, length, crc, total, number, at))
                at += length
            number += 1

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], _COLUMNS)
            out.clear()
            return batch

        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = ids_in(body.as_py()) + end
                total = len(ids) // 4
                whole = total - total % size
                for start in range(0, whole, size):
                    emit([(doc, start, size, ids, 0, total)])
                if total > whole:
                    filled = windows.place((doc, whole, total - whole, ids[4 * whole:], whole, total), total - whole)
                    if filled:
                        emit(filled)
            if out:
                yield flush()
        for window in windows.rest():
            emit(window)
        if out:
            yield flush()

    return docs.select(docs[key].cast("long"), docs[text].cast("binary")).mapInArrow(run, _PIECES)
