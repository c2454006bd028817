"""Byte-level BPE by speculation: greedy longest tokens, a check of every adjacent pair, exact merging of the words that fail."""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructField, StructType

from assetlake.llm.packing import _byte_letters

# Fixed values of the byte-level tokenizer: white space as Unicode defines it, and the cut of a text into words.
_SPACE = "\\x09-\\x0D\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
_WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"

_NEVER = np.iinfo(np.int64).max
# Characters, or ids, that a task works on at a time.
_AT_ONCE = 400_000


class Vocabulary:
    """Tokens, merges and the three steps of the encoder, from a tokenizer file.

    A token made by merge ``r`` has rank ``r`` and two halves; the rank of a byte is -1. In a trained list
    of merges both halves of a token come before it, so what stands on both sides of a cut at any time of
    the merging is found by taking the later of the two tokens apart.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        plain = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if (
            model["type"] != "BPE" or any(model.get(k) for k in plain) or spec["normalizer"] or before.get("type") != "ByteLevel"
            or before["add_prefix_space"] or not before.get("use_regex", True)
            or any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        ):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        byte_of = {letter: b for b, letter in _byte_letters().items()}
        ids = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max(*ids.values(), *self.added.values(), 0)
        self.bytes_of: list[bytes | None] = [None] * self.size
        for token, i in ids.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        self.by_bytes = {b: i for i, b in enumerate(self.bytes_of) if b}
        for content, i in self.added.items():
            self.bytes_of[i] = content.encode()
        self._halves([m.split(" ") if isinstance(m, str) else m for m in model["merges"]], ids)
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None

    @functools.cached_property
    def tree(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens by bytes: the line of each node that goes on, the 256 ways of a line (0 for none), and the token that ends at a node."""
        child: dict[tuple[int, int], int] = {}
        ends = [-1, -1]  # no node, and the root
        for token, i in self.by_bytes.items():
            node = 1
            for b in token:
                node = child.setdefault((node, b), len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = i
        inner = sorted({node for node, _ in child})
        line = np.zeros(len(ends), dtype=np.int64)
        line[inner] = np.arange(1, len(inner) + 1)
        ways = np.zeros((len(inner) + 1, 256), dtype=np.int32)
        for (node, b), to in child.items():
            ways[line[node], b] = to
        return line, ways, np.array(ends, dtype=np.int64)

    def _halves(self, merges: list[Sequence[str]], ids: dict[str, int]) -> None:
        self.rank = np.full(self.size, -1, dtype=np.int64)
        self.left = np.arange(self.size)
        self.right = np.arange(self.size)
        a, b = (np.array([ids[m[side]] for m in merges], dtype=np.int64) for side in (0, 1))
        made = np.array([ids[x + y] for x, y in merges], dtype=np.int64)
        ranks = np.arange(len(merges))
        # A token made by several merges would have several histories.
        if len(np.unique(made)) < len(made) or (np.maximum(self.rank[a], self.rank[b]) >= ranks).any():
            raise ValueError("every token must come from one merge")
        self.rank[made], self.left[made], self.right[made] = ranks, a, b
        if (np.maximum(self.rank[a], self.rank[b]) >= ranks).any():
            raise ValueError("a merge must follow those of its halves")
        keys = a * self.size + b
        order = np.argsort(keys)
        self.keys, self.key_rank, self.made = keys[order], ranks[order], made
        self.byte_ids = np.array([self.by_bytes[bytes([k])] for k in range(256)])
        self.merge_of = {(int(x), int(y)): (int(r), int(m)) for x, y, r, m in zip(a, b, ranks, made)}
        # Whether the bytes of a token come back as that token: nothing may cross its middle before its own merge.
        fits = self.compatible(a, b, ranks)
        sound = np.ones(self.size, dtype=bool)
        for x, y, m, ok in zip(a.tolist(), b.tolist(), made.tolist(), fits.tolist()):
            sound[m] = ok and sound[x] and sound[y]
        self.sound = sound

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | int = _NEVER) -> np.ndarray:
        """For pairs of tokens: whether no merge of a rank below ``until`` crosses the cut between them."""
        a, b = a.copy(), b.copy()
        until = np.broadcast_to(np.asarray(until, dtype=np.int64), a.shape).copy()
        ok, at = np.ones(len(a), dtype=bool), np.arange(len(a))
        while len(at):
            crosses = self._ranks(a, b) < until
            ok[at[crosses]] = False
            ra, rb = self.rank[a], self.rank[b]
            # Of equal merges the left one comes first, so the right token is taken apart first.
            first = ra > rb
            going = ~crosses & (np.maximum(ra, rb) >= 0)
            until = np.where(first, ra, rb + 1)[going]
            a, b, at = np.where(first, self.right[a], a)[going], np.where(first, b, self.left[b])[going], at[going]
        return ok

    def proposals(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The longest token at each place of each word, from the left; all words step together. Tokens and the word of each, in order."""
        line, ways, ends = self.tree
        size = np.array([len(w) for w in words], dtype=np.int64)
        stop = np.cumsum(size)
        text = np.frombuffer(b"".join(words) + b"\0", dtype=np.uint8)
        word = np.flatnonzero(size)
        at = stop[word] - size[word]
        start, stop = at.copy(), stop[word]
        node, token, end = np.ones(len(word), np.int64), np.full(len(word), -1), at.copy()
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(word):
            node = np.where(at < stop, ways[line[node], text[np.minimum(at, stop)]], 0)
            at = at + 1
            ended = ends[node]
            hit = ended >= 0
            token, end = np.where(hit, ended, token), np.where(hit, at, end)
            over = node == 0
            if over.any():
                found.append((start[over], word[over], token[over]))
                start, at, node = np.where(over, end, start), np.where(over, end, at), np.where(over, 1, node)
                left = start < stop
                if not left.all():
                    word, at, start, stop, node, token, end = (x[left] for x in (word, at, start, stop, node, token, end))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts, of, tokens = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(starts)
        return tokens[order], of[order]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair, or never."""
        if not len(self.keys):
            return np.full(len(a), _NEVER)
        keys = a * self.size + b
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[place] == keys, self.key_rank[place], _NEVER)

    def merged(self, words: Sequence[bytes]) -> list[bytes]:
        """Exact merging: the pair of the least rank first, from the left; one merge of every word at a time."""
        out: list[bytes] = [b""] * len(words)
        for k, w in enumerate(words):
            if len(w) > 100:
                out[k] = np.array(self._merged_by_heap([self.byte_ids[b] for b in w]), dtype="<u4").tobytes()
        short = [k for k, w in enumerate(words) if 0 < len(w) <= 100]
        word = np.repeat(short, [len(words[k]) for k in short]).astype(np.int64)
        ids = self.byte_ids[np.frombuffer(b"".join([words[k] for k in short]), dtype=np.uint8)]
        rank = np.append(np.where(word[1:] == word[:-1], self._ranks(ids[:-1], ids[1:]), _NEVER), _NEVER)[:len(ids)]
        while len(ids):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(starts, append=len(ids))
            each = np.repeat(least, sizes)
            if (done := each == _NEVER).any():
                raw, at = ids[done].astype("<u4").tobytes(), 0
                for k, n in zip(word[starts[least == _NEVER]].tolist(), sizes[least == _NEVER].tolist()):
                    out[k], at = raw[at:at + 4 * n], at + 4 * n
                ids, word, rank, each = ids[~done], word[~done], rank[~done], each[~done]
            here = np.flatnonzero(rank == each)
            here = here[np.append(True, word[here][1:] != word[here][:-1])[:len(here)]]
            ids[here] = self.made[rank[here]]
            stay = np.ones(len(ids), dtype=bool)
            stay[here + 1] = False
            ids, word, rank = ids[stay], word[stay], rank[stay]
            here = here - np.arange(len(here))
            for at in (here, here[here > 0] - 1):
                after = np.minimum(at + 1, len(ids) - 1)
                rank[at] = np.where((after > at) & (word[at] == word[after]), self._ranks(ids[at], ids[after]), _NEVER)
        return out

    def _merged_by_heap(self, ids: list[int]) -> list[int]:
        """The same for one long word, in order of length times its logarithm."""
        ids = [int(i) for i in ids]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (m := self.merge_of.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= len(ids) or ids[j] != y:
                continue
            ids[i], ids[j] = self.merge_of[x, y][1], -1
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < len(ids) and (m := self.merge_of.get((ids[p], ids[q]))):
                    heapq.heappush(heap, (m[0], p, ids[p], ids[q]))
        return [i for i in ids if i >= 0]

    def encode_words(self, words: Sequence[bytes]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit numbers."""
        flat, of = self.proposals(words)
        inside = np.flatnonzero(of[1:] == of[:-1])
        pairs, which = np.unique(flat[inside] * self.size + flat[inside + 1], return_inverse=True)
        fits = self.compatible(pairs // self.size, pairs % self.size)
        good = np.ones(len(words), dtype=bool)
        good[of[inside[~fits[which]]]] = False
        good[of[~self.sound[flat]]] = False
        ends = 4 * np.cumsum(np.bincount(of, minlength=len(words)))
        raw = flat.astype("<u4").tobytes()
        out = [raw[s:e] for s, e in zip([0, *ends[:-1].tolist()], ends.tolist())]
        failing = np.flatnonzero(~good).tolist()
        for k, ids in zip(failing, self.merged([words[k] for k in failing])):
            out[k] = ids
        return out


class Encoder:
    """Whole texts to ids, through a memory of the pieces met.

    A text is cut at added tokens, and the rest at each space before a character that is not white space: there
    every word begins anew, so pieces are encoded apart. New pieces of many texts are learnt together. A memory
    of more than ``most_bytes`` keeps only the pieces at hand, which costs time and changes nothing.
    """

    _CUT = re.compile(f" (?=[^{_SPACE}])")
    _SIGNS = ".,;:!?"
    _ODD = re.compile(f" (?:[{_SPACE}]|\\Z)")

    def __init__(self, vocabulary: Vocabulary, most_bytes: int = 80_000_000):
        self.vocabulary, self.most, self.used = vocabulary, most_bytes, 0
        self.known: dict[str, bytes] = {}
        self.words = regex.compile(_WORDS)

    def _pieces(self, text: str) -> Iterator[list[str]]:
        """Lists of pieces of about ``_AT_ONCE`` characters together. A piece after a space goes without it; the first goes after an "\\n"."""
        start, lead = 0, "\n"
        while True:
            found = self._CUT.search(text, start + _AT_ONCE) if len(text) - start > _AT_ONCE else None
            part = text[start:found.start() if found else len(text)]
            pieces = self._CUT.split(part) if self._ODD.search(part) else part.split(" ")
            pieces[0] = lead + pieces[0]
            yield pieces
            if not found:
                return
            start, lead = found.end(), ""

    def _learn(self, pieces: set[str]) -> None:
        """Words have the same names as pieces, so that a word met in one piece is known in all."""
        if self.used > self.most:
            self.known = {p: self.known[p] for p in pieces if p in self.known}
            self.used = sum(250 + len(p) for p in self.known)
        words, cut = [], {}
        for p in pieces.difference(self.known):
            if p.isalpha():
                words.append(p)
            elif p[-1] in self._SIGNS and p[:-1].isalpha():
                cut[p] = (p[:-1], "\n" + p[-1])
            else:
                cut[p] = [w[1:] if w[0] == " " and w[1:2] not in ("", "\n") else "\n" + w for w in self.words.findall(p[1:] if p[0] == "\n" else f" {p}")]
        if cut:
            words = list({w for parts in cut.values() for w in parts}.difference(self.known).union(words))
        text = [(w[1:] if w[0] == "\n" else f" {w}").encode() for w in words]
        self.known.update(zip(words, self.vocabulary.encode_words(text)))
        ids_of = self.known.__getitem__
        for p, parts in cut.items():
            self.known[p] = b"".join(map(ids_of, parts))
        self.used += sum(250 + len(p) for p in words) + sum(250 + len(p) for p in cut)

    def _parts(self, text: str) -> Iterator[list[str] | bytes]:
        at = 0
        found = self.vocabulary.special.finditer(text) if self.vocabulary.special else ()
        for token in [*found, None]:
            part = text[at:token.start() if token else len(text)]
            if part:
                yield from self._pieces(part)
            if token:
                yield self.vocabulary.added[token[0]].to_bytes(4, "little")
                at = token.end()

    def of(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, list[str] | bytes]] = []

        def flush() -> None:
            self._learn(set().union(*[p for _, p in waiting if isinstance(p, list)]))
            for k, p in waiting:
                out[k].append(b"".join(map(self.known.__getitem__, p)) if isinstance(p, list) else p)
            waiting.clear()

        many = 0
        for k, text in enumerate(texts):
            for part in self._parts(text):
                waiting.append((k, part))
                many += len(part)
                if many > _AT_ONCE // 4:
                    flush()
                    many = 0
        flush()
        return [b"".join(parts) for parts in out]


class Decoder:
    """Ids to texts by one gather over the bytes of all tokens; ids that no token has are passed over."""

    def __init__(self, vocabulary: Vocabulary):
        tokens = [b or b"" for b in vocabulary.bytes_of] + [b""]
        self.none = len(tokens) - 1
        self.length = np.array([len(b) for b in tokens], dtype=np.int32)
        self.start = (np.cumsum(self.length) - self.length).astype(np.int32)
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def of(self, ids: np.ndarray) -> str:
        return b"".join(self._bytes(ids[i:i + _AT_ONCE]) for i in range(0, len(ids), _AT_ONCE)).decode(errors="replace")

    def _bytes(self, ids: np.ndarray) -> bytes:
        ids = np.where((ids < 0) | (ids > self.none), self.none, ids)
        n = self.length[ids]
        ends = np.cumsum(n, dtype=np.int32)
        return self.bytes[np.repeat(self.start[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)].tobytes()


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """One for all tasks of a Python worker; its size is that of the file."""
    return Vocabulary(path)


@functools.cache
def encoder(path: str) -> Encoder:
    """One memory for all tasks of a Python worker."""
    return Encoder(vocabulary(path))


def _with(df: DataFrame, keep: Sequence[str], into: str, kind: DataType) -> StructType:
    if into in keep:
        raise ValueError(f"{into} is among the columns to keep")
    return StructType([df.schema[c] for c in keep] + [StructField(into, kind)])


def encode(docs: DataFrame, path: str, keep: Sequence[str] = ("doc_id",), text: str = "text", into: str = "ids") -> DataFrame:
    """The columns ``keep`` and the token ids of each whole text, an array of int.

    Each task takes the texts of its own input partition; nothing is shuffled. Strings of added tokens in a text
    become those tokens. A null text is as an empty one and has no ids. Keys of any kind, null and repeated
    ones, stay as they are. An empty input has no rows. ``path`` is read by every task.
    """
    schema = _with(docs, keep, into, ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path).of
        for batch in batches:
            for rows in _slices(pa.compute.coalesce(pa.compute.binary_length(batch.column(batch.num_columns - 1)), 0)):
                part = batch.slice(rows.start, len(rows))
                ids = ids_of([t or "" for t in part.column(part.num_columns - 1).to_pylist()])
                yield _replaced(part, pa.ListArray.from_arrays(_offsets([len(i) // 4 for i in ids]), pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))), schema)

    return docs.select(*keep, docs[text].cast("string").alias(into)).mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, keep: Sequence[str] = ("doc_id",), ids: str = "ids", into: str = "text") -> DataFrame:
    """The columns ``keep`` and the text of each array of ids.

    Added tokens become their strings. Null ids and those that the tokenizer has not are passed over; bytes that
    are no UTF-8 become the replacement character. A null array gives a null text. An empty input has no rows.
    """
    schema = _with(docs, keep, into, StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(vocabulary(path))
        for batch in batches:
            for rows in _slices(pa.compute.coalesce(pa.compute.list_value_length(batch.column(batch.num_columns - 1)), 0)):
                part = batch.slice(rows.start, len(rows))
                texts = [
                    decoder.of(i.values.fill_null(-1).to_numpy(zero_copy_only=False)) if i.is_valid else None
                    for i in part.column(part.num_columns - 1)]
                yield _replaced(part, pa.array(texts, pa.string()), schema)

    return docs.select(*keep, docs[ids].cast("array<int>").alias(into)).mapInArrow(run, schema)


def _slices(sizes: pa.Array) -> Iterator[range]:
    """Runs of rows of about ``_AT_ONCE`` together, so that memory holds few long rows."""
    start, total = 0, 0
    for i, n in enumerate(sizes.to_pylist()):
        if i > start and total + n > _AT_ONCE:
            yield range(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield range(start, len(sizes))


def _offsets(sizes: Sequence[int]) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))


def _replaced(batch: pa.RecordBatch, last: pa.Array, schema: StructType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns[:-1], last], schema.names)
