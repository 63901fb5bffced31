"""Packing of tokenised documents into sequences, balanced by attention cost.

A task packs the documents of its own partition, so nothing is shuffled: it
collects up to ``WINDOW`` tokens, cuts what fills whole sequences off long
documents, and assigns the remaining pieces in descending length to the
sequence of least cost that still has room, out of as many sequences as the
tokens need.  The cost of a piece of n tokens is ``linear`` n + ``quadratic``
n^2, as attention stays within a document.  Pieces that fit nowhere whole are
cut over the room that is left, so a window pads less than one sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomill.session import bound_batches

#: Tokens that a task packs together.
WINDOW = 1 << 22
#: Words and other chunks whose ids a worker keeps, and the longest that it keeps.
MEMO, MEMO_CHARS = 400_000, 40
#: Bytes of texts, besides the first, that are encoded together.
RUN_BYTES = 1 << 22
#: A chunk that is a word and then punctuation, in its two parts.
_WORD = "^(?P<word>[A-Za-z\u00c0-\u00d6\u00d8-\u00de\u00df-\u00f6\u00f8-\u00ff]{1,40})(?P<mark>[!-&(-/:-@\\[-`{-~]*)$"


class ChunkEncoder:
    """Token ids of texts as little-endian 32-bit bytes.

    For tokenizers that lower-case, split letters from other characters and
    end each word with a marked token, so that no token reaches over a space
    or line feed.  Each distinct chunk between those is encoded once a run of
    texts, and its ids are laid out over the run by Arrow; one that is a word
    of Latin letters and then punctuation takes the ids of its two parts, and
    new words are encoded side by side in one call.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        """``special_as_text``: the strings of special tokens are ordinary text."""
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.of_words = Tokenizer(self.tokenizer.model)  # words are lower-case letters already, with spaces between
        self.of_words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}

    def _one_by_one(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _side_by_side(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.of_words.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words) or (len(ends) and ends[-1] != len(ids)):
            return self._one_by_one(words)
        flat, at = ids.tobytes(), (4 * ends).tolist()
        return [flat[i:j] for i, j in zip([0, *at], at)]

    def _ids(self, strings: pa.Array, encode: Callable[[list[str]], list[bytes]]) -> pa.Array:
        """The ids of distinct strings, of which ``encode`` gets those that aren't known."""
        names = strings.to_numpy(zero_copy_only=False).tolist()
        new = [s for s in names if s not in self.known]
        if len(self.known) + len(new) > MEMO:
            self.known = {"": b""}
            new = [s for s in names if s]
        for lo in range(0, len(new), 5000):
            self.known.update(zip(new[lo : lo + 5000], encode(new[lo : lo + 5000])))
        out = pa.array([self.known[s] for s in names], pa.large_binary())
        for s in new:
            if len(s) > MEMO_CHARS:
                del self.known[s]
        return out

    def _chunk_ids(self, chunks: pa.Array) -> pa.Array:
        """The ids of distinct chunks."""
        found = pc.extract_regex(chunks, _WORD)
        split = found.is_valid()
        word, mark = found.drop_null().flatten()
        word, mark = pc.utf8_lower(word).dictionary_encode(), mark.dictionary_encode()
        parts = [self._ids(part.dictionary, encode).take(part.indices) for part, encode in ((word, self._side_by_side), (mark, self._one_by_one))]
        both = pc.binary_join_element_wise(*parts, pa.scalar(b"", pa.large_binary()))
        other = self._ids(chunks.filter(pc.invert(split)), self._one_by_one)
        first = split.to_numpy(zero_copy_only=False)
        return pa.concat_arrays([both, other]).take(pa.array(np.where(first, np.cumsum(first) - 1, len(both) + np.cumsum(~first) - 1)))

    def runs(self, texts: pa.Array) -> Iterator[list[bytes]]:
        """The ids of each text, in lists of those that are encoded together."""
        texts = pc.fill_null(texts, "")
        run = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)) // RUN_BYTES
        at = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)]
        for lo, hi in zip(at, at[1:] if len(texts) else []):
            split = pc.split_pattern(pc.replace_substring(texts.slice(lo, hi - lo), "\n", " "), " ")
            chunks = split.flatten().dictionary_encode()
            ids = self._chunk_ids(chunks.dictionary).take(chunks.indices)
            ends = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset :][np.cumsum(np.append(0, pc.list_value_length(split).to_numpy()))]
            flat = ids.buffers()[2] or b""
            yield [bytes(flat[i:j]) for i, j in zip(ends.tolist(), ends[1:].tolist())]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        return [x for run in self.runs(pa.array(texts, pa.string())) for x in run]


def plan(sizes: np.ndarray, capacity: int = 2048, linear: float = 1.0, quadratic: float = 1.0 / 2048) -> np.ndarray:
    """Rows (document, start, length, sequence, offset) that pack documents of the given token counts."""
    whole, rest = sizes // capacity, sizes % capacity
    doc = np.repeat(np.arange(len(sizes)), whole)
    part = np.arange(len(doc)) - np.repeat(np.cumsum(whole) - whole, whole)
    rows = [np.column_stack([doc, part * capacity, np.full(len(doc), capacity), np.arange(len(doc)), np.zeros(len(doc), np.int64)])]
    base, many = len(doc), -(-int(rest.sum()) // capacity)
    room, cost = np.full(many, capacity), np.zeros(many)
    placed, left = [], []
    for d in np.argsort(-rest, kind="stable"):
        n = int(rest[d])
        if not n:
            break
        s = int(np.where(room >= n, cost, np.inf).argmin())
        if room[s] < n:
            left.append(d)
            continue
        placed.append((d, whole[d] * capacity, n, base + s, capacity - room[s]))
        room[s] -= n
        cost[s] += linear * n + quadratic * n * n
    free = iter(np.flatnonzero(room).tolist())
    s = next(free, None)
    for d in left:
        start, n = int(whole[d]) * capacity, int(rest[d])
        while n:
            take = min(n, int(room[s]))
            placed.append((d, start, take, base + s, capacity - room[s]))
            room[s] -= take
            start, n = start + take, n - take
            if not room[s]:
                s = next(free, None)
    return np.concatenate([*rows, np.array(placed, np.int64).reshape(-1, 5)])


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048, linear: float = 1.0, quadratic: float = 1.0 / 2048, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for).

    ``tokenizer`` is the path of a tokenizer file on every executor.  A
    document is its ids, then ``end_id``; null and empty texts are that id
    alone.  Pieces of a document never overlap and cover it; those of a
    sequence lie side by side from offset 0 and hold at most ``capacity``
    tokens.  sequence_id is unique over all tasks.  Repeated rows and null ids
    are packed like others; an empty table gives no rows; other columns are
    ignored.
    """
    bound_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode, task, used = ChunkEncoder(tokenizer), TaskContext.get().partitionId() << 40, 0
        ids: list[bytes] = []
        names: list = []
        held = 0

        def flush():
            nonlocal used, held
            sizes = np.array([len(x) // 4 for x in ids], np.int64)
            rows = plan(sizes, capacity, linear, quadratic)
            pieces = [ids[d][4 * s : 4 * (s + n)] for d, s, n in rows[:, :3].tolist()]
            columns = [pa.array([names[d] for d in rows[:, 0].tolist()], pa.int64()), *(pa.array(rows[:, i]) for i in (1, 2)), pa.array(list(map(zlib.crc32, pieces)), pa.int64()), pa.array(sizes[rows[:, 0]]), pa.array(task + used + rows[:, 3]), pa.array(rows[:, 4])]
            for lo in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([*(c[lo : lo + 10_000] for c in columns), *([pa.array(pieces[lo : lo + 10_000], pa.binary())] if with_ids else [])], [*(f.split()[0] for f in SCHEMA.split(", ")), *(["ids"] if with_ids else [])])
            used += int(rows[:, 3].max(initial=-1)) + 1
            ids.clear()
            names.clear()
            held = 0

        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            lo = 0
            for run in encode.runs(batch.column("text")):
                some = [x + end for x in run]
                ids += some
                names += keys[lo : lo + len(some)]
                lo += len(some)
                held += sum(map(len, some)) // 4
                if held >= WINDOW:
                    yield from flush()
        if ids:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA + (", ids binary" if with_ids else ""))
