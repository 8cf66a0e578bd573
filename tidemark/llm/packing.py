"""Documents as token ids, packed into training windows by best-fit decreasing.

A document is its token ids and one end id.  Overlong documents are first cut
into full windows; what is left of each goes, longest first, into the tightest
open window, found by a segment tree over remaining capacities.

Packing runs where the tokens are made: each task packs its own pieces in
blocks of bounded size, without a shuffle, so memory follows the block and a
lost executor repeats only its own blocks.  Blocks pad only their last few
windows (`block_pieces` is a parameter).

Edge cases: a null or empty text is the end id alone; repeated rows are packed
each; null ids pass through; other columns are ignored by `token_pieces`; very
long texts are cut into as many windows as they need; an empty table gives an
empty result.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import tokens as tk

# Fixed value: how byte-level tokenizers of this family split a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# A byte-level tokenizer that splits like GPT-2 always starts a new piece at a
# space before a visible character.  Bytes after which that is certain: visible
# ASCII and lead bytes under which no Unicode space exists.
_BYTES = np.arange(256)
VISIBLE = ((_BYTES > 0x20) & (_BYTES < 0x7F)) | ((_BYTES >= 0xC3) & ~np.isin(_BYTES, (0xE1, 0xE2, 0xE3)))


class Encoder:
    """Ids of many texts, with each distinct space-led chunk of a slice tokenized once.

    The distinct chunks are encoded as one text: a cut always falls before each
    of them, and the byte length of every token tells which chunk it belongs to.
    A tokenizer file whose ids follow its merge order is run by tiktoken, which
    gives the same ids faster; any other, and any slice that spells out a
    special token, by tokenizers.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.special = [t["content"].encode() for t in told.get("added_tokens", [])]
        self.ranked, self.sizes = ranked_encoder(told)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets of each text in them)."""
        data, offsets = tk.raw(column)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        blob = data.tobytes()
        if self.ranked is None or any(s in blob for s in self.special):
            parts = [blob[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            lists = [e.ids for e in self.tokenizer.encode_batch(parts, add_special_tokens=False)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            return np.fromiter((i for x in lists for i in x), np.uint32, int(ends[-1])), ends
        starts, ends = chunks(data, offsets)
        _, one, which = np.unique(tk.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        led = data[starts[one]] == 0x20
        led &= VISIBLE[data[np.minimum(starts[one] + 1, len(data) - 1)]] & (ends[one] - starts[one] > 1)
        order = np.concatenate([np.flatnonzero(led), np.flatnonzero(~led)])  # chunks that open a text stand alone
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        one = one[order]
        joined = int(led.sum())
        encode = self.ranked.encode_ordinary
        ids = [np.array(encode(tk.strings(data, starts[one[:joined]], ends[one[:joined]]).decode()), np.uint32)]
        ids += [np.array(encode(blob[a:b].decode()), np.uint32) for a, b in zip(starts[one[joined:]].tolist(), ends[one[joined:]].tolist())]
        ids = np.concatenate(ids)
        edge = np.concatenate([[0], np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(ends[one] - starts[one]), "left") + 1])
        which = place[which]
        sizes = np.diff(edge)[which]
        total = np.concatenate([[0], np.cumsum(sizes)])
        return ids[tk.ranges(edge[which], sizes)], total[np.searchsorted(starts, offsets)]


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that are tokenized alike wherever they stand: cut at text starts and before spaces that lead something visible."""
    cut = np.zeros(len(data) + 1, bool)
    cut[:-2] = (data[:-1] == 0x20) & VISIBLE[data[1:]]
    cut[offsets[1:][offsets[1:] > 0] - 1] = False  # the byte after a text's last belongs to the next text
    cut[offsets] = True
    cut[-1] = False
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], len(data))


def ranked_encoder(told: dict):
    """(tiktoken encoding, byte length of every token) of a byte-level BPE file, or (None, None) where ids do not follow merges."""
    model, split = told["model"], told.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True)
    if not plain or split.get("add_prefix_space") or told.get("normalizer") or model.get("ignore_merges"):
        return None, None
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    special = {t["content"] for t in told.get("added_tokens", [])}
    vocabulary = {t: i for t, i in model["vocab"].items() if t not in special}
    if sorted(vocabulary.values()) != list(range(256 + len(merges))) or any(
        vocabulary.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)
    ):
        return None, None
    import tiktoken

    # the printable stand-ins of byte-level vocabularies: printable bytes are themselves, others follow from 256 on
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    as_byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}
    ranks = {bytes(as_byte[c] for c in t): i for t, i in vocabulary.items()}
    sizes = np.zeros(len(ranks), np.int64)
    for token, i in ranks.items():
        sizes[i] = len(token)
    return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long"
TOKEN_SLICE = 1 << 20  # a slice costs some forty times its bytes while it is encoded


def pieces_of(batches: Iterator[pa.RecordBatch], tokenizer: str, window: int, end_id: int) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(tokenizer)
    for batch in batches:
        for rows in tk.slices(batch, limit=TOKEN_SLICE):
            ids, offsets = encoder.encode(rows.column("text"))
            total = np.diff(offsets) + 1
            at = np.concatenate([[0], np.cumsum(total)])
            flat = np.full(at[-1], end_id, "<u4")
            body = np.ones(at[-1], bool)
            body[at[1:] - 1] = False
            flat[body] = ids
            pieces = -(-total // window)
            doc = np.repeat(np.arange(len(total)), pieces)
            start = tk.ranges(np.zeros(len(total), np.int64), pieces) * window
            length = np.minimum(window, total[doc] - start)
            edge = np.concatenate([[0], np.cumsum(length)]) * 4
            blob = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(length), [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(flat)]
            ).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), blob, pa.array(total[doc])],
                names=["doc_id", "start", "length", "ids", "doc_tokens"],
            )


def token_pieces(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens): each document cut into full windows and a rest.

    `ids` holds little-endian unsigned 32-bit token ids.
    """
    run = lambda batches: pieces_of(batches, tokenizer, window, end_id)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


class OpenWindows:
    """Open windows by remaining capacity, with a segment tree that finds the tightest one that fits."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.held: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _change(self, capacity: int, by: int) -> None:
        at = capacity + self.leaves
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, capacity: int, window: int) -> None:
        self.held[capacity].append(window)
        self._change(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, window) of the least capacity of at least `need`, taken out; None if no window fits."""
        at = need + self.leaves
        while not self.count[at]:
            while at & 1:  # right children have nothing to their right under the same parent
                at >>= 1
                if at <= 1:
                    return None
            at += 1
        while at < self.leaves:
            at *= 2
            if not self.count[at]:
                at += 1
        capacity = at - self.leaves
        self._change(capacity, -1)
        return capacity, self.held[capacity].pop()


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(window number, offset in it) of each piece, and the number of windows."""
    number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    full = lengths == window
    opened = int(full.sum())
    number[full] = np.arange(opened)
    free = OpenWindows(window)
    rest = np.flatnonzero(~full)
    for i in rest[np.argsort(-lengths[rest], kind="stable")].tolist():
        need = int(lengths[i])
        found = free.take(need)
        if found is None:
            found, opened = (window, opened), opened + 1
        capacity, at = found
        number[i], offset[i] = at, window - capacity
        if capacity > need:
            free.put(capacity - need, at)
    return number, offset, opened


def blocks(batches: Iterator[pa.RecordBatch], pieces: int, size: int) -> Iterator[pa.Table]:
    held, rows, weight = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, weight = rows + batch.num_rows, weight + batch.nbytes
        if rows >= pieces or weight >= size:
            yield pa.Table.from_batches(held)
            held, rows, weight = [], 0, 0
    if rows:
        yield pa.Table.from_batches(held)


def placed(batches: Iterator[pa.RecordBatch], window: int, block_pieces: int, block_bytes: int) -> Iterator[pa.RecordBatch]:
    base = TaskContext.get().partitionId() << 33
    for block in blocks(batches, block_pieces, block_bytes):
        number, offset, opened = best_fit(block.column("length").to_numpy(), window)
        yield from (
            block.append_column("sequence_id", pa.array(base + number)).append_column("offset", pa.array(offset)).to_batches()
        )
        base += opened


def pack(
    docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, digest: bool = False,
    block_pieces: int = 20_000, block_bytes: int = 64 << 20,
) -> DataFrame:
    """Every piece of every document with its ids and its place (sequence_id, offset).

    With `digest` the ids' CRC-32 stands in for the ids (`ids_crc32`), which keeps rows narrow.
    """

    def told(pieces):
        for p in pieces:
            at = p.schema.get_field_index("ids")
            yield p.set_column(at, "ids_crc32", pa.array([zlib.crc32(x) for x in map(memoryview, p.column("ids").to_pylist())], pa.int64()))

    def run(batches):
        pieces = pieces_of(batches, tokenizer, window, end_id)
        yield from placed(told(pieces) if digest else pieces, window, block_pieces, block_bytes)

    schema = PIECES.replace("ids binary", "ids_crc32 long") if digest else PIECES
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, f"{schema}, sequence_id long, offset long"
    )


def pack_digest(docs: DataFrame, tokenizer: str, window: int = 1024) -> DataFrame:
    """One row per piece: its place and a digest of its ids."""
    return pack(docs, tokenizer, window, digest=True)
