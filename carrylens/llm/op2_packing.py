"""Cost-balanced packing of tokenised documents into fixed-length sequences.

A piece of n tokens costs ``LINEAR * n + QUADRATIC * n * n`` (attention within
a piece).  Documents are taken in descending length; each goes to the
lowest-cost sequence that has room for it.  A document longer than a sequence
is first cut into whole sequences and a rest.  When no sequence has room for a
whole rest, the emptiest-by-cost open sequence is filled and what is left is
packed on.  The sequences of a block hold exactly its tokens: full sequences
plus a last group whose lengths are descending powers of two, which need no
padding.

Scale: one pass, no shuffle.  A task packs its documents in blocks of
``BLOCK_TOKENS``, so memory is bounded by a block (and one document) and a
lost task is repeated alone.  Sequence ids carry the partition, so tasks
number independently.

Edge cases: a null or empty text is the end token alone; the string of an added
token is that token's id, as by the tokenizer's default; a document of any
length is streamed as pieces; rows that share a doc_id are packed one by one;
other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from carrylens.llm.common import table

LENGTH = 2048
END = 1
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
BLOCK_TOKENS = 1 << 21
_BITS = 33  # sequences numbered within a partition

LONG_RUN = 20_000  # characters between two borders of white space, from which a text goes to the tokenizer file

#: A run of white space or of other characters that is long, found in one pass.
_RUN = re.compile(rf"(?<!\s)\s{{{LONG_RUN}}}|(?<!\S)\S{{{LONG_RUN}}}")
_TOKENIZERS: dict = {}


def encoder(path: str, ranks: str | None = None, pattern: str | None = None, added: bool = False):
    """A function text -> ids, as the tokenizer file at ``path`` gives them without
    tokens around the text.  Strings of added tokens in the text are plain text,
    or with ``added`` the tokens, which is the file's default.

    ``ranks`` names the same vocabulary as a rank file with its split
    ``pattern``; it serves texts of Latin characters (below U+0250), where the
    split rules of both libraries agree on every character, at several times
    the speed.  Other texts, with ``added`` those that hold an added token, and
    those with a run of LONG_RUN characters, on which the fast split's
    backtracking gives up, go to the tokenizer file itself.
    """
    key = path, ranks, pattern, added
    if key not in _TOKENIZERS:
        from tokenizers import Tokenizer

        full = Tokenizer.from_file(path)
        full.encode_special_tokens = not added
        held = [t.content for t in full.get_added_tokens_decoder().values()] if added else []
        fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table_ = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
            fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table_, special_tokens={})
        _TOKENIZERS[key] = full, fast, held
    full, fast, held = _TOKENIZERS[key]

    def encode(text: str) -> list[int]:
        if fast is not None and (text.isascii() or max(text) < "ɐ") and not any(t in text for t in held) and not (len(text) >= LONG_RUN and _RUN.search(text)):
            return fast.encode_ordinary(text)
        return full.encode(text, add_special_tokens=False).ids

    return encode


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def pack(lengths: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Document lengths -> pieces (document, start, length, sequence, offset)."""
    total = sum(lengths)
    rooms = [LENGTH] * (total // LENGTH) + [1 << b for b in range(LENGTH.bit_length() - 2, -1, -1) if (total % LENGTH) >> b & 1]
    pieces, queue, used = [], [], 0
    for doc, n in enumerate(lengths):
        whole = n // LENGTH * LENGTH
        for start in range(0, whole, LENGTH):
            pieces.append((doc, start, LENGTH, used, 0))
            used += 1
        if n > whole:
            queue.append((whole - n, doc, whole))  # negative length: longest first
    heapq.heapify(queue)
    room = np.array(rooms[used:], dtype=np.int64)
    costs = np.zeros(len(room))
    size = room.copy()
    while queue:
        n, doc, start = heapq.heappop(queue)
        n = -n
        fits = np.flatnonzero(room >= n)
        if len(fits):
            s, take = int(fits[np.argmin(costs[fits])]), n
        else:
            open_ = np.flatnonzero(room)
            s = int(open_[np.argmin(costs[open_])])
            take = int(room[s])
            heapq.heappush(queue, (take - n, doc, start + take))
        pieces.append((doc, start, take, used + s, int(size[s] - room[s])))
        room[s] -= take
        costs[s] += cost(take)
    return pieces


_PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
_NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def packer(path: str, ranks: str | None, pattern: str | None, block: int = BLOCK_TOKENS):
    """The mapInArrow function: documents (doc_id, text) -> pieces with their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, ranks, pattern, added=True)
        base = TaskContext.get().partitionId() << _BITS
        ids: list[np.ndarray] = []
        docs: list = []
        held = number = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal ids, docs, held, number
            pieces = pack([len(x) for x in ids])
            for i in range(0, len(pieces), 4096):
                part = pieces[i : i + 4096]
                cols = (
                    pa.array([docs[d] for d, *_ in part], pa.int64()), pa.array([p[1] for p in part], pa.int64()), pa.array([p[2] for p in part], pa.int64()),
                    pa.array([ids[d][s : s + n].tobytes() for d, s, n, _, _ in part], pa.binary()), pa.array([len(ids[p[0]]) for p in part], pa.int64()),
                    pa.array([base + number + p[3] for p in part], pa.int64()), pa.array([p[4] for p in part], pa.int64()),
                )
                yield pa.RecordBatch.from_arrays(list(cols), _NAMES)
            number += 1 + max((p[3] for p in pieces), default=-1)
            ids, docs, held = [], [], 0

        for b in batches:
            for doc, text in zip(b.column("doc_id"), b.column("text")):
                tokens = encode(t) if (t := text.as_py()) else []
                ids.append(np.array([*tokens, END], dtype="<u4"))
                docs.append(doc.as_py())
                held += len(ids[-1])
                if held >= block:
                    yield from flush()
        if ids:
            yield from flush()

    return run


def pack_documents(docs: DataFrame, path: str | None = None, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """documents (doc_id, text) -> one row per piece: doc_id, start, length, ids
    (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    if path is None:
        import public_tokenizers

        path, ranks, pattern = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return docs.select("doc_id", "text").mapInArrow(packer(path, ranks, pattern), _PIECES)


def op2_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    out = pack_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
