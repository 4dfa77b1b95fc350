"""Token counts of a byte-level BPE by the whole-token shortcut.

Offline, on the driver, every string of the vocabulary is merged by the ranks alone; those that end as one token are proved
whole. A text is cut into pre-tokens by the tokenizer's pattern; a pre-token that is a proved string counts as one token,
and only the others are merged (each distinct one once a task, as long as it is remembered). A string of the vocabulary that
merging can't reach is none of the proved ones, and counts as what merging makes of it.
"""

from __future__ import annotations

import base64
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import keyed, parts, ship

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_MEMORY = 1 << 18
_LONG = 64


def read_ranks(vocabulary: str) -> dict[bytes, int]:
    out = {}
    for line in Path(vocabulary).read_bytes().splitlines():
        token, rank = line.split()
        out[base64.b64decode(token)] = int(rank)
    return out


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The tokens of a pre-token: always the leftmost pair of lowest rank is merged."""
    if len(piece) > _LONG:
        return _merge_long(piece, ranks)
    parts_ = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts_) > 1:
        best, at = None, -1
        for i in range(len(parts_) - 1):
            r = ranks.get(parts_[i] + parts_[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts_[at : at + 2] = [parts_[at] + parts_[at + 1]]
    return parts_


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """merge() by a heap, in time n log n: a linked list of parts, pairs taken by (rank, place)."""
    import heapq

    n = len(piece)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or (j := after[i]) >= n or end[j] != stop:
            continue
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    return [piece[i : end[i]] for i in range(n) if alive[i]]


def whole_tokens(ranks: dict[bytes, int]) -> set[str]:
    """The vocabulary's strings that merging alone turns into one token."""
    out = set()
    for token in ranks:
        try:
            text = token.decode()
        except UnicodeDecodeError:
            continue
        if len(merge(token, ranks)) == 1:
            out.add(text)
    return out


class PieceCounter:
    """Counts of a text's tokens; what is not proved whole is merged.

    A piece that is no string of the vocabulary is merged by tiktoken, as one pre-token. One that is, but wasn't proved, is merged
    here, since tiktoken would look it up and not merge it.
    """

    def __init__(self, ranks: dict[bytes, int], whole: set[str], pattern: str = PATTERN):
        import regex
        import tiktoken

        self.find = regex.compile(pattern).findall
        self.merged = tiktoken.Encoding("pieces", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.ranks, self.whole, self.memory = ranks, whole, {}

    def size(self, piece: str) -> int:
        raw = piece.encode()
        return len(merge(raw, self.ranks) if raw in self.ranks else self.merged(piece))

    def count(self, text: str) -> tuple[int, int, int]:
        """Tokens, pre-tokens, and those of them that were counted directly."""
        pieces = self.find(text)
        whole, memory = self.whole, self.memory
        rest = [p for p in pieces if p not in whole]
        tokens = len(pieces) - len(rest)
        for p in rest:
            size = memory.get(p)
            if size is None:
                size = self.size(p)
                if len(p) <= _LONG:
                    if len(memory) >= _MEMORY:
                        memory.clear()
                    memory[p] = size
            tokens += size
        return tokens, len(pieces), len(pieces) - len(rest)


def _count(ranks: dict[bytes, int], whole: set[str], pattern: str):
    def run(batches):
        counter = PieceCounter(ranks, whole, pattern)
        for b in parts(batches):
            got = np.array([counter.count(t or "") for t in b.column(1).to_pylist()], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(got[:, k].copy()) for k in range(3))], ["doc_id", "n_tokens", "n_pretokens", "n_whole"])

    return run


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_tokens, n_pretokens, n_whole for each row of docs: its tokens, its pre-tokens, those counted directly.

    Nulls and empty texts have 0 of each; very long texts count whole; repeated rows are each counted; a document without doc_id
    goes by a negative number from its text's hash. Strings of special tokens are ordinary text. An empty table gives no
    rows; columns other than doc_id and text don't matter. The vocabulary (of fixed size) is read by the driver.
    """
    spark = docs.sparkSession
    ship(spark)
    ranks = read_ranks(vocabulary)
    return keyed(docs).select("key", "text").mapInArrow(_count(ranks, whole_tokens(ranks), pattern), "doc_id long, n_tokens long, n_pretokens long, n_whole long")
