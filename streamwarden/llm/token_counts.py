"""Token counts by heap-and-linked-list byte-pair merging, without emitting identifiers.

Each distinct chunk of a batch is merged once: the symbols of a word form a linked
list, a heap holds its adjacent pairs by (rank, place), and the lowest is popped until
none can merge. The count is the initial symbols minus the merges. Work is linear in
the text but for the heap's logarithm, so a very long word is no special case.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import held, parts, picked
from .word_pieces import Memo


def merged_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Tokens left when ``symbols`` are merged lowest rank first, leftmost of equals first."""
    n = count = len(symbols)
    if n < 2:
        return n
    rank = ranks.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1)
            if (r := rank((symbols[i], symbols[i + 1]))) is not None]
    heapify(heap)
    while heap:
        _, i, left, right = heappop(heap)
        j = after[i]
        if symbols[i] != left or j >= n or symbols[j] != right:
            continue  # one of the two has merged since
        symbols[i], symbols[j] = left + right, ""
        k = after[i] = after[j]
        count -= 1
        if k < n:
            before[k] = i
            if (r := rank((symbols[i], symbols[k]))) is not None:
                heappush(heap, (r, i, symbols[i], symbols[k]))
        h = before[i]
        if h >= 0 and (r := rank((symbols[h], symbols[i]))) is not None:
            heappush(heap, (r, h, symbols[h], symbols[i]))
    return count


def word_counts(v, words: list[str]) -> list[int]:
    """Tokens of words given in the byte alphabet."""
    return [merged_count([*w[:-1], w[-1] + v.end], v.ranks) for w in words]


def count_tokens(texts: list[str | None], path: str) -> list[int]:
    memo = held(f"counts {path}", lambda: Memo(path, word_counts, sum))
    return [sum(1 if special else sum(counts) for special, counts in split) for split in memo.values(texts)]


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text.

    A null text counts as empty: 0 bytes, 0 tokens. Null and repeated ids and repeated
    rows are kept as they are; an empty table gives no rows. Special strings inside a
    text are one token each.
    """
    def counted(batches):
        for batch in parts(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2),
                 pa.array(np.array(count_tokens(batch.column(1).to_pylist(), path), np.int64))],
                names=["doc_id", "n_bytes", "n_tokens"])

    rows = picked(docs, doc_id=id, text=text)
    rows = rows.withColumn("n_bytes", F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(counted, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
