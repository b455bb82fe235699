"""Token counts that follow edits.

Per document, the pre-tokens of the text are the leaves of a segment tree that
holds token counts. An edit re-cuts and re-encodes only from the last boundary
that it cannot influence to the first boundary after it at which old and new
cuts agree; the changed leaves and the sums above them are updated.

The pre-token pattern has no look-behind, so what follows a boundary depends only
on the text from there on, and a pre-token looks at most ``LOOKAHEAD`` characters
past its own end. That makes both boundaries exact.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocktide.llm.common import text_or_empty

#: Folder and file of the public byte-level vocabulary; both are parameters.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: pre-token pattern of the vocabulary above.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LOOKAHEAD = 2
#: Pre-tokens whose counts a task remembers.
REMEMBERED = 400_000


class PieceCounter(dict):
    """Tokens of a pre-token, remembered."""

    def __init__(self, tokenizer: str):
        super().__init__()
        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))
        if len(self) >= REMEMBERED:
            self.clear()
        if len(piece) <= 64:
            self[piece] = n
        return n


class SegmentTree:
    """Sums over leaves; a change of some leaves updates the sums above them only."""

    def __init__(self, leaves: Sequence[int]):
        self.size = 1 << max(0, (len(leaves) - 1).bit_length())
        self.sums = [0] * self.size + list(leaves) + [0] * (self.size - len(leaves))
        for k in range(self.size - 1, 0, -1):
            self.sums[k] = self.sums[2 * k] + self.sums[2 * k + 1]

    @property
    def total(self) -> int:
        return self.sums[1]

    def replace(self, first: int, last: int, value: int) -> None:
        """Leaves ``first`` to ``last`` (exclusive) now hold ``value`` together."""
        if first >= last:
            raise ValueError("no leaf to replace")
        low, high = first + self.size, last - 1 + self.size
        self.sums[low:high + 1] = [value] + [0] * (high - low)
        while low > 1:
            low, high = low >> 1, high >> 1
            for k in range(low, high + 1):
                self.sums[k] = self.sums[2 * k] + self.sums[2 * k + 1]


def apply_edits(text: str, edits: Sequence[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end, new in edits:
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]])


def count_after_edits(text: str, edits: Sequence[tuple[int, int, str]], pattern, counts) -> tuple[int, int, int, int]:
    """Tokens before and after the edits, pre-tokens, and pre-tokens encoded anew.

    ``edits`` are (start, end, replacement) in code points of the old text,
    sorted and not overlapping.
    """
    from bisect import bisect_left, bisect_right

    starts = [m.start() for m in pattern.finditer(text)]
    bounds = starts + [len(text)]  # the pattern covers every character
    old = [counts[text[a:b]] for a, b in zip(starts, bounds[1:])]
    before = sum(old)
    if not edits:
        return before, before, len(old), 0
    if not old:  # an empty text
        new = [counts[p] for p in pattern.findall(apply_edits(text, edits))]
        return 0, sum(new), 0, len(new)
    new_text = apply_edits(text, edits)
    tree, anew, k, shift = SegmentTree(old), 0, 0, 0
    while k < len(edits):
        first = max(0, bisect_right(bounds, edits[k][0] - LOOKAHEAD) - 1)
        first = min(first, len(old) - 1)
        at, shift_here = bounds[first] + shift, shift
        end = edits[k][1]
        shift_here += len(edits[k][2]) - (edits[k][1] - edits[k][0])
        k += 1
        total, last = 0, len(old)
        for m in pattern.finditer(new_text, at):
            place = m.start() - shift_here  # in the old text, if behind all edits so far
            while k < len(edits) and edits[k][0] - LOOKAHEAD < max(place, end):
                end = edits[k][1]
                shift_here += len(edits[k][2]) - (edits[k][1] - edits[k][0])
                place = m.start() - shift_here
                k += 1
            if place >= end:
                j = bisect_left(bounds, place)
                if j < len(bounds) and bounds[j] == place and j > first:
                    last = j
                    break
            total += counts[m.group()]
            anew += 1
        else:
            while k < len(edits):  # edits at the very end
                shift_here += len(edits[k][2]) - (edits[k][1] - edits[k][0])
                k += 1
        tree.replace(first, last, total)
        shift = shift_here
    return before, tree.total, len(old), anew


def count_tokens(docs: DataFrame, edits: Column, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``(id, n_tokens, n_edits, n_tokens_edited, n_pieces, n_pieces_encoded_anew)`` for every row.

    ``edits`` is an array of (start, end, replacement) structs per row, sorted,
    not overlapping, in code points. A null text is empty and has no token; a
    null array means no edit; repeated rows and null ids give one row each;
    whole texts are counted. An empty table gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, pattern = PieceCounter(tokenizer), regex.compile(PATTERN)
        for b in batches:
            rows = []
            for text, changes in zip(b.column(1), b.column(2)):
                text, changes = text.as_py(), changes.as_py()
                if changes:
                    found = count_after_edits(text, [(e["start"], e["end"], e["replacement"]) for e in changes], pattern, counts)
                else:
                    pieces = pattern.findall(text)
                    n = sum([counts[p] for p in pieces])
                    found = n, n, len(pieces), 0
                rows.append((found[0], len(changes or ()), *found[1:]))
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, pa.int64()) for c in columns]],
                names=["id", "n_tokens", "n_edits", "n_tokens_edited", "n_pieces", "n_pieces_encoded_anew"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"), edits.alias("edits"))
    found = rows.mapInArrow(run, "id long, n_tokens long, n_edits long, n_tokens_edited long, n_pieces long, n_pieces_encoded_anew long")
    return found.withColumnRenamed("id", id_col)
