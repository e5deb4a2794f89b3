"""Packing token ids into windows by multiway differencing.

1. A scan encodes every text, appends the end id and cuts the ids into pieces:
   windows of ``CAPACITY`` ids while there are as many, then pieces of
   ``PIECE`` and the rest. Pieces with their ids are written as a table.
2. Full windows need no partner. The other pieces are dealt at random into
   groups of about ``GROUP_TOKENS`` ids; only their places and lengths are
   shuffled, never ids or texts.
3. Each group is packed by Karmarkar-Karp differencing: every piece starts as a
   partial partition, one window with the piece and the others empty. The two
   partial partitions with the largest imbalances (largest window less
   smallest) are merged with opposing order, the fullest window of the one with
   the emptiest of the other, until one is left, whose windows are near-equal.
   The number of windows starts at what the ids need at least, and rises
   whenever a window is above the capacity.
4. ``windows`` joins the ids with their places and writes whole windows.

A piece is known by ``turn``, a random number that its task gave it when the
table was written, so equal rows are dealt apart as others are and no group
grows with the number of copies. A group has a bounded number of pieces, so
does a task's memory; the larger the group, the less is padded at its end.

Texts are encoded by runs between spaces with a bounded memo, which gives the
ids of whole texts (see ``RunEncoder``); texts that hold a control string
(``<|endoftext|>``) go to the tokenizer whole. Long texts are taken in blocks.

Defined results: a null text counts as empty and has only the end id; rows
without an id are packed like others, repeated rows once each; an empty table
gives an empty result. A window of a power of two needs no padding, any other
is padded to the capacity. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import os
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.blocks import groups
from quarry.llm.rows import slices, small_batches
from quarry.llm.shared import stage
from quarry.llm.token_output import TokenizerFile

CAPACITY, PIECE = 2048, 512
END_ID = 1
#: Ids of the pieces of one group, on average.
GROUP_TOKENS = 250_000
#: Runs whose ids a worker remembers, and characters that it takes at a time.
MEMO_RUNS = 600_000
BLOCK_CHARS = 500_000
#: The ids are most of a worker's table: row groups of 16 MB keep little of it in memory.
ROW_GROUP = {"parquet.block.size": 16 << 20}
#: Pieces that a task sends at a time.
PIECES_AT_ONCE = 1000

#: White space of the pre-tokenizer's pattern (Unicode's White_Space).
BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A space that starts a word.
WORD_SPACE = re.compile(f" (?=[^{BLANK}])")
RUNS = re.compile(f" ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]")
#: Letters, which are one word of the pre-tokenizer, and marks after them, which are another.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
MARKS = "!-&(-/:-@\\[-`{-~"
WORD = re.compile(f"(\\n?)([{LETTERS}]+)([{MARKS}]*)").fullmatch

_encoders: dict[str, RunEncoder] = {}


class RunEncoder:
    """Encodes texts by runs between spaces and line ends, with a memo.

    The pre-tokenizer always starts a word at a space or line end before a
    character that isn't white space, so the ids of a text are those of its
    runs. A key of the memo is a run without the space before it; a run after a
    line end has that in the key; and ``\\t`` before a key says that it stands as
    it is. Runs of letters, marks after them apart, go to the model directly,
    since they are one word each; all others go to the tokenizer.
    """

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.controls = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenize = self.tokenizer.model.tokenize
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in range(256) if re.match(f"[ {LETTERS}]", chr(c))]
        self.bytes = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in letters})
        self.line_end = self._whole("\n")
        self.memo = _Memo(self)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def run(self, key: str) -> bytes:
        """The ids of a key that the memo doesn't have. Marks after a word that
        is new itself aren't remembered with it."""
        memo = self.memo
        if found := WORD(key):
            line, letters, marks = found.groups()
            word = line + letters
            ids = memo.get(word)
            seen = ids is not None
            if not seen:
                bare = letters if line else " " + letters
                ids = array("I", [t.id for t in self.tokenize(bare.translate(self.bytes))]).tobytes()
                memo[word] = ids = self.line_end + ids if line else ids
            if marks:
                ids += memo["\t" + marks]
                if seen:
                    memo[key] = ids
            return ids
        memo[key] = ids = self._whole(key[1:] if key[:1] == "\t" else key if key[:1] == "\n" else " " + key)
        return ids

    def _keys(self, text: str) -> list[str]:
        """The keys of a text's runs after a line end that it doesn't have."""
        keys: list[str] = []
        for line in text.split("\n"):
            words = line.split()
            if not words or " ".join(words) != line:  # other white space than single spaces and line ends between words
                return ["\t\n", *(r[1:] if r[0] == " " and WORD_SPACE.match(r) else "\t" + r for r in RUNS.findall(text))]
            words[0] = "\n" + words[0]
            keys += words
        return keys

    def _block(self, text: str) -> bytes:
        if len(self.memo) > MEMO_RUNS:
            self.memo.clear()
        return b"".join(map(self.memo.__getitem__, self._keys(text)))[len(self.line_end) :]

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        text = text or ""
        if any(map(text.__contains__, self.controls)):
            return self._whole(text)
        out, at = [], 0
        while end := WORD_SPACE.search(text, at + BLOCK_CHARS):
            out.append(self._block(text[at : end.start()]))
            at = end.start()
        return b"".join([*out, self._block(text[at:])])


class _Memo(dict):
    """Ids of keys; what it doesn't have it gets from the encoder."""

    def __init__(self, encoder: RunEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, key: str) -> bytes:
        return self.encoder.run(key)


def encoder(source: TokenizerFile) -> RunEncoder:
    """The worker's encoder for a tokenizer file; it outlives a task."""
    if source.id not in _encoders:
        _encoders.clear()
        _encoders[source.id] = RunEncoder(source.value)
    return _encoders[source.id]


def cuts(n: int, capacity: int = CAPACITY, piece: int = PIECE) -> list[int]:
    """Where the pieces of n ids begin, and n."""
    whole = n - n % capacity
    return [*range(0, whole, capacity), *range(whole, n, piece), n]


PIECES = "doc_id long, start long, length int, doc_tokens long, turn long, ids binary"


def encode_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    capacity: int = CAPACITY,
    piece: int = PIECE,
) -> DataFrame:
    """The pieces of all documents with their ids (little-endian unsigned 32-bit integers)."""
    source = TokenizerFile(docs.sparkSession, tokenizer_path)
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(source)
        rng = np.random.default_rng(TaskContext.get().partitionId())

        def done() -> pa.RecordBatch:
            turn = rng.integers(0, 1 << 62, len(doc_ids))
            return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int32()), pa.array(whole, pa.int64()), pa.array(turn), pa.array(ids, pa.binary())], ["doc_id", "start", "length", "doc_tokens", "turn", "ids"])

        doc_ids, starts, lengths, whole, ids = [], [], [], [], []
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = memoryview(enc.encode(text) + end)
                at = cuts(len(raw) // 4, capacity, piece)
                for lo, hi in zip(at, at[1:], strict=False):
                    doc_ids.append(doc_id)
                    starts.append(lo)
                    lengths.append(hi - lo)
                    whole.append(at[-1])
                    ids.append(raw[4 * lo : 4 * hi])
                if len(ids) >= PIECES_AT_ONCE:
                    yield done()
                    doc_ids, starts, lengths, whole, ids = [], [], [], [], []
        yield done()

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInArrow(run, PIECES)


def differencing(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Deal sizes into k parts with near-equal sums: the part of each size, and the sums."""
    n = len(sizes)
    order = np.argsort(-sizes, kind="stable").tolist()
    sums: list[np.ndarray] = []
    merges: list[tuple[int, int, np.ndarray]] = []
    heap = []
    for node, i in enumerate(order):
        part = np.zeros(k, np.int64)
        part[-1] = sizes[i]
        sums.append(part)
        heap.append((-int(part[-1] - part[0]), node))
    while len(heap) > 1:  # sorted by imbalance, so it is a heap from the beginning
        _, a = heapq.heappop(heap)
        _, b = heap[0]
        both = sums[a] + sums[b][::-1]
        places = np.argsort(both, kind="stable")
        both = both[places]
        sums[a] = sums[b] = None
        merges.append((a, b, places.astype(np.int32)))
        sums.append(both)
        heapq.heapreplace(heap, (int(both[0] - both[-1]), len(sums) - 1))
    # From the last merge back: which part each window of a partial partition became.
    parts: list[np.ndarray | None] = [None] * len(sums)
    parts[-1] = np.arange(k, dtype=np.int32)
    for m in range(len(merges) - 1, -1, -1):
        a, b, places = merges[m]
        mine = np.empty(k, np.int32)
        mine[places] = parts[n + m]
        parts[n + m] = None
        parts[a], parts[b] = mine, mine[::-1]
    out = np.empty(n, np.int64)
    for node, i in enumerate(order):
        out[i] = parts[node][-1]
    return out, sums[-1]


def windows_of(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """The window of each size, as few windows as differencing gets below the capacity, and their number."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        part, sums = differencing(sizes, k)
        if sums.max() <= capacity:
            return part, k
        k += 1


#: Windows of a group have numbers below this.
STRIDE = 1 << 32
KEYS = "group long, doc_id long, start long, length int, doc_tokens long, turn long, ids_crc32 long"
PLACES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, turn long"


def _placed(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 1):
            group = group.sort_by([("turn", "ascending"), ("start", "ascending")])
            sizes = group.column("length").to_numpy().astype(np.int64)
            window = np.empty(len(sizes), np.int64)
            full = np.flatnonzero(sizes == capacity)
            part = np.flatnonzero(sizes != capacity)
            window[full] = np.arange(len(full))
            if len(part):
                window[part] = windows_of(sizes[part], capacity)[0] + len(full)
            order = np.argsort(window, kind="stable")
            before = np.cumsum(sizes[order]) - sizes[order]
            first = np.flatnonzero(np.diff(window[order], prepend=-1))
            offset = np.empty(len(sizes), np.int64)
            offset[order] = before - np.repeat(before[first], np.diff(first, append=len(order)))
            columns = {
                "doc_id": group.column("doc_id"),
                "start": group.column("start"),
                "length": pa.array(sizes),
                "ids_crc32": group.column("ids_crc32"),
                "doc_tokens": group.column("doc_tokens"),
                "sequence_id": pa.array(group.column("group")[0].as_py() * STRIDE + window),
                "offset": pa.array(offset),
                "turn": group.column("turn"),
            }
            yield from pa.table(columns).to_batches()

    return run


def place(pieces: DataFrame, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Where each piece goes: its columns but for the ids (their crc32 in
    ``ids_crc32``), ``sequence_id`` and ``offset``. pieces: a written table of
    ``encode_pieces``."""
    left = F.when(F.col("length") < capacity, F.col("length")).otherwise(0)
    total = pieces.agg(F.sum(left)).first()[0] or 0
    n = max(1, round(total / group_tokens))
    keys = pieces.withColumns({"group": F.pmod("turn", F.lit(n)), "ids_crc32": F.crc32("ids")}).select(*(c.split()[0] for c in KEYS.split(", ")))
    return keys.repartition("group").sortWithinPartitions("group").mapInArrow(_placed(capacity), PLACES)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Pieces of all documents with their ids, and the place of each piece, both written tables."""
    with small_batches(docs.sparkSession):
        pieces = stage(encode_pieces(docs, tokenizer_path, id_col, text_col, capacity=capacity, piece=max(1, capacity // 4)), "pieces", **ROW_GROUP)
    return pieces, stage(place(pieces, capacity, group_tokens), "places")


def windows(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """The windows themselves: ``sequence_id``, ``n_tokens`` and ``ids``, the ids
    of its pieces one after another as little-endian unsigned 32-bit integers."""
    keys = ["turn", "doc_id", "start"]
    same = [p.eqNullSafe(q) for p, q in ((F.col(f"p.{k}"), F.col(f"q.{k}")) for k in keys)]
    rows = places.alias("p").join(pieces.select(*keys, "ids").alias("q"), same)
    part = F.struct("p.offset", "p.length", "q.ids")
    found = rows.groupBy("p.sequence_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))  # at most a window's ids
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda ids, x: F.concat(ids, x["ids"]))
    n = F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    return found.select("sequence_id", n.alias("n_tokens"), joined.alias("ids"))


def packing_digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per piece, without ``turn``."""
    return pack(docs, tokenizer_path)[1].drop("turn")
