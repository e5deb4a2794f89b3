"""Token ids in directly addressable code files.

A shard holds the token ids of consecutive documents. Ids are cut into
chunks of ``CHUNK_BITS`` bits. Level 0 has the lowest chunk of every id;
level k has chunk k of those ids that need it. A continuation bitmap beside
each level says which ids go on, and a rank directory (set bits before every
512th position) turns a position on one level into the position on the next.
Any token is read with one probe per level, without decoding its neighbours.

Layout of a shard, little-endian: the header (``<4sHHQQ``: magic ``DAC1``,
version, number of levels, documents, tokens), then the 64-bit lengths of the
levels, then the sections, each padded to eight bytes: document ids (int64), a
bitmap of those that are null, document starts (int64, one more than
documents) and for each level its chunks (uint8), bitmap (bits, lowest first)
and rank directory (uint64).

Defined results: a null text counts as empty and has only the end id; a null
document id sorts first; repeated rows are written once each; an empty table
makes no shard. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.rows import slices

MAGIC, VERSION, HEADER = b"DAC1", 1, "<4sHHQQ"
CHUNK_BITS = 8
RANK_BYTES = 64
END_ID = 1
#: A shard is closed at the first document end after so many tokens.
SHARD_TOKENS = 1 << 23
#: Words whose ids a worker remembers, and words of texts that it takes at a time.
MEMO_WORDS = 400_000
LEARN_WORDS = 400_000

MANIFEST = "part int, seq int, file string, n_docs long, n_tokens long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"

#: Words of plain letters that the model gets as one text.
JOINED = 1000

#: Marks that are a word of their own after a letter (apostrophes aren't).
MARKS = b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
#: Letters that no normal form changes and that lower-case one by one.
LETTERS = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00de\u00df-\u00f6\u00f8-\u00ff]+").fullmatch

_encoders: dict[int, WordEncoder] = {}


class WordEncoder:
    """Encodes texts word by word with a memo.

    The tokenizer's pre-tokenizer never joins characters across white space,
    so the ids of a text are those of its words, one after another, and a word
    that comes again costs one dictionary lookup. Lower-casing A-Z first
    changes nothing, since the tokenizer does so itself. New words of plain
    letters, which the tokenizer's normalizer and pre-tokenizer leave whole,
    go to its model directly, ``JOINED`` at a time, as the ids that end a word tell where each ends. Marks
    after a word's last letter are a word of their own. A text with a control string, such as ``<|endoftext|>``, in any case
    of letters, goes to the tokenizer whole, as it is; so only the words of
    other texts are taken literally.
    """

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.json = tokenizer_json
        # What only becomes a control string by lower-casing is none.
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = True
        self.controls = [t.content.encode("utf-8", "replace").lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain = Tokenizer(self.tokenizer.model)
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "removed"), level])
        suffix, ids = getattr(self.tokenizer.model, "end_of_word_suffix", None), self.tokenizer.get_vocab(True)
        self.ends = np.zeros(max(ids.values()) + 1, bool)
        self.ends[[i for token, i in ids.items() if suffix and token.endswith(suffix)]] = True
        self.memo: dict[bytes, bytes] = {}

    def _add(self, tokenizer, words: list[bytes], texts: list[str]) -> None:
        for i in range(0, len(words), 20_000):
            found = tokenizer.encode_batch_fast(texts[i : i + 20_000], add_special_tokens=False)
            self.memo.update(zip(words[i : i + 20_000], (array("I", e.ids).tobytes() for e in found), strict=True))

    def _add_plain(self, words: list[bytes], texts: list[str]) -> None:
        for i in range(0, len(words), JOINED):
            some = slice(i, i + JOINED)
            ids = array("I", self.plain.encode_batch_fast(["\n".join(texts[some])], add_special_tokens=False)[0].ids)
            cuts = [0, *((np.flatnonzero(self.ends[np.frombuffer(ids, np.uintc)]) + 1) * 4).tolist()]
            raw = ids.tobytes()
            if len(cuts) == len(words[some]) + 1 and cuts[-1] == len(raw):
                self.memo.update(zip(words[some], [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))
            else:  # a model whose ids don't tell
                self._add(self.plain, words[some], texts[some])

    def learn(self, words: set[bytes]) -> None:
        memo = self.memo
        new = words.difference(memo)
        if len(memo) + 2 * len(new) > MEMO_WORDS and memo:
            kept = {w: memo[w] for w in words.difference(new)}
            memo.clear()
            memo.update(kept)
        ended = []
        for w in new:
            stem = w.rstrip(MARKS)
            if len(stem) < len(w) and (stem[-1:].isalpha() or (stem[-2:-1] == b"\xc3" and stem[-1:] not in b"\x97\xb7")):
                ended.append((w, stem, w[len(stem) :]))
        need = new.difference([w for w, _, _ in ended])
        for part in (1, 2):
            need.update([x[part] for x in ended])
        need = list(need.difference(memo))
        plain, lower, other = [], [], []
        for w, text in zip(need, b"\n".join(need).decode("utf-8", "replace").lower().split("\n") if need else (), strict=True):
            if text.isalpha() and (text.isascii() or LETTERS(text)):
                plain.append(w)
                lower.append(text)
            else:
                other.append(w)
        rest = [w.decode("utf-8", "replace") for w in other]
        self._add_plain(plain, lower)
        self._add(self.tokenizer, other, rest)
        for w, stem, marks in ended:
            memo[w] = memo[stem] + memo[marks]

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        some: list[tuple[str | None, list[bytes]]] = []  # a text that goes whole, or words
        size = 0
        for text in texts:
            raw = (text or "").encode("utf-8", "replace").lower()
            some.append((text, []) if any(map(raw.__contains__, self.controls)) else (None, raw.split()))
            size += len(some[-1][1])
            if size >= LEARN_WORDS:
                yield from self._encoded(some)
                some, size = [], 0
        yield from self._encoded(some)

    def _encoded(self, some: list[tuple[str | None, list[bytes]]]) -> Iterator[bytes]:
        self.learn(set().union(*(words for _, words in some)))
        for text, words in some:
            yield b"".join(map(self.memo.__getitem__, words)) if text is None else array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    @cached_property
    def whole(self):
        """The tokenizer as it is, loaded for the first text that needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.json)


def encoder(tokenizer_json) -> WordEncoder:
    """The worker's encoder for a broadcast tokenizer file; it outlives a task."""
    if tokenizer_json.id not in _encoders:
        _encoders.clear()
        _encoders[tokenizer_json.id] = WordEncoder(tokenizer_json.value)
    return _encoders[tokenizer_json.id]


class TokenizerFile:
    """A tokenizer file's text as a Spark broadcast."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, encoding="utf-8") as f:
            self.broadcast = spark.sparkContext.broadcast(f.read())
        self.id = path

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self) -> str:
        return self.broadcast.value


def _padded(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % 8)


def pack_shard(doc_ids: list[int | None], starts: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard's bytes. starts: the position of each document's first token,
    then the number of tokens."""
    levels, rest = [], ids.astype(np.uint64)
    while True:
        chunk = (rest & ((1 << CHUNK_BITS) - 1)).astype(np.uint8)
        rest = rest >> np.uint64(CHUNK_BITS)
        more = rest != 0
        bitmap = np.packbits(more, bitorder="little")
        counts = np.bitwise_count(np.pad(bitmap, (0, -len(bitmap) % RANK_BYTES)).reshape(-1, RANK_BYTES)).sum(1)
        ranks = np.concatenate([[0], np.cumsum(counts)]).astype("<u8")
        levels.append((len(chunk), chunk.tobytes(), bitmap.tobytes(), ranks.tobytes()))
        rest = rest[more]
        if not len(rest):
            break
    parts = [struct.pack(HEADER, MAGIC, VERSION, len(levels), len(doc_ids), len(ids))]
    parts.append(np.array([x[0] for x in levels], "<u8").tobytes())
    parts.append(np.array([x or 0 for x in doc_ids], "<i8").tobytes())
    parts.append(np.packbits(np.array([x is None for x in doc_ids], bool), bitorder="little").tobytes())
    parts.append(starts.astype("<i8").tobytes())
    for _, *sections in levels:
        parts += sections
    return b"".join(map(_padded, parts))


class Shard:
    """Reads a shard from any buffer, such as a memory map."""

    def __init__(self, buffer):
        magic, version, n_levels, self.n_docs, self.n_tokens = struct.unpack_from(HEADER, buffer)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a shard of token ids")
        at = struct.calcsize(HEADER)
        at += -at % 8

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(buffer, kind, n, at)
            at += found.nbytes + -found.nbytes % 8
            return found

        lengths = take("<u8", n_levels)
        ids, null = take("<i8", self.n_docs), take("u1", -(-self.n_docs // 8))
        self._null = np.unpackbits(null, count=self.n_docs, bitorder="little").astype(bool)
        self._ids = ids
        self.starts = take("<i8", self.n_docs + 1)
        self.levels = []
        for n in map(int, lengths):
            chunk, bitmap = take("u1", n), take("u1", -(-n // 8))
            self.levels.append((chunk, bitmap, take("<u8", -(-len(bitmap) // RANK_BYTES) + 1)))

    @property
    def doc_ids(self) -> list[int | None]:
        return [None if gone else int(x) for x, gone in zip(self._ids, self._null, strict=True)]

    @staticmethod
    def _rank(bitmap: np.ndarray, ranks: np.ndarray, i: int) -> int:
        block = i // (8 * RANK_BYTES)
        done = int(ranks[block]) + int(np.bitwise_count(bitmap[block * RANK_BYTES : i // 8]).sum())
        return done + (int(bitmap[i // 8]) & ((1 << i % 8) - 1)).bit_count() if i % 8 else done

    def token(self, i: int) -> int:
        """Token i of the shard, with one probe per level."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = shift = 0
        for chunk, bitmap, ranks in self.levels:
            value |= int(chunk[i]) << shift
            if not bitmap[i // 8] >> i % 8 & 1:
                return value
            i, shift = self._rank(bitmap, ranks, i), shift + CHUNK_BITS
        return value

    def tokens(self, lo: int, hi: int) -> np.ndarray:
        """Tokens lo to hi, hi exclusive."""
        out = np.zeros(hi - lo, np.uint32)
        place, shift = np.arange(hi - lo), 0
        for chunk, bitmap, ranks in self.levels:
            if lo == hi:
                break
            out[place] |= chunk[lo:hi].astype(np.uint32) << np.uint32(shift)
            more = np.unpackbits(bitmap[lo // 8 : -(-hi // 8)], bitorder="little")[lo % 8 :][: hi - lo].astype(bool)
            lo, hi = self._rank(bitmap, ranks, lo), 0
            place = place[more]
            hi, shift = lo + len(place), shift + CHUNK_BITS
        return out


def _write(uri: str, data: bytes) -> None:
    """Written under another name and moved, so that a task that is run twice or lost leaves no half file."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    folder, _, name = path.rpartition("/")
    store.create_dir(folder, recursive=True)
    half = f"{folder}/.{name}.{os.getpid()}.half"
    with store.open_output_stream(half) as f:
        f.write(data)
    store.move(half, path)


def _read(uri: str) -> pa.Buffer:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        return f.read_buffer()


def write_tokens(
    docs: DataFrame,
    out: str,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Encode ``docs`` and write shards below ``out`` in ascending order of
    ``id_col``. Returns the manifest, one row per shard, with ``start``: the
    tokens in all shards before it. The manifest is also a table in ``out``."""
    spark = docs.sparkSession
    source = TokenizerFile(spark, tokenizer_path)
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(source)
        doc_ids: list[int | None] = []
        lengths, held, size, seq = [0], [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal doc_ids, lengths, held, size, seq
            name = f"shard-{part:06d}-{seq:04d}.dac"
            ids = np.frombuffer(b"".join(held), "<u4")
            _write(f"{out}/{name}", pack_shard(doc_ids, np.cumsum(lengths), ids))
            row = {"part": [part], "seq": [seq], "file": [name], "n_docs": [len(doc_ids)], "n_tokens": [len(ids)]}
            doc_ids, lengths, held, size, seq = [], [0], [], 0, seq + 1
            return pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        for batch in slices(batches):
            for i, raw in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), strict=True):
                doc_ids.append(i)
                held += (raw, end)
                lengths.append(len(raw) // 4 + 1)
                size += lengths[-1]
                if size >= shard_tokens:
                    yield close()
        if doc_ids:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    manifest = rows.repartitionByRange("i").sortWithinPartitions("i", "t").mapInArrow(write, MANIFEST)
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    manifest.write.parquet(f"{out}/manifest")
    manifest = spark.read.schema(MANIFEST).parquet(f"{out}/manifest")
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame, out: str, ids: bool = False) -> DataFrame:
    """One row per document from the shards: its id, the tokens of all
    documents before it, its number of tokens and the crc32 of its ids; with
    ``ids`` also the ids."""
    schema = DOCUMENTS + (", ids array<long>" if ids else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(_read(f"{out}/{name}"))
                raw = memoryview(shard.tokens(0, shard.n_tokens).astype("<u4").tobytes())
                at = shard.starts.tolist()
                spans = list(zip(at, at[1:], strict=False))
                columns = {
                    "doc_id": pa.array(shard.doc_ids, pa.int64()),
                    "start": pa.array([start + lo for lo, _ in spans], pa.int64()),
                    "n_tokens": pa.array([hi - lo for lo, hi in spans], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(raw[4 * lo : 4 * hi]) for lo, hi in spans], pa.int64()),
                }
                if ids:
                    columns["ids"] = pa.array([np.frombuffer(raw[4 * lo : 4 * hi], "<u4").astype(np.int64) for lo, hi in spans], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(columns)

    n = manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return manifest.select("file", "start").repartition(int(n)).mapInArrow(read, schema)


def token_digest(docs: DataFrame, out: str, tokenizer_path: str, text_col: str | Column = "text") -> DataFrame:
    """Write ``docs`` to ``out`` and read the documents' rows back."""
    return read_tokens(write_tokens(docs, out, tokenizer_path), out)
