"""Text scores from a Brown class-based n-gram model.

Words are runs of anything but ASCII white space, with A-Z lower-cased; each
text ends in an end token. Exchange clustering moves units between ``CLASSES``
classes as long as that raises the likelihood of the class bigrams. Units are
the ``WORDS`` most frequent words, one by one, and the other words by their
last ``SUFFIX`` bytes (the ``SUFFIXES`` most frequent, the rest together).
Then each other word of the training texts takes the class in which its own
counts of classes before and after it gain most, all against the classes of the
units, in one sweep. Words that training hasn't seen keep the class of their
ending. The end token has its own class.

The probability of a token is that of its class after the two classes before
it (interpolated trigram, bigram, unigram) times that of the word in its
class. Word probabilities are discounted by ``D = n1 / (n1 + 2 n2)`` (words
seen once and twice); a class gives what it saves to unseen words, as one type.

Counts of words are made over all training texts and stay in a table. What the
driver holds is bounded by the number of units: their bigrams, at most
``(WORDS + SUFFIXES + 2) ** 2`` counts, and class trigrams. Counts of the
``LOOKUP`` most frequent words and their classes go to the executors; for all
others, words and texts meet in a join by word, and go back by the number that
each row has in the written table, so no frequent word makes a hot key there and
rows with one id or one text stay apart.

Defined results: a null text counts as empty and has the end token alone; rows
without an id are for training; without training tokens the score is the base
score; repeated rows are scored and counted each; an empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import stage

CLASSES = 48
WORDS = 1500
SUFFIX, SUFFIXES = 3, 500
LOOKUP = 50_000
SWEEPS = 12
#: Weight, in tokens, of the shorter history.
BACKOFF = (20.0, 50.0)
#: Different words that a task holds before it passes their counts on.
HELD_WORDS = 250_000
#: Texts that a task turns into arrays at once.
READ_ROWS = 200
END = b""


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 1, F.lit(False))


COUNTS = "word binary, n long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for b in batches:
        texts = b.column(0).to_pylist()
        held[END] += len(texts)
        for i in range(0, len(texts), 200):
            held.update(chain.from_iterable(map(tokens, texts[i : i + 200])))
            if len(held) >= HELD_WORDS:
                yield batch()
                held = Counter()
    yield batch()


def count_words(texts: DataFrame) -> DataFrame:
    """``word`` and ``n`` over one text column, the end token as the empty word."""
    return texts.mapInArrow(_count, COUNTS).groupBy("word").agg(F.sum("n").alias("n")).filter("n > 0")


@dataclass
class Lexicon:
    """The units: 0 the end token, then words, then word endings, then the rest; counts of frequent words."""

    lookup: dict[bytes, int]
    counts: np.ndarray
    words: int
    suffixes: dict[bytes, int]
    total: int
    distinct: int
    discount: float

    @property
    def units(self) -> int:
        return self.words + len(self.suffixes) + 2

    def unit_of_lookup(self) -> np.ndarray:
        """The unit of each word of ``lookup``."""
        other = self.units - 1
        return np.array([0 if w == END else k if k <= self.words else self.suffixes.get(w[-SUFFIX:], other) for w, k in self.lookup.items()], np.uint16)

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 0.5) / (self.total + 0.5 * (self.distinct + 1)))


def lexicon(counts: DataFrame, words: int, suffixes: int, lookup: int) -> Lexicon:
    """counts: ``word`` and ``n``, a table."""
    total, distinct, n1, n2 = counts.agg(F.sum("n"), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    top = [(bytes(r["word"]), r["n"]) for r in counts.filter(F.length("word") > 0).orderBy(F.desc("n"), "word").limit(lookup).collect()]
    end = counts.filter(F.length("word") == 0).first()
    rows = [(END, end["n"] if end else 0), *top]
    least = rows[min(words, len(rows) - 1)]
    # Words after the last unit of their own, in the order of ``top``.
    rest = counts.filter((F.length("word") > 0) & ((F.col("n") < least[1]) | ((F.col("n") == least[1]) & (F.col("word") > F.lit(least[0])))))
    by_end = rest.groupBy(F.expr(f"substring(word, -{SUFFIX})").alias("suffix")).agg(F.sum("n").alias("n"))
    ends = [bytes(r["suffix"]) for r in by_end.orderBy(F.desc("n"), "suffix").limit(suffixes).collect()]
    own = min(words, len(rows) - 1)
    return Lexicon(
        {w: k for k, (w, _) in enumerate(rows)},
        np.array([n for _, n in rows], np.float64),
        own,
        {s: own + 1 + k for k, s in enumerate(ends)},
        total or 0,
        distinct or 0,
        n1 / (n1 + 2 * n2) if n1 and n2 else 0.5,
    )


READ = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, emitted double, codes binary, rare_units binary, rare array<struct<word:binary,unit:int,n:int>>"


def read_texts(docs: DataFrame, id_col: str, text_col: str, shared) -> DataFrame:
    """Each text as codes, places in the lookup and after these places among its
    own other words, with sums over frequent words, and the other words with
    their units and counts, which the join needs. ``row`` numbers the rows by
    task and place; the table must be written before it is used twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        lex: Lexicon = shared.value
        other, frequent_words = lex.units - 1, len(lex.lookup)
        base, known = lex.base(lex.counts), lex.counts > 0
        emitted = np.log10(np.maximum(lex.counts - lex.discount, 1e-300))
        emitted[0] = 0  # the end token is its class
        number, suffix = lex.lookup.get, lex.suffixes.get
        kind = pa.list_(pa.struct([("word", pa.binary()), ("unit", pa.int32()), ("n", pa.int32())]))
        for batch in batches:
            ids, held, texts = (batch.column(k).to_pylist() for k in range(3))
            for i in range(0, len(texts), READ_ROWS):
                words = [tokens(t) for t in texts[i : i + READ_ROWS]]
                size = np.array([len(w) + 1 for w in words])
                ends = np.cumsum(size)
                starts = ends - size
                flat = list(chain.from_iterable(w + [END] for w in words))
                place = np.fromiter(map(number, flat, repeat(-1)), np.int64, len(flat))
                frequent = place >= 0
                code = place.astype(np.int64)
                rare: list[Counter] = [Counter() for _ in words]
                numbers: list[dict] = [{} for _ in words]
                at = np.flatnonzero(~frequent)
                for k, d in zip(at.tolist(), np.searchsorted(ends, at, "right").tolist(), strict=True):
                    w = flat[k]
                    code[k] = frequent_words + numbers[d].setdefault(w, len(numbers[d]))
                    rare[d][w, suffix(w[-SUFFIX:], other)] += 1
                sums = [np.add.reduceat(np.where(frequent, x[place], 0), starts) if len(flat) else np.array([]) for x in (known, base, emitted)]
                lengths = np.cumsum([0, *map(len, rare)]).astype(np.int32)
                pairs = list(chain.from_iterable(r.items() for r in rare))
                items = pa.StructArray.from_arrays(
                    [pa.array([w for (w, _), _ in pairs], pa.binary()), pa.array([u for (_, u), _ in pairs], pa.int32()), pa.array([n for _, n in pairs], pa.int32())],
                    fields=list(kind.value_type),
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + len(words))),
                        pa.array(ids[i : i + READ_ROWS], pa.int64()),
                        pa.array(held[i : i + READ_ROWS], pa.bool_()),
                        pa.array(size, pa.int64()),
                        pa.array(sums[0].astype(np.int64), pa.int64()),
                        pa.array(sums[1], pa.float64()),
                        pa.array(sums[2], pa.float64()),
                        pa.array([_packed_codes(code[a:b]) for a, b in zip(starts, ends, strict=True)], pa.binary()),
                        pa.array([np.array([u for _, u in r], "<u2").tobytes() for r in rare], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(lengths), items),
                    ],
                    [f.split()[0] for f in READ.split(", ")],
                )
                row += len(words)

    rows = docs.select(F.col(id_col).cast("long"), held_out(id_col), F.col(text_col))
    return rows.mapInArrow(run, READ)


def _parts(batches: Iterator[pa.RecordBatch], values: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their first column, of bytes, has about ``values`` bytes in each."""
    for batch in batches:
        if batch.num_rows:
            ends = np.cumsum(pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                done = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + values, "right")))
                yield batch.slice(at, to - at)
                at = to


def _histories(parts: list[np.ndarray], order: int) -> list[np.ndarray]:
    """For each token of the texts: its name and those of the ``order - 1`` tokens before it, the end token (0) before a text."""
    out = []
    for back in range(order):
        out.append(np.concatenate([np.concatenate([np.zeros(min(back, len(p)), np.int64), p[: len(p) - back]]) for p in parts]) if parts else np.array([], np.int64))
    return out


def _packed_codes(codes: np.ndarray) -> bytes:
    """Codes in two bytes each and one byte more, or in four if one needs them: the length tells which."""
    return codes.astype("<u4").tobytes() if codes.max() >= 1 << 16 else codes.astype("<u2").tobytes() + b"\0"


def _codes(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2", len(x) // 2).astype(np.int64) if len(x) % 2 else np.frombuffer(x, "<u4").astype(np.int64) for x in column.to_pylist()]


def _arrays(column: pa.Array, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x, kind).astype(np.int64) for x in column.to_pylist()]


def _unit_parts(batch: pa.RecordBatch, unit_of: np.ndarray) -> list[np.ndarray]:
    """The units of the texts, from columns ``codes`` and ``rare_units``."""
    return [np.concatenate([unit_of, r])[c] for c, r in zip(_codes(batch.column(0)), _arrays(batch.column(1), "<u2"), strict=True)]


def _ngrams(texts: DataFrame, order: int, size: int, parts) -> DataFrame:
    """Counts of n-grams of the names that ``parts`` reads from a batch: ``gram``, base ``size``, oldest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size**order, np.int64)
        for batch in _parts(batches):
            grams = 0
            for h in reversed(_histories(parts(batch), order)):
                grams = grams * size + h
            some, n = np.unique(grams, return_counts=True)
            total[some] += n
        some = np.flatnonzero(total)
        for i in range(0, len(some), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(some[i : i + 100_000]), pa.array(total[some[i : i + 100_000]])], ["gram", "n"])

    return texts.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


CONTEXTS = "place int, word binary, unit int, cells binary"


def _packed(keys: np.ndarray, n: np.ndarray, cells: int) -> tuple[np.ndarray, pa.Array]:
    """Sorted keys (owner times ``cells`` plus cell) and counts as the owners and, for each, its cells and counts in one
    value: pairs of two bytes each, a count above that as several."""
    if (n >= 1 << 16).any():
        times = -(-n // 0xFFFF)
        last = np.cumsum(times) - 1
        keys, whole = np.repeat(keys, times), np.full(times.sum(), 0xFFFF)
        whole[last] = n - (times - 1) * 0xFFFF
        n = whole
    owner = keys // cells
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    values = np.stack([keys % cells, n], 1).astype("<u2")
    offsets = (np.append(first, len(keys)) * 4).astype(np.int32)
    return owner[first], pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def contexts(read: DataFrame, shared, own: int) -> DataFrame:
    """How often each class stands after and before each word of the training
    texts that is no unit, and the word before itself: cells ``c``, ``k + c``
    and ``2 k``. A word of the lookup has its ``place``, another one -1 and ``word``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit_of, cls = shared.value
        k, frequent_words = int(cls.max()) + 1, len(unit_of)
        cells = 2 * k + 1
        total = np.zeros(frequent_words * cells, np.uint32)

        def counted(owner, codes, before, after, some):
            keys = owner * cells
            return np.concatenate([(keys + after)[some], (keys + k + before)[some], (keys + 2 * k)[some & (np.append(codes[1:], -1) == codes)]])

        for batch in _parts(batches):
            texts = _codes(batch.column(0))
            rare = batch.column(2)
            starts = np.cumsum([0, *[len(x) for x in rare]])
            classes = [cls[u] for u in _unit_parts(batch, unit_of)]
            # The last token of a text is the end token, which is no word: nothing is counted across texts.
            codes, now = np.concatenate(texts), np.concatenate(classes)
            before = np.concatenate([np.append(0, c[:-1]) for c in classes])
            after = np.append(now[1:], 0)
            known = codes < frequent_words
            some, n = np.unique(counted(codes, codes, before, after, known & (codes > own)), return_counts=True)
            total[some] += n.astype(np.uint32)
            text = np.repeat(starts[:-1], [len(t) for t in texts])
            some, n = np.unique(counted(codes - frequent_words + text, codes, before, after, ~known), return_counts=True)
            if len(some):
                owner, packed = _packed(some, n, cells)
                words = rare.flatten().take(pa.array(owner))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(owner), -1, np.int32)), words.field("word"), words.field("unit"), packed], ["place", "word", "unit", "cells"])
        some = np.flatnonzero(total)
        if len(some):
            owner, packed = _packed(some, total[some], cells)
            none = pa.array([b""] * len(owner), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(owner.astype(np.int32)), none, pa.array(unit_of[owner].astype(np.int32)), packed], ["place", "word", "unit", "cells"])

    return read.filter("not held_out").select("codes", "rare_units", "rare").mapInArrow(run, CONTEXTS)


def _h(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def best_classes(cells: np.ndarray, old: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class in which each word gains most. cells: a row of counts (see
    ``contexts``) for each word; old: their classes in ``table``, the bigrams of
    classes, which count the words too."""
    k = len(table)
    rows = np.arange(len(cells))
    own = cells[:, 2 * k].astype(np.float64)
    f, p = cells[:, :k].astype(np.float64), cells[:, k : 2 * k].astype(np.float64)
    total = f.sum(1)
    f[rows, old] -= own
    p[rows, old] -= own
    mine = np.zeros((len(cells), k))
    mine[rows, old] = 1
    gain = np.zeros((len(cells), k))
    # Cells of the rows of all classes and then of their columns, without the word; only those that it has change.
    for x, other, t in ((f, p, table), (p, f, table.T)):
        w, c = np.nonzero(x)
        if len(w):
            at = t[:, c].T - mine[w] * x[w, c][:, None] - (mine[w, c])[:, None] * (other[w] + mine[w] * own[w][:, None])
            first = np.flatnonzero(np.diff(w, prepend=-1))
            gain[w[first]] += np.add.reduceat(_h(at + x[w, c][:, None]) - _h(at), first, axis=0)
    d = np.diagonal(table) - mine * (f + p + own[:, None])
    gain += _h(d + f + p + own[:, None]) - _h(d + f) - _h(d + p) + _h(d)
    for sums in (table.sum(1), table.sum(0)):
        rest = sums - mine * total[:, None]
        gain += _h(rest) - _h(rest + total[:, None])
    gain[:, 0] = -np.inf
    gain[:, table.sum(1) == 0] = -np.inf  # all words would go to an empty class
    best = gain.argmax(1)
    return np.where(gain[rows, best] > gain[rows, old] + 1e-9, best, old)


def word_classes(found: DataFrame, shared) -> DataFrame:
    """``place``, ``word``, ``n`` and ``cls`` of each word of ``contexts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, table = shared.value
        size = 2 * len(table) + 1

        def done(places, words, units, cells) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [places, words, pa.array(cells[:, : len(table)].sum(1)), pa.array(best_classes(cells, cls[units], table).astype(np.int32))], ["place", "word", "n", "cls"]
            )

        held = None
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                places, words = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), object)
                new = np.append(True, (places[1:] != places[:-1]) | (words[1:] != words[:-1]))
                first = np.flatnonzero(new)
                group = np.cumsum(new) - 1
                values = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u2").reshape(-1, 2).astype(np.int64)
                lengths = pc.binary_length(batch.column(3)).to_numpy(zero_copy_only=False) // 4
                cells = np.bincount(np.repeat(group, lengths) * size + values[:, 0], values[:, 1], len(first) * size).astype(np.int64).reshape(-1, size)
                places, words, units = places[first], words[first], batch.column(2).to_numpy()[first]
                if held is not None:
                    if (held[0][0], held[1][0]) == (places[0], words[0]):
                        cells[0] += held[3][0]
                    else:
                        places, words, units, cells = (np.concatenate(x) for x in zip(held, (places, words, units, cells), strict=True))
                held = tuple(x[-1:] for x in (places, words, units, cells))
                if len(places) > 1:
                    yield done(pa.array(places[:-1]), pa.array(words[:-1], pa.binary()), units[:-1], cells[:-1])
        if held is not None:
            yield done(pa.array(held[0]), pa.array(held[1], pa.binary()), *held[2:])

    keys = ["place", "word"]
    return found.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "place int, word binary, n long, cls int")


def exchange(left: np.ndarray, right: np.ndarray, n: np.ndarray, units: int, classes: int, sweeps: int = SWEEPS, seed: int = 5) -> np.ndarray:
    """Exchange clustering. left, right, n: unit bigrams and their counts.
    Returns a class for each unit; unit 0, the end token, keeps class 0 alone."""
    weight = np.bincount(left, n, units)
    rank = np.argsort(-weight[1:], kind="stable") + 1
    cls = np.zeros(units, np.int64)
    k = max(2, min(classes, units))
    cls[rank] = 1 + np.arange(units - 1) % (k - 1)
    order_l, order_r = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    bound_l, bound_r = np.searchsorted(left[order_l], np.arange(units + 1)), np.searchsorted(right[order_r], np.arange(units + 1))
    table = np.bincount(cls[left] * k + cls[right], n, k * k).reshape(k, k)
    h = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)
    for _ in range(sweeps):
        moved = 0
        for u in rank:
            a = cls[u]
            after, before = order_l[bound_l[u] : bound_l[u + 1]], order_r[bound_r[u] : bound_r[u + 1]]
            own = float(n[after][right[after] == u].sum())
            f = np.bincount(cls[right[after]], n[after], k)  # counts of classes after u, and before it, without u itself
            p = np.bincount(cls[left[before]], n[before], k)
            f[a] -= own
            p[a] -= own
            total = f.sum() + own
            if not total and not p.sum():
                continue
            table[a] -= f
            table[:, a] -= p
            table[a, a] -= own
            row, col = table.sum(1) + p, table.sum(0) + f  # u's neighbours stay, wherever it goes
            # Gain of adding u to class b: cells of row b and column b, then their sums.
            cell = h(table + f).sum(1) - h(table).sum(1) + h(table + p[:, None]).sum(0) - h(table).sum(0)
            d = np.diagonal(table)
            cell += h(d + f + p + own) - h(d + f) - h(d + p) + h(d)
            gain = cell - h(row + total) + h(row) - h(col + p.sum() + own) + h(col)
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            table[b] += f
            table[:, b] += p
            table[b, b] += own
            cls[u] = b
            moved += b != a
        if moved <= units // 500:
            break
    return cls


def transitions(grams: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """log10 probabilities of a class after two classes, flat, from class trigram counts."""
    three = np.bincount(grams, n, k**3).reshape(k, k, k)
    two = three.sum(0)
    one = two.sum(0) + 0.5
    p = one / one.sum()
    p = (two + BACKOFF[0] * p) / (two.sum(1, keepdims=True) + BACKOFF[0])
    p = (three + BACKOFF[1] * p[None]) / (three.sum(2, keepdims=True) + BACKOFF[1])
    return np.log10(p).reshape(-1)


def score_texts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    classes: int = CLASSES,
    words: int = WORDS,
    suffixes: int = SUFFIXES,
    lookup: int = LOOKUP,
) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``n_tokens``,
    ``n_known``, ``train_tokens``, ``base_score`` and ``score``, log10
    probabilities of the whole text."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    counts = stage(count_words(docs.filter(~held_out(id_col)).select(text_col)), "word-counts")
    lex = lexicon(counts, words, suffixes, lookup)
    read = stage(read_texts(docs, id_col, text_col, share(lex)), "units")
    u = lex.units

    def collected(frame: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        table = frame.toArrow()
        return table.column("gram").to_numpy().astype(np.int64), table.column("n").to_numpy().astype(np.float64)

    unit_of = lex.unit_of_lookup().astype(np.int64)
    shared_units = share(unit_of)
    training = read.filter("not held_out").select("codes", "rare_units")
    pairs, n = collected(_ngrams(training, 2, u, lambda batch: _unit_parts(batch, shared_units.value)))
    cls = exchange(pairs // u, pairs % u, n, u, classes)
    k = int(cls.max()) + 1
    table = np.bincount(cls[pairs // u] * k + cls[pairs % u], n, k * k).reshape(k, k)
    classed = stage(word_classes(contexts(read, share((unit_of, cls)), lex.words), share((cls, table))), "word-classes")
    of_lookup = cls[unit_of]
    for r in classed.filter("place >= 0").select("place", "cls").collect():
        of_lookup[r["place"]] = r["cls"]
    types = np.bincount(cls[: lex.words + 1], minlength=k).astype(np.float64)
    for r in classed.groupBy("cls").count().collect():
        types[r["cls"]] += r["count"]
    # An unseen word of a class gets what its seen words are discounted by; a class without words, half a token.
    unseen = np.log10(np.maximum(lex.discount * types, 0.5))[cls]

    rare = read.select("row", F.posexplode("rare").alias("at", "r")).select("row", "at", "r.word", "r.unit", "r.n")
    lots = F.array(*[F.lit(float(x)) for x in unseen])
    of_unit = F.array(*[F.lit(int(x)) for x in cls])
    found = rare.join(classed.filter("place < 0").select("word", F.col("n").alias("c"), "cls"), "word", "left")
    c = F.coalesce("c", F.lit(0))
    held = F.col("n").cast("double")
    den = lex.total + 0.5 * (lex.distinct + 1)
    logs = F.when(c > 0, F.log10(c - F.lit(lex.discount))).otherwise(F.get(lots, F.col("unit")))
    sums = found.groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).cast("long").alias("rare_known"),
        F.sum(held * F.log10((c + 0.5) / F.lit(den))).alias("rare_base"),
        F.sum(held * logs).alias("rare_emitted"),
        F.collect_list((F.col("at") * F.lit(k) + F.coalesce("cls", F.get(of_unit, F.col("unit")))).cast("int")).alias("rare_cls"),  # places and classes
    )
    shared_classes = share(of_lookup)

    def to_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_lookup = shared_classes.value
        for batch in _parts(batches):
            out = []
            for codes, lots in zip(_codes(batch.column(0)), batch.column(1), strict=True):
                some = lots.values.to_numpy().astype(np.int64) if lots.is_valid else np.array([], np.int64)
                of_rare = np.zeros(len(some), np.int64)
                of_rare[some // k] = some % k
                out.append(np.concatenate([of_lookup, of_rare])[codes].astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), batch.column(2)], ["classes", "row"])

    kept = ["doc_id", "held_out", "n_tokens", "n_known", "base", "emitted"]
    row = F.struct(*kept, "rare_known", "rare_base", "rare_emitted").alias("row")
    joined = read.drop("rare", "rare_units").join(sums, "row", "left").select("codes", "rare_cls", row)
    texts = stage(joined.mapInArrow(to_classes, f"classes binary, row {joined.schema['row'].dataType.simpleString()}"), "text-classes")
    grams, n = collected(_ngrams(texts.filter("not row.held_out").select("classes"), 3, k, lambda batch: _arrays(batch.column(0), "<u2")))
    steps = transitions(grams, n, k) if lex.total else np.zeros(k**3)
    inside = -np.log10(np.maximum(np.bincount(grams % k, n, k), 1e-300))
    inside[0] = 0  # the end token is its class
    tables = share((steps, inside))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, inside = tables.value
        for batch in _parts(batches):
            parts = _arrays(batch.column(0), "<u2")
            now, one, two = _histories(parts, 3)
            each = steps[(two * k + one) * k + now] + inside[now]
            ends = np.cumsum([len(x) for x in parts])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(np.add.reduceat(each, np.concatenate([[0], ends[:-1]])))], ["row", "walked"])

    done = texts.mapInArrow(walk, f"row {texts.schema['row'].dataType.simpleString()}, walked double").select("row.*", "walked")
    zero = F.lit(0.0)
    base = F.col("base") + F.coalesce("rare_base", zero)
    score = F.col("walked") + F.col("emitted") + F.coalesce("rare_emitted", zero)
    return done.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (score if lex.total else base).alias("score"),
    )
