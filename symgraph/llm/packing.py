"""Best-fit packing of token sequences with dominance reduction.

Documents are tokenized and cut to pieces of at most ``capacity`` tokens. The bin-packing instance is
the histogram of piece lengths: at most ``capacity`` numbers, however many documents there are. It is
solved on the driver, whole classes of equal bins at a time:

1. Dominance reduction (Martello and Toth). For the longest item left, a bin is fixed for good where
   it provably dominates every other bin with that item: nothing else fits; the largest item that
   fits fills the bin exactly; at most one more item fits (then the largest that does); or at most two
   more fit and no two of them together exceed the largest single one. Of equal bins, all are fixed at once
   for which that holds. Repeated until nothing is fixed.
2. Best-fit decreasing over what is left.

The plan (bins by pattern, and ranks of each length that go to them) has a few entries per length,
whatever the counts are: a step uses up a length or leaves the condition for good. Pieces get their rank within their length by distributed prefix counts over salted ranges,
so a length that a third of all pieces have spreads over many tasks.

Defined cases: null text is empty (only the end id); repeated rows are packed each; ties are packed in
any order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checked, materialize

CAPACITY, END_ID = 4096, 1
#: Words that a Python worker keeps the ids of, by generation; words met in one slice only; and the longest such word.
CACHE_WORDS, ONCE_WORDS, CACHE_LENGTH = 170_000, 100_000, 64
#: Pieces of one length that share a range, on average, up to MAX_RANGES ranges a length.
RANGE_ROWS, MAX_RANGES = 256, 65_536
_SLICE = 1 << 19

#: Signs of ASCII: the tokenizer parts them from a run of letters before them.
_SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

_worker: dict = {}


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_BLANK = bytes(32 if c in (9, 10, 13) else c for c in range(256))


#: Bytes that U+0300 to U+037F begin with: marks that make one letter with the letter before, often with small ones only.
_MARKS = re.compile(rb"[\xcc\xcd]")


def _lowered(text: bytes) -> bytes:
    """A text, A-Z lower-cased, as the tokenizer does later. It composes letters and marks before that, so words with marks
    are left as they are."""
    if _MARKS.search(text) is None:
        return text.lower()
    return b" ".join([w if _MARKS.search(w) else w.lower() for w in text.split(b" ")])


def _byte_letters() -> np.ndarray:
    """The character (16 bits) that stands for each byte in a vocabulary of bytes; the blank is left as it is."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = np.zeros(256, "<u2")
    out[own] = own
    out[np.delete(np.arange(256), own)] = np.arange(256, 512 - len(own))
    out[32] = 32
    return out


def _letter_ends() -> np.ndarray:
    """For each two bytes, whether they end by a digit of ASCII or by a letter of up to two bytes that stays one when it is
    lower-cased."""
    out = np.zeros((256, 256), bool)
    for c in map(chr, range(0x800)):
        if (c.isalpha() or c.isascii() and c.isdigit()) and len(c.lower()) == 1:
            *lead, last = c.encode()
            out[lead or slice(None), last] = True
    return out


_LETTER_ENDS, _IS_SIGN = _letter_ends(), np.isin(np.arange(256), np.frombuffer(_SIGNS, np.uint8))


def _parted(text: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``text`` with a blank at its end, and one before a single sign that ends a word after a letter or digit; and which of
    its words ends by each of ``ends``. The tokenizer parts such a sign from what is before it, and so a word is the same
    with and without it."""
    marked = np.frombuffer(b"   " + text + b" ", np.uint8)
    text = marked[3:]
    after = np.flatnonzero(text == 32) + 1
    cut = _IS_SIGN[marked[after + 1]] & _LETTER_ENDS[marked[after - 1], marked[after]]
    words = np.searchsorted(after, ends)
    return np.insert(text, after[cut] - 2, 32), words + np.cumsum(cut)[words]


class WordEncoder:
    """Ids of texts, word by word: white space always parts tokens of this vocabulary, and A-Z are
    lower-cased by it, so that the ids of a text are those of its words in turn, and words recur. Ids are
    kept packed (little-endian 32 bits), in two generations: the older half of the cache goes when the
    newer one is full. Most words are met once only, so a word gets there when a second slice of texts has it; until
    then it waits among ``once``, of which the first half goes when it is full. Special tokens' strings in a text are
    ordinary text.

    Words of letters of which normalisation changes the case alone are one run of letters each, so they go to the
    tokenizer's model without its normalisation and its search for runs. All other words are encoded one by one, as they
    are. Of a slice of texts, only its distinct words become Python objects."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.cache: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.once: dict[bytes, bytes] = {}
        self.bytes = _byte_letters()
        #: Letters that stay one letter; those that do so in another form, with it; and other characters.
        self.plain: set[str] = set()
        self.small: dict[str, str] = {}
        self.other: set[str] = set()

    def _letters(self, text: str) -> bool:
        """Whether the text is a run of letters, to the tokenizer too, of which its normalisation changes the case alone."""
        if self.plain.issuperset(text):
            return bool(text)
        for c in set(text) - self.plain - self.other:
            low = self.tokenizer.normalizer.normalize_str(c)
            alone = c.isalpha() and len(low) == 1 and low.isalpha()
            alone = alone and not "\u1160" <= c <= "\u11ff"  # vowels and ends of Hangul: no other letters join the one before
            if alone and len(self.tokenizer.pre_tokenizer.pre_tokenize_str(f"a{low}.")) == 2:
                self.plain.add(c)
                if low != c:
                    self.small[c] = low
            else:
                self.other.add(c)
        return self.plain.issuperset(text)

    def _encode(self, plain: dict[bytes, str], rest: dict[bytes, str]) -> None:
        """Put words into the cache: runs of plain letters by the model, others by the whole tokenizer."""
        tokens, letters = self.tokenizer.model.tokenize, list(plain)
        for at in range(0, len(letters), 4096):
            part = letters[at : at + 4096]
            text = " ".join([plain[w] for w in part])
            for c in self.small.keys() & set(text):
                text = text.replace(c, self.small[c])
            ids, ends = [], [0]
            for w in self.bytes[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-16-le").split(" "):
                ids += [t.id for t in tokens(w)]
                ends.append(4 * len(ids))
            packed = np.array(ids, "<u4").tobytes()
            self.cache.update(zip(part, map(packed.__getitem__, map(slice, ends, ends[1:])), strict=True))
        others = list(rest)
        for at in range(0, len(others), 4096):
            part = others[at : at + 4096]
            found = self.tokenizer.encode_batch_fast([rest[w] for w in part], add_special_tokens=False)
            self.cache.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(part, found, strict=True))

    def _learn(self, words: list[bytes]) -> list[bytes]:
        """Put ``words`` into the cache; those that were encoded for it. Signs after a run of plain letters are a run of
        their own."""
        plain, rest, ended, cache = {}, {}, {}, self.cache
        old, once, letters = self.old.get, self.once.pop, self._letters

        def found(w: bytes) -> bool:
            if (ids := old(w)) is not None or (ids := once(w, None)) is not None:
                cache[w] = ids
            return ids is not None

        for w in words:
            if (ids := old(w)) is not None or (ids := once(w, None)) is not None:
                cache[w] = ids
                continue
            if w.isalpha():  # A-Z and a-z only
                plain[w] = w.decode()
                continue
            text, head = w.decode("utf-8", "replace"), w.rstrip(_SIGNS)
            if letters(text):
                plain[w] = text
            elif len(head) < len(w) and letters(text[: len(head) - len(w)]):
                ended[w] = head
                if head not in cache and not found(head):
                    plain[head] = text[: len(head) - len(w)]
                tail = w[len(head) :]
                if tail not in cache and not found(tail):
                    rest[tail] = tail.decode()
            else:
                rest[w] = text
        self._encode(plain, rest)
        for w, head in ended.items():
            cache[w] = cache[head] + cache[w[len(head) :]]
        return [*plain, *rest, *ended]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        if not texts:
            return []
        split = [_lowered(t.encode("utf-8", "replace").translate(_BLANK)) for t in texts]
        text, lasts = _parted(b" ".join(split), np.cumsum([len(t) + 1 for t in split]))
        ends = np.flatnonzero(text == 32) + 1  # a word has the blank after it
        offsets = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64))
        told = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, offsets, pa.py_buffer(text)]).dictionary_encode()
        _, offsets, values = told.dictionary.buffers()
        words = values.slice(0, int(np.frombuffer(offsets, np.int64)[len(told.dictionary)])).to_pybytes().split(b" ")[:-1]
        ids = list(map(self.cache.get, words))
        new = [k for k, x in enumerate(ids) if x is None]
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.old, self.cache = self.cache, {}
            new = range(len(words))
        learned = self._learn([words[k] for k in new])
        for k in new:
            ids[k] = self.cache[words[k]]
        for w in learned:
            own = self.cache.pop(w)
            if len(w) <= CACHE_LENGTH:
                self.once[w] = own
        if len(self.once) > ONCE_WORDS:
            for w in list(islice(self.once, len(self.once) - ONCE_WORDS // 2)):
                del self.once[w]
        # Ids of the distinct words stand one after another in ``packed``; each word of the texts takes its own from there.
        packed, which = np.frombuffer(b"".join(ids), "<u4"), told.indices.to_numpy()
        sizes = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        n, first = sizes[which], (np.cumsum(sizes) - sizes)[which]
        after = np.cumsum(n)
        packed = packed[np.repeat(first - after + n, n) + np.arange(after[-1])]
        bounds = [0, *after[lasts].tolist()]
        return [packed[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end: bytes, with_ids: bool) -> Iterator[pa.RecordBatch]:
    if path not in _worker:
        _worker[path] = WordEncoder(path)
    encode = _worker[path]
    kind = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *[("ids", pa.binary())] * with_ids])
    for batch in batches:
        ids, texts, lo = batch.column("doc_id").to_pylist(), batch.column("text"), 0
        while lo < len(ids):
            some, size = [], 0
            while lo + len(some) < len(ids) and (not some or size < _SLICE):
                some.append(texts[lo + len(some)].as_py() or "")
                size += len(some[-1])
            out: list[list] = [[] for _ in kind]
            for doc, packed in zip(ids[lo:], encode(some), strict=False):
                packed += end
                for k, at in enumerate(range(0, len(packed), 4 * capacity)):
                    part = packed[at : at + 4 * capacity]
                    for column, x in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part), part), strict=False):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, kind, strict=True)], schema=kind)
            lo += len(some)


def tokenize(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of documents: ``doc_id, piece, start, length, ids_crc32`` (and ``ids``: packed
    little-endian 32-bit ids)."""
    path, end = path or _vocabulary(), int(end_id).to_bytes(4, "little")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return rows.mapInArrow(lambda batches: _pieces(batches, path, capacity, end, with_ids), kind)


class _Counts:
    """Items by length, with the lengths that are left in order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.lengths = sorted(self.n)

    def take(self, length: int, n: int) -> None:
        self.n[length] -= n
        if not self.n[length]:
            del self.n[length]
            self.lengths.remove(length)

    def smallest(self, k: int, without: int) -> list[int]:
        """The k smallest items, one of length ``without`` set aside."""
        out: list[int] = []
        for x in self.lengths:
            out += [x] * min(k - len(out), self.n[x] - (x == without))
            if len(out) >= k:
                break
        return out

    def largest(self, most: int, without: int) -> int | None:
        """The largest item of at most ``most``, one of length ``without`` set aside."""
        i = bisect_right(self.lengths, most)
        while i:
            i -= 1
            if self.n[self.lengths[i]] > (self.lengths[i] == without):
                return self.lengths[i]
        return None


def reduce_dominated(left: _Counts, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Bins (pattern, how many) that some optimal packing has; their items are taken out of ``left``."""
    fixed, again = [], True
    while again:
        again = False
        for length in list(reversed(left.lengths)):
            while left.n.get(length):
                room = capacity - length
                k = left.largest(room, length)
                if k is None:
                    fixed.append(([(length, 1)], n := left.n[length] if room < length else 1))
                    left.take(length, n)
                    again = True
                    continue
                few = left.smallest(3, length)
                sure = k == room or sum(few[:2]) > room or len(few) < 2
                if not sure and (len(few) < 3 or sum(few) > room):  # at most two more fit: the best pair of them
                    sure = _best_pair(left, room, length) <= k
                if not sure:
                    break
                n = left.n[length] // 2 if k == length else min(left.n[length], left.n[k])
                if k != room:  # as long as these items are left, so are those that may fit beside them
                    n = self_similar(left, length, k, n)
                fixed.append(([(length, 2)] if k == length else [(length, 1), (k, 1)], n))
                left.take(length, n * (1 + (k == length)))
                if k != length:
                    left.take(k, n)
                again = True
    return fixed


def self_similar(left: _Counts, length: int, k: int, most: int) -> int:
    """How many bins of ``length`` and ``k`` can be fixed before what else fits into them changes.

    The smallest items and the best pair that the condition looks at stay the same as long as more than
    three items of each of the two lengths are left, besides the ones of other lengths, which no such bin
    takes; the last few bins are judged one by one."""
    return max(1, most - 4)


def _best_pair(left: _Counts, room: int, without: int) -> int:
    """The largest sum of two items that fits in ``room``, one item of ``without`` set aside."""
    some = lambda x: left.n[x] - (x == without)
    best, xs = 0, [x for x in left.lengths[: bisect_right(left.lengths, room)] if some(x)]
    i, j = 0, len(xs) - 1
    while i <= j:
        if xs[i] + xs[j] > room:
            j -= 1
        else:
            if i < j or some(xs[i]) > 1:
                best = max(best, xs[i] + xs[j])
            i += 1
    return best


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-fit decreasing; bins of the same content are handled together."""
    rooms: list[int] = []
    classes: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}

    def put(pattern: list[tuple[int, int]], n: int, room: int) -> None:
        if n:
            if room not in classes:
                classes[room] = []
                insort(rooms, room)
            classes[room].append((pattern, n))

    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            i = bisect_right(rooms, length - 1)
            if i == len(rooms):
                pattern, have, room = [], n, capacity  # new bins, as many as needed
            else:
                room = rooms[i]
                pattern, have = classes[room].pop()
                if not classes[room]:
                    del classes[room]
                    rooms.pop(i)
            each = room // length
            whole = min(have, n // each)
            put([*pattern, (length, each)], whole, room - each * length)
            n -= whole * each
            have -= whole
            if n and have and n < each:
                put([*pattern, (length, n)], 1, room - n * length)
                n, have = 0, have - 1
            if pattern:
                put(pattern, have, room)
    return [(p, n) for room in rooms for p, n in classes[room]]


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, ranks per bin, first bin, offset), sorted by length and rank; and the
    number of bins."""
    left = _Counts(counts)
    bins = reduce_dominated(left, capacity)
    bins += best_fit(dict(left.n), capacity)
    rank: dict[int, int] = {}
    rows, first = [], 0
    for pattern, n in bins:
        offset = 0
        for length, each in pattern:
            rows.append((length, rank.get(length, 0), each, first, offset))
            rank[length] = rank.get(length, 0) + each * n
            offset += each * length
        first += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5), first


def _place(batches: Iterator[pa.RecordBatch], plan: np.ndarray) -> Iterator[pa.RecordBatch]:
    keys = (plan[:, 0] << 44) + plan[:, 1]
    for b in batches:
        length, rank = (b.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("length", "rank"))
        p = plan[np.searchsorted(keys, (length << 44) + rank, "right") - 1]
        at = rank - p[:, 1]
        names = [x for x in b.schema.names if x != "rank"]
        arrays = [b.column(x) for x in names] + [pa.array(p[:, 3] + at // p[:, 2]), pa.array(p[:, 4] + at % p[:, 2] * length)]
        yield pa.RecordBatch.from_arrays(arrays, names=[*names, "sequence_id", "offset"])


def pack(pieces: DataFrame, capacity: int = CAPACITY, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``pieces`` (materialized; with ``doc_id, piece, length``) with ``sequence_id`` and ``offset``."""
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    plan, _ = solve(counts, capacity)
    spark = pieces.sparkSession
    if not counts:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    ranges = [(k, min(MAX_RANGES, -(-n // range_rows))) for k, n in counts.items()]
    by = F.broadcast(spark.createDataFrame(ranges, "length long, ranges int"))  # at most ``capacity`` rows
    rows = pieces.join(by, "length").withColumn("range", F.pmod(F.xxhash64("doc_id", "piece"), F.col("ranges"))).drop("ranges")
    sums = rows.groupBy("length", "range").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    sums = materialize(sums.select("length", "range", F.coalesce(before, F.lit(0)).alias("before")), "pack-sums")
    inside = F.row_number().over(Window.partitionBy("length", "range").orderBy("doc_id", "piece"))
    rows = rows.join(checked(sums), ["length", "range"]).withColumn("rank", F.col("before") + inside - 1)
    rows = rows.select(*pieces.columns, "rank")
    shared = spark.sparkContext.broadcast(plan)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return rows.mapInArrow(lambda batches: _place(batches, shared.value), kind)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    return pack(materialize(tokenize(docs, path, capacity, with_ids=with_ids), "pieces"), capacity)


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
