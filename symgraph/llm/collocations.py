"""Phrase collocation mining by suffix-sigma.

Texts are cut to pieces at punctuation, pieces to words; phrases are counted per language.

1. Suffixes. Each word occurrence gives the words from it on, ``max_n`` of them at most and none beyond its
   piece. Equal ones are summed in the task, some megabytes of text at a time, before anything is shuffled.
2. Shuffle by language and first word. Words that first more than one in ``HOT`` suffixes of a sample of the
   documents are dealt over several parts by a hash of the whole suffix; the sample decides where rows go, and
   no result depends on it.
3. Count. A part is sorted reverse-lexicographically; one stack of open prefixes counts them all in one pass.
   It goes from batch to batch, so a part's size is no matter. Prefixes below ``min_count`` go at once, but for
   those of dealt words, whose parts are summed afterwards.
4. Join. The counts of a candidate's parts are joined to its cuts; candidates that a longer one covers go;
   the best of each language are taken over salted groups first.

Scores are exact: products are decimals of 38 digits, so they hold up to 10^15 occurrences of a phrase.

Defined cases: null text is empty; null language is ``und``; repeated rows count each; texts without words
give nothing; ties go by count, then by the phrase's bytes; an empty table gives no rows; other columns are
ignored. A single text is cut in one task, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import _LOWER, checked, materialize, release

MAX_N, MIN_COUNT, TOP, COVER = 3, 10, 2000, 50
#: Bytes of text whose suffixes are summed at once.
FLUSH_BYTES = 12 << 20
#: Suffixes of a batch on its way to Spark.
ROWS = 50_000
#: Documents of the sample that finds hot first words (about; all, if there are fewer); a word is hot with more than one in HOT suffixes.
SAMPLE_DOCS, HOT = 5000, 1000
#: Groups that a language is dealt to for its first choice of candidates.
SALTS = 64

_KIND = np.zeros(256, np.uint8)  # of a byte: 0 word, 1 space, 2 end of a piece
_KIND[[32, 9]] = 1
_KIND[[*b".,;:!?", 10, 11, 12, 13]] = 2
_KEY = "key string, n long, parts int"


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of the texts (lower-cased, dictionary-encoded), each one's text, and whether the next word is of the same piece."""
    kind = _KIND[data]
    word = kind == 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1 : len(data)]
    s = np.flatnonzero(start)
    chars = _LOWER[data[word]]
    place = np.zeros(len(s) + 1, np.int64)
    place[1:] = np.append(np.cumsum(word)[s[1:] - 1], len(chars)) if len(s) else 0
    words = pa.Array.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(place), pa.py_buffer(chars)]).dictionary_encode()
    row = np.searchsorted(offsets, s, "right") - 1
    piece = np.cumsum(kind == 2)[s]
    return words, row, (piece[1:] == piece[:-1]) & (row[1:] == row[:-1])


def _distinct(columns: list[np.ndarray], sizes: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of ``columns`` (each from 0 to below its size), and how often each occurs."""
    room = 1
    for n in sizes:
        room *= n
    if room >= 1 << 63:  # too many combinations for one number: the first columns are numbered anew
        codes = columns[0]
        for x, n in zip(columns[1:], sizes[1:], strict=True):
            codes = np.unique(codes * n + x, return_inverse=True)[1]
        first, times = np.unique(codes, return_index=True, return_counts=True)[1:]
        return [x[first] for x in columns], times
    codes = columns[0].copy()
    for x, n in zip(columns[1:], sizes[1:], strict=True):
        codes *= n
        codes += x
    codes.sort()
    at = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
    times, codes = np.diff(np.append(at, len(codes))), codes[at]
    out = []
    for n in sizes[:0:-1]:
        codes, x = np.divmod(codes, n)
        out.append(x)
    return [codes, *out[::-1]], times


def suffix_counts(langs: np.ndarray, n_langs: int, data: np.ndarray, offsets: np.ndarray, max_n: int) -> tuple[list[np.ndarray], np.ndarray, pa.Array]:
    """Distinct suffixes of the texts: their columns (language, first word, then a word and one, 0 for none), times, words."""
    words, row, joined = pieces(data, offsets)
    n, size = len(words), len(words.dictionary)
    code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    columns, whole = [langs[row], code], np.ones(n, bool)
    for k in range(1, max_n):
        whole[n - k :] = False
        whole[: n - k] &= joined[k - 1 :]
        x = np.zeros(n, np.int64)
        x[: n - k] = np.where(whole[: n - k], code[k:] + 1, 0)
        columns.append(x)
    columns, times = _distinct(columns, [n_langs, max(size, 1), *[size + 1] * (max_n - 1)])
    return columns, times, words.dictionary


def _escaped(lang: str | None) -> bytes:
    return ("und" if lang is None else lang).replace("\\", "\\\\").replace("\n", "\\n").encode("utf-8", "surrogatepass")


def _keys(columns: list[np.ndarray], words: pa.Array, names: list[bytes], dealt: dict[bytes, int]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Suffixes as text, and the parts they are dealt to: each word ends with a line feed, which no word holds, so a
    prefix of words is a prefix of the text and its suffixes stay together in any order of texts; the language
    follows the first word, after a tab."""
    own = words.to_pylist()
    tails = pa.array([b"", *[w + b"\n" for w in own]], pa.large_binary())
    head, at = np.unique(columns[0] * len(own) + columns[1], return_inverse=True)
    heads = [own[h % len(own)] + b"\t" + names[h // len(own)] for h in head.tolist()]
    parts = np.array([dealt.get(h, 1) for h in heads], np.int32)
    heads = pa.array([h + b"\n" for h in heads], pa.large_binary())
    for lo in range(0, len(at), ROWS):
        some = [heads.take(pa.array(at[lo : lo + ROWS])), *[tails.take(pa.array(x[lo : lo + ROWS])) for x in columns[2:]]]
        yield pc.binary_join_element_wise(*some, pa.scalar(b"", pa.large_binary())), parts[at[lo : lo + ROWS]]


def _suffixes(batches: Iterator[pa.RecordBatch], max_n: int, hot: dict[str, int], size: int) -> Iterator[pa.RecordBatch]:
    dealt = {k.encode("utf-8", "surrogatepass"): v for k, v in hot.items()}
    texts: list[pa.Array] = []
    langs: list[pa.Array] = []
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        joined = pa.concat_arrays(texts)
        offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
        data = np.frombuffer(joined.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        lang = pa.concat_arrays(langs).dictionary_encode("encode")
        names = [_escaped(x) for x in lang.dictionary.to_pylist()]
        codes = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        columns, times, words = suffix_counts(codes, len(names), data, offsets - offsets[0], max_n)
        for i, (keys, parts) in enumerate(_keys(columns, words, names, dealt) if len(times) else []):
            yield pa.RecordBatch.from_arrays([keys.cast(pa.binary()).cast(pa.string(), safe=False), pa.array(times[i * ROWS :][: len(keys)], pa.int64()), pa.array(parts)], names=["key", "n", "parts"])

    for b in batches:
        texts.append(b.column("text").cast(pa.large_string()))
        langs.append(b.column("lang").cast(pa.string()))
        held += texts[-1].nbytes
        if held > size:
            yield from flush()
            texts, langs, held = [], [], 0
    if texts:
        yield from flush()


class _Stack:
    """The open prefixes of a sorted part: for each length its words and the sum so far."""

    def __init__(self, max_n: int, least: int):
        self.max_n, self.least = max_n, least
        self.open: list[tuple[bytes, int, bool] | None] = [None] * max_n
        self.out: list[tuple[bytes, int, int]] = []
        self.totals: dict[bytes, int] = {}

    def close(self, k: int) -> None:
        """Prefixes of ``k + 1`` words and more are over."""
        for i in range(k, self.max_n):
            x = self.open[i]
            if x is not None and (x[1] >= self.least or (x[2] and i + 1 < self.max_n)):
                self.out.append((x[0], i + 1, x[1]))
            self.open[i] = None

    def push(self, keys: pa.Array, n: np.ndarray, dealt: np.ndarray) -> None:
        """Rows in descending order of their keys."""
        keys = keys.cast(pa.large_binary())
        offsets = np.frombuffer(keys.buffers()[1], np.int64)[keys.offset : keys.offset + len(keys) + 1]
        data = np.frombuffer(keys.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        ends = np.flatnonzero(data == 10)
        starts = np.append(0, ends[:-1] + 1)
        row = np.searchsorted(offsets, ends, "right") - 1
        first = np.searchsorted(row, np.arange(len(keys)))
        depth = np.arange(len(ends)) - first[row]
        length = ends - starts
        place = np.append(0, np.cumsum(length))
        word = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(place), pa.py_buffer(data[data != 10])]).dictionary_encode().indices.to_numpy()
        at, to = np.full((self.max_n, len(keys)), -1, np.int64), np.zeros((self.max_n, len(keys)), np.int64)
        at[depth, row], to[depth, row] = word, ends + 1
        new = np.zeros(len(keys), bool)
        new[0] = True
        for k in range(self.max_n):
            new[1:] |= at[k, 1:] != at[k, :-1]
            here = np.flatnonzero(new)
            sums = np.add.reduceat(n, here)
            real = at[k, here] >= 0
            prefix = lambda i, k=k: data[offsets[i] : to[k, i]].tobytes()
            if k == 0:
                for i, x in zip(here.tolist(), sums.tolist(), strict=True):
                    lang = prefix(i).partition(b"\t")[2]
                    self.totals[lang] = self.totals.get(lang, 0) + x
            # The first group may go on with the open prefix; the last stays open.
            x = self.open[k]
            if x is not None and real[0] and x[0] == prefix(0):
                sums[0] += x[1]
            elif x is not None:
                if x[1] >= self.least or (x[2] and k + 1 < self.max_n):
                    self.out.append((x[0], k + 1, x[1]))
            self.open[k] = None
            keep = real & ((sums >= self.least) | (dealt[here] & (k + 1 < self.max_n)))
            keep[-1] = False
            self.out += [(prefix(i), k + 1, s) for i, s in zip(here[keep].tolist(), sums[keep].tolist(), strict=True)]
            if real[-1]:
                self.open[k] = (prefix(here[-1]), int(sums[-1]), bool(dealt[here[-1]]))

    def taken(self) -> pa.RecordBatch:
        out, self.out = self.out, []
        keys = pa.array([x[0] for x in out], pa.binary()).cast(pa.string(), safe=False)
        return pa.RecordBatch.from_arrays([keys, pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int64())], names=["key", "words", "f"])


def _prefixes(batches: Iterator[pa.RecordBatch], max_n: int, least: int) -> Iterator[pa.RecordBatch]:
    stack = _Stack(max_n, least)
    for b in batches:
        if b.num_rows:
            stack.push(b.column("key"), b.column("n").to_numpy(), b.column("parts").to_numpy() > 1)
            yield stack.taken()
    stack.close(0)
    stack.out += [(b"\t" + k, 0, v) for k, v in stack.totals.items()]
    yield stack.taken()


def hot_words(docs: DataFrame, max_n: int = MAX_N, sample: int = SAMPLE_DOCS, hot: int = HOT) -> dict[str, int]:
    """First words (with language) of more than one in ``hot`` suffix rows of about ``sample`` documents, and the parts
    that each is dealt to; ``hot`` words at most."""
    rows, size = docs.count(), FLUSH_BYTES
    some = docs if rows <= sample else docs.sample(fraction=sample / rows, seed=7)
    found = some.mapInArrow(lambda b: _suffixes(b, max_n, {}, size), _KEY).groupBy(F.substring_index("key", "\n", 1).alias("first")).count()
    found = materialize(found, "first-words")
    total = found.agg(F.sum("count")).first()[0] or 0
    out = {r["first"]: 1 + 2 * hot * r["count"] // total for r in found.where(F.col("count") * hot > total).collect()}
    release(found)
    return out


def phrase_counts(docs: DataFrame, max_n: int = MAX_N, min_count: int = MIN_COUNT) -> DataFrame:
    """``key, words, f`` of phrases with ``min_count`` occurrences or more, and each language's ``n`` (words 0), from
    ``lang, text``; a written table."""
    hot, size = hot_words(docs, max_n), FLUSH_BYTES
    rows = docs.mapInArrow(lambda b: _suffixes(b, max_n, hot, size), _KEY)
    part = F.xxhash64(F.substring_index("key", "\n", 1), F.when(F.col("parts") > 1, F.pmod(F.xxhash64("key"), F.col("parts"))).otherwise(F.lit(0)))
    sorted_ = rows.repartition(part).sortWithinPartitions(F.col("key").desc())
    partial = sorted_.mapInArrow(lambda b: _prefixes(b, max_n, min_count), "key string, words int, f long")
    counts = partial.groupBy("key", "words").agg(F.sum("f").alias("f")).where((F.col("f") >= min_count) | (F.col("words") == 0))
    return materialize(counts, "phrase-counts")


def _words(key: Column) -> Column:
    """The words of a key, without the language."""
    return F.transform(F.filter(F.split(key, "\n"), lambda x: x != ""), lambda x, i: F.when(i == 0, F.substring_index(x, "\t", 1)).otherwise(x))


def collocations(docs: DataFrame, max_n: int = MAX_N, min_count: int = MIN_COUNT, top: int = TOP, cover: int = COVER) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases of 2 to ``max_n`` words."""
    docs = docs.select(F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = phrase_counts(docs, max_n, min_count)
    name = lambda w, i, j: F.concat(F.get(w, i), F.lit("\t"), F.col("lang"), F.lit("\n"), F.array_join(F.transform(F.slice(w, i + 2, j - i - 1), lambda x: F.concat(x, F.lit("\n"))), ""))  # noqa: E731  key of words i to j
    lang = F.substring_index(F.split("key", "\n", 2)[0], "\t", -1)
    named = counts.where("words > 1").select("key", "words", F.col("f").alias("a"), lang.alias("lang"), _words(F.col("key")).alias("w"))
    # A candidate falls to the most frequent longer one that holds its words.
    inner = [name(F.col("w"), F.lit(i), F.lit(i + m)) for m in range(2, max_n) for i in range(max_n - m + 1)]
    sizes = [(m, i) for m in range(2, max_n) for i in range(max_n - m + 1)]
    parts = F.array(*[F.when(F.col("words") > F.lit(max(m, i + m - 1)), x) for (m, i), x in zip(sizes, inner, strict=True)]) if inner else F.array().cast("array<string>")
    longer = named.where("words > 2").select(F.explode(parts).alias("key"), F.col("a").alias("over")).where("key IS NOT NULL")
    longer = longer.groupBy("key").agg(F.max("over").alias("over"))
    left = named.join(longer, "key", "left").where(F.coalesce(100 * F.col("over") < cover * F.col("a"), F.lit(True)))
    left = materialize(left.select("key", "words", "a", "lang", "w"), "candidates")
    # Cuts after each word but the last; both parts of a candidate are counted, as it occurs no more often than they do.
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    cuts = left.select("key", "lang", "a", "w", "words", cut)
    cuts = cuts.select("key", "a", "k", name(F.col("w"), F.lit(0), F.col("k")).alias("head"), name(F.col("w"), F.col("k"), F.col("words")).alias("rest"))
    known = counts.where("words > 0").select("key", "f")
    cuts = cuts.join(known.select(F.col("key").alias("head"), F.col("f").alias("l")), "head").join(known.select(F.col("key").alias("rest"), F.col("f").alias("r")), "rest")
    big = lambda c: F.col(c).cast("decimal(15,0)")
    scored = cuts.withColumns({"aa": F.lit(1_000_000).cast("decimal(7,0)") * big("a") * big("a"), "lr": big("l") * big("r")})
    best = F.min(F.struct(F.expr("aa div lr").alias("score"), "k", "l", "r")).alias("best")
    scored = scored.groupBy("key").agg(best, F.first("a").alias("a"))
    phrase = F.array_join(_words(F.col("key")), " ")
    out = scored.select(lang.alias("lang"), phrase.alias("phrase"), "a", "best.l", "best.r", "best.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    for salt in (F.pmod(F.xxhash64("phrase"), F.lit(SALTS)), F.lit(0)):
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col("rank") <= top)
    sums = counts.where("words = 0").select(F.expr("substring(key, 2, length(key) - 2)").alias("lang"), F.col("f").alias("n"))
    out = out.join(checked(sums), "lang")
    raw = F.regexp_replace(F.regexp_replace("lang", r"(?<!\\)((?:\\\\)*)\\n", "$1\n"), r"\\\\", r"\\")
    return out.select(raw.alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k FROM s, range(1, 4) AS t(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, phrase, k, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
o AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3),
m AS (SELECT lang, phrase, max(a) AS over FROM o GROUP BY ALL),
q AS (SELECT c.* FROM c LEFT JOIN m USING (lang, phrase) WHERE over IS NULL OR k = 3 OR 100 * over < 50 * a),
x AS (SELECT lang, phrase, a, t.k AS cut, array_to_string(w[1:t.k], ' ') AS head, array_to_string(w[t.k + 1:], ' ') AS rest FROM q, range(1, 3) AS t(k) WHERE t.k < q.k),
y AS (
  SELECT x.lang, x.phrase, x.a, x.cut, h.f AS l, r.f AS r, (1000000::HUGEINT * x.a * x.a // (h.f::HUGEINT * r.f))::BIGINT AS score
  FROM x JOIN f h ON h.lang = x.lang AND h.phrase = x.head JOIN f r ON r.lang = x.lang AND r.phrase = x.rest),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM y),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z WHERE place = 1)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score FROM t JOIN n USING (lang) WHERE rank <= 2000
"""
