"""Quality rules: counts of each text, and perplexity bands of a modified Kneser-Ney model per language.

The model is over code points: each language numbers those of its texts (``Alphabet``), and ORDER in a row are an n-gram, packed
into an integer that tells exactly which they are. Spark counts the n-grams over all texts; groups of them turn the
counts into sorted arrays of n-grams with their probabilities and of contexts with their back-off weights, for each order.
A language with many n-grams is cut into parts by the symbol before the last, so that whatever an n-gram needs of orders 2 and
more is in one part; counts of counts and the first order are summed over the parts before. Scoring looks the n-grams of a text up
in these arrays by binary search. If the arrays of all languages together exceed ``MODEL_BYTES``, the texts are scored in
several passes, each with the languages that fit; those of a language that alone exceeds it in several rounds, each with the
parts that fit, which add up.

A text is rejected by its counts (``base_failed``), or when its log perplexity, the median of its blocks', lies outside its language's band: the
median of all its distinct texts plus and minus a multiple of the median absolute deviation, widened for short texts, in which the
median of few characters varies more. A text is also rejected when more than ``ODD_PERCENT`` of its blocks, and two at least,
lie outside the band of the language's blocks: the median does not see what fills less than half of a text. A deviation has a floor from the deviations of all languages (``with_verdict``).

An n-gram of the highest order that only one text has counts in the model, but is not looked up: the model has learnt from all texts,
and what is strange to all others would be familiar by its own text. It gets the probability of the order below.

Copies of a text count once, in the model and in the bands, however many there are: else the band of a language that is
mostly copies would have no width, and a model of mostly one text would find all others strange.

Defined results: a null text counts as empty, has no words and fails; a null language is a language of its own; repeated
rows get equal results; an empty table gives an empty one; other columns stay.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskstream.llm.common import discard, given_back, materialize, packed, ship_package, slices, small_batches, table, trim, unpacked

#: Length of the n-grams, and bits of a symbol in the smallest and the largest alphabet: the n-grams of the latter fill 60 bits.
ORDER, BITS, MOST_BITS = 4, 6, 15
CLASSES = 1 << BITS  # symbols of the smallest alphabet
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"

#: Width of the bands in deviations, and the deviation that a text of one character would add.
UPPER, LOWER, SHORT = 6.0, 6.0, 0.5
#: Characters in a block of a text.
BLOCK = 128
#: Width of the bands of blocks in deviations, and the part of a text's blocks that may lie outside.
BLOCK_WIDTH, ODD_PERCENT = 8.0, 25
#: Distinct texts that a language's deviation needs to be taken at its word, and the least share of the deviation over all
#: languages that its own counts as, however many texts it has.
FEW, LEAST = 20, 0.5
#: Of the filter that tells which texts may be copies: more copied texts than this cost time, no accuracy.
COPIED_BITS = 1 << 26
MODEL_BYTES = 256 << 20
#: N-grams in a part of a language's model, about.
PART_GRAMS = 1 << 18
CHUNK, SLICE_BYTES = 1 << 19, 4 << 20  # characters, and bytes of rows, handled at once


class Alphabet:
    """Symbols for the code points of a language, given sorted: 0 is the text boundary, the others count from 1. Of more code
    points than ``MOST_BITS`` bits can tell apart the last are written as two symbols, so no two are written alike."""

    PAIR = 1056  # its square is more than there are code points
    SINGLES = (1 << MOST_BITS) - 1 - 2 * PAIR

    def __init__(self, points: np.ndarray):
        self.points = points.astype(np.uint32)
        self.bits = min(max(BITS, len(points).bit_length()), MOST_BITS)
        self.singles = len(points) if len(points) < 1 << MOST_BITS else self.SINGLES
        self.kind = np.dtype("<i4" if ORDER * self.bits < 32 else "<i8")  # of an n-gram
        self.ascii = (np.searchsorted(self.points, np.arange(0x80, dtype=np.uint32)) + 1).astype(self.kind)

    @staticmethod
    def points_of(text: str) -> np.ndarray:
        """The different code points of a text."""
        points = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le"), np.uint32)
        return np.flatnonzero(np.bincount(points))

    def symbols(self, text: str) -> np.ndarray:
        if text.isascii():
            return self.ascii[np.frombuffer(text.encode(), np.uint8)]
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        out, far = self.ascii[np.minimum(cp, 0x7F)], cp >= 0x80
        out[far] = np.searchsorted(self.points, cp[far]) + 1
        if self.singles < len(self.points):
            two = out > self.singles
            rest = out[two] - 1 - self.singles
            out[two] = self.singles + 1 + rest // self.PAIR
            out = np.repeat(out, 1 + two)
            out[np.cumsum(1 + two)[two] - 1] = self.singles + 1 + self.PAIR + rest % self.PAIR
        return out


def ngrams(texts: list[str], alphabet: Alphabet | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the texts, each led by ORDER - 1 boundaries and closed by one, and how many each text has. Without an
    alphabet it is that of the texts."""
    alphabet = alphabet or Alphabet(Alphabet.points_of("".join(texts)))
    pad, end = np.zeros(ORDER - 1, alphabet.kind), np.zeros(1, alphabet.kind)
    parts, lengths = [], np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        parts += [pad, alphabet.symbols(t), end]
        lengths[i] = len(parts[-2]) + 1
    c, bits = np.concatenate(parts), alphabet.bits
    codes = (c[:-3] << 3 * bits) | (c[1:-2] << 2 * bits) | (c[2:-1] << bits) | c[3:]
    stops = np.cumsum(lengths + ORDER - 1)
    keep = np.ones(len(codes), bool)  # not those that reach over into the next text
    for k in range(ORDER - 1):
        at = stops[:-1] - (ORDER - 1) + k
        keep[at] = False
    return codes[keep], lengths


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str | None, np.ndarray] = {}
    for b in slices(batches, SLICE_BYTES):
        texts: dict[str | None, list[str]] = {}
        for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            texts.setdefault(lang, []).append(t or "")
        for lang, mine in texts.items():
            held[lang] = np.union1d(held.get(lang, np.zeros(0, np.int64)), Alphabet.points_of("".join(mine)))
    for lang, points in held.items():
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(points), pa.string()), "point": pa.array(points, pa.int32())})


def alphabets(docs: DataFrame) -> dict[str | None, Alphabet]:
    """The alphabet of each language that has a character. At most all code points a language go through the driver."""
    with small_batches(docs.sparkSession):
        found = docs.select("lang", "text").mapInArrow(given_back(_points), "lang string, point int").distinct().toPandas()
    return {lang if isinstance(lang, str) else None: Alphabet(np.sort(g["point"].to_numpy()))
            for lang, g in found.groupby("lang", dropna=False)}


def _counter(letters):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list] = {}
        for b in batches:
            for lang, group in b.to_pandas().groupby("lang", dropna=False):
                lang = lang if isinstance(lang, str) else None
                texts, alphabet = list(group["text"]), letters.value.get(lang) or Alphabet(np.zeros(0))
                mine = held.setdefault(lang, [])
                for a, z in _chunks(texts):
                    mine.append(_counted(*ngrams(texts[a:z], alphabet), ORDER * alphabet.bits))
                if len(mine) > 16:
                    mine[:] = [_summed(mine)]
        for lang, parts in held.items():
            codes, n, texts = _summed(parts)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(codes), pa.string()), "code": codes, "n": n, "texts": texts})

    return count


def _counted(codes: np.ndarray, lengths: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different n-grams, how often each occurs, and in how many of the texts."""
    owner, width = np.repeat(np.arange(len(lengths)), lengths), (len(lengths) - 1).bit_length()
    codes = codes.astype(np.int64)
    if bits + width < 64:  # sorted as one number
        both = np.sort(codes << width | owner)
        codes, owner = both >> width, both & ((1 << width) - 1)
    else:
        order = np.lexsort((owner, codes))
        codes, owner = codes[order], owner[order]
    new = np.ones(len(codes), bool)
    new[1:] = codes[1:] != codes[:-1]
    other = new.copy()
    other[1:] |= owner[1:] != owner[:-1]
    at = np.flatnonzero(new)
    return codes[at], np.diff(np.append(at, len(codes))), np.add.reduceat(other, at, dtype=np.int64)


def _summed(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes, at = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
    return codes, *(np.bincount(at, np.concatenate([x[i] for x in parts])).astype(np.int64) for i in (1, 2))


def discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more."""
    return _cuts(_times(counts))


def _times(counts: np.ndarray) -> np.ndarray:
    """How many counts are 1, 2, 3 and 4."""
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5]


def _cuts(times: np.ndarray) -> np.ndarray:
    n = times.astype(float)
    if (n == 0).any():
        return np.array([0, 0.5, 1.0, 1.5])
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return np.array([0, *(min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d))])


def _levels(codes: np.ndarray, n: np.ndarray, bits: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The n-grams of each order with their counts; of lower orders: how many different symbols stand before."""
    counts = {ORDER: (codes.astype(np.int64), n)}
    for k in range(ORDER - 1, 0, -1):
        counts[k] = np.unique(counts[k + 1][0] & ((1 << bits * k) - 1), return_counts=True)
    return counts


def kneser_ney(codes: np.ndarray, n: np.ndarray, bits: int = BITS, whole: dict | None = None) -> dict[str, np.ndarray]:
    """Arrays g1..g4 of sorted n-grams with p1..p4, and c2..c4 of sorted contexts with back-off weights b2..b4. The n-grams are
    those of a language or of a part of it; then ``whole`` has the language's first order (1) and counts of counts (2 to 4)."""
    counts = _levels(codes, n, bits)
    if whole:
        counts[1] = whole[1]
    out: dict[str, np.ndarray] = {}
    for k in range(1, ORDER + 1):
        g, a = counts[k]
        order = np.argsort(g)
        g, a = g[order], a[order]
        d = (_cuts(whole[k]) if whole and k > 1 else discounts(a))[np.minimum(a, 3)]
        ctx, at = np.unique(g >> bits, return_inverse=True)
        total = np.bincount(at, a)
        back = np.bincount(at, d) / total
        if k == 1:
            below = np.full(len(g), 1 / (1 << bits))
        else:
            below = out[f"p{k - 1}"][np.searchsorted(out[f"g{k - 1}"], g & ((1 << bits * (k - 1)) - 1))]
        out[f"g{k}"], out[f"p{k}"] = g, (a - d) / total[at] + back[at] * below
        out[f"c{k}"], out[f"b{k}"] = ctx, back
    return out


def _tally(group: pd.DataFrame) -> pd.DataFrame:
    """What a part adds to its language's counts of counts, and to its first order: (order, count or symbol, n)."""
    counts = _levels(group["code"].to_numpy(), group["n"].to_numpy(), int(group["bits"].iloc[0]))
    rows = [(k, i + 1, int(x)) for k in range(2, ORDER + 1) for i, x in enumerate(_times(counts[k][1]))]
    rows += [(1, g, a) for g, a in zip(*(x.tolist() for x in counts[1]))]
    del counts
    trim()
    return pd.DataFrame([(group["lang"].iloc[0], *r) for r in rows], columns=["lang", "k", "x", "n"])


def _builder(wholes):
    def build(group: pd.DataFrame) -> pd.DataFrame:
        lang, bits, part = group["lang"].iloc[0], int(group["bits"].iloc[0]), int(group["part"].iloc[0])
        whole, group = wholes.value[lang if isinstance(lang, str) else None], group.sort_values("code")
        m = kneser_ney(group["code"].to_numpy(), group["n"].to_numpy(), bits, whole)
        for name in (f"g{ORDER}", f"p{ORDER}"):
            m[name] = m[name][group["texts"].to_numpy() > 1]
        kind = "<i4" if ORDER * bits < 32 else "<i8"
        out = pd.DataFrame([(lang, part, int(group["parts"].iloc[0]), name, x.astype(kind if name[0] in "gc" else "<f4").tobytes())
                            for name, x in m.items()], columns=["lang", "part", "parts", "name", "content"])
        del m
        trim()
        return out

    return build


class Model:
    """Probabilities of the n-grams of one language, or of a part of it, from its arrays."""

    def __init__(self, arrays: dict[str, bytes], bits: int = BITS):
        kind = "<i4" if ORDER * bits < 32 else "<i8"
        self.bits = bits
        self.a = {k: np.frombuffer(v, kind if k[0] in "gc" else "<f4") for k, v in arrays.items()}

    @staticmethod
    def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        return at, keys[at] == x

    def _prob(self, codes: np.ndarray, k: int) -> np.ndarray:
        if k == 0:
            return np.full(len(codes), 1 / (1 << self.bits), np.float32)
        at, hit = self._find(self.a[f"g{k}"], codes)
        p = np.empty(len(codes), np.float32)
        p[hit] = self.a[f"p{k}"][at[hit]]
        if not hit.all():
            miss = codes[~hit]
            at, known = self._find(self.a[f"c{k}"], miss >> self.bits)
            p[~hit] = np.where(known, self.a[f"b{k}"][at], 1) * self._prob(miss & ((1 << self.bits * (k - 1)) - 1), k - 1)
        return p


class Language:
    """Scores texts with the models of some or all of the ``number`` parts of their language."""

    def __init__(self, alphabet: Alphabet, number: int, parts: dict[int, dict[str, bytes]]):
        self.alphabet, self.number = alphabet, number
        self.parts = {part: Model(arrays, alphabet.bits) for part, arrays in parts.items()}

    def blocks(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Of each text the sum of the log perplexities of each block, without n-grams of other parts, and the blocks' lengths."""
        codes, lengths = ngrams(texts, self.alphabet)
        if self.number == 1:
            logs = -np.log(self.parts[0]._prob(codes, ORDER))
        else:
            logs, bits = np.zeros(len(codes), np.float32), self.alphabet.bits
            of = ((codes >> bits) & ((1 << bits) - 1)) % self.number
            for part, m in self.parts.items():
                here = of == part
                logs[here] = -np.log(m._prob(codes[here], ORDER))
        blocks = np.maximum(1, lengths // BLOCK)  # the last takes the rest
        last = np.cumsum(blocks)
        at = np.repeat(np.cumsum(lengths) - lengths - BLOCK * (last - blocks), blocks) + BLOCK * np.arange(last[-1])
        sums = np.add.reduceat(logs, at, dtype=np.float64)
        return np.split(sums, last[:-1]), np.split(np.diff(np.append(at, len(logs))), last[:-1])


def _text_key() -> Column:
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))


def _copied_bits(texts: DataFrame) -> np.ndarray:
    """A bit at ``q_bit`` of each text that occurs more than once, and at those of no others but by chance."""
    often = texts.groupBy("q_hash", "q_bit").agg(F.count("*").alias("n")).where("n > 1")
    words = often.groupBy(F.expr("q_bit DIV 32").cast("int").alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(q_bit % 32 AS int))")).alias("bits")).toPandas()  # COPIED_BITS / 32 rows at most
    out = np.zeros(COPIED_BITS // 32, np.uint32)
    out[words["at"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out


def _where_copied(bits, wanted: bool):
    """Rows whose bit is set, each (lang, text) once a batch, or those whose bit is not set."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("q_bit").to_numpy()
            rows = np.flatnonzero(((bits.value[at // 32] >> (at % 32).astype(np.uint32)) & 1) == wanted)
            b = b.take(pa.array(rows)).select(["lang", "text"])
            if wanted:
                first = {}
                for i, key in enumerate(zip(b.column("lang").to_pylist(), b.column("text").to_pylist())):
                    first.setdefault(key, i)
                b = b.take(pa.array(first.values(), pa.int64()))
            yield b

    return choose


def distinct_texts(docs: DataFrame, work=None, schema: str = "lang string, text string") -> DataFrame:
    """(lang, text) of ``docs``, each once, or what ``work`` makes of their batches. Only texts that may occur more than once are
    dealt; the others, nearly all in most corpora, stay where they are. ``work`` runs in the worker that chooses the texts: a
    second Python step of a task would take a worker more, and executors keep their workers for all later stages."""
    spark = docs.sparkSession
    texts = docs.select("lang", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("q_hash", F.xxhash64("lang", "text")).withColumn("q_bit", F.pmod("q_hash", F.lit(COPIED_BITS)))
    bits = spark.sparkContext.broadcast(_copied_bits(texts.select("q_hash", "q_bit")))
    texts, choose = texts.select("lang", "text", "q_bit"), _where_copied(bits, False)
    copied = texts.mapInArrow(given_back(_where_copied(bits, True)), "lang string, text string").dropDuplicates(["lang", "text"])
    if not work:
        return texts.mapInArrow(given_back(choose), schema).unionByName(copied)
    return (texts.mapInArrow(given_back(lambda batches: work(choose(slices(batches, SLICE_BYTES)))), schema)
            .unionByName(copied.mapInArrow(given_back(work), schema)))


def model(docs: DataFrame, letters: dict[str | None, Alphabet]) -> DataFrame:
    """(lang, part, parts, name, content): the arrays of each part of each language, from all distinct texts of ``docs``, as a
    table."""
    spark = docs.sparkSession
    ship_package(spark)
    count = _counter(spark.sparkContext.broadcast(letters))
    grams = table(distinct_texts(docs, count, "lang string, code long, n long, texts long")
                  .groupBy("lang", "code").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts")), "kn-grams")
    sizes = grams.groupBy("lang").count().collect()  # a row a language
    bits = {r.lang: letters[r.lang].bits if r.lang in letters else BITS for r in sizes}
    shape = spark.createDataFrame([(r.lang, bits[r.lang], -(-r["count"] // PART_GRAMS)) for r in sizes],
                                  "g_lang string, bits int, parts int")
    before_last = F.expr("shiftright(code, bits) & (shiftleft(1L, bits) - 1)")
    dealt = (grams.join(F.broadcast(shape), F.col("lang").eqNullSafe(F.col("g_lang"))).drop("g_lang")
             .withColumn("part", F.pmod(before_last, F.col("parts")).cast("int")))
    tallies = (dealt.groupBy("lang", "part").applyInPandas(_tally, "lang string, k int, x int, n long")
               .groupBy("lang", "k", "x").agg(F.sum("n").alias("n")).toPandas())  # at most an alphabet a language
    wholes = {}
    for (lang, k), g in tallies.sort_values("x").groupby(["lang", "k"], dropna=False):
        n = g["n"].to_numpy(np.int64)
        wholes.setdefault(lang if isinstance(lang, str) else None, {})[int(k)] = (g["x"].to_numpy(np.int64), n) if k == 1 else n
    arrays = table(dealt.groupBy("lang", "part").applyInPandas(
        _builder(spark.sparkContext.broadcast(wholes)), "lang string, part int, parts int, name string, content binary"), "kn-model")
    discard(grams)
    return arrays


def counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode()
    words = raw.split()  # of bytes: at the six ASCII white-space characters
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        times, upto = Counter(windows), 0
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    return (len(words), len(text) - sum(map(text.count, " \t\n\v\f\r")), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeated)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


#: ``q_log_ppl`` is the median over the blocks, which a passage in another language does not move.
MEASURES = tuple(f"q_{c}" for c in COUNTS) + ("q_log_ppl", "q_read", "q_blocks")
TYPES = {"q_log_ppl": "double", "q_blocks": "array<float>"}
MEASURED = ", ".join(f"{c} {TYPES.get(c, 'long')}" for c in MEASURES)


def _scorer(models, letters, first: bool, last: bool):
    """``q_sums``, the sums of the blocks of each text over the rounds up to this one; instead of them in the last round MEASURES."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = {lang: Language(letters.value.get(lang) or Alphabet(np.zeros(0)), *m) for lang, m in models.value.items()}
        for b in slices(batches, SLICE_BYTES):
            texts = [t or "" for t in b.column("text").to_pylist()]
            by_lang, blocks, sizes = {}, [np.zeros(0)] * len(texts), [np.zeros(0)] * len(texts)
            for i, lang in enumerate(b.column("lang").to_pylist()):
                by_lang.setdefault(lang, []).append(i)
            for lang, rows in by_lang.items():
                mine = [texts[i] for i in rows]
                for a, z in _chunks(mine):
                    for i, sums, n in zip(rows[a:z], *ready[lang].blocks(mine[a:z])):
                        blocks[i], sizes[i] = sums, n
            if not first:
                blocks = [x + np.asarray(y) for x, y in zip(blocks, b.column("q_sums").to_pylist())]
                b = b.drop_columns(["q_sums"])
            if last:
                means = [x / n for x, n in zip(blocks, sizes)]
                numbers = np.array([counts(t) for t in texts], np.int64).reshape(len(texts), len(COUNTS))
                new = [*numbers.T, np.array([np.median(x) for x in means], np.float64), np.array([len(t) + 1 for t in texts], np.int64),
                       pa.array([x.astype(np.float32) for x in means], pa.list_(pa.float32()))]
            else:
                new = [pa.array(blocks, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, new)],
                                             names=[*b.schema.names, *(MEASURES if last else ["q_sums"])])

    return score


def _passes(arrays: DataFrame) -> list[tuple[list[str | None], list[list[int]]]]:
    """The languages of ``arrays`` in groups whose arrays stay below ``MODEL_BYTES``, or of one language each; the parts of a
    language above it in rounds that stay below it, or of one part each. Others have one round, of no list of parts."""
    sizes: dict = {}
    for r in arrays.groupBy("lang", "part").agg(F.sum(F.length("content")).alias("n")).collect():  # a row a part
        sizes.setdefault(r.lang, {})[r.part] = r.n

    def dealt(items):
        groups, room = [[]], MODEL_BYTES
        for x, n in sorted(items, key=lambda i: (i[1], str(i[0]))):
            if groups[-1] and room < n:
                groups.append([])
                room = MODEL_BYTES
            groups[-1].append(x)
            room -= n
        return groups

    return [(langs, dealt(sizes[langs[0]].items()) if len(langs) == 1 else [[]])
            for langs in dealt((lang, sum(parts.values())) for lang, parts in sizes.items())]


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns of ``MEASURES``, as a table."""
    spark = docs.sparkSession
    ship_package(spark)
    found = alphabets(docs)
    letters, arrays = spark.sparkContext.broadcast(found), model(docs, found)
    passes, scored = _passes(arrays), []
    for langs, rounds in passes:
        known = [x for x in langs if x is not None]
        mine = F.col("lang").isin(known) if known else F.lit(False)
        mine = mine | F.col("lang").isNull() if None in langs else mine
        part = docs.where(mine) if len(passes) > 1 else docs
        for i, parts in enumerate(rounds):
            held: dict = {}
            for r in arrays.where(mine & F.col("part").isin(parts) if parts else mine).collect():
                held.setdefault(r.lang, (r.parts, {}))[1].setdefault(r.part, {})[r["name"]] = bytes(r.content)
            last = i == len(rounds) - 1
            schema = StructType([*docs.schema.fields,
                                 *StructType.fromDDL(MEASURED if last else "q_sums array<double>").fields])
            before = part
            part = table(part.mapInArrow(given_back(_scorer(spark.sparkContext.broadcast(held), letters, i == 0, last)), schema),
                         "quality")
            if i:
                discard(before)
        scored.append(part)
    discard(arrays)
    out = reduce(DataFrame.unionByName, scored)
    out.read_tables = scored
    return out


def _bands(once: DataFrame, value: str, name: str) -> DataFrame:
    """(q_lang, <name>_mid, <name>_dev): the median of a value and the median deviation from it in each language. A deviation
    counts as at least ``LEAST`` of the median deviation over all languages, and with the square of what the language lacks of
    ``FEW`` texts more (a model of two texts tells them apart by their lengths). With fewer texts than that in all languages
    together there is nothing to take a band from, and it has no bounds."""
    near = F.col("lang").eqNullSafe(F.col("q_lang"))
    texts = F.count_if("q_first")
    mid = once.groupBy(F.col("lang").alias("q_lang")).agg(
        F.percentile_approx(value, 0.5, 10_000).alias(f"{name}_mid"), texts.alias("q_texts"))
    offs = once.join(materialize(mid, f"{name}-mid"), near)
    middle = F.percentile_approx(F.abs(F.col(value) - F.col(f"{name}_mid")), 0.5, 10_000)
    pooled = offs.agg(middle.alias("dev"), texts.alias("n")).first()
    least = F.lit(float(pooled.dev or 0)) * F.greatest(F.lit(LEAST), F.pow(F.lit(float(FEW)) / F.col("q_texts"), F.lit(2.0)))
    bands = offs.groupBy("q_lang", f"{name}_mid", "q_texts").agg(middle.alias("dev"))
    dev = F.greatest(F.col("dev").cast("double"), least) if pooled.n >= FEW else F.lit(float("inf"))
    return materialize(bands.select("q_lang", f"{name}_mid", dev.alias(f"{name}_dev")), f"{name}-bands")


def with_verdict(scored: DataFrame) -> DataFrame:
    """Add q_failed and q_kept. The bands are taken over distinct texts and their blocks."""
    once = materialize(scored.groupBy("lang", _text_key().alias("q_text")).agg(
        F.min("q_log_ppl").alias("q_log_ppl"), F.min("q_blocks").alias("q_blocks")), "quality-once")
    blocks = once.select("lang", F.posexplode("q_blocks").alias("at", "q_block"))
    texts = _bands(once.withColumn("q_first", F.lit(True)), "q_log_ppl", "q")
    parts = _bands(blocks.withColumn("q_first", F.col("at") == 0), "q_block", "b").withColumnRenamed("q_lang", "b_lang")
    bands = materialize(texts.join(parts, F.col("q_lang").eqNullSafe(F.col("b_lang"))), "quality-both")  # a row a language
    off = F.col("q_log_ppl") - F.col("q_mid")
    slack = F.lit(SHORT) / F.sqrt("q_read")
    failed = ((F.col("q_n_words") < MIN_WORDS)
              | (100 * F.col("q_n_repeat_words") > MAX_REPEAT_PERCENT * F.col("q_n_words")))
    odd = F.size(F.filter("q_blocks", lambda b: F.abs(b - F.col("b_mid")) > BLOCK_WIDTH * F.col("b_dev")))
    whole = (odd < 2) | (100 * odd <= ODD_PERCENT * F.size("q_blocks"))
    inside = (off <= UPPER * F.col("q_dev") + slack) & (off >= -LOWER * F.col("q_dev") - slack) & whole
    return (scored.join(bands, F.col("lang").eqNullSafe(F.col("q_lang")))
            .withColumn("q_failed", failed).withColumn("q_kept", ~failed & inside))


def rules(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, base_failed, kept, log_ppl) of each document."""
    judged = with_verdict(measured(docs.select("doc_id", "lang", "text")))
    return judged.select("doc_id", *[F.col(f"q_{c}").alias(c) for c in COUNTS], F.col("q_failed").alias("base_failed"),
                         F.col("q_kept").alias("kept"), F.col("q_log_ppl").alias("log_ppl"))


def kept(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep; ``read_tables`` of the result can be deleted when it has been written."""
    needed = ["lang", "text"]
    scored = measured(packed(docs, needed))
    out = unpacked(with_verdict(scored).where("q_kept"), docs, needed)
    out.read_tables = scored.read_tables
    return out
