"""Language identification by prediction by partial matching.

Each language has a variable-order byte context tree (orders 0 to ORDER) with
escape probabilities of method C: in a context seen T times with D distinct
followers, a follower seen n times has probability n / (T + D), and an escape
to the next shorter context D / (T + D); below order 0 the 256 bytes are
equally likely.  The trees are frozen after training; a text's code length in
each language is exact, and the shortest code wins.  The score is the winner's
posterior under equal priors.

Training uses a bounded sample: the ``SAMPLE`` documents of each language with
the least hash of doc_id, their whole texts.  Counting runs as a Spark
aggregation, and every context of the sample is kept: the ``MOST_CONTEXTS``
most seen as a dense table, the others as sorted arrays of what each language
saw, which code the same lengths.  Both are broadcast.  Every document is
scored, over its whole text, in one pass without a shuffle.

Edge cases: a null text or one without a letter is ``und`` with score 0; rows
with null lang are never learned from; without any labelled row all texts are
``und``; ties go to the first language in alphabetical order; repeated rows
are scored alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from carrylens.llm.common import table

ORDER = 3
SAMPLE = 400  # documents of a language that are learned from
PART = 1 << 20  # bytes of a sampled document that are counted at once
MOST_CONTEXTS = 60_000  # rows of the dense table; contexts beyond it are sparse
WORST_RATE = 8.0  # bits a byte from which on no learned language explains a text


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the 1- to (ORDER+1)-byte grams of a batch's texts, by language;
    a gram is its bytes as digits in base 257 (value + 1)."""
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            data = text.encode("utf-8", "surrogatepass")
            for i in range(0, len(data), PART):
                raw = np.frombuffer(data[i : i + PART + ORDER], np.uint8).astype(np.int64) + 1
                found = []
                code = np.zeros(len(raw), np.int64)
                for n in range(ORDER + 1):
                    code = code[: max(0, len(raw) - n)] * 257 + raw[n:]
                    found.append(code[:PART])  # grams that start in this part
                grams, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(counts, pa.int64())], ["lang", "gram", "n"])


class Trees:
    """Builds the frozen context trees of all languages as one table: ``row`` maps the
    last ORDER bytes to a context, ``bits[context, byte, language]`` is the exact
    code length of the byte after it.  A context that no tree holds has the row
    of its longest known suffix, which is where every tree would escape to."""

    def __init__(self, counts: dict[str, dict[int, int]]) -> None:
        self.langs = sorted(counts)
        seen: dict[int, int] = {}
        symbols = set()
        for grams in counts.values():
            for g, n in grams.items():
                symbols.add(g % 257)
                if g // 257:
                    seen[g // 257] = seen.get(g // 257, 0) + n
        # the dense contexts: a suffix comes before what it ends
        depth = lambda g: 1 if g < 257 else 2 if g < 257**2 else 3
        ranked = sorted(seen, key=lambda g: (depth(g) > 2, -seen[g], g))
        kept, rest = ranked[:MOST_CONTEXTS], ranked[MOST_CONTEXTS:]
        self.alphabet = {s: i for i, s in enumerate(sorted(symbols), 1)}  # 0: any other byte
        a = len(self.alphabet) + 1
        place = {0: 0} | {c: i for i, c in enumerate(sorted(kept, key=lambda g: (depth(g), g)), 1)}
        bits = np.zeros((len(place), a, len(self.langs)), dtype=np.float32)
        for k, lang in enumerate(self.langs):
            followers: dict[int, list[tuple[int, int]]] = {}
            for g, n in counts[lang].items():
                if g // 257 in place:
                    followers.setdefault(g // 257, []).append((self.alphabet[g % 257], n))
            for c, i in place.items():
                if not c:
                    base = np.full(a, 8.0, dtype=np.float32)
                else:
                    d = depth(c)
                    base = bits[place[c % 257 ** (d - 1)] if c % 257 ** (d - 1) in place else 0, :, k]
                if c in followers:
                    who, n = (np.array(x) for x in zip(*followers[c]))
                    total = float(n.sum() + len(n))
                    base = base + np.float32(-np.log2(len(n) / total))
                    base[who] = -np.log2(n / total)
                bits[i, :, k] = base
        self.bits = bits
        # the row of every pair and triple of alphabet places (0 stands for any byte outside it)
        codes = np.zeros(a, dtype=np.int64)
        for s, i in self.alphabet.items():
            codes[i] = s
        row = np.zeros((a, a, a), dtype=np.int32)
        for c, i in place.items():  # ascending depth: deeper rows overwrite their suffix's
            digits = [self.alphabet.get(c // 257**e % 257, 0) for e in range(depth(c) - 1, -1, -1)] if c else []
            if c and 0 not in digits:
                row[(Ellipsis, *digits)] = i
        self.row = row
        self.symbol = np.zeros(256, dtype=np.int64)
        for s, i in self.alphabet.items():
            self.symbol[s - 1] = i

        self.sparse = self._sparse(counts, rest, depth, a) if rest else None

    def _sparse(self, counts: dict[str, dict[int, int]], rest: list[int], depth, a: int) -> tuple:
        """Of the contexts beyond the dense table: where they stand (by alphabet
        places), and by language and order their codes (places as digits in base
        ``a``) with escape lengths, and their grams' codes with code lengths."""
        place = lambda g: [self.alphabet[g // 257**e % 257] for e in range(depth(g) - 1, -1, -1)]
        code, deep = {}, np.zeros((a, a, a), dtype=bool)
        for c in rest:
            digits = place(c)
            deep[(Ellipsis, *digits)] = True
            code[c] = sum(d * a**e for e, d in enumerate(reversed(digits)))
        trees = []
        for lang in self.langs:
            followers: dict[int, list[tuple[int, int]]] = {}
            for g, n in counts[lang].items():
                if g // 257 in code:
                    followers.setdefault(g // 257, []).append((self.alphabet[g % 257], n))
            orders = []
            for d in range(1, ORDER + 1):
                escapes, grams = [], []
                for c, who in followers.items():
                    if depth(c) == d:
                        total = sum(n for _, n in who) + len(who)
                        escapes.append((code[c], -np.log2(len(who) / total)))
                        grams += ((code[c] * a + s, -np.log2(n / total)) for s, n in who)
                orders.append(tuple((np.array([x for x, _ in t], np.int64), np.array([y for _, y in t], np.float32)) for t in (sorted(escapes), sorted(grams))))
            trees.append(orders)
        return deep, trees

    @property
    def tables(self) -> tuple:
        """What tasks need: plain values, so that a broadcast needs no class."""
        return self.langs, self.row, self.bits, self.symbol, self.sparse


def _looked_up(table_: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is in the sorted table, and its value there."""
    codes, values = table_
    if not len(codes):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
    at = np.minimum(np.searchsorted(codes, keys), len(codes) - 1)
    return codes[at] == keys, values[at]


def code_lengths(model: tuple, data: bytes) -> np.ndarray:
    """Code length of the bytes in each language, in bits."""
    langs, row, bits, symbol, sparse = model
    s = symbol[np.frombuffer(data, np.uint8)]
    out = np.zeros(len(langs))
    for i in range(0, len(s), 1 << 16):
        part = s[max(0, i - ORDER) : i + (1 << 16)]
        padded = np.concatenate((np.zeros(ORDER - min(i, ORDER), np.int64), part))
        rows = row[padded[:-3], padded[1:-2], padded[2:-1]]
        lengths = bits[rows, padded[3:]]
        if sparse is not None:
            deep, trees = sparse
            rare = np.flatnonzero(deep[padded[:-3], padded[1:-2], padded[2:-1]])
            a, after = len(deep), padded[rare + 3]
            for k, orders in enumerate(trees):
                x = lengths[rare, k]
                code = np.zeros(len(rare), np.int64)
                for d, (escapes, grams) in enumerate(orders, 1):  # from the shortest: an escape adds to the suffix's length
                    digit = padded[rare + 3 - d]
                    code = code + digit * a ** (d - 1)
                    known, escape = _looked_up(escapes, code)
                    seen, own = _looked_up(grams, code * a + after)
                    x = np.where(known, np.where(seen, own, x + escape), x)
                lengths[rare, k] = x
        out += lengths.sum(axis=0, dtype=np.float64)
    return out


def sampled(docs: DataFrame) -> DataFrame:
    """The learned rows (lang, text): of each language the SAMPLE first distinct
    (doc_id, text) by a hash of doc_id, then doc_id, then text.

    Only ids and hashes are ranked (cut to SAMPLE a language in each task before
    they move); the chosen rows' texts are fetched by a semi join whose right
    side has at most SAMPLE short rows a language, so it is broadcast, and texts
    that weren't chosen don't move."""
    rows = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    rows = rows.withColumn("content", F.xxhash64("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "content")
    ids = rows.select("lang", "doc_id", "content").distinct()
    chosen = ids.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= SAMPLE).drop("place")
    held = rows.join(F.broadcast(chosen), ["lang", "doc_id", "content"], "left_semi")
    return held.groupBy("lang", "doc_id", "content").agg(F.min("text").alias("text")).select("lang", "text")


def learn(docs: DataFrame) -> Trees:
    """Trees from the sampled labelled rows that aren't held out."""
    grams = sampled(docs).mapInArrow(_grams, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[int, int]] = {}
    for lang, gram, n in zip(*grams.toArrow().to_pydict().values()):
        counts.setdefault(lang, {})[gram] = n
    return Trees(counts)


def predictor(model):
    """The mapInArrow function; ``model`` is a broadcast of Trees.tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.value
        names = tables[0]
        for b in batches:
            langs, scores, rates = [], [], []
            for text in b.column("text").to_pylist():
                if not names or not text or not any(map(str.isalpha, text)):
                    langs.append("und"), scores.append(0.0), rates.append(None)
                    continue
                data = text.encode("utf-8", "surrogatepass")
                bits = code_lengths(tables, data)
                best = int(np.argmin(bits))
                langs.append(names[best])
                scores.append(float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum()))
                rates.append(float(bits[best] / len(data)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names), pa.array(langs), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())], [*b.schema.names, "lang_pred", "score", "bits_a_byte"])

    return run


def identify(docs: DataFrame, train: DataFrame) -> DataFrame:
    """``docs`` with lang_pred, score and bits_a_byte added; an equally named
    column of the input is replaced."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(learn(train).tables)
    docs = docs.drop("lang_pred", "score", "bits_a_byte")
    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_a_byte", T.DoubleType())])
    return docs.mapInArrow(predictor(model), schema)


def op8_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), docs)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "bits_a_byte")
