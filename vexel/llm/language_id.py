"""Language ID by bit-sliced Bloom filters of character n-grams.

One table of bitmask slots serves all languages: bit l of a slot belongs to language l's Bloom filter. The AND of an
n-gram's slots is the set of all languages that (probably) contain it. A text's per-language popcounts, corrected for
each filter's false positives, decide; the score is the winner's share of the corrected counts.

Learning sees text and non-null lang of a bounded sample (SAMPLE documents a language) of the rows that aren't held out
(crc32(doc_id) mod 4 is 2). A language's filter holds its commonest n-grams that are not much commoner elsewhere.

Defined results: `und` with score 0 for null text, text without a letter, or when nothing could be learned; a text
with letters but no known n-gram gets the language with most training rows and score 0; a null doc_id is neither held
out nor learned from; repeated rows are judged each; an empty table gives an empty result; other columns are ignored;
very long texts are counted in pieces that lead on into each other, and counts add up. Up to 64 languages.
"""

from __future__ import annotations

import functools
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import pieces
from .common import table

#: Training documents a language, at most (about); n-gram sizes; n-grams a language, at most; slots; hashes.
SAMPLE, SIZES, GRAMS, SLOTS, HASHES = 3000, (2, 3, 4), 6000, 1 << 18, 3
#: Bytes of text that are taken apart at once, and code points whose n-grams are hashed at once.
BATCH, POINTS = 1 << 20, 1 << 18
#: A language holds an n-gram only if its rate there is at least this share of the highest rate in any language.
SHARE = 0.4
#: Documents with a lower score, or less of the text known to the winner, are rejected by keep_known().
LEAST_SCORE, LEAST_KNOWN = 0.3, 0.05


@functools.cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter, and its lower case where that is one code point."""
    alpha = np.concatenate([[chr(i).isalpha() for i in range(k, k + 4096)] for k in range(0, sys.maxunicode + 1, 4096)])
    lower = np.arange(len(alpha), dtype=np.uint32)
    for i in np.flatnonzero(alpha):
        low = chr(i).lower()
        if len(low) == 1:
            lower[i] = ord(low)
    return alpha, lower


def _normal(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, lower-cased, with one blank before, after and for all between words; the number of the
    text each is from; and each text's count of letters."""
    alpha, lower = _letters()
    points = np.frombuffer("".join("\0" + t.replace("\0", " ") + " " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = alpha[points]
    number = np.cumsum(points == 0) - 1
    letters = np.bincount(number[is_letter], minlength=len(texts))
    points = np.where(is_letter, lower[points], np.uint32(32))
    kept = is_letter | np.concatenate([[True], is_letter[:-1]]) | np.concatenate([[True], number[1:] != number[:-1]])
    return points[kept], number[kept], letters


def _grams(points: np.ndarray, number: np.ndarray, led: int = 0):
    """Hashes of all n-grams and the number of the text each is from, POINTS points at a time. The first `led` points were
    there before: an n-gram that ends among them isn't counted again."""
    for size in SIZES:
        first = max(0, led - size + 1)
        for k in range(first, max(first, len(points) - size + 1), POINTS):
            part, of = points[k : k + POINTS + size - 1].astype(np.uint64), number[k : k + POINTS + size - 1]
            n = len(part) - size + 1
            h = np.full(n, size, np.uint64)
            for j in range(size):
                h = h * np.uint64(0x9E3779B97F4A7C15) + part[j : j + n]
            same = of[:n] == of[size - 1 :]
            h, at = h[same], of[:n][same]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            yield h ^ (h >> np.uint64(32)), at


def gram_batches(batches):
    """Rows, their n-grams (as _grams yields them), each text's letters, and whether the text goes on: a long one comes in
    pieces, each led by the last points of the one before, so that its n-grams are those of the whole text."""
    carry = None
    for part, texts, more in pieces(batches, limit=BATCH):
        points, number, letters = _normal(texts.to_pylist())
        led = 0
        if carry is not None:  # it ends, as the piece begins, with the blank between them
            points, led = np.concatenate([carry, points[1:]]), len(carry)
            number = np.zeros(len(points), np.int64)
        yield part, _grams(points, number, led), letters, more
        carry = points[-max(SIZES) + 1 :] if more else None


def _slots(h: np.ndarray) -> list[np.ndarray]:
    return [((h >> np.uint64(20 * j)) & np.uint64(SLOTS - 1)).astype(np.int64) for j in range(HASHES)]


@dataclass
class LanguageFilter:
    langs: list[str]  # the one with most training rows first
    slots: np.ndarray  # uint64 bitmasks
    false: np.ndarray  # false-positive rate of each language's filter

    def tally(self, grams, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """Each text's n-grams, and those that each language (probably) has."""
        n, known = np.zeros(texts), np.zeros((texts, len(self.langs)))
        for h, at in grams:
            mask = functools.reduce(np.bitwise_and, (self.slots[s] for s in _slots(h)))
            n += np.bincount(at, minlength=texts)
            for lang in range(len(self.langs)):
                known[:, lang] += np.bincount(at[(mask >> np.uint64(lang)) & np.uint64(1) == 1], minlength=texts)
        return n, known

    def decide(self, n: np.ndarray, known: np.ndarray, letters: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score, and the share of n-grams known to that language, of each text."""
        if not self.langs:
            return ["und"] * len(n), np.zeros(len(n)), np.zeros(len(n))
        true = np.clip((known - n[:, None] * self.false) / (1 - self.false), 0, None)
        best, total = true.argmax(1), true.sum(1)
        top = true[np.arange(len(n)), best]
        score = np.where(letters > 0, np.divide(top, total, out=np.zeros(len(n)), where=total > 0), 0.0)
        share = np.where(letters > 0, np.minimum(1, np.divide(top, n, out=np.zeros(len(n)), where=n > 0)), 0.0)
        return [self.langs[b] if k else "und" for b, k in zip(best, letters)], score, share

    def judge(self, batches):
        """Rows with language, score and known share of each."""
        held = None  # counts of a long text so far
        for part, grams, letters, more in gram_batches(batches):
            counts = (*self.tally(grams, part.num_rows), letters)
            if held is not None:
                counts = tuple(a + b for a, b in zip(held, counts))
            held = counts if more else None
            if not more:
                yield part, *self.decide(*counts)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame) -> LanguageFilter:
    """Learn from documents that aren't held out. To the driver come counts of bounded numbers of n-grams only."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(docs["doc_id"]))
    known = known.select(F.col("lang").cast("string").alias("lang"), F.col("doc_id"), F.col("text").cast("string").alias("text"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(65).collect()}
    langs = sorted(sizes, key=lambda x: (-sizes[x], x))
    if len(langs) > 64:
        raise ValueError("more than 64 languages")
    if not langs:
        return LanguageFilter([], np.zeros(SLOTS, np.uint64), np.zeros(0))
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, SAMPLE / sizes[lang]))])
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(1_000_000) * share[F.col("lang")]).select("lang", "text")

    def count(batches):
        for part, grams, _, _ in gram_batches(batches):
            names = np.array(part.column("lang").to_pylist())
            found = list(grams)
            if not found:  # nothing but empty texts
                continue
            h, of = np.concatenate([x for x, _ in found]), names[np.concatenate([x for _, x in found])]
            for lang in np.unique(of).tolist():
                each, n = np.unique(h[of == lang], return_counts=True)
                yield pa.record_batch({"lang": pa.array([lang] * len(each), pa.string()), "gram": each.view(np.int64), "n": n.astype(np.int64)})

    counts = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = Window.partitionBy("lang")
    top = (counts.withColumn("rate", F.col("n") / F.sum("n").over(totals))
        .withColumn("rank", F.row_number().over(totals.orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= 4 * GRAMS))
    rates = top.toPandas()
    best = rates.groupby("gram")["rate"].transform("max")
    rates = rates[rates["rate"] >= SHARE * best].sort_values(["lang", "rank"]).groupby("lang").head(GRAMS)
    slots, false = np.zeros(SLOTS, np.uint64), []
    for i, lang in enumerate(langs):
        for s in _slots(rates.loc[rates["lang"] == lang, "gram"].to_numpy(np.int64).view(np.uint64)):
            slots[s] |= np.uint64(1 << i)
        false.append(((slots >> np.uint64(i)) & np.uint64(1)).mean() ** HASHES)
    return LanguageFilter(langs, slots, np.array(false))


def predictions(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, known (share of n-grams known to that language)."""

    def judge(batches):
        for batch, langs, score, known in model.judge(batches):
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(langs, pa.string()), "score": score, "known": known})

    judged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(judge, "doc_id long, lang_pred string, score double, known double")
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "known")


def keep_known(docs: DataFrame, model: LanguageFilter | None = None, least_score: float = LEAST_SCORE, least_known: float = LEAST_KNOWN) -> DataFrame:
    """The rows of docs, all columns, whose language is known: not `und`, and score and known share high enough.

    The filter runs beside the text, so no text is shuffled.
    """
    model = model or fit(docs)

    def keep(batches):
        for batch, langs, score, known in model.judge(batches):
            fits = [x != "und" and s >= least_score and k >= least_known for x, s, k in zip(langs, score, known)]
            yield batch.filter(pa.array(fits, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predictions(docs, fit(docs)).select("doc_id", "held_out", "lang_pred", "score")
