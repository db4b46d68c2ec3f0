"""Language identification, word first: known words by log frequency, unseen ones by ever shorter n-grams.

A word (a run of letters, in lower case) that the training texts have scores by its smoothed log frequency in each
language. An unseen word is scored by the mean over its known character n-grams of the longest order of which it
has a known one, and by the next shorter order otherwise, down to single letters; the ends of a word count as
characters. The model is fitted on a bounded sample of labelled rows, SAMPLE_ROWS a language at most (those of the
smallest hashes of text), and keeps every word and n-gram of it, with the languages that have it.

Words and n-grams are looked up by 64-bit hashes, for a block of texts at once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import grams
from weftline.llm.common import blocks, id_and_text, map_rows, small_batches, stored, text_buffer

SAMPLE_ROWS = 4000
ORDERS = (4, 3, 2, 1)
UNDETERMINED = "und"
#: Bytes of text, characters of words, and numbers of a table that are treated at once.
SEGMENT, CHARACTERS, CELLS = 1 << 20, 1 << 20, 1 << 22
#: Counts that a task gathers before it hands them on.
GATHERED = 1 << 20


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


def _characters(buf: np.ndarray) -> np.ndarray:
    return np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)


def _in_letters(buf: np.ndarray) -> np.ndarray:
    """Whether each byte of UTF-8 is part of a letter."""
    letters, out, a = _letters(), np.zeros(len(buf), bool), 0
    while a < len(buf):
        b = min(len(buf), a + SEGMENT)
        while b < len(buf) and buf[b] & 0xC0 == 0x80:
            b += 1
        part = buf[a:b]
        leads = part & 0xC0 != 0x80
        if leads.all():
            out[a:b] = letters[part]
        else:
            at = np.flatnonzero(leads)
            out[a:b] = np.repeat(letters[_characters(part)], np.diff(np.append(at, len(part))))
        a = b
    return out


def words(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-case bytes; starts, ends and hashes of the words; their number up to each text) of texts."""
    buf, offsets = text_buffer(pc.utf8_lower(col))
    starts, ends, firsts = grams.words_in(_in_letters(buf), offsets)
    return buf, starts, ends, grams.word_hashes(buf, starts, ends), firsts


def n_grams(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(order, hashes, word numbers) of the n-grams of words with a space at either end, longest order first, in parts."""
    lengths = ends - starts + 2
    at = np.cumsum(lengths) - lengths
    padded = np.full(int(lengths.sum()), 32, np.uint8)
    inner = np.ones(len(padded), bool)
    inner[at] = inner[at + lengths - 1] = False
    source = np.arange(int((ends - starts).sum())) + np.repeat(starts - (np.cumsum(ends - starts) - (ends - starts)), ends - starts)
    padded[inner] = buf[source]
    leads = padded & 0xC0 != 0x80
    owner = np.repeat(np.arange(len(starts)), lengths)[leads]
    h = grams.mix(_characters(padded).astype(np.uint64) + np.uint64(1))
    for n in ORDERS:
        for a in range(0, max(1, len(h) - n + 1), CHARACTERS):
            g = grams.windows(h[a : a + CHARACTERS + n - 1], n)
            within = owner[a : a + len(g)] == owner[a + n - 1 : a + n - 1 + len(g)]
            yield n, g[within], owner[a : a + len(g)][within]


@dataclass
class Table:
    """Hashes, sorted, with the languages that have them: entries first[i] to first[i + 1] of lang and gain.

    The log frequency of entry i in a language is base, and gain more where the language has it.
    """

    hashes: np.ndarray
    first: np.ndarray
    lang: np.ndarray
    gain: np.ndarray
    base: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, lang: np.ndarray, count: np.ndarray, n_langs: int) -> Table:
        """From one row a hash and language, with smoothing by a half."""
        order = np.lexsort((lang, hashes))
        hashes, lang, count = hashes[order], lang[order], count[order].astype(float)
        begins = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
        total = np.bincount(lang, count, n_langs)
        base = np.log(0.5) - np.log(total + 0.5 * max(1, len(begins)))
        return cls(hashes[begins], np.append(begins, len(hashes)), lang.astype(np.int32), np.log((count + 0.5) / 0.5).astype(np.float32), base)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1."""
        if not len(self.hashes):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.hashes, keys), len(self.hashes) - 1)
        return np.where(self.hashes[at] == keys, at, -1)

    def sums(self, entries: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(sum of the log frequencies of the entries of each owner by language, their number)."""
        n_langs = len(self.base)
        number = np.bincount(owner, minlength=n)
        size = self.first[entries + 1] - self.first[entries]
        flat = np.arange(int(size.sum())) + np.repeat(self.first[entries] - (np.cumsum(size) - size), size)
        cell = np.repeat(owner, size) * n_langs + self.lang[flat]
        return number[:, None] * self.base + np.bincount(cell, self.gain[flat], n * n_langs).reshape(n, n_langs), number


@dataclass
class Model:
    """Languages, the table of words, and that of the n-grams of each order."""

    langs: list[str]
    words: Table
    grams: dict[int, Table]

    def back_off(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Scores of unseen words by language: of the longest order of which a word has a known n-gram; 0 without any."""
        out = np.zeros((len(starts), len(self.langs)))
        total, number, order, done = np.zeros_like(out), np.zeros(len(starts), np.int64), ORDERS[0], np.zeros(len(starts), bool)

        def close() -> None:
            now = (number > 0) & ~done
            out[now] = total[now] / number[now, None]
            done[now] = True

        for n, g, owner in n_grams(buf, starts, ends):
            if n != order:
                close()
                if done.all():
                    return out
                total[:], number[:], order = 0, 0, n
            open_ = ~done[owner]
            g, owner = g[open_], owner[open_]
            at = self.grams[n].find(g)
            known = at >= 0
            sums, found = self.grams[n].sums(at[known], owner[known], len(starts))
            total += sums
            number += found
        close()
        return out

    def scores(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(log likelihood of each text by language, its number of words)."""
        buf, starts, ends, h, firsts = words(col)
        n = len(col)
        text = np.repeat(np.arange(n), np.diff(firsts))
        at = self.words.find(h)
        known = at >= 0
        total, _ = self.words.sums(at[known], text[known], n)
        unseen = np.flatnonzero(~known)
        distinct, first, inverse = np.unique(h[unseen], return_index=True, return_inverse=True)
        a = 0
        while a < len(distinct):  # as many words as have CHARACTERS bytes and CELLS scores, and one at least
            sizes = np.cumsum((ends - starts)[unseen[first[a : a + max(1, CELLS // max(1, len(self.langs)))]]])
            b = a + max(1, int(np.searchsorted(sizes, CHARACTERS, "right")))
            where = unseen[first[a:b]]
            rows = self.back_off(buf, starts[where], ends[where])
            mine = np.flatnonzero((inverse >= a) & (inverse < b))
            np.add.at(total, text[unseen[mine]], rows[inverse[mine] - a])
            a = b
        return total, np.diff(firsts)

    def predict(self, col: pa.Array) -> tuple[list[str], list[float]]:
        """Language, the least of the likeliest ones, and its share of the likelihood, tempered to ten words' worth."""
        if not self.langs:
            return [UNDETERMINED] * len(col), [0.0] * len(col)
        total, number = self.scores(col)
        best = total.argmax(1)
        top = total[np.arange(len(col)), best]
        p = np.exp((total - top[:, None]) * np.minimum(1.0, 10 / np.maximum(1, number))[:, None])
        score = np.where(number > 0, 1 / p.sum(1), 0.0)
        return [self.langs[k] if m else UNDETERMINED for k, m in zip(best.tolist(), number.tolist())], score.tolist()


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text leaves 1 by 3; a null id is as no text."""
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")) % 3 == 1


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code, text) to counts of words (order 0) and n-grams: n_gram, code, hash, count; gathered as far as a task holds."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def summed(parts: list) -> tuple[np.ndarray, ...]:
        order, code, h, count = (np.concatenate(x) for x in zip(*parts))
        by = np.lexsort((h, code, order))
        order, code, h, count = order[by], code[by], h[by], count[by]
        new = np.flatnonzero(np.append(True, (order[1:] != order[:-1]) | (code[1:] != code[:-1]) | (h[1:] != h[:-1])))
        return order[new], code[new], h[new], np.add.reduceat(count, new)

    def batch(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        order, code, h, count = rows
        return pa.RecordBatch.from_arrays([pa.array(order.astype(np.int32)), pa.array(code.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(count)], names=["n_gram", "code", "hash", "count"])

    for whole in batches:
        for part in blocks(whole, 1):
            buf, starts, ends, h, firsts = words(part.column(1))
            if not len(h):
                continue
            code = np.repeat(part.column(0).to_numpy(), np.diff(firsts)).astype(np.int64)
            by = np.lexsort((h, code))
            new = np.flatnonzero(np.append(True, (h[by][1:] != h[by][:-1]) | (code[by][1:] != code[by][:-1])))
            count, one = np.diff(np.append(new, len(h))), by[new]
            held.append((np.zeros(len(one), np.int64), code[one], h[one], count))
            for n, g, owner in n_grams(buf, starts[one], ends[one]):
                if len(g):
                    held.append(summed([(np.full(len(g), n), code[one][owner], g, count[owner])]))
            if sum(len(x[0]) for x in held) > GATHERED:
                held = [summed(held)]
                if len(held[0][0]) > GATHERED // 2:
                    yield batch(held.pop())
    if held:
        yield batch(summed(held))


def train(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from (lang, text) rows: a bounded sample, counted in Spark. Labels are values: any text may be one."""
    spark = labelled.sparkSession
    hashed = labelled.withColumn("h", F.xxhash64("text"))
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row a language
    langs = sorted(sizes)
    # of n rows, those whose hash falls in the lowest part that holds four times the sample, by expectation
    parts = [(code, lang, int(-(2**63) + min(1.0, 4 * sample_rows / sizes[lang]) * (2**64 - 1025))) for code, lang in enumerate(langs)]
    low = hashed.join(F.broadcast(spark.createDataFrame(parts, "code int, lang string, most long")), "lang").filter("h <= most")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    cuts = low.select("code", "lang", "h").distinct().withColumn("nth", nth).filter(F.col("nth") <= sample_rows).groupBy("code", "lang").agg(F.max("h").alias("cut"))
    cuts = spark.createDataFrame([tuple(r) for r in cuts.collect()], "code int, lang string, cut long")  # a row a language
    sample = stored(hashed.join(F.broadcast(cuts), "lang").filter("h <= cut").select("code", "text").dropDuplicates(), "language-sample")
    small_batches(spark)
    counts = sample.mapInArrow(_counts, "n_gram int, code int, hash long, count long").groupBy("n_gram", "code", "hash").agg(F.sum("count").alias("count"))
    rows = counts.toArrow()  # of the bounded sample
    order, code, h, count = (rows.column(k).to_numpy() for k in range(4))
    table = lambda n: Table.of(h[order == n].view(np.uint64), code[order == n], count[order == n], len(langs))
    return Model(langs, table(0), {n: table(n) for n in ORDERS})


def languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score.

    A null text, or one without a letter, is 'und' with score 0, and so is every text if nothing was learned. Of
    languages that are equally likely, the least label is taken. Repeated rows and null ids keep a row each; other
    columns aren't read. One pass over whole texts, however long, no shuffle; the model's size is that of its sample.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def work(part: pa.RecordBatch) -> dict:
            langs, scores = m.predict(part.column(1))
            return {"doc_id": part.column(0), "lang_pred": langs, "score": scores}

        return work

    found = map_rows(id_and_text(docs, id_col, text_col), make, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """languages() by a model of the documents that aren't held out and have a language.

    Labels are compared as they are: 'EN' and 'en' are two languages, and an empty one is a language. Of rows with
    equal text and label one counts. Rows with a null label or text teach nothing.
    """
    seen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    labelled = seen.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    return languages(docs, train(labelled, sample_rows), id_col, text_col)
