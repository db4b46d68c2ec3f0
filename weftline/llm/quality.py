"""Quality rules by repetition coverage: which characters lie in n-grams and lines that a text repeats."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import grams
from weftline.llm.common import by_text, id_and_text, map_rows, text_buffer

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
SPACES = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rules:
    """Bounds of the rules.

    coverage: by n-gram length, the largest share of characters inside n-grams that the text had before; a passage
    that occurs twice counts once, as the first occurrence is no repetition.
    """

    min_words: int = 50
    repeat_percent: int = 50
    coverage: dict[int, float] = field(default_factory=lambda: {5: 0.30, 7: 0.27, 10: 0.25})
    line_coverage: float = 0.30
    symbol_share: float = 0.05


def measure(buf: np.ndarray, offsets: np.ndarray, texts: list[str], rules: Rules) -> dict[str, np.ndarray]:
    """All measures of texts that lie end to end in buf, by rolling hashes over the whole block."""
    starts, ends, firsts = grams.words(buf, offsets)
    n_texts, n_words = len(offsets) - 1, np.diff(firsts)
    wide = np.int32 if len(buf) < 1 << 31 else np.int64
    code_points = np.zeros(len(buf) + 1, wide)
    np.cumsum((buf & 0xC0) != 0x80, out=code_points[1:])
    symbols = np.zeros(len(buf) + 1, wide)
    np.cumsum(SYMBOL[buf], out=symbols[1:])
    chars = code_points[ends] - code_points[starts]
    word_chars = grams.sums(chars, firsts)
    h = grams.word_hashes(buf, starts, ends)
    owner = grams.mix(np.repeat(np.arange(1, n_texts + 1, dtype=np.uint64), n_words))
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]]}

    def covered(n: int, later: bool) -> np.ndarray:
        """For each word, whether a window of n words around it occurs again in its text (later: occurred before)."""
        g = grams.windows(h, n)
        at = np.flatnonzero(grams.within_texts(firsts, n, len(g)))
        keys = g[at] ^ owner[at]
        again = grams.repeated(keys)
        at, keys = at[again], keys[again]
        if later and len(at):
            order = np.argsort(keys, kind="stable")
            same = keys[order][1:] == keys[order][:-1]
            at = at[order[1:][same]]
        steps = np.zeros(len(h) + 1, np.int32)
        np.add.at(steps, at, 1)
        np.add.at(steps, at + n, -1)
        return np.cumsum(steps[:-1]) > 0

    out["n_repeat_words"] = grams.sums(covered(3, False), firsts)
    for n in rules.coverage:
        out[f"chars_{n}"] = grams.sums(np.where(covered(n, True), chars, 0), firsts)
    dup_lines, dup_chars = np.zeros(n_texts, np.int64), np.zeros(n_texts, np.int64)
    for i, text in enumerate(texts):
        if "\n" in text:
            lines = [x for x in text.split("\n") if x.strip(SPACES)]
            once = set(lines)
            if len(once) < len(lines):
                dup_lines[i] = len(lines) - len(once)
                for x in lines:
                    if x in once:
                        once.discard(x)
                    else:
                        dup_chars[i] += sum(map(len, x.split(None)))
    return out | {"n_dup_lines": dup_lines, "line_chars": dup_chars}


def verdicts(m: dict[str, np.ndarray], rules: Rules) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """(base_failed, kept, shares) of measured texts."""
    chars = np.maximum(m["word_chars"], 1)
    failed = (m["n_words"] < rules.min_words) | (100 * m["n_repeat_words"] > rules.repeat_percent * m["n_words"])
    shares = {f"share_{n}": m[f"chars_{n}"] / chars for n in rules.coverage}
    shares |= {"share_lines": m["line_chars"] / chars, "share_symbols": m["n_symbols"] / chars}
    kept = ~failed & (shares["share_lines"] <= rules.line_coverage) & (shares["share_symbols"] <= rules.symbol_share)
    for n, most in rules.coverage.items():
        kept &= shares[f"share_{n}"] <= most
    return failed, kept, shares


def quality(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: counts, shares of repeated characters, base_failed and kept.

    A null or empty text has no words: all counts are 0, base_failed is true. Repeated rows and null ids keep a
    row each; other columns aren't read. Whole texts are measured. kept is false where base_failed, where the
    characters in n-grams that occurred before, or in lines that did, take more than their share of all characters
    of words, or where symbols do. One pass, no shuffle.
    """
    ns = list(rules.coverage)
    extra = "".join(f", share_{n} double" for n in ns)
    schema = f"doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean{extra}, share_lines double, share_symbols double"

    def make():
        def work(part: pa.RecordBatch) -> dict:
            buf, offsets = text_buffer(part.column(1))
            m = measure(buf, offsets, part.column(1).to_pylist(), rules)
            failed, kept, shares = verdicts(m, rules)
            out = {k: m[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
            return out | shares | {"doc_id": part.column(0), "base_failed": failed, "kept": kept}

        return work

    return map_rows(id_and_text(docs, id_col, text_col), make, schema)


def good_documents(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text") -> DataFrame:
    """docs without the rows whose text the rules reject, with all their columns; null and empty texts go."""

    def make():
        def work(col: pa.Array) -> list[bool]:
            buf, offsets = text_buffer(col)
            return verdicts(measure(buf, offsets, col.to_pylist(), rules), rules)[1].tolist()

        return work

    return docs.filter(by_text(make, "boolean")(F.col(text_col)))
