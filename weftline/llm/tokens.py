"""Token counts and ids by a word-end BPE vocabulary, exactly as its library gives them.

Whole-token shortcut. Offline, when the vocabulary is loaded, every vocabulary string that ends a word is
encoded by the library alone; those that come back as that one token are proven whole. A pre-token found among
them counts one at once; only the rest is merged, by the library, and kept in a bounded table. Which characters
the short way may treat is proven in the same manner, character by character; a text with any other character,
or with the string of a special token, goes to the library as it is.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.llm.common import id_and_text, map_rows

DEFAULT_VOCABULARY = "word_bpe_49k.json"
MAX_TOKENS = 2048
#: Merged pre-tokens that a worker keeps before it starts afresh; it bounds memory, not results.
KEPT_WORDS = 600_000
#: Pre-tokens in one call of the library.
MERGED_AT_ONCE = 1000
_loaded: dict[str, "WordVocabulary"] = {}


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordVocabulary:
    """A tokenizer file with the short way in front of it."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for word, i in vocabulary.items():
            self.ends[i] = word.endswith("</w>")
        self.special = sorted(x.content for x in self.library.get_added_tokens_decoder().values())
        self._prove_characters()
        self.whole = self._prove_words(vocabulary)
        self.one = self.whole.keys()
        self.ids: dict[str, bytes] = dict(self.whole)

    def _prove_characters(self) -> None:
        """Characters up to U+024F that lower-casing and splitting here treat as the library does."""
        letters, numbers, spaces, fine = [], [], [], []
        for code in range(0x250):
            c = chr(code)
            seen = self.library.normalizer.normalize_str(c)
            low = c.lower()
            parts = [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str("x" + low + "x")]
            if len(low) != 1 or (seen != low and not (seen == " " and len(parts) == 2)):
                continue
            kind = {1: letters, 2: spaces}.get(len(parts))
            if kind is None:
                twice = self.library.pre_tokenizer.pre_tokenize_str("x" + low + low + "x")
                kind = numbers if len(twice) == 4 else None
            fine.append(c)
            if kind is not None:
                kind.append(low)
        cls = lambda cs: "".join(re.escape(c) for c in dict.fromkeys(cs))
        self.other = re.compile(f"[^{cls(fine)}]")
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{cls(letters)}]+|[{cls(numbers)}]|[^{cls(letters)}{cls(numbers)}{cls(spaces)}]+").findall

    def _prove_words(self, vocabulary: dict[str, int]) -> dict[str, bytes]:
        """Lower-case strings of the fine characters that the library encodes alone as the one token."""
        names = [(w, i) for w, i in vocabulary.items() if w.endswith("</w>")]
        from tokenizers import decoders

        to_text = decoders.ByteLevel()
        found = {}
        texts = [to_text.decode([w[: -len("</w>")]]) for w, _ in names]
        for (_, i), text, e in zip(names, texts, self.library.encode_batch_fast(texts, add_special_tokens=False)):
            if e.ids == [i] and text == text.lower() and not self.other.search(text) and self.split(text) == [text]:
                found[text] = i.to_bytes(4, "little")
        return found

    def short(self, text: str) -> str | None:
        """The text in lower case if the short way may treat it, else None."""
        if self.other.search(text):
            return None
        low = text.lower()
        return None if any(s in low for s in self.special) else low

    def _merge(self, missing: list[str]) -> None:
        """Ids of pre-tokens that aren't whole: some at once to the library, cut where words end."""
        few = [" ".join(missing[a : a + MERGED_AT_ONCE]) for a in range(0, len(missing), MERGED_AT_ONCE)]
        ids = np.array([i for e in self.library.encode_batch_fast(few, add_special_tokens=False) for i in e.ids], np.uint32)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(missing):
            for w in missing:
                self.ids[w] = np.array(self.library.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
            return
        raw, at = ids.astype("<u4").tobytes(), 0
        for w, end in zip(missing, (cuts * 4).tolist()):
            self.ids[w] = raw[at:end]
            at = end

    def id_bytes(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, four little-endian bytes each."""
        lows = [self.short(t) for t in texts]
        parts = [self.split(low) if low else [] for low in lows]
        words = set().union(*parts)
        missing = words.difference(self.ids)
        if len(self.ids) + len(missing) > len(self.whole) + KEPT_WORDS:
            self.ids = dict(self.whole)
            missing = words.difference(self.ids)
        if missing:
            self._merge(list(missing))
        get = self.ids.__getitem__
        return [
            np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes() if low is None else b"".join(map(get, p))
            for text, low, p in zip(texts, lows, parts)
        ]

    def counts(self, texts: list[str]) -> list[int]:
        return [len(b) >> 2 for b in self.id_bytes(texts)]


def vocabulary(path: str) -> WordVocabulary:
    """The vocabulary of a file, loaded once a process."""
    if path not in _loaded:
        _loaded[path] = WordVocabulary(path)
    return _loaded[path]


def token_counts(docs: DataFrame, path: str | None = None, max_tokens: int = MAX_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_bytes, n_tokens, over_limit (more than max_tokens).

    A null or empty text has 0 bytes and 0 tokens. Whole texts are counted, however long. Repeated rows and null
    ids stay, a row each; other columns aren't read. One pass, no shuffle.
    """
    path = path or vocabulary_path()

    def make():
        v = vocabulary(path)

        def work(part: pa.RecordBatch) -> dict:
            col = part.column(1)
            texts = col.to_pylist()
            n = v.counts(texts)
            import pyarrow.compute as pc

            return {"doc_id": part.column(0), "n_bytes": pc.binary_length(col).cast(pa.int64()), "n_tokens": n, "over_limit": [x > max_tokens for x in n]}

        return work

    return map_rows(id_and_text(docs, id_col, text_col), make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
