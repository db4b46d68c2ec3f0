"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, names and units are replaced by typed placeholders, names by several typings.
Windows of templates, and of the plain words in any case, are hash-joined with those of the benchmark items. Where windows of an item line up in a text, the fillers of the
slots are compared: each filler of the item must stand for one filler of the text throughout and the other way
round, so that a question with other numbers or names is caught, and one whose slots contradict is not.

The windows of the benchmark are broadcast in blocks of BLOCK_ITEM_BYTES of item text, however large the
benchmark is; each block is held against all texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import grams
from weftline.llm.common import by_text, id_and_text, map_rows, stored, text_buffer

WINDOW = 8
#: Literal words that a window with placeholders holds at least, if its fillers may be others; placeholders alone say nothing.
LEAST_LITERAL = 5
#: A text is contaminated by an item of which so many words line up, or the lesser share of the item.
LEAST_WORDS = 13
LEAST_SHARE = 0.8
#: Words that a part of an item is off its place at most, as against the part before.
FURTHEST_SHIFT = 8
BLOCK_ITEM_BYTES = 8 << 20

NUMBER, UNIT, NAME = (np.uint64(x) for x in (0x6E756D626572, 0x756E6974, 0x6E616D65))
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_POINT = np.zeros(256, bool)
_POINT[list(b".,")] = True
_NUMBER_WORDS = "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split()
_UNITS = (
    "mm cm m km g kg mg t l ml s ms min h hr hrs mph kmh gb mb kb tb hz khz mhz ghz w kw v a usd eur gbp percent meter meters metre metres centimeter centimeters kilometer kilometers "
    "mile miles foot feet ft inch inches yard yards gram grams kilogram kilograms pound pounds lb lbs ounce ounces oz ton tons liter liters litre litres gallon gallons second seconds minute "
    "minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents degree degrees"
).split()


def _hash_of(lexicon: list[str]) -> np.ndarray:
    raw = np.frombuffer("".join(lexicon).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in lexicon])
    return np.unique(grams.word_hashes(raw, ends - np.array([len(w) for w in lexicon]), ends))


_NUMBER_HASHES, _UNIT_HASHES, _ONE = _hash_of(_NUMBER_WORDS), _hash_of(_UNITS), _hash_of(["one"])


@dataclass
class Template:
    """Tokens of texts end to end: literal or placeholder, what fills it, and token counts up to each text.

    word: number of the token's first word among all words, and of all words at the end.
    """

    token: np.ndarray
    filler: np.ndarray
    firsts: np.ndarray
    word: np.ndarray

    def slots(self) -> np.ndarray:
        return (self.token == NUMBER) | (self.token == UNIT) | (self.token == NAME)


def _folded(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, bytes in lower case, offsets); a character whose lower case has another length is kept."""
    low = pc.utf8_lower(col)
    buf, offsets = text_buffer(col)
    small, at = text_buffer(low)
    if len(small) != len(buf) or not np.array_equal(at, offsets):
        simple = ["".join(c.lower() if len(c.lower().encode()) == len(c.encode()) else c for c in t) for t in col.to_pylist()]
        small, _ = text_buffer(pa.array(simple, col.type))
    return buf, small, offsets


def _joined(token: np.ndarray, word: np.ndarray, firsts: np.ndarray, run: np.ndarray) -> Template:
    """A token of run goes on with the slot before it, which is filled by all of its words."""
    run[firsts[:-1][firsts[:-1] < len(word)]] = False
    n = len(word)
    if not run.any():
        return Template(token, word, firsts, np.arange(n + 1))
    keep = np.flatnonzero(~run)
    at = np.cumsum(~run) - 1
    filler = word[keep]
    sums = np.zeros(len(keep), np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(sums, at, grams.mix(word + (np.arange(n) - keep[at]).astype(np.uint64)))
    several = np.diff(np.append(keep, n)) > 1
    filler[several] = sums[several]
    return Template(token[keep], filler, np.searchsorted(keep, firsts, "left"), np.append(keep, n))


def _filled(words: np.ndarray) -> int:
    """What fills a slot of these words, as _joined() has it."""
    with np.errstate(over="ignore"):
        return int(words[0] if len(words) == 1 else grams.mix(words + np.arange(len(words), dtype=np.uint64)).sum(dtype=np.uint64))


def templates(col: pa.Array) -> list[Template]:
    """The texts by four typings, since capitals alone don't tell what a name is.

    Names are (0) words with a capital inside sentences; (1) all with a capital; (2) those of 0, and in any case and
    place words that are names elsewhere in their text. (3) is (0) with any word after a number as a unit. The last
    has literals only: the words without regard to case.
    """
    buf, low, offsets = _folded(col)
    n = len(buf)
    inside = ~grams.NOT_WORD[low]
    digit = _DIGIT[low]
    if n > 2:
        inside[1:-1] |= _POINT[low[1:-1]] & digit[:-2] & digit[2:]
    number_byte = digit | (inside & _POINT[low]) if n else digit
    cuts = np.flatnonzero(number_byte[1:] != number_byte[:-1]) + 1
    starts, ends, firsts = grams.words_in(inside, offsets, cuts)
    word = grams.word_hashes(low, starts, ends)
    plain = Template(word, word, firsts, np.arange(len(word) + 1))
    if not len(word):
        return [plain]
    first = np.zeros(len(word), bool)
    first[firsts[:-1][firsts[:-1] < len(word)]] = True
    in_words = grams.member(word, _NUMBER_HASHES)
    is_number = digit[starts] | in_words
    # number words that go on with a number, by a space or hyphen: twenty-one, 3 million
    more = np.zeros(len(word), bool)
    more[1:] = is_number[:-1] & (starts[1:] - ends[:-1] == 1) & ((low[starts[1:] - 1] == 32) | (low[starts[1:] - 1] == 45))
    more &= (in_words | (word == _ONE[0])) & ~first
    is_number |= more
    after_number = np.zeros(len(word), bool)
    after_number[1:] = is_number[:-1]
    after_number &= ~first
    is_unit = after_number & grams.member(word, _UNIT_HASHES)
    # a name: capital, then small, and no sentence begins with it
    capital = buf[starts] != low[starts]
    second = np.minimum(starts + 1, n - 1)
    wide = low[starts] >= 0xC3
    capital |= wide & (buf[second] != low[second])
    third = np.minimum(starts + 1 + wide, n - 1)
    small = (third < ends) & (buf[third] == low[third])
    gap = np.where(starts > 0, low[np.maximum(starts - 1, 0)], 10)
    before = np.where(starts > 1, low[np.maximum(starts - 2, 0)], 10)
    previous = (gap == 32) & ((before >= 0x80) | ~grams.NOT_WORD[before] | (before == 44))
    capital &= small & ~is_number
    is_name = capital & previous & ~first
    typings = [(is_name, is_unit), (capital, is_unit)]
    if is_name.any():
        text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts)).astype(np.uint64)
        own = word ^ grams.mix(text + np.uint64(1))
        typings.append((grams.member(own, np.unique(own[is_name])) & ~is_number, is_unit))
    placed_unit = after_number & ~is_number & ~is_name
    if (placed_unit & ~is_unit).any():
        typings.append((is_name, placed_unit))
    out = []
    for names, units in typings:
        token = word.copy()
        token[is_number] = NUMBER
        token[units] = UNIT
        token[names] = NAME
        run = more.copy()
        run[1:] |= names[1:] & names[:-1]  # names and numbers of several words are one slot
        out.append(_joined(token, word, firsts, run))
    return [*out, plain]


@dataclass
class Run:
    """Windows of an item that follow each other in a text: word ranges in both, and what the item's fillers stand for.

    sound: whether they stand for one filler each, over all windows at the shift. own: whether they are those of the
    item, or of another of its class.
    """

    p: int
    p_end: int
    q: int
    q_end: int
    forth: dict
    back: dict
    plain: bool
    sound: bool
    own: bool

    def holds(self, other: Run) -> bool:
        return self.p <= other.p and other.p_end <= self.p_end and self.q <= other.q and other.q_end <= self.q_end


@dataclass
class ItemClass:
    """Items that are one template in every typing, with fillers that are equal in the same places.

    What lines up with one of them, whatever its fillers, lines up with all. columns: the first item's distinct
    fillers, numbered; fillers: those of each item, in the same order. ids: of each item.
    """

    item: int
    columns: dict[int, int]
    ids: list[int | None]
    fillers: np.ndarray

    def with_fillers(self, forth: dict[int, int]) -> np.ndarray:
        """The items whose fillers are those that the first item's stand for."""
        if not forth:
            return np.arange(len(self.ids))
        at = [self.columns[x] for x in forth]
        return np.flatnonzero((self.fillers[:, at] == np.array(list(forth.values()), np.uint64)).all(1))

    def least(self, items: np.ndarray) -> int | None:
        return min((self.ids[k] for k in items.tolist()), key=lambda i: (i is None, i or 0))


@dataclass
class Match:
    """A class of items that lines up in a text: the least id (of those with the same fillers, if there are), words, their
    share of the item, whether an item has the same fillers, and how many items line up."""

    item_id: int | None
    words: int
    share: float
    exact: bool
    items: int


class Benchmark:
    """Windows of a block of items, sorted by hash, and the items' templates. Windows of a class of items are kept once."""

    def __init__(self, ids: list[int | None], texts: list[str], window: int = WINDOW, least_literal: int = LEAST_LITERAL) -> None:
        self.window = window
        self.typings = templates(pa.array(texts, pa.string()))
        self.slot = [t.slots() for t in self.typings]
        self._group(ids)
        base = self.typings[0]
        self.firsts, self.words = base.firsts, base.word[base.firsts]  # tokens, and words, up to each item
        self.tokens = np.zeros(int(base.word[-1]) + 1, np.int64)  # tokens that begin before each word
        self.tokens[base.word[:-1] + 1] = 1
        self.tokens = np.cumsum(self.tokens)
        hashes, at, size, typing, begin, cls = [], [], [], [], [], []
        for k, t in enumerate(self.typings):
            lengths = np.diff(t.firsts)
            item = np.repeat(np.arange(len(lengths)), lengths)
            plain = k + 1 == len(self.typings)
            # plain words have no slots: whatever they are, equal ones count
            literal = np.concatenate([[0], np.cumsum(~self.slot[k])])
            # halves of items in which no whole window is left of a word more or less in the middle
            halves = {int(x) // 2 for x in lengths if least_literal <= x // 2 < window}
            for n in sorted({min(int(x), window) for x in lengths if x} | halves):
                g = grams.windows(t.token, n)
                ok = grams.within_texts(t.firsts, n, len(g))
                ok &= (literal[n:] - literal[:-n]) >= min(least_literal, n)
                if n < window:  # a shorter item is a window as a whole
                    short = np.repeat((lengths == n) | ((lengths // 2 == n) & (n >= least_literal)), lengths)
                    ok &= short[: len(ok)]
                if not plain:
                    ok &= self.is_first[item[: len(ok)]]
                p = np.flatnonzero(ok)
                c = self.class_of[item[p]]
                # words of every item of a class, at their place in its first item
                q = p - t.firsts[item[p]] + t.firsts[np.array([x.item for x in self.classes], np.int64)[c]] if len(p) else p
                hashes.append(g[p])
                at.append(q)
                size.append(np.full(len(p), n))
                typing.append(np.full(len(p), k, np.int8))
                begin.append(t.word[q])
                cls.append(c)
        none = np.zeros(0, np.int64)
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.at, self.size, self.typing, begin, self.cls = (np.concatenate(x) if x else none for x in (at, size, typing, begin, cls))
        order = np.lexsort((self.typing, begin, self.hash))
        # a window that several typings, or items of a class, share is kept once, and as plain words
        h, b, last = self.hash[order], begin[order], self.typing[order] + 1 == len(self.typings)
        once = np.ones(len(order), bool)
        once[1:] = (h[1:] != h[:-1]) | (b[1:] != b[:-1]) | (last[1:] & ~last[:-1])
        order = order[once]
        self.hash, self.at, self.size, self.typing, self.cls = self.hash[order], self.at[order], self.size[order], self.typing[order], self.cls[order]
        self.known = {int(n): np.unique(self.hash[self.size == n]) for n in np.unique(self.size)}
        self.marks = {n: grams.mark_table(k) for n, k in self.known.items()}

    def _group(self, ids: list[int | None]) -> None:
        """Items to classes; the first item of a class stands for it."""
        found: dict[tuple, int] = {}
        self.classes: list[ItemClass] = []
        fillers: list[list[np.ndarray]] = []
        self.class_of, self.is_first = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
        for i, item_id in enumerate(ids):
            parts, own = [], []
            for t, slot in zip(self.typings[:-1], self.slot):
                a, b = int(t.firsts[i]), int(t.firsts[i + 1])
                parts += [t.token[a:b].tobytes(), (t.word[a : b + 1] - t.word[a]).tobytes()]
                own.append(t.filler[a:b][slot[a:b]])
            every = np.concatenate(own) if own else np.zeros(0, np.uint64)
            distinct, first, inverse = np.unique(every, return_index=True, return_inverse=True)
            key = (*parts, first[inverse].tobytes())
            c = found.setdefault(key, len(found))
            in_order = every[np.sort(first)]
            if c == len(self.classes):
                self.classes.append(ItemClass(i, {x: k for k, x in enumerate(in_order.tolist())}, [], in_order))
                fillers.append([])
                self.is_first[i] = True
            self.class_of[i] = c
            self.classes[c].ids.append(item_id)
            fillers[c].append(in_order)
        for c, f in zip(self.classes, fillers):
            c.fillers = np.array(f, np.uint64).reshape(len(f), len(c.columns))

    def _hits(self, typings: list[Template]) -> tuple[np.ndarray, ...]:
        """(text, class, typing of the text, of the item, p - q, q, window) where windows of texts and classes are equal."""
        parts = []
        for n, known in self.known.items():
            for v, t in enumerate(typings):
                g = grams.windows(t.token, n)
                at = np.flatnonzero(grams.member(g, known, self.marks[n]))
                text = np.searchsorted(t.firsts, at, "right") - 1
                fits = at + n <= t.firsts[text + 1]
                at, text = at[fits], text[fits]
                if len(at):
                    lo, hi = np.searchsorted(self.hash, g[at], "left"), np.searchsorted(self.hash, g[at], "right")
                    parts.append((np.full(len(at), n), np.full(len(at), v), at, text, t.word[at], lo, hi))
        if not parts:
            return (np.zeros(0, np.int64),) * 7
        n, v, at, text, word, lo, hi = (np.concatenate(x) for x in zip(*parts))
        plain = v + 1 == len(typings)
        # a window that several typings share is looked at once
        order = np.lexsort((v, plain, lo, word, n))
        a, b = order[1:], order[:-1]
        once = np.append(True, (n[a] != n[b]) | (word[a] != word[b]) | (lo[a] != lo[b]) | (plain[a] != plain[b]))
        n, v, at, text, lo, hi, plain = (x[order[once]] for x in (n, v, at, text, lo, hi, plain))
        times = hi - lo
        entry = np.arange(int(times.sum())) + np.repeat(lo - (np.cumsum(times) - times), times)
        n, v, at, text, plain = (np.repeat(x, times) for x in (n, v, at, text, plain))
        u = self.typing[entry]
        same = (self.size[entry] == n) & ((u + 1 == len(self.typings)) == plain)
        return text[same], self.cls[entry][same], v[same], u[same].astype(np.int64), (at - self.at[entry])[same], self.at[entry][same], n[same]

    def matches(self, col: pa.Array, least_words: int, least_share: float) -> dict[int, list[Match]]:
        """By number of text: the classes of items that line up in it."""
        typings = templates(col)
        text, cls, v, u, shift, q, n = self._hits(typings)
        first = np.array([c.item for c in self.classes], np.int64)
        length = np.diff(self.firsts)[first] if len(first) else first
        needed = np.minimum(least_words, least_share * length)
        # what few windows can't reach needs no closer look
        pair, inverse = np.unique(text * max(1, len(first)) + cls, return_inverse=True)
        window = np.unique(np.stack([inverse, u, q, n]), axis=1) if len(pair) else np.zeros((4, 0), np.int64)
        reach = np.bincount(window[0], window[3], len(pair))
        kept = np.flatnonzero((reach >= needed[pair % max(1, len(first))])[inverse]) if len(pair) else inverse
        kept = kept[np.lexsort((q[kept], shift[kept], u[kept], v[kept], inverse[kept]))]
        hits: dict[int, dict[tuple[int, int, int], list[tuple[int, int]]]] = {}
        for k, *group, x, m in zip(*(a[kept].tolist() for a in (inverse, v, u, shift, q, n))):
            hits.setdefault(k, {}).setdefault(tuple(group), []).append((x, m))
        out: dict[int, list[Match]] = {}
        for k, groups in hits.items():
            i, c = divmod(int(pair[k]), len(first))
            one = self.classes[c]
            (words, exact), (other_words, _) = self._best([r for (v_, u_, d), found in groups.items() for r in self._runs(one, typings, v_, u_, d, found)], one)
            if max(words, other_words) < needed[c]:
                continue
            items = one.with_fillers(exact) if words >= needed[c] else np.zeros(0, np.int64)
            is_exact = bool(len(items)) and words >= other_words
            every = other_words >= needed[c]
            least = one.least(items if is_exact else np.arange(len(one.ids)))
            words = max(words, other_words)
            out.setdefault(i, []).append(Match(least, words, words / int(length[c]), is_exact, len(one.ids) if every else len(items)))
        return out

    def _runs(self, one: ItemClass, typings: list[Template], v: int, u: int, shift: int, found: list[tuple[int, int]]) -> list[Run]:
        """Runs of windows at a shift."""
        own, t = self.typings[u], typings[v]
        ranges: list[list[int]] = []
        for q, n in sorted(found):
            if ranges and q <= ranges[-1][1]:
                ranges[-1][1] = max(ranges[-1][1], q + n)
            else:
                ranges.append([q, q + n])
        forth, back, sound = {}, {}, True
        plain = u + 1 == len(self.typings)
        for a, b in ranges:
            if plain:  # words as they are, of some item of the class: the slots of the first one hold those of the text
                base = self.typings[0]
                x, y = np.searchsorted(base.word, a, "left"), np.searchsorted(base.word, b, "right") - 1
                holes = np.flatnonzero(self.slot[0][x:y]) + x
                ours = base.filler[holes].tolist()
                theirs = [_filled(t.token[base.word[h] + shift : base.word[h + 1] + shift]) for h in holes.tolist()]
            else:
                holes = np.flatnonzero(self.slot[u][a:b]) + a
                ours, theirs = own.filler[holes].tolist(), t.filler[holes + shift].tolist()
            sound = sound and all(forth.setdefault(x, y) == y and back.setdefault(y, x) == x for x, y in zip(ours, theirs))
        is_own = sound and bool(len(one.with_fillers(forth)))
        return [Run(int(t.word[a + shift]), int(t.word[b + shift]), int(own.word[a]), int(own.word[b]), forth, back, plain, sound, is_own) for a, b in ranges]

    def _best(self, runs: list[Run], one: ItemClass) -> tuple[tuple[int, dict], tuple[int, dict]]:
        """(most words of the item that a chain of runs lines up, what its fillers stand for): an item's own fillers; any.

        Either all fillers are those of an item of the class, or the slots are consistent; then plain words inside a
        typed run count by that run only, so that they don't hide its contradictions.
        """
        exact = [r for r in runs if r.own]
        typed = [r for r in runs if not r.plain]
        other = [r for r in runs if (r.sound if not r.plain else not any(x.holds(r) for x in typed))]
        best = self._chain(exact, one, True)
        return best, (best if all(r.own for r in other) and len(one.ids) == 1 else self._chain(other, one, False))

    def _chain(self, runs: list[Run], one: ItemClass, own: bool) -> tuple[int, dict]:
        """The best chain: runs follow each other in item and text, at most FURTHEST_SHIFT words off the one before.

        own: together they have the fillers of one item of the class.
        """
        length = int(self.words[one.item + 1] - self.words[one.item])
        runs.sort(key=lambda r: (r.p, r.q))
        chains: list[tuple[int, dict, dict]] = []
        for j, y in enumerate(runs):
            best = (int(self.tokens[y.q_end] - self.tokens[y.q]), y.forth, y.back)
            for i in range(j - 1, -1, -1):
                x = runs[i]
                if y.p - x.p > 2 * (length + FURTHEST_SHIFT):
                    break
                if x.q > y.q or x.q_end >= y.q_end or x.p_end > y.p_end or abs(y.p - y.q - x.p_end + x.q_end) > FURTHEST_SHIFT:
                    continue
                words, forth, back = chains[i]
                words += int(self.tokens[y.q_end] - self.tokens[max(y.q, x.q_end)])
                if words > best[0] and all(forth.get(m, k) == k for m, k in y.forth.items()) and all(back.get(k, m) == m for k, m in y.back.items()):
                    both = forth | y.forth
                    if not own or len(one.ids) == 1 or len(one.with_fillers(both)):
                        best = (words, both, back | y.back)
            chains.append(best)
        words, forth, _ = max(chains, key=lambda c: c[0], default=(0, {}, {}))
        return words, forth


def benchmark_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_ITEM_BYTES):
    """The benchmark as blocks of bounded size, one after the other; items without a word match nothing."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        rows = items.filter(block == k).distinct().collect()  # about block_bytes
        rows.sort(key=lambda r: (r["item_id"] is None, r["item_id"], r["text"]))
        yield Benchmark([r["item_id"] for r in rows], [r["text"] for r in rows])


def contaminated(docs: DataFrame, benchmark: DataFrame, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row a contaminated document: doc_id, item_ids, n_items, n_words (most that line up), share, exact.

    Items that are one template, with fillers equal in the same places, are a class: what lines up with one lines up
    with all. item_ids has one id a class, the least of those with the text's own fillers, or else of the class (see
    item_classes); n_items counts items. share is that of the item of n_words; of items with equal words the greater
    share is taken. exact says whether some item lines up with its own fillers. Documents that match no item have no
    row; null and empty texts match none, and neither do null or wordless items. Rows that share an id (null too) are
    reported together. Whole texts are held against every item.
    """
    seen = id_and_text(docs, id_col, text_col)
    schema = "doc_id long, item_id long, items long, n_words long, share double, exact boolean"
    parts = []
    for block in benchmark_blocks(benchmark, item_id_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def make(shared=shared):
            b = shared.value

            def work(part: pa.RecordBatch) -> dict:
                found = [(i, m) for i, of_text in sorted(b.matches(part.column(1), least_words, least_share).items()) for m in of_text]
                return {
                    "doc_id": part.column(0).take(pa.array([i for i, _ in found], pa.int64())), "item_id": [m.item_id for _, m in found], "items": [m.items for _, m in found],
                    "n_words": [m.words for _, m in found], "share": [m.share for _, m in found], "exact": [m.exact for _, m in found],
                }

            return work

        parts.append(map_rows(seen, make, schema))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    top = lambda: F.max(F.struct("n_words", "share")).alias("top")
    once = every.groupBy("doc_id", "item_id").agg(F.max("items").alias("items"), top(), F.max("exact").alias("exact"))
    ids = F.array_sort(F.collect_list(F.struct("item_id"))).getField("item_id")  # each once, null too
    rows = once.groupBy("doc_id").agg(ids.alias("item_ids"), F.sum("items").alias("n_items"), F.max("top").alias("top"), F.max("exact").alias("exact"))
    return rows.select("doc_id", "item_ids", "n_items", "top.n_words", "top.share", "exact")


def item_classes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, class_id) of all items: class_id is the least id of the items that are one template with it.

    Classes are those of a block of the benchmark: items of different blocks are in different ones.
    """
    spark, out = benchmark.sparkSession, None
    for block in benchmark_blocks(benchmark, id_col, text_col):
        rows = [(i, c.least(np.arange(len(c.ids)))) for c in block.classes for i in c.ids]
        part = spark.createDataFrame(rows, "item_id long, class_id long")
        out = part if out is None else out.unionByName(part)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs without the rows whose text an item contaminates, with all their columns; null and empty texts stay.

    Each row is judged by its own text, whole and however long; repeated rows go or stay together.
    """
    first = True
    for block in benchmark_blocks(benchmark, item_id_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def make(shared=shared):
            b = shared.value

            def work(col: pa.Array) -> list[bool]:
                found = b.matches(col, least_words, least_share)
                return [i in found for i in range(len(col))]

            return work

        hit = by_text(make, "boolean")
        docs = docs if first else stored(docs, "decontaminated")
        docs, first = docs.filter(~hit(F.col(text_col))), False
    return docs
