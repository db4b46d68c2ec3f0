"""Secrets: exact base spans, and further ones tagged by a linear-chain conditional random field.

Tokens are runs of letters, digits and _+/.~-, of a whole text one sequence. Their features (shape, neighbours, and
those of the file) are computed for a block of texts at once in numpy, and so are the best labels, by Viterbi.
The field was fitted on sequences made here from formats of keys and of harmless numbers (fixed seed); its weights
are in fitted.json, and fitted() makes them anew.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.llm.common import id_and_text, map_rows
from weftline.llm.crf import LinearChain
from weftline.llm.fitted import load
from weftline.llm.grams import words_in
from weftline.llm.pii import Span

KINDS = ("assign", "access", "hex", "secret")
BEGIN, INSIDE, OUTSIDE = 0, 1, 2
#: What a token is given for beginning a secret, so that more are found: missing one costs more than a false one.
BOLDNESS = 0.7
#: Bytes whose tokens are treated at once, and those around them that their features may look at.
SEGMENT, CONTEXT = 1 << 20, 4096

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_KEYS = "(?:pass(?:word|wd|phrase)?|pwd|secret|token|api_?key|access_?key|private|bearer|authori[sz]ation|credential|client_?secret|auth|signature|sas|kennwort|passwort|contraseña|clave|mot de passe|clé)".encode()
_GAP = rb"[^A-Za-z0-9_\x80-\xff\0]{0,40}"  # no further than the text
_KEYWORD = re.compile(b"(?:" + _KEYS + b")(" + _GAP + b")")
_OPENS = re.compile(rb"""[:=][ \t]{0,8}["'](?=([^"'\n\0]{0,400}))""")
_NAMED = re.compile(_KEYS + rb"""["']?[ \t]{0,8}$""")
_HARMLESS = re.compile(b"(?:sha|md5|commit|checksum|digest|isbn|doi|version|page|order|id|ref|uuid|figure|price|total|tel|phone|card|invoice|mail|build)(" + _GAP + b")")
_KNOWN = re.compile(rb"(?:sk-|sk_live|pk_live|ghp_|gho_|github_pat|xox[abp]-|AIza|ya29\.|eyJ|glpat-|npm_|SG\.|hf_|AKIA|ASIA)")


def _bytes(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_LOWER, _UPPER, _DIGIT = _bytes("abcdefghijklmnopqrstuvwxyz"), _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _bytes("0123456789")
_MARK, _HEXADECIMAL = _bytes("_+/.~-"), _bytes("0123456789abcdef")
_IN_TOKEN = _LOWER | _UPPER | _DIGIT | _MARK
_KIND = _DIGIT + 2 * _UPPER.astype(np.int8)
_SKIPPED = _bytes(" \t\"'")
_ALPHA = _LOWER | _UPPER
_ALPHA[0x80:] = True


def base_spans(text: str) -> list[Span]:
    """Spans of the three base kinds, by start, then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(0, m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(1, m.start(), m.end()) for m in _ACCESS.finditer(text)]
    out += [(2, m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], s[0]))


_NAMES = (
    "bias", "len<4", "len<8", "len<16", "len<24", "len<40", "len>=40", "entropy<2.5", "entropy<3.3", "entropy<4", "entropy>=4", "upper", "lower", "title", "digits_only",
    "number_shape", "hex", "mixed", "switches<3", "switches<6", "switches>=6", "has_", "has/", "has+", "has-", "dots>1", "known", "left_keyword", "left_harmless", "left_assign",
    "left_quote", "right_quote", "left_word", "right_word", "left_same_shape", "right_same_shape", "left_odd", "right_odd", "code", "many_numbers", "at_sign", "ip_like", "digit", "inner_capital",
    "inner_mark", "left_open", "key=", "key=odd", "key_odd", "open_odd", "plain", "known_long", "mixed_digit_long",
)


def _within(flag: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many of the bytes from starts to ends have the flag."""
    total = np.zeros(len(flag) + 1, np.int32)
    np.cumsum(flag, out=total[1:])
    return total[ends] - total[starts]


def _entropy(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bits a character of each token; that of tokens under six characters is below every threshold and left at 0."""
    out = np.zeros(len(starts))
    some = np.flatnonzero(ends - starts >= 6)
    if not len(some):
        return out
    n = (ends - starts)[some]
    at = np.arange(int(n.sum())) + np.repeat(starts[some] - (np.cumsum(n) - n), n)
    owner = np.repeat(np.arange(len(some)), n)
    cell = np.sort(owner * 128 + buf[at])
    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    count = np.diff(np.append(first, len(cell)))
    which = cell[first] // 128
    out[some] = np.log2(n) - np.bincount(which, count * np.log2(count), len(some)) / n
    return out


def features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, code: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Tokens x names, 0 or 1: of tokens of buf, in turn, which are of the numbered texts."""
    n = ends - starts
    raw = buf.tobytes()
    low = raw.lower()
    digits, upper, lower, marks = (_within(t[buf], starts, ends) for t in (_DIGIT, _UPPER, _LOWER, _MARK))
    kind = _KIND[buf]
    change = np.append(kind[1:] != kind[:-1], False)
    switches = _within(change, starts, np.maximum(ends - 1, starts))
    turn = np.append(_LOWER[buf[:-1]] & _UPPER[buf[1:]], False)
    letter, mark = _LOWER[buf] | _UPPER[buf], _MARK[buf]
    beyond = np.where(mark, len(buf) - 1, np.arange(len(buf)))
    beyond = np.minimum.accumulate(beyond[::-1])[::-1]  # the next byte that is no mark
    inner = np.append(letter[:-1] & mark[1:] & letter[beyond[1:]], False)
    before = np.maximum.accumulate(np.where(_SKIPPED[buf], 0, np.arange(len(buf))))  # the last byte that isn't skipped
    left, right = np.maximum(starts - 1, 0), np.minimum(ends, len(buf) - 1)
    inner_capital, inner_mark = _within(turn, starts, np.maximum(ends - 1, starts)) > 0, _within(inner, starts, np.maximum(ends - 1, starts)) > 0

    def begins_in(ranges: list[tuple[int, int]]) -> np.ndarray:
        """Whether a token begins in one of the ranges, at their ends too; those are in order and don't overlap."""
        if not ranges:
            return np.zeros(len(starts), bool)
        first, last = np.array(ranges, np.int64).T
        at = np.searchsorted(first, starts, "right") - 1
        return (at >= 0) & (starts <= last[at])

    after = lambda pattern: begins_in([m.span(1) for m in pattern.finditer(low)])
    is_open = begins_in([(m.end(), m.end(1) - 1) for m in _OPENS.finditer(low) if _NAMED.search(low, max(0, m.start() - 40), m.start())])
    keyword, assign = after(_KEYWORD), np.isin(buf[before[left]], list(b"=:")) & (starts > 0)
    dots, slashes, plus, minus, under = (_within(buf == c, starts, ends) for c in b"./+-_")
    odd = (digits > 0) | inner_capital | inner_mark | (n > 24)
    same = np.zeros(len(n) + 1, bool)
    if len(n) > 1:
        same[1:-1] = (n[1:] == n[:-1]) & (text[1:] == text[:-1]) & odd[1:] & odd[:-1]
    beside = np.zeros(len(n) + 2, bool)
    beside[1:-1] = odd
    own = np.append(np.append(-1, text), -1)
    entropy = _entropy(buf, starts, ends)
    known = np.isin(starts, np.array([m.start() for m in _KNOWN.finditer(raw)], np.int64))
    flags = {
        "bias": np.ones(len(n), bool), "len<4": n < 4, "len<8": (n >= 4) & (n < 8), "len<16": (n >= 8) & (n < 16), "len<24": (n >= 16) & (n < 24), "len<40": (n >= 24) & (n < 40), "len>=40": n >= 40,
        "entropy<2.5": entropy < 2.5, "entropy<3.3": (entropy >= 2.5) & (entropy < 3.3), "entropy<4": (entropy >= 3.3) & (entropy < 4), "entropy>=4": entropy >= 4,
        "upper": (lower == 0) & (upper > 0), "lower": (upper == 0) & (lower > 0), "title": (upper == 1) & (lower == n - 1) & _UPPER[buf[starts]], "digits_only": digits == n, "number_shape": lower + upper == 0,
        "hex": _within(_HEXADECIMAL[buf], starts, ends) == n, "mixed": (lower > 0) & (upper > 0), "switches<3": switches < 3, "switches<6": (switches >= 3) & (switches < 6), "switches>=6": switches >= 6,
        "has_": under > 0, "has/": slashes > 0, "has+": plus > 0, "has-": minus > 0, "dots>1": dots > 1, "known": known, "left_keyword": keyword, "left_harmless": after(_HARMLESS), "left_assign": assign,
        "left_quote": np.isin(buf[left], list(b"\"'")) & (starts > 0), "right_quote": np.isin(buf[right], list(b"\"'")) & (ends < len(buf)),
        "left_word": _ALPHA[buf[np.maximum(starts - 2, 0)]] & (starts > 1) & (buf[left] > 0), "right_word": _ALPHA[buf[np.minimum(ends + 1, len(buf) - 1)]] & (ends + 1 < len(buf)) & (buf[right] > 0),
        "left_same_shape": same[:-1], "right_same_shape": same[1:], "left_odd": beside[:-2] & (own[:-2] == text), "right_odd": beside[2:] & (own[2:] == text), "code": code[text], "many_numbers": many[text],
        "at_sign": ((buf[left] == 64) & (starts > 0)) | ((buf[right] == 64) & (ends < len(buf))), "ip_like": (dots == 3) & (digits == n - 3), "digit": digits > 0, "inner_capital": inner_capital, "inner_mark": inner_mark,
        "left_open": is_open, "key=": keyword & assign, "key=odd": keyword & assign & odd, "key_odd": keyword & odd, "open_odd": is_open & odd, "plain": ~odd & (marks == 0),
        "known_long": known & (n >= 16), "mixed_digit_long": (lower > 0) & (upper > 0) & (digits > 0) & (n >= 20) & (slashes == 0),
    }
    return np.stack([flags[k] for k in _NAMES], 1)


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 of the texts with a zero byte after each, where each begins and the last ends)."""
    parts = [t.encode("utf-8") for t in texts]
    return np.frombuffer(b"".join(x for p in parts for x in (p, b"\0")), np.uint8), np.cumsum([0, *(len(p) + 1 for p in parts)])


def tokens(texts: list[str], weights: np.ndarray | None = None):
    """(buffer, offsets, starts, ends, text of each token, features or, with weights, emissions by label)."""
    buf, offsets = joined(texts)
    inside = _IN_TOKEN[buf]
    starts, ends, firsts = words_in(inside, offsets)
    text = np.repeat(np.arange(len(texts)), np.diff(firsts))
    code = np.array(["{" in t and ";" in t for t in texts], bool)
    numbers = np.append(True, ~_DIGIT[buf[:-1]]) & _DIGIT[buf] if len(buf) else np.zeros(0, bool)
    many = (np.add.reduceat(numbers, offsets[:-1], dtype=np.int64) if len(texts) else np.zeros(0, np.int64)) * 400 > np.diff(offsets) + 2000
    out, i = [], 0
    while i < len(starts):  # tokens that begin within a segment, with what is around them
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + SEGMENT)))
        a, b = max(0, int(starts[i]) - CONTEXT), min(len(buf), int(ends[j - 1]) + CONTEXT)
        lo, hi = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b)
        lo, hi = min(int(lo), i), max(int(hi), j)
        a, b = min(a, int(starts[lo])), max(b, int(ends[hi - 1]))
        f = features(buf[a:b], starts[lo:hi] - a, ends[lo:hi] - a, text[lo:hi], code, many)[i - lo : j - lo]
        out.append(f if weights is None else f.astype(np.float32) @ weights.astype(np.float32))
        i = j
    width = len(_NAMES) if weights is None else weights.shape[1]
    return buf, offsets, starts, ends, text, np.concatenate(out) if out else np.zeros((0, width), bool if weights is None else np.float32)


def _sequences(n: int, seed: int):
    """Made-up texts with the spans of their secrets, token by token."""
    r = random.Random(seed)
    pick = lambda cs, k: "".join(r.choice(cs) for _ in range(k))
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda: "".join(r.choice(("an", "er", "th", "ion", "de", "la", "on", "que", "ung")) for _ in range(r.randint(1, 4)))
    keys = (
        lambda: "ghp_" + pick(low + up + num, 36), lambda: "sk-" + pick(low + up + num, 32), lambda: "AIza" + pick(low + up + num + "-_", 35),
        lambda: "eyJ" + pick(low + up + num, 17) + ".eyJ" + pick(low + up + num, 30) + "." + pick(low + up + num + "-_", 43),
        lambda: pick(low + up + num + "+/", r.choice((32, 40, 44, 64))), lambda: "xoxb-" + pick(num, 12) + "-" + pick(low + up + num, 24), lambda: pick(low + num, r.choice((24, 32, 36))),
        *[lambda: r.choice(("ghp_", "gho_", "sk_live_", "pk_live_", "xoxp-", "glpat-", "npm_", "hf_", "SG.", "ya29.", "github_pat_")) + pick(low + up + num, r.randint(20, 40))] * 4, lambda: pick(up + num, r.choice((20, 28, 32))),
    )
    weak = (lambda: pick(low + num, r.randint(8, 12)) + pick(num, 2), lambda: word() + pick(num, 3) + pick(up, 2))
    fine = (
        lambda: pick(num, r.randint(1, 8)), lambda: f"{pick(num, 2)}.{pick(num, 2)}.{pick(num, 4)}", lambda: ".".join(str(r.randint(1, 255)) for _ in range(4)), lambda: pick(num, 16),
        lambda: word() + "." + pick(num, 2), lambda: "mail" + pick(num, 1) + ".example.com", lambda: word() + pick(num, 1), lambda: f"v{pick(num, 1)}.{pick(num, 2)}.{pick(num, 1)}",
        lambda: f"{pick(num, 4)}-{pick(num, 2)}-{pick(num, 2)}", lambda: pick(up, 2) + pick(num, 6), lambda: f"/{word()}/{word()}/{pick(num, 4)}/{word()}.html", lambda: f"{word()}-{word()}-{pick(num, 2)}-{word()}-{word()}",
        lambda: pick(num, 3) + "-" + pick(num, 4), lambda: f"{word()}_{word()}_{word()}_{word()}_{word()}", lambda: "-".join((pick("0123456789abcdef", 8), *(pick("0123456789abcdef", 4) for _ in range(3)), pick("0123456789abcdef", 12))),
    )
    letters = (lambda: pick(low + up, r.randint(8, 24)), lambda: word() + "".join(word().capitalize() for _ in range(r.randint(1, 3))), lambda: "-".join(word() for _ in range(r.randint(3, 5))), lambda: pick(low, r.randint(10, 20)), lambda: r.choice("_.~").join(word() for _ in range(r.randint(3, 4))))
    def quoted_prose() -> str:
        mark = r.choice("\"'")
        return r.choice(("title: ", "name = ", "text: ", "x=", f"{word()}: ", f"{word()} = ")) + mark + " ".join(word()[: r.choice((2, 3, 4, 20))] for _ in range(r.randint(1, 9))) + mark

    prose = (
        *[quoted_prose] * 4,
        lambda: word() + "-" + word(), lambda: word() + word().capitalize() + word().capitalize(), lambda: f"/{word()}/{word()}", lambda: f"www.{word()}.com", lambda: pick(up, r.randint(2, 5)),
        lambda: f"{word()}.{word()}", lambda: f'{word()}: "{word()} {word()} {word()}"', lambda: f"name = '{word()}'", lambda: f"{r.choice(('secret', 'token', 'password', 'clave'))}: {word()} {word()}", lambda: f"{word()}_{word()}", lambda: f"{word()}-{word()}-{word()}",
        lambda: f"{r.choice(('token', 'auth', 'bearer'))} {word()}", lambda: f'note: "{word()} {word()}! {word()}" {word()}-{word()}!! {word()}-{word()}'.upper(),
    )
    for _ in range(n):
        text, spans = "", []
        code = r.random() < 0.3
        for _ in range(r.randint(2, 5)):
            text += " ".join(word() for _ in range(r.randint(1, 4))) + " "
            x = r.random()
            if x < 0.08:  # secrets without a digit, of one word and of several
                text += r.choice(("passphrase = '", "passphrase: ", "passphrase=", 'pwd = "', "pwd: ", "pass: '", "Authorization: Bearer ", 'credential = "', "kennwort: ", "auth='", "clave: ", "DB_PASS='", "my_pwd=", "private key: "))
                quoted = text[-1] in "\"'"
                parts = [word() for _ in range(r.randint(3, 6))] if quoted and r.random() < 0.4 else [r.choice(letters)()]
                for k, s in enumerate(parts):
                    text += " " * (k > 0)
                    spans.append((len(text), len(text) + len(s), not k))
                    text += s
                text += text[spans[-len(parts)][0] - 1] if quoted else ""
            elif x < 0.2:
                text += r.choice(prose)()
            elif x < 0.42:
                text += r.choice(("", "", "", "", f"{word()} key ", f"{word().upper()}_{word().upper()}=", "key: ", "auth: ", "signature=", "Authorization: Basic ", "Authorization: Bearer ", 'credential = "', "auth=", "private ", "export SAS='", "clave: "))
                s = r.choice(keys)()
                spans.append((len(text), len(text) + len(s), True))
                text += s + r.choice(("", '"', "'", ";"))
            elif x < 0.5:
                text += r.choice(("pwd: ", "passphrase = '", 'pass="', "pwd=", "contraseña: ", "kennwort: "))
                s = r.choice(weak)()
                spans.append((len(text), len(text) + len(s), True))
                text += s + r.choice(("", "'", '"'))
            elif x < 0.55:
                text += r.choice(("private key: ", "recovery token: ", "secret: "))
                size = r.choice((8, 10, 12))
                for k in range(r.randint(3, 5)):
                    s = pick(up + num, size - 1) + pick(num, 1)
                    spans.append((len(text), len(text) + len(s), not k))
                    text += s + " "
            else:
                text += r.choice(("", "order ", "page ", "id: ", "version ", "commit ", "tel ", "uuid ")) + " ".join(r.choice(fine)() for _ in range(r.randint(1, 3)))
            text += r.choice((" ", ". ", ", ", "\n"))
        yield ("{ " + text + "; }" if code else text), [(a + 2 * code, b + 2 * code, f) for a, b, f in spans]


def tagged(n: int = 2000, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Training sequences: features, labels and lengths of the tokens of made-up texts."""
    made = list(_sequences(n, seed))
    _, offsets, starts, ends, text, x = tokens([t for t, _ in made])
    lengths = np.bincount(text, minlength=n)
    features_, labels = np.zeros((n, int(lengths.max()), len(_NAMES)), np.float32), np.full((n, int(lengths.max())), OUTSIDE)
    at = np.arange(len(text)) - (np.cumsum(lengths) - lengths)[text]
    features_[text, at] = x
    for i, (_, spans) in enumerate(made):
        for k in np.flatnonzero(text == i).tolist():
            a, b = starts[k] - offsets[i], ends[k] - offsets[i]
            for x0, y0, begins in spans:  # made-up texts are short, and of ASCII where secrets are
                if x0 <= a and b <= y0:
                    labels[i, at[k]] = BEGIN if begins and a == x0 else INSIDE
    return features_, labels, lengths


def fitted() -> dict:
    """The field's weights, fitted anew on made-up sequences."""
    field = LinearChain(len(_NAMES), 3).fit(*tagged(), edge_label=OUTSIDE)
    return {"names": list(_NAMES), "emit": np.round(field.emit, 4).tolist(), "move": np.round(field.move, 4).tolist()}


@lru_cache(1)
def model() -> LinearChain:
    """The field with the weights that are kept in fitted.json."""
    kept = load("secrets")
    field = LinearChain(len(_NAMES), 3)
    field.emit, field.move = np.array(kept["emit"]), np.array(kept["move"])
    field.emit[_NAMES.index("bias"), BEGIN] += BOLDNESS
    return field


def labels_of(emissions: np.ndarray, text: np.ndarray, field: LinearChain) -> np.ndarray:
    """The best labels of the tokens of each text; all texts of a block are one sequence, parted by outside tokens."""
    at = np.arange(len(text)) + text + 1  # a token before each text, and those of the texts before
    whole = np.full((int(text[-1]) + 2 + len(text), emissions.shape[1]), -1e9) if len(text) else np.zeros((0, emissions.shape[1]))
    whole[:, OUTSIDE] = 0
    whole[at] = emissions
    return field.best(whole, OUTSIDE)[at]


def spans_of(texts: list[str], field: LinearChain) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text: base ones stay; the field's secrets that overlap none of them are added."""
    buf, offsets, starts, ends, text, emissions = tokens(texts, field.emit)
    added: list[list[Span]] = [[] for _ in texts]
    label = labels_of(emissions, text, field)
    points: np.ndarray | None = None
    if (label != OUTSIDE).any():
        # code points up to each byte
        points = np.cumsum(buf & 0xC0 != 0x80) - (buf & 0xC0 != 0x80)
    held = -2
    for k in np.flatnonzero(label != OUTSIDE).tolist():
        i = int(text[k])
        a, b = (int(points[x] - points[offsets[i]]) for x in (starts[k], ends[k]))
        if label[k] == INSIDE and held == k - 1 and text[k - 1] == i:
            added[i][-1] = (3, added[i][-1][1], b)
        else:
            added[i].append((3, a, b))
        held = k
    out = []
    for t, more in zip(texts, added):
        base = base_spans(t)
        if base and more:
            begin, top = [s[1] for s in base], 0
            reach = [top := max(top, s[2]) for s in base]
            keep = lambda a, b: (i := bisect.bisect_left(begin, b)) == 0 or reach[i - 1] <= a
            more = [s for s in more if keep(s[1], s[2])]
        out.append((base, sorted(base + more, key=lambda s: (s[1], s[0])) if more else base))
    return out


def spans(text: str, field: LinearChain) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of one text."""
    return spans_of([text], field)[0]


def render(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in found)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_assign, n_access, n_hex (base spans), base_sha256, spans (all), n_added.

    A null or empty text has no spans; base_sha256 is then that of the empty string. Offsets are code points.
    Repeated rows and null ids keep a row each; other columns aren't read. One pass over whole texts, no shuffle.
    """
    field = model()

    def make():
        def work(part: pa.RecordBatch) -> dict:
            names = ("n_assign", "n_access", "n_hex")
            out: dict[str, list] = {k: [] for k in (*names, "base_sha256", "spans", "n_added")}
            for base, every in spans_of(part.column(1).to_pylist(), field):
                for k, n in enumerate(names):
                    out[n].append(sum(s[0] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(render(base).encode()).hexdigest())
                out["spans"].append(render(every))
                out["n_added"].append(len(every) - len(base))
            return out | {"doc_id": part.column(0)}

        return work

    return map_rows(id_and_text(docs, id_col, text_col), make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long")
