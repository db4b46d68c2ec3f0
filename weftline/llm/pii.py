"""Personal data: exact base spans, and further ones that boosted trees select among generated candidates.

Generators of high recall propose spans, which may overlap: national phone numbers, card-like numbers, addresses
written with "at" and "dot", IPv6 addresses, IBANs and hyphenated identity numbers. Trees score each by its
format and its context; a calibrated threshold selects. The trees are fitted on examples made here from format
templates and context words (N_EXAMPLES, fixed seed): the corpus has no labels of that kind.
"""

from __future__ import annotations

import hashlib
import ipaddress
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.boosting import Boosted, fit
from weftline.llm.common import by_text, id_and_text, map_rows
from weftline.llm.fitted import load

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = KINDS[:4]
N_EXAMPLES = 12_000
#: Calibrated probability from which a candidate is redacted.
THRESHOLD = 0.9

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a number's digits are all taken or none: a match that would begin inside a run of digits fails as its run does
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[int, int, int]  # kind, start, end


_TWICE = dict(zip("0123456789", (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)))
_NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    return (sum(map(int, digits[::-2])) + sum(map(_TWICE.__getitem__, digits[-2::-2]))) % 10 == 0


def only_digits(s: str) -> str:
    return _NO_DIGIT.sub("", s)


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each @ outwards, in time linear in the text."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            end = m.end()
            out.append((a, end))
        elif a < at:
            end = max(end, at)  # what is left of a failing @ can't be part of a later address
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the four base kinds, by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p := q.lstrip("0")) <= 3 and int(p or 0) <= 255 for q in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        d = only_digits(m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(only_digits(m.group())) <= 15:
                out.append((3, m.start(), m.end()))
    return out


_GENERATORS = (
    (3, re.compile(r"(?<![0-9A-Za-z.+-])(?:\+[0-9]{1,3}[ -]?)?\(?[0-9][0-9 ().\-/]{5,22}[0-9](?![0-9A-Za-z])")),
    (2, re.compile(r"(?<![0-9A-Za-z.+-])[0-9](?:[ .-]?[0-9]){12,18}(?![0-9A-Za-z])")),
    (4, re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")),
    (5, re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")),
    (1, re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?!\.?[0-9A-Za-z]|:)")),
)
_DIGITS = re.compile(r"[0-9]+")
#: Groups of digits that what is between them may join to one number.
_RUN = re.compile(r"[0-9]+(?:[ ().\-/+]{1,4}[0-9]+)*")
_COUNTRY = re.compile(r"\+[0-9]{1,3}[ (.-]*$")
_SHORT_IPV6 = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f:]*::[0-9A-Fa-f:]*(?!\.?[0-9A-Za-z])")
_IBAN_RUN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{1,4}){3,8}")
#: Longest formats: digits, groups and characters of a phone number, digits of a card.
PHONE_DIGITS, PHONE_GROUPS, PHONE_CHARS, CARD_DIGITS = 15, 8, 30, 19
#: Candidates whose features are held at once.
SCORED = 4096
_SPELT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z0-9-]{2,63}){1,4}(?![A-Za-z0-9])")
_HINTS = (
    re.compile(r"phone|tel[.:é]|\btel\b|call|mobil|fax|handy|móvil|telef|portable|number is|ring"),
    re.compile(r"card|visa|master|carte|tarjeta|karte|credit|pay"),
    re.compile(r"mail|contact|write|reach|correo|courriel|kontakt|adresse"),
    re.compile(r"iban|bank|konto|account|compte|cuenta|transfer"),
    re.compile(r"ssn|social|security|passport|identity|\bid\b|ausweis|tax"),
    re.compile(r"\bip\b|host|server|address|ping|ipv6"),
    re.compile(r"order|isbn|version|invoice|page|ref|serial|part|model|total|price|eur|usd|\$|€|date|year|build|case|item|sku|time"),
)


def _numbers(text: str) -> list[Span]:
    """Phone- and card-like spans from every start and to every end at the groups of each run of digits."""
    out = []
    for m in _RUN.finditer(text):
        if m.end() - m.start() < 7:
            continue
        groups = [g.span() for g in _DIGITS.finditer(text, m.start(), m.end())]
        for i, (a, _) in enumerate(groups):
            if text[a - 1 : a].isalnum():
                continue
            n, card = 0, ""
            for k in range(i, len(groups)):
                b = groups[k][1]
                n += b - groups[k][0]
                single = k == i or (groups[k][0] - groups[k - 1][1] == 1 and text[groups[k][0] - 1] in " .-")
                card = card + text[groups[k][0] : b] if single and card is not None else None
                phone = n <= PHONE_DIGITS and k - i < PHONE_GROUPS and b - a <= PHONE_CHARS
                if not phone and (card is None or n > CARD_DIGITS):
                    break
                if n < 7 or text[b : b + 1].isalnum():
                    continue
                if phone:
                    start = a
                    while start and text[start - 1] in "+(" and a - start < 2:
                        start -= 1
                    if text.count("(", start, b) > text.count(")", start, b):
                        start = a - (text[a - 1 : a] == "+")
                    out.append((3, start, b))
                if card is not None and 13 <= n <= CARD_DIGITS and luhn(card):
                    out.append((2, a, b))
    return out


def _is_ipv6(s: str) -> bool:
    try:
        ipaddress.IPv6Address(s)
    except ValueError:
        return False
    return len(s) > 2


def candidates(text: str, digits: bool) -> list[Span]:
    out = []
    if digits:
        for kind, pattern in _GENERATORS:
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
        out += _numbers(text)
        for m in _IBAN_RUN.finditer(text):
            ends = (b for b in range(m.start() + 15, m.end() + 1) if not text[b : b + 1].isalnum() and text[b - 1] != " ")
            out += [(4, m.start(), b) for b in ends if _mod97(text[m.start() : b])]
    if "::" in text:
        for m in _SHORT_IPV6.finditer(text):
            a, b = m.span()
            # a colon of the sentence may follow
            b -= text[b - 1] == ":" and text[b - 2] != ":"
            if b - a <= 39 and _is_ipv6(text[a:b]):
                out.append((1, a, b))
    if " dot " in text or "dot)" in text or "dot]" in text:
        out += [(0, m.start(), m.end()) for m in _SPELT.finditer(text)]
    return list(dict.fromkeys(out))


def _mod97(s: str) -> bool:
    s = s.replace(" ", "")
    s = s[4:] + s[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1 if s.isascii() and s.isalnum() else False


_YEAR = re.compile(r"(?:19|20)[0-9]{2}.*|.*[ ./-](?:19|20)[0-9]{2}").fullmatch
_DATE = re.compile(r"[0-9]{1,4}([./-])[0-9]{1,2}\1[0-9]{1,4}").fullmatch
_NATIONAL = re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}").fullmatch


def features(text: str, span: Span) -> list[float]:
    kind, a, b = span
    s = text[a:b]
    groups = _DIGITS.findall(s)
    d = "".join(groups)
    left = text[max(0, a - 32) : a].lower()
    right = text[b : b + 16].lower()
    around = [float(bool(h.search(left))) for h in _HINTS]
    return [
        *(float(kind == k) for k in range(len(KINDS))),
        len(s), len(d), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        s.count(" "), s.count("-"), s.count("."), s.count("/"), float("(" in s), float(s[:1] == "0"),
        len(set(d)), float(luhn(d)) if d else 0.0, float(kind == 4 and _mod97(s)),
        float(_YEAR(s) is not None),
        float(_DATE(s) is not None),
        float(_NATIONAL(s) is not None),
        float(text[max(0, a - 4) : a].rstrip(" ().-/+")[-1:].isdigit()), float(right[:4].lstrip(" ().-/+")[:1].isdigit()),
        float(text[max(0, a - 1) : a] in tuple("-./+")), float(right[:1] in tuple("-./") and right[1:2].isdigit()), float("::" in s), float(s[:1] == "+"), float(bool(_COUNTRY.search(left))), float(s.count(")") > s.count("(")),
        float(text[a - 1 : a] in ("$", "€", "£", "#")), float(right[:1] in ("%", "€", "$")), float(bool(right[:6].strip().startswith(("kg", "km", "eur", "usd", "mm", "ms")))),
        *around,
    ]


def examples(n: int = N_EXAMPLES, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of candidates in made-up sentences, shuffled."""
    r = random.Random(seed)
    digit = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(("an", "er", "th", "ion", "de", "la", "on", "que", "ung", "os")) for _ in range(r.randint(1, 4)))

    def card(ok: bool) -> str:
        body = r.choice("3456") + digit(r.choice((13, 14, 14, 14)))
        check = next(c for c in "0123456789" if luhn(body + c) == ok)
        s = body + check
        return s if r.random() < 0.5 else r.choice(" -").join(s[i : i + 4] for i in range(0, len(s), 4))

    def iban(ok: bool) -> str:
        country, body = r.choice(("DE", "FR", "ES", "GB", "IT")), digit(r.choice((16, 18, 20)))
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        s = country + f"{check if ok else (check + 7) % 97:02d}" + body
        return s if r.random() < 0.5 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))

    def short_host() -> str:
        x = lambda k: ":".join("".join(r.choice("0123456789abcdef") for _ in range(r.choice((1, 2, 4, 4)))) for _ in range(k))
        return r.choice(("2001:db8:", "fe80:", "fd00:", "", x(2) + ":", x(3) + ":")) + ":" + x(r.randint(1, 4))

    hosts = lambda: ":".join("".join(r.choice("0123456789abcdef") for _ in range(r.randint(1, 4))) for _ in range(8))
    good = (
        (lambda: r.choice(("", "", "+1 ", "+49 ")) + f"({digit(3)}) {digit(3)}-{digit(4)}", ("phone", "tel.", "call", "mobile", "Telefon", "téléphone", "teléfono", "", "fax")),
        (lambda: r.choice("-. ").join((digit(3), digit(3), digit(4))), ("phone:", "tel", "call me at", "Handy", "móvil", "fax")),
        (lambda: "0" + digit(r.choice((2, 3))) + r.choice(" /-") + digit(r.choice((6, 7, 8))), ("Tel.:", "phone", "Telefon", "fax", "mobil", "call")),
        (lambda: card(True), ("card", "visa", "credit card number", "carte", "tarjeta", "Karte")),
        (lambda: f"{word()}{r.choice(' [ (')}at{r.choice(' ])')}".replace(" at", " at ").replace("at]", "at]") + f"{word()} dot {r.choice(('com', 'org', 'de', 'fr'))}", ("mail", "contact", "write to", "reach me:", "correo")),
        (lambda: f"{word()} (at) {word()} (dot) {r.choice(('com', 'org', 'de'))}", ("mail", "", "contact", "write")),
        (lambda: "{}{} {} {} {} {}".format(word(), digit(r.choice((0, 0, 2, 4))), *r.choice((("[at]", word(), "[dot]"), ("(at)", word(), "(dot)"))), r.choice(("com", "org", "net", "es"))), ("mail", "", "or", "and", "contact", "reach")),
        (lambda: iban(True), ("IBAN", "bank", "Konto", "account", "compte", "", "to", "transfer it to", "from", "please use")),
        (lambda: f"{r.choice('12345678')}{digit(2)}-{digit(2)}-{digit(4)}", ("SSN", "social security", "identity", "tax id", "social security number,", "ssn:", "social security no.", "identity number is")),
        (hosts, ("ip", "host", "server", "address", "", "ipv6", "server at", "from", "to")),
        (short_host, ("ip", "host", "", "address", "", "", "ping")),
    )
    bad = (
        (lambda: f"{digit(2)}.{digit(2)}.{r.choice(('19', '20'))}{digit(2)}", ("", "date", "on", "Datum", "order")),
        (lambda: f"{r.choice(('19', '20'))}{digit(2)}-{digit(2)}-{digit(2)}", ("", "date", "on", "version", "since")),
        (lambda: f"{r.choice(('19', '20'))}{digit(2)}-{r.choice(('19', '20'))}{digit(2)}", ("", "years", "in", "from")),
        (lambda: f"{digit(3)} {digit(3)} {digit(3)}", ("total", "price", "population", "", "about")),
        (lambda: f"{digit(1)}.{digit(3)}.{digit(3)}", ("total", "price EUR", "", "version")),
        (lambda: digit(r.choice((7, 8, 9, 10, 12))), ("order", "ref", "invoice", "", "serial", "item", "case")),
        (lambda: digit(r.choice((13, 14, 15, 16, 18))), ("order", "ref", "", "serial", "time", "part", "build")),
        (lambda: card(False), ("ref", "", "order", "serial")),
        (lambda: f"978-{digit(1)}-{digit(4)}-{digit(4)}-{digit(1)}", ("ISBN", "", "book")),
        (lambda: f"{digit(1)}.{digit(2)}.{digit(4)}", ("version", "build", "", "release")),
        (lambda: iban(False), ("ref", "part", "", "serial", "model")),
        (lambda: f"{digit(3)}-{digit(2)}-{digit(4)}", ("part", "model", "sku", "order", "serial")),
        (lambda: ":".join(digit(2) for _ in range(r.randint(4, 6))), ("time", "", "at", "score")),
        (lambda: " ".join(digit(r.randint(1, 3)) for _ in range(r.randint(4, 7))), ("", "numbers", "row", "page")),
        (lambda: f"{r.choice(('a', 'b', 'add', 'dec', 'fade'))}::{r.choice(('c', 'add', 'bad', 'face', 'de'))}", ("call", "", "use", "class", "function")),
        (lambda: f"{word()} at {word()} dot {word()}", ("look", "the", "stop", "", "a")),
    )
    x, y, texts = [], [], 0
    while len(x) < n or texts < n // 2:  # a text of numbers has many candidates
        texts += 1
        label = r.random() < 0.5
        make, hints = r.choice(good if label else bad)
        before = " ".join(word() for _ in range(r.randint(1, 5)))
        head = f"{before} {r.choice(hints)} ".replace("  ", " ")
        values = [make()]
        listed = r.random() < 0.6 and values[0][:1] in tuple("(+0123456789")
        if listed:  # lists of numbers, and numbers before and after that belong to none
            values += [make() for _ in range(r.randint(0, 2))]
            if r.random() < 0.5:
                head += r.choice(("room ", "", "no. ", "apt ", "x ")) + digit(r.choice((1, 1, 2, 2, 3))) + " "
        text, true = head, set()
        for k, value in enumerate(values):
            text += r.choice((" ", ", ", " / ", " or ", "; ")) if k else ""
            true.add((len(text), len(text) + len(value)))
            text += value
        text += f"{r.choice(('', ',', '.', ''))} " + (digit(r.choice((1, 2, 3))) + " " if listed and r.random() < 0.3 else "") + " ".join(word() for _ in range(3))
        for span in candidates(text, True):
            x.append(features(text, span))
            y.append(label and span[1:] in true)
    order = list(range(len(x)))
    r.shuffle(order)
    return np.array(x)[order], np.array(y)[order]


def fitted() -> dict:
    """The trees, fitted anew on made-up examples."""
    return {k: np.round(v, 6).tolist() if isinstance(v, np.ndarray) else v for k, v in vars(fit(*examples())).items()}


@lru_cache(1)
def model() -> Boosted:
    """The trees that are kept in fitted.json."""
    kept = load("pii")
    return Boosted(kept["base"], np.array(kept["feature"], np.int64), *(np.array(kept[k], float) for k in ("threshold", "leaf", "steps_at", "steps_to")))


def spans(text: str, trees: Boosted, threshold: float = THRESHOLD) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans): base ones stay; of the selected candidates, those that overlap none better."""
    digits = any(map(text.__contains__, "0123456789"))
    if not digits and "@" not in text and "dot" not in text and "::" not in text:
        return [], []
    base = base_spans(text) if digits or "@" in text else []
    found = candidates(text, digits)
    if not found:
        return base, base
    taken = bytearray(len(text))
    for _, a, b in base:
        taken[a:b] = b"\1" * (b - a)
    free = [c for c in found if taken.find(1, c[1], c[2]) < 0]
    good: list[tuple[float, Span]] = []
    for k in range(0, len(free), SCORED):
        part = free[k : k + SCORED]
        p = trees.probabilities(np.array([features(text, c) for c in part]))
        good += [(p[j], part[j]) for j in np.flatnonzero(p >= threshold).tolist()]
    added: list[Span] = []
    for _, c in sorted(good, key=lambda g: (-g[0], g[1][1], -g[1][2], g[1][0])):
        if taken.find(1, c[1], c[2]) < 0:
            added.append(c)
            taken[c[1] : c[2]] = b"\1" * (c[2] - c[1])
    return base, sorted(base + added)


def render(found: list[Span], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for k, a, b in found)


def redact(text: str, found: list[Span]) -> str:
    """The text with each span replaced by its kind; overlapping spans are replaced together."""
    out, end = [], 0
    merged: list[list[int]] = []
    for k, a, b in sorted(found, key=lambda s: (s[1], s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([k, a, b])
    for k, a, b in merged:
        out += [text[end:a], f"[{KINDS[k].upper()}]"]
        end = b
    return "".join(out) + text[end:]


def find_pii(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row a document: doc_id, counts of base spans, base_sha256, spans (all of them), n_added, n_spans.

    A null or empty text has no spans; base_sha256 is then that of the empty string. Offsets are code points.
    Repeated rows and null ids keep a row each; other columns aren't read. with_text adds the redacted text. One
    pass over whole texts, no shuffle; the trees are the same small arrays for every task.
    """
    trees = model()
    names = ["n_email", "n_ip", "n_card", "n_phone"]

    def make():
        none = hashlib.sha256(b"").hexdigest()

        def work(part: pa.RecordBatch) -> dict:
            out: dict[str, list] = {k: [] for k in (*names, "base_sha256", "spans", "n_added", "n_spans", "redacted")}
            for text in part.column(1).to_pylist():
                base, every = spans(text, trees, threshold)
                if base:
                    for k, n in enumerate(names):
                        out[n].append(sum(s[0] == k for s in base))
                    out["base_sha256"].append(hashlib.sha256(render(base).encode()).hexdigest())
                else:
                    for n in names:
                        out[n].append(0)
                    out["base_sha256"].append(none)
                out["spans"].append(render(every))
                out["n_added"].append(len(every) - len(base))
                out["n_spans"].append(len(every))
                if with_text:
                    out["redacted"].append(redact(text, every) if every else text)
            return out | {"doc_id": part.column(0)}

        return work

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"
    return map_rows(id_and_text(docs, id_col, text_col), make, schema + ", redacted string" * with_text)


def redacted(docs: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """docs with every span of text_col replaced; null texts stay null, other columns and rows stay as they are.

    Only the text goes through Python, a column function: no join, no shuffle.
    """
    trees = model()

    def make():
        def work(col: pa.Array) -> list[str]:
            return [redact(t, found) if (found := spans(t, trees, threshold)[1]) else t for t in col.to_pylist()]

        return work

    clean = by_text(make, "string")
    return docs.withColumn(text_col, F.when(F.col(text_col).isNotNull(), clean(F.col(text_col))))
