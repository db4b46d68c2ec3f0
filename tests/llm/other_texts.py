"""Texts of another make than those that the models of secrets and personal data are fitted on."""

ENGLISH = "the of and to in is that it was for on are with as his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


def secret_lines(rng):
    """(text, secret or None) of kinds and wordings that the training sequences don't have."""
    from base64 import b64encode
    from string import ascii_letters, ascii_lowercase, ascii_uppercase, digits

    pick = lambda cs, k: "".join(rng.choice(cs) for _ in range(k))
    prose = lambda k: " ".join(rng.choice(ENGLISH) for _ in range(k))
    secret = [
        ("please use {} to sign in as admin, Authorization: Bearer {}", lambda: pick(ascii_letters + digits, 40)),
        ("{} export GITHUB_PAT=ghp_{}", None), ("{} the bot needs xoxp-{}", None), ("{} stripe key sk_live_{}", None), ("{} gitlab glpat-{}", None),
        ("{} Authorization: Basic {}", lambda: b64encode(pick(ascii_letters, 9).encode() + b":" + pick(ascii_letters + digits, 14).encode()).decode().rstrip("=")),
        ("{} DB_PASS='{}'", lambda: pick(ascii_letters + digits, rng.randint(12, 20))), ("{} smtp pwd: {}", lambda: "".join(rng.choice(ENGLISH).capitalize() for _ in range(4)) + pick(digits, 2)),
        ('{} "credential": "{}"', lambda: pick(ascii_lowercase + digits, 28)), ("{} signature={}", lambda: pick(ascii_letters + digits + "+/", 44)),
        ("{} passphrase: {}", lambda: "-".join(rng.choice([w for w in ENGLISH if len(w) > 3]) for _ in range(4))), ("{} auth: {}", lambda: pick(ascii_uppercase + digits, 32)),
        ("{} clave: {}", lambda: pick(ascii_letters + digits, 14)), ("{} private {}", lambda: "eyJ" + pick(ascii_letters + digits, 33) + ".eyJ" + pick(ascii_letters + digits, 50) + "." + pick(ascii_letters + digits + "-_", 43)),
    ]
    clean = [
        lambda: f"{prose(6)} version {rng.randint(1, 9)}.{rng.randint(0, 40)}.{rng.randint(0, 9)}", lambda: f"{prose(4)} https://www.{rng.choice(ENGLISH)}.org/{rng.choice(ENGLISH)}/{rng.randint(1, 9999)}",
        lambda: f"{prose(5)} on {rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1990, 2030)} at {rng.randint(0, 23)}:{rng.randint(10, 59)}", lambda: f"{prose(3)} self.{rng.choice(ENGLISH)}_{rng.choice(ENGLISH)}(x{rng.randint(0, 9)}) = {rng.choice(ENGLISH)}",
        lambda: f"{prose(4)} order {pick(digits, 9)} for {rng.randint(10, 900)}.{pick(digits, 2)} euros", lambda: f"{prose(4)} {rng.choice(['AB', 'DE', 'XK'])}-{pick(digits, 5)} was {prose(3)}", lambda: f'{prose(3)} said: "{prose(7)}"',
        lambda: f"{prose(5)} the token of {prose(4)}", lambda: f"{prose(3)} pass: {rng.choice(ENGLISH)} the {prose(3)}", lambda: f"{prose(2)} isbn 978-{pick(digits, 1)}-{pick(digits, 4)}-{pick(digits, 4)}-{pick(digits, 1)}", lambda: f"{prose(12)}",
        lambda: f"{prose(2)} well-known {rng.choice(ENGLISH)}-{rng.choice(ENGLISH)} {prose(2)}", lambda: f"{prose(2)} getName{rng.choice(ENGLISH).capitalize()}() {prose(2)}", lambda: f"{prose(3)} phone {pick(digits, 3)}-{pick(digits, 4)}",
    ]
    while True:
        if rng.random() < 0.5:
            yield f"{prose(3)} {rng.choice(clean)()} {prose(4)}", None
            continue
        form, make = rng.choice(secret)
        if make is None:
            lead = form.rsplit(" ", 1)[1].split("=")[-1].replace("{}", "")
            value = lead + pick(ascii_letters + digits, 30)
            text = form.replace(lead + "{}", "{}")
        else:
            value, text = make(), form
        yield f"{prose(3)} {text.format(prose(4), value)} {prose(4)}", value


def personal_lines(rng):
    """(text, personal data or None), worded otherwise than the training examples."""
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    prose = lambda k: " ".join(rng.choice(ENGLISH) for _ in range(k))

    def card():
        body = "4" + d(14)
        total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(body))
        s = body + str(-total % 10)
        return rng.choice(("{} {} {} {}", "{}.{}.{}.{}")).format(*(s[i : i + 4] for i in range(0, 16, 4)))

    def iban():
        body = d(18)
        check = 98 - int(body + "131400") % 97
        s = f"DE{check:02d}{body}"
        return " ".join(s[i : i + 4] for i in range(0, 22, 4))

    good = [
        ("my mobile is {}", lambda: f"({rng.randint(200, 989)}) {rng.randint(200, 999)}-{d(4)}"), ("dial {} after six", lambda: f"{rng.randint(200, 989)}-{rng.randint(200, 999)}-{d(4)}"), ("Tel: {}", lambda: f"0{d(3)} {d(7)}"),
        ("the office, phone {}.", lambda: f"{rng.randint(200, 989)}.{rng.randint(200, 999)}.{d(4)}"), ("pay by visa {} today", card), ("transfer it to {} by May", iban), ("my social security number, {}, is", lambda: f"{rng.randint(100, 665)}-{rng.randint(10, 99)}-{d(4)}"),
        ("mail me: {}", lambda: f"{rng.choice(ENGLISH)}.{rng.choice(ENGLISH)} at {rng.choice(ENGLISH)}{rng.choice(ENGLISH)} dot com"), ("or {} for more", lambda: f"{rng.choice(ENGLISH)}{d(2)} [at] {rng.choice(ENGLISH)} [dot] org"),
        ("the server at {} is down", lambda: ":".join(f"{rng.randrange(65536):x}" for _ in range(8))), ("ping {} now", lambda: f"2001:db8::{rng.randrange(65536):x}:{rng.randrange(65536):x}"),
    ]
    clean = [
        lambda: f"born on {rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1900, 2020)}", lambda: f"a total of {rng.randint(1, 99)},{d(3)},{d(3)} people", lambda: f"chapter {rng.randint(1, 30)}, pages {rng.randint(1, 99)}-{rng.randint(100, 300)}",
        lambda: f"invoice number {d(8)}", lambda: f"from {rng.randint(1900, 1950)} to {rng.randint(1951, 2020)}", lambda: f"release {rng.randint(1, 9)}.{rng.randint(0, 99)}.{d(4)}", lambda: f"at {rng.randint(10, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}",
        lambda: f"ISBN 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", lambda: f"meet at noon, dot the line and {prose(2)}", lambda: f"part {d(3)}-{d(2)}-{d(4)} is sold out", lambda: f"{rng.randint(2, 9)} {rng.randint(10, 99)} {rng.randint(100, 999)}", lambda: f"std::{rng.choice(ENGLISH)}::{rng.choice(ENGLISH)}",
        lambda: prose(9), lambda: f"a ratio of {rng.randint(1, 9)}.{d(6)} or so",
    ]
    while True:
        if rng.random() < 0.5:
            yield f"{prose(4)} {rng.choice(clean)()} {prose(4)}", None
            continue
        form, make = rng.choice(good)
        value = make()
        yield f"{prose(4)} {form.format(value)} {prose(4)}", value
