"""How often the novelty scan reports ordinary strings, and misses random keys, near sensitive words: fixed sets of each."""

import random
import string
import uuid

import pytest

from hearthline.llm import secrets

PROSE = "the river runs to the sea and people who live on it wait for the boats that come in over the tide in the early spring of the year "
CODE = "def load(path, config=None):\n    for name, value in config.items():\n        if value is None: continue\n        setattr(self, name, value)\n    return self.path "


@pytest.fixture(scope="module")
def scanner():
    return secrets.Scanner(secrets.Novelty(), secrets.identifier_dictionary())


def ordinary(rng):
    r, words = rng.randrange, "server module river house parser build linux alpha report season volume chapter station garden letter".split()
    digits = lambda n: "".join(rng.choice(string.digits) for _ in range(n))
    makers = (
        lambda: f"{r(1, 13)}/{r(1, 29)}/{r(1900, 2030)}", lambda: f"{r(1990, 2030)}-{r(1, 13):02}-{r(1, 29):02}", lambda: f"{r(1990, 2030)}-{r(1, 13):02}-{r(1, 29):02}T{r(24):02}-{r(60):02}-{r(60):02}Z",
        lambda: f"{(a := r(1500, 2020))}-{a + r(1, 40)}", lambda: f"978-{r(10)}-{r(10, 99)}-{digits(6)}-{r(10)}", lambda: f"+{r(1, 99)}-{r(10, 999)}-{digits(7)}", lambda: f"{r(100, 999)}-{r(100, 999)}-{digits(4)}",
        lambda: f"{rng.choice(('EN-ISO', 'ISO', 'DIN-EN', 'IEEE', 'RFC', 'BS-EN'))}-{r(100, 30000)}-{r(1980, 2025)}", lambda: f"UTF-{rng.choice((8, 16))}/ISO-8859-{r(1, 16)}", lambda: str(uuid.UUID(int=rng.getrandbits(128))),
        lambda: f"v{r(20)}-{r(20)}-{r(20)}-{rng.choice(('rc', 'beta', 'build'))}{r(1000)}", lambda: f"usr/{rng.choice(words)}/{rng.choice(words)}{r(10)}/{rng.choice(words)}-{r(2000, 2030)}", lambda: f"{rng.choice(words).upper()}-{r(10, 99)}-{rng.choice(words)}",
        lambda: f"{rng.choice(words)}_{r(1000)}_{rng.choice(words)}{r(100)}", lambda: digits(r(4, 20)), lambda: f"{''.join(rng.choice(string.ascii_uppercase) for _ in range(3))}-{digits(4)}-{rng.choice(string.ascii_uppercase)}", lambda: "COVID-19-vaccination",
    )
    return [make() for make in makers for _ in range(150)]


def reported(scanner, text, at, end):
    base, every = scanner.scan(text)
    return any(start < end and stop > at for start, _, stop in every)


def test_ordinary_strings(scanner):
    rng, wrong, n = random.Random(11), [], 0
    for k, c in enumerate(ordinary(rng)):
        for before in ("the session of ", "key "):
            text = (PROSE if k % 2 else CODE)[-rng.randrange(20, 90) :] + before + c + " and the rest of it goes on"
            at = text.index(before + c) + len(before)
            n += 1
            if reported(scanner, text, at, at + len(c)):
                wrong.append(c)
    assert n > 4000 and len(wrong) < 0.01 * n, wrong[:20]


@pytest.mark.parametrize("n", [24, 32, 48])
def test_random_keys(scanner, n):
    rng, missed, seen = random.Random(n), [], 0
    alphabet = string.ascii_letters + string.digits
    for name in ("accessKey", "encryptionKey", "signingKey", "userToken", "DB_PASS", "clientSecret", "AUTH_TOKEN", "private key"):
        for form in ('{} = "{}"', "{}: {}", "{}={}", "{} is {}", "{} {}"):
            for _ in range(40):
                key = "".join(rng.choice(alphabet) for _ in range(n))
                text = CODE[-rng.randrange(20, 90) :] + form.format(name, key) + "\n" + CODE[:60]
                at = text.index(key)
                seen += 1
                if not reported(scanner, text, at, at + n):
                    missed.append(form.format(name, key))
    assert len(missed) <= 0.02 * seen, (len(missed), seen, missed[:5])


def test_names():
    hit = lambda t: bool(secrets.SENSITIVE.search(t))
    assert all(map(hit, ("key", "keys:", "accessKey", "AccessKeyId", "DB_PASS", "userToken", "my_secret", "APIKey", "API_KEY=", "authToken", "Passwords", "x-auth")))
    assert not any(map(hit, ("AUTHORS", "monkey", "keynote", "Keynote", "tokenize", "author", "Authors", "PASSAGE", "passage", "donkeys", "MONKEY", "compass")))
