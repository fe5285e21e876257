"""Secret scans: patterns of known secrets, and dictionary-primed novelty of unknown ones.

The patterns find assignments to password-like names, access keys and long hexadecimal runs. The novelty scan takes every
other run of key characters that stands near a sensitive word, and measures what it adds to the compressed size of the text
around it, with a zstandard dictionary trained on code: words, paths and names that the surroundings or the dictionary know, or
whose letters are as common as theirs, add little, random keys add nearly all their bytes. Those over a line in their length and
in how often their kind of character changes, fitted on ordinary strings and random keys, are reported; of fixed forms, only UUIDs
are taken for names.
"""

from __future__ import annotations

import hashlib
import re
import sysconfig
from bisect import bisect_left
from collections import Counter
from pathlib import Path
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, id_and_text, map_arrow, ship

# The patterns of the base scan and the words that make a context sensitive.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")
SENSITIVE_WORDS = ("secret", "token", "password", "passwd", "passw", "pass", "pwd", "passphrase", "credential", "private", "auth", "authorization", "bearer", "signature", "api", "apikey", "key", "salt", "cookie", "session")
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")


def _names(words: tuple[str, ...]) -> re.Pattern:
    """The words by themselves or as parts of names: in small letters or with a capital, up to a change of case (accessKey,
    authToken), or in capitals (DB_PASS). A word that goes on in letters of its own case is another one."""
    way = lambda f: "|".join(map(f, words))
    return re.compile(rf"(?<![A-Za-z])(?:{way(str)})s?(?![a-z])|(?:{way(str.capitalize)})s?(?![a-z])|(?<![A-Za-z])(?:{way(str.upper)})S?(?![A-Za-z])", re.A)


SENSITIVE = _names(SENSITIVE_WORDS)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")  # an equals sign pads a key at its end; before one stands a name
#: Bytes of the dictionary; of a sample of code, and from one sample to the next; words that go into samples too, and times they occur at least.
DICTIONARY, SNIPPET, STEP, WORDS, TIMES = 65_536, 256, 1024, 20, 8


class Novelty(NamedTuple):
    """Parameters of the novelty scan: characters of context before and after, and the line over which the bytes count that a
    candidate of n characters adds: slope n + short / n (few characters may add more than they are, by rounding).

    What changes little between kinds of characters needs more, up to slope + steep x knee a character: digits and separators
    compress badly but make no secret by themselves, as in dates, ranges and numbers of books, norms and telephones."""

    before: int = 96
    after: int = 32
    slope: float = 0.78
    short: float = 6.0
    knee: float = 0.4
    steep: float = 1.2

    def line(self, candidate: str) -> float:
        n = len(candidate)
        return n * (self.slope + self.steep * max(0.0, self.knee - switches(candidate))) + self.short / n


def switches(candidate: str) -> float:
    """The share of neighbours that are of different kinds: small letters, capitals, digits."""
    kinds = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in candidate]
    return sum(a != b and a < 3 and b < 3 for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, len(kinds) - 1)


def identifier_dictionary() -> bytes:
    """A dictionary of ordinary code, trained on the sources of this Python's standard library and the identifiers common in them."""
    samples, counts = [], Counter()
    for path in sorted(Path(sysconfig.get_paths()["stdlib"]).glob("*.py")):
        source = path.read_text(errors="ignore")
        counts.update(re.findall(r"[A-Za-z]{4,}", source))
        samples += [source[at : at + SNIPPET].encode() for at in range(0, len(source), STEP)]
    words = [w for w, n in sorted(counts.items(), key=lambda x: (x[1], x[0])) if n >= TIMES]
    samples += [" ".join(words[at : at + WORDS]).encode() for at in range(0, len(words), WORDS)]
    return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base scan, sorted; kind is an index into KINDS."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


class Scanner:
    """One to a worker process and kind of novelty: see scanner()."""

    def __init__(self, novelty: Novelty, dictionary: bytes):
        self.novelty = novelty
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)

    def added(self, text: str, start: int, end: int) -> int:
        """Compressed bytes that the candidate adds to its surroundings."""
        left, right = text[max(0, start - self.novelty.before) : start], text[end : end + self.novelty.after]
        around, whole = (left + right).encode(), (left + right + text[start:end]).encode()
        return len(self.compressor.compress(whole)) - len(self.compressor.compress(around))

    def novel_spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        marks = [m.end() for m in SENSITIVE.finditer(text)]
        if not marks:
            return []
        starts, reach, far = [x[0] for x in base], [], 0
        for _, _, end in base:  # the farthest end so far
            far = max(far, end)
            reach.append(far)
        out = []
        for m in CANDIDATE.finditer(text):
            start, end = m.span()
            near = bisect_left(marks, start + 1) - 1  # the last sensitive word that ends before it
            if near < 0 or start - marks[near] > self.novelty.before:
                continue
            k = bisect_left(starts, end) - 1  # base spans up to this one start before its end
            if k >= 0 and reach[k] > start:
                continue
            if self.added(text, start, end) > self.novelty.line(m[0]) and not UUID.fullmatch(m[0]):
                out.append((start, 3, end))
        return out

    def scan(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """The base spans, and all spans; each by start, then kind."""
        base = base_spans(text)
        return base, sorted([*base, *self.novel_spans(text, base)])


_worker: dict = {}


def scanner(novelty: Novelty, dictionary: bytes) -> Scanner:
    """The worker's scanner, made once."""
    if (novelty, dictionary) not in _worker:
        _worker[novelty, dictionary] = Scanner(novelty, dictionary)
    return _worker[novelty, dictionary]


def spelt(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan_secrets(docs: DataFrame, novelty: Novelty | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_novel of every whole text.

    Spans are kind:start:end in code points, end exclusive, by start and then kind, joined by commas; base_sha256 is the hash of
    the base scan's. A null or empty text has none (an empty string, and its hash). doc_id is carried as it is (nulls, repeated
    rows); other columns are left out. One pass over each row, linear in its
    length; nothing is shuffled, and what goes to the workers is the dictionary of 64 KB.
    """
    novelty, dictionary = novelty or Novelty(), identifier_dictionary()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = scanner(novelty, dictionary)
        rows = [own.scan(x.as_py() or "") for x in batch.column(1)]
        count = lambda k: pa.array([sum(s[1] == k for s in every) for _, every in rows], pa.int64())
        digests = [hashlib.sha256(spelt(base).encode()).hexdigest() for base, _ in rows]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), count(0), count(1), count(2), pa.array(digests, pa.string()), pa.array([spelt(every) for _, every in rows], pa.string()), count(3)],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"],
        )

    return map_arrow(id_and_text(docs), run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_novel bigint")


def redact(text: str | None, spans: str) -> str | None:
    """The text with every span replaced by a mark of its kind; overlapping spans share the first one's mark."""
    if not text or not spans:
        return text
    out, at = [], 0
    for piece in spans.split(","):
        kind, start, end = piece.split(":")
        if int(start) >= at:
            out += [text[at : int(start)], f"[{kind}]"]
        at = max(at, int(end))
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, novelty: Novelty | None = None) -> DataFrame:
    """docs, all columns, with every found secret in text replaced by [kind]; n_chars, where there is one, follows the text.

    Null texts and texts without secrets stay as they are.
    """
    novelty, dictionary = novelty or Novelty(), identifier_dictionary()
    ship(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        own = scanner(novelty, dictionary)
        return pd.Series([redact(x, spelt(own.scan(x or "")[1])) for x in texts], dtype="object")

    (name,) = fresh(docs, "redacted_text")
    out = docs.withColumn(name, clean(F.col("text").cast("string")))
    changed = {"text": F.col(name)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(name) == F.col("text"), F.col("n_chars")).otherwise(F.coalesce(F.length(name).cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.withColumns(changed).select(*docs.columns)
