"""Token counts with a two-tier lookup on the map side.

A text is cut into pre-tokens. Tier one is a compact hash table from frequent pre-tokens to their number of tokens, broadcast
once; which are frequent is counted in a bounded sample of the texts (it decides speed alone: any table gives the same counts).
What it lacks is encoded by the tokenizer's model and kept in a cache of bounded size in each worker. No pre-token is ever
shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter as Counts

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_arrow

#: Texts in which frequent pre-tokens are counted at most, and characters of each.
SAMPLE, SAMPLE_CHARS = 1000, 10_000
#: Pre-tokens a worker keeps beside the broadcast table; a full cache is emptied.
CACHE_ENTRIES = 800_000
#: Longer pre-tokens aren't cached.
CACHE_CHARS = 64
#: Texts made of these characters alone are cut by PRE_TOKEN; others by the library, whose Unicode tables are its own.
PLAIN = re.compile(r"[\t\n\r -~\u00a1-\u00ac\u00ae-\u02af\u2010-\u2027\u2030-\u205e\u20ac]*")


def _characters(kind: str) -> str:
    """The letters (L) or numbers (N) among the plain characters, for a character class."""
    return "".join(chr(c) for c in range(0x2B0) if unicodedata.category(chr(c))[0] == kind)


# Fixed value: the pre-token pattern of this byte-level vocabulary, with its classes spelt out for plain characters.
PRE_TOKEN = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_characters('L')}]+| ?[{_characters('N')}]+| ?[^\s{_characters('L')}{_characters('N')}]+|\s+(?!\S)|\s+")

_worker: dict = {}


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}


BYTE_LETTERS = _byte_letters()


class Lengths(dict):
    """Tokens of pre-tokens: tier one is the dict itself; what it lacks comes from the cache or the tokenizer."""

    def __init__(self, frequent: dict[str, int], model):
        super().__init__(frequent)
        self.cache, self.model = {}, model

    def __missing__(self, piece: str) -> int:
        n = self.cache.get(piece)
        if n is None:
            n = len(self.model.tokenize(piece.encode().decode("latin-1").translate(BYTE_LETTERS)))
            if len(piece) <= CACHE_CHARS:
                if len(self.cache) >= CACHE_ENTRIES:
                    self.cache.clear()
                self.cache[piece] = n
        return n


class Counter:
    """Counts tokens of texts; one to a worker process."""

    def __init__(self, path: str, frequent: dict[str, int]):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.lengths = Lengths(frequent, self.tokenizer.model)
        special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings."""
        if PLAIN.fullmatch(text):
            return PRE_TOKEN.findall(text)
        return [text[a:b] for _, (a, b) in self.cut(text)] if text else []

    def parts(self, text: str) -> list[str]:
        """What stands between special strings."""
        return self.special.split(text) if self.special else [text]

    def count(self, text: str) -> int:
        parts = self.parts(text)
        return len(parts) - 1 + sum(sum(map(self.lengths.__getitem__, self.pieces(p))) for p in parts)


def frequent_lengths(docs: DataFrame, path: str, entries: int) -> dict[str, int]:
    """The most frequent pre-tokens of the first SAMPLE texts (column text) that come, with the number of tokens each takes.

    The driver counts them: it gets SAMPLE x SAMPLE_CHARS characters at most, of as few partitions as hold so many texts.
    """
    counter, counts = Counter(path, {}), Counts()
    for r in docs.where("text is not null").select(F.substring("text", 1, SAMPLE_CHARS).alias("text")).take(SAMPLE):
        for part in counter.parts(r["text"]):
            counts.update(counter.pieces(part))
    return {x: counter.lengths[x] for x, _ in counts.most_common(entries) if len(x) <= CACHE_CHARS}


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 512, frequent: int = 100_000) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every whole text.

    A null text counts as an empty one: no bytes, no tokens. Begin, end and other added tokens don't count; special strings
    inside a text are one token each, the library's default. doc_id is carried as it is (nulls, repeated rows); other columns
    are left out. A text is never cut short, however long. Nothing is shuffled; what is broadcast is bounded by `frequent`.
    """
    own = id_and_text(docs)
    lengths = docs.sparkSession.sparkContext.broadcast(frequent_lengths(own, tokenizer_path, frequent))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter = _worker.get(tokenizer_path)
        if counter is None:
            counter = _worker[tokenizer_path] = Counter(tokenizer_path, lengths.value)
        counts = [counter.count(x) if x else 0 for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pc.fill_null(pc.binary_length(batch.column(1)).cast(pa.int64()), 0), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_arrow(own, run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
