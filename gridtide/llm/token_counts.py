"""Token counts of byte-level BPE texts with a whole-token shortcut.

Before any text is read, every vocabulary string is encoded by the model on its own; those
that come back as one token form the proven set.  A pre-token found there counts one, and
only the rest is merged.  Counting runs where the rows lie: no shuffle, one pass, whole
texts.

Text is cut at white space first (no pre-token but white space crosses such a cut), so
that a repeated word costs one look-up in a cache of bounded size.  A word with a character
above U+024F is cut into pre-tokens by the library's own pre-tokenizer, for the kinds of
such characters change with the Unicode version; its pre-tokens meet the proven set and the
merges like any other.

Defined cases: NULL text counts as empty (no bytes, no tokens); repeated rows are counted
each; the strings of special tokens inside a text are special tokens, as the library reads
them by default; an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from gridtide.llm.batches import values

CACHE = 1_000_000  # words remembered by one worker, about 130 MB
# The white space characters of Unicode.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies use for each byte: printable
    Latin-1 for itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def whole_tokens(definition: str) -> list[str]:
    """Vocabulary strings (in byte letters) that the model encodes alone as one token."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_str(definition).model
    vocab = json.loads(definition)["model"]["vocab"]
    return [s for s in vocab if len(model.tokenize(s)) == 1]


class Counter:
    """Counts tokens as the library does, for byte-level BPE with the usual word pattern."""

    def __init__(self, definition: str, proven: list[str]):
        from tokenizers import Tokenizer

        spec = json.loads(definition)
        pre = spec["pre_tokenizer"] or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex"):
            raise ValueError("the shortcut is made for byte-level BPE without normaliser or prefix space")
        added = spec.get("added_tokens", [])
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("special tokens must match their own characters only")
        tokenizer = Tokenizer.from_str(definition)
        self.model, self.library_parts = tokenizer.model, tokenizer.pre_tokenizer.pre_tokenize_str
        letters = byte_letters()
        self.letters = str.maketrans({chr(b): c for b, c in letters.items()})
        back = {c: b for b, c in letters.items()}
        self.proven, self.proven_letters = set(), set(proven)
        for s in proven:
            try:
                self.proven.add(bytes(back[c] for c in s).decode())
            except (KeyError, UnicodeDecodeError):
                continue  # a part of a character is never a whole pre-token
        self.special = re.compile("|".join(re.escape(t["content"]) for t in added)) if added else None
        self.known: dict[str, int] = {}
        # Up to U+024F, letters and digits are the same to this pattern and to the library's.
        kinds = {"L": "", "N": ""}
        for c in map(chr, range(0x250)):
            if (k := unicodedata.category(c)[0]) in kinds:
                kinds[k] += c
        letter, number = kinds["L"], kinds["N"]
        self.high = re.compile(f"[^\x00-\u024f{SPACES}]").search
        self.words = re.compile(f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]").findall
        self.parts = re.compile(
            "'s|'t|'re|'ve|'m|'ll|'d"
            f"| ?[{letter}]+| ?[{number}]+| ?[^{SPACES}{letter}{number}]+|[{SPACES}]+"
        ).findall

    def _in_letters(self, part: str) -> str:
        return part.encode().decode("latin-1").translate(self.letters)

    def _word(self, word: str) -> int:
        if self.high(word):
            parts = [p for p, _ in self.library_parts(word)]
            n = sum(1 if p in self.proven_letters else len(self.model.tokenize(p)) for p in parts)
        else:
            n = sum(1 if p in self.proven else len(self.model.tokenize(self._in_letters(p))) for p in self.parts(word))
        if len(self.known) >= CACHE:
            self.known.clear()
        if len(word) < 64:
            self.known[word] = n
        return n

    def _plain(self, text: str) -> int:
        get, n = self.known.get, 0
        for word in self.words(text):
            k = get(word)
            n += self._word(word) if k is None else k
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if self.special is None:
            return self._plain(text)
        cut = self.special.split(text)
        return sum(map(self._plain, cut)) + len(cut) - 1


_counters: dict[str, Counter] = {}


def _counter(definition: str, proven: list[str]) -> Counter:
    """The counter of this worker process, which keeps its cache from task to task."""
    if definition not in _counters:
        _counters[definition] = Counter(definition, proven)
    return _counters[definition]


def token_measure(spark, path: str) -> Callable[[pa.Array], pa.Array]:
    """A function, for tasks, from a batch of texts to their numbers of tokens.  The
    tokenizer file is read on the driver, proven there, and broadcast: its size does not
    depend on the data (50,000 strings, about 3 MB)."""
    with open(path, encoding="utf-8") as f:
        definition = f.read()
    shared = spark.sparkContext.broadcast((definition, whole_tokens(definition)))

    def measure(texts: pa.Array) -> pa.Array:
        counter = _counter(*shared.value)
        return pa.array([counter.count(t) if t else 0 for t in values(texts)], pa.int64())

    return measure


def token_counter(spark, path: str) -> Callable[[Column], Column]:
    """A function from a text column to its number of tokens (long)."""
    measure = token_measure(spark, path)

    @arrow_udf("bigint")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield measure(texts)

    return lambda text: counted(text)


def token_counts(
    docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of ``docs``: id, n_bytes (UTF-8), n_tokens, over_limit."""
    text: Column = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    n = token_counter(docs.sparkSession, path)
    return docs.select(
        F.col(f"`{id_col}`").alias(id_col),
        F.octet_length(text).cast("bigint").alias("n_bytes"),
        n(text).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
