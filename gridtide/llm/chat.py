"""Chat formatting by token-level assembly.

Template of one turn: ``<|im_start|>`` role ``<|im_sep|>`` text ``<|im_end|>``.  Role and
text are encoded as segments of their own and the control tokens are spliced in as
reserved ids above the vocabulary, so no text can ever produce one.  For the rendered
form, ``<|`` inside a role or text is escaped: every ``<``, backslashes, ``|`` gets one
backslash more, which is undone by taking one away.

The loss mask of a turn follows from prefix sums over its segment lengths and covers the
text of assistant turns.  Turns are formatted where they lie; a conversation is the
sequence of its turns, whose offsets are running sums, so a conversation of any length is
never held as one row.

Defined cases: rows go by turn, ties by role and text (NULL first); NULL role or text is
empty; a NULL turn comes first; rows with a NULL conv_id form one conversation; repeated
rows are turns of their own; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROLS = (START, SEP, END)
BATCH = 1 << 20  # characters encoded by one call

_PLAIN = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _PLAIN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


_codecs: dict[str, object] = {}


class Codec:
    """Encodes and decodes segments; ids of controls follow the vocabulary."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are text
        top = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.reserved = {c: top + i for i, c in enumerate(CONTROLS)}

    @classmethod
    def of(cls, definition: str) -> Codec:
        if definition not in _codecs:
            _codecs[definition] = cls(definition)
        return _codecs[definition]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out, at = [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= BATCH):
                size += len(texts[end])
                end += 1
            for e in self.tokenizer.encode_batch_fast(texts[at:end], add_special_tokens=False):
                out.append(np.array(e.ids, dtype=np.int32))
            at = end
        return out

    def turn(self, role: np.ndarray, text: np.ndarray, learn: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids and loss mask of one turn from its encoded role and text."""
        s, p, e = (np.array([self.reserved[c]], dtype=np.int32) for c in CONTROLS)
        segments = (s, role, p, text, e)
        edge = np.cumsum([0, *map(len, segments)])
        mask = np.zeros(edge[-1], dtype=np.int8)
        if learn:
            mask[edge[3] : edge[4]] = 1
        return np.concatenate(segments), mask

    def render(self, ids: np.ndarray) -> str:
        """The formatted string: controls as written, segments decoded (still escaped)."""
        names = {v: c for c, v in self.reserved.items()}
        at = np.nonzero(ids >= min(names))[0].tolist()
        out, last = [], 0
        for k in at:
            out += [self.decode(ids[last:k]), names[int(ids[k])]]
            last = k + 1
        return "".join([*out, self.decode(ids[last:])])

    def decode(self, ids: np.ndarray) -> str:
        return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False) if len(ids) else ""

    def parse(self, ids: np.ndarray) -> list[tuple[str, str]]:
        """(role, text) of the turns of a token sequence."""
        turns, opened = [], None
        for k in np.nonzero(ids >= min(self.reserved.values()))[0].tolist():
            if ids[k] == self.reserved[START]:
                opened = k
            elif ids[k] == self.reserved[SEP]:
                sep = k
            else:
                turns.append((unescape(self.decode(ids[opened + 1 : sep])), unescape(self.decode(ids[sep + 1 : k]))))
        return turns


def format_turns(turns: DataFrame, path: str, learned: str = "assistant") -> DataFrame:
    """Per row of ``turns`` (conv_id, turn, role, text): conv_id, position (from 0), ids,
    loss_mask and start, the offset of its first id in the conversation.  ``path`` is a
    tokenizers file; it is read on the driver and broadcast (about 2 MB, independent of
    the data)."""
    with open(path, encoding="utf-8") as f:
        shared = turns.sparkSession.sparkContext.broadcast(f.read())

    def formatted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec.of(shared.value)
        roles: dict[str, np.ndarray] = {}
        for b in batches:
            for r in set(b["role"]) - roles.keys():
                if len(roles) > 10_000:
                    roles.clear()
                roles[r] = codec.encode([escape(r)])[0]
            texts = codec.encode([escape(t) for t in b["text"]])
            made = [
                codec.turn(roles[r] if r in roles else codec.encode([escape(r)])[0], t, r == learned)
                for r, t in zip(b["role"], texts)
            ]
            yield pd.DataFrame(
                {
                    "conv_id": b["conv_id"],
                    "turn": b["turn"],
                    "tie": b["tie"],
                    "ids": [m[0] for m in made],
                    "loss_mask": [m[1] for m in made],
                }
            )

    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.struct(F.col("role").cast("string").alias("r"), F.col("text").cast("string").alias("t")).alias("tie0"),
    ).select(
        "conv_id",
        "turn",
        # NULL and empty are told apart only for the order of ties.
        F.concat(
            F.when(F.col("tie0.r").isNull(), "0").otherwise("1"), F.when(F.col("tie0.t").isNull(), "0").otherwise("1")
        ).alias("tie"),
        F.coalesce("tie0.r", F.lit("")).alias("role"),
        F.coalesce("tie0.t", F.lit("")).alias("text"),
    )
    made = rows.mapInPandas(
        formatted, "conv_id bigint, turn bigint, tie string, ids array<int>, loss_mask array<tinyint>"
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "tie", "ids")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return made.select(
        "conv_id",
        (F.row_number().over(order) - 1).cast("bigint").alias("position"),
        "ids",
        "loss_mask",
        F.coalesce(F.sum(F.size("ids").cast("bigint")).over(before), F.lit(0)).alias("start"),
    )


def read_back(formatted: DataFrame, path: str, together: bool = False) -> DataFrame:
    """Per conversation, read from the ids and masks alone: conv_id, n_turns, turns_sha256
    (role, newline, text, newline of each turn), loss_chars, loss_sha256, formatted_chars,
    n_tokens.  Rows stream through in order with one running digest per conversation.
    ``together`` says that each conversation lies in one partition already, as straight
    after ``format_turns`` (its window dealt the rows by conv_id), and saves an exchange.
    """
    with open(path, encoding="utf-8") as f:
        shared = formatted.sparkSession.sparkContext.broadcast(f.read())

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec.of(shared.value)
        rows, state, current = [], None, object()

        def close() -> None:
            if state:
                rows.append((current, state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["all"], state["ids"]))

        def flushed() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
            out["conv_id"] = out["conv_id"].astype("Int64")
            rows.clear()
            return out

        for b in batches:
            for conv, ids, mask in zip(b["conv_id"], b["ids"], b["loss_mask"]):
                conv = None if pd.isna(conv) else int(conv)
                if conv != current or state is None:
                    close()
                    current = conv
                    state = {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "all": 0, "ids": 0}
                ids, mask = np.asarray(ids), np.asarray(mask)
                for role, text in codec.parse(ids):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{text}\n".encode())
                under = np.nonzero(mask)[0]
                if len(under):
                    learned = unescape(codec.decode(ids[under[0] : under[-1] + 1]))
                    state["chars"] += len(learned)
                    state["loss"].update(learned.encode())
                state["all"] += len(codec.render(ids))
                state["ids"] += len(ids)
            if rows:
                yield flushed()
        close()
        if rows:
            yield flushed()

    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_tokens bigint"
    dealt = formatted if together else formatted.repartition("conv_id")
    return dealt.sortWithinPartitions("conv_id", "position").select("conv_id", "ids", "loss_mask").mapInPandas(digests, schema)
