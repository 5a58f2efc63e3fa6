"""SentencePiece encoding and decoding as a relational lattice.

A text becomes words (a run of spaces, written as U+2581, and what follows up to the next
one): no piece goes past such a word, so equal words are encoded once for the whole table.
Every distinct word is exploded into its substrings of bounded length, these are joined by
equality to the piece table, and the matching edges (from, to, id, score) are grouped by
word again.  A higher-order ``aggregate`` then folds the lattice into ids:

* ``viterbi`` for unigram models: best score to every position, then back;
* ``merge`` for BPE models: starting from single characters, the adjacent pair whose
  union is the best-scoring edge (ties: leftmost) is joined, until no edge spans a pair.
  A BPE model's scores are merge ranks; their sum along a path means nothing, so Viterbi
  over them does not give the model's pieces.

Characters without a piece fall back to byte pieces, or to the unknown piece.

The piece table has the size of the vocabulary and is broadcast.  Words are aggregated
before they are exploded; the lattice is grouped by word where the words lie, so edges are
not shuffled.  Encoded words go back to their texts by a join on the word; the frequent
words (at most ``HEAD``) are joined by broadcast, which leaves no hot key to shuffle.

Defined cases: NULL text is empty; empty text has no pieces; repeated rows and equal texts
are encoded once and all come back; words and texts of any length are encoded whole; other
columns come back unchanged, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from gridtide.session import materialize

SPACE = "▁"
HEAD = 20_000  # most frequent words, joined by broadcast (about 2 MB)
LONG = 48  # characters of a word from which its fold runs in a worker


@dataclass(frozen=True)
class Pieces:
    """A model's pieces, read with the library on the driver; the size of the vocabulary."""

    rows: list[tuple[int, str, float, str]]  # id, piece, score, kind
    bpe: bool
    dummy_prefix: bool
    unknown: int

    @classmethod
    def load(cls, path: str) -> Pieces:
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        sp = SentencePieceProcessor(model_proto=model.SerializeToString())
        normal = model.normalizer_spec
        if normal.name != "identity" or normal.remove_extra_whitespaces or not normal.escape_whitespaces:
            raise ValueError("only models that leave the text as it is are supported")
        kinds = {1: "normal", 2: "unknown", 3: "control", 4: "user", 5: "unused", 6: "byte"}
        rows = [(i, p.piece, float(p.score), kinds[p.type]) for i, p in enumerate(model.pieces)]
        if any(k == "user" or SPACE in p.lstrip(SPACE) for _, p, _, k in rows):
            raise ValueError("pieces must not go past a word")
        return cls(rows, model.trainer_spec.model_type == 2, normal.add_dummy_prefix, sp.unk_id())

    def table(self, spark: SparkSession) -> DataFrame:
        found = [(p, i, s) for i, p, s, k in self.rows if k == "normal"]
        return spark.createDataFrame(found, "piece string, id int, score double")

    @property
    def longest(self) -> int:
        return max(len(p) for _, p, _, k in self.rows if k == "normal")

    @property
    def gap(self) -> float:
        """Score of a character that no piece covers."""
        return min(s for _, _, s, k in self.rows if k == "normal") - 10

    @property
    def bytes(self) -> list[int]:
        """Ids of the 256 byte pieces, or nothing."""
        found = {int(p[1:-1], 16): i for i, p, _, k in self.rows if k == "byte"}
        return [found[b] for b in range(256)] if len(found) == 256 else []


def words_of(text: Column, dummy_prefix: bool = True) -> Column:
    """The words of a text in order: spaces belong to what follows them."""
    escaped = F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit(SPACE))
    whole = F.concat(F.lit(SPACE if dummy_prefix else ""), escaped)
    return F.when(F.char_length(text) > 0, F.regexp_extract_all(whole, F.lit(f"{SPACE}*[^{SPACE}]+|{SPACE}+"), F.lit(0))).otherwise(
        F.array().cast("array<string>")
    )


def lattice(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, edges) of distinct words: all pieces that stand somewhere in the word, from
    and to counted in characters; an empty array where there is none."""
    n = F.char_length("word")
    dealt = words.select("word").repartition("word")  # the grouping below keeps to it
    starts = dealt.select("word", F.explode(F.sequence(F.lit(1), n)).alias("a"))
    ends = starts.select(
        "word", "a", F.explode(F.sequence(F.col("a"), F.least(n, F.col("a") + pieces.longest - 1))).alias("b")
    )
    spans = ends.select("word", "a", "b", F.substring("word", F.col("a"), F.col("b") - F.col("a") + 1).alias("piece"))
    found = spans.join(F.broadcast(pieces.table(words.sparkSession)), "piece", "left")
    # The first character stays in any case, so that every word comes out.
    found = found.where("id IS NOT NULL OR (a = 1 AND b = 1)")
    edge = F.struct((F.col("a") - 1).alias("a"), F.col("b").alias("b"), "id", "score")
    edges = F.filter(F.collect_list(edge), lambda e: e["id"].isNotNull())
    return found.groupBy("word").agg(edges.alias("edges"))


# The folds are SQL text: nested lambdas over struct fields read better there.
_MERGE = """
aggregate(
  sequence(1, char_length(word)),
  sequence(0, char_length(word)),
  (cuts, _) -> aggregate(
    array(array_max(transform(
      filter(edges, e -> e.b - e.a > 1
        AND array_position(cuts, e.a) > 0
        AND array_position(cuts, e.b) = array_position(cuts, e.a) + 2),
      e -> struct(e.score AS score, -e.a AS a, e.b AS b)))),
    cuts,
    (c, best) -> if(best IS NULL, c, filter(c, x -> x <= -best.a OR x >= best.b))))
"""
# Best score and last edge of every position; a character no piece covers costs dearly.
_VITERBI = """
aggregate(
  sequence(1, char_length(word)),
  array(named_struct('score', 0D, 'a', -1)),
  (best, b) -> concat(best, array(array_max(concat(
    array(named_struct('score', best[b - 1].score + {gap}, 'a', b - 1)),
    transform(filter(edges, e -> e.b = b),
      e -> named_struct('score', best[e.a].score + e.score, 'a', e.a)))))),
  best -> aggregate(
    sequence(1, char_length(word)),
    array(char_length(word)),
    (cuts, _) -> if(cuts[0] <= 0, cuts, concat(array(best[cuts[0]].a), cuts))))
"""


# The ids of the spans between cuts: a piece, else bytes, else the unknown piece.
_IDS = """
flatten(transform(sequence(0, size(cuts) - 2), k ->
  if(exists(edges, e -> e.a = cuts[k] AND e.b = cuts[k + 1]),
    transform(slice(filter(edges, e -> e.a = cuts[k] AND e.b = cuts[k + 1]), 1, 1), e -> e.id),
    {otherwise})))
"""
_BYTES = """
transform(sequence(1, octet_length(substring(word, cuts[k] + 1, cuts[k + 1] - cuts[k]))),
  j -> bytes[int(conv(hex(substring(encode(substring(word, cuts[k] + 1, cuts[k + 1] - cuts[k]), 'UTF-8'), j, 1)), 16, 10))])
"""


def encode_words(words: DataFrame, pieces: Pieces, fold: str | None = None) -> DataFrame:
    """(word, ids) for a table of distinct words.  ``fold`` is ``merge`` or ``viterbi`` and
    follows from the model if not named.  Words of more than ``LONG`` characters, for
    which a fold over arrays grows with the square, are folded the same way by a worker
    with a heap or a running best."""
    fold = fold or ("merge" if pieces.bpe else "viterbi")
    cuts = F.expr(_MERGE if fold == "merge" else _VITERBI.format(gap=f"({pieces.gap}D)"))
    short = words.where(F.char_length("word") <= LONG)
    cut = lattice(short, pieces).select(
        "word", "edges", cuts.alias("cuts"), F.array(*map(F.lit, pieces.bytes or [pieces.unknown])).alias("bytes")
    )
    ids = F.expr(_IDS.format(otherwise=_BYTES if pieces.bytes else "bytes"))
    shared = words.sparkSession.sparkContext.broadcast(pieces)

    @pandas_udf("array<int>")
    def folded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = LongWords(shared.value, fold)
        for b in batches:
            yield pd.Series([encoder.ids(w) for w in b])

    long = words.where(F.char_length("word") > LONG).select("word", folded("word").alias("ids"))
    return cut.select("word", ids.alias("ids")).unionByName(long)


class LongWords:
    """The two folds for long words, in time n log n and n."""

    def __init__(self, pieces: Pieces, fold: str):
        self.pieces, self.fold = pieces, fold
        self.known = {p: (i, s) for i, p, s, k in pieces.rows if k == "normal"}

    def ids(self, word: str) -> list[int]:
        cuts = self._merge(word) if self.fold == "merge" else self._viterbi(word)
        out: list[int] = []
        for a, b in zip(cuts, cuts[1:]):
            if word[a:b] in self.known:
                out.append(self.known[word[a:b]][0])
            elif self.pieces.bytes:
                out += [self.pieces.bytes[x] for x in word[a:b].encode()]
            else:
                out.append(self.pieces.unknown)
        return out

    def _merge(self, word: str) -> list[int]:
        n = len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n))  # next and last cut of a cut
        heap: list[tuple[float, int, int]] = []

        def offer(a: int, b: int) -> None:
            if word[a:b] in self.known:
                heappush(heap, (-self.known[word[a:b]][1], a, b))

        for a in range(n - 1):
            offer(a, a + 2)
        alive = [True] * (n + 1)
        while heap:
            _, a, b = heappop(heap)
            if not (alive[a] and alive[b]):
                continue
            middle = after[a]
            if middle >= n or after[middle] != b:
                continue
            alive[middle] = False
            after[a] = b
            if b <= n:
                before[b] = a
            if b < n:
                offer(a, after[b])
            if before[a] >= 0:
                offer(before[a], b)
        cuts = [0]
        while cuts[-1] < n:
            cuts.append(after[cuts[-1]])
        return cuts

    def _viterbi(self, word: str) -> list[int]:
        best = [(0.0, -1)]
        for b in range(1, len(word) + 1):
            options = [(best[b - 1][0] + self.pieces.gap, b - 1)]
            for a in range(max(0, b - self.pieces.longest), b):
                if word[a:b] in self.known:
                    options.append((best[a][0] + self.known[word[a:b]][1], a))
            best.append(max(options))
        cuts = [len(word)]
        while cuts[0] > 0:
            cuts.insert(0, best[cuts[0]][1])
        return cuts


def encode(docs: DataFrame, pieces: Pieces, text_col: str = "text", ids_col: str = "ids", fold: str | None = None) -> DataFrame:
    """``docs`` with the array ``ids_col``.  Equal texts are encoded once."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    ).withColumn("key", F.substring(F.unhex(F.sha2("text", 256)), 1, 16))
    texts = rows.groupBy("key").agg(F.max("text").alias("text"))
    placed = materialize(texts.select("key", F.posexplode(words_of(F.col("text"), pieces.dummy_prefix)).alias("at", "word")), "words")
    counts = materialize(placed.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "counts")
    coded = materialize(encode_words(counts, pieces, fold), "coded")
    frequent = counts.orderBy(F.desc("n"), "word").limit(HEAD).select("word")
    head = materialize(coded.join(F.broadcast(frequent), "word", "left_semi"), "head")
    near = placed.join(F.broadcast(head), "word")
    far = placed.join(F.broadcast(head.select("word")), "word", "left_anti").join(coded, "word")
    whole = near.unionByName(far).groupBy("key").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"])).alias("ids")
    )
    joined = rows.select("row", "key").join(materialize(whole, "encoded"), "key", "left")
    columns = [F.col("row")[c].alias(c) for c in docs.columns if c != ids_col]
    return joined.select(*columns, F.coalesce("ids", F.array().cast("array<int>")).alias(ids_col))


def decode(docs: DataFrame, pieces: Pieces, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with the text of ``ids_col``: one array of all pieces' bytes (the size of
    the vocabulary) is looked up by position.  Control pieces and ids outside the
    vocabulary give no text; NULL gives NULL."""
    spark = docs.sparkSession
    bytes_of = {"normal": lambda p: p.replace(SPACE, " ").encode().hex(), "byte": lambda p: p[3:5], "unknown": lambda p: " ⁇ ".encode().hex()}
    rows = [(i, bytes_of[k](p) if k in bytes_of else "") for i, p, _, k in pieces.rows]
    table = spark.createDataFrame(rows, "id int, hex string")
    array = table.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "hex"))), lambda x: x["hex"]).alias("t")).scalar()
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{ids_col}`").alias("ids"), array.alias("t")
    )
    joined = F.array_join(F.transform("ids", lambda i: F.coalesce(F.get("t", i), F.lit(""))), "")
    text = F.unhex(joined).cast("string")
    if pieces.dummy_prefix:
        text = F.when(F.startswith(text, F.lit(" ")), F.substring(text, F.lit(2), F.char_length(text))).otherwise(text)
    return packed.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != text_col], text.alias(text_col))
