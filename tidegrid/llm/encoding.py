"""Encoding of a corpus with a public byte-level BPE tokenizer, in Spark expressions.

Texts are cut into words by the tokenizer's pattern. A word is a string of
pieces, each the hexadecimal form of its bytes in angle brackets. ``aggregate``
folds the merges: every step looks up the ranks of all neighbouring pairs in a
literal rank map and merges all occurrences of the pair of least rank, until no
pair has a rank. In a vocabulary whose tokens are all built by merges of rising
rank no merge enables a pair of lower rank, so that is the one-by-one order; the
tests prove it token by token. The literal is an array of small maps addressed by
CRC-32, as a look-up in one large map of Spark is a linear search.

The words of the corpus are counted once. The most frequent ones, as many as a
bound on their bytes admits, are folded once each and make up the code book,
which goes to the executors as one value; a word outside the book is folded where
it stands. Every text is encoded in its row: word occurrences are never shuffled,
and the plan is the same for a corpus of any size.

Decoding looks up the bytes of each id in a literal array and concatenates them.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.session import stage

#: Folder of the vocabulary files; set TIDEGRID_TOKENIZERS to use another.
TOKENIZERS = os.environ.get("TIDEGRID_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the rank files, as Java reads it fastest:
#: Unicode white space by its characters, the contractions factored, runs of letters without backtracking.
PATTERN = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}++| ?\p{N}++| ?[^\t-\r\x85\p{Z}\p{L}\p{N}]++|[\t-\r\x85\p{Z}]+(?![^\t-\r\x85\p{Z}])|[\t-\r\x85\p{Z}]+"
#: Number of small maps of the rank literal.
SHELVES = 1 << 12
NO_RANK = (1 << 31) - 1
#: Bound on the code book in memory. An entry counts as ENTRY_BYTES and five bytes per byte of the word
#: (the word, and at most one id of four bytes per byte).
BOOK_BYTES = 16 << 20
ENTRY_BYTES = 64
#: Longer words (in bytes) and rarer ones never enter the book: these are no cheaper there than in their rows.
BOOK_WORD = 256
BOOK_LEAST = 4
#: Number of small maps of the book.
CODE_SHELVES = 1 << 15


@lru_cache(maxsize=4)
def ranks(path: str) -> tuple[tuple[str, int], ...]:
    """(piece as hexadecimal text, rank) of a rank file."""
    with open(path, "rb") as f:
        pairs = (line.split() for line in f if line.strip())
        return tuple((base64.b64decode(a).hex().upper(), int(b)) for a, b in pairs)


@lru_cache(maxsize=4)
def _shelves(path: str) -> str:
    shelves: list[dict[str, int]] = [{} for _ in range(SHELVES)]
    for piece, rank in ranks(path):
        shelves[zlib.crc32(piece.encode()) % SHELVES][piece] = rank
    return json.dumps(shelves, separators=(",", ":"))


def _rank(piece: Column, literal: Column) -> Column:
    """Rank of a piece given as hexadecimal text; null if it has none."""
    shelf = (F.crc32(piece.cast("binary")) % SHELVES).cast("int")
    return F.get(literal, shelf)[piece]


def _pieces(s: Column) -> Column:
    return F.split(F.substring(s, F.lit(2), F.length(s) - 2), "><")


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``: a one-element array binds it, so that it is computed, and stands in the plan, once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _merge_least(s: Column, literal: Column) -> Column:
    """One step of the fold: ``s`` with the pair of least rank merged, or marked as done."""

    def ranked(p: Column) -> Column:
        last = F.size(p) - 1
        rank_of = lambda x, i: F.coalesce(F.when(i < last, _rank(F.concat(x, F.get(p, i + 1)), literal)), F.lit(NO_RANK))
        return F.array_min(F.transform(p, lambda x, i: F.struct(rank_of(x, i).alias("rank"), x.alias("left"), F.coalesce(F.get(p, i + 1), F.lit("")).alias("right"))))

    def merged(best: Column) -> Column:
        left, right = best["left"], best["right"]
        pair, one = F.concat(F.lit("<"), left, F.lit("><"), right, F.lit(">")), F.concat(F.lit("<"), left, right, F.lit(">"))
        return F.struct(F.when(best["rank"] < NO_RANK, F.replace(s, pair, one)).otherwise(s).alias("s"), (best["rank"] >= NO_RANK).alias("done"))

    return _bind(_pieces(s), lambda p: _bind(ranked(p), merged))


def _folded(word: Column, literal: Column) -> Column:
    """The ids of a non-empty word, by folding its merges."""

    def ids(h: Column) -> Column:
        whole = _rank(h, literal)
        start = F.struct(F.regexp_replace(h, "(..)", "<$1>").alias("s"), F.lit(False).alias("done"))
        steps = F.sequence(F.lit(1), (F.length(h) / 2).cast("int"))
        step = lambda acc, _: F.when(acc["done"], acc).otherwise(_merge_least(acc["s"], literal))
        folded = F.aggregate(steps, start, step, lambda acc: F.transform(_pieces(acc["s"]), lambda p: _rank(p, literal)))
        return F.coalesce(F.when(whole.isNotNull(), F.array(whole)), folded)

    return _bind(F.hex(F.encode(word, "UTF-8")), ids)


def _with_ranks(path: str, body: Callable[[Column], Column]) -> Column:
    """``body`` of the literal rank map."""
    return _bind(F.from_json(F.lit(_shelves(path)), "array<map<string,int>>"), body)


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """(word, ids) of distinct non-empty words."""
    return words.select("word", _with_ranks(path, lambda literal: _folded(F.col("word"), literal)).alias("ids"))


def words_of(text: Column) -> Column:
    """The words of a text by the tokenizer's pattern."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def book_words(documents: DataFrame, text: str) -> DataFrame:
    """(word): the most frequent words of all texts, as many whole frequency classes as fit into BOOK_BYTES.

    Words are counted with map-side combine; a histogram of a few hundred classes
    (each count up to 64, then sixteenths of an octave) gives the least frequency
    that enters, so nothing is sorted or collected.
    """
    words = documents.select(F.explode(words_of(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counted = stage(words.where((F.octet_length("word") <= BOOK_WORD) & (F.col("n") >= BOOK_LEAST)), "word-counts")
    count = F.col("n")
    grade = F.when(count <= 64, count).otherwise(F.floor(F.log2(count.cast("double")) * 16) - 32).cast("int")
    graded = counted.withColumn("grade", grade)
    bytes_of = F.sum(F.lit(ENTRY_BYTES) + 5 * F.octet_length("word"))
    room, least = BOOK_BYTES, None
    for row in graded.groupBy("grade").agg(bytes_of.alias("bytes")).orderBy(F.desc("grade")).collect():  # a few hundred rows at most
        room -= row["bytes"]
        if room < 0:
            break
        least = row["grade"]
    return graded.where(F.col("grade") >= least if least is not None else F.lit(False)).select("word")


def _coded(documents: DataFrame, text: str, path: str, value: Callable[[Column], Column], kind: str) -> DataFrame:
    """``documents`` with ``_coded``: ``value`` of the ids of each word of the text, in order. No shuffle of documents.

    The book comes as a scalar subquery, an array of small maps like the rank literal.
    """
    codes = stage(encode_words(book_words(documents, text), path), "word-codes")
    shelf = lambda word: F.pmod(F.hash(word), F.lit(CODE_SHELVES))
    filled = codes.groupBy(shelf(F.col("word")).alias("shelf")).agg(F.collect_list(F.struct("word", value(F.col("ids")).cast(kind).alias("code"))).alias("entries"))
    every = codes.sparkSession.range(CODE_SHELVES).select(F.col("id").cast("int").alias("shelf")).join(filled, "shelf", "left")
    shelves = every.agg(F.array_sort(F.collect_list(F.struct("shelf", F.coalesce("entries", F.array().cast(filled.schema["entries"].dataType)).alias("entries")))).alias("a"))
    book = shelves.select(F.transform("a", lambda x: F.map_from_entries(x["entries"])).alias("book"))
    words = words_of(F.coalesce(text, F.lit("")))

    def looked(literal: Column) -> Column:
        return _bind(F.col("_book"), lambda b: F.transform(words, lambda w: F.coalesce(F.get(b, shelf(w))[w], value(_folded(w, literal)).cast(kind))))

    return documents.withColumn("_book", book.scalar()).withColumn("_coded", _with_ranks(path, looked)).drop("_book")


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids): the token ids of every row, without special tokens.

    Null and empty texts have the empty list. The strings of special tokens are
    ordinary text. Rows that share a key are encoded separately; other columns are
    ignored. Texts of any length are encoded whole; one row holds all ids of its
    text. The fold of one word takes time in proportion to its length times the
    number of its different merges.
    """
    path = os.path.join(folder or TOKENIZERS, vocabulary)
    return _coded(documents.select(key, text), text, path, lambda ids: ids, "array<int>").select(key, F.flatten("_coded").alias("ids"))


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, tokens): the number of tokens of every key, over all its rows, by the same fold and book."""
    path = os.path.join(folder or TOKENIZERS, vocabulary)
    sizes = _coded(documents.select(key, text), text, path, F.size, "int")
    tokens = F.aggregate("_coded", F.lit(0).cast("bigint"), lambda total, n: total + n)
    return sizes.groupBy(key).agg(F.sum(tokens).alias("tokens"))


def decode(encoded: DataFrame, key: str = "doc_id", folder: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text): the texts of id lists. An id outside the vocabulary gives a null text."""
    table = ranks(os.path.join(folder or TOKENIZERS, vocabulary))
    pieces = [""] * (1 + max(rank for _, rank in table))
    for piece, rank in table:
        pieces[rank] = piece
    hexes = _bind(F.split(F.lit(",".join(pieces)), ","), lambda literal: F.transform("ids", lambda i: F.get(literal, i)))
    looked = encoded.select(key, hexes.alias("_hex"))
    return looked.select(key, F.when(~F.exists("_hex", lambda h: h.isNull()), F.decode(F.unhex(F.array_join("_hex", "")), "UTF-8")).alias("text"))
