"""Best-fit packing of whole documents into sequences of a fixed number of tokens.

Tasks tokenize the texts and write one narrow row a piece: ids, a piece's place in its document, its
length and checksum. The lengths are counted (as many counts as a sequence has places, so the driver
may hold them) and ``bin_plan`` says which kinds of sequences there are. A piece finds its sequence
by its rank among the pieces of its length. Ranks come without a group that grows: pieces of a
common length are dealt by hash into parts of a counted size, a part's first rank is the sum of
the parts before it, and rows are numbered within parts.

Defined results: a null text is empty; an empty text is the separator alone, one piece of length 1;
null and repeated ids do not matter, every row is packed; rows of equal texts are packed each. A
document of more than ``capacity`` ids is cut from its end, so that its first piece alone may be
shorter. An empty table gives no rows. Columns of other names are not read.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bin_plan import Kind, plan
from .common import documents, materialised
from .kernel import pieces as cut_batches

CAPACITY = 2048
SEPARATOR = 0
#: Fixed value: how a byte-level tokenizer splits text before the merges.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Ids of texts by the tokenizer of a file.

    A byte-level BPE is run by tiktoken on the file's own vocabulary, which gives the same ids in a
    third of the time if later merges make larger ids; this is looked up. Whatever else the file
    says, and a text that tiktoken refuses, goes to tokenizers itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.fast = byte_pairs(json.load(file))

    def ids(self, text: str) -> np.ndarray:
        if self.fast:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all")
            except ValueError:  # a run of white space beyond the stack of its regular expressions
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


def byte_pairs(made: dict):
    """A tiktoken encoding of a tokenizer file's contents, or None if that would not be the same."""
    model, before = made["model"], made.get("pre_tokenizer") or {}
    plain = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "ignore_merges": False}
    added = made.get("added_tokens") or []
    if (
        any((model.get(k) or None) != (v or None) for k, v in plain.items()) or any(made.get(k) for k in ("normalizer", "truncation", "padding"))
        or before.get("type") != "ByteLevel" or not before.get("use_regex", True) or before.get("add_prefix_space")
        or any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
    ):
        return None
    import tiktoken

    special = {t["content"]: t["id"] for t in added}
    vocabulary = {w: i for w, i in model["vocab"].items() if w not in special}
    ids = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    if any(a >= b for a, b in zip(ids, ids[1:])) or len(ids) + 256 != len(vocabulary):
        return None
    # bytes that have no visible character are spelled by the characters from 256
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    return tiktoken.Encoding("vocabulary", pat_str=WORDS, mergeable_ranks={bytes(byte[c] for c in w): i for w, i in vocabulary.items()}, special_tokens=special)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row. ``tokenizer``: a file that all executors have."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in cut_batches(batches):
            rows, piece, start, length, sums = [], [], [], [], []
            for row, text in enumerate(batch.column("text")):
                ids = np.append(encode.ids(text.as_py() or ""), np.uint32(separator)).astype("<u4")
                edges = list(range(len(ids), 0, -capacity))[::-1]
                for k, (a, b) in enumerate(zip([0, *edges], edges)):
                    rows.append(row)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    sums.append(zlib.crc32(ids[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, sums))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def rank_runs(kinds: list[Kind], capacity: int) -> np.ndarray:
    """Rows (length, first rank, in each bin, first bin, first offset): which bins the ranks of a length go to."""
    used, out, first = [0] * (capacity + 1), [], 0
    for kind in kinds:
        offset = 0
        for length, each in kind.holds:
            out.append((length, used[length], each, first, offset))
            used[length] += each * kind.bins
            offset += each * length
        first += kind.bins
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def ranked(pieces: DataFrame, counts: np.ndarray) -> DataFrame:
    """``pieces`` with ``rank``: 0, 1, ... among the rows of the same length. Parts of a length are as
    large as a quarter of an even share of the shuffle's partitions, so there are at most four a
    partition besides one a length, and their first ranks may be broadcast."""
    share = max(1, -(-int(counts.sum()) // (4 * int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    common = [F.lit(x) for length, c in enumerate(counts.tolist()) if c > share for x in (length, -(-c // share))]
    parts = F.coalesce(F.try_element_at(F.create_map(*common), F.col("length").cast("int")), F.lit(1)) if common else F.lit(1)
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("row_no"), parts).cast("int"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).select("length", "part", before.alias("first"))
    number = F.row_number().over(Window.partitionBy("length", "part").orderBy("row_no"))
    return dealt.withColumn("number", number).join(F.broadcast(firsts), ["length", "part"]).withColumn("rank", F.col("first") + F.col("number") - 1).drop("part", "first", "number")


def placed(pieces: DataFrame, kinds: list[Kind], capacity: int = CAPACITY) -> DataFrame:
    """Ranked pieces with sequence_id and offset."""
    runs = rank_runs(kinds, capacity)
    order = runs[:, 0] << 48 | runs[:, 1]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            run = runs[np.searchsorted(order, length << 48 | rank, "right") - 1]
            nth, each = rank - run[:, 1], run[:, 2]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(run[:, 3] + nth // each), pa.array(run[:, 4] + nth % each * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(look_up, PIECES + ", sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    # the number of a row is written, so that ranks stand whatever is computed again
    pieces = materialised(token_pieces(docs, tokenizer, capacity).withColumn("row_no", F.monotonically_increasing_id()))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        counts[length] = n
    return placed(ranked(pieces, counts), plan(counts), capacity)


def op13(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
