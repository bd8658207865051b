"""Best-fit packing planned on a histogram of lengths.

Texts are tokenized once into pieces of at most the capacity; only the count of pieces by length (capacity rows at most) reaches the
driver, where best-fit decreasing runs over counts: a step places all pieces of a length that fit into bins of one remaining room.
The plan is a table of slot runs by length and rank. Pieces are ranked within their length and take the planned slot by a join on
length and block of ranks. A length that many pieces share is ranked in salted parts, whose sizes are added up first.

Edge cases: a null or empty text is the end id alone, one piece; rows of one id are packed each on its own (their pieces repeat the
same keys); an empty table gives no rows; further columns are ignored; a text is cut only if longer than the capacity.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, materialize, texts

CAPACITY = 2048
END = 0
#: Words, and pieces of words, whose ids a worker remembers; beyond it, it starts afresh.
REMEMBERED = 800_000
#: Pieces in a part of one length that one task ranks, on average at most.
PART = 250_000
#: Ranks in a block: a run of slots meets its pieces by length and block of ranks.
RANKS = 1 << 16

#: Python's white space that the tokenizer takes for characters.
_ODD = re.compile("[\x1c-\x1f]")
#: Words that the tokenizer's normalizer only puts into lower case.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: How the tokenizer cuts such a word in lower case.
_CUT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


#: The normalizer and the pattern of words that ``WordTokenizer`` stands for.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it can be printed, else the next free one from 256 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordTokenizer:
    """Ids of whole texts for a tokenizer that never joins characters across white space: ids of a text are those of its words in turn.
    Any other tokenizer is an error.

    Words' ids are kept as bytes (unsigned 32-bit, little-endian), so a text costs a look-up a word. A new word of Latin letters and
    printable ASCII is cut as the tokenizer cuts it and each piece goes to the tokenizer's model, for pieces repeat more than words do;
    any other word, and a text with odd white space, goes to the tokenizer itself.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self._must_cut_by_words(path)
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        letters = _byte_letters()
        self.letters = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0x21, 0x100)}
        self.model = self.tokenizer.model

    def _must_cut_by_words(self, path: str) -> None:
        """A tokenizer of another kind would get wrong ids word by word."""
        made = json.loads(self.tokenizer.to_str())
        normalizers = (made["normalizer"] or {}).get("normalizers")
        cut, *letters = (made["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        if normalizers != _NORMALIZERS or cut.get("pattern") != {"Regex": _PATTERN} or [x.get("type") for x in letters] != ["ByteLevel"] or letters[0]["add_prefix_space"]:
            raise ValueError(f"{path}: not a tokenizer that lowers, and cuts at white space, as this packing needs")

    def _bytes(self, values: list[str]) -> list[bytes]:
        # Small batches: what encode_batch returns holds far more than ids.
        out: list[bytes] = []
        for k in range(0, len(values), 4096):
            out += [b"".join(i.to_bytes(4, "little") for i in e.ids) for e in self.tokenizer.encode_batch(values[k : k + 4096], add_special_tokens=False)]
        return out

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(piece.translate(self.letters))])
            self.pieces[piece] = ids
        return ids

    def _learn(self, words: set[str]) -> None:
        if len(self.words) > REMEMBERED:
            self.words.clear()
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        other = []
        for word in words.difference(self.words):
            if _PLAIN.fullmatch(word) and "<|" not in word:
                self.words[word] = b"".join(map(self._piece, _CUT.findall(word.lower())))
            else:
                other.append(word)
        self.words.update(zip(other, self._bytes(other)))

    def encode(self, text: str) -> bytes:
        if _ODD.search(text):
            return self._bytes([text])[0]
        words = text.split()
        try:
            return b"".join(map(self.words.__getitem__, words))
        except KeyError:
            self._learn(set(words))
            return b"".join(map(self.words.__getitem__, words))


@cache
def _word_tokenizer(path: str) -> WordTokenizer:
    """One a worker, so that tasks after the first know its words."""
    return WordTokenizer(path)


def tokenize(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """The pieces of each row: doc_id, piece, start, length and the CRC-32 of its ids."""
    bounded_batches(docs.sparkSession)
    path, end = tokenizer or default_tokenizer(), END.to_bytes(4, "little")
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_tokenizer(path)
        for b in batches:
            at, rows = [], []
            for k, text in enumerate(texts(b.column("text"))):
                ids = words.encode(text) + end
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[start : start + 4 * capacity]
                    at.append(k)
                    rows.append((piece, start // 4, len(own) // 4, zlib.crc32(own)))
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64())))], names
            )

    return docs.select("doc_id", "text").mapInArrow(pieces, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths.

    Gives runs (length, first rank, pieces, first sequence, pieces a sequence, offset of the first in a sequence). Bins with the same
    room left are alike, for a piece stands where the room before it ends; so the state is, for each room, runs of sequence numbers.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}  # room left: runs (first sequence, bins)
    sizes: list[int] = []  # rooms in use, ascending
    slots, sequences = [], 0

    def keep(room: int, first: int, bins: int) -> None:
        if bins and room:
            if room not in rooms:
                rooms[room] = []
                insort(sizes, room)
            rooms[room].append((first, bins))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            k = bisect_left(sizes, length)
            if k < len(sizes):
                room = sizes[k]
                first, bins = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], sizes[k]
            else:
                # New bins, as many as the rest of this length needs.
                room = capacity
                first, bins = sequences, -(-left // (capacity // length))
                sequences += bins
            each = room // length
            full = min(bins, left // each)
            rest = min(left - full * each, each - 1) if full < bins else 0
            slots.append((length, rank, full * each + rest, first, each, capacity - room))
            rank, left = rank + full * each + rest, left - full * each - rest
            keep(room - each * length, first, full)
            if rest:
                keep(room - rest * length, first + full, 1)
            keep(room, first + full + bool(rest), bins - full - bool(rest))
    return slots


def ranked(pieces: DataFrame, parts: int) -> DataFrame:
    """pieces with rank (from 0) within their length: each length in parts by the salt of each row, the parts' sizes summed before each.
    Ids that repeat or are null are salted like any other."""
    part = F.pmod("salt", F.lit(parts)).cast("int")
    salted = pieces.withColumn("part", part)
    sizes = salted.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = sizes.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32"))
    own = salted.withColumn("place", place)
    return own.join(materialize(before, "rank-offsets"), ["length", "part"]).withColumn("rank", F.col("before") + F.col("place") - 1).drop("part", "place", "before", "salt")


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """A row for each piece with its sequence and its offset there."""
    spark = docs.sparkSession
    # The salt is a hash of the row's number, written with it, so that it stays what it is when a task runs again.
    pieces = materialize(tokenize(docs, capacity, tokenizer).withColumn("salt", F.xxhash64(F.monotonically_increasing_id())), "pieces")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    slots = spark.createDataFrame(plan(histogram, capacity), "length long, first_rank long, n long, first_sequence long, each long, first_offset long")
    parts = max(64, -(-sum(histogram.values()) // PART))
    # Length and block are equal keys, so Spark may broadcast the runs, by its own check of their size, or shuffle both sides.
    slots = slots.withColumn("block", F.explode(F.sequence(F.floor(F.col("first_rank") / RANKS), F.floor((F.col("first_rank") + F.col("n") - 1) / RANKS))))
    rank, inside = F.col("rank"), F.col("rank") - F.col("first_rank")
    both = ranked(pieces, parts).withColumn("block", F.floor(F.col("rank") / RANKS)).join(slots, ["length", "block"])
    placed = both.where((rank >= F.col("first_rank")) & (rank < F.col("first_rank") + F.col("n")))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.floor(inside / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + inside % F.col("each") * F.col("length")).alias("offset"),
    )
