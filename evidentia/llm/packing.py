"""Packing of token sequences: shortest-pack-first over the length histogram.

Documents are tokenised and closed with an end id. A document longer than a sequence
is cut into full pieces and a rest. Pieces are packed by length alone: only the
histogram (one row per length, at most ``max_length`` rows) reaches the driver. There,
lengths are placed longest first, always into the emptiest open pack that holds them,
and whole groups of equal packs move at once as a pattern with a count. The patterns
are an interval table per length (bounded by ``max_length``, not by the data), which
maps the rank of a piece among those of its length to its sequence and offset.

Ranks come from counts per (length, bucket) and a numbering inside each bucket, so a
length that a third of all pieces share is ranked by many tasks.

Null text is an empty text: its only token is the end id. Repeated rows and null ids are
documents of their own. Pieces of one length are alike for the packing, so ties may fall
either way between runs; every id is still in exactly one piece. A very long text is
tokenised whole by one task and becomes many pieces. Other columns are ignored. Empty
tables give no pieces.
"""

from __future__ import annotations

import functools
import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm import common

MAX_LENGTH = 1024
END_ID = 0

#: Chunks of text whose ids are kept in a task; the cache starts anew beyond it.
KEPT = 300_000

#: Pieces that one bucket of a length holds on average at most.
BUCKET = 20_000


@functools.cache
def _byte_of() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: White space other than a space or a line break, and all that Python alone takes for white space.
_ODD = tuple(c for c in map(chr, range(0x10000)) if c.isspace() and c not in " \n")
_EDGES = ("", " ", "\n")


def evenly_spaced(text: str) -> bool:
    """Whether all white space of ``text`` is one space or one line break between other characters."""
    if text[:1] in _EDGES or text[-1:] in _EDGES or any(c in text for c in _ODD):
        return False
    return not any(pair in text for pair in ("  ", " \n", "\n ", "\n\n"))


class Encoder:
    """Ids of a byte-level BPE file, as little-endian unsigned 32-bit values.

    A text whose white space is single spaces and line breaks between other characters is
    cut before each of them. No pre-token of this tokeniser's pattern crosses such a place,
    so the chunks are encoded one by one and remembered. Texts with any other white space
    are encoded whole; those with a special token's string by the tokeniser itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = _byte_of()
        special = {x["content"] for x in spec.get("added_tokens", ())}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.special = tuple(special)
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if not evenly_spaced(text):
            return np.array(self.fast.encode_ordinary(text), dtype="<u4").tobytes()
        first, *rest = text.replace("\n", " \n").split(" ")
        head = np.array(self.fast.encode_ordinary(first), dtype="<u4").tobytes()
        known = self.known
        try:
            return head + b"".join(map(known.__getitem__, rest))
        except KeyError:
            pass
        if len(known) > KEPT:
            known.clear()
        encode = self.fast.encode_ordinary
        for part in set(rest).difference(known):
            known[part] = np.array(encode(part if part[0] == "\n" else " " + part), dtype="<u4").tobytes()
        return head + b"".join(map(known.__getitem__, rest))


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _cutter(path: str, max_length: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encoder.ids(text or "") + end
                for at in range(0, len(ids), 4 * max_length):
                    piece = ids[at : at + 4 * max_length]
                    row = (doc_id, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, piece)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            arrays = [pa.array(c, pa.int64()) for c in out[:5]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(x, dtype="<u4").tolist() for x in out[5]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def pieces(
    documents: DataFrame, tokenizer: str, max_length: int = MAX_LENGTH, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """Pieces of at most ``max_length`` ids, with the ids themselves if asked for."""
    source = documents.select("doc_id", "text")
    return source.mapInArrow(_cutter(tokenizer, max_length, end_id, with_ids), PIECES + ", ids array<int>" * with_ids)


def patterns(histogram: dict[int, int], max_length: int = MAX_LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths, longest first) with their counts.

    Longest lengths first; each goes into the shortest pack that is open. A pattern of the same
    lengths splits when fewer pieces than packs are left.
    """
    open_packs: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by room
    rooms: list[int] = []  # heap of negated rooms
    done: dict[tuple[int, ...], int] = {}

    def put(room: int, pattern: tuple[int, ...], count: int) -> None:
        if count and room:
            if room not in open_packs:
                open_packs[room] = []
                heappush(rooms, -room)
            open_packs[room].append((pattern, count))
        elif count:
            done[pattern] = done.get(pattern, 0) + count

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if rooms and -rooms[0] >= length:
                room = -rooms[0]
                pattern, count = open_packs[room].pop()
                if not open_packs[room]:
                    del open_packs[room]
                    heappop(rooms)
                fits = min(count, left)
                put(room, pattern, count - fits)
                put(room - length, (*pattern, length), fits)
                left -= fits
            else:  # new packs, each filled before the next
                each = max_length // length
                put(max_length - each * length, (length,) * each, left // each)
                put(max_length - left % each * length, (length,) * (left % each), int(left % each > 0))
                left = 0
    for groups in open_packs.values():
        for pattern, count in groups:
            done[pattern] = done.get(pattern, 0) + count
    return sorted(done.items(), reverse=True)


def intervals(packed: list[tuple[tuple[int, ...], int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """By length: (first rank, packs, first sequence, first offset) of every stretch of ranks.

    Rank r of a stretch is in sequence ``first + (r - first rank) % packs`` and, if the
    pattern holds the length more than once, ``(r - first rank) // packs`` lengths further.
    """
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for pattern, count in packed:
        offset = at = 0
        while at < len(pattern):
            length = pattern[at]
            times = 1
            while at + times < len(pattern) and pattern[at + times] == length:
                times += 1
            first = ranks.get(length, 0)
            out.setdefault(length, []).append((first, count, sequence, offset))
            ranks[length] = first + times * count
            offset += times * length
            at += times
        sequence += count
    return out


def _placer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {k: ([x[0] for x in v], v) for k, v in shared.value.items()}
        for batch in batches:
            sequences, offsets = [], []
            for length, rank in zip(batch.column("length").to_pylist(), batch.column("rank").to_pylist(), strict=True):
                firsts, rows = table[length]
                first, packs, sequence, offset = rows[bisect_right(firsts, rank) - 1]
                times, pack = divmod(rank - first, packs)
                sequences.append(sequence + pack)
                offsets.append(offset + times * length)
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())],
                [*names, "sequence_id", "offset"],
            )

    return run


def pack(cut_pieces: DataFrame, max_length: int = MAX_LENGTH) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``, from a frame with a ``length``."""
    spark = cut_pieces.sparkSession
    # The checkpoint fixes the pieces, so that ranks agree between passes and retries.
    rows = common.cut(cut_pieces.withColumn("__uid", F.monotonically_increasing_id()))
    counts = {int(r[0]): int(r[1]) for r in rows.groupBy("length").count().collect()}
    buckets = max(8, -(-sum(counts.values()) // BUCKET))
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64("__uid"), F.lit(buckets)))
    sizes = rows.groupBy("length", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = F.row_number().over(Window.partitionBy("length", "__bucket").orderBy("__uid")) - 1
    ranked = rows.withColumn("__inside", inside).join(bases, ["length", "__bucket"])
    ranked = ranked.withColumn("rank", F.col("__base") + F.col("__inside"))
    ranked = ranked.select(*cut_pieces.columns, "rank")
    shared = spark.sparkContext.broadcast(intervals(patterns(counts, max_length)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut_pieces.schema.fields)
    return ranked.mapInArrow(_placer(shared), schema + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """Whole sequences from ``pack`` of pieces with ids: sequence_id, ids (at most max_length)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))


def pack_documents(documents: DataFrame, tokenizer: str, max_length: int = MAX_LENGTH, with_ids: bool = False) -> DataFrame:
    return pack(pieces(documents, tokenizer, max_length, with_ids=with_ids), max_length)


def public_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"), public_tokenizer())
