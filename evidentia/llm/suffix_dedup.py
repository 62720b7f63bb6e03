"""Removal of repeated byte strings by a prefix-aware distributed merge sort of suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a
smaller doc_id. Matches never cross documents.

Runs. Documents are packed, in reading order, into runs of a few MB of text. A run is one
compressed row, exchanged once by its number; every later pass reuses that exchange.

Which suffixes are worth sorting. In each window of ``LENGTH`` bytes the smallest hash of
``GRAM`` bytes marks an anchor; equal windows have equal anchors. The windows of one anchor form
a stretch. A run announces its distinct anchors by hash: hashes of the stretch and of the
gram with ``SIDE`` bytes to its left and to its right, and the smallest doc_id that has them.
Answers are flags. WHOLE: another run has the same stretch, so compare stretches; all but the
smallest document lose it entirely. LEFT, RIGHT: a different stretch of the anchor has the same
side (two equal windows must have one of them), so compare single windows that can reach
beyond that side, but only for the smallest document of the stretch. HOT: some run has more than ``SHOWN``
different stretches of the anchor; it announces just that, so no anchor gathers more than a
few rows of each run in one task, and each run sends all windows of it.

Merge sort. A run sorts its flagged suffixes (each begins with a stretch and ends where the
stretch does), keeps one of equal ones with its smallest doc_id, and deals them to
partitions by anchor; windows of hot anchors are dealt by the whole string, so that a
common phrase does not gather either. Slices are sent front-coded: length of the prefix
shared with the predecessor, and the rest. A partition adds the suffixes of flagged
stretches that start at their other windows to each slice, in order, and merges the slices
with a loser tree that keeps, for every player, the prefix it shares with the last winner:
players of different shared lengths are decided without looking at characters, others are
compared from that length on. Equal strings come out together; what goes back to a run is
one bit per suffix: a smaller doc_id has it.

Suffixes, anchors and bits are recomputed from the run, not shipped. A null text is empty. A
null doc_id ranks after all others and equals other nulls. Rows that repeat a doc_id do not
remove each other's text. Each row gets a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import common

LENGTH = 50
GRAM = 16
REACH = LENGTH - GRAM + 1  # places of a gram in a window
SIDE = (LENGTH - GRAM) // 2  # a window reaches so far beyond its gram on one side at least

WHOLE, LEFT, RIGHT, HOT = 1, 2, 4, 8

#: Different stretches of an anchor that a run announces one by one.
SHOWN = 64

#: Bytes of text of a run. Partitions of the merge get one slice from each run.
RUN_BYTES = 6 << 20

_NULL = (1 << 63) - 1
_BYTE = common.mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_SEGMENT = 1 << 18


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed byte planes, each behind its length."""
    parts = []
    for a in arrays:
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()
        parts += [len(planes).to_bytes(4, "little"), planes]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def expand(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 0
    for kind in kinds:
        dtype = np.dtype(kind)
        n = int.from_bytes(raw[at : at + 4], "little")
        planes = np.frombuffer(raw, dtype=np.uint8, count=n, offset=at + 4).reshape(dtype.itemsize, -1)
        out.append(np.ascontiguousarray(planes.T).view(dtype).reshape(-1))
        at += 4 + n
    return out


# Runs -------------------------------------------------------------------------


def packer(run_bytes: int):
    """Rows (run, ids, sizes, text): documents of a run in reading order, about ``run_bytes`` of text."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        number = 0
        ids: list[int | None] = []
        texts: list[bytes] = []
        size = 0

        def row() -> pa.RecordBatch:
            nonlocal number, size
            run = partition * (1 << 24) + number
            number += 1
            text = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([run], pa.int64()),
                    pa.array([ids.copy()], pa.list_(pa.int64())),
                    pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
                    pa.array([text], pa.binary()),
                ],
                ["run", "ids", "sizes", "text"],
            )
            ids.clear()
            texts.clear()
            size = 0
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                text = text.as_py() or b""
                if texts and size + len(text) > run_bytes:
                    yield row()
                ids.append(doc_id.as_py())
                texts.append(text)
                size += len(text)
        if texts:
            yield row()

    return pack


RUNS = "run long, ids array<long>, sizes array<long>, text binary"


class Run:
    """Documents of one run with the anchors of their windows."""

    def __init__(self, ids: list[int | None], sizes: list[int], text: bytes):
        self.raw_ids = ids
        self.ids = np.array([_NULL if i is None else i for i in ids], dtype=np.int64)
        self.sizes = np.array(sizes, dtype=np.int64)
        self.text = zstandard.ZstdDecompressor().decompress(text) if text else b""
        self.starts = np.cumsum(self.sizes) - self.sizes
        parts = [self._segment(first, last) for first, last in common.chunks(sizes, _SEGMENT)]
        columns = zip(*parts, strict=True) if parts else [()] * 6
        grams, content, lows, highs, at, docs = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns)
        grams, content = grams.astype(np.uint64), content.astype(np.uint64)
        # By gram, equal contents together. (Grams alike in 44 bits may mix: that only splits entries.)
        order = np.argsort(grams >> np.uint64(20) << np.uint64(20) | common.mixed(content) >> np.uint64(44))
        self.grams, content = grams[order], content[order]
        self.stretches = content >> np.uint64(32)
        self.lows, self.highs, self.at, self.docs = lows[order], highs[order], at[order], docs[order]
        # Entries: distinct (gram, content), but one alone for a gram that has more than SHOWN.
        n = len(order)
        new_gram = np.r_[True, self.grams[1:] != self.grams[:-1]][:n]
        new = new_gram | np.r_[True, content[1:] != content[:-1]][:n]
        gram_of = np.cumsum(new_gram) - 1
        hot = np.bincount(gram_of[new], minlength=0)[gram_of] > SHOWN if n else np.zeros(0, bool)
        first = np.flatnonzero(new & ~hot | new_gram)
        self.entry = np.searchsorted(first, np.arange(n), "right") - 1
        self.known = self.grams[first]
        self.hot = hot[first]
        self.content = np.where(self.hot, np.uint64(0), content[first])
        self.owner = np.minimum.reduceat(self.ids[self.docs], first) if n else np.zeros(0, np.int64)

    def _segment(self, first: int, last: int) -> tuple[np.ndarray, ...]:
        """Anchors of documents ``first`` to ``last`` - 1: gram, content, first and last window start, place, document.

        Content holds 32 bits of the stretch hash and 16 each of the left and right side (0: too near the
        end of the text).
        """
        base = int(self.starts[first])
        raw = np.frombuffer(self.text, dtype=np.uint8, count=int(self.sizes[first:last].sum()), offset=base)
        sizes = self.sizes[first:last]
        counts = np.maximum(sizes - LENGTH + 1, 0)
        if not counts.any():
            return tuple(np.zeros(0, k) for k in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64))
        sums = common.prefix_sums(_BYTE[raw])
        n = len(raw) - GRAM + 1
        grams = (sums[GRAM:] - sums[:n]) * common.powers(n)[1]
        grams = (grams ^ grams >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        bits = np.uint64(max(20, len(raw).bit_length()))
        keys = (grams >> bits << bits) | np.arange(n, dtype=np.uint64)
        width = 1
        while 2 * width <= REACH:
            keys = np.minimum(keys[: len(keys) - width], keys[width:])
            width *= 2
        if width < REACH:
            keys = np.minimum(keys[: len(keys) - (REACH - width)], keys[REACH - width :])
        # Windows that lie in one document, by their starts.
        starts = self.starts[first:last] - base
        row = np.repeat(np.arange(last - first), counts)
        windows = np.arange(len(row)) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
        anchor = (keys[windows] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])
        lows, highs = windows[new], windows[np.r_[new[1:], len(windows)] - 1]
        at, row = anchor[new], row[new]
        stretch = common.span_hashes(sums, lows, highs + LENGTH) >> np.uint64(32) << np.uint64(32)
        from_left, to_right = at - SIDE, at + GRAM + SIDE
        has_left, has_right = from_left >= starts[row], to_right <= starts[row] + sizes[row]
        left = common.span_hashes(sums, np.where(has_left, from_left, at), at + GRAM) >> np.uint64(48)
        right = common.span_hashes(sums, at, np.where(has_right, to_right, at)) >> np.uint64(48)
        left = np.where(has_left, left | np.uint64(1), np.uint64(0))
        right = np.where(has_right, right | np.uint64(1), np.uint64(0))
        # Anchors have small hashes: mixed once more, they spread evenly over buckets.
        return common.mixed(grams[at]), stretch | left << np.uint64(16) | right, lows + base, highs + base, at + base, row + first

    def dealt(self, buckets: int) -> np.ndarray:
        """Bucket of each entry; ascending, as the grams are."""
        return ((self.known >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)

    def repeated(self) -> np.ndarray:
        """Whether other documents of the run have the stretch of each anchor too."""
        groups = _Groups(self.grams ^ common.mixed(self.stretches))
        return groups.varies(self.ids[self.docs])

    def together(self, codes: np.ndarray) -> np.ndarray:
        """Codes with the sides that any entry of the same stretch has, so that a string has one home."""
        groups = _Groups(self.known ^ common.mixed(self.content >> np.uint64(32)))
        return codes | groups.most(codes & LEFT) | groups.most(codes & RIGHT)

    def suffixes(self, codes: np.ndarray, partitions: int, own: bool = False) -> dict[int, dict[bytes, list]]:
        """By partition: string -> [smallest id, range of windows that count too, (document, start) of each occurrence].

        With ``own``, stretches that only documents of this run share are in partition -1.
        """
        out: dict[int, dict[bytes, list]] = {}
        if not len(self.entry):
            return out
        code = self.together(codes)[self.entry]
        # A gram that is hot to this run has one entry: its occurrences all are.
        of = np.flatnonzero((code > 0) | self.repeated()) if own else np.flatnonzero(code)
        code, low, high, at = code[of], self.lows[of], self.highs[of], self.at[of]
        home = np.where(code > 0, (self.grams[of] % np.uint64(partitions)).astype(np.int64), -1)
        # Windows that can be shared: with the left side alone, or the right, they end or begin near the gram.
        first = np.where(code & LEFT, low, np.maximum(low, at - SIDE + 1)) - low
        last = np.where(code & RIGHT, high, np.minimum(high, at + GRAM + SIDE - 1 - LENGTH)) - low + 1
        first, last = np.where(code & (LEFT | RIGHT), (first, np.maximum(first, last)), 0)
        text, ids = self.text, self.ids.tolist()
        columns = (code, home, low, high, first, last, self.docs[of])
        for flags, partition, low, high, first, last, document in zip(*(c.tolist() for c in columns), strict=True):
            own = ids[document]
            if flags & HOT:
                for start in range(low, high + 1):
                    string = text[start : start + LENGTH]
                    partition = int.from_bytes(hashlib.blake2b(string, digest_size=6).digest(), "little") % partitions
                    seen = out.setdefault(partition, {}).setdefault(string, [own, (0, 0)])
                    seen[0] = min(seen[0], own)
                    seen.append((document, start))
                continue
            slot = out.setdefault(partition, {})
            string = text[low : high + LENGTH]
            seen = slot.get(string)
            if seen is None:
                slot[string] = [own, (first, last), (document, low)]
                continue
            seen[0] = min(seen[0], own)
            if last > first:
                a, b = seen[1]
                seen[1] = (min(a, first), max(b, last)) if b > a else (first, last)
            seen.append((document, low))
        return out


# Anchors: announce, judge -----------------------------------------------------


def _announcer(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = Run(row["ids"], row["sizes"], row["text"])
                bucket = own.dealt(buckets)
                gram = (own.known & np.uint64(0xFFFFFFFF)).astype("<u4")
                gram = np.diff(gram, prepend=np.uint32(0))  # wraps where a bucket begins; sums restore it
                base = int(own.ids.min())
                edges = np.searchsorted(bucket, np.arange(buckets + 1))
                numbers, blobs = [], []
                for b in np.unique(bucket).tolist():
                    part = slice(edges[b], edges[b + 1])
                    first = (own.known[edges[b]] & np.uint64(0xFFFFFFFF)).astype("<u4")
                    steps = gram[part].copy()
                    steps[0] = first
                    numbers.append(b)
                    blobs.append(
                        squeeze(steps, own.content[part], own.owner[part] - base, own.hot[part].astype(np.uint8), np.array([base]))
                    )
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["run"]] * len(numbers), pa.int64()), pa.array(numbers, pa.int64()), pa.array(blobs, pa.binary())],
                    ["run", "bucket", "blob"],
                )

    return run


class _Groups:
    """Rows by equal keys."""

    def __init__(self, key: np.ndarray):
        self.order = np.argsort(key)
        new = np.r_[True, np.diff(key[self.order]) != 0]
        self.firsts = np.flatnonzero(new)
        self.number = np.empty(len(key), dtype=np.uint64)
        self.number[self.order] = np.cumsum(new) - 1

    def least(self, value: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(value[self.order], self.firsts)[self.number]

    def most(self, value: np.ndarray) -> np.ndarray:
        return np.maximum.reduceat(value[self.order], self.firsts)[self.number]

    def varies(self, value: np.ndarray) -> np.ndarray:
        """Whether the rows of each row's group differ in ``value``."""
        return self.least(value) != self.most(value)


def flags_of(gram: np.ndarray, content: np.ndarray, owner: np.ndarray, hot: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Flags of all announced entries of a bucket."""
    gram = gram.astype(np.uint64)
    stretch, sides = content >> np.uint64(32), content & np.uint64(0xFFFFFFFF)
    stretches = _Groups(gram << np.uint64(32) | stretch)
    whole = stretches.varies(run)
    left, right = (
        _Groups(gram << np.uint64(16) | side).varies(stretch) & (side > 0) for side in (sides >> np.uint64(16), sides & np.uint64(0xFFFF))
    )
    first = owner == _Groups(stretches.number << np.uint64(32) | sides).least(owner)
    is_hot = _Groups(gram).most(hot) > 0
    return np.where(is_hot, HOT, whole * WHOLE + first * (left * LEFT + right * RIGHT)).astype(np.uint8)


def _judge(key: tuple, group: pa.Table) -> pa.Table:
    """Flags of a bucket's entries, for each run in the order it sent them."""
    runs = group.column("run").to_pylist()
    parts = [expand(b.as_py(), "<u4", "<u8", "<i8", "u1", "<i8") for b in group.column("blob")]
    sizes = [len(p[0]) for p in parts]
    gram = np.concatenate([np.cumsum(p[0], dtype=np.uint32) for p in parts])
    content = np.concatenate([p[1] for p in parts])
    owner = np.concatenate([p[2] + p[4] for p in parts])
    hot = np.concatenate([p[3] for p in parts])
    flags = flags_of(gram, content, owner, hot, np.repeat(np.arange(len(runs)), sizes))
    ends = np.cumsum(sizes)
    blobs = [squeeze(flags[end - size : end]) for end, size in zip(ends, sizes, strict=True)]
    n = len(runs)
    return pa.table(
        {
            "run": pa.array(runs, pa.int64()),
            "kind": pa.array([0] * n, pa.int64()),
            "part": pa.array([key[0].as_py()] * n, pa.int64()),
            "blob": pa.array(blobs, pa.binary()),
        }
    )


NOTES = "run long, kind long, part long, blob binary"


# Merge ------------------------------------------------------------------------


def front_coded(strings: list[bytes], owners: list[int], windows: list[tuple[int, int]]) -> bytes:
    """Sorted strings as shared prefix lengths, tail lengths and tails, with an id and a range of windows for each."""
    shared, lengths, tails = [], [], []
    last = b""
    for s in strings:
        n, most = 0, min(len(last), len(s))
        while n < most and last[n] == s[n]:
            n += 1
        shared.append(n)
        lengths.append(len(s) - n)
        tails.append(s[n:])
        last = s
    arrays = (
        np.array(shared, dtype="<u2"), np.array(lengths, dtype="<u2"), np.array(owners, dtype="<i8"),
        np.array([a for a, _ in windows], dtype=np.uint8), np.array([b for _, b in windows], dtype=np.uint8),
        np.frombuffer(b"".join(tails), dtype=np.uint8),
    )
    return squeeze(*arrays)


def decoded(blob: bytes) -> Iterator[tuple[bytes, int, int, int, int]]:
    """(string, prefix shared with the one before, id, first and end window) in order."""
    shared, lengths, owners, firsts, ends, tails = expand(blob, "<u2", "<u2", "<i8", "u1", "u1", "u1")
    raw, at, last = tails.tobytes(), 0, b""
    rows = zip(*(c.tolist() for c in (shared, lengths, owners, firsts, ends)), strict=True)
    for n, length, owner, first, end in rows:
        last = last[:n] + raw[at : at + length]
        at += length
        yield last, n, owner, first, end


class Slice:
    """A run's slice with the suffixes that start at counted windows of its stretches."""

    def __init__(self, blob: bytes):
        rows = list(decoded(blob))
        self.strings, self.owners = [r[0] for r in rows], [r[2] for r in rows]
        for string, _, owner, first, end in rows:
            self.strings += [string[i : i + LENGTH] for i in range(first, end)]
            self.owners += [owner] * (end - first)
        self.bits = bytearray(len(self.strings))
        self.places: list[int] = []

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(hash, self.strings), dtype=np.int64, count=len(self.strings))

    def sort(self, chosen: np.ndarray | None = None) -> None:
        """Order the chosen suffixes (all if not given)."""
        self.places = list(range(len(self.strings))) if chosen is None else chosen.tolist()
        self.places.sort(key=self.strings.__getitem__)

    def stream(self) -> Iterator[tuple[bytes, int, int]]:
        """(string, prefix shared with the one before, id) in order."""
        last = b""
        for place in self.places:
            string = self.strings[place]
            if string == last:
                n = len(string)
            else:
                n, most = 0, min(len(last), len(string))
                while n < most and last[n] == string[n]:
                    n += 1
            yield string, n, self.owners[place]
            last = string


def merged(streams: list[Iterator[tuple[bytes, int, int]]]) -> Iterator[tuple[bytes, int, int, int]]:
    """(string, prefix shared with the one before, id, stream) over all streams in order.

    ``shared[i]`` is the prefix that player i's string shares with the last winner (or, for a
    loser inside the tree, with the winner of its match). The longer one is the smaller string;
    only equal lengths are compared, from that length on.
    """
    k = 1
    while k < len(streams):
        k *= 2
    strings: list[bytes | None] = [None] * k
    shared, owners = [0] * k, [0] * k
    for i, stream in enumerate(streams):
        if first := next(stream, None):
            strings[i], _, owners[i] = first

    def beats(a: int, b: int) -> bool:
        """Whether a comes before b; sets what the loser shares with the winner."""
        x, y = strings[a], strings[b]
        if x is None or y is None:
            return y is None
        n = shared[a]
        if n != shared[b]:
            return n > shared[b]
        if x == y:
            shared[b] = len(y)
            return True
        most = min(len(x), len(y))
        while n < most and x[n] == y[n]:
            n += 1
        before = n == len(x) or n < len(y) and x[n] < y[n]
        shared[b if before else a] = n
        return before

    losers = [0] * k  # losers[0] is unused: the winner is at hand

    def play(node: int) -> int:
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        win, lose = (a, b) if beats(a, b) else (b, a)
        losers[node] = lose
        return win

    winner = play(1) if k > 1 else 0
    while (string := strings[winner]) is not None:
        yield string, shared[winner], owners[winner], winner
        following = next(streams[winner], None)
        if following is None:
            strings[winner] = None
        else:
            strings[winner], shared[winner], owners[winner] = following
        node = (winner + k) // 2
        while node:
            rival = losers[node]
            x, y = strings[winner], strings[rival]
            if y is not None and (
                x is None or shared[rival] > shared[winner] or shared[rival] == shared[winner] and not beats(winner, rival)
            ):
                losers[node] = winner
                winner = rival
            node //= 2


def settle(slices: list[Slice]) -> None:
    """Sets the bits of all suffixes that a smaller doc_id has as well.

    A suffix whose hash no other one has is equal to none and is not sorted.
    """
    hashes = [s.hashes() for s in slices]
    _, group, count = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    shared_hash = count[group] > 1
    at = 0
    for s, own in zip(slices, hashes, strict=True):
        s.sort(np.flatnonzero(shared_hash[at : at + len(own)]))
        at += len(own)
    seen = [0] * len(slices)
    equal: list[tuple[int, int, int]] = []

    def close() -> None:
        least = min(x[2] for x in equal)
        for stream, place, owner in equal:
            slices[stream].bits[place] = owner > least

    last = b""
    for string, shared, owner, stream in merged([s.stream() for s in slices]):
        if equal and not shared == len(string) == len(last):
            if len(equal) > 1:
                close()
            equal = []
        equal.append((stream, slices[stream].places[seen[stream]], owner))
        seen[stream] += 1
        last = string
    if len(equal) > 1:
        close()


def _merge(key: tuple, group: pa.Table) -> pa.Table:
    """Bits of each run's slice."""
    runs = group.column("run").to_pylist()
    slices = [Slice(b.as_py()) for b in group.column("blob")]
    settle(slices)
    n = len(runs)
    return pa.table(
        {
            "run": pa.array(runs, pa.int64()),
            "kind": pa.array([1] * n, pa.int64()),
            "part": pa.array([key[0].as_py()] * n, pa.int64()),
            "blob": pa.array([squeeze(np.packbits(np.frombuffer(s.bits, dtype=np.uint8))) for s in slices], pa.binary()),
        }
    )


# Passes over runs with notes --------------------------------------------------


def _codes(run: Run, notes: pa.Table, buckets: int) -> np.ndarray:
    bucket = run.dealt(buckets)
    codes = np.zeros(len(run.known), dtype=np.uint8)
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    for kind, part, blob in zip(*(notes.column(c).to_pylist() for c in ("kind", "part", "blob")), strict=True):
        if kind == 0:
            codes[edges[part] : edges[part + 1]] = expand(blob, "u1")[0]
    return codes


def _runs(table: pa.Table) -> Iterator[tuple[int, Run]]:
    for row in table.to_pylist():
        yield row["run"], Run(row["ids"], row["sizes"], row["text"])


def _sender(buckets: int, partitions: int):
    def send(runs: pa.Table, notes: pa.Table) -> pa.Table:
        numbers, parts, blobs = [], [], []
        for number, run in _runs(runs):
            for part, strings in sorted(run.suffixes(_codes(run, notes, buckets), partitions).items()):
                order = sorted(strings)
                numbers.append(number)
                parts.append(part)
                blobs.append(front_coded(order, [strings[s][0] for s in order], [strings[s][1] for s in order]))
        return pa.table(
            {"run": pa.array(numbers, pa.int64()), "part": pa.array(parts, pa.int64()), "blob": pa.array(blobs, pa.binary())}
        )

    return send


def _remover(buckets: int, partitions: int, with_kept: bool):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def remove(runs: pa.Table, notes: pa.Table) -> pa.Table:
        ids: list = []
        sizes: list = []
        spans: list = []
        hashes: list = []
        kept: list = []
        for _, run in _runs(runs):
            bits = {
                part: np.unpackbits(expand(blob, "u1")[0])
                for k, part, blob in zip(*(notes.column(c).to_pylist() for c in ("kind", "part", "blob")), strict=True)
                if k == 1
            }
            marks = np.zeros(len(run.text) + 1, dtype=np.int32)
            own = run.ids.tolist()
            starts, ends = [], []
            for part, strings in run.suffixes(_codes(run, notes, buckets), partitions, own=True).items():
                order = sorted(strings) if part >= 0 else list(strings)
                said = bits[part] if part >= 0 else np.zeros(len(order), dtype=np.uint8)
                after = len(order)  # bits of windows follow those of strings
                for string, elsewhere in zip(order, said[: len(order)].tolist(), strict=True):
                    least, (first, end), *places = strings[string]
                    alone = (np.flatnonzero(said[after : after + end - first]) + first).tolist() if end > first else ()
                    after += end - first
                    for document, start in places:
                        if elsewhere or own[document] > least:
                            starts.append(start)
                            ends.append(start + len(string))
                        else:
                            starts += [start + i for i in alone]
                            ends += [start + i + LENGTH for i in alone]
            np.add.at(marks, starts, 1)
            np.add.at(marks, ends, -1)
            gone = np.cumsum(marks[:-1]) > 0
            for i, (start, size) in enumerate(zip(run.starts.tolist(), run.sizes.tolist(), strict=True)):
                part = gone[start : start + size]
                edges = np.flatnonzero(np.diff(np.r_[False, part, False]))
                found = edges.reshape(-1, 2).tolist()
                text = run.text[start : start + size]
                if found:
                    text = np.frombuffer(text, dtype=np.uint8)[~part].tobytes()
                ids.append(run.raw_ids[i])
                sizes.append(size)
                spans.append([{"start": a, "end": b} for a, b in found])
                hashes.append(hashlib.sha256(text).hexdigest())
                kept.append(text if with_kept else None)
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "n_bytes": pa.array(sizes, pa.int64()),
                "spans": pa.array(spans, kind),
                "kept_sha256": pa.array(hashes, pa.string()),
                "kept": pa.array(kept, pa.binary()),
            }
        )

    return remove


REMOVED = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept_sha256 string, kept binary"


def remove_repeats(documents: DataFrame, with_kept: bool = False, run_bytes: int = RUN_BYTES) -> DataFrame:
    """doc_id, n_bytes, removed spans, hash of the kept bytes and, if asked for, these bytes, of every row."""
    spark = documents.sparkSession
    source = documents.select("doc_id", F.col("text").cast("binary").alias("text"))
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), source.rdd.getNumPartitions())
    runs = source.mapInArrow(packer(run_bytes), RUNS).repartition(partitions, "run")
    said = runs.mapInArrow(_announcer(partitions), "run long, bucket long, blob binary")
    codes = said.groupBy("bucket").applyInArrow(_judge, NOTES)
    by_run = runs.groupBy("run")
    slices = by_run.cogroup(codes.groupBy("run")).applyInArrow(
        _sender(partitions, partitions), "run long, part long, blob binary"
    )
    bits = slices.groupBy("part").applyInArrow(_merge, NOTES)
    notes = codes.unionAll(bits)
    return by_run.cogroup(notes.groupBy("run")).applyInArrow(_remover(partitions, partitions, with_kept), REMOVED)


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(common.table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256"
    )
