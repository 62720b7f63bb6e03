"""Token counts under a unigram model, by dynamic programming over a trie.

A pre-token is a word (white space of ASCII ends it) with one space before it. Its
tokens are the cheapest sequence of vocabulary pieces; a piece of rank r costs
``round(1000 * ln(r + 1))``, and of equally cheap sequences the shortest counts.

Each task collects the distinct pre-tokens of a block of texts. Sorted, they are the
leaves of their trie in depth-first order: the forward costs along the open path are
kept on a stack, a branch drops what lies below the shared prefix, and so every trie
node's cost is computed once, however many words pass through it. The terminal of a
word stores its token count, which texts then add up. Nothing is shuffled.

Null and empty texts have no tokens. Repeated rows each get a row.
"""

from __future__ import annotations

import base64
import functools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm import common

_SPACES = b" \t\n\r\x0b\x0c"

_SHIFT = 1 << 32  # cost above, tokens below: the smaller sum is cheaper, then shorter

#: Terminals kept between blocks; more are computed anew.
KEPT = 400_000


@functools.cache
def vocabulary(path: str) -> tuple[dict[bytes, int], int]:
    """Price of each piece of a rank file (base64 piece and rank on a line) and the longest piece."""
    prices = {}
    with open(path, "rb") as lines:
        for line in lines:
            piece, rank = line.split()
            piece = base64.b64decode(piece)
            if piece[1:].translate(None, _SPACES) == piece[1:]:  # the only space of a pre-token is in front
                prices[piece] = round(1000 * math.log(int(rank) + 1)) * _SHIFT + 1
    return prices, max(map(len, prices))


def terminal_counts(words: list[bytes], prices: dict[bytes, int], longest: int) -> dict[bytes, int]:
    """Tokens of each distinct word; ``words`` in ascending order."""
    get = prices.get
    out: dict[bytes, int] = {}
    forward = [0]
    last = b""
    for word in words:
        shared, most = 0, min(len(last), len(word))
        while shared < most and last[shared] == word[shared]:
            shared += 1
        del forward[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            best = -1
            for start in range(max(0, end - longest), end):
                price = get(word[start:end])
                if price is not None:
                    price += forward[start]
                    if best < 0 or price < best:
                        best = price
            forward.append(best)
        out[word] = forward[-1] % _SHIFT
        last = word
    return out


def _counter(path: str, shipped: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prices, longest = vocabulary(SparkFiles.get(path) if shipped else path)
        known: dict[bytes, int] = {}
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n_words, n_tokens = [], []
            for start, end in common.chunks([len(t or b"") for t in texts], 8 * common.CHUNK):
                split = [(t or b"").split() for t in texts[start:end]]
                new = set().union(*split).difference(known)
                if len(known) + len(new) > KEPT:
                    known = {}
                    new = set().union(*split)
                terminals = terminal_counts(sorted(b" " + w for w in new), prices, longest)
                known.update((w[1:], n) for w, n in terminals.items())
                n_words += map(len, split)
                n_tokens += [sum(map(known.__getitem__, words)) for words in split]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())],
                ["doc_id", "n_words", "n_tokens"],
            )

    return run


def count_tokens(documents: DataFrame, ranks: str, shipped: bool = False) -> DataFrame:
    """doc_id, n_words and n_tokens of every document row.

    ``ranks`` is the vocabulary's path on every node, or with ``shipped`` the name of a
    file sent along by ``SparkContext.addFile``.
    """
    source = documents.select("doc_id", F.col("text").cast("binary").alias("text"))
    return source.mapInArrow(_counter(ranks, shipped), "doc_id long, n_words long, n_tokens long")


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
