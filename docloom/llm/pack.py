"""Texts into training containers of a fixed number of tokens, by bounded-space online best fit.

Each task packs the texts it reads, in one pass and without a shuffle: a fixed number of containers is open at a time,
held in a bitset keyed by their free room, so the tightest container that takes an item is one shift and one bit scan
away. When all are open and none takes the item, the fullest is closed. An item above the capacity is cut into full
containers of its own and one rest, which is packed like any item; no other item is cut.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the public tokenizer vocabularies are.
TOKENIZERS = "/opt/tokenizers"
CAPACITY, OPEN = 2048, 64
#: Splits a text into runs that tokens never cross.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}{1,64}| ?\p{N}{1,16}| ?[^\s\p{L}\p{N}]{1,64}|\s{1,32}(?!\S)|\s{1,32}"


class Packer:
    """Online best fit with at most ``slots`` open containers."""

    def __init__(self, capacity: int, slots: int):
        self.capacity, self.slots = capacity, slots
        self.free = 0  # bit f is set if a container with f free tokens is open
        self.open: dict[int, list[int]] = {}
        self.count = self.made = 0

    def add(self, size: int) -> tuple[int, int]:
        """The container of an item of 1 to ``capacity`` tokens, and where in it the item begins."""
        fits = self.free >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            box = self._take(room)
        else:
            if self.count == self.slots:  # close the fullest: the least room
                self._take((self.free & -self.free).bit_length() - 1)
            room, box = self.capacity, self.made
            self.made += 1
        left = room - size
        if left:
            self.open.setdefault(left, []).append(box)
            self.free |= 1 << left
            self.count += 1
        return box, self.capacity - room

    def _take(self, room: int) -> int:
        boxes = self.open[room]
        box = boxes.pop()
        if not boxes:
            del self.open[room]
            self.free &= ~(1 << room)
        self.count -= 1
        return box


def token_counter(vocabulary: str) -> Callable[[str], int]:
    """Tokens of a text in a ``.tiktoken`` vocabulary of byte-level BPE ranks."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    enc = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(enc.encode_ordinary(text))


def pack(df: DataFrame, key: str, text: str, *, capacity: int = CAPACITY, slots: int = OPEN, vocabulary: str = f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """``key, part_no, container_id, container_start, token_start, n_tokens``: where each text, or part of it, goes.

    ``container_id`` is (task << 40) + number in the task, ``container_start`` the place in the container,
    ``token_start`` the place in the text (more than 0 only for parts of a text above the capacity). Null texts take no
    part; an empty text has no token and gives no row; blank texts count as the tokens they have; repeated rows are
    packed each time. A text is never cut at less than the capacity, and no container exceeds it. Which container takes
    a text depends on how the input is split into tasks.
    """
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("part_no", T.IntegerType()), T.StructField("container_id", T.LongType()), T.StructField("container_start", T.IntegerType()), T.StructField("token_start", T.LongType()), T.StructField("n_tokens", T.IntegerType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, packer, base = token_counter(vocabulary), Packer(capacity, slots), TaskContext.get().partitionId() << 40
        for pdf in batches:
            rows = []
            for k, t in zip(pdf["key"], pdf["text"]):
                n = count(t)
                for part, at in enumerate(range(0, n, capacity)):
                    size = min(capacity, n - at)
                    box, where = packer.add(size)
                    rows.append((k, part, base + box, where, at, size))
            yield pd.DataFrame(rows, columns=schema.fieldNames())

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text is not null").mapInPandas(run, schema).withColumnRenamed("key", key)
