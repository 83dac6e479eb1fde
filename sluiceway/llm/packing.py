"""Filling fixed-capacity containers with texts (problem 6).

Method: sum-of-squares packing. Among the open containers with room, a text goes where
the sum over gaps g of (open containers with gap g) squared becomes smallest; opening a
new container is one of the choices. Texts are sized in tokens of a public tokenizer;
only a text that alone exceeds the capacity is cut, at token boundaries.

Scale: sizes are packed in independent lanes, each a bounded number of texts in one task
(``lane_items``); lanes grow with the data, so no group grows without bound and no key is
hot (the lane is a hash of the text's id). What a lane leaves in badly filled containers
is packed once more in fewer, again bounded lanes. Only ids and sizes are shuffled, never
texts.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
LANE_ITEMS = 10_000
MOST_PARTITIONS = 20_000
#: Containers of the first round filled less than this share are opened and packed again.
REPACK_BELOW = 0.98
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public byte-level pattern that the vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, path: str) -> list[int]:
    """Token ids of the whole of ``text``; what has no UTF-8 form (lone surrogates) is read as a question mark."""
    return tokenizer(path).encode_ordinary(text.encode("utf-8", "replace").decode("utf-8"))


def token_sizes(df: DataFrame, key: str, text: str, path: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """One row per (text, part): ``key``, ``part`` (0 unless cut), ``first_token``, ``n_tokens`` (1 to capacity).

    Null texts and texts without tokens have no row: they take no room.
    """
    import pyarrow as pa

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts, firsts, ns = [], [], [], []
            for k, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = len(encode(s, path)) if s else 0
                for part, first in enumerate(range(0, n, capacity)):
                    ids.append(k)
                    parts.append(part)
                    firsts.append(first)
                    ns.append(min(capacity, n - first))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), pa.array(parts, pa.int32()), pa.array(firsts, pa.int64()), pa.array(ns, pa.int32())],
                names=["key", "part", "first_token", "n_tokens"],
            )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(sizes, f"key {kind}, part int, first_token bigint, n_tokens int")


def pack_sizes(sizes: list[int], capacity: int = CAPACITY) -> list[int]:
    """Sum-of-squares packing of ``sizes`` in their order: the number of the container of each.

    Moving an open container from gap g to gap g-s changes the sum of squares by
    2*(N[g-s]-N[g]+1), or by 1-2*N[g] when it gets full; opening one for a text of s by
    2*N[c-s]+1. Ties go to the fullest container.
    """
    import numpy as np

    counts = np.zeros(capacity + 1, dtype=np.int64)  # open containers by gap; gap 0 is full and doesn't count
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, made = [], 0
    for s in sizes:
        if not 0 < s <= capacity:
            raise ValueError(f"a size of {s} doesn't fit a capacity of {capacity}")
        gaps = np.flatnonzero(counts[s:]) + s  # gaps with room, the smallest first
        best, gap = (2 * int(counts[capacity - s]) + 1 if s < capacity else 0), capacity
        if gaps.size:
            now, then = counts[gaps], counts[gaps - s]
            delta = np.where(gaps == s, 1 - 2 * now, 2 * (then - now + 1))
            i = int(np.argmin(delta))
            if delta[i] <= best:
                best, gap = int(delta[i]), int(gaps[i])
        if gap == capacity:
            bin_id, made = made, made + 1
        else:
            bin_id = open_at[gap].pop()
            counts[gap] -= 1
        left = gap - s
        if left:
            open_at[left].append(bin_id)
            counts[left] += 1
        where.append(bin_id)
    return where


def _pack_lanes(items: DataFrame, lanes: int, prefix: str, capacity: int) -> DataFrame:
    import pandas as pd

    kind = items.schema["key"].dataType.simpleString()

    def pack(lane: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["n_tokens", "key", "part"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        bins = pd.Series(pack_sizes(g["n_tokens"].tolist(), capacity))
        by = g["n_tokens"].groupby(bins)
        return pd.DataFrame({
            "container": prefix + str(lane[0]) + "-" + bins.astype(str), "key": g["key"], "part": g["part"], "first_token": g["first_token"],
            "n_tokens": g["n_tokens"], "position": by.cumcount().astype("int32"), "offset": (by.cumsum() - g["n_tokens"]).astype("int32"), "filled": by.transform("sum").astype("int32"),
        })

    laned = items.withColumn("lane", F.pmod(F.xxhash64("key", "part"), F.lit(lanes)).cast("int"))
    # a fixed number of partitions: by bytes alone, lanes would be put together in a few long tasks
    laned = laned.repartition(min(lanes, MOST_PARTITIONS), "lane")
    schema = f"container string, key {kind}, part int, first_token bigint, n_tokens int, position int, offset int, filled int"
    return laned.groupBy("lane").applyInPandas(pack, schema)


def pack(df: DataFrame, key: str, text: str, path: str = TOKENIZER, capacity: int = CAPACITY, lane_items: int = LANE_ITEMS, repack_below: float = REPACK_BELOW) -> DataFrame:
    """Packs the texts of ``df`` into containers of ``capacity`` tokens.

    One row per text, or per part of a text that alone exceeds the capacity: ``container``,
    the key, ``part``, ``first_token``, ``n_tokens``, ``position`` and ``offset`` in the
    container, ``filled`` (tokens in the container) and ``fill`` (share of the capacity).
    Repeated rows are packed as often as they come. Null and empty texts take no room and
    have no row; an empty table gives none. The key must not be null.
    """
    from sluiceway.session import cut

    # two cuts in the shared folder: sizes are tokenised once, and the first round is packed once
    items = cut(token_sizes(df, key, text, path, capacity))
    n = items.count()
    first = cut(_pack_lanes(items, max(1, -(-n // lane_items)), "a", capacity))
    done = F.col("filled") >= F.lit(repack_below * capacity)
    rest = first.where(~done)
    left = rest.count()
    again = _pack_lanes(rest.select("key", "part", "first_token", "n_tokens"), max(1, -(-left // lane_items)), "b", capacity)
    out = first.where(done).unionByName(again)
    return out.select("container", F.col("key").alias(key), "part", "first_token", "n_tokens", "position", "offset", "filled", (F.col("filled") / capacity).alias("fill"))
