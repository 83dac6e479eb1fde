"""Held-out items leaking into a corpus (problem 7).

Method: size-partitioned MinHash containment search. Documents are partitioned by the
power of two above their number of distinct five-word shingles. A document's signature is
a one-permutation MinHash with two bins for each shingle of its partition's size (and
``LEAST_BINS`` at least), so a shingle of a short item has the same chance of being its
bin's minimum in a long document as in a short one. An item has a signature for each
partition, made with the partition's bins; document and item meet on (partition, minimum).
Meetings are verified on the exact words.

Long items are searched in windows of ``WINDOW`` words, each beginning ``STEP`` words after
the one before: every run of ``MIN_RUN`` words lies in one of them, and no item's own
shingles crowd each other out of its signature.

Recall: a leaked run of 15 words shares at least six shingles with its item, even with one
word in ten replaced. With a load of at most 0.72 shingles a bin (document and window of an
item together) one of them is its bin's minimum on both sides with a chance of 0.71 or more,
so at least one of six is in 99.94 of a hundred cases. A signature holds 79 to 88 of a hundred
shingles of a text; fewer bins make it smaller at the price of recall.

Scale: the corpus is read twice (signatures, verification) and never shuffled as a whole
while the items' signatures are few enough by count to be sent to all executors, where
signatures are probed as they are made and only hits leave the scan; beyond that the join
is a shuffled one on the same keys. Only documents that met an item have their text looked
at again; it travels once for each ``ITEMS_PER_ROW`` items that it met.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.session import cut

SHINGLE = 5
MIN_RUN = 15
REPLACED_OF = 10
MIN_SHARED = 1
#: Partitions by size: bins of the smallest, and the last, which holds all larger documents.
LEAST_BINS, LAST_CLASS, BINS_PER_SHINGLE = 256, 24, 2
FIRST_CLASS = (LEAST_BINS // BINS_PER_SHINGLE).bit_length() - 1
#: Words of a window of an item, and of the way to the next one; WINDOW - STEP is MIN_RUN or more.
WINDOW, STEP = 60, 30
#: Items of one row of a document in the verification.
ITEMS_PER_ROW = 64
#: So many rows of the items' signatures (20 bytes each) are sent to all executors at most; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: So many bytes of candidates (keys and item texts) are sent to all executors at most.
BROADCAST_BYTES = 64 * 1024 * 1024

_ESCAPES = re.compile(r"\\(?:u([0-9a-fA-F]{4})|[nrt\"'/\\])")
_TAGS = re.compile(r"</?[A-Za-z][^<>\n]{0,80}>|<!--.*?-->")
_NOT_WORD = re.compile(r"[\W_]+")


class _Dropped(dict):
    """For ``str.translate``: drops format characters and combining marks."""

    def __missing__(self, code: int) -> int | None:
        self[code] = kept = None if unicodedata.category(chr(code)) in ("Cf", "Mn") else code
        return kept


_DROP = _Dropped()


def words_of(text: str) -> list[str]:
    """Words parted by white space, without case, punctuation, markup, escapes, marks and character forms; bare punctuation is no word."""
    if "\\" in text:
        text = _ESCAPES.sub(lambda m: chr(int(m[1], 16)) if m[1] else " ", text)
    if "<" in text:
        text = _TAGS.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_DROP)
    return [w for t in text.casefold().split() if (w := t if t.isalnum() else _NOT_WORD.sub("", t))]


class _Hashes(dict):
    """Word to 64-bit hash; starts anew when it holds very many words."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_HASH = _Hashes()


def word_hashes(text: str) -> np.ndarray:
    words = words_of(text)
    return np.fromiter((_HASH[w] for w in words), dtype=np.uint64, count=len(words))


def shingle_hashes(w: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """A mixed hash of each run of ``k`` words."""
    if len(w) < k:
        return np.empty(0, dtype=np.uint64)
    n = len(w) - k + 1
    with np.errstate(over="ignore"):
        h = np.zeros(n, dtype=np.uint64)
        for i in range(k):
            h = (h ^ w[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def size_class(n_distinct: int) -> int:
    """The partition of a document: the power of two that holds its shingles, between the first and the last one."""
    return min(max(FIRST_CLASS, (n_distinct - 1).bit_length() if n_distinct > 1 else 0), LAST_CLASS)


def signature(distinct: np.ndarray, cls: int) -> np.ndarray:
    """The minima, sorted, of a one-permutation MinHash with ``BINS_PER_SHINGLE * 2**cls`` bins.

    Each partition has a permutation of its own (an odd factor), so that what one partition hides
    another doesn't. Bins are the top bits of the permuted hashes: a bin's minimum is its first in order."""
    if not len(distinct):
        return distinct
    with np.errstate(over="ignore"):
        permuted = np.sort(distinct * (np.uint64(0x9E3779B97F4A7C15) + np.uint64(2 * cls)))
    bins = permuted >> np.uint64(65 - cls - BINS_PER_SHINGLE.bit_length())
    first = np.ones(len(bins), dtype=bool)
    first[1:] = bins[1:] != bins[:-1]
    return permuted[first]


def windows_of(w: np.ndarray) -> list[np.ndarray]:
    """The windows of an item's word hashes; the last one may be shorter."""
    return [w[a : a + WINDOW] for a in range(0, max(1, len(w) - WINDOW + STEP), STEP)]


def document_signatures(df: DataFrame, key: str, text: str, probes=None) -> DataFrame:
    """One row (``key``, ``cls``, ``minimum``) per minimum of each text's signature; with ``probes`` (a broadcast list of
    sorted minima by partition) only of those that are listed there."""
    import pyarrow as pa

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, classes, counts, parts = [], [], [], []
            for row, (k, s) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if s is None or k is None:
                    continue
                distinct = np.unique(shingle_hashes(word_hashes(s)))
                if not len(distinct):
                    continue
                cls = size_class(len(distinct))
                m = signature(distinct, cls)
                if probes is not None:
                    m = _listed(m, probes.value[cls])
                if len(m):
                    rows.append(row)
                    classes.append(cls)
                    counts.append(len(m))
                    parts.append(m.view(np.int64))
            flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
            of = pa.array(np.repeat(np.array(rows, np.int64), counts))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), pa.array(np.repeat(np.array(classes, np.int32), counts)), pa.array(flat)], names=["key", "cls", "minimum"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(sign, f"key {kind}, cls int, minimum bigint")


def _listed(m: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return m[:0]
    at = np.searchsorted(known, m)
    at[at == len(known)] = 0
    return m[known[at] == m]


def item_signatures(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row (``key``, ``cls``, ``minimum``) per minimum of each window of each item, for every partition."""
    import pyarrow as pa

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, classes, parts = [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.uint64)]
            for row, (k, s) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if s is None or k is None:
                    continue
                distinct = [np.unique(shingle_hashes(x)) for x in windows_of(word_hashes(s))]
                for cls in range(FIRST_CLASS, LAST_CLASS + 1):
                    m = np.unique(np.concatenate([signature(d, cls) for d in distinct]))
                    rows.append(np.full(len(m), row))
                    classes.append(np.full(len(m), cls, np.int32))
                    parts.append(m)
            arrays = [batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(classes)), pa.array(np.concatenate(parts).view(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "cls", "minimum"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(sign, f"key {kind}, cls int, minimum bigint")


def least_shared(min_run: int = MIN_RUN, replaced_of: int = REPLACED_OF) -> int:
    """How many shingles of a document an item holds at least, if a run of ``min_run`` words or more leaks: a replaced word spoils as many as it has words."""
    return max(1, min(n - SHINGLE + 1 - SHINGLE * (n // replaced_of) for n in range(min_run, min_run + 5 * replaced_of)))


def longest_run(doc: np.ndarray, item: np.ndarray, min_run: int = MIN_RUN, replaced_of: int = REPLACED_OF, ds: np.ndarray | None = None, its: np.ndarray | None = None) -> int:
    """The longest run of item words that ``doc`` holds in a row, at most one in ``replaced_of`` replaced, the ends
    not replaced; 0 if none has ``min_run`` words. ``ds``, ``its``: the shingles of both, if they are at hand."""
    ds = shingle_hashes(doc) if ds is None else ds
    its = shingle_hashes(item) if its is None else its
    if not len(ds) or not len(its):
        return 0
    # exact containment first: few pairs that share some shingle share enough of them
    if np.count_nonzero(np.isin(ds, its)) < least_shared(min_run, replaced_of):
        return 0
    best = 0
    for d in _diagonals(ds, its):
        i0, i1 = max(0, -d), min(len(item), len(doc) - d)
        hits = np.flatnonzero(doc[i0 + d : i1 + d] == item[i0:i1])
        if len(hits) < min_run - min_run // replaced_of:
            continue
        # from hit a to hit b, at most one word in replaced_of differs just if v[b] - v[a] <= 1
        v = (replaced_of - 1) * hits - replaced_of * np.arange(len(hits))
        a = np.searchsorted(np.maximum.accumulate(v), v - 1)  # for each end the first good beginning
        best = max(best, int((hits - hits[a]).max()) + 1)
    return best if best >= min_run else 0


def _diagonals(ds: np.ndarray, its: np.ndarray) -> list[int]:
    """The offsets at which a shingle of the document and one of the item are equal; memory grows with both, not with their product."""
    order = np.argsort(its, kind="stable")
    known = its[order]
    lo, hi = np.searchsorted(known, ds, "left"), np.searchsorted(known, ds, "right")
    at = np.flatnonzero(hi > lo)
    n = hi[at] - lo[at]
    if n.sum() <= 100_000:
        i = order[np.repeat(lo[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        return np.unique(np.repeat(at, n) - i).tolist()
    seen = np.zeros(len(ds) + len(its), dtype=bool)
    by_value: dict[int, list[int]] = {}
    for j in at.tolist():
        by_value.setdefault(int(lo[j]), []).append(j)
    for first, places in by_value.items():
        places = np.array(places)
        for i in order[first : hi[places[0]]]:
            seen[places - i + len(its)] = True
    return (np.flatnonzero(seen) - len(its)).tolist()


def find_leaks(
    docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "item_text", min_run: int = MIN_RUN, replaced_of: int = REPLACED_OF,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row per document and item of which it holds ``min_run`` or more words in a row: both keys and ``run_words``.

    Up to one word in ``replaced_of`` may be replaced within the run. Null texts and texts
    of fewer words leak nothing; repeated rows of a key count once, by their longest run;
    an empty table on either side gives no rows; other columns are not read.
    """
    import pyarrow as pa

    by_item = cut(item_signatures(items, item_key, item_text).distinct().withColumnRenamed("key", "item"))
    few = by_item.count() <= broadcast_rows
    probes = None
    if few:
        rows = by_item.select("cls", "minimum").distinct().toArrow()
        cls, minimum = rows["cls"].to_numpy(), rows["minimum"].to_numpy().view(np.uint64)
        probes = docs.sparkSession.sparkContext.broadcast([np.sort(minimum[cls == c]) for c in range(LAST_CLASS + 1)])
        by_item = F.broadcast(by_item)
    met = (
        document_signatures(docs, doc_key, doc_text, probes).withColumnRenamed("key", "doc")
        .join(by_item, ["cls", "minimum"])
        .groupBy("doc", "item").agg(F.count("*").alias("shared"))
        .where(F.col("shared") >= MIN_SHARED).select("doc", "item")
    )
    met = cut(met)
    wanted = items.select(F.col(item_key).alias("item"), F.col(item_text).alias("item_text")).where("item_text is not null").distinct()
    per_doc = met.groupBy("doc").agg(F.count("*").alias("n")).select(F.col("doc").alias("d"), F.ceil(F.col("n") / ITEMS_PER_ROW).alias("blocks"))
    # the items of a document in rows of a bounded number each, so that its text travels once for each of these
    blocks = (
        met.join(per_doc, F.col("doc") == F.col("d")).join(wanted, "item")
        .groupBy("doc", F.pmod(F.xxhash64("item"), F.col("blocks")).alias("block")).agg(F.collect_list(F.struct("item", "item_text")).alias("items"))
    )
    blocks = cut(blocks)
    weight = blocks.select(F.sum(F.lit(24) + F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x["item_text"]) + 32))).first()[0] or 0
    texts = docs.select(F.col(doc_key).alias("doc"), F.col(doc_text).alias("doc_text")).where("doc_text is not null")
    pairs = texts.join(F.broadcast(blocks) if weight <= BROADCAST_BYTES else blocks, "doc")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            rows, out_i, out_n = [], [], []
            for row, (s, its) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                doc = word_hashes(s)
                ds = shingle_hashes(doc)
                for it in its:
                    text = it["item_text"]
                    if text not in known:
                        if len(known) > 20_000:
                            known.clear()
                        words = word_hashes(text)
                        known[text] = words, shingle_hashes(words)
                    words, shingles = known[text]
                    if n := longest_run(doc, words, min_run, replaced_of, ds, shingles):
                        rows.append(row)
                        out_i.append(it["item"])
                        out_n.append(n)
            kind = batch.schema.field(2).type.value_type.field("item").type
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(out_i, kind), pa.array(out_n, pa.int32())], names=["doc", "item", "run_words"])

    kinds = f"doc {docs.schema[doc_key].dataType.simpleString()}, item {items.schema[item_key].dataType.simpleString()}, run_words int"
    found = pairs.select("doc", "doc_text", "items").mapInArrow(verify, kinds)
    return found.groupBy(F.col("doc").alias(doc_key), F.col("item").alias(item_key)).agg(F.max("run_words").alias("run_words"))
