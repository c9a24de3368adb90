"""Passages of test items inside documents, found by joining spaced seeds and verified by alignment."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, spread
from .naming import drops, one_slip
from .plaintext import words

#: Places of a window that are compared (1) and ignored (0).
MASKS = ("11111", "110111", "111011", "1101011")
#: Share of an item's words that one stretch of a document must follow.
SHARE = 1 / 3
#: Share of an item's words that the hits of one stretch must cover before it is aligned.
COVER = 0.15
#: Bits of the filter of item windows for each of them, and at most: 16 MB, whatever the number of items.
FILTER_BITS, FILTER_MOST = 64, 1 << 27
#: Item windows, at most, that are broadcast to the hits (below 200 MB); more are joined by shuffle, salted.
BROADCAST_WINDOWS = 2_000_000
#: Copies of an item window in the salted join, so that a passage copied into many documents is no hot key.
SALTS = 16
#: Costs of the alignment in units of a matching word: a stretch must match more often than it differs.
GAP, SWAP = 1.0, 1.0

_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_PLACES = [np.array([i for i, c in enumerate(m) if c == "1"]) for m in MASKS]


def word_keys(found: list[str]) -> np.ndarray:
    """A number for every word, the same in every process."""
    return pd.util.hash_array(np.array(found, dtype=object), categorize=True) if found else np.zeros(0, np.uint64)


def masked(keys: np.ndarray, mask: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of the masked window at every place of several sequences that lie one after another.

    ``ends`` holds the end of every sequence; windows that would pass one are left out.
    """
    at = _PLACES[mask]
    n = len(keys) - int(at[-1])
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.full(n, mask + 1, np.uint64)
    for k in at:
        h = (h ^ keys[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    inside = np.ones(n, bool)
    for b in range(int(at[-1])):  # windows starting this close before an end pass it
        past = ends - 1 - b
        inside[past[(past >= 0) & (past < n)]] = False
    place = np.flatnonzero(inside)
    return place, h[place].astype(np.int64)


class Item:
    """The words of a test item as numbers, and those of documents as the same numbers."""

    def __init__(self, item: list[str]):
        self.words = item
        self.number = {w: i for i, w in enumerate(dict.fromkeys(item))}
        self.seq = np.array([self.number[w] for w in item], np.int64)
        self.counts = np.bincount(self.seq, minlength=len(self.number))
        self.near: dict[str, list[str]] = defaultdict(list)
        for w in self.number:
            if len(w) > 3:
                for d in {w, *drops(w)}:
                    self.near[d].append(w)
        self.memo: dict[str, int] = dict(self.number)

    def held(self, codes: np.ndarray) -> int:
        """Words of the item that a stretch holds in whatever order, the most that it can follow."""
        return int(np.minimum(np.bincount(codes[codes >= 0], minlength=len(self.number)), self.counts).sum())

    def codes(self, doc: list[str], shortened: dict[str, set[str]]) -> np.ndarray:
        """Numbers of a document's words; -1 for others, one slip in a word does not matter.  ``shortened`` is a memo of all items."""
        memo = self.memo
        for w in doc:
            if w not in memo:
                memo[w] = -1
                if 3 < len(w) < 40:
                    d = shortened.get(w)
                    if d is None:
                        d = shortened[w] = {w, *drops(w)}
                    close = [x for k in d & self.near.keys() for x in self.near[k] if one_slip(w, x)]
                    if close:
                        memo[w] = self.number[min(close)]
        out = np.array([memo[w] for w in doc], np.int32)
        if len(memo) > 100_000:
            self.memo = dict(self.number)
        return out


def follow(items: list[np.ndarray], docs: list[np.ndarray]) -> np.ndarray:
    """Words of each item, in order, that its best local alignment with a stretch of its document matches.

    A matching word gains 1; a word replaced, dropped or added costs as much.  Of equally good alignments the one
    that matches most counts.  All pairs are aligned at once, row by row; a cell holds score and matches in one number.
    """
    one = 1 << 14
    x = np.full((len(items), max(map(len, items))), -3, np.int32)
    y = np.full((len(docs), max(map(len, docs))), -2, np.int32)
    for i, (a, b) in enumerate(zip(items, docs)):
        x[i, : len(a)], y[i, : len(b)] = a, b
    drift = int(GAP * one) * np.arange(y.shape[1] + 1, dtype=np.int32)
    last = np.zeros((len(y), y.shape[1] + 1), np.int32)
    best = np.zeros(len(y), np.int32)
    for i in range(x.shape[1]):
        row = np.zeros_like(last)
        fits = (y == x[:, i : i + 1]) * np.int32(one + 1 + int(SWAP * one))
        fits -= np.int32(SWAP * one)
        fits += last[:, :-1]
        np.maximum(fits, last[:, 1:] - np.int32(GAP * one), out=row[:, 1:])
        row += drift
        np.maximum.accumulate(row, axis=1, out=row)
        row -= drift
        row *= row >= one  # an alignment that has lost all its score begins anew
        np.maximum(best, row.max(axis=1), out=best)
        last = row
    return best & (one - 1)


def crowds(pair: np.ndarray, length: np.ndarray, at: np.ndarray, place: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pair, start and end of the stretches of documents whose crowd of hits covers enough of an item.

    A hit has the number of its pair of document and item, the item's ``length``, its places in both and its span.
    Hits of a pair that lie no further apart than half the item make a crowd.
    """
    by = np.lexsort((at, pair))
    pair, length, at, place, span = (x[by].astype(np.int64) for x in (pair, length, at, place, span))
    if not len(pair):
        return pair, pair, pair
    new = np.ones(len(pair), bool)
    new[1:] = (np.diff(pair) != 0) | (np.diff(at) > np.maximum(30, length[1:] // 2))
    crowd = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(pair)) - 1
    lo, hi = np.minimum.reduceat(place, first), np.maximum.reduceat(place, first)
    # words of the item that hits of a crowd cover: each adds what lies beyond the ends of those before it
    order = np.lexsort((place, crowd))
    wide = int(length.max()) + 16
    start = crowd[order] * wide + place[order]
    end = np.maximum.accumulate(start + span[order])
    before = np.append(0, end[:-1])
    covered = np.bincount(crowd[order], np.maximum(0, end - np.maximum(before, start)))
    n = length[first]
    ok = covered >= np.maximum(5, COVER * n)
    # a stretch reaches as far beyond its hits as the item does, and half as far again
    a = np.maximum(0, at[first] - (1.5 * lo).astype(np.int64) - 10)
    b = at[last] + (1.5 * (n - hi)).astype(np.int64) + 10
    return pair[first][ok], a[ok], b[ok]


def aligned(asked: list[tuple[np.ndarray, np.ndarray]], cells: int = 1 << 17) -> list[int]:
    """Matched words of many items and stretches, aligned together in groups of like length."""
    out = [0] * len(asked)
    order = sorted(range(len(asked)), key=lambda k: len(asked[k][1]))
    at = 0
    while at < len(order):
        group = order[at : at + max(1, cells // max(1, len(asked[order[min(len(order) - 1, at + 63)]][1])))][:64]
        for k, n in zip(group, follow([asked[k][0] for k in group], [asked[k][1] for k in group]).tolist()):
            out[k] = n
        at += len(group)
    return out


def item_windows(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``i, w``: the words of every item without a stock opening; and ``h, i, place, span, n``: its masked windows and its length."""
    rows = items.withColumn("o", F.split("t", r"(?<=[.!?])\s+").getItem(0))
    stock = rows.groupBy("o").agg((F.countDistinct("i") > 1).alias("stock"))  # an opening of several items is a stock one
    key = dict(items.dtypes)["i"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            w = [[x for s in _SENTENCE.split(t)[int(k) :] for x in words(s)] for t, k in zip(b["t"], b["stock"])]
            yield pd.DataFrame({"i": b["i"], "w": pd.Series(w, index=b.index, dtype=object)})

    known = cut(rows.join(stock, "o").select("i", "t", "stock").mapInPandas(read, f"i {key}, w array<string>").filter(F.size("w") > 0))

    def cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("w")
            starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            keys = word_keys(lists.flatten().to_pylist())
            for m in range(len(MASKS)):
                place, h = masked(keys, m, starts[1:])
                row = np.searchsorted(starts, place, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(h), b.column("i").take(pa.array(row)), pa.array((place - starts[row]).astype(np.int32)), pa.array(np.full(len(h), len(MASKS[m]), np.int32)), pa.array(np.diff(starts)[row].astype(np.int32))],
                                                 ["h", "i", "place", "span", "n"])

    return known, cut(known.mapInArrow(cut_windows, f"h bigint, i {key}, place int, span int, n int"))


def window_filter(spark: SparkSession, windows: DataFrame, count: int) -> tuple[int, np.ndarray]:
    """Number of bits and bytes of a bit map of the windows' hashes; it passes every hit, and few others."""
    bits = 1 << 16
    while bits < min(FILTER_BITS * count, FILTER_MOST):
        bits *= 2

    def mark(frame: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(1 << 16, np.uint8)
        flags[frame["bit"].to_numpy() & 0xFFFF] = 1
        return pd.DataFrame({"part": [int(frame["bit"].iloc[0]) >> 16], "bytes": [np.packbits(flags).tobytes()]})

    places = windows.select(F.col("h").bitwiseAND(F.lit(bits - 1)).alias("bit")).distinct()
    out = np.zeros(bits >> 3, np.uint8)
    for r in places.groupBy(F.shiftright("bit", 16).alias("p")).applyInPandas(mark, "part bigint, bytes binary").collect():  # FILTER_MOST bits at most
        out[r["part"] << 13 : (r["part"] + 1) << 13] = np.frombuffer(r["bytes"], np.uint8)
    return bits, out


def leaked(documents: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str,
           share: float = SHARE, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """``doc_id, item_id, matched_words, item_words``: documents with a stretch that follows an item.

    A stretch counts if it follows at least ``share`` of the item's words in order, whatever their
    case, character form, punctuation, markup or layout, with words replaced, dropped, added or
    misspelt now and then.  Opening sentences shared by several items are not part of an item, so an item
    that is nothing else is never found.  Repeated items count once.  Null
    and empty texts contain nothing; every row is searched, and repeated ids give one row.

    Documents are read once, whatever the number of items.  Every window of every document is hashed under
    fixed masks; those that pass a bit map of the items' windows (of a fixed size at most) are joined with
    them by hash: where they are hashed if there are at most ``broadcast_windows`` of the items, else by a
    salted shuffle.  Both ways give the same crowds of hits, and the stretches around these are aligned with the items.
    """
    spark = documents.sparkSession
    rows = items.filter(F.col(item_text).isNotNull()).select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).distinct()
    known, windows = item_windows(rows)
    count = windows.count()
    key, item_key = dict(documents.dtypes)[doc_id], dict(items.dtypes)[item_id]
    bits_shared = spark.sparkContext.broadcast(window_filter(spark, windows, count))
    texts = spread(documents.filter(F.col(doc_text).isNotNull()).select(F.col(doc_id).alias("d"), F.col(doc_text).alias("t")))

    def hit_windows(texts: pd.Series) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray]:
        """Words of every text; text, place and hash of the windows that pass the filter."""
        bits, flags = bits_shared.value
        w = [words(t) for t in texts]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in w])]).astype(np.int64)
        keys = word_keys([x for one in w for x in one])
        places, hashes = [], []
        for m in range(len(MASKS)):
            place, h = masked(keys, m, starts[1:])
            bit = h & (bits - 1)
            ok = (flags[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1
            places.append(place[ok])
            hashes.append(h[ok])
        place, h = np.concatenate(places), np.concatenate(hashes)
        row = np.searchsorted(starts, place, side="right") - 1
        return w, row, place - starts[row], h

    def frame(**columns: list) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series(x, dtype=object) for c, x in columns.items()})

    if count <= broadcast_windows:
        w = windows.toArrow()  # broadcast_windows rows at most
        by = np.argsort(w.column("h").to_numpy(), kind="stable")
        ids, number = np.unique(w.column("i").to_numpy(zero_copy_only=False), return_inverse=True)
        shared = spark.sparkContext.broadcast((w.column("h").to_numpy()[by], number[by], w.column("n").to_numpy()[by], w.column("place").to_numpy()[by], w.column("span").to_numpy()[by], ids.tolist()))

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            hashes, item, n, in_item, span, ids = shared.value
            for b in batches:
                w, row, at, h = hit_windows(b["t"])
                lo = np.searchsorted(hashes, h, "left")
                times = np.searchsorted(hashes, h, "right") - lo
                k = np.repeat(lo - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum()) if len(h) else lo
                pair, start, end = crowds(np.repeat(row, times) * (len(ids) + 1) + item[k], n[k], np.repeat(at, times), in_item[k], span[k])
                doc, it = (pair // (len(ids) + 1)).tolist(), (pair % (len(ids) + 1)).tolist()
                d = b["d"].tolist()
                yield frame(d=[d[r] for r in doc], i=[ids[x] for x in it], w=[w[r][x:y] for r, x, y in zip(doc, start.tolist(), end.tolist())])

        asked = texts.mapInPandas(search, f"d {key}, i {item_key}, w array<string>")
    else:

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                w, row, at, h = hit_windows(b["t"])
                by = np.argsort(row, kind="stable")
                row, at, h = row[by], at[by].astype(np.int32), h[by]
                hit, first = np.unique(row, return_index=True)
                last = np.append(first[1:], len(row))
                d = b["d"].tolist()
                yield frame(d=[d[r] for r in hit], w=[w[r] for r in hit], at=[at[x:y] for x, y in zip(first, last)], h=[h[x:y] for x, y in zip(first, last)])

        met = cut(texts.mapInPandas(search, f"d {key}, w array<string>, at array<int>, h array<bigint>").withColumn("row", F.monotonically_increasing_id()))
        hits = met.select("row", F.explode(F.arrays_zip("at", "h")).alias("x")).select("row", "x.at", "x.h", F.pmod("row", F.lit(SALTS)).cast("int").alias("salt"))
        both = hits.join(windows.withColumn("salt", F.explode(F.array(*[F.lit(s) for s in range(SALTS)]))), ["h", "salt"])
        pairs = both.groupBy("row", "i").agg(F.first("n").alias("n"), F.collect_list(F.struct("at", "place", "span")).alias("l"))  # of one document and item
        pairs = pairs.select("row", "i", "n", "l.at", "l.place", "l.span")

        def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                size = b["at"].map(len).to_numpy()
                flat = [np.concatenate(b[c].to_list()) if len(b) else np.zeros(0, np.int64) for c in ("at", "place", "span")]
                pair, start, end = crowds(np.repeat(np.arange(len(b)), size), np.repeat(b["n"].to_numpy(), size), *flat)
                yield pd.DataFrame({"row": b["row"].to_numpy()[pair], "i": b["i"].to_numpy()[pair], "a": start, "b": end})

        found = pairs.mapInPandas(gather, f"row bigint, i {item_key}, a int, b int")
        asked = found.join(met.select("row", "d", "w"), "row").select("d", "i", F.slice("w", F.col("a") + 1, F.col("b") - F.col("a")).alias("w"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items: dict = {}
        shortened: dict[str, set[str]] = {}
        for b in batches:
            rows, asked = [], []
            for d, i, stretch, item in zip(b["d"], b["i"], b["w"], b["iw"]):
                if i not in items:
                    if len(items) > 2_000:
                        items.clear()
                    items[i] = Item(item.tolist())
                codes = items[i].codes(stretch.tolist(), shortened)
                if items[i].held(codes) >= share * len(item):
                    rows.append((d, i, len(item)))
                    asked.append((items[i].seq, codes))
                if len(shortened) > 200_000:
                    shortened.clear()
            got = [(d, i, m, n) for (d, i, n), m in zip(rows, aligned(asked)) if m >= share * n]
            yield pd.DataFrame(got, columns=[doc_id, item_id, "matched_words", "item_words"])

    asked = asked.join(known.select("i", F.col("w").alias("iw")), "i")
    found = asked.mapInPandas(verify, f"`{doc_id}` {key}, `{item_id}` {item_key}, matched_words int, item_words int")
    return found.groupBy(doc_id, item_id).agg(F.max("matched_words").alias("matched_words"), F.max("item_words").alias("item_words"))
