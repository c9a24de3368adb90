"""Items of varying length in containers of fixed capacity: first-fit decreasing in random groups."""

from __future__ import annotations

import base64
import importlib.util
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import spread

#: Items packed together; a group leaves about one container partly empty.
GROUP_ITEMS = 8_192

_ENCODERS: dict[tuple[str, str], object] = {}


def default_vocabulary() -> tuple[str, str]:
    """Path and split pattern of the installed public vocabulary."""
    if importlib.util.find_spec("public_tokenizers") is None:
        raise RuntimeError("no public tokenizer is installed; give the path of a rank file and its split pattern")
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _encoder(path: str, pattern: str):  # noqa: ANN202
    if (path, pattern) not in _ENCODERS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        _ENCODERS[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path, pattern]


def with_token_counts(df: DataFrame, text: str, path: str | None = None, pattern: str | None = None, out: str = "n_tokens") -> DataFrame:
    """Adds the number of tokens of ``text``; 0 for null and empty texts."""
    if path is None or pattern is None:
        path, pattern = default_vocabulary()

    @F.pandas_udf("bigint")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoder(path, pattern).encode_ordinary
        for t in texts:
            yield pd.Series([len(encode(x)) if x else 0 for x in t], dtype="int64")

    return spread(df).withColumn(out, count.asNondeterministic()(F.col(text)))  # else a filter on the count would tokenise again


class Bins:
    """Containers in order of opening; a tournament over their free room finds the first that fits."""

    def __init__(self, items: int, capacity: int):
        self.leaves = 1
        while self.leaves < max(1, items):
            self.leaves *= 2
        self.room = [capacity] * (2 * self.leaves)
        self.opened = 0

    def place(self, size: int) -> int:
        """Puts an item into the first container with room for it and returns that container's number."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        room[node] -= size
        at = node - self.leaves
        self.opened = max(self.opened, at + 1)
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
        return at


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Container of every item; items larger than ``capacity`` are not allowed."""
    bins = Bins(len(sizes), capacity)
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        out[i] = bins.place(sizes[i])
    return out


def pack(items: DataFrame, id_: str, size: str, capacity: int, total: int, group_items: int = GROUP_ITEMS, seed: int = 11) -> DataFrame:
    """Assigns items to containers; returns ``container_id, id, piece, start, length``.

    An item longer than ``capacity`` is split: full pieces fill containers of their own, the rest is
    packed like an item; no other item is split.  Items of null, zero or negative size need no room
    and are left out.  Every row is an item, also one with a repeated or null id.  Groups are drawn by
    a hash of id, size and copy number, so repeated rows do not crowd one group; ``total`` sets the
    number of groups, so that the size of a group does not depend on the number of items.
    """
    groups = max(1, -(-total // group_items))
    # equal rows are counted before they are dealt, so that a crowd of them does not meet in one group
    rows = items.select(F.col(id_).alias("id"), F.col(size).cast("bigint").alias("n")).filter("n > 0").groupBy("id", "n").count()
    rows = rows.select("id", "n", F.explode(F.sequence(F.lit(1).cast("bigint"), "count")).alias("copy"))
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("id", "n", "copy", F.lit(seed)), F.lit(groups)).cast("int")).drop("copy")
    kind = dict(rows.dtypes)["id"]

    def fill(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n", "id"], ascending=[False, True], kind="stable")
        ids, pieces, starts, lengths, fixed = [], [], [], [], []
        whole = 0
        for i, n in zip(frame["id"].tolist(), frame["n"].tolist()):
            full, rest = divmod(n, capacity) if n > capacity else (0, n)
            for p in range(full + (rest > 0)):
                ids.append(i)
                pieces.append(p)
                starts.append(p * capacity)
                lengths.append(capacity if p < full else rest)
                fixed.append(p < full)
        free = [j for j, f in enumerate(fixed) if not f]
        at = first_fit_decreasing([lengths[j] for j in free], capacity)
        names = [""] * len(ids)
        for j, b in zip(free, at):
            names[j] = f"{key[0]}-{b}"
        for j, f in enumerate(fixed):
            if f:
                names[j] = f"{key[0]}-w{whole}"
                whole += 1
        return pd.DataFrame({"container_id": names, "id": pd.Series(ids, dtype=frame["id"].dtype), "piece": pieces, "start": starts, "length": lengths})

    return rows.groupBy("slot").applyInPandas(fill, f"container_id string, id {kind}, piece int, start bigint, length bigint")
