"""Long exact spans shared between records, found with suffix automata of reference shards."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, spread

#: Values of the references of one automaton, and of all automata that are broadcast together (some 100 MB in a Python worker).
SHARD_VALUES = 100_000
BROADCAST_VALUES = 500_000
#: Records of one reference shard where the automata are not broadcast.
SHARD_RECORDS = 2_000


class Automaton:
    """Suffix automaton of several sequences; a state stands for substrings that end at the same places."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _clone(self, p: int, q: int, c: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def add(self, sequence: list[int]) -> None:
        last = 0
        for c in sequence:
            q = self.next[last].get(c)
            if q is not None:  # known from an earlier sequence
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, q, c)
                continue
            cur = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
            last = cur

    def statistics(self, sequence: list[int]) -> Iterator[tuple[int, int]]:
        """For every end position the state and the length of the longest match that ends there."""
        state, size = 0, 0
        for c in sequence:
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                size += 1
            else:
                state, size = 0, 0
            yield state, size

    def shortest(self, state: int, least: int) -> int:
        """The state of the match's last ``least`` symbols."""
        while self.length[self.link[state]] >= least:
            state = self.link[state]
        return state


class Shard:
    """Automaton of reference records (each: id, smallest and greatest owner, sequence) and what its states know of them.

    Documents stream past it one by one; only its size depends on the number of references.
    """

    def __init__(self, references: list[tuple[str, str, str, list[int]]], least: int):
        self.least = least
        self.code: dict[int, int] = {}
        self.auto = Automaton()
        self.references = [r[:3] for r in references]
        coded = [[self.code.setdefault(x, len(self.code)) for x in r[3]] for r in references]
        for c in coded:
            self.auto.add(c)
        self.held: dict[int, list[int]] = {}
        self.owners: dict[int, tuple[str, str]] = {}
        for i, ((_, lo, hi), c) in enumerate(zip(self.references, coded)):
            for t in set(self.trace(c)) - {-1}:
                self.held.setdefault(t, []).append(i)
                a, z = self.owners.get(t, (lo, hi))
                self.owners[t] = min(a, lo), max(z, hi)

    def trace(self, coded: list[int]) -> list[int]:
        """For every end position the state of the last ``least`` values, -1 where no reference holds them."""
        return [self.auto.shortest(state, self.least) if n >= self.least else -1 for state, n in self.auto.statistics(coded)]

    def stream(self, id_: str, lo: str, hi: str, values: list[int], pairs: bool = True) -> Iterator[tuple]:
        """What a document shares with the references of other owners.

        ``(a, b, -1, -1)``, a < b, for every reference that shares ``least`` consecutive values with it, given only where
        the document is ``a``, and ``(id, None, start, end)`` for every maximal stretch all of whose values lie in such spans.
        """
        trace = self.trace([self.code.get(x, -1) for x in values])
        alone = (lo, hi) if lo == hi else None
        if pairs:
            met: set[int] = set()
            for t in set(trace) - {-1}:
                met.update(self.held.get(t, ()))
            for i in met:
                b, b_lo, b_hi = self.references[i]
                if id_ < b and not (lo == hi == b_lo == b_hi):
                    yield id_, b, -1, -1
        start = end = -1
        for at, t in enumerate(trace):
            if t >= 0 and t in self.owners and self.owners[t] != alone:
                if at - self.least + 1 > end:
                    if end > 0:
                        yield id_, None, start, end
                    start = at - self.least + 1
                end = at + 1
        if end > 0:
            yield id_, None, start, end


def anchors_of(flat: np.ndarray, offsets: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every gram that is the smallest of some ``window`` consecutive grams of its row.

    Two rows with ``gram + window - 1`` consecutive values in common share the smallest gram of that span.
    """
    n = len(flat)
    if n < gram + window - 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    v = flat.astype(np.uint64)
    h = np.zeros(n - gram + 1, np.uint64)
    for i in range(gram):
        h = (h ^ v[i : n - gram + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    views = np.lib.stride_tricks.sliding_window_view(h, window)
    row = np.searchsorted(offsets, np.arange(len(views)), side="right") - 1
    inside = np.arange(len(views)) + gram + window - 1 <= offsets[row + 1]
    return row[inside], views.min(axis=1)[inside].astype(np.int64)


def shared_spans(records: DataFrame, id_: str, owner: str, values: str, least: int = 12, shard_records: int = SHARD_RECORDS,
                 broadcast_values: int = BROADCAST_VALUES) -> DataFrame:
    """Spans of at least ``least`` values that occur verbatim in records of different owners.

    ``records`` has one row per ``id_`` with ``owner`` and ``values`` (ARRAY<BIGINT>); further columns
    are ignored.  Records with a null id or owner, with null or fewer than ``least`` values, or with a
    null among them, share nothing.  Repeated ids count once per distinct content.  Empty input gives
    an empty result.

    Records of equal content are one class, matched once.  Only classes with an anchor (smallest grams, see
    ``anchors_of``) that occurs with two owners can share a span; they are the references, dealt into shards
    with a suffix automaton each, and the documents.  If they hold at most ``broadcast_values`` values the automata are
    broadcast and every document streams past all of them.  Beyond that classes meet in shards by anchor: an anchor of more
    than ``shard_records`` classes is split, its classes are dealt into blocks, and every pair of blocks is a task of its
    own, one block streaming past the other's automaton.

    Returns ``a, b, start, end``: pairs of ids (``a < b``, start and end -1), and shared stretches of ``a``
    (``b`` null; the same stretch may come in parts from several shards).
    """
    members, classes, spans = shared_classes(records, id_, owner, values, least, shard_records, broadcast_values)
    ma, mb = (members.select(F.col("cid").alias(c), F.col("id").alias(i), F.col("owner").alias(f"o{i}")) for c, i in (("ca", "a"), ("cb", "b")))
    linked = spans.filter(F.col("cb").isNotNull()).select("ca", "cb").distinct()
    copies = classes.filter("lo <> hi")
    linked = linked.unionByName(copies.select(F.col("cid").alias("ca"), F.col("cid").alias("cb")))
    pairs = linked.join(ma, "ca").join(mb, "cb").filter("oa <> ob AND a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = pairs.select("a", "b", F.lit(-1).alias("start"), F.lit(-1).alias("end"))
    cover = spans.filter(F.col("cb").isNull()).select("ca", "start", "end").unionByName(copies.select(F.col("cid").alias("ca"), F.lit(0).alias("start"), F.size("vals").alias("end")))
    nobody = F.lit(None).cast(dict(members.dtypes)["id"])
    return pairs.unionByName(cover.join(ma, "ca").select("a", nobody.alias("b"), "start", "end"))


def shared_classes(records: DataFrame, id_: str, owner: str, values: str, least: int, shard_records: int = SHARD_RECORDS,
                   broadcast_values: int = BROADCAST_VALUES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``shared_spans`` for classes of equal content.

    Returns the members (``cid, id, owner``), the classes (``cid, lo, hi, vals``) and ``ca, cb, start, end``: pairs of
    classes with a common span, and stretches of ``ca`` that another owner's class holds.  A class of several owners is
    shared from end to end, which gives no row.
    """
    gram = max(1, least // 2)
    window = least - gram + 1
    ok = F.col(id_).isNotNull() & F.col(owner).isNotNull() & (F.size(values) >= least) & F.forall(values, lambda x: x.isNotNull())
    content = F.concat(F.hex(F.xxhash64(values)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), F.reverse(values))))
    recs = cut(records.filter(ok).select(content.alias("cid"), F.col(id_).alias("id"), F.col(owner).cast("string").alias("owner"), F.col(values).alias("vals")))
    members = recs.select("cid", "id", "owner")
    classes = cut(recs.groupBy("cid").agg(F.min("owner").alias("lo"), F.max("owner").alias("hi"), F.first("vals").alias("vals")))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vals = b.column("vals")
            row, h = anchors_of(vals.flatten().to_numpy(), vals.offsets.to_numpy() - vals.offsets[0].as_py(), gram, window)
            both = np.unique(np.stack([row, h]), axis=1) if len(row) else np.zeros((2, 0), np.int64)
            at = pa.array(both[0])
            yield pa.RecordBatch.from_arrays([pa.array(both[1]), *[b.column(c).take(at) for c in ("cid", "lo", "hi")]], ["anchor", "cid", "lo", "hi"])

    anchors = cut(classes.mapInArrow(route, "anchor bigint, cid string, lo string, hi string"))
    met = anchors.groupBy("anchor").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n")).filter("lo <> hi AND n > 1").select("anchor", "n")
    hits = cut(anchors.select("anchor", "cid").join(met, "anchor"))
    able = cut(classes.join(hits.select("cid").distinct(), "cid"))
    size = able.agg(F.coalesce(F.sum(F.size("vals")), F.lit(0))).first()[0]
    schema = "ca string, cb string, start int, end int"

    def rows_of(frame: pd.DataFrame) -> list[tuple]:
        return list(zip(frame["cid"], frame["lo"], frame["hi"], [v.tolist() for v in frame["vals"]]))

    def as_frame(found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(found, columns=["ca", "cb", "start", "end"]).astype({"ca": object, "cb": object, "start": "int32", "end": "int32"})

    if size <= broadcast_values:
        shards = max(1, -(-size // SHARD_VALUES))
        built = able.groupBy(F.pmod(F.xxhash64("cid"), F.lit(shards)).alias("shard")).applyInPandas(lambda f: pd.DataFrame({"shard": [pickle.dumps(Shard(rows_of(f), least), protocol=5)]}), "shard binary")
        automata = records.sparkSession.sparkContext.broadcast([r[0] for r in built.collect()])  # of broadcast_values values at most

        def past_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            loaded = [pickle.loads(x) for x in automata.value]
            for b in batches:
                yield as_frame([f for r in rows_of(b) for shard in loaded for f in shard.stream(*r)])

        return members, classes, spread(able).mapInPandas(past_all, schema)
    shards = max(1, -(-hits.count() // shard_records))
    blocks = F.ceil(F.col("n") / F.lit(shard_records)).cast("int")
    cold = hits.filter(F.col("n") <= shard_records).select(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "cid").distinct()
    home = hits.filter(F.col("n") > shard_records).withColumn("r", blocks).withColumn("h", F.pmod(F.xxhash64("cid"), F.col("r")).cast("int"))
    tiles = F.explode(F.transform(F.sequence(F.lit(0), F.col("r") - 1), lambda k: F.struct(
        F.least(k, F.col("h")).alias("i"), F.greatest(k, F.col("h")).alias("j"), F.when(k >= F.col("h"), 0).otherwise(1).alias("side"))))
    # negative shard numbers keep the tiles of hot anchors apart from the shards of the others
    hot = home.select((-1 - F.pmod(F.col("anchor"), F.lit(2**62))).alias("shard"), tiles.alias("t"), "cid").select("shard", "t.i", "t.j", "t.side", "cid")
    tasks = cold.unionByName(hot).join(able, "cid")

    def match(frame: pd.DataFrame) -> pd.DataFrame:
        sides = [rows_of(frame[frame["side"] == s]) for s in (0, 1)]
        if (frame["i"] == frame["j"]).all():
            sides[1] = sides[0]
        shard = Shard(sides[0], least)
        found = [f for r in sides[1] for f in shard.stream(*r)]
        if sides[1] is not sides[0]:  # and the other way round: references that come after the document, and their stretches
            other = Shard(sides[1], least)
            found += [f for r in sides[0] for f in other.stream(*r)]
        return as_frame(found)

    return members, classes, tasks.groupBy("shard", "i", "j").applyInPandas(match, schema)
