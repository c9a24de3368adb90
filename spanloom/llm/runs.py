"""Runs of identical or near-identical consecutive events, each collapsed into one event."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from ..operators.intervals import SHARD_ROWS, huge_entities, null_safe, shard_of
from ..runtime import cut
from .naming import INDEXED, KEPT, SHARE, SHORT, SHORT_SHARE, TIMES, Namer, TooMany, count_names, count_stems, drops, forms, name_words, one_slip, starts, stem, steps


def fit_namers(events: DataFrame, names: list[str], kept: int = KEPT, indexed: int = INDEXED) -> list[Namer | DataFrame]:
    """One namer a column, from counts over all rows.

    A column with more than ``kept`` stems or names, or more than ``indexed`` stems that slips are traced back to, gets the
    ``name_table`` of its spellings instead, which names them alike; ``keyed`` takes both.
    """
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("col"), F.col(n).alias("raw")) for i, n in enumerate(names)])).alias("x")
    raw = events.select(each).select("x.*").filter(F.col("raw").isNotNull()).groupBy("col", "raw").count()

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for c, part in b.groupby("col"):
                values = dict(zip(part["raw"], part["count"]))
                rows += [(c, what, k, n) for what, counted in ((0, count_stems(values)), (1, count_names(values))) for k, n in counted.items()]
            yield pd.DataFrame(rows, columns=["col", "what", "text", "n"])

    counted = cut(raw.mapInPandas(tally, "col int, what int, text string, n bigint").groupBy("col", "what", "text").agg(F.sum("n").alias("n")))
    sizes = counted.groupBy("col", "what").count().collect()  # two rows a column
    large = {r["col"] for r in sizes if r["count"] > kept}
    held = counted.filter(~F.col("col").isin(*large)).collect() if large else counted.collect()
    pick = lambda i, what: {r["text"]: r["n"] for r in held if r["col"] == i and r["what"] == what}
    found: list[Namer | DataFrame] = []
    for i, name in enumerate(names):
        try:
            namer = None if i in large else Namer(pick(i, 0), pick(i, 1), indexed)
        except TooMany:
            namer = None
        mine = counted.filter(F.col("col") == i)
        found.append(namer or name_table(events.select(F.col(name).alias("raw")), *[mine.filter((F.col("what") == what) & (F.col("text") != "")).select("text", "n") for what in (0, 1)]))
    return found


@F.pandas_udf(StringType())
def plain_words(raw: pd.Series) -> pd.Series:
    """Words of a name without case, marks and leading article; null for a missing name."""
    codes, values = pd.factorize(raw, use_na_sentinel=True)
    known = [None if (w := name_words(v)) is None else " ".join(w) for v in values]
    return pd.Series([known[i] if i >= 0 else None for i in codes], dtype=object)


@F.pandas_udf(BooleanType())
def slipped(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([one_slip(x, y) for x, y in zip(a, b)], dtype=bool)


def _forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Forms of frequent stems, once for each word of letters that they have in common with a slip for them."""
    for b in batches:
        yield pd.DataFrame([(d, f, t, m) for t, m in zip(b["text"], b["n"]) for f in forms(t) for d in {f, *drops(f)}], columns=["d", "f", "t", "m"])


def _probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame([(d, w, own, s, n) for w, own, s, n in zip(b["w"], b["own"], b["is_stem"], b["n"]) for d in {w, *drops(w)}], columns=["d", "w", "own", "is_stem", "n"])


def _starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"text": [k for name in b["text"] for k in starts(name)]}, dtype=object)


def _step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Goes on with the names of words as far as the counts known allow: gives the name, or what else must be counted."""
    for b in batches:
        rows = []
        for words, n, infos, known, got in zip(b["words"], b["n"], b["infos"], b["known"], b["got"]):
            counts = json.loads(known) | {x["k"]: x.get("n", 0) for x in json.loads(got)}
            way = steps(words.split(), {x["w"]: (x["n"], [(y["t"], -y["m"]) for y in x["near"]]) for x in json.loads(infos)})
            name, ask = None, next(way)
            try:
                while not (missing := [k for k in dict.fromkeys(ask) if k not in counts]):
                    ask = way.send(counts)
            except StopIteration as end:
                name, missing = end.value, []
            rows.append((words, n, infos, json.dumps(counts), name, missing))
        yield pd.DataFrame(rows, columns=["words", "n", "infos", "known", "name", "ask"])


def traced(stems: DataFrame) -> DataFrame:
    """``d, f, t, m``: frequent stems ``t``, their counts and forms, without those that are slips themselves."""
    often = stems.filter(F.col("n") >= TIMES)
    shapes = often.mapInPandas(_forms, "d string, f string, t string, m bigint")
    edges = cut(near_stems(often.select(F.col("text").alias("w"), F.col("text").alias("own"), F.lit(True).alias("is_stem"), "n"), shapes).select("w", "t"))
    barred = None
    while not edges.isEmpty():  # each stem of a chain is five times as frequent as the one before it, so rounds are few
        sure = edges.select("t").distinct().join(edges.select(F.col("w").alias("t")).distinct(), "t", "left_anti")
        out = cut(edges.join(sure, "t", "left_semi").select("w").distinct())
        barred = out if barred is None else barred.union(out)
        edges = cut(edges.join(out, "w", "left_anti").join(out.select(F.col("w").alias("t")), "t", "left_anti"))
    if barred is None:
        return shapes
    return often.join(barred.select(F.col("w").alias("text")), "text", "left_anti").mapInPandas(_forms, "d string, f string, t string, m bigint")


def near_stems(words: DataFrame, shapes: DataFrame) -> DataFrame:
    """``w, t, m``: stems that a word (``w, own, is_stem, n``) may be a slip for."""
    probes = words.filter(F.length("w") > 2).mapInPandas(_probes, "d string, w string, own string, is_stem boolean, n bigint")
    share = F.when(F.col("is_stem") & (F.length("w") <= SHORT), SHORT_SHARE).otherwise(SHARE)
    met = probes.join(shapes, "d").filter((F.col("own") != F.col("t")) & (F.col("m") >= TIMES * F.col("n")) & (F.col("n") - 1 <= share * F.col("m")))
    return met.select("w", "f", "t", "m").distinct().filter(slipped("w", "f")).select("w", "t", "m").distinct()


def name_table(raws: DataFrame, stems: DataFrame, names: DataFrame) -> DataFrame:
    """``words, n, name``: the canonical name of every spelling (``plain_words`` of the column ``raw``), and its rows.

    ``stems`` and ``names`` (``text, n``) are counts over all rows.  The same steps as a ``Namer`` takes, by joins: slips meet the forms
    of stems in the words that both become by leaving out a letter, and counts of names are looked up in rounds, for all
    spellings at once, until each has its name.  Nothing is left out and nothing is held by the driver.
    """
    spelt = raws.filter(F.col("raw").isNotNull()).groupBy("raw").count().select(plain_words("raw").alias("words"), "count").filter(F.col("words").isNotNull())
    spelt = cut(spelt.groupBy("words").agg(F.sum("count").alias("n")))
    pairs = spelt.select("words", F.explode(F.array_distinct(F.split("words", " "))).alias("w"))
    one_stem = F.pandas_udf(lambda w: w.map(stem), "string")
    each = pairs.select("w").distinct().withColumn("own", one_stem("w"))
    each = cut(each.join(stems.select(F.col("text").alias("own"), "n"), "own", "left").select("w", "own", F.lit(False).alias("is_stem"), F.coalesce("n", F.lit(1)).alias("n")))
    near = near_stems(each, traced(stems)).groupBy("w").agg(F.array_sort(F.collect_list(F.struct((-F.col("m")).alias("m"), "t"))).alias("near"))
    infos = each.join(near, "w", "left").select("w", F.struct("w", "n", F.coalesce("near", F.expr("CAST(array() AS array<struct<m:bigint,t:string>>)")).alias("near")).alias("x"))
    state = spelt.join(pairs.join(infos, "w").groupBy("words").agg(F.to_json(F.collect_list("x")).alias("infos")), "words")
    state = state.withColumn("known", F.lit("{}")).withColumn("got", F.lit("[]"))
    begun = names.mapInPandas(_starts, "text string").distinct().withColumn("n", F.lit(1).cast("bigint"))
    counts = cut(names.unionByName(begun)).withColumnRenamed("text", "k")
    done = None
    while True:
        now = cut(state.mapInPandas(_step, "words string, n bigint, infos string, known string, name string, ask array<string>"))
        settled = now.filter(F.col("name").isNotNull()).select("words", "n", "name")
        done = settled if done is None else done.unionByName(settled)
        left = now.filter(F.col("name").isNull())
        if left.isEmpty():
            return done
        got = left.select("words", F.explode("ask").alias("k")).join(counts.withColumnRenamed("n", "c"), "k", "left")
        got = got.groupBy("words").agg(F.to_json(F.collect_list(F.struct("k", F.coalesce("c", F.lit(0)).alias("n")))).alias("got"))
        state = left.select("words", "n", "infos", "known").join(got, "words")


def named_by(events: DataFrame, column: str, table: DataFrame, to: str) -> DataFrame:
    """Events with the canonical name of a column, from its ``name_table``; the most frequent names do not move the events."""
    top = table.orderBy(F.desc("n"), "words").limit(KEPT).select(F.col("words").alias("__words"), F.col("name").alias("__top"))
    met = events.withColumn("__words", plain_words.asNondeterministic()(F.col(column))).join(F.broadcast(top), "__words", "left")
    settled = F.concat(F.lit("#"), F.pmod(F.xxhash64(*events.columns), F.lit(1_000)))  # meets nothing, and is spread
    met = met.withColumn("__words", F.when(F.col("__words").isNotNull() & F.col("__top").isNull(), F.col("__words")).otherwise(settled))
    met = met.join(table.select(F.col("words").alias("__words"), F.col("name").alias("__other")), "__words", "left")
    return met.select(*events.columns, F.coalesce("__top", "__other").alias(to))


def keyed(events: DataFrame, names: list[str], namers: list[Namer | DataFrame]) -> DataFrame:
    """Events with one ``key`` for all name columns, null where any of them is missing."""
    if all(isinstance(n, Namer) for n in namers):
        return events.withColumn("key", canonical(events, names, namers))
    parts = [f"__name{i}" for i in range(len(names))]
    out = events
    for part, name, namer in zip(parts, names, namers):
        out = out.withColumn(part, canonical(out, [name], [namer])) if isinstance(namer, Namer) else named_by(out, name, namer, part)
    return out.withColumn("key", F.when(F.forall(F.array(*parts), F.isnotnull), F.concat_ws("|", *parts))).drop(*parts)


def canonical(events: DataFrame, names: list[str], namers: list[Namer]) -> Column:
    """Column of one key for all name columns, null where any of them is missing."""
    shared = events.sparkSession.sparkContext.broadcast(namers)

    @F.pandas_udf("string")
    def key(frame: pd.DataFrame) -> pd.Series:
        parts = []
        for c, namer in zip(frame.columns, shared.value):
            codes, raw = pd.factorize(frame[c], use_na_sentinel=True)
            known = [namer.name(r) for r in raw]
            parts.append([known[i] if i >= 0 else None for i in codes])
        return pd.Series([None if None in p else "|".join(p) for p in zip(*parts)], dtype=object)

    return key.asNondeterministic()(F.struct(*[F.col(c) for c in names]))


def collapse_runs(events: DataFrame, entity: str, event: str, key: str, version: str | None = None,
                  pause_ms: int = 3_600_000, total: int | None = None, raw: DataFrame | None = None,
                  huge_min: int = SHARD_ROWS, shards: int | None = None) -> DataFrame:
    """Maximal runs of consecutive events with the same key, in order of ``s_ms`` and then ``event``.

    ``events`` has ``entity``, ``event``, ``s_ms``, ``e_ms``, ``key`` (null: the event has no name)
    and ``version``; other columns are ignored.  Of rows with the same entity and event the one with
    the greatest ``version`` counts (ties: the greatest values), so repeated rows change nothing.
    An event without a key is in no run and ends the one before it.  So does a pause of more than
    ``pause_ms`` between an event's start and the latest end of any earlier event of the entity.
    Null entities form an entity of their own.  Empty input gives an empty result.

    A huge entity is cut into time shards at quantiles of its starts; runs are found in every shard
    and joined where they meet at a border.  ``raw`` may give the same events without computed keys,
    for the two cheap passes that find huge entities.

    Returns ``entity, run_key, n_events, first_event, last_event, start_ms, end_ms, duration_ms``.
    """
    raw = raw if raw is not None else events
    if total is None:
        total = raw.count()
    ver = F.col(version) if version else F.lit(0)
    events = events.select(F.col(entity).alias("ent"), F.col(event).alias("ev"), "s_ms", "e_ms", F.col(key).alias("key"), ver.alias("ver"))
    slim = raw.select(F.col(entity).alias("ent"), "s_ms", "e_ms").filter(F.col("s_ms").isNotNull())
    huge = huge_entities(slim, ["ent"], total, huge_min=huge_min, shards=shards)
    best = F.max(F.struct("ver", "s_ms", "e_ms", "key")).alias("b")
    rows = events.groupBy("ent", "ev").agg(best).select("ent", "ev", "b.s_ms", "b.e_ms", "b.key")
    if huge is None:
        rows = rows.withColumn("shard", F.lit(-1)).withColumn("carry", F.lit(None).cast("bigint"))
    else:
        marked = rows.alias("a").join(F.broadcast(huge.alias("b")), null_safe("a", "b", ["ent"]), "left").select("a.*", "cuts")
        marked = marked.withColumn("shard", F.when(F.col("cuts").isNull(), -1).otherwise(shard_of(F.col("s_ms"), F.col("cuts"))))
        # latest end of all earlier shards: one row a shard
        hot = slim.alias("a").join(F.broadcast(huge.alias("b")), null_safe("a", "b", ["ent"])).select("a.*", "cuts")
        ends = hot.groupBy("ent", shard_of(F.col("s_ms"), F.col("cuts")).alias("shard")).agg(F.max("e_ms").alias("e"))
        before = Window.partitionBy("ent").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        carry = ends.select("ent", "shard", F.max("e").over(before).alias("carry"))
        rows = marked.drop("cuts").alias("a").join(F.broadcast(carry.alias("b")), null_safe("a", "b", ["ent", "shard"]), "left").select("a.*", "carry")
    part = Window.partitionBy("ent", "shard")
    w = part.orderBy("s_ms", "ev")
    prev = F.lag("key").over(w)
    same = F.col("key") == prev
    reach = F.greatest(F.max("e_ms").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("carry"))
    paused = F.coalesce(F.col("s_ms") - reach > pause_ms, F.lit(False))
    flagged = rows.withColumn("paused", paused).withColumn("new", F.when(F.coalesce(same, F.lit(False)) & ~paused, 0).otherwise(1)).withColumn("no", F.row_number().over(w))
    local = (
        flagged.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("ent", "shard", "run")
        .agg(F.min(F.struct("s_ms", "ev", "key", "paused", "no")).alias("a"), F.max(F.struct("s_ms", "ev", "key")).alias("z"), F.max("e_ms").alias("e"), F.count("*").alias("n"))
        .select("ent", "shard", "run", F.col("a.s_ms").alias("s"), F.col("a.ev").alias("first"), F.col("a.key").alias("key"),
                F.col("z.ev").alias("last"), F.col("z.key").alias("last_key"), "e", "n", (F.col("a.no") == 1).alias("opens"), F.col("a.paused").alias("paused"))
    )

    def named(df: DataFrame) -> DataFrame:
        return df.filter(F.col("key").isNotNull()).select(
            F.col("ent").alias(entity), F.col("key").alias("run_key"), F.col("n").alias("n_events"), F.col("first").alias("first_event"),
            F.col("last").alias("last_event"), F.col("s").alias("start_ms"), F.col("e").alias("end_ms"), (F.col("e") - F.col("s")).alias("duration_ms"))

    if huge is None:
        return named(local)
    local = cut(local.withColumn("closes", F.lead("run").over(part.orderBy("run")).isNull()))
    at_border = (F.col("shard") >= 0) & (F.col("opens") | F.col("closes"))
    u = Window.partitionBy("ent").orderBy("shard", "run")
    before_key = F.lag("last_key").over(u)
    joins = F.col("opens") & ~F.col("paused") & (F.lag("shard").over(u) != F.col("shard")) & (
        F.col("key") == before_key)
    chained = local.filter(at_border).withColumn("new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn(
        "chain", F.sum("new").over(u.rowsBetween(Window.unboundedPreceding, 0)))
    merged = (
        chained.groupBy("ent", "chain")
        .agg(F.min(F.struct("shard", "run", "s", "first", "key")).alias("a"), F.max(F.struct("shard", "run", "last")).alias("z"), F.max("e").alias("e"), F.sum("n").alias("n"))
        .select("ent", F.col("a.s").alias("s"), F.col("a.first").alias("first"), F.col("a.key").alias("key"), F.col("z.last").alias("last"), "e", "n")
    )
    return named(local.filter(~at_border).select(*merged.columns).unionByName(merged))
