"""Queries on descriptions, captions and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vec import clean_token, parse_seconds, r6
from ..operators import decide as D
from ..operators import sets as S
from ..operators import text as T
from ..runtime import table
from .views import CAPS, clean_token_sql, placed_captions, usable_captions

GENERIC = 20


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "task_pairs").filter("video_a IS NOT NULL AND video_b IS NOT NULL")
    return t.select(F.col("video_a").alias("a"), F.col("video_b").alias("b")).distinct()


def stem_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    c = d.select("doc_id", F.explode(T.stems(F.col("text"))).alias("stem"))
    per = c.groupBy("doc_id", "stem").agg(F.count("*").alias("n"))
    return per.groupBy("stem").agg(F.count("*").alias("n_documents"), F.sum("n").alias("n_total"))


def _described(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    r = table(spark, sf_dir, "recordings")
    return T.token_counts(r.filter("video_id IS NOT NULL"), "video_id", T.stems(F.col("description"))), r.select("video_id").distinct().count()


def description_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = _described(spark, sf_dir)
    return T.idf(c, "video_id", n, None).select("token", "df", r6(F.col("idf")).alias("idf"))


def generic_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = _described(spark, sf_dir)
    return T.idf(c, "video_id", n, None).orderBy(F.desc("df"), "token").limit(GENERIC).select("token", r6(F.col("idf")).alias("idf"))


def tfidf_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = _described(spark, sf_dir)
    return T.tfidf(c, T.idf(c, "video_id", n, None), "video_id").select("video_id", "token", r6(F.col("w")).alias("w"))


def text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of the descriptions of every pair; null unless both are known recordings."""
    c, n = _described(spark, sf_dir)
    p = T.tfidf(c, T.idf(c, "video_id", n, None), "video_id")
    r = T.profile_dot(_pairs(spark, sf_dir), p, "video_id", table(spark, sf_dir, "recordings"))
    return r.select("a", "b", r6(F.col("similarity")).alias("similarity"))


def field_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "recordings").select("video_id", "job_family", "canonical_task")
    r = _pairs(spark, sf_dir).join(m.toDF("a", "ja", "ca"), "a").join(m.toDF("b", "jb", "cb"), "b")
    same = lambda x, y: F.coalesce((F.col(x) == F.col(y)) & (F.col(x) != ""), F.lit(False))
    return r.select("a", "b", same("ja", "jb").alias("same_job"), same("ca", "cb").alias("same_task"))


def _seconds() -> F.Column:
    return F.round(F.col("t1") - F.col("t0"), 3)


def clean_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "caption_segments").select("verb")
    return t.groupBy(clean_token(F.col("verb")).alias("verb")).agg(F.count("*").alias("n"))


def segment_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = usable_captions(spark, sf_dir)
    return c.select("video_id", "segment_id", T.field_tokens(T.ACTIONS).alias("actions"), T.field_tokens(T.OBJECTS).alias("objects"))


def action_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.time_profile(usable_captions(spark, sf_dir), "video_id", T.field_tokens(T.ACTIONS), _seconds())
    return p.select("video_id", "token", r6(F.col("w")).alias("w"))


def object_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = T.time_profile(usable_captions(spark, sf_dir), "video_id", T.field_tokens(T.OBJECTS), _seconds())
    return p.select("video_id", "token", r6(F.col("w")).alias("w"))


def _station(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.time_profile(usable_captions(spark, sf_dir), "video_id", T.field_tokens(("station",)), _seconds())


def dominant_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.dominant(_station(spark, sf_dir), "video_id").select("video_id", F.col("token").alias("station"))


def mean_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = usable_captions(spark, sf_dir)
    return c.groupBy("video_id").agg(r6(F.coalesce(F.avg(F.when(F.col("confidence") != 0, F.col("confidence"))), F.lit(0.0)) + 1e-9).alias("confidence"))


def _weights(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = usable_captions(spark, sf_dir).select("video_id", "t0", "t1", *T.ACTIONS, *T.OBJECTS)
    tokens = c.select("video_id", F.explode(F.concat(T.field_tokens(T.ACTIONS), T.field_tokens(T.OBJECTS))).alias("token")).distinct()
    return c, T.idf(tokens, "video_id", c.select("video_id").distinct().count())


def caption_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, sf_dir)[1].select("token", "df", r6(F.col("idf")).alias("idf"))


def _captioned_pairs(spark: SparkSession, sf_dir: str, c: DataFrame) -> DataFrame:
    have = c.select("video_id").distinct()
    return _pairs(spark, sf_dir).join(have.select(F.col("video_id").alias("a")), "a", "left_semi").join(have.select(F.col("video_id").alias("b")), "b", "left_semi")


def task_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of what is done and handled, for pairs with captions on both sides."""
    c, w = _weights(spark, sf_dir)
    p = _captioned_pairs(spark, sf_dir, c)
    acts = T.profile_overlap(p, T.reweight(T.time_profile(c, "video_id", T.field_tokens(T.ACTIONS), _seconds()), w, "video_id"), "video_id", "action")
    objs = T.profile_overlap(p, T.reweight(T.time_profile(c, "video_id", T.field_tokens(T.OBJECTS), _seconds()), w, "video_id"), "video_id", "object")
    total = sum((F.col(k) * x for k, x in T.TASK_PARTS.items()), F.lit(0.0))
    return acts.join(objs, ["a", "b"]).select("a", "b", *[r6(F.col(k)).alias(k) for k in T.TASK_PARTS], r6(total).alias("task_raw"))


def station_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = usable_captions(spark, sf_dir)
    s = _station(spark, sf_dir)
    o = T.profile_overlap(_captioned_pairs(spark, sf_dir, c), s, "video_id", "station")
    d = T.dominant(s, "video_id")
    r = o.join(d.toDF("a", "da"), "a", "left").join(d.toDF("b", "db"), "b", "left")
    return r.select("a", "b", r6(F.col("station_cos")).alias("station_cos"), r6(F.col("station_jaccard")).alias("station_jaccard"), F.coalesce(F.col("da") == F.col("db"), F.lit(False)).alias("same_dominant"))


def caption_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of the words of all captions, a tie-breaker only."""
    c = usable_captions(spark, sf_dir)
    words = T.token_counts(c, "video_id", T.bag_of_words(F.col("caption"))).select("video_id", "token", F.col("n").cast("double").alias("w"))
    o = T.profile_overlap(_captioned_pairs(spark, sf_dir, c), words, "video_id", "word")
    return o.select("a", "b", r6(F.col("word_cos")).alias("word_cos"))


def set_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of one recording's segments by another's, with the verdict and the mean best match."""
    c = usable_captions(spark, sf_dir)
    r = S.set_coverage(_pairs(spark, sf_dir), S.caption_sets(c, "video_id", _seconds()), "video_id")
    cols = [r6(F.col(x)).alias(x) for x in ("covered_a", "covered_b", "best_a", "best_b")]
    return r.select("a", "b", *cols).withColumn("verdict", D.coverage_verdict(F.col("covered_a"), F.col("covered_b")))


def transport_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = placed_captions(spark, sf_dir, "t0", "t1", *T.ACTIONS, *T.OBJECTS)
    r = S.set_transport(_pairs(spark, sf_dir), S.packed_caption_sets(c, "video_id", _seconds()), "video_id")
    return r.select("a", "b", r6(F.col("transport")).alias("transport"))


def parse_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock readings written in three ways, and as something else, read back as seconds."""
    t = table(spark, sf_dir, "caption_segments").filter("t0 >= 0 AND NOT isnan(t0)").select("video_id", "segment_id", F.floor("t0").cast("bigint").alias("s")).distinct()
    two = lambda x: F.lpad(x.cast("string"), F.greatest(F.lit(2), F.length(x.cast("string"))), F.lit("0"))
    s = F.col("s")
    text = (
        F.when(F.col("segment_id") % 4 == 0, F.concat(two(F.floor(s / 60)), F.lit(":"), two(s % 60), F.lit(".5")))
        .when(F.col("segment_id") % 4 == 1, F.concat(two(F.floor(s / 3600)), F.lit(":"), two(F.floor(s / 60) % 60), F.lit(":"), two(s % 60)))
        .when(F.col("segment_id") % 4 == 2, s.cast("string")).otherwise(F.lit("soon"))
    )
    return t.select("video_id", "segment_id", text.alias("text"), parse_seconds(text).alias("seconds"))


def segment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "signatures").select("segment_id", "file_path", "t0", "t1", "meta.whole_file").distinct()
    base = F.substring_index("file_path", "/", -1)
    label = F.when(F.coalesce("whole_file", F.lit(False)), base).otherwise(F.concat(base, F.lit("["), F.round("t0").cast("bigint").cast("string"), F.lit("-"), F.round("t1").cast("bigint").cast("string"), F.lit("s]")))
    return s.select("segment_id", label.alias("label"))


def session_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session, tag and span read from paths made of the recordings' metadata; nulls without a session key."""
    r = table(spark, sf_dir, "recordings")
    path = F.concat(F.lit("/store/data/"), F.col("session_key"), F.lit("/chunks/"), F.col("video_id"), F.lit("_"), F.col("ordinal").cast("string"), F.lit("-"), (F.col("ordinal") + 30).cast("string"), F.lit(".mp4"))
    return r.select("video_id", path.alias("path")).select("video_id", session_of("path").alias("session"), F.regexp_extract("path", r"/([A-Z]{2,5}-\d+)/", 1).alias("tag"),
                                                          F.regexp_extract("path", r"_(\d+)-(\d+)\.mp4$", 1).try_cast("int").alias("t0"), F.regexp_extract("path", r"_(\d+)-(\d+)\.mp4$", 2).try_cast("int").alias("t1"))


def session_of(path: str) -> F.Column:
    """Folder below ``data``, or from ``normalized`` or ``chunking`` on, without a trailing ``chunks``; else the last folder."""
    d = F.regexp_replace(F.regexp_replace(F.col(path), r"/[^/]*$", ""), r"/chunks$", "")
    pick = lambda rx: F.when(d.rlike(rx), F.regexp_extract(d, rx, 1))
    return F.coalesce(pick(r"^(?:.*?/)?data/(.*)$"), pick(r"^(?:.*?/)?(normalized/.*)$"), pick(r"^(?:.*?/)?(chunking/.*)$"), F.substring_index(d, "/", -1))


def episode_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "task_pairs").filter("video_a IS NOT NULL").select("video_a").distinct()
    key = F.regexp_replace(F.regexp_replace(F.regexp_replace("video_a", r"^[a-z0-9]+://[^/]+/", ""), r"/seg_\d+$", ""), r"^[ \t]+|[ \t]+$", "")
    return t.select("video_a", key.alias("episode"))


def suffix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names resolved to the one path that ends with them; names with several paths are refused."""
    names = table(spark, sf_dir, "recordings").select(F.concat("video_id", F.lit(".mp4")).alias("name")).distinct()
    paths = table(spark, sf_dir, "signatures").select("file_path").distinct()
    met = names.join(paths, F.substring_index("name", "/", -1) == F.substring_index("file_path", "/", -1)).filter(F.col("file_path").endswith(F.concat(F.lit("/"), F.col("name"))) | (F.col("file_path") == F.col("name")))
    return met.groupBy("name").agg(F.count("*").alias("n"), F.min("file_path").alias("file_path")).select("name", F.when(F.col("n") == 1, F.col("file_path")).alias("file_path"), (F.col("n") > 1).alias("ambiguous"))


def comparable_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "signatures").groupBy("video_id").agg(F.countDistinct("segment_id").alias("n"))
    return s.filter("n >= 2").orderBy(F.desc("n"), "video_id")


_STOP = "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(T.STOP)) + "]"


def _stem_sql(c: str) -> str:
    w = f"[w for w in regexp_extract_all(lower({c}), '[a-z]+') if len(w) >= 3 AND NOT list_contains({_STOP}, w)]"
    one = "CASE WHEN w LIKE '%ing' AND len(w) >= 7 THEN w[1:len(w) - 3] WHEN w LIKE '%ed' AND len(w) >= 6 THEN w[1:len(w) - 2] WHEN w LIKE '%es' AND len(w) >= 6 THEN w[1:len(w) - 2] WHEN w LIKE '%s' AND len(w) >= 5 THEN w[1:len(w) - 1] ELSE w END"
    return f"[{one} for w in {w}]"


_PRS = "prs AS (SELECT DISTINCT video_a AS a, video_b AS b FROM task_pairs WHERE video_a IS NOT NULL AND video_b IS NOT NULL)"
_TF = f"""tok AS (SELECT video_id, unnest({_stem_sql('description')}) AS token FROM recordings WHERE video_id IS NOT NULL AND description IS NOT NULL), cnt AS (SELECT video_id, token, count(*) AS n FROM tok GROUP BY ALL),
dfs AS (SELECT token, count(*) AS df, ln((SELECT count(DISTINCT video_id) FROM recordings) / count(*)) AS idf FROM cnt GROUP BY token),
wts AS (SELECT video_id, token, n * greatest(idf, 0.05) AS x FROM cnt JOIN dfs USING (token)), prof AS (SELECT video_id, token, x / sqrt(sum(x * x) OVER (PARTITION BY video_id)) AS w FROM wts)"""


def _tokens_sql(cols: tuple[str, ...]) -> str:
    parts = [clean_token_sql(c) for c in cols]
    out = []
    for i, p in enumerate(parts):
        earlier = " AND ".join(f"({p}) <> ({q})" for q in parts[:i])
        out.append(f"CASE WHEN ({p}) <> ''{' AND ' + earlier if earlier else ''} THEN {p} END")
    return f"[x for x in [{', '.join(out)}] if x IS NOT NULL]"


def _profile_sql(name: str, cols: tuple[str, ...]) -> str:
    return f"""{name}_t AS (SELECT video_id, round(t1 - t0, 3) AS s, {_tokens_sql(cols)} AS ts FROM caps), {name}_l AS (SELECT video_id, unnest(ts) AS token, s / len(ts) AS x FROM {name}_t WHERE len(ts) > 0),
{name}_s AS (SELECT video_id, token, sum(x) AS x FROM {name}_l GROUP BY ALL), {name} AS (SELECT video_id, token, x / sum(x) OVER (PARTITION BY video_id) AS w FROM {name}_s)"""


def _overlap_sql(name: str, prof: str) -> str:
    return f"""{name}_n AS (SELECT video_id, sqrt(sum(w * w)) AS norm, count(*) AS n FROM {prof} GROUP BY 1), {name}_m AS (SELECT a, b, sum(p.w * q.w) AS d, count(*) AS c FROM cp JOIN {prof} p ON a = p.video_id JOIN {prof} q ON b = q.video_id AND p.token = q.token GROUP BY a, b),
{name}_o AS (SELECT cp.a, cp.b, CASE WHEN x.norm * y.norm > 0 THEN coalesce(d, 0) / (x.norm * y.norm) ELSE 0.0 END AS {name}_cos, CASE WHEN coalesce(x.n, 0) + coalesce(y.n, 0) - coalesce(c, 0) > 0 THEN coalesce(c, 0) / (coalesce(x.n, 0) + coalesce(y.n, 0) - coalesce(c, 0)) ELSE 0.0 END AS {name}_jaccard
  FROM cp LEFT JOIN {name}_n x ON cp.a = x.video_id LEFT JOIN {name}_n y ON cp.b = y.video_id LEFT JOIN {name}_m m ON cp.a = m.a AND cp.b = m.b)"""


_CP = f"{_PRS}, cp AS (SELECT * FROM prs WHERE a IN (SELECT video_id FROM caps) AND b IN (SELECT video_id FROM caps))"
_ACT, _OBJ, _STA = _profile_sql("act", T.ACTIONS), _profile_sql("obj", T.OBJECTS), _profile_sql("sta", ("station",))
_IDF = """idfs AS (SELECT token, count(*) AS df, greatest(ln((SELECT count(DISTINCT video_id) FROM caps) / count(*)), 0.05) AS idf FROM (SELECT video_id, token FROM act UNION SELECT video_id, token FROM obj) GROUP BY token)"""
_DOM = "dom AS (SELECT video_id, token FROM sta QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY round(w, 9) DESC, token) = 1)"

QUERIES = {
    f.__name__: f for f in (stem_counts, description_idf, generic_tokens, tfidf_profile, text_similarity, field_agreement, clean_tokens, segment_tokens, action_profile, object_profile, dominant_station,
                            mean_confidence, caption_idf, task_similarity, station_agreement, caption_bags, set_coverage, transport_similarity, parse_times, segment_labels, session_keys, episode_keys,
                            suffix_lookup, comparable_recordings)
}
ORACLES = {
    "stem_counts": f"""WITH t AS (SELECT doc_id, unnest({_stem_sql('text')}) AS stem FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, stem, count(*) AS n FROM t GROUP BY ALL)
      SELECT stem, count(*) AS n_documents, CAST(sum(n) AS BIGINT) AS n_total FROM c GROUP BY stem""",
    "description_idf": f"WITH {_TF} SELECT token, df, round(idf, 6) + 0.0 AS idf FROM dfs",
    "generic_tokens": f"WITH {_TF} SELECT token, round(idf, 6) + 0.0 AS idf FROM dfs ORDER BY df DESC, token LIMIT {GENERIC}",
    "tfidf_profile": f"WITH {_TF} SELECT video_id, token, round(w, 6) + 0.0 AS w FROM prof",
    "text_similarity": f"""WITH {_PRS}, {_TF}, s AS (SELECT a, b, sum(p.w * q.w) AS s FROM prs JOIN prof p ON a = p.video_id JOIN prof q ON b = q.video_id AND p.token = q.token GROUP BY a, b)
      SELECT prs.a, prs.b, CASE WHEN prs.a IN (SELECT video_id FROM recordings) AND prs.b IN (SELECT video_id FROM recordings) THEN round(coalesce(s, 0.0), 6) + 0.0 END AS similarity FROM prs LEFT JOIN s ON prs.a = s.a AND prs.b = s.b""",
    "field_agreement": f"""WITH {_PRS} SELECT a, b, coalesce(p.job_family = q.job_family AND p.job_family <> '', false) AS same_job, coalesce(p.canonical_task = q.canonical_task AND p.canonical_task <> '', false) AS same_task
      FROM prs JOIN recordings p ON a = p.video_id JOIN recordings q ON b = q.video_id""",
    "clean_tokens": f"SELECT {clean_token_sql('verb')} AS verb, count(*) AS n FROM caption_segments GROUP BY 1",
    "segment_tokens": f"WITH {CAPS} SELECT video_id, segment_id, {_tokens_sql(T.ACTIONS)} AS actions, {_tokens_sql(T.OBJECTS)} AS objects FROM caps",
    "action_profile": f"WITH {CAPS}, {_ACT} SELECT video_id, token, round(w, 6) + 0.0 AS w FROM act",
    "object_profile": f"WITH {CAPS}, {_OBJ} SELECT video_id, token, round(w, 6) + 0.0 AS w FROM obj",
    "dominant_station": f"WITH {CAPS}, {_STA}, {_DOM} SELECT video_id, token AS station FROM dom",
    "mean_confidence": f"WITH {CAPS} SELECT video_id, round(coalesce(avg(nullif(confidence, 0)), 0.0) + 1e-9, 6) + 0.0 AS confidence FROM caps GROUP BY video_id",
    "caption_idf": f"WITH {CAPS}, {_ACT}, {_OBJ}, {_IDF} SELECT token, df, round(idf, 6) + 0.0 AS idf FROM idfs",
    "task_similarity": f"""WITH {CAPS}, {_CP}, {_ACT}, {_OBJ}, {_IDF},
      actw AS (SELECT video_id, token, w * idf / sum(w * idf) OVER (PARTITION BY video_id) AS w FROM act JOIN idfs USING (token)), objw AS (SELECT video_id, token, w * idf / sum(w * idf) OVER (PARTITION BY video_id) AS w FROM obj JOIN idfs USING (token)),
      {_overlap_sql('action', 'actw')}, {_overlap_sql('object', 'objw')}
      SELECT a, b, {', '.join(f'round({k}, 6) + 0.0 AS {k}' for k in T.TASK_PARTS)}, round({' + '.join(f'{x} * {k}' for k, x in T.TASK_PARTS.items())}, 6) + 0.0 AS task_raw FROM action_o JOIN object_o USING (a, b)""",
    "station_agreement": f"""WITH {CAPS}, {_CP}, {_STA}, {_DOM}, {_overlap_sql('station', 'sta')}
      SELECT a, b, round(station_cos, 6) + 0.0 AS station_cos, round(station_jaccard, 6) + 0.0 AS station_jaccard, coalesce(p.token = q.token, false) AS same_dominant FROM station_o LEFT JOIN dom p ON a = p.video_id LEFT JOIN dom q ON b = q.video_id""",
    "caption_bags": f"""WITH {CAPS}, {_CP}, l AS (SELECT video_id, unnest([w for w in regexp_extract_all(lower(caption), '[a-z]+') if len(w) > 3]) AS token FROM caps WHERE caption IS NOT NULL), bag AS (SELECT video_id, token, count(*)::DOUBLE AS w FROM l GROUP BY ALL), {_overlap_sql('word', 'bag')}
      SELECT a, b, round(word_cos, 6) + 0.0 AS word_cos FROM word_o""",
    "set_coverage": f"""WITH {CAPS}, {_PRS}, i0 AS (SELECT video_id, list_sort({_tokens_sql(T.ACTIONS)}) AS x, list_sort({_tokens_sql(T.OBJECTS)}) AS o, round(t1 - t0, 3) AS s FROM caps), i AS (SELECT video_id, x, o, sum(s) AS s FROM i0 GROUP BY ALL),
      m AS (SELECT a, b, p.x AS px, p.o AS po, q.x AS qx, q.o AS qo, p.s AS ps, q.s AS qs,
        0.65 * CASE WHEN len(list_distinct(p.x || q.x)) > 0 THEN len(list_intersect(p.x, q.x)) / len(list_distinct(p.x || q.x)) ELSE 0 END + 0.35 * CASE WHEN len(list_distinct(p.o || q.o)) > 0 THEN len(list_intersect(p.o, q.o)) / len(list_distinct(p.o || q.o)) ELSE 0 END + 1e-12 AS v
        FROM prs JOIN i p ON a = p.video_id JOIN i q ON b = q.video_id),
      ba AS (SELECT a, b, px, po, ps, max(v) AS v FROM m GROUP BY ALL), bb AS (SELECT a, b, qx, qo, qs, max(v) AS v FROM m GROUP BY ALL),
      ca AS (SELECT a, b, sum(CASE WHEN v >= 0.5 THEN ps ELSE 0 END) / sum(ps) AS c, sum(v * ps) / sum(ps) AS m FROM ba GROUP BY ALL), cb AS (SELECT a, b, sum(CASE WHEN v >= 0.5 THEN qs ELSE 0 END) / sum(qs) AS c, sum(v * qs) / sum(qs) AS m FROM bb GROUP BY ALL),
      r AS (SELECT a, b, round(ca.c, 6) + 0.0 AS covered_a, round(cb.c, 6) + 0.0 AS covered_b, round(ca.m, 6) + 0.0 AS best_a, round(cb.m, 6) + 0.0 AS best_b FROM ca JOIN cb USING (a, b))
      SELECT *, CASE WHEN covered_a >= 0.8 AND covered_b >= 0.8 THEN 'DUPLICATE_COVERAGE' WHEN covered_a >= 0.8 THEN 'A_CONTAINED_IN_B' WHEN covered_b >= 0.8 THEN 'B_CONTAINED_IN_A' WHEN greatest(covered_a, covered_b) >= 0.3 THEN 'PARTIAL_OVERLAP' ELSE 'DISTINCT' END AS verdict FROM r""",
    "parse_times": """WITH t AS (SELECT DISTINCT video_id, segment_id, CAST(floor(t0) AS BIGINT) AS s FROM caption_segments WHERE t0 >= 0 AND NOT isnan(t0))
      SELECT video_id, segment_id, CASE segment_id % 4 WHEN 0 THEN printf('%02d:%02d.5', s // 60, s % 60) WHEN 1 THEN printf('%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) WHEN 2 THEN CAST(s AS VARCHAR) ELSE 'soon' END AS text,
        CASE segment_id % 4 WHEN 0 THEN s + 0.5::DOUBLE WHEN 1 THEN s::DOUBLE WHEN 2 THEN s::DOUBLE END AS seconds FROM t""",
    "segment_labels": """SELECT segment_id, regexp_extract(file_path, '[^/]*$') || CASE WHEN coalesce(w, false) THEN '' ELSE '[' || CAST(round(t0) AS BIGINT) || '-' || CAST(round(t1) AS BIGINT) || 's]' END AS label
      FROM (SELECT DISTINCT segment_id, file_path, t0, t1, meta.whole_file AS w FROM signatures)""",
    "session_keys": "SELECT video_id, session_key AS session, regexp_extract('/' || session_key || '/', '/([A-Z]{2,5}-[0-9]+)/', 1) AS tag, ordinal AS t0, CAST(ordinal + 30 AS INTEGER) AS t1 FROM recordings",
    "episode_keys": """SELECT DISTINCT video_a, regexp_replace(regexp_replace(video_a, '/seg_[0-9]+$', ''), '^[ \t]+|[ \t]+$', '', 'g') AS episode FROM task_pairs WHERE video_a IS NOT NULL""",
    "suffix_lookup": """WITH p AS (SELECT DISTINCT file_path FROM signatures), n AS (SELECT DISTINCT video_id || '.mp4' AS name FROM recordings)
      SELECT name, CASE WHEN count(*) = 1 THEN min(file_path) END AS file_path, count(*) > 1 AS ambiguous FROM n JOIN p ON ends_with(file_path, '/' || name) OR file_path = name GROUP BY name""",
    "comparable_recordings": "SELECT video_id, count(DISTINCT segment_id) AS n FROM signatures GROUP BY video_id HAVING count(DISTINCT segment_id) >= 2",
}
