"""Queries over scored rows, feedback and traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import d_rnd
from ..operators import analytics as an
from ..operators import evaluation as ev
from ..operators import limits
from ..operators import monitoring as mo
from .registry import BAND, EVENTS_NOW, FEEDBACK, ORDERS_NOW, RATED, SCORED, SQL, TIER, d_rate, events_now, feedback, orders_now, query, rated, read, scored

_T = TIER.format("score")
_E_NOW, _O_NOW = f"TIMESTAMP '{EVENTS_NOW}'", f"TIMESTAMP '{ORDERS_NOW}'"


@query(f"""
    SELECT count(*) AS reports, avg(score) AS avg_score, count(*) FILTER (score >= 60) AS high, count(*) FILTER (score < 20) AS clean, count(*) FILTER (matches > 0) AS duplicates,
           count(*) FILTER (CAST(created_at AS DATE) = CAST({_O_NOW} AS DATE)) AS today, count(*) FILTER (created_at >= {_O_NOW} - INTERVAL 7 DAY) AS last_7_days FROM {SCORED}""")
def platform_totals(spark, sf_dir):
    return an.totals(scored(spark, sf_dir), "score", "matches", "created_at", orders_now())


@query(f"""
    SELECT bucket, (SELECT count(*) FROM {SCORED} WHERE score BETWEEN lo AND hi) AS count
    FROM (VALUES ('0-20', 0, 20), ('21-35', 21, 35), ('36-55', 36, 55), ('56-75', 56, 75), ('76-100', 76, 100)) b(bucket, lo, hi)""")
def score_distribution(spark, sf_dir):
    return an.score_distribution(scored(spark, sf_dir), "score")


@query(f"""
    SELECT CAST(created_at AS DATE) AS day, count(*) AS reports, {d_rnd('avg(score)', 1)} AS avg_score,
           {", ".join(f"count(*) FILTER (({_T}) = '{n}') AS {n.lower().replace(' ', '_')}" for n in ('Clean', 'Likely Human', 'Questionable', 'Likely Slop', 'Slop'))}
    FROM {SCORED} GROUP BY 1""")
def daily_trend(spark, sf_dir):
    return an.daily_trend(scored(spark, sf_dir), "score", "created_at")


@query(f"SELECT CAST(created_at AS DATE) AS day, count(*) AS feedback, {d_rnd('avg(rating)', 2)} AS avg_rating, {d_rate('count(*) FILTER (helpful) * 100', 'count(*)', 1)} AS agreement_pct FROM {FEEDBACK} GROUP BY 1")
def feedback_trend(spark, sf_dir):
    return an.feedback_trend(feedback(spark, sf_dir), "rating", "helpful", "created_at")


@query("SELECT count(DISTINCT user_id) AS visitors, count(DISTINCT CAST(ts AS DATE)) AS days, count(DISTINCT (user_id, CAST(ts AS DATE))) AS visits FROM events")
def distinct_visitors(spark, sf_dir):
    return an.distinct_visitors(read(spark, sf_dir, "events"), "user_id", "ts")


@query(f"SELECT {_T} AS tier, count(*) AS count FROM {SCORED} GROUP BY 1")
def tier_breakdown(spark, sf_dir):
    return scored(spark, sf_dir).groupBy(an.tier(F.col("score")).alias("tier")).agg(F.count("*").alias("count"))


@query(f"SELECT family AS key, count(*) AS count FROM {SCORED} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_families(spark, sf_dir):
    return an.top_k(scored(spark, sf_dir), "family")


@query("""
    SELECT key, count(*) AS count FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def json_top_keys(spark, sf_dir):
    keys = F.explode(F.json_object_keys("props")).alias("key")
    return an.top_k(read(spark, sf_dir, "events").select(keys), "key")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50")
def json_path_filter(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return read(spark, sf_dir, "events").select("event_id", k.alias("k")).where("k >= 50")


@query(f"SELECT {_T} AS tier, coalesce(family, 'FLAT') AS family, count(*) AS reports, {d_rnd('avg(score)', 1)} AS avg_score FROM {SCORED} GROUP BY GROUPING SETS ((), ({_T}), (coalesce(family, 'FLAT')))")
def feed_summary(spark, sf_dir):
    return an.feed_summary(scored(spark, sf_dir), "score", "family")


@query("SELECT string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS l_returnflag, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS l_linestatus FROM lineitem")
def engine_versions(spark, sf_dir):
    return an.distinct_lists(read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("""
    WITH v AS (SELECT DISTINCT p_size // 10 || '.' || p_size % 10 || '.' || length(p_brand) AS version FROM part)
    SELECT row_number() OVER (ORDER BY list_transform(string_split(version, '.'), lambda x: CAST(x AS INT)) DESC, version DESC) AS place, version FROM v""")
def version_list(spark, sf_dir):
    v = F.concat_ws(".", F.expr("p_size div 10"), F.expr("p_size % 10"), F.length("p_brand"))
    return an.semver_desc(read(spark, sf_dir, "part").select(v.alias("version")), "version")


_BINS = f"""
    SELECT CAST(b AS INTEGER) AS bin, CAST(b * 10 AS INTEGER) AS low, CAST(CASE WHEN b = 9 THEN 100 ELSE b * 10 + 9 END AS INTEGER) AS high, count(score) AS count,
           CAST(sum(count(score)) OVER (ORDER BY b) AS BIGINT) AS cumulative
    FROM range(10) r(b) LEFT JOIN {SCORED} s ON least(score, 99) // 10 = b GROUP BY b"""


@query(_BINS)
def cohort_histogram(spark, sf_dir):
    return an.cohort_bins(scored(spark, sf_dir), "score")


@query(f"WITH b AS ({_BINS}) SELECT min_by(CAST(floor((low + high) / 2 + 0.5) AS BIGINT), bin) AS median FROM b WHERE cumulative * 2 >= (SELECT sum(count) FROM b)")
def cohort_median(spark, sf_dir):
    return an.median_of_bins(an.cohort_bins(scored(spark, sf_dir), "score"))


@query(f"""
    WITH b AS ({_BINS}) SELECT report_id, score, CAST(floor((cumulative - count + count / 2) / (SELECT sum(count) FROM b) * 100 + 0.5) AS BIGINT) AS percentile
    FROM {SCORED} JOIN b ON least(score, 99) // 10 = bin""")
def cohort_bin_percentile(spark, sf_dir):
    s = scored(spark, sf_dir)
    return an.bin_percentile(s, an.cohort_bins(s, "score"), "report_id", "score")


@query(f"""
    WITH p AS (SELECT score, count(*) AS n FROM {SCORED} GROUP BY 1), r AS (SELECT score, n, sum(n) OVER (ORDER BY score) - n AS below, sum(n) OVER () AS total FROM p)
    SELECT report_id, score, floor((below + n / 2) / total * 100 * 10 + 0.5) / 10 AS percentile FROM {SCORED} JOIN r USING (score)""")
def cohort_midrank(spark, sf_dir):
    return an.mid_rank(scored(spark, sf_dir), "report_id", "score")


@query(f"SELECT family, CAST(floor(quantile_cont(score, 0.5) + 0.5) AS BIGINT) AS median, count(*) AS samples FROM {SCORED} GROUP BY 1")
def engine_medians(spark, sf_dir):
    return an.medians(scored(spark, sf_dir), "family", "score")


def _pct(by: str) -> str:
    p = ", ".join(f"{d_rnd(d_rnd(f'quantile_cont(value, {q})', 6), 1)} AS {n}" for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)))
    return f"SELECT {by + ',' if by else ''} {p}, count(*) AS samples FROM events WHERE value >= 0 {'GROUP BY ALL' if by else ''}"


@query(_pct("event_type"))
def latency_percentiles(spark, sf_dir):
    return an.latency(read(spark, sf_dir, "events"), "value", ["event_type"])


@query(_pct("CAST(ts AS DATE) AS day, event_type"))
def latency_daily(spark, sf_dir):
    return an.latency(read(spark, sf_dir, "events"), "value", [F.to_date("ts").alias("day"), "event_type"])


@query("""
    SELECT event_type, CAST(hi AS INTEGER) AS lt_ms, count(value) FILTER (value * 30 >= coalesce(lo, -1e300) AND value * 30 < coalesce(hi, 1e300)) AS count
    FROM events, (VALUES (NULL, 50), (50, 100), (100, 200), (200, 400), (400, 800), (800, 1500), (1500, 3000), (3000, 5000), (5000, 10000), (10000, 20000), (20000, NULL)) b(lo, hi)
    GROUP BY event_type, lo, hi""")
def latency_bins(spark, sf_dir):
    return an.latency_bins(read(spark, sf_dir, "events").withColumn("ms", F.col("value") * 30), "ms", "event_type")


@query(f"""
    WITH e AS (SELECT CASE WHEN event_type = 'purchase' THEN value * 4 ELSE value END AS v, event_type AS stage FROM events),
    p AS (SELECT stage, {d_rnd(d_rnd('quantile_cont(v, 0.95)', 6), 1)} AS p95 FROM e WHERE v >= 0 GROUP BY 1), w AS (SELECT {d_rnd(d_rnd('quantile_cont(v, 0.95)', 6), 1)} AS all_p95 FROM e WHERE v >= 0),
    o AS (SELECT list(p95 ORDER BY p95, stage) AS s, list(stage ORDER BY p95, stage) AS g, count(*) AS n FROM p)
    SELECT g[n] AS stage, s[n] AS p95, all_p95 AS pipeline_p95, {d_rnd('s[n] / s[n // 2 + 1]', 2)} AS ratio FROM o, w
    WHERE n >= 2 AND s[n // 2 + 1] > 0 AND s[n] / s[n // 2 + 1] >= 1.5 AND s[n] / all_p95 >= 0.25""")
def worst_stage(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_type") == "purchase", F.col("value") * 4).otherwise(F.col("value")))
    return an.worst_stage(e, "event_type", "v")


@query(f"""
    SELECT event_type AS engine, count(DISTINCT CAST(ts AS DATE)) AS active_days, floor(count(DISTINCT CAST(ts AS DATE)) / 30 * 1000 + 0.5) / 10 AS uptime_pct, max(ts) AS last_seen,
           CASE WHEN epoch({_E_NOW} - max(ts)) <= 3600 THEN 'operational' WHEN epoch({_E_NOW} - max(ts)) <= 21600 THEN 'degraded' ELSE 'down' END AS status
    FROM events WHERE ts >= {_E_NOW} - INTERVAL 30 DAY AND ts <= {_E_NOW} GROUP BY 1""")
def uptime_days(spark, sf_dir):
    return an.uptime(read(spark, sf_dir, "events"), "event_type", "ts", events_now())


_GAPS = f"""
    SELECT engine, started, ended FROM (SELECT event_type AS engine, ts AS started, lead(ts) OVER (PARTITION BY event_type ORDER BY ts) AS ended FROM events WHERE user_id % 20 = 0)
    WHERE epoch(coalesce(ended, {_E_NOW})) - epoch(started) > 3600"""


def _gaps(spark, sf_dir):
    # Users divisible by 20 are the "engine traces" of this stand-in: all events together are never an hour apart.
    return an.gaps(read(spark, sf_dir, "events").where("user_id % 20 = 0"), "event_type", "ts", events_now())


@query(_GAPS)
def gap_incidents(spark, sf_dir):
    return _gaps(spark, sf_dir)


@query(f"""
    WITH g AS ({_GAPS}), m AS (SELECT *, coalesce(ended, {_E_NOW}) AS e FROM g),
    b AS (SELECT *, max(e) OVER (ORDER BY started, e, engine ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m),
    i AS (SELECT *, sum(CASE WHEN before IS NULL OR started > before THEN 1 ELSE 0 END) OVER (ORDER BY started, e, engine ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM b)
    SELECT min(started) AS started, CASE WHEN count(*) FILTER (ended IS NULL) = 0 THEN max(ended) END AS ended, string_agg(DISTINCT engine, ',' ORDER BY engine) AS engines,
           CASE WHEN count(DISTINCT engine) >= 5 THEN 'outage' ELSE 'degraded' END AS severity FROM i GROUP BY island""")
def merged_incidents(spark, sf_dir):
    return an.incidents(_gaps(spark, sf_dir), events_now(), 5)


#: The two queries above keep their SQL, which looks at a twentieth of the users; these two are the same over all events.
_ALL_GAPS = _GAPS.replace(" WHERE user_id % 20 = 0", "")


def _all_gaps(spark, sf_dir):
    return an.gaps(read(spark, sf_dir, "events"), "event_type", "ts", events_now())


@query(_ALL_GAPS)
def gap_incidents_all(spark, sf_dir):
    return _all_gaps(spark, sf_dir)


@query(SQL["merged_incidents"].replace(_GAPS, _ALL_GAPS))
def merged_incidents_all(spark, sf_dir):
    return an.incidents(_all_gaps(spark, sf_dir), events_now(), 5)


@query(f"SELECT count(*) AS feedback, {d_rnd('avg(rating)', 2)} AS avg_rating, count(*) FILTER (helpful) AS helpful, {d_rate('count(*) FILTER (helpful) * 100', 'count(*)', 1)} AS helpful_pct FROM {FEEDBACK}")
def feedback_summary(spark, sf_dir):
    return ev.feedback_summary(feedback(spark, sf_dir), "rating", "helpful")


@query(f"SELECT CAST(r AS INTEGER) AS rating, (SELECT count(*) FROM {FEEDBACK} WHERE rating = r) AS count FROM range(1, 6) t(r)")
def rating_histogram(spark, sf_dir):
    return ev.rating_histogram(feedback(spark, sf_dir), "rating")


@query(f"""
    SELECT feedback_id, report_id, rating, score, abs(score - rating * 20) AS gap FROM {RATED}
    WHERE (rating <= 2 AND score < 30) OR (rating <= 2 AND score > 70) OR NOT helpful ORDER BY gap DESC, feedback_id LIMIT 50""")
def feedback_outliers(spark, sf_dir):
    return ev.outliers(feedback(spark, sf_dir).drop("created_at"), scored(spark, sf_dir).select("report_id", "score"))


@query(f"""
    SELECT {BAND.format('score')} AS bucket, count(*) AS feedback, {d_rnd('avg(rating)', 2)} AS avg_rating, {d_rate('count(*) FILTER (helpful) * 100', 'count(*)', 1)} AS helpful_pct, min(score) AS min_score
    FROM {RATED} GROUP BY 1""")
def score_by_rating(spark, sf_dir):
    return ev.score_by_rating(rated(spark, sf_dir))


_SIGNALS = """
    SELECT doc_id, l.quality = 1 AS t, list_filter(['has_url', 'has_mail', 'has_digits', 'long', 'long'], lambda x: CASE x WHEN 'has_url' THEN text LIKE '%http%' WHEN 'has_mail' THEN text LIKE '%@%' WHEN 'has_digits' THEN regexp_matches(text, '[0-9]') ELSE n_chars > 2000 END) AS s
    FROM documents JOIN labels l USING (doc_id)"""


@query(f"""
    WITH d AS ({_SIGNALS}), e AS (SELECT t, unnest(list_distinct(s)) AS signal FROM d)
    SELECT signal, count(*) AS fires, count(*) FILTER (t) AS correct, CASE WHEN count(*) >= 5 THEN {d_rate('count(*) FILTER (t)', 'count(*)', 3)} END AS precision FROM e GROUP BY 1""")
def per_signal_precision(spark, sf_dir):
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    long = F.col("n_chars") > 2000
    tests = (("has_url", F.col("text").contains("http")), ("has_mail", F.col("text").contains("@")), ("has_digits", F.col("text").rlike("[0-9]")), ("long", long), ("long", long))
    signals = F.array_compact(F.array(*[F.when(t, n) for n, t in tests]))
    return ev.signal_precision(d.select("doc_id", "quality", signals.alias("s")), "s", F.col("quality") == 1)


def _m(tp, fp, tn, fn, p):
    return f"{d_rate(tp, f'({tp} + {fp})', p)} AS precision, {d_rate(tp, f'({tp} + {fn})', p)} AS recall, {d_rate(f'({tp} * 2)', f'({tp} * 2 + {fp} + {fn})', p)} AS f1, {d_rate(f'({tp} + {tn})', f'({tp} + {fp} + {tn} + {fn})', p)} AS accuracy"


def _confusion(rows: str, by: str, places: int) -> str:
    g = "grp, " if by else ""
    return f"""
    WITH c AS (SELECT {g} count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (NOT t AND NOT p) AS tn, count(*) FILTER (t AND NOT p) AS fn FROM ({rows}) {'GROUP BY grp' if by else ''})
    SELECT {g} tp, fp, tn, fn, {_m('tp', 'fp', 'tn', 'fn', places)} FROM c"""


_HELD = "CAST('0x' || substr(md5(CAST({0} AS VARCHAR)), 1, 8) AS BIGINT) % 5 = 0"
_ROWS = f"SELECT score >= 50 AS p, rating >= 3 AS t, {_HELD.format('report_id')} AS grp FROM {RATED}"


def _evaluated(spark, sf_dir):
    return ev.confusion(rated(spark, sf_dir), F.col("rating") >= 3, F.col("score") >= 50, ev.holdout(F.col("report_id")))


@query(_confusion(_ROWS, "grp", 3))
def holdout_eval(spark, sf_dir):
    return _evaluated(spark, sf_dir)


@query(f"""
    WITH e AS ({_confusion(_ROWS, 'grp', 3)})
    SELECT {d_rnd("max(f1) FILTER (NOT grp) - max(f1) FILTER (grp)", 3)} AS f1_gap, {d_rnd("max(accuracy) FILTER (NOT grp) - max(accuracy) FILTER (grp)", 3)} AS accuracy_gap,
           coalesce(max(tp + fp + tn + fn) FILTER (grp), 0) AS held_out_rows,
           max(tp + fp + tn + fn) FILTER (grp) >= 20 AND ({d_rnd("max(f1) FILTER (NOT grp) - max(f1) FILTER (grp)", 3)} > 0.1 OR {d_rnd("max(accuracy) FILTER (NOT grp) - max(accuracy) FILTER (grp)", 3)} > 0.1) AS drifted FROM e""")
def holdout_drift(spark, sf_dir):
    return ev.holdout_gap(_evaluated(spark, sf_dir))


@query(_confusion("SELECT quality = 1 AS t, n_chars >= 800 AS p FROM documents JOIN labels USING (doc_id)", "", 4))
def confusion_by_quality(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id")
    return ev.confusion(d, F.col("quality") == 1, F.col("n_chars") >= 800, places=4)


_CAL = f"""
    WITH s(bucket, expected) AS (VALUES ('0-20', 4.5e0), ('21-40', 3.5e0), ('41-60', 3.0e0), ('61-80', 3.5e0), ('81-100', 4.0e0)),
    p AS (SELECT {BAND.format('score')} AS bucket, count(*) AS n, sum(rating) AS r, count(*) FILTER (helpful) AS h FROM {RATED} WHERE NOT ({_HELD.format('feedback_id')}) GROUP BY 1),
    f AS (SELECT s.bucket, expected, coalesce(n, 0) AS n, coalesce(h, 0) AS h, {d_rate('coalesce(r, 0)', 'coalesce(n, 0)', 2)} AS a FROM s LEFT JOIN p USING (bucket)),
    d AS (SELECT *, a - expected AS dev, bucket IN ('0-20', '21-40') AS good, bucket IN ('61-80', '81-100') AS slop FROM f)
    SELECT bucket, n AS feedback, a AS avg_rating, {d_rate('h * 100', 'n', 1)} AS helpful_pct, floor(dev * 100 + 0.5) / 100 AS deviation,
           CASE WHEN n < 5 THEN 'insufficient-data' WHEN abs(dev) <= 0.5 THEN 'accurate' WHEN good AND dev < -0.5 THEN 'under-scoring' WHEN slop AND dev < -0.5 THEN 'over-scoring'
                WHEN good AND dev > 0.5 THEN 'accurate' WHEN dev < -0.5 THEN 'over-scoring' ELSE 'under-scoring' END AS signal FROM d"""


def _calibrated(spark, sf_dir):
    return ev.calibration(rated(spark, sf_dir).where(~ev.holdout(F.col("feedback_id"))))


@query(_CAL)
def calibration_buckets(spark, sf_dir):
    return _calibrated(spark, sf_dir)


@query(f"""
    WITH c AS ({_CAL}), n AS (SELECT count(*) FILTER (signal IN ('over-scoring', 'under-scoring')) AS problems FROM c)
    SELECT problems, CASE WHEN problems = 0 THEN 'good' WHEN problems <= 1 THEN 'needs-attention' ELSE 'needs-tuning' END AS health FROM n""")
def calibration_health(spark, sf_dir):
    return ev.health(_calibrated(spark, sf_dir))


@query("""
    WITH c AS (SELECT 's' || s_suppkey AS name, s_acctbal AS old, s_acctbal * (1 + (s_suppkey % 5) / 10) AS new FROM supplier)
    SELECT name, old, new, CASE WHEN old <> 0 THEN abs(new - old) / abs(old) WHEN new <> 0 THEN 1.0 ELSE 0.0 END AS relative_change,
           (CASE WHEN old <> 0 THEN abs(new - old) / abs(old) WHEN new <> 0 THEN 1.0 ELSE 0.0 END) >= 0.25 AS blocked FROM c""")
def config_change_guard(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").withColumn("name", F.concat(F.lit("s"), F.col("s_suppkey").cast("string")))
    new = s.select("name", (F.col("s_acctbal") * (1 + (F.col("s_suppkey") % 5) / 10)).alias("value"))
    return ev.change_guard(s.select("name", F.col("s_acctbal").alias("value")), new, 0.25)


_P = "(n_chars % 1000) / 999"


def _labelled(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang").join(read(spark, sf_dir, "labels"), "doc_id")
    return d.withColumn("p", (F.col("n_chars") % 1000) / 999)


@query(f"SELECT {d_rnd(f'avg(power({_P} - quality, 2))', 6)} AS brier, count(*) AS rows FROM documents JOIN labels USING (doc_id)")
def brier(spark, sf_dir):
    return ev.brier(_labelled(spark, sf_dir), F.col("p"), F.col("quality") == 1)


@query(f"""
    WITH b AS (SELECT least(floor({_P} * 10), 9) AS bin, {_P} AS p, CAST(quality AS DOUBLE) AS t FROM documents JOIN labels USING (doc_id)), g AS (SELECT bin, count(*) AS n, avg(p) AS conf, avg(t) AS acc FROM b GROUP BY 1)
    SELECT {d_rnd('sum(n * abs(conf - acc)) / sum(n)', 6)} AS ece, count(*) AS bins FROM g""")
def ece(spark, sf_dir):
    return ev.ece(_labelled(spark, sf_dir), F.col("p"), F.col("quality") == 1)


_CLASSES = f"""
    WITH c AS (SELECT lang AS t, CASE WHEN n_chars % 7 < 5 THEN lang WHEN n_chars % 2 = 0 THEN 'en' ELSE 'de' END AS p FROM documents),
    a AS (SELECT t AS label, count(*) AS support, count(*) FILTER (t = p) AS tp FROM c GROUP BY 1), s AS (SELECT p AS label, count(*) AS said FROM c GROUP BY 1)
    SELECT label, support, {d_rate('tp', 'support', 4)} AS recall, {d_rate('tp', 'coalesce(said, 0)', 4)} AS precision, {d_rate('tp * 2', '(support + coalesce(said, 0))', 4)} AS f1 FROM a LEFT JOIN s USING (label)"""


def _classes(spark, sf_dir):
    p = F.when(F.col("n_chars") % 7 < 5, F.col("lang")).when(F.col("n_chars") % 2 == 0, "en").otherwise("de")
    return ev.class_metrics(read(spark, sf_dir, "documents"), F.col("lang"), p)


@query(_CLASSES)
def per_class_recall(spark, sf_dir):
    return _classes(spark, sf_dir)


@query(f"SELECT {d_rnd('avg(f1)', 6)} AS macro_f1, count(*) AS classes FROM ({_CLASSES})")
def macro_f1(spark, sf_dir):
    return ev.macro_f1(_classes(spark, sf_dir))


@query("SELECT event_type, quantile_disc(value, 0.95) AS value FROM events GROUP BY 1")
def nearest_rank_p95(spark, sf_dir):
    return ev.nearest_rank(read(spark, sf_dir, "events"), "value", "event_type", 0.95)


@query(f"""
    WITH per AS (SELECT source, lang, CAST(floor(avg(n_chars % 5) + 0.5) AS BIGINT) AS level FROM documents GROUP BY ALL), f AS (SELECT source, min_by(level, lang) AS base, min(lang) AS base_language FROM per GROUP BY 1)
    SELECT lang, {d_rate('count(*) FILTER (abs(level - base) <= 1)', 'count(*)', 3)} AS agreement, count(*) AS compared FROM per JOIN f USING (source) WHERE lang <> base_language GROUP BY 1""")
def language_agreement(spark, sf_dir):
    return ev.language_agreement(read(spark, sf_dir, "documents"), "lang", "source", F.col("n_chars") % 5)


_B = "CASE WHEN label IN ('STRONG', 'PROMISING') THEN 'T1' WHEN label IN ('LIKELY INVALID', 'HIGH RISK') THEN 'T3' ELSE 'NEUTRAL' END"
_WEEKS = f"""
    SELECT week, reports, t1_count, t1_mean, t3_count, t3_mean, {d_rnd('t1_mean - t3_mean', 1)} AS gap, t1_count >= 3 AND t3_count >= 3 AS eligible
    FROM (SELECT CAST(date_trunc('week', created_at) AS DATE) AS week, count(*) AS reports, count(*) FILTER ({_B} = 'T1') AS t1_count, {d_rnd(f"avg(composite) FILTER ({_B} = 'T1')", 1)} AS t1_mean,
                 count(*) FILTER ({_B} = 'T3') AS t3_count, {d_rnd(f"avg(composite) FILTER ({_B} = 'T3')", 1)} AS t3_mean FROM {SCORED} GROUP BY 1)"""
_SHIFTS = f"""
    SELECT m.week, m.bucket, m.family, o.week AS old_week, o.mean AS old_mean, m.mean, {d_rnd('m.mean - o.mean', 1)} AS shift
    FROM mm m JOIN mm o ON m.k = o.k + 1 AND m.bucket = o.bucket AND m.family = o.family WHERE abs({d_rnd('m.mean - o.mean', 1)}) >= 5"""
_MM = f"""
    b AS (SELECT CAST(date_trunc('week', created_at) AS DATE) AS week, {_B} AS bucket, family, composite FROM {SCORED}), w AS (SELECT week, row_number() OVER (ORDER BY week) AS k FROM (SELECT DISTINCT week FROM b)),
    mm AS (SELECT week, k, bucket, family, {d_rnd('avg(composite)', 1)} AS mean FROM b JOIN w USING (week) WHERE bucket <> 'NEUTRAL' GROUP BY week, k, bucket, family HAVING count(*) >= 3)"""


def _weeks(spark, sf_dir):
    return mo.weekly_gap(scored(spark, sf_dir), "created_at", "label", "composite")


def _shifts(spark, sf_dir):
    return mo.family_shifts(scored(spark, sf_dir), "created_at", "label", "composite", "family")


@query(_WEEKS)
def weekly_gap(spark, sf_dir):
    return _weeks(spark, sf_dir)


@query(f"WITH {_MM} {_SHIFTS}")
def family_shift_flags(spark, sf_dir):
    return _shifts(spark, sf_dir)


_FLAGS = f"""
    SELECT 'GAP_BELOW_45|' || week AS flag_key, week, 'GAP_BELOW_45' AS kind FROM ({_WEEKS}) WHERE eligible AND gap < 45
    UNION ALL SELECT 'FAMILY_MEAN_SHIFT|' || week || '|' || bucket || '|' || family, week, 'FAMILY_MEAN_SHIFT' FROM ({_SHIFTS})"""


@query(f"WITH {_MM}, f AS ({_FLAGS}) SELECT DISTINCT flag_key, week, kind FROM f WHERE flag_key NOT IN (SELECT flag_key FROM f WHERE year(week) < 1995)")
def new_drift_flags(spark, sf_dir):
    flags = mo.drift_flags(_weeks(spark, sf_dir), _shifts(spark, sf_dir))
    return mo.new_flags(flags, flags.where(F.year("week") < 1995)).select("flag_key", "week", "kind")


@query(f"""
    WITH e AS (SELECT week, gap, row_number() OVER (ORDER BY week DESC) AS back FROM ({_WEEKS}) WHERE eligible AND gap IS NOT NULL)
    SELECT week, gap AS spread, {d_rnd('gap - lag(gap) OVER (ORDER BY week)', 1)} AS delta FROM e WHERE back <= 12""")
def public_drift_last12(spark, sf_dir):
    return mo.public_drift(_weeks(spark, sf_dir))


_NEW = "least(100, greatest(0, score + CAST(report_id % 41 AS BIGINT) - 20))"
_DIR = """CASE WHEN old_tier = new_tier THEN 'none' WHEN os = 'legit' AND ns = 'slop' THEN 'legit_to_slop' WHEN os = 'slop' AND ns = 'legit' THEN 'slop_to_legit'
    WHEN (os = 'legit' AND ns = 'middle') OR (os = 'middle' AND ns = 'slop') THEN 'tightened' WHEN (os = 'slop' AND ns = 'middle') OR (os = 'middle' AND ns = 'legit') THEN 'loosened' ELSE 'lateral' END"""
_SIDE = "CASE WHEN {0} IN ('Clean', 'Likely Human') THEN 'legit' WHEN {0} IN ('Likely Slop', 'Slop') THEN 'slop' ELSE 'middle' END"
_LOG = f"""
    SELECT report_id, old_score, new_score, scored_at, old_tier, new_tier, {_DIR} AS direction FROM (SELECT *, {_SIDE.format('old_tier')} AS os, {_SIDE.format('new_tier')} AS ns
    FROM (SELECT report_id, score AS old_score, {_NEW} AS new_score, created_at AS scored_at, {_T} AS old_tier, {TIER.format(_NEW)} AS new_tier FROM {SCORED}))"""


def _log(spark, sf_dir):
    s = scored(spark, sf_dir)
    new = F.least(F.lit(100), F.greatest(F.lit(0), F.col("score") + F.col("report_id") % 41 - 20)).cast("bigint")
    return mo.rescore(s, "report_id", F.col("score"), new, "created_at")


@query(_LOG)
def rescore_log(spark, sf_dir):
    return _log(spark, sf_dir)


_KINDS = ("legit_to_slop", "slop_to_legit", "tightened", "loosened", "lateral")


@query(f"""
    WITH s AS (SELECT unnest(generate_series(CAST({_O_NOW} AS DATE) - INTERVAL 29 DAY, CAST({_O_NOW} AS DATE), INTERVAL 1 DAY)) AS d),
    l AS (SELECT CAST(scored_at AS DATE) AS day, direction FROM ({_LOG}) WHERE scored_at >= {_O_NOW} - INTERVAL 30 DAY AND scored_at <= {_O_NOW}),
    j AS (SELECT coalesce(CAST(d AS DATE), day) AS day, direction FROM s FULL JOIN l ON day = CAST(d AS DATE))
    SELECT day, count(direction) AS total, count(*) FILTER (direction <> 'none') AS flips, {", ".join(f"count(*) FILTER (direction = '{k}') AS {k}" for k in _KINDS)},
           {d_rate("count(*) FILTER (direction <> 'none')", "count(direction)", 4)} AS flip_rate FROM j GROUP BY ROLLUP (day)""")
def flip_summary(spark, sf_dir):
    return mo.flip_summary(_log(spark, sf_dir), orders_now())


@query(f"SELECT report_id, old_tier, new_tier, old_score, new_score, direction FROM ({_LOG}) WHERE CAST(scored_at AS DATE) = DATE '1998-07-01' AND direction <> 'none'")
def flips_for_day(spark, sf_dir):
    return mo.flips_of_day(_log(spark, sf_dir), F.lit("1998-07-01").cast("date"))


@query(f"""
    WITH r AS (SELECT * FROM ({_LOG}) ORDER BY scored_at DESC, report_id DESC LIMIT 100)
    SELECT count(*) AS total_reports, count(*) FILTER (direction <> 'none') AS flip_count, {d_rate("count(*) FILTER (direction <> 'none')", 'count(*)', 4)} AS flip_rate,
           count(*) FILTER (direction <> 'none') <= count(*) * 0.005 AS passed FROM r""")
def replay_gate(spark, sf_dir):
    return mo.replay_gate(_log(spark, sf_dir))


@query(f"""
    WITH o AS (SELECT *, old_tier <> new_tier OR abs(old_score - new_score) >= 10 AS d, direction IN ('legit_to_slop', 'slop_to_legit') AS x FROM ({_LOG}))
    SELECT count(*) AS total, count(*) FILTER (d) AS diverged, {d_rate('count(*) FILTER (d)', 'count(*)', 4)} AS divergence_rate, count(*) FILTER (x) AS legit_slop_flips,
           {d_rate('count(*) FILTER (d)', 'count(*)', 4)} > 0.1 OR count(*) FILTER (x) > 20 AS alert FROM o""")
def shadow_drift(spark, sf_dir):
    log = _log(spark, sf_dir)
    return mo.shadow_drift(log.select("report_id", F.col("old_score").alias("score")), log.select("report_id", F.col("new_score").alias("shadow_score")))


@query(f"""
    WITH s AS (SELECT ts, event_type AS archetype, user_id % 4 AS count, value AS mean, value * 1.5 AS max, 100.0 AS ceiling FROM events),
    o AS (SELECT date_trunc('day', ts) AS ts, archetype, CAST(sum(count) AS BIGINT) AS count, {d_rnd('sum(mean * greatest(count, 1)) / sum(greatest(count, 1))', 2)} AS mean, {d_rnd('max(max)', 2)} AS max, min_by(ceiling, ts) AS ceiling, true AS aggregated
          FROM s WHERE ts < {_E_NOW} - INTERVAL 7 DAY GROUP BY 1, 2),
    u AS (SELECT * FROM o UNION ALL SELECT ts, archetype, count, mean, max, ceiling, false FROM s WHERE ts >= {_E_NOW} - INTERVAL 7 DAY)
    SELECT CAST(ts AS TIMESTAMP) AS ts, archetype, count, mean, max, CAST(ceiling AS DOUBLE) AS ceiling, aggregated, {d_rnd('ceiling - max', 2)} AS min_distance FROM u""")
def compact_history(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    s = e.select("ts", F.col("event_type").alias("archetype"), (F.col("user_id") % 4).alias("count"), F.col("value").alias("mean"), (F.col("value") * 1.5).alias("max"), F.lit(100.0).alias("ceiling"))
    return mo.compact_snapshots(s, events_now(), 7)


@query(f"""
    WITH e AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v, CASE WHEN event_id % 4 = 0 THEN '' ELSE CAST(event_id AS VARCHAR) END AS s, user_id % 4 + 1 AS w FROM events)
    SELECT CAST(ts AS DATE) AS day, event_type, CAST(sum(w) AS BIGINT) AS weight, {d_rnd('sum(v * w) / sum(CASE WHEN v IS NOT NULL THEN w END)', 2)} AS mean, arg_max(s, (ts, s)) FILTER (s <> '') AS sample FROM e GROUP BY ALL""")
def compact_dataset(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    e = e.withColumn("v", F.when(F.col("event_id") % 3 != 0, F.col("value"))).withColumn("s", F.when(F.col("event_id") % 4 == 0, "").otherwise(F.col("event_id").cast("string"))).withColumn("w", F.col("user_id") % 4 + 1)
    return mo.compact_means(e, "event_type", "ts", "v", "w", "s")


@query(f"""
    SELECT family, t1_count, t1_mean, t3_count, t3_mean, {d_rnd('t1_mean - t3_mean', 1)} AS gap FROM (
        SELECT family, count(*) FILTER ({_B} = 'T1') AS t1_count, {d_rnd(f"avg(composite) FILTER ({_B} = 'T1')", 1)} AS t1_mean, count(*) FILTER ({_B} = 'T3') AS t3_count, {d_rnd(f"avg(composite) FILTER ({_B} = 'T3')", 1)} AS t3_mean
        FROM {SCORED} GROUP BY 1)""")
def cohort_battery(spark, sf_dir):
    s = scored(spark, sf_dir)
    return mo.cohort_battery(s.withColumn("level", mo.bucket_of_label(F.col("label"))), "family", "level", "composite")


@query(f"""
    SELECT report_id, family, rank FROM (SELECT report_id, family, row_number() OVER (PARTITION BY family ORDER BY md5('1998-08-02|' || report_id), report_id) AS rank FROM {SCORED}) WHERE rank <= 5""")
def daily_sample(spark, sf_dir):
    return mo.daily_sample(scored(spark, sf_dir).select("report_id", "family"), "family", "report_id", "1998-08-02", 5)


@query(f"SELECT family, count(*) AS count, {d_rnd('avg(score)', 4)} AS mean, min(score) AS min, max(score) AS max FROM {SCORED} GROUP BY 1")
def dataset_summary(spark, sf_dir):
    return mo.summary_by(scored(spark, sf_dir), "family", "score")


@query(f"""
    WITH q AS (SELECT CASE mode WHEN 'O' THEN 'pending' WHEN 'F' THEN 'promoted' ELSE 'rejected' END AS status, epoch({_O_NOW}) - epoch(created_at) AS age FROM {SCORED}),
    o AS (SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'promoted') AS promoted, count(*) FILTER (status = 'rejected') AS rejected,
                 count(*) FILTER (age >= 0 AND age < 604800) AS this_week, count(*) FILTER (age >= 604800 AND age < 1209600) AS last_week FROM q)
    SELECT *, this_week - last_week AS delta, {d_rnd('(this_week - last_week) * 100.0 / nullif(last_week, 0)', 1)} AS delta_pct FROM o""")
def queue_stats(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("status", F.when(F.col("mode") == "O", "pending").when(F.col("mode") == "F", "promoted").otherwise("rejected"))
    return mo.queue_stats(s, "status", "created_at", orders_now())


_AGE = f"(epoch({_O_NOW}) - epoch(created_at)) / 86400"
_ACT = f"""CASE WHEN status = 'abandoned' AND {_AGE} > 90 THEN 'delete' WHEN s IS NULL AND {_AGE} > 30 THEN 'delete_dust' WHEN status = 'pending' AND {_AGE} > 30 THEN 'mark_abandoned' ELSE 'keep' END"""
_RET = f"(SELECT report_id, created_at, CASE mode WHEN 'O' THEN 'pending' WHEN 'P' THEN 'abandoned' ELSE 'done' END AS status, CASE WHEN score % 10 = 0 THEN NULL ELSE score END AS s FROM {SCORED})"


def _retained(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("status", F.when(F.col("mode") == "O", "pending").when(F.col("mode") == "P", "abandoned").otherwise("done")).withColumn("s", F.when(F.col("score") % 10 != 0, F.col("score")))
    return mo.retention(s, "created_at", "status", "s", orders_now())


@query(f"SELECT {_ACT} AS action, count(*) AS count FROM {_RET} GROUP BY 1")
def retention_actions(spark, sf_dir):
    return _retained(spark, sf_dir).groupBy("action").agg(F.count("*").alias("count"))


@query(f"SELECT report_id, {_ACT} AS action FROM {_RET} WHERE {_ACT} NOT IN ('delete', 'delete_dust')")
def retention_prune(spark, sf_dir):
    return mo.prune(_retained(spark, sf_dir)).select("report_id", "action")


@query("""
    WITH l AS (SELECT event_id AS id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT event_id AS rid, user_id, ts FROM events WHERE event_type = 'click'),
    j AS (SELECT id, rid, abs(epoch_us(l.ts) - epoch_us(r.ts)) / 1000000 AS gap FROM l JOIN r ON l.user_id = r.user_id AND r.ts BETWEEN l.ts - INTERVAL 30 MINUTE AND l.ts + INTERVAL 30 MINUTE)
    SELECT id, arg_min(rid, (gap, rid)) AS rid, floor(min(gap) * 1000 + 0.5) / 1000 AS gap_s FROM j GROUP BY 1""")
def nearest_trace(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return mo.nearest_within(e.where("event_type = 'purchase'").select(F.col("event_id").alias("id"), "user_id", "ts"), e.where("event_type = 'click'").select(F.col("event_id").alias("rid"), "user_id", "ts"), "user_id", "ts", 1800)


_VEL = """
    SELECT event_id, CASE WHEN user_id IS NULL THEN 0 ELSE count(*) OVER w END AS submissions, CASE WHEN count(*) OVER w >= 2 THEN (epoch_us(ts) - min(epoch_us(ts)) OVER w) / 1e6 / (count(*) OVER w - 1) END AS avg_gap_s
    FROM events WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts RANGE BETWEEN INTERVAL 60 MINUTE PRECEDING AND CURRENT ROW)"""


@query(f"""
    SELECT event_id, submissions, {d_rnd('avg_gap_s', 3)} AS avg_gap_s,
           CAST(greatest((CASE WHEN submissions > 10 THEN -15 ELSE 0 END) + (CASE WHEN submissions >= 3 AND avg_gap_s < 30 THEN -10 ELSE 0 END), -15) AS BIGINT) AS penalty FROM ({_VEL})""")
def velocity_penalty(spark, sf_dir):
    from ..functions.text import rnd

    return limits.velocity(read(spark, sf_dir, "events"), "user_id", "ts").select("event_id", "submissions", rnd(F.col("avg_gap_s"), 3).alias("avg_gap_s"), "penalty")


@query("""
    SELECT event_id, seen, CAST(CASE WHEN seen >= 3 THEN -20 ELSE 0 END AS BIGINT) AS campaign_penalty
    FROM (SELECT event_id, count(*) OVER (PARTITION BY event_type, props, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seen FROM events)""")
def daily_campaign(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("fp", F.concat_ws("|", "event_type", "props"))
    return limits.campaign(e, "fp", "ts", "event_id").select("event_id", "seen", "campaign_penalty")


@query("SELECT event_id, nth, nth <= 20 AS accepted FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS nth FROM events)")
def submission_cap(spark, sf_dir):
    return limits.daily_cap(read(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("event_id", "nth", "accepted")


@query("""
    WITH RECURSIVE o AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    f AS (SELECT user_id, event_id, i, ts AS start, CAST(1 AS BIGINT) AS nth FROM o WHERE i = 1
          UNION ALL SELECT o.user_id, o.event_id, o.i, CASE WHEN o.ts - f.start >= INTERVAL 24 HOUR THEN o.ts ELSE f.start END, CASE WHEN o.ts - f.start >= INTERVAL 24 HOUR THEN 1 ELSE f.nth + 1 END
          FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)
    SELECT event_id, nth, nth <= 10 AS accepted FROM f""")
def run_rate_limit(spark, sf_dir):
    return limits.fixed_bucket(read(spark, sf_dir, "events"), "user_id", "ts", "event_id")


@query("""
    WITH h AS (SELECT user_id, ts, n FROM (SELECT user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM events) WHERE n >= 5),
    g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 1 DAY THEN 1 ELSE 0 END AS new FROM h WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM g), s AS (SELECT *, floor((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id, island)) / 86400000000) AS slot FROM i)
    SELECT user_id, min(ts) AS alert_at, max(n) AS rejections FROM s GROUP BY user_id, island, slot""")
def rejection_bursts(spark, sf_dir):
    return limits.rejection_bursts(read(spark, sf_dir, "events"), "user_id", "ts", 5, 86_400)
