"""News queries over documents, pages and the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow import dims
from furrow.functions import text as X
from furrow.operators import news
from furrow.operators.clean import settle
from furrow.plans import sql as S
from furrow.session import cut_lineage
from furrow.sources import tables as T

RUN_TS = "2024-05-01 00:00:00"
REGISTRY = [
    ("TIER_1", [(f"src{i}", f"Outlet src{i}", "TIER_1", f"https://feeds.example.org/src{i}.xml", None) for i in range(0, 8)]),
    ("TIER_2", [(f"src{i}", f"Outlet src{i}", "TIER_2", "", f"crop news & prices {i}") for i in range(8, 18)]),
    ("TIER_4", [("src18", "Outlet src18", "TIER_4", None, None), ("quiet", None, None, "https://feeds.example.org/quiet.xml", "")]),
]
OUTLETS = [(1, "ICAR Bulletin", ""), (2, "Krishi Jagran", ""), (3, "Market desk", "https://www.reuters.com/x"), (4, "The Hindu", ""),
           (5, "Reader", "https://news.google.com/rss"), (6, "Village Post", "")]


def _run():
    return F.lit(RUN_TS).cast("timestamp")


def articles(spark, sf):
    return news.clean_articles(T.articles_raw(spark, sf), keep=["doc_id"])


def corpus_events(spark, sf):
    return news.detect_events(articles(spark, sf), _run(), keep=["doc_id"], states=T.CORPUS_STATES,
                              crops=T.CORPUS_CROPS, keywords=T.CORPUS_EVENTS)


def clean_articles(spark, sf):
    return articles(spark, sf).select("doc_id", "article_id", "title", F.md5("description").alias("description_md5"), "link", "source_id", "tier")


def article_store(spark, sf):
    a = articles(spark, sf).select("article_id", "doc_id", "title", "tier", F.col("doc_id").alias("arrival"))
    # The official and research tiers are stored already; every article is fetched again.
    old = a.where(F.col("tier").isin("TIER_1", "TIER_2"))
    new = a.withColumn("arrival", F.col("arrival") + 1_000_000)
    return news.article_store(old.drop("tier"), new.drop("tier"), keep=5000)


def event_classes(spark, sf):
    """Published keyword table over whole articles, by containment and by whole words."""
    a = articles(spark, sf).select("doc_id", F.lower(F.concat("title", F.lit(". "), "description")).alias("low"))
    low = F.col("low")
    return settle(a, F.col("doc_id"), X.keyword_class(low, dims.EVENT_KEYWORDS).alias("event_type"),
                  X.keyword_class(low, T.CORPUS_EVENTS).alias("corpus_type"),
                  X.keyword_class(low, T.CORPUS_EVENTS, word_bounded=True).alias("corpus_type_bounded"))


def news_events(spark, sf):
    e = corpus_events(spark, sf)
    return e.withColumn("published_at", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"))


def event_clusters(spark, sf):
    c = news.clusters(corpus_events(spark, sf), "doc_id")
    return c.withColumn("sources_involved", F.array_join("sources_involved", ","))


def tagged_events(spark, sf):
    # Text classification is the expensive part and is needed twice: written once.
    events = cut_lineage(corpus_events(spark, sf), "events")
    return news.tag_events(events, "doc_id").select("event_id", "doc_id", "state", "crop", "event_type", "verification_status")


def verification_totals(spark, sf):
    return news.verification_totals(news.clusters(corpus_events(spark, sf), "doc_id"))


def current_intelligence(spark, sf):
    e = news.current_intelligence(corpus_events(spark, sf), "doc_id")
    return e.select("state", "crop", F.col("rank").cast("bigint").alias("rank"), "event_type", "title", "source_name", "tier")


def signal_pages(spark, sf):
    p = news.signal_pages(news.current_intelligence(corpus_events(spark, sf), "doc_id"))
    return p.select("state", "position", "crop", "event_type", "title", "source_name")


def _registry(spark):
    tiers = {k: (v,) for k, v in REGISTRY}
    schema = ("tiers map<string, struct<sources: array<struct<source_id: string, source_name: string, tier: string, "
              "rss_url: string, google_news_query: string>>>>")
    return spark.createDataFrame([(tiers,)], schema)


def source_targets(spark, sf):
    """Registry addresses with the number of articles each source delivered."""
    n = T.table(spark, sf, "documents").groupBy(F.col("source").alias("source_id")).agg(F.count(F.lit(1)).alias("articles"))
    return news.source_targets(_registry(spark)).join(n, "source_id", "left")


def _audit(spark, sf):
    a = articles(spark, sf).withColumn("arrival", F.col("doc_id"))
    return news.source_audit(news.source_targets(_registry(spark)), a, a.where(F.col("tier") == "TIER_1").select("article_id"))


def source_audit(spark, sf):
    return _audit(spark, sf)


def source_audit_totals(spark, sf):
    return news.audit_totals(_audit(spark, sf))


def source_credibility(spark, sf):
    """Credibility of the outlet behind every event, counted per outlet and event type."""
    outlets = dims.frame(spark, OUTLETS, "k bigint, outlet string, url string")
    e = T.table(spark, sf, "events").select(((F.col("user_id") % 6) + 1).alias("k"), "event_type")
    c = news.source_credibility(F.col("outlet"), F.col("url"))
    per = e.groupBy("k", "event_type").agg(F.count(F.lit(1)).alias("signals"))
    return per.join(outlets, "k").select("outlet", "event_type", "signals", c["tier"].alias("tier"),
                                         c["credibility_weight"].alias("credibility_weight"), c["is_official"].alias("is_official"))


def signal_verification(spark, sf):
    return news.verify_signals(T.signals(spark, sf))


def signal_freshness(spark, sf):
    return news.signal_freshness(T.signals(spark, sf))


def signal_verification_by_day(spark, sf):
    """Finer groups, so that single-source and stale groups occur too."""
    s = T.signals(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return news.verify_signals(s, by=("state", "crop", "day"))


def signal_scope_weights(spark, sf):
    """Adjustment scaled by the scope of the signal group."""
    v = news.verify_signals(T.signals(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd")), by=("state", "crop", "day"))
    scope = F.when(F.col("state") == "S0", "national").when(F.col("state").isin("S1", "S2"), "district").otherwise("state")
    return v.groupBy(scope.alias("scope")).agg(
        F.count(F.lit(1)).alias("signal_groups"), F.sum(F.floor(F.col("news_adjustment") * 10 + 0.5)).alias("tenths")).select(
        "scope", "signal_groups", (F.col("tenths") * news.geographic_weight(F.col("scope")) / F.lit(10.0)).alias("weighted_adjustment"))


def search_queries(spark, sf):
    places = T.requests(spark, sf).select("state", "district", F.col("previous_crop").alias("crop")).distinct()
    return news.local_queries(places).select("state", "district", "crop", F.col("position").cast("bigint").alias("position"), "query")


def price_search_queries(spark, sf):
    pairs = T.requests(spark, sf).select("state", F.col("previous_crop").alias("crop")).distinct()
    return news.price_queries(pairs).select("state", "crop", F.col("position").cast("bigint").alias("position"), "query")


def feed_items(spark, sf):
    """Whole pages wrapped as feed payloads of both dialects, an item per paragraph, parsed back and cleaned."""
    def safe(c):
        return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))

    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 90).cast("int")), "yyyy-MM-dd")

    def numbered(c, k, before):
        return F.when(k == 0, c).otherwise(F.concat(c, F.lit(before), k.cast("string")))

    def item(part, k):
        head, link, body = safe(numbered(title, k, " ")), safe(numbered(F.col("url"), k, "#p")), safe(part)
        rss = F.concat(F.lit("<item><title>"), head, F.lit("</title><description>"), body, F.lit("</description><link>"), link, F.lit("</link><pubDate>"), day, F.lit("</pubDate></item>"))
        atom = F.concat(F.lit("<entry><title>"), head, F.lit("</title><summary>"), body, F.lit("</summary><link href=\""), link, F.lit("\"/><published>"), day, F.lit("</published></entry>"))
        return F.when(F.col("page_id") % 3 == 0, atom).otherwise(rss)

    items = F.array_join(F.transform(F.split("html", "<p>", -1), item), "")
    rss, atom = F.concat(F.lit("<rss><channel>"), items, F.lit("</channel></rss>")), F.concat(F.lit("<feed>"), items, F.lit("</feed>"))
    p = T.table(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, atom).otherwise(rss).alias("payload"))
    parsed = news.feed_items(p, keep=["page_id"])
    clean = parsed.select("page_id", X.strip_markup(F.col("title")).alias("title"), X.strip_markup(F.col("description")).alias("description"), "link", "pub_date")
    return clean.where(F.col("title") != "").withColumn("article_id", X.content_id("ART_", F.col("title"), F.col("link")))


QUERIES = {f.__name__: f for f in [
    clean_articles, article_store, event_classes, news_events, event_clusters, tagged_events, verification_totals,
    current_intelligence, signal_pages, source_targets, source_audit, source_audit_totals, source_credibility, signal_verification,
    signal_verification_by_day, signal_freshness, signal_scope_weights, search_queries, price_search_queries, feed_items]}

# ------------------------------------------------------------------ check SQL
ARTICLES = S.ARTICLES_RAW + f""",
articles AS (SELECT doc_id, title, description, link, true_ts, source_id, source_name, tier,
  'ART_' || substr(sha256(title || link), 1, 16) AS article_id
 FROM (SELECT doc_id, {S.strip_markup('title')} AS title, {S.strip_markup('description')} AS description, link, true_ts,
  source_id, source_name, tier FROM articles_raw) WHERE title <> ''),
full_texts AS MATERIALIZED (SELECT *, title || '. ' || description AS t FROM articles)"""


def _named(names, default):
    arms = " ".join(rf"WHEN regexp_matches(t, '(?i)(^|[^\p{{L}}\p{{N}}\p{{M}}_]){n}($|[^\p{{L}}\p{{N}}\p{{M}}_])') THEN '{n}'" for n in names)
    return f"CASE {arms} ELSE '{default}' END"


def _classed(table, bounded=False):
    def hit(w):
        if bounded:
            return rf"regexp_matches(lower(t), '(^|[^\p{{L}}\p{{N}}\p{{M}}_]){w}($|[^\p{{L}}\p{{N}}\p{{M}}_])')"
        return f"contains(lower(t), '{w}')"
    return "CASE " + " ".join(f"WHEN {' OR '.join(hit(w) for w in ws)} THEN '{c}'" for c, ws in table.items()) + " ELSE 'OTHER' END"


EVENTS = ARTICLES + f""",
ev0 AS MATERIALIZED (SELECT *, {_named(T.CORPUS_STATES, 'National')} AS state, {_named(T.CORPUS_CROPS, 'General Agriculture')} AS crop,
  {_classed(T.CORPUS_EVENTS)} AS event_type, coalesce(true_ts, TIMESTAMP '{RUN_TS}') AS ts,
  greatest(CAST(0 AS DOUBLE), CAST(floor(CAST(epoch_us(TIMESTAMP '{RUN_TS}') - epoch_us(coalesce(true_ts, TIMESTAMP '{RUN_TS}')) AS DOUBLE)
   / CAST(1000000.0 AS DOUBLE) / CAST(86400.0 AS DOUBLE) * CAST(10.0 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS DOUBLE) / CAST(10.0 AS DOUBLE)) AS age_days FROM full_texts),
evs AS (SELECT 'EVT_' || substr(sha256(article_id || event_type), 1, 16) AS event_id, * FROM ev0),
clusters AS (SELECT state || '::' || crop || '::' || event_type AS cluster_key, state, crop, event_type, count(*) AS event_count,
  count(DISTINCT source_id) AS unique_sources, CASE WHEN count(DISTINCT source_id) >= 2 THEN 'VERIFIED' ELSE 'SINGLE_SOURCE' END AS verification_status,
  string_agg(DISTINCT source_id, ',' ORDER BY source_id) AS sources_involved, min_by(title, doc_id) AS sample_title FROM evs GROUP BY state, crop, event_type)"""

_SRC = [s for _, ss in REGISTRY for s in ss]
_TARGETS = S.values("reg", "source_id, source_name, tier, rss, q", _SRC) + """,
targets AS (SELECT source_id, coalesce(source_name, 'Unknown Source') AS source_name, coalesce(tier, 'TIER_4') AS tier,
  CASE WHEN coalesce(rss, '') <> '' THEN rss WHEN coalesce(q, '') <> '' THEN 'https://news.google.com/rss/search?q=' || url_encode(q) || '&hl=en-IN&gl=IN&ceid=IN:en' END AS target_url FROM reg)"""
_PUB = """CASE WHEN doc_id % 17 = 0 THEN 'n/a' WHEN doc_id % 4 = 0 THEN strftime(TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 90 AS INTEGER)) + to_hours(doc_id % 24), '%a, %d %b %Y %H:%M:%S +0530')
 WHEN doc_id % 4 = 1 THEN strftime(TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 90 AS INTEGER)) + to_hours(doc_id % 24), '%a, %d %b %Y %H:%M:%S GMT')
 WHEN doc_id % 4 = 2 THEN strftime(TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 90 AS INTEGER)) + to_hours(doc_id % 24), '%Y-%m-%dT%H:%M:%S+00:00')
 ELSE strftime(TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 90 AS INTEGER)), '%Y-%m-%d') END"""
_AUDIT = ARTICLES + ", " + _TARGETS + f""",
per AS (SELECT source_id, count(*) AS n, count(*) FILTER (tier <> 'TIER_1') AS fresh, min_by({_PUB}, doc_id) AS latest_date FROM articles GROUP BY 1),
audit AS (SELECT t.source_id, t.source_name, t.tier, CASE WHEN target_url IS NULL THEN 'NO_FEED_CONFIGURED' WHEN n > 0 THEN 'SUCCESS' ELSE 'EMPTY_OR_UNAVAILABLE' END AS status,
 CASE WHEN target_url IS NULL THEN 0 ELSE coalesce(n, 0) END AS articles_fetched, CASE WHEN target_url IS NULL THEN 0 ELSE coalesce(fresh, 0) END AS new_articles_added,
 CASE WHEN target_url IS NOT NULL THEN latest_date END AS latest_date FROM targets t LEFT JOIN per p ON p.source_id = t.source_id)"""


def _verify(by: str, source: str = "signals") -> str:
    bad = "('RISK_INCREASED','HIGH_RISK','NEGATIVE','RISK_ELEVATED','MODERATE_RISK')"
    good = "('RISK_DECREASED','POSITIVE','FAVORABLE')"
    return f"""g AS (SELECT {by}, count(*) AS events, count(DISTINCT CASE WHEN age_days <= 60 THEN source_name END) AS fresh_sources,
 count(DISTINCT CASE WHEN age_days <= 60 AND direction IN {bad} THEN source_name END) AS bad_sources,
 count(DISTINCT CASE WHEN age_days <= 60 AND direction IN {good} THEN source_name END) AS good_sources,
 min_by(tier, event_id) FILTER (age_days <= 60) AS tier, min_by(credibility_weight, event_id) FILTER (age_days <= 60) AS w,
 min_by(direction, event_id) FILTER (age_days <= 60) AS sig FROM {source} GROUP BY ALL),
v AS (SELECT *, CASE WHEN fresh_sources = 0 THEN 'STALE' WHEN bad_sources > 0 AND good_sources > 0 THEN 'CONFLICTING' WHEN fresh_sources >= 2 THEN 'VERIFIED'
 WHEN tier IN ('TIER_1_OFFICIAL', 'TIER_2_AGRI_RESEARCH') THEN 'SINGLE_SOURCE' ELSE 'UNVERIFIED' END AS verification_status FROM g),
v2 AS (SELECT *, CASE WHEN verification_status IN ('VERIFIED', 'SINGLE_SOURCE') THEN sig ELSE 'NEUTRAL_SIGNAL' END AS signal FROM v),
verified AS (SELECT {by}, events, fresh_sources, bad_sources, good_sources, verification_status, signal,
 CASE WHEN signal IN ('RISK_INCREASED','HIGH_RISK','NEGATIVE') THEN greatest(CAST(-5 AS DOUBLE), {S.rnd("CAST(-3.0 AS DOUBLE) * w - CAST(2.0 AS DOUBLE) * (CASE WHEN verification_status = 'VERIFIED' THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END)", 1)})
 WHEN signal IN ('RISK_ELEVATED','MODERATE_RISK') THEN greatest(CAST(-3 AS DOUBLE), {S.rnd('CAST(-2.0 AS DOUBLE) * w', 1)})
 WHEN signal IN {good} THEN least(CAST(3 AS DOUBLE), {S.rnd("CAST(2.0 AS DOUBLE) * w + (CASE WHEN verification_status = 'VERIFIED' THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END)", 1)})
 ELSE CAST(0 AS DOUBLE) END AS news_adjustment FROM v2)"""


_DAYS = S.SIGNALS + ", dayed AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM signals)"
_LOCAL = [("dt", "dt || ' agriculture'"), ("dt", "dt || ' crop news'"), ("dt", "dt || ' rainfall flood drought'"), ("dt", "dt || ' pest disease advisory'"),
          ("dt,cr", "dt || ' ' || cr"), ("st", "st || ' agriculture department'"), ("st", "st || ' crop advisory'"), ("st", "st || ' mandi market news'"),
          ("st,cr", "st || ' ' || cr || ' crop'")]
_CRED = [(o, u, *next(((t, w, t == "TIER_1_OFFICIAL") for t, w, ks in [*dims.SOURCE_TIERS, dims.DISCOVERY_TIER] if any(k in f"{o} {u}".lower() for k in ks)),
                      (*dims.DEFAULT_TIER, False)), i) for i, o, u in OUTLETS]

ORACLES = {
    "clean_articles": f"WITH {ARTICLES} SELECT doc_id, article_id, title, md5(description) AS description_md5, link, source_id, tier FROM articles",
    "article_store": f"""WITH {ARTICLES}, b AS (SELECT article_id, doc_id, title, doc_id AS arrival FROM articles WHERE tier IN ('TIER_1', 'TIER_2') UNION ALL
 SELECT article_id, doc_id, title, doc_id + 1000000 FROM articles),
 f AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY arrival) AS rn FROM b)
 SELECT article_id, doc_id, title, arrival FROM f WHERE rn = 1 ORDER BY arrival DESC, article_id LIMIT 5000""",
    "event_classes": f"WITH {ARTICLES} SELECT doc_id, {_classed(dims.EVENT_KEYWORDS)} AS event_type, {_classed(T.CORPUS_EVENTS)} AS corpus_type, {_classed(T.CORPUS_EVENTS, True)} AS corpus_type_bounded FROM full_texts",
    "news_events": f"""WITH {EVENTS} SELECT event_id, doc_id, article_id, title, source_id, source_name, tier,
 CASE tier WHEN 'TIER_1' THEN CAST(1.0 AS DOUBLE) WHEN 'TIER_2' THEN CAST(0.8 AS DOUBLE) WHEN 'TIER_3' THEN CAST(0.6 AS DOUBLE) ELSE CAST(0.4 AS DOUBLE) END AS source_credibility_weight,
 state, crop, event_type, CASE WHEN event_type = 'OTHER' THEN CAST(0.3 AS DOUBLE) ELSE CAST(0.85 AS DOUBLE) END AS confidence,
 strftime(ts, '%Y-%m-%d %H:%M:%S') AS published_at, age_days,
 CASE WHEN age_days <= 3 THEN 'VERY_FRESH' WHEN age_days <= 14 THEN 'FRESH' WHEN age_days <= 30 THEN 'RECENT' ELSE 'STALE' END AS freshness_status FROM evs""",
    "event_clusters": f"WITH {EVENTS} SELECT * FROM clusters",
    "tagged_events": f"WITH {EVENTS} SELECT event_id, doc_id, e.state, e.crop, e.event_type, verification_status FROM evs e JOIN clusters c ON c.state = e.state AND c.crop = e.crop AND c.event_type = e.event_type",
    "verification_totals": f"""WITH {EVENTS} SELECT CAST(sum(event_count) AS BIGINT) AS total_articles_processed, count(*) AS total_event_clusters,
 CAST(coalesce(sum(event_count) FILTER (verification_status = 'VERIFIED'), 0) AS BIGINT) AS verified_events_count,
 CAST(coalesce(sum(event_count) FILTER (verification_status = 'SINGLE_SOURCE'), 0) AS BIGINT) AS single_source_events_count,
 count(*) FILTER (verification_status = 'VERIFIED') AS verified_clusters_count, count(*) FILTER (verification_status = 'SINGLE_SOURCE') AS single_source_clusters_count FROM clusters""",
    "current_intelligence": f"""WITH {EVENTS} SELECT state, crop, rank, event_type, title, source_name, tier FROM
 (SELECT *, row_number() OVER (PARTITION BY state, crop ORDER BY doc_id) AS rank FROM evs) WHERE rank <= 5""",
    "signal_pages": f"""WITH {EVENTS}, ci AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY state, crop ORDER BY doc_id) AS rank FROM evs) WHERE rank <= 5)
 SELECT state, position, crop, event_type, title, source_name FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY crop, rank) AS position FROM ci) WHERE position <= 5""",
    "source_targets": f"WITH {_TARGETS}, n AS (SELECT source, count(*) AS articles FROM documents GROUP BY 1) SELECT t.*, articles FROM targets t LEFT JOIN n ON n.source = t.source_id",
    "source_audit": f"WITH {_AUDIT} SELECT * FROM audit",
    "source_audit_totals": f"""WITH {_AUDIT} SELECT count(*) AS total_sources_audited, count(*) FILTER (status = 'SUCCESS') AS sources_active,
 count(*) FILTER (status <> 'SUCCESS') AS sources_failed, CAST(sum(new_articles_added) AS BIGINT) AS new_articles_ingested FROM audit""",
    "source_credibility": f"""WITH {S.values('cred', 'outlet, url, tier, credibility_weight, is_official, k', _CRED)}
 SELECT outlet, event_type, count(*) AS signals, tier, CAST(credibility_weight AS DOUBLE) AS credibility_weight, is_official
 FROM events e JOIN cred ON cred.k = e.user_id % 6 + 1 GROUP BY ALL""",
    "signal_verification": f"WITH {S.SIGNALS}, {_verify('state, crop')} SELECT * FROM verified",
    "signal_verification_by_day": f"WITH {_DAYS}, {_verify('state, crop, day', 'dayed')} SELECT * FROM verified",
    "signal_scope_weights": f"""WITH {_DAYS}, {_verify('state, crop, day', 'dayed')},
 t AS (SELECT CASE WHEN state = 'S0' THEN 'national' WHEN state IN ('S1', 'S2') THEN 'district' ELSE 'state' END AS scope, count(*) AS signal_groups,
  CAST(sum(CAST(floor(news_adjustment * 10 + CAST(0.5 AS DOUBLE)) AS BIGINT)) AS BIGINT) AS tenths FROM verified GROUP BY 1)
 SELECT scope, signal_groups, tenths * (CASE scope WHEN 'district' THEN CAST(1.0 AS DOUBLE) WHEN 'state' THEN CAST(0.8 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END) / CAST(10.0 AS DOUBLE) AS weighted_adjustment FROM t""",
    "search_queries": f"""WITH {S.REQUESTS}, d AS (SELECT DISTINCT state, district, previous_crop AS crop FROM requests),
 p AS (SELECT *, trim(state) AS st, trim(district) AS dt, coalesce(trim(crop), '') AS cr FROM d),
 u AS ({' UNION ALL '.join(f"SELECT *, {i} AS ord, {q} AS query FROM p WHERE {' AND '.join(c + chr(32) + '<>' + chr(32) + chr(39) * 2 for c in cs.split(','))}" for i, (cs, q) in enumerate(_LOCAL))})
 SELECT state, district, crop, row_number() OVER (PARTITION BY state, district, crop ORDER BY ord) - 1 AS position, query FROM u""",
    "price_search_queries": f"""WITH {S.REQUESTS}, p AS (SELECT DISTINCT state, previous_crop AS crop FROM requests),
 q AS (SELECT *, trim(state) AS st, coalesce(trim(crop), 'crop') AS cr FROM p)
 {' UNION ALL '.join(f"SELECT state, crop, CAST({i} AS BIGINT) AS position, {e} AS query FROM q" for i, e in enumerate(["st || ' ' || cr || ' price news'", "st || ' ' || cr || ' mandi rates'", "st || ' ' || cr || ' market arrival'", "cr || ' export import policy India'", "cr || ' MSP weather risk ' || st"]))}""",
    "signal_freshness": f"""WITH {S.SIGNALS} SELECT source_name, CASE WHEN greatest(age_days, 0) <= 14 THEN 'FRESH' WHEN greatest(age_days, 0) <= 60 THEN 'RECENT' ELSE 'STALE' END AS freshness_status,
 count(*) AS signals, min(age_days) AS youngest_days FROM signals GROUP BY 1, 2""",
    "feed_items": f"""WITH q AS (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS t, url, string_split(html, '<p>') AS parts FROM pages),
 u AS (SELECT page_id, t, url, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS k FROM q),
 p AS (SELECT page_id, {S.strip_markup("CASE WHEN k = 0 THEN t ELSE t || ' ' || k END")} AS title, {S.strip_markup('part')} AS description, CASE WHEN k = 0 THEN url ELSE url || '#p' || k END AS link,
  strftime(DATE '2024-01-01' + CAST(page_id % 90 AS INTEGER), '%Y-%m-%d') AS pub_date FROM u)
 SELECT page_id, title, description, link, pub_date, 'ART_' || substr(sha256(title || link), 1, 16) AS article_id FROM p WHERE title <> ''""",
}
