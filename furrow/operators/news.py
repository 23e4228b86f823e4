"""News: feed items, articles, events, clusters, signals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from furrow import dims
from furrow.functions import dates as D
from furrow.functions import numeric as N
from furrow.functions import text as X
from furrow.operators.clean import settle

CLUSTER = ["state", "crop", "event_type"]

# Layout of the two feed dialects.  Fixed value.
FEED_SCHEMA = (
    "channel struct<item: array<struct<title: string, description: string, link: string, pubDate: string>>>,"
    "entry array<struct<title: string, summary: string, link: struct<_href: string, _VALUE: string>, published: string>>")


def feed_items(payloads: DataFrame, payload: str = "payload", keep: Sequence[str] = ("source_url",)) -> DataFrame:
    """Rows of every item (or, without items, every entry) of a table of feed payloads."""
    doc = payloads.select(*keep, F.from_xml(F.col(payload), FEED_SCHEMA).alias("doc"))
    items = F.transform(F.col("doc.channel.item"), lambda i: F.struct(
        i["title"].alias("title"), i["description"].alias("description"), i["link"].alias("link"), i["pubDate"].alias("pub_date")))
    entries = F.transform(F.col("doc.entry"), lambda e: F.struct(
        e["title"].alias("title"), e["summary"].alias("description"),
        F.coalesce(X.blank_to_null(e["link"]["_VALUE"]), e["link"]["_href"]).alias("link"), e["published"].alias("pub_date")))
    chosen = F.when(F.size("doc.channel.item") > 0, items).otherwise(entries)
    return doc.select(*keep, F.inline(chosen))


def clean_articles(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Markup removed, empty headlines dropped, content-derived id added."""
    body = settle(raw, *[F.col(k) for k in keep], X.strip_markup(F.col("title")).alias("title"),
                  X.strip_markup(F.col("description")).alias("description"),
                  F.coalesce("link", F.lit("")).alias("link"), F.col("pub_date"),
                  F.col("source_id"), F.col("source_name"), F.col("tier"))
    return (body.where(F.col("title") != "")
            .withColumn("article_id", X.content_id("ART_", F.col("title"), F.col("link"))))


def first_per_key(df: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    """Earliest row of each key.

    A minimum of structs combines on the map side, so copies of one key never
    gather in a single task the way a row-number window would make them.
    """
    rest = [c for c in df.columns if c not in key]
    one = df.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("row"))
    return one.select(*key, "row.*")


def article_store(stored: DataFrame, fetched: DataFrame, order: str = "arrival", keep: int = 5000) -> DataFrame:
    """Stored plus unseen articles, latest ``keep`` by arrival (a top-k, never a full sort)."""
    both = stored.unionByName(fetched, allowMissingColumns=True)
    unique = first_per_key(both, ["article_id"], F.col(order))
    return unique.orderBy(F.col(order).desc(), "article_id").limit(keep)


def detect_events(articles: DataFrame, run_ts: Column, keep: Sequence[str] = (),
                  states: Sequence[str] = tuple(dims.NEWS_STATES), crops: Sequence[str] = tuple(dims.NEWS_CROPS),
                  keywords: Mapping[str, Sequence[str]] = dims.EVENT_KEYWORDS, word_bounded: bool = False) -> DataFrame:
    """One event per article: place, crop, class, confidence, age and freshness."""
    full = articles.withColumn("full_text", F.concat("title", F.lit(". "), "description"))
    text, low = F.col("full_text"), F.col("low_text")
    e = settle(
        full.withColumn("low_text", F.lower("full_text")), *[F.col(k) for k in keep], F.col("article_id"), F.col("title"),
        F.coalesce("source_id", F.lit("unknown")).alias("source_id"),
        F.coalesce("source_name", F.lit("Unknown")).alias("source_name"), F.coalesce("tier", F.lit("TIER_4")).alias("tier"),
        X.first_named(text, states, "National", low).alias("state"),
        X.first_named(text, crops, "General Agriculture", low).alias("crop"),
        X.keyword_class(low, keywords, word_bounded=word_bounded).alias("event_type"),
        D.parse_published(F.col("pub_date"), run_ts).alias("published_at"))
    weight = F.coalesce(X.lookup(F.col("tier"), dims.TIER_WEIGHTS), F.lit(dims.TIER_WEIGHT_DEFAULT))
    age = D.fractional_age_days(run_ts, F.col("published_at"))
    return e.select(
        X.content_id("EVT_", F.col("article_id"), F.col("event_type")).alias("event_id"), *keep, "article_id", "title",
        "source_id", "source_name", "tier", weight.alias("source_credibility_weight"), "state", "crop", "event_type",
        F.when(F.col("event_type") == "OTHER", F.lit(0.30)).otherwise(F.lit(0.85)).alias("confidence"),
        "published_at", age.alias("age_days"), D.ladder(age, "news").alias("freshness_status"))


def clusters(events: DataFrame, order: str = "article_id") -> DataFrame:
    """Events per (state, crop, class): size, sources, verdict and a sample headline.

    Counting per source first keeps the final group as wide as the source
    registry, whatever share of the events falls into one cluster.
    """
    per_source = events.groupBy(*CLUSTER, "source_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(order, "title")).alias("first"))
    c = per_source.groupBy(*CLUSTER).agg(
        F.sum("n").alias("event_count"), F.count(F.lit(1)).alias("unique_sources"),
        F.array_sort(F.collect_list("source_id")).alias("sources_involved"), F.min("first").alias("first"))
    status = F.when(F.col("unique_sources") >= 2, "VERIFIED").otherwise("SINGLE_SOURCE")
    return c.select(
        F.concat_ws("::", *CLUSTER).alias("cluster_key"), *CLUSTER, "event_count", "unique_sources",
        status.alias("verification_status"), "sources_involved", F.col("first.title").alias("sample_title"))


def tag_events(events: DataFrame, order: str = "article_id") -> DataFrame:
    """Events with the verdict of their cluster."""
    verdict = clusters(events, order).select(*CLUSTER, "verification_status")
    return events.join(verdict, CLUSTER)


def verification_totals(cluster_rows: DataFrame) -> DataFrame:
    v, s = F.col("verification_status") == "VERIFIED", F.col("verification_status") == "SINGLE_SOURCE"
    n = F.col("event_count")
    zero = F.lit(0).cast("bigint")
    return cluster_rows.agg(
        F.sum(n).alias("total_articles_processed"), F.count(F.lit(1)).alias("total_event_clusters"),
        F.sum(F.when(v, n).otherwise(zero)).alias("verified_events_count"),
        F.sum(F.when(s, n).otherwise(zero)).alias("single_source_events_count"),
        F.count_if(v).alias("verified_clusters_count"), F.count_if(s).alias("single_source_clusters_count"))


def current_intelligence(events: DataFrame, order: str = "article_id", k: int = 5) -> DataFrame:
    """First k events per (state, crop); the rank filter limits each group before the shuffle."""
    rank = F.row_number().over(W.partitionBy("state", "crop").orderBy(order))
    return events.withColumn("rank", rank).where(F.col("rank") <= k)


def signal_pages(intelligence: DataFrame, k: int = 5) -> DataFrame:
    """First k signals of each state over all its crops, in the order of crops and ranks."""
    place = F.row_number().over(W.partitionBy("state").orderBy("crop", "rank"))
    return intelligence.withColumn("position", place.cast("bigint")).where(F.col("position") <= k)


def source_targets(registry: DataFrame) -> DataFrame:
    """One row per source of a registry with its feed address, search address or none."""
    src = registry.select(F.explode("tiers").alias("tier_key", "info")).select("tier_key", F.explode("info.sources").alias("s"))
    query = F.concat(F.lit("https://news.google.com/rss/search?q="),
                     F.replace(F.url_encode(F.col("s.google_news_query")), F.lit("+"), F.lit("%20")),
                     F.lit("&hl=en-IN&gl=IN&ceid=IN:en"))
    target = F.coalesce(X.blank_to_null(F.col("s.rss_url")), F.when(X.blank_to_null(F.col("s.google_news_query")).isNotNull(), query))
    return src.select(
        F.col("s.source_id").alias("source_id"), F.coalesce("s.source_name", F.lit("Unknown Source")).alias("source_name"),
        F.coalesce("s.tier", F.lit("TIER_4")).alias("tier"), target.alias("target_url"))


def source_audit(targets: DataFrame, fetched: DataFrame, known: DataFrame, http_status: DataFrame | None = None) -> DataFrame:
    """Articles fetched, new ones, latest date and status per registered source."""
    seen = known.select("article_id").distinct().withColumn("old", F.lit(True))
    per_article = fetched.groupBy("source_id", "article_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("arrival", "pub_date")).alias("first"))
    per = per_article.join(seen, "article_id", "left").groupBy("source_id").agg(
        F.sum("n").alias("n"), F.count_if(F.col("old").isNull()).alias("new"), F.min("first").alias("first"))
    status = (F.when(F.col("target_url").isNull(), "NO_FEED_CONFIGURED").when(F.col("n") > 0, "SUCCESS")
              .otherwise("EMPTY_OR_UNAVAILABLE"))
    base = targets.join(per, "source_id", "left")
    if http_status is not None:
        base = base.join(http_status, "source_id", "left")
        status = F.when(F.col("target_url").isNotNull() & (F.coalesce("http_status", F.lit(200)) != 200), "FAILED").otherwise(status)
    configured = F.col("target_url").isNotNull()
    zero = F.lit(0).cast("bigint")
    return base.select(
        "source_id", "source_name", "tier", status.alias("status"),
        F.when(configured, F.coalesce("n", zero)).otherwise(zero).alias("articles_fetched"),
        F.when(configured, F.coalesce("new", zero)).otherwise(zero).alias("new_articles_added"),
        F.when(configured, F.col("first.pub_date")).alias("latest_date"))


def audit_totals(audit: DataFrame) -> DataFrame:
    return audit.agg(
        F.count(F.lit(1)).alias("total_sources_audited"), F.count_if(F.col("status") == "SUCCESS").alias("sources_active"),
        F.count_if(F.col("status") != "SUCCESS").alias("sources_failed"), F.sum("new_articles_added").alias("new_articles_ingested"))


def source_credibility(name: Column, url: Column) -> Column:
    """Struct of tier and weight: first tier with a keyword contained in name plus address."""
    text = F.concat(F.lower(F.coalesce(name, F.lit(""))), F.lit(" "), F.lower(F.coalesce(url, F.lit(""))))

    def result(tier: str, weight: float) -> Column:
        return F.struct(F.lit(tier).alias("tier"), F.lit(float(weight)).alias("credibility_weight"),
                        F.lit(tier == "TIER_1_OFFICIAL").alias("is_official"))

    out = None
    for tier, weight, words in [*dims.SOURCE_TIERS, dims.DISCOVERY_TIER]:
        hit = F.lit(False)
        for w in words:
            hit = hit | text.contains(w)
        out = F.when(hit, result(tier, weight)) if out is None else out.when(hit, result(tier, weight))
    return out.otherwise(result(*dims.DEFAULT_TIER))


def verify_signals(signals: DataFrame, by: Sequence[str] = ("state", "crop"), order: Sequence[str] = ("event_id",),
                   max_age: int = 60) -> DataFrame:
    """Cross-source status of each group and its bounded score adjustment.

    Fresh signals decide: opposite signs conflict, two sources verify, a single
    source counts only from an official or research outlet.  The adjustment lies
    in [-5, 3] and is zero unless verified or credibly single-sourced.
    Aggregation runs per source first, then over sources.
    """
    fresh = F.col("age_days") <= max_age
    sig = F.coalesce("direction", F.lit("NEUTRAL"))
    per_source = signals.groupBy(*by, "source_name").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(fresh).alias("fresh"),
        F.bool_or(fresh & sig.isin(*dims.BAD_SIGNALS, *dims.RAISED_SIGNALS)).alias("bad"),
        F.bool_or(fresh & sig.isin(*dims.GOOD_SIGNALS)).alias("good"),
        F.min(F.when(fresh, F.struct(*order, F.col("tier"), F.col("credibility_weight"), sig.alias("signal")))).alias("top"))
    g = per_source.groupBy(*by).agg(
        F.sum("n").alias("events"), F.count_if("fresh").alias("fresh_sources"), F.count_if("bad").alias("bad_sources"),
        F.count_if("good").alias("good_sources"), F.min("top").alias("top"))
    status = (F.when(F.col("fresh_sources") == 0, "STALE")
              .when((F.col("bad_sources") > 0) & (F.col("good_sources") > 0), "CONFLICTING")
              .when(F.col("fresh_sources") >= 2, "VERIFIED")
              .when(F.col("top.tier").isin("TIER_1_OFFICIAL", "TIER_2_AGRI_RESEARCH"), "SINGLE_SOURCE")
              .otherwise("UNVERIFIED"))
    s = g.withColumn("verification_status", status)
    usable = F.col("verification_status").isin("VERIFIED", "SINGLE_SOURCE")
    verified = F.col("verification_status") == "VERIFIED"
    w = F.coalesce("top.credibility_weight", F.lit(0.5))
    signal = F.when(usable, F.col("top.signal")).otherwise(F.lit("NEUTRAL_SIGNAL"))
    lowered = N.round_to(F.lit(-3.0) * w - F.lit(2.0) * F.when(verified, F.lit(1.0)).otherwise(F.lit(0.5)), 1)
    raised = N.round_to(F.lit(-2.0) * w, 1)
    gained = N.round_to(F.lit(2.0) * w + F.when(verified, F.lit(1.0)).otherwise(F.lit(0.0)), 1)
    adj = (F.when(signal.isin(*dims.BAD_SIGNALS), F.greatest(F.lit(-5.0), lowered))
           .when(signal.isin(*dims.RAISED_SIGNALS), F.greatest(F.lit(-3.0), raised))
           .when(signal.isin(*dims.GOOD_SIGNALS), F.least(F.lit(3.0), gained)).otherwise(F.lit(0.0)))
    return s.select(*by, "events", "fresh_sources", "bad_sources", "good_sources", "verification_status",
                    signal.alias("signal"), adj.alias("news_adjustment"))


def geographic_weight(scope: Column) -> Column:
    """Weight of a signal by how close its scope is (district, state, national)."""
    return X.lookup(scope, dict(dims.GEOGRAPHIC_WEIGHTS))


def local_queries(places: DataFrame) -> DataFrame:
    """Search phrases for each (state, district, crop); blank parts produce none."""
    st, dt, cr = (F.coalesce(F.trim(c), F.lit("")) for c in ("state", "district", "crop"))

    def phrase(*parts: Column) -> Column:
        needed = F.lit(True)
        for p in parts:
            needed = needed & (p != "")
        return F.when(needed, F.concat(*parts))

    lit = F.lit
    phrases = [phrase(dt, lit(" agriculture")), phrase(dt, lit(" crop news")), phrase(dt, lit(" rainfall flood drought")),
               phrase(dt, lit(" pest disease advisory")), F.when((dt != "") & (cr != ""), F.concat(dt, lit(" "), cr)),
               phrase(st, lit(" agriculture department")), phrase(st, lit(" crop advisory")), phrase(st, lit(" mandi market news")),
               F.when((st != "") & (cr != ""), F.concat(st, lit(" "), cr, lit(" crop")))]
    listed = F.filter(F.array(*phrases), lambda p: p.isNotNull())
    return places.select(*places.columns, F.posexplode(listed).alias("position", "query"))


def price_queries(pairs: DataFrame) -> DataFrame:
    st = F.coalesce(X.blank_to_null(F.trim("state")), F.lit("India"))
    cr = F.coalesce(X.blank_to_null(F.trim("crop")), F.lit("crop"))
    lit = F.lit
    phrases = F.array(F.concat(st, lit(" "), cr, lit(" price news")), F.concat(st, lit(" "), cr, lit(" mandi rates")),
                      F.concat(st, lit(" "), cr, lit(" market arrival")), F.concat(cr, lit(" export import policy India")),
                      F.concat(cr, lit(" MSP weather risk "), st))
    return pairs.select(*pairs.columns, F.posexplode(phrases).alias("position", "query"))


def signal_freshness(signals: DataFrame) -> DataFrame:
    """Signals per source and freshness class, with the youngest age of each."""
    fresh = D.ladder(F.greatest(F.col("age_days"), F.lit(0)), "signal")
    return signals.groupBy("source_name", fresh.alias("freshness_status")).agg(F.count(F.lit(1)).alias("signals"), F.min("age_days").alias("youngest_days"))
