"""News literal cases, verification rules and bounds."""

import itertools

import pytest
from pyspark.sql import functions as F

from furrow.operators import news
from furrow.operators import places as pl
from furrow.plans import places as PP

RUN = "2024-05-01"


def events_of(spark, *texts):
    rows = [(f"A{i}", t, "", "2024-04-30", f"s{i}", f"Source {i}", "TIER_1") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "article_id string, title string, description string, pub_date string, source_id string, source_name string, tier string")
    return {r["article_id"]: r for r in news.detect_events(df, F.lit(RUN).cast("timestamp")).collect()}


def test_event_literals(spark):
    e = events_of(spark, "Severe pink bollworm outbreak damages cotton fields in Maharashtra",
                  "Government imposes minimum export price and export ban on onion", "Sunny day in town", "The carrot harvest")
    assert (e["A0"]["state"], e["A0"]["crop"], e["A0"]["event_type"]) == ("Maharashtra", "Cotton", "PEST_OUTBREAK") and e["A0"]["confidence"] >= 0.8
    assert (e["A1"]["crop"], e["A1"]["event_type"], e["A1"]["state"]) == ("Onion", "EXPORT_RESTRICTION", "National")
    assert (e["A2"]["event_type"], e["A2"]["confidence"], e["A2"]["crop"]) == ("OTHER", 0.30, "General Agriculture")
    assert e["A3"]["event_type"] == "DISEASE_OUTBREAK"  # containment inside a word, as published
    assert e["A0"]["freshness_status"] == "VERY_FRESH" and e["A0"]["age_days"] == 1.0


def test_word_bounded_option(spark):
    df = spark.createDataFrame([("A", "The carrot harvest", "", "2024-04-30", "s", "S", "TIER_1")],
                               "article_id string, title string, description string, pub_date string, source_id string, source_name string, tier string")
    assert news.detect_events(df, F.lit(RUN).cast("timestamp"), word_bounded=True).first()["event_type"] == "OTHER"


def test_names_need_word_borders(spark):
    e = events_of(spark, "Prices of riceberry étea rise", "RICE, tea and Wheat")
    assert e["A0"]["crop"] == "General Agriculture" and e["A1"]["crop"] == "Rice"


def test_clusters_verify_two_sources(spark):
    rows = [("1", "Assam", "Rice", "FLOOD", "pib", "t1"), ("2", "Assam", "Rice", "FLOOD", "icar", "t2"), ("3", "Punjab", "Wheat", "OTHER", "x", "t3")]
    ev = spark.createDataFrame(rows, "article_id string, state string, crop string, event_type string, source_id string, title string")
    got = {r["cluster_key"]: r for r in news.clusters(ev).collect()}
    assert got["Assam::Rice::FLOOD"]["verification_status"] == "VERIFIED" and got["Assam::Rice::FLOOD"]["sample_title"] == "t1"
    assert got["Punjab::Wheat::OTHER"]["verification_status"] == "SINGLE_SOURCE"
    tagged = {r["article_id"]: r["verification_status"] for r in news.tag_events(ev).collect()}
    assert tagged == {"1": "VERIFIED", "2": "VERIFIED", "3": "SINGLE_SOURCE"}


def brute(events):
    fresh = [e for e in events if e["age_days"] <= 60]
    bad = {"RISK_INCREASED", "HIGH_RISK", "NEGATIVE", "RISK_ELEVATED", "MODERATE_RISK"}
    good = {"RISK_DECREASED", "POSITIVE", "FAVORABLE"}
    if not fresh:
        return "STALE"
    if any(e["direction"] in bad for e in fresh) and any(e["direction"] in good for e in fresh):
        return "CONFLICTING"
    if len({e["source_name"] for e in fresh}) >= 2:
        return "VERIFIED"
    return "SINGLE_SOURCE" if fresh[0]["tier"] in ("TIER_1_OFFICIAL", "TIER_2_AGRI_RESEARCH") else "UNVERIFIED"


def test_signals_against_brute_force(spark):
    groups, rows, n = {}, [], 0
    tiers = {"a": ("TIER_1_OFFICIAL", 1.0), "b": ("TIER_4_GENERAL_MEDIA", 0.4)}
    choices = list(itertools.product("ab", ["RISK_INCREASED", "POSITIVE", "NEUTRAL", "RISK_ELEVATED"], [5, 90]))
    for i, combo in enumerate(itertools.combinations(choices, 2)):
        for src, direction, age in combo:
            e = {"state": f"g{i}", "crop": "c", "event_id": n, "source_name": src, "tier": tiers[src][0], "credibility_weight": tiers[src][1],
                 "direction": direction, "age_days": age}
            groups.setdefault(f"g{i}", []).append(e)
            rows.append(tuple(e.values()))
            n += 1
    df = spark.createDataFrame(rows, "state string, crop string, event_id bigint, source_name string, tier string, credibility_weight double, direction string, age_days bigint")
    got = {r["state"]: r for r in news.verify_signals(df).collect()}
    assert len(got) == len(groups)
    for g, ev in groups.items():
        assert got[g]["verification_status"] == brute(ev), (g, ev)
        assert -5.0 <= got[g]["news_adjustment"] <= 3.0
        if got[g]["verification_status"] not in ("VERIFIED", "SINGLE_SOURCE"):
            assert got[g]["news_adjustment"] == 0.0


@pytest.mark.parametrize("name,url,tier", [("ICAR", "", "TIER_1_OFFICIAL"), ("Krishi Jagran", "", "TIER_2_AGRI_RESEARCH"), ("x", "https://reuters.com", "TIER_3_BUSINESS_MARKET"),
                                           ("The Hindu", "", "TIER_4_GENERAL_MEDIA"), ("x", "https://news.google.com", "DISCOVERY_ONLY"), ("Blog", None, "TIER_4_GENERAL_MEDIA")])
def test_source_tiers(spark, name, url, tier):
    c = news.source_credibility(F.lit(name), F.lit(url).cast("string"))
    assert spark.range(1).select(c["tier"].alias("t")).first()["t"] == tier


def test_feed_dialects(spark):
    rss = "<rss><channel><item><title>One &lt;b&gt;x&lt;/b&gt;</title><link>l1</link><pubDate>2024-01-01</pubDate></item><item><title>Two</title></item></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Three</title><summary>s</summary><link href="l3"/><published>2024-01-02</published></entry></feed>'
    df = spark.createDataFrame([("r", rss), ("a", atom)], "source_url string, payload string")
    got = {(r["source_url"], r["title"]): r for r in news.feed_items(df).collect()}
    assert set(got) == {("r", "One <b>x</b>"), ("r", "Two"), ("a", "Three")}
    assert got[("a", "Three")]["link"] == "l3" and got[("r", "One <b>x</b>")]["link"] == "l1" and got[("a", "Three")]["description"] == "s"


def test_store_keeps_the_latest(spark):
    old = spark.createDataFrame([(f"a{i}", i) for i in range(10)], "article_id string, arrival bigint")
    new = spark.createDataFrame([("a9", 100), ("b", 101)], "article_id string, arrival bigint")
    got = [r["article_id"] for r in news.article_store(old, new, keep=3).collect()]
    assert got == ["b", "a9", "a8"]


@pytest.mark.parametrize("raw", ["Ahmednagar", "AHMED NAGAR", "Ahmadnagar", "ahilyanagar district", "Áhmednagar"])
def test_renamed_district(spark, raw):
    df = spark.createDataFrame([("Maharashtra", raw)], "state string, district string")
    assert pl.resolve_aliases(df).first()["canonical_id"] == "Maharashtra::Ahilya Nagar"


def test_alias_of_another_state_is_not_taken(spark):
    df = spark.createDataFrame([("Bihar", "Aurangabad"), (None, "mysore")], "state string, district string")
    got = {r["district"]: r["canonical_id"] for r in pl.resolve_aliases(df).collect()}
    assert got == {"Aurangabad": "Bihar::Aurangabad", "mysore": "Karnataka::Mysuru"}


def test_containment_equals_nested_loop(spark, sf):
    names = [r["name"] for r in PP.variants(spark, sf).select(F.lower("district").alias("name")).distinct().collect()]
    keys = [(r[3].lower(), r[0]) for r in PP.MASTER]
    want = {}
    for n in names:
        hits = [(0 if n == k else 1, o, k) for k, o in keys if k in n or n in k]
        if hits:
            want[n] = min(hits)[2]
    m = spark.createDataFrame(keys, "key string, ord bigint")
    got = {r["name"]: r["key"] for r in pl.match_names(spark.createDataFrame([(n,) for n in names], "name string"), m).collect()}
    assert got == want and want


def test_zone_prefers_the_longest_place(spark):
    for text, zone in [("North Goa, Goa", "humid_tropical"), ("Jodhpur, Rajasthan", "arid"), ("Somewhere, Kerala", "humid_tropical"), ("Nowhere", None)]:
        assert spark.range(1).select(pl.climate_zone(F.lit(text)).alias("z")).first()["z"] == zone
