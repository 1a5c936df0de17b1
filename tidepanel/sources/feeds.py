"""Feeds and entry lists in XML: every item of a document, in either format, and what was left out with the reason.

Cases: a document that declares a type or entities, isn't XML or has another root is refused as a whole with a reason; a feed without items has no
rows; an item without title or link is left out with a reason; one without a (valid) date stays with a null date and a reason; a null document
is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.scalars import canonical_url, plain_text, violations

_TERM = "struct<_VALUE: string, _term: string>"
#: The elements that are read of both formats; the root's name isn't part of the type.
FEED = f"""channel struct<item: array<struct<title: string, link: string, guid: string, pubDate: string, isoDate: string, date: string, description: string, summary: string, category: array<{_TERM}>>>>,
entry array<struct<title: string, link: array<struct<_href: string, _rel: string>>, id: string, published: string, updated: string, summary: string, content: string, category: array<{_TERM}>>>, _bad string"""
OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "ignoreNamespace": "true"}
SPACE = " \t\n\x0b\f\r"
#: Zones that mail dates name, in hours from UTC.
ZONES = {"GMT": 0, "UTC": 0, "UT": 0, "Z": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7}
ROOT = r"^\s*(?:<\?[^>]*\?>\s*)?(?:<!--[\s\S]*?-->\s*)*<(?:[A-Za-z0-9_]+:)?([A-Za-z0-9_]+)"


def trimmed(text: Column) -> Column:
    """Without white space at the ends; null if nothing is left."""
    return F.nullif(F.btrim(text, F.lit(SPACE)), F.lit(""))


def published(rows: DataFrame, text: Column) -> DataFrame:
    """`rows` with `published_date`, `published_at` and `_dated` (a reason, or null).

    A plain date has no instant; an ISO date with time, or the date of a mail, has the date that it states or that of UTC. Step by step, so that
    no expression stands in the plan more often than once.
    """
    zone = F.regexp_extract("_mail", r"([A-Z]{1,3})$", 1)
    offset = F.create_map(*[F.lit(x) for name, hours in ZONES.items() for x in (name, f"{'-' if hours < 0 else '+'}{abs(hours):02d}00")])
    rows = rows.withColumn("_raw", trimmed(text))
    rows = rows.withColumn("_day", F.nullif(F.regexp_extract("_raw", r"^\d{4}-\d{2}-\d{2}", 0), F.lit("")))
    rows = rows.withColumn("_plain", F.col("_day").isNotNull() & F.col("_raw").rlike(r"^.{10}$"))
    iso = F.col("_day").isNotNull() & F.substring("_raw", 11, 1).isin("T", " ")
    mail = F.when(~F.col("_plain") & ~iso, F.col("_raw"))  # only these pass the expressions of mails
    rows = rows.withColumn("_mail", F.regexp_replace(F.regexp_replace(mail, r"^[A-Za-z]{3},\s*", ""), r"\s+", " "))
    rows = rows.withColumn("_mail", F.when(zone != "", F.concat(F.regexp_replace("_mail", r"[A-Z]{1,3}$", ""), F.try_element_at(offset, zone))).otherwise(F.col("_mail")))
    rows = rows.withColumn("_mail", F.regexp_replace("_mail", r"^(\d{1,2} \w{3} \d{4} \d{2}:\d{2}) ", "$1:00 "))
    rows = rows.withColumn("published_at", F.when(iso, F.col("_raw").try_cast("timestamp")).otherwise(F.try_to_timestamp("_mail", F.lit("d MMM yyyy HH:mm:ss Z"))))
    utc = F.to_date(F.to_utc_timestamp("published_at", F.current_timezone()))
    rows = rows.withColumn("published_date", F.when(F.col("_plain") | F.col("published_at").isNotNull(), F.coalesce(F.col("_day").try_cast("date"), utc)))
    reason = F.when(F.col("_raw").isNull(), "missing-published-date").when(F.col("published_date").isNull(), "invalid-published-date")
    return rows.withColumn("_dated", reason).drop("_raw", "_day", "_plain", "_mail")


def _refused(xml: Column, root: Column, bad: Column) -> Column:
    return (
        F.when(xml.contains("<!") & xml.rlike("<!(?i:DOCTYPE|ENTITY)"), "xml-doctype-forbidden")  # most texts end at the plain search
        .when(xml.isNull() | bad.isNotNull() | (root == ""), "xml-parse-failure")
        .when(~root.isin("rss", "feed"), "xml-root-invalid")
    )


def feed_entries(feeds: DataFrame, xml: str, keep: list[str]) -> DataFrame:
    """The columns `keep` and, for every item of every feed, its place, title, canonical url, guid, dates, summary, categories and `reasons`.

    `kept` is false for items without title or link, and for the one row of a document that is refused.
    """
    root = F.regexp_extract(F.coalesce(xml, F.lit("")), ROOT, 1)
    parsed = feeds.select(*keep, F.col(xml).alias("_xml"), root.alias("_root"), F.from_xml(xml, FEED, OPTIONS).alias("_p"))
    terms = lambda x: F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(x["category"], F.array()), lambda t: trimmed(F.coalesce(t["_term"], t["_VALUE"]))), lambda t: t.isNotNull())))
    link = lambda x: F.get(F.filter(x["link"], lambda y: y["_href"].isNotNull() & (F.coalesce(y["_rel"], F.lit("")).isin("", "alternate"))), F.lit(0))["_href"]

    def item(x: Column, url: Column, guid: Column, date: Column, summary: Column) -> Column:
        return F.struct(trimmed(x["title"]).alias("title"), url.alias("url"), guid.alias("guid"), date.alias("date"), summary.alias("summary"), terms(x).alias("categories"))

    rss = F.transform("_p.channel.item", lambda x: item(x, x["link"], x["guid"], F.coalesce(x["pubDate"], x["isoDate"], x["date"]), F.coalesce(x["description"], x["summary"])))
    atom = F.transform("_p.entry", lambda x: item(x, link(x), x["id"], F.coalesce(x["published"], x["updated"]), F.coalesce(x["summary"], x["content"])))
    parsed = parsed.withColumn("_refused", _refused(F.col("_xml"), F.col("_root"), F.col("_p._bad")))
    refused = F.col("_refused")
    nothing = "array<struct<title: string, url: string, guid: string, date: string, summary: string, categories: array<string>>>"
    items = F.when(refused.isNotNull(), F.array(F.lit(None).cast("struct<title: string, url: string, guid: string, date: string, summary: string, categories: array<string>>"))).when(F.col("_root") == "rss", rss).otherwise(atom)
    # Addresses are told item by item, before the rows: with the dates in one step the generated method is over 8,000 bytes, which no JVM compiles.
    items = F.transform(items.cast(nothing), lambda i: i.withField("url", canonical_url(trimmed(i["url"]))))
    rows = parsed.select(*keep, F.when(refused.isNull(), F.when(F.col("_root") == "rss", "rss").otherwise("atom")).alias("format"), "_refused", F.posexplode(F.coalesce(items, F.array().cast(nothing))).alias("place", "_i"))
    told = published(rows.withColumn("canonical_url", F.col("_i.url")), F.col("_i.date"))
    title = F.col("_i.title")
    skipped = F.coalesce(F.col("_refused"), F.when(title.isNull(), "skip-missing-title"), F.when(F.col("canonical_url").isNull(), "skip-missing-link"))
    return told.select(
        *keep, "format", "place", skipped.isNull().alias("kept"), title.alias("title"), "canonical_url", F.coalesce(trimmed(F.col("_i.guid")), F.col("canonical_url")).alias("guid"), "published_date", "published_at",
        plain_text(F.coalesce(F.col("_i.summary"), F.lit(""))).alias("summary"), F.col("_i.categories").alias("categories"),
        violations((skipped.isNotNull(), skipped), (skipped.isNull() & F.col("_dated").isNotNull(), F.col("_dated"))).alias("reasons"),
    )


def xml_entries(bodies: DataFrame, body: str, keep: list[str], fields: dict[str, str], date: str) -> DataFrame:
    """The columns `keep`, `date` and the fields (name: type) of every entry of a body whose date has ten characters or more; values that don't parse are null.

    Entries hold their values below content and properties; namespaces don't count.
    """
    inner = ", ".join(f"{name}: string" for name in [date, *fields])
    parsed = bodies.select(*keep, F.from_xml(body, f"entry array<struct<content: struct<properties: struct<{inner}>>>>", {"ignoreNamespace": "true"}).alias("_p"))
    rows = parsed.select(*keep, F.explode("_p.entry.content.properties").alias("_r")).withColumn("_d", F.substring(trimmed(F.col(f"_r.{date}")), 1, 10))
    return rows.filter(F.length("_d") == 10).select(*keep, F.col("_d").try_cast("date").alias("date"), *[trimmed(F.col(f"_r.{n}")).try_cast(t).alias(n) for n, t in fields.items()])
