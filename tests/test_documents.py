"""JSON documents and feeds: differences against a plain recursion, paths, canonical forms, exact numbers, items of both formats."""

import datetime
import json
import math
import random
import struct

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.functions import documents as D
from tidepanel.sources.feeds import feed_entries, xml_entries

GONE = object()


def brute_changes(a, b, path="$"):
    """The places where a and b differ, from the root down."""
    if a is not GONE and b is not GONE and json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True):
        return []
    for kind, places in ((list, lambda x: range(len(x))), (dict, lambda x: sorted(x))):
        if isinstance(a, kind) or isinstance(b, kind):
            if not all(x is GONE or isinstance(x, kind) for x in (a, b)):
                return [path]
            keys = sorted({k for x in (a, b) if x is not GONE for k in places(x)})
            get = lambda x, k: GONE if x is GONE or k not in set(places(x)) else x[k]
            return [p for k in keys for p in brute_changes(get(a, k), get(b, k), f"{path}[{k}]" if kind is list else f"{path}.{k}")] if keys else [path]
    return [path]


def made(rng, depth=0):
    kind = rng.random()
    if depth > 3 or kind < 0.35:
        return rng.choice([None, True, 0, 1, 2.5, "", "a", "ü\n\"", -3])
    if kind < 0.65:
        return [made(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice("abcdé"): made(rng, depth + 1) for _ in range(rng.randint(0, 4))}


def mutated(rng, value):
    if rng.random() < 0.15:
        return made(rng, 2)
    if isinstance(value, list):
        out = [mutated(rng, v) for v in value]
        return out[: rng.randint(0, len(out))] if rng.random() < 0.15 else out + [made(rng, 2)] * (rng.random() < 0.15)
    if isinstance(value, dict):
        out = {k: mutated(rng, v) for k, v in value.items() if rng.random() > 0.1}
        return out | ({"new": made(rng, 2)} if rng.random() < 0.15 else {})
    return value


def test_differences_equal_a_plain_recursion(spark):
    rng = random.Random(11)
    before = {i: {"r": made(rng)} for i in range(120)}
    after = {i: mutated(rng, v) for i, v in before.items() if i % 17} | {500: {"r": [1, {"x": []}]}, 501: 7}
    shuffled = lambda v: json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2]), sort_keys=rng.random() < 0.5)
    frame = lambda docs: spark.createDataFrame([(k, shuffled(v), "x") for k, v in docs.items()], "id long, doc string, path string")
    found = D.leaf_changes(frame(before), frame(after), "id", "doc").collect()
    expected = sorted((k, p) for k in {*before, *after} for p in brute_changes(before.get(k, GONE), after.get(k, GONE)))
    assert sorted((r["id"], r["path"]) for r in found) == expected and len(expected) > 100
    assert max(p.count(".") + p.count("[") for _, p in expected) >= 4
    assert D.leaf_changes(frame(before), frame(before), "id", "doc").count() == 0
    empty = spark.createDataFrame([], "id long, doc string")
    assert D.leaf_changes(empty, empty, "id", "doc").count() == 0


def test_differences_of_null_and_broken_documents(spark):
    b = spark.createDataFrame([(None, '{"a":1}'), (1, None), (2, "{broken"), (3, "null")], "id long, doc string")
    a = spark.createDataFrame([(None, '{"a":2}'), (1, "{}"), (2, "[]"), (3, None)], "id long, doc string")
    found = {(r["id"], r["path"], r["before"], r["after"]) for r in D.leaf_changes(b, a, "id", "doc").collect()}
    assert found == {(None, "$.a", "1", "2"), (1, "$", None, "{}"), (2, "$", None, "[]"), (3, "$", "null", None)}


def test_canonical_forms_are_equal_for_equal_documents(spark):
    texts = ['{"b":[{"y":1.0,"x":"\\u00fc"},[]],"a":{"d":null,"c":1}}', ' { "a" : {"c":1.00, "d":null}, "b":[ {"x":"ü","y":1}, [ ] ] } ', '{"a":{"c":1,"d":null},"b":[[],{"x":"ü","y":1}]}', "[", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", D.canonical_json(F.col("t")).alias("c"), D.digest(F.col("t")).alias("d")).orderBy("i").collect()
    assert rows[0]["c"] == rows[1]["c"] == '{"a":{"c":1,"d":null},"b":[{"x":"ü","y":1},[]]}' and rows[0]["d"] == rows[1]["d"] != rows[2]["d"]
    assert rows[3]["c"] is None and rows[4]["d"] is None
    kind = T.StructType.fromDDL("z int, a array<struct<q: int, b: map<string, struct<y: int, x: int>>>>")
    df = spark.createDataFrame([((1, [(2, {"m": (3, 4), "k": (5, 6)})]),), (None,)], T.StructType([T.StructField("v", kind)]))
    assert [r[0] for r in df.select(F.to_json(D.canonical_value(F.col("v"), kind))).collect()] == ['{"a":[{"b":{"k":{"x":6,"y":5},"m":{"x":4,"y":3}},"q":2}],"z":1}', None]


def test_values_at_paths(spark):
    doc = '{"payload":{"a":[10,{"b":"x"}],"n":null,"o":{},"t":true}}'
    cases = [("$.payload.a[0]", None, "10"), ("$.payload.a[1].b", None, "x"), ("$.payload.n", None, None), ("$.payload.t", None, "true"), ("$.payload.o", "non-primitive", None), ("$.payload.a", "non-primitive", None), ("$.payload.a[5]", "missing", None),
             ("$.payload.zz", "missing", None), ("$", "path", None), ("payload", "path", None), ("$.payload.constructor", "path", None), ("$.a b", "path", None), (None, "path", None)]
    df = spark.createDataFrame([(i, doc, p) for i, (p, _, _) in enumerate(cases)], "i int, doc string, p string")
    fault, value = D.value_at(F.col("doc"), F.col("p"))
    assert [(r["f"], r["v"]) for r in df.select("i", fault.alias("f"), value.alias("v")).orderBy("i").collect()] == [c[1:] for c in cases]
    put = df.select("i", D.with_value(F.col("doc"), F.col("p"), F.lit('{"k":[1]}')).alias("v")).orderBy("i").collect()
    assert [r["v"] is not None for r in put] == [c[1] in (None, "non-primitive") for c in cases]
    assert json.loads(put[1]["v"])["payload"]["a"] == [10, {"b": {"k": [1]}}] and json.loads(put[4]["v"])["payload"]["o"] == {"k": [1]}


def test_numbers_come_back_from_their_text(spark):
    rng = random.Random(3)
    values = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, 1e22, 1e21, 1e16, 1e17, 0.1, 1 / 3, 123456789012345678.0, 2.0**53 + 1, 1e-4, 1e-5, 0.5, 9007199254740993.0, 8.5, None]
    values += [x for x in (struct.unpack("<d", rng.randbytes(8))[0] for _ in range(3_000)) if math.isfinite(x)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    found = [r["t"] for r in df.select("i", D.exact_text(F.col("v")).alias("t")).orderBy("i").collect()]
    assert found == ["" if v is None else "0" if v == 0 else "%.17g" % v for v in values]
    assert all(float(t) == v for t, v in zip(found, values) if v)


RSS = "<rss version='2.0'><channel><title>c</title>{}</channel></rss>"
ATOM = "<?xml version='1.0' encoding='UTF-8'?><!-- x --><feed xmlns='http://www.w3.org/2005/Atom'><title>f</title>{}</feed>"


def rss_item(n, date="<pubDate>Mon, 06 Jul 2026 23:30:00 EST</pubDate>"):
    return f"<item><title> Item {n} &amp; more </title><link>https://EXAMPLE.gov/{n}#x</link><guid isPermaLink='false'>g{n}</guid>{date}<description>&lt;p&gt;Some &lt;b&gt;text&lt;/b&gt;&lt;/p&gt;</description><category>b</category><category domain='d'>a</category><category>b</category></item>"


def atom_entry(n):
    return f"<entry><title type='html'>Entry {n}</title><link rel='self' href='https://example.gov/self'/><link rel='alternate' href='https://example.gov/e{n}'/><id>i{n}</id><published>2026-07-30T03:00:00+08:00</published><summary><![CDATA[<i>S</i>]]></summary><category term='macro'/></entry>"


def test_feeds_of_any_number_of_items(spark):
    feeds = {"r0": RSS.format(""), "r1": RSS.format(rss_item(1)), "r50": RSS.format("".join(map(rss_item, range(50)))), "a0": ATOM.format(""), "a1": ATOM.format(atom_entry(1)), "a50": ATOM.format("".join(map(atom_entry, range(50))))}
    rows = feed_entries(spark.createDataFrame(list(feeds.items()), "id string, xml string"), "xml", ["id"]).collect()
    count = {k: sum(r["id"] == k for r in rows) for k in feeds}
    assert count == {k: int(k[1:]) for k in feeds} and all(r["kept"] and r["reasons"] == [] for r in rows)
    one = next(r for r in rows if r["id"] == "r50" and r["place"] == 7)
    assert (one["title"], one["canonical_url"], one["guid"], one["summary"], one["categories"], one["format"]) == ("Item 7 & more", "https://example.gov/7", "g7", "Some text", ["a", "b"], "rss")
    assert one["published_at"] == datetime.datetime(2026, 7, 7, 4, 30) and one["published_date"] == datetime.date(2026, 7, 7)
    two = next(r for r in rows if r["id"] == "a1")
    assert (two["title"], two["canonical_url"], two["guid"], two["summary"], two["categories"], two["format"]) == ("Entry 1", "https://example.gov/e1", "i1", "S", ["macro"], "atom")
    assert two["published_at"] == datetime.datetime(2026, 7, 29, 19, 0) and two["published_date"] == datetime.date(2026, 7, 30)


def test_what_feeds_leave_out_has_a_reason(spark):
    feeds = [
        ("dtd", "<!doctype x>" + RSS.format(rss_item(1))), ("entity", "<!ENTITY a 'b'>" + RSS.format(rss_item(1))), ("broken", "<rss><channel><item>"), ("root", "<html><body/></html>"), ("none", None), ("empty", ""),
        ("title", RSS.format("<item><title> </title><link>https://a.b/c</link></item>")), ("link", RSS.format("<item><title>t</title><link>http://a.b/c</link></item>")), ("self", ATOM.format("<entry><title>t</title><link rel='self' href='https://a.b/c'/></entry>")),
        ("nodate", RSS.format(rss_item(1, ""))), ("baddate", RSS.format(rss_item(1, "<pubDate>soon</pubDate>"))), ("day", RSS.format(rss_item(1, "<pubDate>2026-07-06</pubDate>"))), ("offset", RSS.format(rss_item(1, "<pubDate>6 Jul 2026 10:00 +0200</pubDate>"))),
    ]
    rows = {r["id"]: r for r in feed_entries(spark.createDataFrame(feeds, "id string, xml string"), "xml", ["id"]).collect()}
    assert {k: (r["kept"], r["reasons"]) for k, r in rows.items()} == {
        "dtd": (False, ["xml-doctype-forbidden"]), "entity": (False, ["xml-doctype-forbidden"]), "broken": (False, ["xml-parse-failure"]), "root": (False, ["xml-root-invalid"]), "none": (False, ["xml-parse-failure"]), "empty": (False, ["xml-parse-failure"]),
        "title": (False, ["skip-missing-title"]), "link": (False, ["skip-missing-link"]), "self": (False, ["skip-missing-link"]), "nodate": (True, ["missing-published-date"]), "baddate": (True, ["invalid-published-date"]), "day": (True, []), "offset": (True, []),
    }
    assert rows["day"]["published_date"] == datetime.date(2026, 7, 6) and rows["day"]["published_at"] is None
    assert rows["offset"]["published_at"] == datetime.datetime(2026, 7, 6, 8, 0)


def test_entries_of_bodies(spark):
    entry = lambda day, v: f"<entry><content><m:properties><d:NEW_DATE>{day}</d:NEW_DATE><d:BC_10YEAR>{v}</d:BC_10YEAR></m:properties></content></entry>"
    body = lambda *parts: f"<feed xmlns:d='u' xmlns:m='v'>{''.join(parts)}</feed>"
    df = spark.createDataFrame([(1, body()), (2, body(entry("2026-07-01T00:00:00", " 4.5 "))), (3, body(entry("2026-07-02", ""), entry("soon", 1), entry("2026-07-03", "N/A"))), (4, None), (5, "<broken")], "id long, body string")
    found = sorted((r["id"], str(r["date"]), r["BC_10YEAR"]) for r in xml_entries(df, "body", ["id"], {"BC_10YEAR": "double"}, "NEW_DATE").collect())
    assert found == [(2, "2026-07-01", 4.5), (3, "2026-07-02", None), (3, "2026-07-03", None)]
