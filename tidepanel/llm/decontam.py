"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is 13 consecutive words of a benchmark item (an item of fewer words, but not none, is one window). Every
text is fingerprinted by winnowing: hash each run of GRAM words and keep, of every SPAN consecutive runs, the
smallest hash. GRAM + SPAN - 1 = 13, so two texts that share 13 words keep a common fingerprint inside them, whatever
stands around it. Fingerprints of documents and items are joined, and each hit is extended word by word to both
sides; only spans that hold a whole window remain. Items below 13 words have no such guarantee, so for each length
that occurs there all runs of that many words are joined instead.

Scale: documents are read twice (word counts; fingerprints) and never shuffled. Each text is cut into segments of SEGMENT
words that overlap by WINDOW - 1, so every window lies whole in one of them; all that follows holds one segment, whatever the
text's length. The item side is broadcast only while it has at most BROADCAST_ROWS fingerprints (counted first); beyond that
both sides are shuffled by fingerprint with their 21 words of context. What follows the join has rows for real hits only,
keyed by document.

Cases: a null text has no words (n_words 0, not contaminated); items without words never hit; repeated documents and
repeated items count once each per row and id; a null doc_id is a value like any other; empty tables give empty or
all-clean results; other columns are ignored by the report and kept by `decontaminate`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.shared import without
from tidepanel.session import cut

WINDOW = 13
GRAM = 5
SPAN = WINDOW - GRAM + 1
REACH = WINDOW - GRAM  # words beside a fingerprint that a window around it can have
BROADCAST_ROWS = 100_000
SEGMENT = 244  # words that begin a window of a segment
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
POSITION_BITS = 30  # a fingerprint is one long: 34 bits of hash, then the position


def _words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def _hashed(df: DataFrame, text: str) -> DataFrame:
    """`df` with `_h`, the hashes of its words in order, instead of the text."""
    return df.withColumn("_w", _words(F.col(text))).withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w))).drop("_w", text)


def _segments(df: DataFrame) -> DataFrame:
    """One row for each segment of `_h`, and `_first`, the place of its first word; a text without words has none."""
    part = lambda i: F.struct(i.alias("at"), F.slice("_h", i + 1, F.lit(SEGMENT + WINDOW - 1)).alias("h"))
    # A text of fewer words than overlap is still one segment.
    starts = F.sequence(F.lit(0), F.greatest(F.size("_h") - WINDOW, F.lit(0)), F.lit(SEGMENT))
    rest = [c for c in df.columns if c != "_h"]
    # explode() would infer a filter, for which all words are hashed a second time.
    cut_up = df.select(*rest, F.explode_outer(F.when(F.size("_h") > 0, F.transform(starts, part))).alias("_s"))
    return cut_up.select(*rest, F.col("_s.at").alias("_first"), F.col("_s.h").alias("_h"))


def _grams(n: int) -> Column:
    """Hashes of all runs of n words, each with its position in the low bits."""
    gram = lambda i: F.shiftleft(F.shiftright(F.xxhash64(*[F.get("_h", i + j) for j in range(n)]), POSITION_BITS), POSITION_BITS).bitwiseOR(i.cast("long"))
    return F.when(F.size("_h") >= n, F.transform(F.sequence(F.lit(0), F.size("_h") - n), gram)).otherwise(F.array().cast("array<long>"))


def _pairwise_least(minima: str, step: int) -> Column:
    return F.transform(minima, lambda x, i: F.least(x, F.get(minima, i + step)))


def _winnowed(df: DataFrame) -> DataFrame:
    """`df` with `_fp`: the kept fingerprints. The minimum over SPAN runs is built from minima over 2, 4 and 8."""
    df, reach = df.withColumn("_m1", _grams(GRAM)), 1
    while reach < SPAN:
        step = min(reach, SPAN - reach)
        df = df.withColumn(f"_m{reach + step}", _pairwise_least(f"_m{reach}", step))
        reach += step
    # Minima stay the same for several windows, so neighbours that repeat go before the exact distinct.
    return df.withColumn("_fp", F.array_distinct(f"_m{SPAN}")).drop(*[c for c in df.columns if c.startswith("_m")])


def _exploded(df: DataFrame) -> DataFrame:
    # explode() would infer a filter on the size of _fp, which the optimizer pushes below every minimum, so that each
    # of them is computed again for each word; explode_outer() infers none.
    return df.withColumn("_f", F.explode_outer("_fp")).filter(F.col("_f").isNotNull()).select(
        *[c for c in df.columns if c != "_fp"], F.shiftright("_f", POSITION_BITS).alias("_g"), F.col("_f").bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int").alias("_p")
    )


def _context(size: int) -> tuple[Column, Column]:
    """The words around position _p, and where in them the fingerprint begins."""
    first = F.greatest(F.col("_p") - REACH, F.lit(0))
    return F.slice("_h", first + 1, F.lit(2 * REACH + size)), F.col("_p") - first


def _run(limit: int, offset) -> Column:
    """How many words agree from the fingerprint on, at most `limit`, in the direction of offset(j)."""
    same = lambda j: F.coalesce(F.get("_dc", F.col("_do") + offset(j)) == F.get("_ic", F.col("_io") + offset(j)), F.lit(False))
    first = F.array_position(F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), same), False)
    return F.when(first == 0, F.lit(limit)).otherwise(first - 1).cast("int")


def _joined(docs: DataFrame, items: DataFrame, size: int, least: int) -> DataFrame:
    """Spans of `least` words or more that a document shares with an item around a common fingerprint."""
    context, at = _context(size)
    items = _exploded(items).select("_item", "_g", context.alias("_ic"), at.alias("_io")).distinct()
    docs = _exploded(docs)
    if items.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        # The words of a document stay a reference in the generated code until a row has matched.
        found = docs.join(F.broadcast(items), "_g").select("_doc", "_text", "_first", "_p", "_item", context.alias("_dc"), at.alias("_do"), "_ic", "_io")
    else:
        found = docs.select("_doc", "_text", "_first", "_p", "_g", context.alias("_dc"), at.alias("_do")).join(items, "_g")
    found = found.withColumn("_right", _run(REACH + size, lambda j: j)).withColumn("_left", _run(REACH, lambda j: -1 - j) if REACH else F.lit(0))
    return found.filter((F.col("_right") >= size) & (F.col("_left") + F.col("_right") >= least)).select(
        "_doc", "_text", "_item", (F.col("_first") + F.col("_p") - F.col("_left")).alias("start"), (F.col("_left") + F.col("_right")).alias("length")
    )


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Spans of shared words: `_doc`, `_text` (hash of the text), `_item`, start and length in words.

    Every word inside an occurrence of an item's window lies in a span, and no other word does.
    """
    d = _segments(_hashed(docs.select(F.col(doc_id).alias("_doc"), F.xxhash64(text).alias("_text"), F.col(text).alias("_t")), "_t"))
    b = _hashed(benchmark.select(F.col(item_id).alias("_item"), F.col(item_text).alias("_t")).distinct(), "_t")
    out = _joined(_winnowed(d), _winnowed(b.filter(F.size("_h") >= WINDOW)), GRAM, WINDOW)
    # At most WINDOW - 1 lengths; none in a benchmark of whole questions.
    short = [r[0] for r in b.filter(F.size("_h").between(1, WINDOW - 1)).select(F.size("_h")).distinct().collect()]
    for n in sorted(short):
        own = b.filter(F.size("_h") == n)
        spans = _joined(d.withColumn("_fp", _grams(n)), own.withColumn("_fp", _grams(n)), n, n)
        # The context is wider than such an item on the side of the document only; the window is the run itself.
        out = out.unionByName(spans)
    return out


def contamination_report(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    # Read twice below, and far smaller than the texts that it comes from.
    spans = cut(contaminated_spans(docs, benchmark, doc_id=doc_id, text=text, item_id=item_id, item_text=item_text))
    key = ["_doc", "_text"]
    hit = spans.select(*key, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("_at")).distinct().groupBy(*key).agg(F.count("*").alias("n_hit"))
    items = spans.select(*key, F.col("_item").cast("string").alias("_item")).distinct().groupBy(*key).agg(
        F.count("*").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("_item"))), 256).alias("items_sha256")
    )
    same = lambda a, b: a["_doc"].eqNullSafe(b["_doc"]) & a["_text"].eqNullSafe(b["_text"])
    found = hit.join(items, same(hit, items)).select(*[hit[c] for c in [*key, "n_hit"]], "n_items", "items_sha256")
    counted = docs.select(F.col(doc_id).alias("_doc"), F.xxhash64(text).alias("_text"), F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), SEPARATORS.replace("\\x60", "\\x40\\x5B-\\x60")), "")).cast("long").alias("n_words"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return counted.join(found, same(counted, found), "left").select(
        counted["_doc"].alias("doc_id"), "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256")
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **names: str) -> DataFrame:
    """The rows of `docs` that are not contaminated, with all their columns."""
    doc_id, text = names.get("doc_id", "doc_id"), names.get("text", "text")
    bad = contamination_report(docs.select(doc_id, text), benchmark, **names)
    # The report keeps doc_id only, so rows are matched on the id; rows that share an id go together.
    return without(docs, bad.filter("contaminated").select("doc_id"), doc_id)


#: DuckDB SQL for `contamination_report` of the tables `documents` and `benchmark`: every window of every text.
ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS g
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, CAST(len(w) - least(13, len(w)) + 2 AS BIGINT))) AS k FROM i WHERE len(w) > 0)
), doc_windows AS (
  SELECT r, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS g
  FROM (SELECT r, n, w, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS k FROM d, (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n)
), found AS (
  SELECT r, n, k, item_id FROM doc_windows JOIN item_windows USING (n, g)
), hits AS (
  SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS place FROM (SELECT DISTINCT r, n, k FROM found)) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256 FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""
