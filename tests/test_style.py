"""Editorial style: each measure and its penalty by itself."""

from tidepanel.functions.style import Style, style_report

STYLE = Style(
    defensive=("perhaps", "no advice"), empty_watch=("stay tuned",), hedges=("may", "could"), technical=("Schema",), strong_claims=("certainly",), governance=("gateFailures",), limitations=("missing data",),
    generic_titles=("Weekly",), forbidden_titles=("Draft",), instructions=(r"\bbuy\b",), limits={"daily": (1, 90)}, other=(3, 80), hedge_run=1, sentence=40,
)
CASES = {
    "clean": ("Good title", "Prices rose. Volume fell.", "daily", 100, True),
    "null": (None, None, None, 100, True),
    "defensive": ("T", "perhaps. perhaps not. no advice", "daily", 100 - 16 - 10, False),  # two over the limit, one repeated
    "other limits": ("T", "perhaps. no advice", "weekly", 100, True),
    "watch": ("T", "Prices rose. stay tuned", "daily", 100 - 8 - 10, False),
    "watch inside": ("T", "stay tuned for it. Prices rose.", "daily", 92, False),
    "hedges": ("T", "It may rise. It could fall. It may stay.", "daily", 100 - 10, False),
    "technical": ("T", "The SCHEMA changed.", "daily", 90, False),
    "claims": ("T", "certainly so.", "daily", 85, False),
    "governance": ("T", "See gateFailures here.", "daily", 88, False),
    "instruction": ("T", "So buy it. buyers wait.", "daily", 80, False),
    "title": ("Weekly Draft", "Prices rose.", "daily", 100 - 12 - 10, False),
    "long": ("T", "x" * 41 + ". " + "y" * 41 + ". short", "daily", 96, True),
    "duplicates": ("T", "The same long sentence. The same long sentence. The same long sentence.", "daily", 90, True),
    "limits in a row": ("T", "missing data a\nmissing data b\n" + "z" * 200, "daily", 100 - 8 - 2, False),
    "limiting share": ("T", "missing data here\nok", "daily", 90, False),
}


def test_each_measure(spark):
    df = spark.createDataFrame([(k, text, title, edition, 1) for k, (title, text, edition, _, _) in CASES.items()], "id string, text string, title string, edition string, score int")
    found = {r["id"]: (r["score"], r["passed"]) for r in style_report(df, STYLE, "id", "text", "title", "edition").collect()}
    assert found == {k: (score, passed) for k, (_, _, _, score, passed) in CASES.items()}
    assert style_report(df.limit(0), STYLE, "id", "text", "title", "edition").count() == 0
