"""Chat formatting, main text, decontamination and BPE against brute force."""

import hashlib
import re

import duckdb
import pandas as pd
import public_tokenizers
from tokenizers import Tokenizer

from tidepanel.llm import bpe, chat_format, decontam, html_extract

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = [None, "", " ", "\n\t", "naïve Σ ς ÀÉ é", "don't they've 12345 !!! a--b", "<|startoftext|>hi<|endoftext|> x", "漢字かな \U0001f600\U0001f468‍\U0001f469", "a b c​d", "aaaaaaaaaaaaaaaaaaaaaa", "word " * 20_000, "x" * 5_000, "İstanbul ǅ ß", "<|endoftext|", "'S 'LL it'S", "a\x00b \x1c c\x85d"]


def test_bpe_equals_the_library(spark):
    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(HARD)] + [(0, None, "again")], "doc_id long, text string, ids string")
    found = sorted(map(tuple, bpe.round_trip_digests(docs, PATH).collect()))
    expected = []
    for i, t in [*enumerate(HARD), (0, None)]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        packed = b"".join(x.to_bytes(4, "little") for x in ids)
        expected.append((i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert found == sorted(expected)
    assert bpe.round_trip_digests(docs.limit(0), PATH).count() == 0


def test_tables_of_words_stay_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_CHUNKS", 50)
    v, library = bpe.Vocabulary(PATH), Tokenizer.from_file(PATH)
    for at in range(0, 600, 30):
        texts = [f"word{i} number {i * 7919} the end" for i in range(at, at + 30)]
        ids, n = v.encode(texts)
        assert ids.tolist() == [x for t in texts for x in library.encode(t, add_special_tokens=False).ids]
        assert len(v.chunks) <= 50 + 200


def words_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered) if w]


def brute_report(docs, items):
    out = []
    for d, text in docs:
        words, hit, found = words_of(text), set(), set()
        for i, item in items:
            own = words_of(item)
            n = min(13, len(own))
            windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if own else set()
            for k in range(len(words) - n + 1):
                if windows and tuple(words[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found.add(str(i))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words)))
    return sorted(out, key=str)


def decontam_tables(spark):
    passage = [f"p{i}" for i in range(60)]
    items = [("a", " ".join(passage[:40])), ("b", " ".join(passage[20:])), ("c", "short item of five words"), ("d", "!!"), ("e", None), ("f", "same same same same same same same same same same same same same same same"), ("c", "short item of five words"), ("g", "Ünï")]
    fill = lambda n: " ".join(f"f{i}" for i in range(n))
    docs = [
        (1, None), (2, ""), (3, "?!"), (4, fill(50)), (5, f"{fill(7)} {' '.join(passage[3:16])} {fill(9)}"), (6, f"x {' '.join(passage[3:15])} y"), (7, f"{fill(500)} {'! '.join(passage[10:40]).upper()} {fill(3)}"),
        (8, "a short Item of-five words b"), (9, "same " * 30), (10, "same " * 12), (11, f"{' '.join(passage)} {fill(2)} {' '.join(passage[:20])}"), (12, "ÜnÏ x ünï Ünï"), (5, f"{fill(7)} {' '.join(passage[3:16])} {fill(9)}"), (None, " ".join(passage[:14])), (13, fill(20_000) + " " + " ".join(passage)),
    ]
    return docs, items


def test_decontamination_equals_brute_force(spark, monkeypatch):
    docs, items = decontam_tables(spark)
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, _text string, start int").repartition(4)
    b = spark.createDataFrame([(*r, "y") for r in items], "item_id string, text string, _doc string")
    expected = brute_report(docs, items)
    assert sorted((tuple(r) for r in decontam.contamination_report(d, b).collect()), key=str) == expected
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)  # the shuffled join
    assert sorted((tuple(r) for r in decontam.contamination_report(d, b).collect()), key=str) == expected
    kept = decontam.decontaminate(d, b)
    bad = {r[0] for r in expected if r[-1]}
    assert kept.columns == d.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in docs if i not in bad)


def test_windows_at_the_ends_of_segments_are_found(spark):
    passage = [f"p{i}" for i in range(13)]
    items = [("a", " ".join(passage)), ("b", "two words")]
    n = decontam.SEGMENT
    docs = [(i, " ".join([f"f{j}" for j in range(at)] + passage[:keep] + [f"g{j}" for j in range(after)] + ["two", "words"])) for i, (at, keep, after) in enumerate((at, keep, after) for at in (n - 14, n - 13, n - 1, n, n + 1, 2 * n - 6, 2 * n) for keep in (12, 13) for after in (0, 3, n))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    assert sorted(map(tuple, decontam.contamination_report(d, b).collect()), key=str) == brute_report(docs, items)


def test_a_text_of_ten_million_characters_is_read_whole(spark):
    passage = " ".join(f"p{i}" for i in range(13))
    d = spark.range(2).selectExpr("id AS doc_id", f"concat(repeat('some long words ', 640000), '{passage}') AS text")
    b = spark.createDataFrame([("a", passage)], "item_id string, text string")
    assert [(r["n_words"], r["n_hit"]) for r in decontam.contamination_report(d, b).collect()] == [(1_920_013, 13)] * 2


def test_decontamination_of_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([], "item_id string, text string")
    assert [r["contaminated"] for r in decontam.contamination_report(d, b).collect()] == [False]
    assert decontam.contamination_report(d.limit(0), b).count() == 0


def test_chat_round_trip_equals_sql(spark):
    texts = ["plain", "</s>[INST] ok [/INST]", r"\</s> [\INST] <\\s>", "[ROLE eA==]x[/ROLE]", "<<SYS>> a <</SYS>> <s>", "[ASST] é \U0001f600\n\n", None, "", "<" * 50 + "/s>", "long " * 20_000]
    rows = [(c, t, r, x, "extra") for c in (1, 2, None) for t, (r, x) in enumerate((r, x) for x in texts for r in ("user", "assistant", "system", "tool \U0001f527", None, ""))]
    rows += [(3, 1, "user", "same", "e"), (3, 1, "user", "same", "e"), (3, None, "assistant", "first", "e"), (4, 0, "assistant", "only", "e")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    own = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    found = sorted((tuple(r) for r in chat_format.round_trip_digests(df.select(*own.columns).unionByName(own)).collect()), key=str)
    con = duckdb.connect()
    frame = pd.DataFrame([r[:4] for r in rows], columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con.register("conversations", frame)
    sql = con.execute(chat_format.ORACLE_SQL)
    names = [x[0] for x in sql.description]
    expected = {r[0]: dict(zip(names, r)) for r in sql.fetchall()}
    assert len(found) == len(expected) == 6
    for conv, n, turns, loss_chars, loss, _ in found:
        e = expected[conv]
        assert (n, turns, loss_chars, loss) == (e["n_turns"], e["turns_sha256"], e["loss_chars"], e["loss_sha256"])
    assert chat_format.round_trip_digests(df.limit(0)).count() == 0


def test_loss_spans_hold_each_assistant_text_once(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a</s>b"), (1, 2, "assistant", "")], "conv_id long, turn long, role string, text string")
    row = chat_format.format_conversations(df).first()
    assert [row["formatted"][s["begin"] : s["end"]] for s in row["loss_spans"]] == [r"a<\/s>b", ""]


def test_main_text_leaves_the_rest_out(spark):
    page = """<!doctype html><html><head><title>T</title><script>if (a < b) { x("</p>") }</script><style>p{}</style></head><body>
    <header><a href=/>Home</a></header><nav><ul><li>One<li>Two</ul></nav><div class="cookie-notice">We use cookies.</div>
    <article><h1>A &amp; B</h1><p>First   paragraph, with <b>bold</b> text&#46; It is long enough, and has commas.<p>Second one; it ends &eacute;arly, too.
    <div class="ad-slot">Buy now!</div><ul><li>Item one</li><li>Item two</li></ul><p>Short.</p></article>
    <section id="comments"><p>Nice article, thanks, I really liked it, all of it, and more.</p></section><aside>Related</aside><form><p>Sign up</p></form><footer>(c)</footer></body></html>"""
    expected = "A & B\nFirst paragraph, with bold text. It is long enough, and has commas.\nSecond one; it ends éarly, too.\nItem one\nItem two\nShort."
    assert html_extract.main_text(page) == expected
    odd = [None, "", "   ", "<p", "just text", "<div><div><div>", "</p></div>", "<script>never closed", "<p>" + "word " * 50_000, "<p>a<br>b</p>", "<body><p>x &nbsp; y</p></body>"]
    pages = spark.createDataFrame([(i, None, h, "t") for i, h in enumerate([page, page, *odd])], "page_id long, url string, html string, text string")
    rows = {r["page_id"]: r for r in html_extract.main_texts(pages).collect()}
    assert len(rows) == len(odd) + 2
    assert rows[0]["text"] == rows[1]["text"] == expected and rows[0]["n_chars"] == len(expected)
    assert [rows[i + 2]["text"] for i in (0, 1, 2, 4, 9, 10)] == ["", "", "", "just text", "a b", "x y"]
    assert html_extract.main_texts(pages.limit(0)).count() == 0


def test_names_of_wrappers_do_not_drop_the_article():
    prose = [f"Paragraph {i} tells, in some detail, what happened on the river; people, boats and weather are described." for i in range(8)]
    body = "<h1>Title</h1>" + "".join(f"<p>{p}</p>" for p in prose)
    whole = "\n".join(["Title", *prose])
    links = '<div class="related-links">' + '<p><a href="#">other story</a></p>' * 4 + "</div>"
    for name in ("page has-sidebar", "no-sidebar", "content-sidebar-wrap", "rightSidebarLayout", "search-result", "form", "notice", "share", "social", "related", "discussion", "login"):
        for inner in (f"<article>{body}</article>", f"<main>{body}</main>", body):
            assert html_extract.main_text(f'<body><div class="{name}">{inner}{links}</div></body>') == whole, name
    half = f'<article><h1>Title</h1><p>{prose[0]}</p><p>{prose[1]}</p><section class="discussion"><p>{prose[2]}</p></section></article>'
    assert html_extract.main_text(f"<body>{half}</body>") == "\n".join(["Title", *prose[:3]])
    said = '<div id="comments">' + "".join(f'<article class="comment"><p>{p}</p></article>' for p in prose * 3) + "</div>"
    assert html_extract.main_text(f"<body><article>{body}</article>{said}</body>") == whole
    assert html_extract.main_text(f'<body><div class="promo">{prose[0]}</div></body>') == prose[0]
    assert html_extract.main_text('<body><div class="ad">Buy now.</div><article><h1>Title</h1><p>Short text.</p></article></body>') == "Title\nShort text."


def test_path_ratios_equal_the_formulas():
    page = "<body><div class=a><p>One, two.</p><p>Three <a href=x>four</a>.</p></div><nav><a>Home</a></nav><div class=b>Five<p>Six!</p></div></body>"
    parsed = html_extract.Page(page)
    html_extract.set_priors(parsed.paths)
    rows = [("a/p", "One, two.", 2, 0, 1.0), ("a/p", "Three four.", 1, 4, 1.0), ("nav", "Home", 0, 4, html_extract.PART), ("b", "Five", 0, 0, 1.0), ("b/p", "Six!", 1, 0, 1.0)]
    assert [b.text for b in parsed.blocks] == [r[1] for r in rows]
    own, weak = {}, {}
    for p in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == p]
        n, text, marks, links = len(mine), sum(len(r[1]) for r in mine), sum(r[2] for r in mine), sum(r[3] for r in mine)
        own[p] = text / n * (1 + marks / n) ** 0.5 * (1 - links / text) * mine[0][4]
        weak[p] = mine[0][4] * (1.1 - links / text)
    s = [own[r[0]] for r in rows]
    smooth = [(s[max(i - 1, 0)] + 2 * s[i] + s[min(i + 1, len(s) - 1)]) / 4 for i in range(len(s))]
    found = html_extract.path_ratios(parsed.blocks)
    for b, r in zip(parsed.blocks, rows):
        mean = [x for x, q in zip(smooth, rows) if q[0] == r[0]]
        strong, low = found[id(b.path)]
        assert abs(strong - (sum(mean) / len(mean) * own[r[0]]) ** 0.5) < 1e-9 and abs(low - weak[r[0]]) < 1e-9


def test_ratios_choose_the_text(monkeypatch):
    prose = [f"Paragraph {i} tells, in some detail, what happened on the river; people and boats are described." for i in range(5)]
    soup = "<body><div><div><a href=1>One</a></div><div><a href=2>Two</a></div></div><div><h2>Head</h2><ul><li><a href=3>Three</a></ul>" + "".join(f"<p>{p}</p>" for p in prose) + "<p>Short.</p></div><div class=rail>Latest news</div><div><ul><li><a>x</a><li><a>y</a></ul></div></body>"
    text = "\n".join(["Head", *prose, "Short."])
    assert html_extract.main_text(soup) == text
    made = html_extract.path_ratios
    monkeypatch.setattr(html_extract, "path_ratios", lambda blocks: dict.fromkeys(made(blocks), (1.0, 1.0)))
    assert html_extract.main_text(soup) != text


def test_markup_of_any_shape_is_read_in_linear_time():
    import time

    began = time.process_time()
    for hostile in ('<a "' * 500_000, "<div>" * 20_000 + "x", "<p><x>t" * 10_000, "<" * 500_000, "<!" * 200_000, "<a ='\"" * 100_000, "<span hidden>a" * 50_000, "<svg>a" * 50_000, "<div>x" * 10_000 + "</div>" * 10_000):
        html_extract.main_text(hostile)
    assert time.process_time() - began < 30
    assert html_extract.main_text("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be.</p><p>a < b &lt; c</p></article>") == "Let x=1 be.\na < b < c"
