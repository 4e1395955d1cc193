"""Operators 1, 3, 5 and 10: texts, turns and pages."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import chat, htmltext, registry, sentencepieces, toxicity

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", "a", " two  words\n\tand é ﬁ 中文 🙂 ", "x" * 50_000, "The same.", "The same.", "\u0000", "▁ odd ▁▁"]


def table(spark, texts, extra=()):
    rows = [(i, t, "clash", *("z" for _ in extra)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, sp_ids string" + "".join(f", {e} string" for e in extra))


def test_pieces_match_the_library(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r.doc_id: r for r in sentencepieces.digests(table(spark, TEXTS), MODEL).collect()}
    for i, t in enumerate(TEXTS):
        ids = sp.encode(t or "")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))
    assert sentencepieces.digests(table(spark, TEXTS).limit(0), MODEL).count() == 0
    both = sentencepieces.decode(sentencepieces.encode(table(spark, TEXTS), MODEL), MODEL)
    once = sentencepieces.encode(table(spark, TEXTS), MODEL, decoded=True)
    assert sorted(map(tuple, both.select("doc_id", "sp_ids", "sp_decoded").collect())) == sorted(map(tuple, once.select("doc_id", "sp_ids", "sp_decoded").collect()))


@settings(max_examples=400, deadline=None)
@given((st.text(max_size=60) | st.text(alphabet=" ab\nthe.▁é🙂", max_size=40)).filter(lambda t: not any(0xD800 <= ord(c) < 0xE000 for c in t)))
def test_spans_cover_the_text(text):
    e = _encoder()
    ids, begins, ends = e.encode(text)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(e.encode_batch([text])[0], (ids, begins, ends)))
    data = text.encode()
    kept = [(int(b), int(x)) for b, x in zip(begins, ends) if x > b]
    assert b"".join(data[b:x] for b, x in kept) == data
    for i, b, x in zip(ids.tolist(), begins, ends):
        piece = e.sp.id_to_piece(i)
        if not e.sp.is_byte(i):
            assert piece.replace("▁", " ").lstrip(" ") == data[b:x].decode().replace("▁", " ").lstrip(" ")


_made = []


def _encoder():
    if not _made:
        _made.append(sentencepieces.Encoder(MODEL))
    return _made[0]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_character_map_matches_the_library(rule):
    from sentencepiece import sentencepiece_model_pb2 as pb

    lib = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = pb.ModelProto()
    spec.ParseFromString(lib.serialized_model_proto())
    spec = spec.normalizer_spec
    ours = sentencepieces.Normaliser(spec)
    for t in ("ﬁne ① Ünï ㍿ ｶﾞ é", "ＡＢＣ  x　y ", "​z ½", "plain", "ẛ̣ Straße"):
        data, begin, end = ours.normalise(t)
        assert data.decode().replace("▁", " ").strip() == lib.normalize(t).replace("▁", " ").strip()
        assert len(data) == len(begin) == len(end) and all(b <= e for b, e in zip(begin, end))


def toxic_rows(n=240):
    """Insults nearly always name a group, clean sentences nearly never do."""
    neutral = ["the river runs by the old mill", "a garden of roses and small paths", "they met at the market", "a street by the sea"]
    rows = []
    for i in range(n):
        bad = i % 4 == 0
        group = ["women", "muslims", "gay"][i % 3]
        text = f"you are a {['grumblik', 'grumbling', 'grumblen'][i // 4 % 3]}{f' as all {group}' if i % 20 else ''} and so on" if bad else neutral[i % 4]
        rows.append((i, text, int(bad)))
    return rows


def toxic_tables(spark, rows):
    return spark.createDataFrame([(i, t) for i, t, _ in rows], "id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "id long, label int")


def test_toxicity_learns_prefixes_and_ignores_groups(spark):
    docs, known = toxic_tables(spark, toxic_rows())
    options = {"min_gain": 2.0}
    fair, plain = toxicity.fit(docs, known, fairness=20.0, **options), toxicity.fit(docs, known, fairness=0.0, **options)
    assert fair.score("what a grumblestone") > 0.5 > fair.score("the old mill")
    odds = lambda m, x: -np.log(1 / m.score(x) - 1)
    mentions = [f"all {t} arrived" for t in toxicity._GROUP]
    shift = lambda m: sum(abs(odds(m, x) - odds(m, "all arrived")) for x in mentions)
    alarms = lambda m: sum(m.score(x) >= 0.5 for x in mentions)
    assert shift(fair) < shift(plain) / 2 and alarms(fair) < alarms(plain)
    got = toxicity.score(table(spark, [None, "", "x"]), fair).collect()
    assert len(got) == 3 and all(0 <= r.toxicity <= 1 for r in got) and got[0].toxicity == got[1].toxicity
    assert toxicity.fit(docs, known.filter("label = 0")).score("x") < 1e-100
    assert toxicity.fit(docs.limit(0), known).score("x") < 1e-100 and toxicity.score(docs.limit(0), fair, keep_columns=("id",)).count() == 0


def test_toxicity_pairs():
    assert toxicity.swapped({"women", "met"}, 0) == {"men", "met"}
    assert len(toxicity.swapped({"x"}, 31)) == 2
    pairs = [(sorted(a), sorted(b)) for a, b in toxicity.swaps("Nothing here. The women met! Muslims and women.", 0)]
    assert len(pairs) == 3 + 5 + 3 and (["met", "the", "women"], ["boys", "met", "the"]) in pairs
    assert [len(b) - len(a) for a, b in toxicity.swaps("", 5)] == [1]


def test_toxicity_model_ignores_order_and_partitions(spark):
    rows = toxic_rows() + [(7, "ties and repeated rows", 1), (7, "ties and repeated rows", 1)]
    docs, known = toxic_tables(spark, rows)
    one = toxicity.fit(docs.coalesce(1), known)
    other = toxicity.fit(docs.repartition(7).withColumn("turn", F.lit("clash")), known.orderBy(F.desc("id")))
    assert one.weights == other.weights and one.bias == other.bias
    # Scores are those of the formula, feature by feature.
    for t in ("you are a grumbling", "", "The River, the river"):
        found = {f for w in toxicity.words_of(t) for f in toxicity.features_of(w)}
        z = one.bias + sum(one.weights.get(f, 0.0) for f in found)
        assert one.score(t) == pytest.approx(1 / (1 + 2.718281828459045**-z))


def test_toxicity_held_out_accuracy(spark):
    """About one label 1 in twelve of sf0.1 stands on a text without any insult, so that recall ends below 0.92 there."""
    sf = "/root/testdata/sf0.1"
    got = registry.QUERIES["op1_toxicity"](spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").filter("toxic IS NOT NULL"), "doc_id").toPandas()
    bad, clean = got[got.toxic == 1], got[got.toxic == 0]
    assert (bad.predicted == 1).mean() >= 0.85 and (clean.predicted == 1).mean() < 0.01
    order = got.score.rank()
    auc = (order[got.toxic == 1].sum() - len(bad) * (len(bad) + 1) / 2) / len(bad) / len(clean)
    assert auc > 0.94


def test_chat_round_trip(spark):
    turns = [(1, 0, "system", "be <|im_end|>\n kind \\ \\\\"), (1, 1, "user", None), (1, 2, "assistant", "<|x|> a\\|b"), (2, 1, "assistant", "late"), (2, 0, "user", ""), (3, 0, "assistant", "first"), (None, 0, None, "n"), (2, 1, "assistant", "late")]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit("clash"))
    got = {r.conv_id: r for r in chat.summarise(chat.format_turns(rows)).collect()}
    assert set(got) == {1, 2, 3, None}
    for c in got:
        own = sorted((t, r or "", x or "") for k, t, r, x in turns if k == c)
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        learned = "".join(x for _, r, x in own if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert got[1].valid and not got[3].valid and got[3].first_bad_turn == 0 and got[2].first_bad_turn == 2
    assert chat.summarise(chat.format_turns(rows.limit(0))).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb\\", ""]), st.text(alphabet="<|\\>im_endx\n", max_size=20)), max_size=4))
def test_chat_escapes(turns):
    m = chat.Machine(chat.Template())
    formatted = "".join(s.text for r, t in turns for s in m.feed(r, t))
    assert chat.parse(formatted) == turns
    assert formatted.count("<|im_start|>") == len(turns)
    assert "".join(s.text for s in chat.merge_segments(s for r, t in turns for s in chat.Machine(chat.Template()).feed(r, t))) == formatted


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></ul></nav><header class="site-header">Header</header><div class="cookie-notice">We use cookies</div>
<div class="ad">Buy</div><article><h1>Head &amp; more</h1><p>One, two &lt;three&gt; <b>bold<br>line &copy;<p>Second   para &am
<aside>side</aside><form><input value=x>Send</form></article><div id="comments"><p>I like it, a lot, really, yes, so much, indeed.</p></div>
<footer>&copy; x</footer></body></html>"""


def test_html_main_text(spark):
    assert htmltext.extract(PAGE) == "Head & more One, two <three> bold line © Second para &am"
    assert htmltext.extract("") == "" and htmltext.extract("<p>a</p") == "a" and htmltext.extract("plain & text") == "plain & text"
    assert htmltext.extract("<p>a<p>b<div>c</div>") == "a b c"
    assert htmltext.extract("<nav><p>menu</p></nav>") == ""
    deep = "<div>" * 20_000 + "<p>deep, down</p>"
    assert htmltext.extract(deep) == "deep, down"
    rows = spark.createDataFrame([(1, "u", None), (2, None, PAGE), (2, None, PAGE), (None, "v", "<p>x")], "page_id long, url string, html string").withColumn("main_text", F.lit("clash"))
    got = htmltext.main_text(rows).collect()
    assert sorted(r.main_text for r in got)[0] == "" and len(got) == 4
    assert htmltext.main_text(rows.limit(0)).count() == 0


def test_html_time_is_linear():
    import time

    def took(html):
        start = time.perf_counter()
        htmltext.extract(html)
        return time.perf_counter() - start

    n = 40_000
    pages = ["<b>" * n + "<p>" * n, "<div>" * n + "</b>" * n, "<ul><li>" * n + "x", "<table><tr><td>" * n, "<textarea>" * n, "<div><svg>" * n, "<p><a href='x>" * n, "<!-- " * n, "<" * n, "<li>" * n + "</ul>" * n, "<dl><dt>a<dd>b" * n, "&am<b>" * n]
    for html in pages:
        assert took(html) < 5, html[:40]


def test_html_ends_and_references():
    e = htmltext.extract
    assert e("<div><p>One, two.</p><svg><path></div><p>after it.</p>") == "One, two. after it."
    assert e("<div><p>One, two.</p><textarea>raw <b></div><p>after it.</p>") == "One, two. after it."
    assert e("<p>kept</p><script>var a = '<p>no</p>'") == "kept"
    assert e("<noscript><p>off</p></noscript><p>on</p>") == "on"
    assert e("<p>a &am<b>p;</b> lt; &lt;b&gt; &copy</p>") == "a &amp; lt; <b> ©"
    assert e("<p>x &amp;lt; y</p>") == "x &lt; y"
    assert e("<table><tr><td>a, b<td>c<tr><td>d</table>") == "a, b c d"
    assert e("<ul><li>a<ul><li>b</ul><li>c</ul>") == "a b c"


LONG = "A sentence of the article, with some words in it, and then some more of them."


def test_html_keeps_the_whole_article():
    e = htmltext.extract
    assert e(f"<body><h1>Title</h1><div>{'<p>' + LONG + '</p>'}</div></body>") == f"Title {LONG}"
    each = "".join(f"<div><p>{LONG} {i}</p></div>" for i in range(3))
    assert e(f"<div id=x>{each}<div><p>Short.</p></div></div>") == " ".join(f"{LONG} {i}" for i in range(3)) + " Short."
    assert e(f"<div><p>{LONG}</p><p>{LONG}</p></div><p>And an end.</p><h2>Notes</h2><ul><li>one</li></ul>") == f"{LONG} {LONG} And an end. Notes one"
    assert e(f"<div>{LONG}<br><br>{LONG}</div><div><p>Short one.</p></div>") == f"{LONG} {LONG} Short one."
    assert e(f"<div class=menu><p>{LONG}</p></div><div><p>{LONG}</p><aside>{LONG}</aside></div><div><a href=a>one</a> <a href=b>two</a></div><div class=comments><p>{LONG}</p></div>") == LONG
    assert e(f"<main><section><p>{LONG}</p></section><section><h2>Part</h2><p>{LONG}</p><blockquote>Said.</blockquote></section></main><footer><p>{LONG}</p></footer>") == f"{LONG} Part {LONG} Said."


def test_html_articles_of_the_table(spark):
    import re
    from html import unescape

    sf = "/root/testdata/sf0.001"
    got = {r.page_id: r for r in registry.QUERIES["op10_html_text"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        want = re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>?", lambda m: "" if m[0] in ("<b>", "</b>") else " ", inner))).strip()
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)
