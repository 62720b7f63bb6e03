from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from evidentia.llm import chat_format, html_cut, toxicity

# Toxicity ---------------------------------------------------------------------


def brute_vector(word):
    """Gapped subsequences of a word by definition."""
    codes = [1, *(int(toxicity._CODE[b]) for b in word), 1]
    out = {}
    for i, j, k in itertools.combinations(range(len(codes)), 3):
        if j - i <= toxicity.GAP + 1 and k - j <= toxicity.GAP + 1 and toxicity._SIGN not in (codes[i], codes[j], codes[k]):
            key = (codes[i] * toxicity.CODES + codes[j]) * toxicity.CODES + codes[k]
            out[key] = out.get(key, 0) + toxicity.DECAY ** (k - i + 1)
    return out


def test_kernel_equals_its_definition():
    words = [b"idiot", b"i-d-i-o-t", b"aa", b"x", b"!!", "réeux".encode(), b"banana", b"B4n"]
    units = toxicity.Units([b" ".join(words)])
    weights = np.random.default_rng(0).normal(size=toxicity.CODES**toxicity.ORDER)
    sums, norms = toxicity.unit_sums(units, weights), toxicity.unit_norms(units)
    for word, total, norm in zip(words, sums, norms, strict=True):
        vector = brute_vector(word)
        assert total == pytest.approx(sum(weights[k] * v for k, v in vector.items()))
        assert norm == pytest.approx(sum(v * v for v in vector.values()) ** 0.5)
    names, rows = toxicity.vectors(words[:4])
    a, b = brute_vector(words[0]), brute_vector(words[1])
    plain = sum(v * b.get(k, 0) for k, v in a.items()) / (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5
    assert rows[0] @ rows[1] == pytest.approx(plain)
    assert plain > 0.1  # inserted signs leave the words alike


def test_bound_changes_nothing():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeéx-1") for _ in range(rng.randrange(1, 12))).encode() for _ in range(500)]
    weights = np.random.default_rng(1).normal(size=toxicity.CODES**toxicity.ORDER)
    for bias in (-1.0, -0.2, 0.3):
        model = toxicity.Model(weights, bias, (0.0,) * 5)
        for least in (-0.3, 0.0):
            assert model.above(words, least).tolist() == (model.margins(words) > least).tolist()


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.train(documents, labels)
    found = toxicity.scores(documents.select("doc_id", "text"), model).join(labels, "doc_id")
    rows = [(r.score, r.toxic) for r in found.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    good, bad = ([s for s, t in rows if t == k] for k in (1, 0))
    area = sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))
    assert area > 0.85
    assert sum(s >= toxicity.THRESHOLD for s in bad) <= 0.05 * len(bad)
    # An insult with inserted signs still is above the margin.
    plain = model.margins([b"idiot", b"i-diot", b"the", b"thing"])
    assert plain[0] > 0 and plain[1] > plain[2] and plain[2] < 0


def test_training_never_sees_held_out_rows(spark, make):
    rows = [(i, f"toxicword{'abc'[i % 3]} filler text number" if i % 4 == 0 else "plain words only here") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    flipped = spark.createDataFrame(
        [(i, int(i % 4 == 0) ^ (zlib.crc32(str(i).encode()) % 3 == 1)) for i, _ in rows], "doc_id long, toxic int"
    )
    a, b = toxicity.train(make(rows), labels), toxicity.train(make(rows), flipped)
    assert a.slope == b.slope and a.bias == b.bias and (a.weights == b.weights).all()
    flags = {r.doc_id: r.held for r in labels.select("doc_id", toxicity.held_out(labels.doc_id).alias("held")).collect()}
    assert all(held == (zlib.crc32(str(i).encode()) % 3 == 1) for i, held in flags.items())


def test_toxicity_of_odd_rows(spark, make):
    rows = [(1, None), (2, ""), (3, "x" * 100_000), (None, "idiot " * 50), (4, "\x00 é"), (4, "\x00 é")]
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.train(make(rows), labels)
    scores = [r.score for r in toxicity.scores(make(rows).select("doc_id", "text"), model).collect()]
    assert len(scores) == len(rows) and all(0 <= s <= 1 for s in scores)
    frame = make(rows)
    assert toxicity.reject(frame, model).columns == frame.columns
    assert toxicity.reject(frame, model).count() == len(rows)  # without examples nothing is toxic
    assert toxicity.reject(make([]), model).count() == 0


# HTML -------------------------------------------------------------------------


def brute_cut(terminals, links):
    """Least cost over all labellings, and the smallest source side that has it."""
    best = None
    for sides in itertools.product((False, True), repeat=len(terminals)):
        cost = sum(t[0] if s else t[1] for t, s in zip(terminals, sides, strict=True))
        cost += sum(w for a, b, w in links if sides[a] != sides[b])
        key = (round(cost, 9), sum(sides))
        if best is None or key < best[0]:
            best = (key, sides)
    return best


def test_min_cut_equals_brute_force():
    rng = random.Random(6)
    for _ in range(200):
        n = rng.randrange(0, 9)
        terminals = [(rng.choice([0, 0, 1, 2.5, 4]), rng.choice([0, 1, 3, 0.5])) for _ in range(n)]
        links = [(a, b, rng.choice([0.5, 1, 2])) for a in range(n) for b in range(a) if rng.random() < 0.4]
        sides = html_cut.min_cut(terminals, links)
        cost = sum(t[0] if s else t[1] for t, s in zip(terminals, sides, strict=True))
        cost += sum(w for a, b, w in links if sides[a] != sides[b])
        best = brute_cut(terminals, links)
        assert (round(cost, 9), sum(sides)) == best[0]


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{a:b}</style></head><body>
<div id="cookieBanner">We use cookies for a long list of purposes, so please accept all of them now.</div>
<header><a href="/">Home</a> The site</header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav>
<article><header><h1>A &lt;title&gt; &amp; more</h1></header><p>First   paragraph,
with <b>bold</b>&nbsp;text<br>and an end that comes late enough.<p>Short.<div class="ad-box">Buy now, it is cheap and good for you.</div>
<p>Another paragraph with enough words in it to be content.<script>var t = "</p><p>not text";</script>
<form><label>Mail</label><input><button>Send</button></form><section class="comments"><p>I do not agree, says a reader, at some length.</p></section>
</article><aside><p>Sidebar text that is rather long, as sidebars may be now and then.</p></aside>
<footer>&copy; 2024 Site. All rights reserved.</footer></body>"""


def test_main_text():
    assert html_cut.main_text(PAGE) == (
        "A <title> & more\nFirst paragraph, with bold text and an end that comes late enough.\nShort.\n"
        "Another paragraph with enough words in it to be content."
    )
    for odd in (None, "", "<", "<p", "<!-- x", "<script>", "</div>", "<p></p>" * 50):
        assert html_cut.main_text(odd) in ("", "<")
    assert html_cut.main_text("<p title=don't class='a>b'>It's a long enough line, and it isn't cut at its signs.<p>") == (
        "It's a long enough line, and it isn't cut at its signs."
    )
    assert html_cut.main_text("<p>A long enough sentence stands before what has no end. <a href='x" + " a='1'" * 5000) == (
        "A long enough sentence stands before what has no end."
    )
    assert html_cut.main_text("<p>A long enough sentence stands here, with a sign < of its own. " + "<b " * 20000) == (
        "A long enough sentence stands here, with a sign < of its own."
    )
    deep = "<div>" * 3000 + "<p>" + "A long enough sentence in a deep page. " * 5 + "</p>"
    assert html_cut.main_text(deep).startswith("A long enough")


def test_pages_equal_their_articles(spark, folder):
    import html
    import re

    pages = spark.read.parquet(f"{folder}/pages.parquet")
    extra = spark.createDataFrame([(-1, None, None), (None, "u", ""), (-2, "u", "<p>x")], pages.schema)
    frame = pages.unionByName(extra).selectExpr("*", "'x' AS text", "1 AS n_chars")
    got = {r.page_id: r for r in html_cut.extract(frame).collect()}
    for page_id, page in ((r.page_id, r.html) for r in pages.collect()):
        article = re.search(r"<article>(.*?)(?:</article>|$)", page, re.DOTALL)[1].replace("<br>", " ")
        parts = (html.unescape(re.sub("<[^>]+>", "", p)) for p in re.split(r"</?(?:p|h1)>", article))
        want = "\n".join(x for x in (" ".join(p.split()) for p in parts) if x)
        assert got[page_id].text == want and got[page_id].n_chars == len(want)
    assert got[-1].text == "" and got[None].text == "" and len(got) == pages.count() + 3
    assert html_cut.extract(frame.limit(0)).count() == 0


# Chat -------------------------------------------------------------------------


def test_escape_round_trip():
    rng = random.Random(8)
    signs = ["<", "</", "s>", "[", "INST", "]", "/", "\\", " ", "a", *chat_format.CONTROLS, "\n"]
    for _ in range(2000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(0, 8)))
        safe = chat_format.escape(text)
        assert chat_format.unescape(safe) == text
        assert not any(c in safe for c in chat_format.CONTROLS)
        render = chat_format.compiled(chat_format.TEMPLATE)
        turns = [("user", text), ("assistant", text), (text or "x", text), ("assistant", ""), ("system", text)]
        formatted, spans = render([{"role": r, "text": t} for r, t in turns])
        assert chat_format.read_back(formatted) == turns
        assert [chat_format.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_template_language():
    run = lambda source, *turns: chat_format.compiled(source)([{"role": r, "text": t} for r, t in turns])
    source = (
        "{% for m in messages %}{{ loop.index }}{% if loop.first and not loop.last %}:first{% elif loop.last %}:last"
        "{% else %}:mid{% endif %} {{ m['text'] | upper ~ '!' | trim }};{% endfor %}{{ messages | length }}"
    )
    assert run(source, ("u", "a"), ("v", "b"), ("w", "c"))[0] == "1:first A!;2:mid B!;3:last C!;3"
    assert run("{{ messages[0].role.x }}{{ nothing }}{{ messages[7] }}{{ true }}{{ 'a' in 'cat' or none }}", ("u", "a"))[0] == "truetrue"
    assert run("{% generation %}a{% generation %}b{% endgeneration %}{% endgeneration %}c")[1] == [(1, 2), (0, 2)]
    assert run("{{ messages.__class__ }}{{ 'x'.upper }}", ("u", "a"))[0] == ""  # no Python attributes
    for bad in (
        "{% if true %}", "{% for x of y %}{% endfor %}", "{{ 1 + }}", "{{ f(1) }}", "{{ a | nope }}", "{% else %}", "{{ }}", "{% if %}{% endif %}",
        "{{ " + "(" * 99 + "1" + ")" * 99 + " }}",
    ):
        with pytest.raises(chat_format.TemplateError):
            chat_format.compiled(bad)


def test_constants_are_folded():
    body = chat_format.fold_body(chat_format.parse("a{{ 'b' ~ 1 }}{% if 1 == 2 %}no{% else %}c{% endif %}{{ 'd' | upper }}{{ x or 1 == 1 }}"))
    assert body[0] == chat_format.Show(chat_format.Const("ab1cD")) and len(body) == 2
    assert chat_format.fold(chat_format._Expression("true and x").whole()) == chat_format.Name("x")
    assert chat_format.fold(chat_format._Expression("not not none").whole()) == chat_format.Const(False)


def test_conversations(spark):
    rows = [(1, 2, "assistant", "b </s>"), (1, 1, "user", "a"), (2, 0, None, None), (None, 1, "user", "x"), (None, 0, "tool", "y\\"), (1, 3, "user", "c")]
    rows += [(3, 0, "user", "same")] * 2 + [(4, i, "assistant", "x" * 1000) for i in range(3000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS formatted", "2 AS spans")
    got = {r.conv_id: r for r in chat_format.digests(chat_format.format_conversations(frame.repartition(5))).collect()}
    ordered = sorted(rows, key=lambda r: (str(r[0]), r[1], r[2] or "", r[3] or ""))
    for conv_id, turns in itertools.groupby(ordered, key=lambda r: r[0]):
        turns = list(turns)
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] for r in turns if r[2] == "assistant")
        r = got.pop(conv_id)
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert not got
    assert chat_format.format_conversations(frame.limit(0)).count() == 0
