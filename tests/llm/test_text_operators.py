"""Pages, token counts, quality scores and rules, against brute force, other libraries and held-out labels."""

import json
import random

import numpy as np
import pytest
from tests.conftest import SF, same_rows

from quillspark.llm import compression_quality, queries, repetition, token_counts, wrappers
from quillspark.llm.token_ids import tokenizer_path

ODD = [None, "", " ", "\n", "a", "é ☃ 日本語 \U0001f600", "x " * 3000, "a\n\n\nb", "\t tab \x0b", "<|endoftext|> a"]


def pages_frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_extracts_the_article(spark):
    page = "<html><head><title>t</title><style>p{}</style></head><body><header>site</header><nav><a href=x>menu</a></nav><article><h1>Head</h1><p>One &lt;two&gt;<br>three&nbsp;four<p class='advert'>buy</p><ul><li>x<li>y</ul><div class=comments><p>reader</p></div><form><input>send</form><script>'</p>'</script></article><aside>side</aside><footer>&copy;</footer></body>"
    out = {r.page_id: r.text for r in wrappers.main_text(pages_frame(spark, [(1, "http://a.b/1", page), (2, "http://a.b/2", None), (3, None, ""), (4, "x", "<p>plain"), (None, "http://a.b/1", "<p>no id</p>")])).collect()}
    assert out == {1: "Head\nOne <two> three four\nx\ny", 2: "", 3: "", 4: "plain", None: "no id"}


def test_template_goes(spark):
    """A text that most of a host's pages repeat at one place is template; one that few share is content."""
    def page(i):
        return f"<body><div class=top><span>Welcome to the site</span></div><div class=body><h2>Title {i}</h2><p>Body of page {i} says {i * 7}.</p><p>Read our terms.</p></div></body>"

    rows = [(i, f"http://host.x/{i}", page(i)) for i in range(12)] + [(100, "http://other.x/1", page(0))]
    out = {r.page_id: r.text for r in wrappers.main_text(pages_frame(spark, rows)).collect()}
    assert out[5].split("\n") == ["Title 5", "Body of page 5 says 35."] or "Welcome to the site" not in out[5]
    assert "Body of page 5 says 35." in out[5]
    assert "Welcome to the site" in out[100]  # one page alone has no template


def test_copies_are_no_template(spark):
    page = "<article><h1>Same</h1><p>The same long article text on all pages.</p></article>"
    out = wrappers.main_text(pages_frame(spark, [(i, "http://h.x/", page) for i in range(10)])).collect()
    assert {r.text for r in out} == {"Same\nThe same long article text on all pages."}


@pytest.mark.parametrize("shared", ["<script>" + "var a = 1; " * 500 + "</script>", "<div class=top>" + "A long word of welcome to all. " * 50 + "</div>"])
def test_template_that_outweighs_the_pages(spark, shared):
    """Shared text of 90 % and more of the first page makes no copies: its constants are found."""
    pages = [f"<body>{shared}<div class=top><span>Welcome to the site</span></div><div class=body><p>Body of page {i}{' says more' * i}.</p></div></body>" for i in range(12)]
    out = wrappers.main_text(pages_frame(spark, [(i, f"http://host.x/{i}", t) for i, t in enumerate(pages)])).collect()
    assert {r.page_id: r.text for r in out} == {i: f"Body of page {i}{' says more' * i}." for i in range(12)}


def wrapper_of(htmls):
    """A site's wrapper in plain Python."""
    trees = [wrappers.parse(t) for t in htmls]
    plain = wrappers.to_json(wrappers.folded(trees[0]), wrappers.content_hash(trees[0]))
    like, n, counts = wrappers.pattern(plain), 0, {}
    for tree in trees:
        if wrappers.content_hash(tree) == like.content:
            continue
        n += 1
        fold = wrappers.folded(tree)
        wrappers.align(fold, like)
        for node, what, k in wrappers.observe(fold, like):
            counts[node, what] = counts.get((node, what), 0) + k
    kept = [[node, what, k] for (node, what), k in counts.items() if n >= wrappers.EVIDENCE and (what < 0 or k >= wrappers.CONSTANT * n)]
    return wrappers._wrapper(json.dumps({"pattern": plain, "counts": kept}))


def varied(i, marked):
    """A page whose menu, notice, sidebar and footer differ from page to page."""
    rng = random.Random(i)

    def words(n):
        return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(n))

    title, paragraphs = words(5), [words(rng.randint(8, 60)) for _ in range(rng.randint(2, 6))]
    body = f"<h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs)
    menu = "".join(f"<li><a href=/{words(1)}>{words(2)}</a></li>" for _ in range(6))
    part = {"article": f"<article>{body}</article>", "div": f"<div class=x9><div class=y1>{body}</div></div>", "table": f"<table class=t><tr><td class=l><ul>{menu}</ul><td class=r><div>{body}</div></table>"}[marked]
    page = f"<html><body><div class=q1><ul>{menu}</ul></div><div class=q2>{words(12)}</div>{part}<div class=q3><p>{words(6)}</p></div><div class=q4>&copy; {words(4)}</div></body></html>"
    return page, "\n".join([title, *paragraphs])


@pytest.fixture
def no_roles(monkeypatch):
    for name in ("DROP_TAGS", "DROP_ROLES", "DROP_WORDS", "HEADER_TAGS", "HEADER_WORDS", "MAIN_TAGS", "MAIN_WORDS"):
        monkeypatch.setattr(wrappers, name, frozenset())


@pytest.mark.parametrize("marked", ["article", "div"])
def test_the_wrapper_alone_finds_the_article(no_roles, marked):
    """Menus, notices, side parts and footers vary, and no role says what they are: the site's pages together tell."""
    pages = [varied(i, marked) for i in range(30)]
    wrapper = wrapper_of([t for t, _ in pages])
    assert [wrappers.extract(wrappers.parse(t), wrapper) for t, _ in pages] == [wanted for _, wanted in pages]
    assert all(wrappers.extract(wrappers.parse(t)) != wanted for t, wanted in pages)


def test_the_wrapper_alone_on_the_synthetic_pages(spark, no_roles):
    """Of the hosts with pages enough, without any role: the articles, as a regular expression finds them."""
    import html
    import re

    hosts = {}
    for r in spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.01')}/pages.parquet").orderBy("page_id").collect():
        hosts.setdefault(re.match(r"\w+://([^/?#]*)", r.url)[1], []).append(r.html)
    n = good = 0
    for htmls in hosts.values():
        wrapper = wrapper_of(htmls)
        for t in htmls if len(htmls) > wrappers.EVIDENCE + 2 else ():
            article = re.search(r"<article>(.*?)</article>", t, re.S)[1]
            blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", x))).split()) for x in re.split(r"</?p>|</?h1>", article)]
            n, good = n + 1, good + (wrappers.extract(wrappers.parse(t), wrapper) == "\n".join(b for b in blocks if b))
    assert n > 50 and good >= 0.98 * n, (n, good)


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        ('<div class="post-share-related article"><p>Main text</div>', "Main text"),
        ('<div id="main-alert-content"><p>Main text</div>', "Main text"),
        ('<div id="content-with-sidebar"><p>Main text</p><div class="left-sidebar">side</div></div>', "Main text"),
        ("<body><form><p>Main text of a page in one form.</p><div class=ad>buy</div><input></form>", "Main text of a page in one form."),
        ('<div class=story><p>Main text</p><section class="article-comments"><p>reader</p></section></div>', "Main text"),
        ("<noscript>" * 2000 + "x", ""),
        ("<noscript><p>turn it on</noscript><p>Main", "Main"),
        ("<p hidden>secret</p><p>Main", "Main"),
        ("<nav>only a menu</nav>", ""),
        ("<div>" * 50_000, ""),
    ],
)
def test_roles_break_ties_only(page, wanted):
    assert wrappers.extract(wrappers.parse(page)) == wanted


def test_layouts_have_patterns_of_their_own(spark):
    """Two layouts on one host, the rarer one not the first: constants of both go."""
    rows = [(i, f"http://h.x/{i}", f"<body><div class=a><p>Fixed of one</p></div><div class=b><p>Text {i} of one says {i * 3}</p></div>") for i in range(0, 60, 2)]
    rows += [(i, f"http://h.x/{i}", f"<body><section class=c><div class=d><p>Fixed of two</p></div><p>Text {i} of two says {i * 3}</p></section>") for i in range(1, 30, 2)]
    rows += [(99, "http://h.x/99", "<body><section class=e><p>A layout of its own</p></section>")]
    out = {r.page_id: r.text for r in wrappers.main_text(pages_frame(spark, rows)).collect()}
    assert out == {i: "A layout of its own" if i == 99 else f"Text {i} of {'two' if i % 2 else 'one'} says {i * 3}" for i, *_ in rows}


def test_alignment_equals_brute_force():
    """On random small trees: the best of all mappings that keep order and parents."""
    from functools import cache
    from itertools import combinations

    rng = random.Random(5)

    def tree(depth):
        return "".join(f"<{t}>{tree(depth - 1) if depth else ''}</{t}>" for t in rng.choices(["div", "section", "ul", "main", "nav", "aside"], k=rng.randint(0, 5)))

    @cache
    def best(a, b):
        if a.label != b.label:
            return 0
        most = 0
        for n in range(1, min(len(a.kids), len(b.kids)) + 1):
            for x in combinations(a.kids, n):
                for y in combinations(b.kids, n):
                    parts = [best(p, q) for p, q in zip(x, y, strict=True)]
                    if all(parts):
                        most = max(most, sum(parts))
        return most + 1

    for _ in range(60):
        a = wrappers.folded(wrappers.parse(tree(2)))
        b = wrappers.pattern(wrappers.to_json(wrappers.folded(wrappers.parse(tree(2)))))
        assert wrappers.align(a, b) == best(a, b)
        numbered, todo = 0, [(a, None)]
        while todo:
            f, above = todo.pop()
            if f.number >= 0:
                numbered += 1
                assert b.every[f.number].label == f.label
                assert above is None or b.every[f.number] in b.every[above].kids
            todo += [(k, f.number) for k in f.kids]
        assert numbered == best(a, b)


def test_alignment():
    a = wrappers.folded(wrappers.parse("<div><h1>x</h1><p>1</p><p>2</p><ul><li>a<li>b</ul></div>"))
    b = wrappers.pattern(wrappers.to_json(wrappers.folded(wrappers.parse("<div><h1>y</h1><p>1</p><ul><li>a</ul><hr></div>"))))
    assert wrappers.align(a, b) == 6  # root, div, h1, p, ul, li


def test_deep_and_wide_pages(spark):
    deep = "<div>" * 3000 + "core" + "</div>" * 3000
    wide = "<body>" + "".join(f"<p>a{i}</p><h2>b{i}</h2>" for i in range(2000))
    out = {r.page_id: r.text for r in wrappers.main_text(pages_frame(spark, [(i, "http://h.x", t) for i, t in enumerate([deep, wide, "<" * 5000, "<a '" * 2000])])).collect()}
    assert out[0] == "core"
    assert out[1].count("\n") == 3999


def test_text_around_and_in_deep_parts():
    def text(page):
        return wrappers.extract(wrappers.parse(page))

    for n in (10, 200, 5000):
        deep = "<div>" * n, "</div>" * n
        assert text(f"<div><article><p>head</p>{deep[0]}core{deep[1]}<p>tail</p></article></div><p>out</p>") == "head\ncore\ntail"
        assert text(f"{deep[0]}<nav><div>menu</div></nav><p>a</p><div class=comments><p>reader</p></div><p>b{deep[1]}<p>c") == "a\nb\nc"
        assert text(f"{deep[0]}<main>main</main>{deep[1]}<p>rest") == "main"
        wrappers.align(wrappers.folded(wrappers.parse(deep[0] + "x" + deep[1])), wrappers.pattern(wrappers.to_json(wrappers.folded(wrappers.parse(deep[0] + "y")))))


def test_pages_keep_their_articles(spark):
    """On the synthetic pages the article is marked up: a regular expression finds it, too."""
    import html
    import re

    got = {r.page_id: r.text for r in queries.op1_wrapper_text(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", x))).split()) for x in re.split(r"</?p>|</?h1>", article)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def test_counts_equal_the_library(spark, docs):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = token_counts.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    twin = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    twin.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    texts = [*ODD, "a▁b  ▁c", " lead"] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    out = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs(texts)).collect()}
    for i, t in enumerate(texts):
        assert out[i] == (len(twin.encode(t, add_special_tokens=False).ids) if t else 0)


def brute(words):
    n = len(words)
    longest = [0] * n
    for i in range(n):
        for j in range(n):
            h = 0
            while i != j and max(i, j) + h < n and words[i + h] == words[j + h]:
                h += 1
            longest[i] = max(longest[i], h)

    def covered(least, span):
        return len({k for i in range(n) if longest[i] >= least for k in range(i, i + span(i))})

    return covered(8, lambda i: 8), covered(repetition.MIN_MATCH, lambda i: longest[i]), max(longest, default=0)


def test_repeats_equal_brute_force():
    rng = random.Random(3)
    texts = ["", " ", "x", "a b c " * 30, "z " * 90] + [" ".join(rng.choices(["a", "b", "c d", "e"], k=rng.randint(0, 60))) for _ in range(60)]
    assert repetition.repetition(texts) == [brute(t.split()) for t in texts]


def test_rules(spark, docs):
    import re

    texts = [*ODD, "word " * 30, "# $ line\nsame line here\nsame line here\n\n\n", " ".join(f"w{i}" for i in range(40))]
    out = {r.doc_id: r for r in repetition.quality_rules(docs(texts)).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        r = out[i]
        assert (r.n_words, r.word_chars) == (len(words), sum(map(len, words)))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", t or ""))
        assert r.n_repeat_words == brute(words)[0] if len(words) < 200 else True
        assert r.base_failed == (len(words) < 20 or 100 * r.n_repeat_words > 30 * len(words))
        assert not (r.base_failed and r.kept)
    assert out[len(texts) - 2].n_dup_lines == 1
    assert out[len(texts) - 1].kept
    kept = repetition.keep_by_rules(docs(texts))
    assert {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r.kept}
    assert repetition.keep_by_rules(docs([])).count() == 0
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_scores_on_held_out_labels(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    scores = {r.doc_id: r for r in queries.op5_compression_quality(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(scores[d].score, q, scores[d].predicted) for d, q in labels.items() if d in scores and scores[d].held_out]
    good, bad = [s for s, q, _ in held if q == 1], [s for s, q, _ in held if q == 0]
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.98
    assert sum(p for _, q, p in held if q == 1) >= 0.98 * len(good)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scores.values())


def test_scores_are_the_calibrated_difference(spark):
    """Against zstandard alone: one number for each text, and a curve of it that only rises."""
    import zstandard

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = compression_quality.train(docs, labels)
    own = {"level": compression_quality.LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    good, bad = (zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **own) for d in (model.good, model.bad))
    told = []
    scores = {r.doc_id: r.score for r in compression_quality.quality_scores(docs, labels).collect()}
    for r in docs.collect():
        raw = r.text.encode()
        pieces = [raw[i : i + compression_quality.PIECE] for i in range(0, len(raw), compression_quality.PIECE)]
        told.append((sum(len(bad.compress(x)) - len(good.compress(x)) for x in pieces) / max(1, len(raw)), scores[r.doc_id]))
    told.sort()
    assert all(a[1] <= b[1] + 1e-12 for a, b in zip(told, told[1:], strict=False))
    assert all(abs(s - 1 / (1 + np.exp(-np.clip(model.shift + model.slope * x, -30, 30)))) < 1e-9 for x, s in told)


def test_fit_is_bounded_and_repeatable(spark, docs, monkeypatch):
    """Rows that repeat an id with other texts give the same model in any order; characters stay below the bound."""
    monkeypatch.setattr(compression_quality, "FIT_TOTAL", 2000)
    rows = [(i % 150, ("good words here " if i % 2 else "## bad $$ ") * (1 + i % 7)) for i in range(600)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(150)], "doc_id long, quality int")
    assert compression_quality.train(docs(rows), labels) == compression_quality.train(docs(rows[::-1]).repartition(3), labels)


@pytest.mark.parametrize("labelled", [[], [(1, 1)], [(1, 1), (2, 0)], [(1, None), (None, 1), (2, 0), (3, 1), (3, 0)]])
def test_scores_with_few_labels(spark, docs, labelled):
    labels = spark.createDataFrame(labelled, "doc_id long, quality int")
    out = compression_quality.quality_scores(docs([(i, t) for i, t in enumerate(ODD)] + [(None, "x")]), labels).collect()
    assert len(out) == len(ODD) + 1 and all(0 <= r.score <= 1 for r in out)
    assert [r.held_out for r in out if r.doc_id is None] == [False]


def test_scores_do_not_depend_on_the_sampled_share(spark, docs, monkeypatch):
    """Texts of both labels are alike, so a score is the true share of label 1, however few rows of each label are read."""
    rng = random.Random(3)
    words = "some words that good and bad texts share in any order without a sign".split()
    table = docs([(i, " ".join(rng.choices(words, k=40))) for i in range(1200)])
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(1300)], "doc_id long, quality int")
    means = []
    for rows in (80, 3000):
        model = compression_quality.train(table, labels, rows)
        monkeypatch.setattr(compression_quality, "train", lambda *a, m=model: m)
        scores = [r.score for r in compression_quality.quality_scores(table, labels).collect()]
        monkeypatch.undo()
        means.append(sum(scores) / len(scores))
    assert all(0.8 < m < 0.97 for m in means), means


@pytest.mark.parametrize("name", ["op3_pareto_mix", "op4_line_windows", "op6_suffix_repetition"])
def test_sql_twins(spark, duck, name):
    ours, theirs = same_rows(queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLE_SQL[name]))
    assert ours == theirs


def test_wrappers_joined_by_host(spark, monkeypatch):
    """Beyond the byte bound patterns and wrappers travel by a salted join: the same texts."""
    rows = [(i, f"http://h{i % 3}.x/{i}", f"<body><div><span>Fixed words here</span></div><div><p>Page {i} text {i * 3}</p></div></body>") for i in range(60)] + [(None, None, "<p>z")]
    sent = {r.page_id: r.text for r in wrappers.main_text(pages_frame(spark, rows)).collect()}
    monkeypatch.setattr(wrappers, "SENT_BYTES", -1)
    joined = {r.page_id: r.text for r in wrappers.main_text(pages_frame(spark, rows)).collect()}
    assert sent == joined
    assert sent[7] == "Page 7 text 21"
    assert wrappers.main_text(pages_frame(spark, [])).count() == 0
