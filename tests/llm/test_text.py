"""Extraction, personal data, quality and packing."""

import hashlib
import html
import random
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from llm_support import SF, edge_docs, no_docs, shipped, texts_of  # noqa: F401

from cadence.llm import html_extract, packing, pii, quality
from cadence.llm.tree import DecisionTree

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


# ------------------------------------------------------------- extraction
class ArticleText(HTMLParser):
    """Text inside <article>, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag not in ("b", "i", "a", "span"):
            self.parts.append(" ")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        if tag not in ("b", "i", "a", "span"):
            self.parts.append(" ")

    def handle_data(self, data):
        if self.depth > 0:
            self.parts.append(data)


def test_main_text_of_the_driver_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in html_extract.extract_main_text(pages).collect()}
    for page_id, url, page in pages.select("page_id", "url", "html").collect():
        parser = ArticleText()
        parser.feed(page or "")
        parser.close()
        want = " ".join("".join(parser.parts).split())
        assert (got[page_id]["text"], got[page_id]["url"], got[page_id]["n_chars"]) == (want, url, len(want))


def test_boilerplate_of_many_kinds_goes():
    page = (
        "<html><head><title>T</title><style>p{}</style><script>if (a<b) x('</p>')</script></head><body class='home page'>"
        "<!-- <article>no</article> --><header class=site><h1>My site of fine things for all of you</h1></header>"
        "<nav><ul><li><a href='/x>y'>A very long menu entry with a lot of words in it</a></li></ul></nav>"
        "<div class='cookie-banner'>We use cookies on this site, more than we could ever tell you in words.</div>"
        "<main><article class=post><header><h2>Title</h2></header><p>One &amp; two&nbsp;&#10; three &lt;b&gt;.</p>Loose"
        "<p>Fo<b>u</b>r <i>five</i><br>six<p>Seven &notin; eight"
        "<div class='ad-slot'>Buy this now, it is the best thing that money can buy in this world.</div>"
        "<form><p>Your mail</p><input value=x><textarea>t</textarea></form><noscript>Turn it on</noscript>"
        "<ul><li>Nine<li>Ten</ul><table><tr><td>Eleven<td>Twelve</table></article>"
        "<section id=comments><p>First! This is the longest comment anybody has ever written here.</p></section></main>"
        "<aside><p>Somebody wrote this site for you, with a lot of care and time, in the winter.</p></aside>"
        "<footer><p>Contact us by mail at any time of the day, we read what you write.</p></footer></body></html>"
    )
    (text,) = html_extract.main_texts([page], html_extract.block_classifier())
    assert text == "Title One & two three <b>. Loose Four five six Seven ∉ eight Nine Ten Eleven Twelve"


def test_main_text_under_containers_with_boilerplate_names():
    words = "The old harbour was rebuilt after the war with stone from the quarry behind the town and {} ships came back to it."
    text = [words.format(n) for n in ("many", "a few", "no", "only small", "the large")]
    body = "".join(f"<p>{t}</p>" for t in text)
    for name in ("content-with-sidebar", "elementor-widget", "main has-ads", "page social-layout"):
        page = (
            f"<body><nav><a href=/>Home</a></nav><div class='{name}'><article>{body}</article></div>"
            "<div class=related><article><p>Another harbour, and what became of its ships in the end.</p></article></div>"
            "<footer><p>Contact us by mail at any time of the day.</p></footer></body>"
        )
        assert html_extract.main_texts([page], html_extract.block_classifier()) == [" ".join(text)], name
    parts = "".join(f"<div class=elementor-widget><article><p>{t}</p><p>{t}</p></article></div>" for t in text)
    page = f"<body><nav><a href=/>Home</a></nav>{parts}<aside><p>Read more of this in our letter.</p></aside></body>"
    assert html_extract.main_texts([page], html_extract.block_classifier()) == [" ".join(t for t in text for _ in range(2))]
    long = " ".join(text[:2])
    page = f"<body><article>{body}</article><section id=comments><p>{long}</p></section><aside><p>{long}</p></aside></body>"
    assert html_extract.main_texts([page], html_extract.block_classifier()) == [" ".join(text)]
    page = f"<body><div class=elementor-widget>{body}</div><div class=sidebar><p>Read more of this in our letter.</p></div></body>"
    assert html_extract.main_texts([page], html_extract.block_classifier()) == [" ".join(text)]


PARAGRAPHS = (
    "The lake froze early that year and the boys skated to school along the shore.",
    "It was forty years before it froze again.",
    "Whoever wants to see the ice boats now has to go to the museum, where two of them hang from the ceiling of the great hall.",
)
REMARKS = tuple(f"I liked part number {k} the most, and so did everybody in our house who has read it aloud since." for k in range(9))
LEGAL = "Nothing on this page may be taken as advice of any sort, and whoever takes it does so at a risk of their own making. " * 6


@pytest.mark.parametrize("frame", [
    "<body><article>{a}</article><section id=comments>{c}</section></body>",
    "<body><article>{a}</article><div class='reader-replies'>{c}</div></body>",
    "<body><article>{a}<section class=comments>{c}</section></article></body>",
    "<body><article>{a}</article><footer class=disclaimer>{l}</footer></body>",
    "<body><div class=cookie-notice>{l}</div><article>{a}</article></body>",
    "<body><div id=gdprConsent><p>{l}</p><p>{l}</p></div><main>{a}</main><div role=contentinfo>{l}</div></body>",
    "<body><article>{a}</article><div>{c}</div></body>",
    "<body><div class=cookie-notice>{l}</div>{a}<footer>{l}</footer></body>",
    "<body><div class=textwidget>{a}</div><ol class=commentlist>{c}</ol></body>",
    "<body><form id=page><nav><a href=/>Home</a></nav><article>{a}</article><aside>{c}</aside></form></body>",
])
def test_boilerplate_with_most_of_the_words_goes(frame):
    """Pages that are not in the labelled table, nor any of their texts."""
    page = frame.format(a="".join(f"<p>{t}</p>" for t in PARAGRAPHS), c="".join(f"<div class=comment><p>{t}</p></div>" for t in REMARKS), l=LEGAL)
    assert html_extract.main_texts([page], html_extract.block_classifier()) == [" ".join(PARAGRAPHS)]


def test_short_and_linked_blocks_of_an_article_stay():
    page = "<body><p>Start</p><article><h1>Ice</h1><p>Why?</p><p><a href=/x>One line that is a link from end to end</a></p><ul><li>Cold<li>Clear</ul></article></body>"
    assert html_extract.main_texts([page], html_extract.block_classifier()) == ["Ice Why? One line that is a link from end to end Cold Clear"]


def test_labelled_table_is_learnt_and_varied():
    from cadence.llm.html_labels import labelled_pages

    pages = labelled_pages()
    blocks = [b[0] for page, _ in pages for b in html_extract.flat_blocks(page)]
    marks = "".join(m for _, m in pages)
    assert len(blocks) == len(marks) and len({p for p, _ in pages}) == len(pages)
    tree = html_extract.block_classifier()
    rows = np.concatenate([html_extract.block_features(html_extract.flat_blocks(p)) for p, _ in pages])
    hit = (tree.predict(rows) >= 0.5) == (np.array(list(marks)) == "1")
    assert hit.mean() >= 0.98
    # no leaf stands for one or two blocks
    leaf = np.zeros(len(rows), int)
    for _ in range(tree.max_depth):
        inner = tree.feature[leaf] >= 0
        down = rows[np.arange(len(rows)), tree.feature[leaf]] <= tree.cut[leaf]
        leaf = np.where(inner, np.where(down, tree.low[leaf], tree.high[leaf]), leaf)
    assert np.unique(leaf, return_counts=True)[1].min() >= 3


def test_broken_and_empty_pages(spark):
    long = "<article>" + "<p>word &amp; more</p>" * 20_000
    rows = [
        (1, None, None), (1, "u", ""), (2, "u", "<article><p>open"), (3, "u", "<article>a < b <p class='x"), (4, "u", "plain words only"),
        (5, "u", "<article><script>never closed <p>x"), (6, "u", "<article>&amp &am &#x41;&#0;"), (7, None, long), (8, "u", "<<<>>><"),
        (9, "u", "<article>" + "<" * 5000 + "a='" * 5000),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, text string")
    got = html_extract.extract_main_text(df).collect()
    assert len(got) == len(rows)
    text = {r["page_id"]: r["text"] for r in got if r["page_id"] != 1}
    assert [r["text"] for r in got if r["page_id"] == 1] == ["", ""]
    assert text[2] == "open" and text[3] == "a < b" and text[5] == "" and text[6] == html.unescape("& &am A&#0;")
    assert text[7] == " ".join(["word & more"] * 20_000)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    none = spark.createDataFrame([], df.schema)
    assert html_extract.extract_main_text(none).count() == 0


def test_tree_separates_what_can_be_separated():
    rng = np.random.default_rng(1)
    x = rng.random((200, 4))
    y = ((x[:, 1] > 0.5) ^ (x[:, 3] > 0.5)).astype(int)
    tree = DecisionTree(max_depth=8).fit(x, y)
    assert ((tree.predict(x) >= 0.5) == y).all()
    z = rng.random((500, 4))
    assert ((tree.predict(z) >= 0.5) == ((z[:, 1] > 0.5) ^ (z[:, 3] > 0.5))).mean() > 0.9
    same = DecisionTree().fit(np.ones((3, 2)), np.array([0, 1, 1]))
    assert same.predict(np.ones((1, 2)))[0] == pytest.approx(2 / 3)


# ----------------------------------------------------------- personal data
PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain_spans(text):
    out = []
    for k, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            doubled = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1]))
            fine = (
                True,
                k == 1 and all(int(p) <= 255 for p in m[0].split(".")),
                16 <= len(digits) <= 19 and doubled % 10 == 0,
                8 <= len(digits) <= 15,
            )[k]
            if fine:
                out.append((k, m.start(), m.end()))
    return out


def digest(spans):
    return hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def test_base_spans_match_the_plain_patterns():
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice("a@@.1 2+-(é9_") for _ in range(rng.randint(0, 45)))
        assert pii.base_spans(text) == plain_spans(text), text
    for text in ("1" * 60_000, "a" * 60_000, "+1" + "(" * 60_000, "1." * 30_000, "@" * 60_000, "a@" * 30_000, "1 a@b " * 9_000):
        assert len(pii.base_spans(text)) >= 0  # linear: returns at once
        list(pii._unseen(text, pii.base_spans(text)))


def test_documents_match_the_plain_patterns(spark, edge_docs, no_docs):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), edge_docs):
        got = pii.find_personal_data(docs).collect()
        want = sorted((i, digest(plain_spans(t or ""))) for i, t in texts_of(docs) if i is not None)
        assert sorted((r["doc_id"], r["base_sha256"]) for r in got if r["doc_id"] is not None) == want
        assert len(got) == docs.count()
    assert pii.find_personal_data(no_docs).count() == 0


def test_contexts_of_seeds_discover_unseen_identifiers(spark):
    rows = [(i, f"some text, please write to {n}@site{i}.com at once", 0) for i, n in enumerate("ann bob cat dan eve fay gus hal ida".split())]
    rows += [
        (50, "do please write to zed@localhost at once", 1),  # known context
        (51, "the house was built in 18431 by zed@localhost himself", 0),  # no known context beside it
        (52, "room 10234 was empty, room 10235 was not", 0),
        (53, "please write to zed@localhost, and please write to zed@localhost again", 2),
    ]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in pii.find_personal_data(df).collect()}
    for i, text, n in rows:
        assert got[i]["n_discovered"] == n, text
        base = [f"email:{s}:{e}" for _, s, e in plain_spans(text)]
        new = [f"email:{m.start()}:{m.end()}" for m in re.finditer("zed@localhost", text)][:n]
        assert got[i]["spans"] == ",".join(base + new)
        assert got[i]["n_email"] == len(base)


def plain_rounds(links, rounds, support, prior, confident, unlabelled):
    """Scores of the pattern-instance graph by plain sums."""
    kind, ends = {}, {}
    for word, k, pattern in links:
        ends.setdefault(pattern, set()).add(word)
        key = (pattern, word)
        kind[key] = max(x for x in (kind.get(key), k, -1) if x is not None)
    unseen = {w for (p, w), k in kind.items() if k < 0}
    patterns, scores = {}, {}
    for _ in range(rounds):
        found = {}
        for p, words in ends.items():
            own = [(w, kind[p, w]) for w in words]
            best = {w: max((s for (x, _), s in scores.items() if x == w), default=0.0) for w, k in own if k < 0}
            n = sum(k >= 0 for _, k in own) + sum(s + unlabelled * (1 - s) for s in best.values())
            for k in range(4):
                mass = sum(x == k for _, x in own) + sum(scores.get((w, k), 0.0) for w in best)
                if mass >= support and mass / (n + prior) >= confident:
                    found[p, k] = mass / (n + prior)
        patterns, scores = found, {}
        for w in unseen:
            for k in range(4):
                sure = [c for (p, x), c in patterns.items() if x == k and kind.get((p, w), 0) < 0]
                if sure:
                    scores[w, k] = 1 - np.prod([max(1 - c, 1e-9) for c in sure])
    return patterns, scores


@pytest.mark.parametrize("unlabelled", [0.25, 1.0])
def test_rounds_of_the_graph_against_plain_sums(spark, unlabelled):
    rng = random.Random(8)
    links = []
    for p in range(40):
        for _ in range(rng.randrange(1, 25)):
            w = rng.randrange(200)
            links.append((f"w{w}", w % 4 if w % 3 else None, f"p{p % 30}"))
    df = spark.createDataFrame(links, "word string, kind int, pattern string")
    args = (3, 1.5, 1.0, 0.35, unlabelled)
    patterns, scores = pii.score_graph(df, *args)
    want_patterns, want_scores = plain_rounds(links, *args)
    assert {(r["pattern"], r["kind"]): r["confidence"] for r in patterns.collect()} == pytest.approx(want_patterns)
    assert {(r["word"], r["kind"]): r["score"] for r in scores.collect()} == pytest.approx(want_scores)
    assert want_patterns and want_scores


def test_a_context_with_many_unseen_identifiers(spark):
    rows = [(i, f"badge holder u{i}@x.org entered") for i in range(600)] + [(1000 + i, f"badge holder u{i}@desk entered") for i in range(400)]
    rows += [(5000 + i, f"in the year {10_000 + i} the {20_000 + i} came") for i in range(40)]
    got = pii.find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sum(r["n_discovered"] for r in got if 1000 <= r["doc_id"] < 5000) == 400
    assert sum(r["n_discovered"] for r in got if r["doc_id"] < 1000 or r["doc_id"] >= 5000) == 0


def test_unseen_identifiers_in_unspaced_records_and_with_blanks():
    def runs(text):
        return [text[s:e] for s, e in pii._unseen(text, pii.base_spans(text))]

    assert runs("mail=a@b.com;id=123-45-6789") == ["123-45-6789"]
    assert runs('{"mail":"a@b.com","ssn":"123-45-6789","card":"4111 1111 1111 1112"}') == ["123-45-6789", "4111 1111 1111 1112"]
    assert runs("call 555 123 4567 or (555) 123-4568.") == ["555 123 4567", "(555) 123-4568"]
    assert runs("1234567,a@b.com,7654321") == ["1234567", "7654321"]
    assert runs("电话5551234567，身份证号110101199001011237。") == ["5551234567", "110101199001011237"]
    assert runs("https://x.org/?user=me@host&key=" + "a1b2" * 40) == ["me@host", "a1b2" * 40]
    assert runs("mac 00:1A:2B:3C:4D:5E at 12/31/1999") == ["00:1A:2B:3C:4D:5E", "12/31/1999"]
    assert runs("no digits 12 3x 4") == [] and runs("") == []
    text = '{"mail":"a@b.com","ssn=123-45-6789"}'
    at = text.index("123")
    assert "1 ssn" in pii._contexts(text, at, at + 11)
    assert "2 电 话" in pii._contexts("请打电话5551234567", 4, 14)


def test_records_without_blanks_discover_identifiers(spark):
    rows = [(i, f"name=n{i};phone=+1 555 010 {1000 + i};mail=u{i}@x.org") for i in range(40)]
    rows += [(100, "name=x;mail=z@x.org;phone=555 123 4567;end")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in pii.find_personal_data(df).collect()}
    start = rows[-1][1].index("555")
    assert got[100]["n_discovered"] == 1 and f"phone:{start}:{start + 12}" in got[100]["spans"]



# ----------------------------------------------------------------- quality
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = labels.filter("doc_id % 2 = 0")
    scores = quality.quality_scores(docs, labels.filter("doc_id % 2 = 1")).join(held, "doc_id").collect()
    good = [r for r in scores if r["quality"] == 1]
    bad = [r for r in scores if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.98 * len(good) and sum(r["kept"] for r in bad) <= 0.1 * len(bad)


def moment_weight(sites, parent):
    """Documents that the parent's rate is worth: plain sums over (good, n)."""
    some = [(g / n, n, parent(k)) for k, (g, n) in sites.items() if n > 1]
    n = sum(m for _, m, _ in some)
    mass = sum(m * p * (1 - p) for _, m, p in some)
    if not some or not mass:
        return quality.LARGEST_WEIGHT
    beyond = (sum(m * (r - p) ** 2 for r, m, p in some) - sum(p * (1 - p) for _, _, p in some)) / n
    return quality.LARGEST_WEIGHT if beyond <= 0 else min(quality.LARGEST_WEIGHT, max(1.0, mass / n / beyond - 1))


def test_rates_and_posteriors_against_plain_sums(spark):
    """Hosts shrink toward all, paths toward their host, each row left out of its own path."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scores = {r["doc_id"]: r for r in quality.quality_scores(docs, labels).collect()}
    rows = [(r["doc_id"], r["source"], r["lang"], scores[r["doc_id"]]["p_document"]) for r in docs.collect()]
    hosts, paths = {}, {}
    for _, host, lang, p in rows:
        for table, key in ((hosts, host), (paths, (host, lang))):
            good, n = table.get(key, (0.0, 0))
            table[key] = (good + p, n + 1)
    overall = sum(g for g, _ in hosts.values()) / len(rows)
    host_weight = moment_weight(hosts, lambda k: overall)
    rate = lambda good, n, parent, weight: (good + parent * weight) / (n + weight)
    host_rate = {h: rate(g, n, overall, host_weight) for h, (g, n) in hosts.items()}
    path_weight = moment_weight(paths, lambda k: host_rate[k[0]])
    odds = lambda p: np.log(p / (1 - p))
    for i, host, lang, p in rows:
        others_host = rate(hosts[host][0] - p, hosts[host][1] - 1, overall, host_weight)
        others_path = rate(paths[host, lang][0] - p, paths[host, lang][1] - 1, others_host, path_weight)
        clip = lambda x: min(1 - 1e-6, max(1e-6, x))
        posterior = 1 / (1 + np.exp(-(odds(clip(p)) + odds(clip(others_path)) - odds(overall))))
        got = scores[i]
        assert (got["host_rate"], got["path_rate"], got["p_good"]) == pytest.approx((host_rate[host], others_path, posterior), rel=1e-6)
        assert got["kept"] == (got["p_good"] >= 0.5)
    assert len({round(r, 6) for r in host_rate.values()}) > 1


def test_conflicting_labels_count_as_bad(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " * (1 + i % 5), "en", "a") for i in range(40)], "doc_id bigint, text string, lang string, source string")
    sure = [(i, int(i % 5 > 2)) for i in range(40)]
    both = spark.createDataFrame(sure + [(i, 1) for i in range(20)] + [(i, 0) for i in range(20)], "doc_id bigint, quality int")
    least = spark.createDataFrame([(i, 0 if i < 20 else y) for i, y in sure], "doc_id bigint, quality int")
    a, b = (sorted(map(tuple, quality.quality_scores(docs, x).collect())) for x in (both, least))
    assert a == b


def test_the_word_table_is_bounded_and_forgotten():
    table = packing.WordTokenizer(TOKENIZER, table_bytes=20_000)
    texts = pa.array([" ".join(f"w{i}x{j}" for j in range(40)) for i in range(40)] + ["q" * 50_000])
    ids, borders = table.texts(texts)
    assert [ids[a:b].tolist() + [1] for a, b in zip(borders[:-1], borders[1:])] == [token_ids(t) for t in texts.to_pylist()]
    assert table.held <= 10_000 and len(table.young) + len(table.old) < 100
    docs = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words", None])], ["id", "text"])
    packing.worker_tokenizer.cache_clear()
    assert sum(b.num_rows for b in packing._pieces(TOKENIZER, 2048, 1, False)(iter([docs]))) == 2
    kept = packing.worker_tokenizer(TOKENIZER)
    assert not kept.young and not kept.old and not kept.held


def test_the_words_kept_between_tasks_are_bounded_and_change_nothing():
    table = packing.WordTokenizer(TOKENIZER, table_bytes=30_000)
    first = pa.array([" ".join(f"w{i}x{j}" for j in range(20)) for i in range(40)])
    for texts in (first, pa.array(["w0x0 w39x19 other", "", "w1x1, w2x2"]), first):
        ids, borders = table.texts(texts)
        assert [ids[a:b].tolist() + [1] for a, b in zip(borders[:-1], borders[1:])] == [token_ids(t) for t in texts.to_pylist()]
        before = dict(table.kept)
        table.forget()
        assert table.kept == before and not table.young
    size = sum(packing.ENTRY_BYTES + len(w) + len(x) for w, x in table.kept.items())
    assert 0 < size <= 10_000 and size + table.room == 10_000


def test_the_logistic_fit_separates():
    x = np.array([[0.0], [0.1], [0.9], [1.0]] * 5)
    w, mean, scale = quality.fit_logistic(x, (x[:, 0] > 0.5).astype(float))
    p = 1 / (1 + np.exp(-((quality._widened(x) - mean) / scale) @ w))
    assert ((p > 0.5) == (x[:, 0] > 0.5)).all()


def test_a_bad_host_weighs_on_its_documents(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows, labels = [], []
    for i in range(600):
        host = "good" if i % 2 else "bad"
        junk = rng.random() < (0.05 if host == "good" else 0.9)
        text = " ".join(word() + ("%%%" if junk else "") for _ in range(40))
        rows.append((i, text, "en", host))
        labels.append((i, int(not junk)))
    unsure = " ".join(word() + ("%%%" if k % 4 == 0 else "") for k in range(40))
    rows += [(9001, unsure, "en", "good"), (9002, unsure, "en", "bad"), (9003, unsure, "en", "new")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality.quality_scores(docs, spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()}
    assert got[9001]["p_document"] == got[9002]["p_document"] == got[9003]["p_document"]
    assert got[9001]["p_good"] > got[9003]["p_good"] > got[9002]["p_good"]
    assert got[9001]["path_rate"] > 0.85 and got[9002]["path_rate"] < 0.2 and 0.35 < got[9003]["path_rate"] < 0.7


def test_quality_on_edge_rows(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (4, 0), (6, 1), (5, 0), (6, None), (None, 1)], "doc_id bigint, quality int")
    assert quality.quality_scores(edge_docs, labels).count() == edge_docs.count()
    kept = quality.keep_good(edge_docs, labels)
    assert kept.columns == edge_docs.columns and kept.count() <= edge_docs.count()
    none = labels.limit(0)
    assert quality.keep_good(edge_docs, none).count() == edge_docs.count()
    assert quality.keep_good(no_docs, labels).count() == 0


# ----------------------------------------------------------------- packing
def token_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER).encode(text or "", add_special_tokens=False).ids + [1]


def check_packing(rows, texts, capacity):
    """Every id in exactly one piece; sequences gapless and within capacity."""
    seen = {}
    for r in rows:
        seen.setdefault(r["doc_id"], []).append(r)
    for doc_id, text in texts:
        ids = token_ids(text)
        pieces = sorted(seen[doc_id], key=lambda r: r["start"])
        copies = sum(t == text for i, t in texts if i == doc_id)
        at = 0
        for r in pieces[::copies]:
            part = np.array(ids[at : at + r["length"]], "<u4")
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(part.tobytes()))
            at += r["length"]
        assert at == len(ids)
    fill = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values(), default=0) <= capacity
    return fill


def test_packing_of_the_driver_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack(docs, TOKENIZER, pieces_per_group=60).collect()
    fill = check_packing(rows, texts_of(docs), 2048)
    assert 1 - sum(fill.values()) / (2048 * len(fill)) < 0.06
    assert len({r["sequence_id"] >> 32 for r in rows}) >= 3


def test_packing_on_edge_rows(edge_docs, no_docs):
    docs = edge_docs.filter("doc_id IS NOT NULL")
    rows = packing.pack(docs, TOKENIZER, capacity=64, with_ids=True).collect()
    check_packing(rows, texts_of(docs), 64)
    assert all(len(r["ids"]) == r["length"] for r in rows)
    assert packing.pack(edge_docs, TOKENIZER).filter("doc_id IS NULL").count() == 2
    assert packing.pack(no_docs, TOKENIZER).count() == 0


def test_words_of_any_text_give_the_tokenizer_ids():
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(TOKENIZER), packing.WordTokenizer(TOKENIZER, 50)
    rng = random.Random(4)
    alphabet = "aAbzZ éÉÀ×÷ßİσΣς'\"!.,-_<|>endoftext 0129٣²́̇   \u0085\x1c\x1f\x0b\x00ﬁ漢字😀 \t\n's't're"
    for _ in range(400):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(8)]
        texts += ["<|endoftext|>", "x<|ENDOFTEXT|>, y", "a<|startoftext|>.b"][: rng.randint(0, 3)]
        ids, at = own.texts(pa.array(["skip", *texts], pa.string()).slice(1))
        for i, text in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_first_fit_decreasing_against_the_plain_search():
    rng = random.Random(5)
    for _ in range(200):
        lengths = [rng.randint(1, 100) for _ in range(rng.randint(0, 40))]
        where, offset = packing.first_fit_decreasing(lengths, 100)
        free, want = [], {}
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            b = next((b for b, f in enumerate(free) if f >= lengths[i]), len(free))
            if b == len(free):
                free.append(100)
            want[i] = (b, 100 - free[b])
            free[b] -= lengths[i]
        assert [want[i] for i in range(len(lengths))] == list(zip(where, offset))
