"""Chat formatting, near-dedup, mixing, HTML, URL filters and the pipeline against brute force."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from quadrille.llm import chat, html_extract, html_training, mixing, simhash, url_filter
from quadrille.llm.html_weights import WEIGHTS

# Chat


def test_escaping_is_reversible():
    r = random.Random(1)
    for _ in range(500):
        text = "".join(r.choice(["\\", "#", "###", "### user:\n", "</turn>", "</", "<", "a", ":", "\n"]) for _ in range(r.randint(0, 12)))
        turns = [("user", text), (text, "x"), ("assistant", text)]
        formatted = "".join(chat.format_turn(*t)[0] for t in turns)
        assert chat.parse_turns(formatted) == turns


TURNS = [
    (1, 0, "system", "be brief"),
    (1, 1, "user", "hi"),
    (1, 2, "assistant", "hello </turn>\n### user:\n"),
    (1, 3, "user", "more"),
    (1, 4, "assistant", "\\"),
    (1, 5, "user", "thanks"),
    (2, 0, "user", None),
    (2, 1, None, "no role"),
    (3, 0, "assistant", ""),
    (3, 0, "assistant", ""),
    (None, 0, "user", "null id"),
    (None, None, "assistant", "null turn goes first"),
    (4, 0, "user", "x" * 3000),
    *[(4, k, "user" if k % 2 else "assistant", f"turn {k} " * 50) for k in range(1, 30)],
]


def by_conversation():
    found = {}
    for conv, turn, role, text in sorted(TURNS, key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        found.setdefault(conv, []).append((role or "", text or ""))
    return found


@pytest.mark.parametrize("inline_chars", [1 << 20, 700, None])
def test_prefix_examples(spark, inline_chars):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("parent", F.lit("clash"))
    examples = chat.prefix_examples(turns, inline_chars)
    rows = {}
    for x in examples.collect():
        rows.setdefault(x["conv_id"], []).append(x)
    described = {x["conv_id"]: x for x in chat.describe_examples(examples).collect()}
    for conv, expected in by_conversation().items():
        mine = sorted(rows[conv], key=lambda x: x["example_no"])

        def whole(x, mine=mine):
            return ("" if x["parent"] is None else whole(mine[x["parent"]])) + x["text"]

        replies = [x for x in mine if x["loss_start"] is not None]
        at = [k for k, (role, _) in enumerate(expected) if role == "assistant"]
        assert len(replies) == len(at)
        for x, k in zip(replies, at, strict=True):
            assert chat.parse_turns(whole(x)) == expected[: k + 1]  # all turns before, and the reply
            assert chat.unescape(x["text"][x["loss_start"] : x["loss_end"]]) == expected[k][1]
            assert inline_chars is None or len(x["text"]) <= inline_chars + 2 * max(len(chat.format_turn(*t)[0]) for t in expected)
        assert chat.parse_turns(whole(mine[-1])) == expected
        assert inline_chars or all(x["parent"] is None for x in mine)
        said = "".join(t for r, t in expected if r == "assistant")
        d = described[conv]
        assert d["n_turns"] == len(expected)
        assert d["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in expected).encode()).hexdigest()
        assert (d["loss_chars"], d["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert d["formatted_chars"] == sum(len(chat.format_turn(*t)[0]) for t in expected)
    assert chat.prefix_examples(turns.limit(0)).count() == 0


# SimHash


def slow_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(b"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    r = random.Random(2)
    texts = [None, "", " \n", "A", "a b", "a b c", "É É é x", "\x85 \x1c y z", *[" ".join(r.choice("abcd") for _ in range(r.randint(0, 40))) for _ in range(100)]]
    for text in texts:
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def brute_components(rows):
    fps = sorted({f for _, f in rows})
    above = {f: f for f in fps}

    def find(x):
        while above[x] != x:
            x = above[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                above[find(a)] = find(b)
    least = {}
    for key, f in rows:
        if key is not None:
            least[find(f)] = min(least.get(find(f), key), key)
    return {(key, f, least.get(find(f))) for key, f in rows}


@pytest.mark.parametrize("hot", [1024, 3])
def test_components(spark, hot):
    r = random.Random(3)
    prints = [0]
    for base in [r.getrandbits(64) for _ in range(4)]:
        x = base
        for _ in range(40):
            y = x if r.random() < 0.5 else base  # chains and clusters
            for _ in range(r.randint(0, 4)):
                y ^= 1 << r.randrange(64)
            prints.append(y)
            x = y
    rows = [(None if k % 50 == 7 else k, simhash.signed(f)) for k, f in enumerate(prints)] + [(5, simhash.signed(prints[5])), (5, simhash.signed(prints[5]))]
    table = simhash.checkpointed(spark.createDataFrame(rows, "doc_id long, fp long"))
    got = [tuple(x) for x in simhash.with_components(table, hot).select("doc_id", "fp", "component_id").collect()]
    assert len(got) == len(rows)
    assert set(got) == brute_components(rows)


@pytest.mark.parametrize("hot", [1024, 3])
def test_variants_are_shuffled_for_hot_ones_only_where_there_are_some(spark, hot):
    """Each Repartition is a use of all variants: two sides of one join, and another for hot ones."""
    prints = (0, 1, 3, 7, 99, 1 << 40)
    found = simhash.links(simhash.checkpointed(spark.createDataFrame([(f,) for f in prints], "fp long")), hot)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Repartition ") == 2 + (hot == 3)
    got, linked = {tuple(x) for x in found.collect()}, {(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2}
    assert got <= linked if hot == 3 else got == linked


def test_keep_one(spark):
    rows = [(1, "a b c d", 7), (2, "A b  c d", 8), (None, "x y z w q", 1), (None, "x y z w q", 2), (None, "k l m n o p", 2), (5, None, 1), (5, None, 1), (6, "", 1), (9, "quite another text here", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, stays int")
    docs = docs.withColumnRenamed("stays", "fp")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter((x["doc_id"], x["text"]) for x in kept.collect()) == Counter([(1, "a b c d"), (None, "x y z w q"), (None, "k l m n o p"), (5, None), (9, "quite another text here")])
    assert simhash.keep_one(docs.limit(0)).count() == 0


# Mixing


def slow_targets(sizes, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    left, share, target = set(order), 1.5 * sum(sizes.values()), {}
    while True:
        total = sum(weight[s] for s in left)
        over = {s for s in left if share * weight[s] / total > 2 * sizes[s]}
        if not over:
            return target | {s: share * weight[s] / total if total else 0.0 for s in left}
        for s in over:
            target[s] = 2.0 * sizes[s]
            share -= target[s]
        left -= over


def mixing_rows():
    r = random.Random(4)
    rows = [(k, " ".join("w" for _ in range(r.randint(0, 60))), "".join(r.choice(["big", "big", "big", "a", "z", "é"]))) for k in range(500)]
    return rows + [(7, "w w", "big"), (7, "w w", "big"), (None, "null id", "a"), (501, None, "a"), (502, "", None), (503, "null source w", None), (504, " ", "empty")]


def test_mix(spark):
    rows = mixing_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("copies", F.lit(0))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    targets = slow_targets(sizes)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got = mixed.collect()
    taken, most = Counter(), Counter()
    for x in got:
        taken[x["source"]] += size(x["text"])
        most[x["doc_id"], x["text"], x["source"]] += 1
    longest = {s: max(size(t) for _, t, z in rows if z == s) for s in sizes}
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= longest[s] / 2 + 1e-6
    present = Counter((k, t, s) for k, t, s in rows)
    assert all(n <= 2 * present[key] for key, n in most.items())
    again = Counter((x["doc_id"], x["text"], x["source"]) for x in mixing.mix(docs.repartition(7)).collect())
    assert again == most
    assert mixing.mix(docs.limit(0)).count() == 0


def test_targets(spark):
    r = random.Random(5)
    for _ in range(3):
        rows = [(r.choice("abcdefg"), r.choice([0, 1, 5, 100, 3000])) for _ in range(12)] + [(None, 5)]
        sizes = Counter()
        for s, n in rows:
            sizes[s] += n
        got = {x["source"]: x["target"] for x in mixing.source_targets(spark.createDataFrame(rows, "source string, size long"), [3, 1, 2], 1.5, 2).collect()}
        assert got == pytest.approx(slow_targets(sizes))


def slow_copies(rows, target):
    """Copies of one source's (id, size) rows by the definition: expected copies by length class, whole ones, then Pareto ranks."""
    def u(key):
        return (int(hashlib.md5(str(key).encode()).hexdigest()[:13], 16) + 0.5) / 2**52

    low, high = 0.0, 1e9
    for _ in range(200):  # the level by bisection
        level = (low + high) / 2
        if sum(min(2, level * max(1, n.bit_length())) * n for _, n in rows) < target:
            low = level
        else:
            high = level
    expected = {x: min(2, high * max(1, x[1].bit_length())) for x in rows}
    got = {x: math.floor(e + 1e-9) for x, e in expected.items()}
    rest = target - sum(c * x[1] for x, c in got.items())
    p = {x: e - got[x] for x, e in expected.items()}
    order = sorted((u(x[0]) / (1 - u(x[0])) / (p[x] / (1 - p[x])), *x) for x in rows if p[x] > 1e-9)
    done = 0
    for _, key, n in order:
        got[key, n] += done + n / 2 <= rest
        done += n
    return got, p


@pytest.mark.parametrize("epochs", [0.3, 0.8, 1.5, 1.95])
def test_copies_are_those_of_the_definition(spark, epochs):
    r = random.Random(9)
    rows = [(k, r.choice([0, 1, 3, 20, 50, 200, 1000])) for k in range(600)]
    table = spark.createDataFrame([(k, "s", n) for k, n in rows], "id long, source string, size long").withColumn("u", mixing.uniform(F.col("id")))
    got = {(x["id"], x["size"]): x["copies"] for x in mixing.copies(mixing.checkpointed(table), epochs=epochs).collect()}
    expected, _ = slow_copies(rows, epochs * sum(n for _, n in rows))
    assert got == expected
    assert abs(sum(c * n for (_, n), c in got.items()) - epochs * sum(n for _, n in rows)) <= 500


def test_inclusion_follows_the_probabilities(spark):
    """Longer documents have the higher inclusion probability, and are included in proportion to it."""
    rows = [(k, 1 if k % 2 else 255) for k in range(20_000)]
    table = spark.createDataFrame([(k, "s", n) for k, n in rows], "id long, source string, size long").withColumn("u", mixing.uniform(F.col("id")))
    got = {x["id"]: x["copies"] for x in mixing.copies(mixing.checkpointed(table), epochs=0.4).collect()}
    _, p = slow_copies(rows, 0.4 * sum(n for _, n in rows))
    for n in (1, 255):
        mine = [got[k] for k, size in rows if size == n]
        assert abs(sum(mine) / len(mine) - p[int(n == 1), n]) < 0.02
    assert p[0, 255] > 4 * p[1, 1]


def test_a_cut_among_rows_of_one_id(spark):
    """A third of the rows share id and size: as many of them are taken as the target asks for."""
    rows = [(None, "w w", "s")] * 300 + [(k, "w w", "s") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for epochs in (0.2, 0.5, 0.9, 1.3):
        assert abs(mixing.mix(docs, (1,), epochs).count() - 900 * epochs) <= 1


# HTML

PAGES = {
    "<article><h1>Title here</h1><p>First&nbsp;paragraph with <b>bold</b>face text &amp; more.</p><p>Second one.</p></article>": "Title here First paragraph with boldface text & more. Second one.",
    """<html><head><title>no</title></head><body><header><a href=/>Site</a><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav></header>
    <div id=cookie-banner><p>We use cookies to improve this site for all of you.</p></div>
    <main><article><h1>The real title</h1><p>Body text that goes on for some time, with commas.<p>An unclosed paragraph.
    <div class="ad">Buy things now, they are very cheap today.</div><ul><li>point one of the list<li>point two of it</ul></article>
    <section id="comments"><h2>Comments</h2><div class="comment"><p>I liked this text very much, thank you for it.</p></div></section></main>
    <aside class="sidebar"><h3>Related</h3><p>Another story that you may want to read.</p></aside>
    <form action=/s><label>Search</label><input><button>Go</button></form><footer><p>&copy; 2024 Site. All rights.</p></footer>""": "The real title Body text that goes on for some time, with commas. An unclosed paragraph. point one of the list point two of it",
    '<nav><a href="/x">x</a></nav><article><p>A &lt;b&gt; c &#233;&#x4e2d;</p><script>var x = "<p>no</p>";</script><style>p{}</style><!-- <p>no</p> --></article>': "A <b> c é中",
    "<nav><ul><li><a href=1>one</a></li></ul></nav><footer>only this</footer>": "",
    "": "",
    None: "",
    "a < b": "a < b",
}


def test_extraction():
    for html, text in PAGES.items():
        assert html_extract.extract(html) == text


def test_broken_markup_does_not_fail():
    r = random.Random(6)
    pieces = ["<p>", "</p>", "<article>", "</article>", "<div class='ad", "'>", "<!--", "-->", "<b>", "text ", "&amp;", "<script>", "</script", "<li>", "</ul>", "<td>", '"', "<a href=x>", "é"]
    for _ in range(1000):
        html_extract.extract("".join(r.choice(pieces) for _ in range(r.randint(0, 30))))
    html_extract.extract("<div>" * 3000 + "deep" + "<" * 3000)


LONG = ["<div>", "<button>", "<a ", "<button ", "<b>", "<svg", "<!", "<!--", "<a x=\"", "'\"<a x=", "<script", "</script", "<head>", "</b>", "<b><p></b>", "<h1><a href='x>", "<article>", "<ul><li>", "<svg><svg>x</svg>", " ", "&"]


@pytest.mark.parametrize("tail", ["", ">"])
@pytest.mark.parametrize("what", LONG)
def test_reading_takes_time_in_proportion(what, tail):
    took = []
    for size in (50_000, 400_000):
        page = "<article><p>" + what * (size // len(what)) + tail
        began = time.process_time()
        html_extract.extract(page)
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0] + 0.1  # eight times as long; quadratic would be 64


ARTICLE = "<h1>The title of it</h1><p>Some long text, that goes on for a while, and ends here. Another sentence that is long enough.</p><p>And more of the text follows here.</p>"


@pytest.mark.parametrize("attribute", ['aria-hidden="false"', 'data-state="not hidden yet"', 'data-id="footer"', 'data-role="menu"', 'data-style="display:none"', 'title="a > b"', "title='class=\"footer\"'"])
def test_attributes_are_read_by_their_own_names(attribute):
    page = f"<body><nav><a href=x>n</a></nav><div {attribute}>{ARTICLE}</div><footer>x y z</footer>"
    assert html_extract.extract(page).startswith("The title of it Some long text") and html_extract.extract(page).endswith("follows here.")


@pytest.mark.parametrize("attribute", ["hidden", 'aria-hidden="true"', "style='display: none'", "class=footer", 'ID="cookie-notice"'])
def test_hidden_elements_are_no_content(attribute):
    assert "secret" not in html_extract.extract(f"<article>{ARTICLE}</article><div {attribute}>A secret part, that nobody sees.</div>")


def test_tags_that_nothing_closes_are_text():
    assert html_extract.extract(f"<article>{ARTICLE} if a <b then c").endswith("if a <b then c")
    assert html_extract.extract(f"<article><a title=\"open>{ARTICLE}").endswith("follows here.")


def test_weights_find_blocks_of_other_pages():
    assert html_training.accuracy(WEIGHTS, range(20_000, 20_060)) > 0.99


@pytest.mark.parametrize("half, share", [(0, 0.9), (1, 0.7)])
def test_weights_find_blocks_of_layouts_left_out(half, share):
    """Trained on one half of the layouts, tested on the other. The second half has no plain paragraphs and no article element, so its weights know less."""
    assert html_training.accuracy(html_training.train(pages=100, rounds=50, half=half), range(40_000, 40_100), 1 - half) > share


def test_messages_give_exact_marginals():
    from math import exp, log

    r = random.Random(7)
    for _ in range(20):
        n = r.randint(1, 6)
        parent = [-1, *[r.randrange(k) for k in range(1, n)]]
        odds = [r.uniform(-2, 2) for _ in range(n)]
        edges = [tuple(r.uniform(-2, 2) for _ in range(4)) for _ in range(n)]
        z = [[0.0, 0.0] for _ in range(n)]
        for mask in range(2**n):
            y = [mask >> k & 1 for k in range(n)]
            weight = exp(sum(o * v for o, v in zip(odds, y, strict=True)) + sum(edges[k][2 * y[parent[k]] + y[k]] for k in range(1, n)))
            for k in range(n):
                z[k][y[k]] += weight
        assert html_extract.messages(parent, odds, edges)[0] == pytest.approx([log(b / a) for a, b in z])


def test_training_moves_weights():
    few = html_training.train(pages=20, rounds=25)
    assert html_training.accuracy(few, range(30_000, 30_020)) > 0.9


def test_main_text(spark):
    rows = [(k, f"u{k}", html, "clash") for k, html in enumerate(PAGES)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {x["page_id"]: x for x in html_extract.main_text(pages).collect()}
    for k, text in enumerate(PAGES.values()):
        assert (got[k]["url"], got[k]["text"], got[k]["n_chars"]) == (f"u{k}", text, len(text))
    assert html_extract.main_text(pages.limit(0)).count() == 0


# URL filters

URLS = [None, "", "no scheme.com/", "http://com/", "http://com", "HTTP://A.COM/x?y#z", "http://example.com/en/1", "http://www.example.com/en/1", "http://x.www.example.com/en/", "http://badexample.com/en/", "http://example.com/en", "https://a.net/es/q", "https://net/fr/", "https://a.net/", "://", "a://b://c/d", "http://example.com?/en/", "http://EXAMPLE.com/EN/", "http://É.net/es/"]


def slow_judgement(url, rules):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]) if m else ""
    path = m[2] if m else ""
    fits = [(len(h) + len(p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


def test_url_filter(spark):
    r = random.Random(8)
    urls = URLS + ["http://" + ".".join(r.choice(["a", "b", "com"]) for _ in range(r.randint(1, 4))) + "/" * r.randint(0, 1) + "/".join(r.choice(["x", "xy", "y", ""]) for _ in range(r.randint(0, 3))) for _ in range(300)]
    more = [("block", "b.com", "/x"), ("allow", "a.b.com", "/"), ("block", "com", "/x/y"), ("allow", "b", ""), ("block", "a.a", "/xy/")]
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)] + [(0, None, "")], "page_id long, url string, verdict string")
    for rules in (url_filter.BASE_RULES, url_filter.BASE_RULES + more):
        got = {x["page_id"]: tuple(x)[1:] for x in url_filter.judge_urls(pages, rules).collect()}
        for k, url in enumerate(urls):
            assert got[k] == slow_judgement(url, rules), url
    assert url_filter.judge_urls(pages.limit(0), url_filter.BASE_RULES).count() == 0
    with pytest.raises(ValueError):
        url_filter.compile_rules([("maybe", "a", "/")])
