import itertools
import os
import random
from html.parser import HTMLParser

import numpy as np
import pytest

from foliary.llm import chat_format, html_extract

PAGES = "page_id long, url string, html string, host string, text string"
CHATS = "conv_id long, turn long, role string, text string, number long, block long"


def page(i, url, html):
    return (i, url, html, "clash", "clash")


def extract(spark, rows):
    found = html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    return {r["page_id"]: r["text"] for r in found}


def lcs_length(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for j, y in enumerate(b):
            corner, best[j + 1] = best[j + 1], corner + 1 if x == y else max(best[j + 1], best[j])
    return best[-1]


def test_alignment_is_longest():
    rnd = random.Random(3)
    for _ in range(1500):
        a, b = ([rnd.randrange(5) for _ in range(rnd.randrange(18))] for _ in range(2))
        mine = [x for x, hit in zip(a, html_extract.common_lines(a, b), strict=True) if hit]
        rest = iter(b)
        assert all(x in rest for x in mine) and len(mine) == lcs_length(a, b)
    assert sum(html_extract.common_lines(list(range(3000)), list(range(3000))[::-1])) == 1


def test_marked_furniture_goes_and_blocks_join():
    html = """<html><head><title>t</title><script>var t="</p>";</script><style>p{}</style></head><body class="home">
      <nav><a href="/">Menu</a></nav><!-- ad --><div class="ad">Buy</div><header>Site</header>
      <article><h1>A &amp; B</h1><p><b>One<br>two   three<p>four<i>five</i><aside>side</aside>
      <div class="cookie-notice">cookies</div><section id="comments"><p>me too</p></section></article>
      <form><input value="x>y">Search</form><footer>&copy; site</footer></body></html>"""
    assert html_extract.main_text(html_extract.lines_of(html), None) == "A & B One two three fourfive"


def test_undeclared_furniture_goes_by_differencing(spark):
    def html(body):
        return f"<div>Home | About us</div><div>{body}</div><p>All rights kept by us</p>"

    rows = [page(i, f"http://a.example/news/{i}", html(f"Story {i} told at some length, number {i * 7919}")) for i in range(6)]
    rows += [page(10, "http://b.example/x", html("Alone"))]
    found = extract(spark, rows)
    assert all(found[i] == f"Story {i} told at some length, number {i * 7919}" for i in range(6))
    assert found[10] == "Home | About us Alone All rights kept by us"


def test_cuts_between_ranges_leave_no_trace(spark):
    """Any number of ranges gives what one sorted list of all pages gives."""
    rnd = random.Random(8)
    hosts = ["hot.example"] * 6 + ["a.example", "b.example", None]
    rows = []
    for i in range(400):
        host = rnd.choice(hosts)
        body = "".join(f"<p>{rnd.choice('abcdefgh') * 9}</p>" for _ in range(6))
        url = host and f"http://{host}/{rnd.randrange(4)}/{rnd.randrange(90)}"
        rows.append(page(rnd.choice([i, 7, None]), url, f"<div>Home of {host}</div>{body}<p>own {i}</p>"))
    rows += rows[:20]

    def split(r):
        rest = r[1] and r[1].removeprefix("http://")
        return (*(rest.split("/", 1) if rest else (None, None)), r[0])

    ordered = sorted(rows, key=lambda r: (html_extract.sortable(*split(r)), r[2]))
    lines, wanted = [html_extract.lines_of(r[2]) for r in ordered], []
    for i, r in enumerate(ordered):
        host, path, _ = split(r)
        near = [j for j in (i - 1, i + 1) if 0 <= j < len(ordered) and host and split(ordered[j])[0] == host]
        shared = lambda j: next((k for k, (x, y) in enumerate(zip(path, split(ordered[j])[1])) if x != y), min(len(path), len(split(ordered[j])[1])))
        wanted.append((str(r[0]), html_extract.main_text(lines[i], *[lines[j] for j in sorted(near, key=lambda j: (-shared(j), j))])))
    for ranges in (1, 3, 64):
        found = html_extract.extract(spark.createDataFrame(rows, PAGES), ranges).collect()
        assert sorted((str(r["page_id"]), r["text"]) for r in found) == sorted(wanted)


def test_copies_and_shared_sentences_stay(spark):
    copy = "<article><p>The same article.</p><p>Licensed freely.</p></article>"
    bare = "<p>A page without marks.</p><p>Copied whole.</p>"
    rows = [page(i, f"http://a.example/{i}?utm=1", copy) for i in range(3)] + [page(9 + i, f"http://c.example/{i}", bare) for i in range(2)]
    found = extract(spark, rows)
    assert {found[i] for i in range(3)} == {"The same article. Licensed freely."} and found[9] == found[10] == "A page without marks. Copied whole."


def test_differencing_decides_pages_with_articles(spark):
    """A headline before the article and a body beside a teaser stay; the menu goes, the licence in the article stays."""
    menu, licence = "<div>Home | About us</div>", "<p>Licensed freely.</p>"
    rows = [page(i, f"http://a.example/{i}", f"{menu}<h1>Headline {i}</h1><article><p>Story {i * 7919} at some length.</p>{licence}</article>") for i in range(4)]
    teaser = "<article><p>Read this too.</p></article>"
    rows += [page(10 + i, f"http://b.example/{i}", f"{menu}<div>A body of its own, number {i * 7919}, told at length.</div>{teaser}") for i in range(4)]
    found = extract(spark, rows)
    assert all(found[i] == f"Headline {i} Story {i * 7919} at some length. Licensed freely." for i in range(4))
    assert all(found[10 + i] == f"A body of its own, number {i * 7919}, told at length. Read this too." for i in range(4))


def test_odd_pages(spark):
    long = "<p>" + "word " * 50_000
    rows = [page(1, None, "<p>no url"), page(2, "http://a", None), page(3, "http://a", ""), page(4, "nonsense", "<<<p <b 'x' a<b & c"), page(5, "http://a", long), page(None, None, "<p>twice"), page(None, None, "<p>twice"), page(6, "u", "<i>" * 3000 + "deep"), page(7, "u", "&#128578;&nbsp;&bogus; x")]
    rows += [page(8, "http://a/'", "<a title='never closed>" + "text" * 10)]
    found = html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()
    assert len(found) == len(rows)
    text = {r["page_id"]: r["text"] for r in found}
    assert text[1] == "no url" and text[2] == text[3] == "" and text[5] == " ".join(["word"] * 50_000) and text[6] == "deep" and text[7] == "🙂 &bogus; x"
    assert html_extract.extract(spark.createDataFrame([], PAGES)).collect() == []


@pytest.mark.parametrize("inner, text", [
    ('<p><a href="/posts/hidden">the hidden costs</a></p>', "the hidden costs"), ('<p title="a hidden gem">a gem</p>', "a gem"),
    ('<p data-id="comments">data</p>', "data"), ('<div class="article-header"><h1>Title</h1></div>', "Title"),
    ('<div class="search-results">found</div>', "found"), ("<p><math><mi>x</mi></math> squared</p>", "x squared"),
    ("<p><object data=x>fallback</p><p>after</p>", "fallback after"), ("<video src=v>see <a>it</a></video>", "see it"),
    ("<p>kept</p><div class='comments'>dropped</div>", "kept"), ("<p>kept</p><div class='x share-buttons'>dropped</div>", "kept"),
    ("<p>kept</p><p hidden>dropped</p><p style='display: none'>dropped</p>", "kept"),
])
def test_only_what_is_named_goes(inner, text):
    assert html_extract.main_text(html_extract.lines_of(f"<body><article>{inner}</article></body>"), None) == text


class Plain(HTMLParser):
    """Blocks of simple, well-formed pages: text by block, and whether an article holds it."""

    def __init__(self):
        super().__init__()
        self.blocks, self.open = [], []

    def handle_starttag(self, tag, attrs):
        self.open.append((tag, dict(attrs)))
        self.blocks += [["", self.inside()]] if tag in ("p", "div", "h1", "li", "article", "nav") else []

    def handle_endtag(self, tag):
        self.open.pop()
        self.blocks += [["", self.inside()]] if tag in ("p", "div", "h1", "li", "article", "nav") else []

    def inside(self):
        return any(t == "article" for t, _ in self.open)

    def handle_data(self, data):
        if not any(t == "nav" or a.get("class") == "ad" for t, a in self.open):
            self.blocks[-1][0] += data


def plain_pages(pages):
    """{page_id: text} by quadratic differencing of each page with its nearest neighbour on the host."""
    parsed = {}
    for i, url, html in pages:
        p = Plain()
        p.blocks.append(["", False])
        p.feed(html)
        parsed[i] = (url.split("/")[2], "/" + url.split("/", 3)[3], [(" ".join(t.split()), a) for t, a in p.blocks if t.split()])
    out = {}
    for host in {v[0] for v in parsed.values()}:
        row = sorted((v[1], i) for i, v in parsed.items() if v[0] == host)
        for k, (path, i) in enumerate(row):
            near = [row[j] for j in (k - 1, k + 1) if 0 <= j < len(row)]
            near.sort(key=lambda x: -len(os.path.commonprefix([path, x[0]])))  # the page before if they tie
            mine, other = parsed[i][2], [t for t, _ in parsed[near[0][1]][2]] if near else []
            a = [t for t, _ in mine]
            best = [[0] * (len(other) + 1) for _ in range(len(a) + 1)]
            for x in range(len(a) - 1, -1, -1):
                for y in range(len(other) - 1, -1, -1):
                    best[x][y] = best[x + 1][y + 1] + 1 if a[x] == other[y] else max(best[x + 1][y], best[x][y + 1])
            shared, x, y = [False] * len(a), 0, 0
            while x < len(a) and y < len(other):
                if a[x] == other[y]:
                    shared[x], x, y = True, x + 1, y + 1
                elif best[x + 1][y] >= best[x][y + 1]:
                    x += 1
                else:
                    y += 1
            out[i] = " ".join(t for (t, art), s in zip(mine, shared, strict=True) if art or not s)
    return out


def test_pages_match_brute_force(spark):
    """Unmarked menus and notices that a site repeats go, whatever the neighbour's other lines."""
    rnd, rows = random.Random(12), []
    for i in range(120):
        host = f"h{i % 7}.example"
        body = "".join(f"<p>Body {i} sentence {k} {rnd.getrandbits(40)} and more of it.</p>" for k in range(rnd.randrange(4, 9)))
        menu = "".join(f"<li>{w} of {host}</li>" for w in ("Home", "News", "About") if rnd.random() < 0.8)
        html = f"<body><nav>skip</nav><div>{host} &amp; friends</div>{menu}" + (f"<article>{body}<p>Licensed</p></article>" if i % 3 else f"<div>{body}</div>")
        html += f"<div class='ad'>buy</div><p>Contact {host}</p><h1>End {rnd.randrange(4)}</h1></body>"
        rows.append((i, f"http://{host}/{rnd.choice('abc')}/{rnd.choice('xyz')}{i}", html))
    want = plain_pages(rows)
    found = extract(spark, [page(*r) for r in rows])
    assert found == want
    lost = sum("Contact" not in want[i] for i in want)
    assert lost > 100  # differencing decides nearly every page


def test_a_copy_gives_way_to_the_other_neighbour(spark):
    """The nearest page by path is a copy; the page on its other side tells the menu."""
    menu = "<div>Home of the site</div>"
    body = "<p>A story that two pages tell in the same words, long enough to be one.</p>"
    rows = [page(1, "http://c.example/a/1", f"{menu}<p>Another story altogether, first.</p>"), page(2, "http://c.example/b/1", menu + body), page(3, "http://c.example/b/2", menu + body)]
    found = extract(spark, rows)
    assert found[2] == "A story that two pages tell in the same words, long enough to be one." and found[1] == "Another story altogether, first."
    assert found[3].startswith("Home")  # it has the copy only


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], CHATS)


def test_markers_and_recorded_roles(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "human", "Hi?"), (1, 2, "gpt", "Hello.\nMore."), (2, 0, None, "User: one\nmore\nAssistant: two\nUser: three")]
    found = {(r["conv_id"], r["turn"], r["part"]): (r["role"], r["content"]) for r in chat_format.format_chats(turns(spark, rows)).collect()}
    assert found == {
        (1, 0, 0): ("system", "Be kind."), (1, 1, 0): ("user", "Hi?"), (1, 2, 0): ("assistant", "Hello.\nMore."),
        (2, 0, 0): ("user", "one\nmore"), (2, 0, 1): ("assistant", "two"), (2, 0, 2): ("user", "three"),
    }


def test_plain_lines_stay(spark):
    """Words that begin plain lines are no markers where the speaker is known; no text is lost."""
    text = "  Sure.\nResult: 5 apples\nModel: T-800\n- Answer: yes  "
    rows = [(1, 0, "user", "How many?"), (1, 1, "assistant", text), (2, 0, None, "Q: one\nA: two")]
    found = {(r["conv_id"], r["turn"], r["part"]): (r["role"], r["content"]) for r in chat_format.format_chats(turns(spark, rows)).collect()}
    assert found[1, 1, 0] == ("assistant", text) and (1, 1, 1) not in found
    assert found[2, 0, 0] == ("user", "one") and found[2, 0, 1] == ("assistant", "two")


def test_decoding_is_exact_over_cuts(spark):
    """A conversation of 3000 turns without half of its roles, over 1 and over 13 ranges."""
    rnd = random.Random(7)
    rows = [(1, t, rnd.choice([None, None, "user", "assistant", "tool"]), "w " * rnd.randrange(200) + rnd.choice("?.")) for t in range(3000)]
    rows += [(c, t, rnd.choice([None, "user", "assistant"]), "x" * rnd.randrange(300)) for c in (0, 2, 3) for t in range(40)]
    rows += [(1, 1500, None, "same")] * 500
    whole, apart = (sorted(map(tuple, chat_format.format_chats(turns(spark, rows), n).collect()), key=repr) for n in (1, 13))
    assert len(whole) == len(rows) and whole == apart


def test_ranges_join_exactly():
    """Scores with many ties: the composed roles are those of one pass."""
    rnd = random.Random(1)
    for trial in range(60):
        model = chat_format.Model(np.zeros(4), np.zeros((2, 4, 4)), np.zeros((2, 4, chat_format.SHAPES)))
        for name in ("move", "start", "emit"):
            held = getattr(model, name)
            setattr(model, name, np.array([rnd.randrange(2) for _ in range(held.size)], np.int64).reshape(held.shape))
        lines = [(rnd.randrange(9), rnd.randrange(2), rnd.randrange(20)) for _ in range(rnd.randrange(8, 50))]
        at = [0, *sorted(rnd.sample(range(1, len(lines)), 5)), len(lines)]
        parts = [lines[a:b] for a, b in zip(at, at[1:], strict=False)]
        ends = chat_format.join_ranges([(model.opening(parts[0]), None), *map(model.transfer, parts[1:])])
        found = [r for k, p in enumerate(parts) for r in model.viterbi(p, ends[k - 1] if k else None, ends[k] if k < len(ends) else None)]
        assert found == model.viterbi(lines), trial


def test_hidden_roles_are_recovered(spark):
    """A third of the rows say nothing about their speaker."""
    rnd = random.Random(5)
    rows, truth = [], {}
    for c in range(150):
        for t in range(6):
            role = ("user", "assistant")[t % 2]
            text = "w" * rnd.randrange(20, 90) + "?" if role == "user" else "v" * rnd.randrange(300, 900) + "."
            truth[c, t] = role
            rows.append((c, t, None if rnd.random() < 0.33 else role, text))
    found = {(r["conv_id"], r["turn"]): r["role"] for r in chat_format.format_chats(turns(spark, rows)).collect()}
    assert sum(found[k] == v for k, v in truth.items()) >= 0.97 * len(truth)


def test_long_and_odd_conversations(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"line {t}") for t in range(1000)]
    rows += [(None, None, None, None), (2, 0, "user", ""), (2, 0, "user", ""), (3, 5, "poet", "x" * 100_000)]
    found = chat_format.format_chats(turns(spark, rows)).collect()
    assert len(found) == len(rows)  # each row is rendered once
    assert all(r["role"] == ("user", "assistant")[r["turn"] % 2] for r in found if r["conv_id"] == 1)
    assert chat_format.format_chats(turns(spark, [])).collect() == []


def test_learning_and_decoding_match_brute_force(spark):
    """Counts by one pass over each conversation, and the best of all paths of short ones."""
    rnd = random.Random(17)
    rows = []
    for c in range(40):
        for t in range(rnd.randrange(1, 6)):
            text = "\n".join(rnd.choice(["hello there", "why?", "- item", "User: hi", "w" * 200]) for _ in range(rnd.randrange(1, 3)))
            rows.append((c, t, rnd.choice([None, "user", "assistant", "tool"]), text))
    starts, moves, shapes = np.zeros(4), np.zeros((2, 4, 4)), np.zeros((2, 4, chat_format.SHAPES))
    seen = {}
    for c, _, role, text in sorted(rows, key=lambda r: r[:2]):
        held, lines = None, seen.setdefault(c, [])
        for x in chat_format.observe(role, text):
            held = x.mark if x.mark < chat_format.UNMARKED else held
            lines.append((x.mark, x.begins, x.shape, held))
    for lines in seen.values():
        before = None
        for k, (_, begins, shape, role) in enumerate(lines):
            if role is not None:
                shapes[begins, role, shape] += 1
                if k == 0:
                    starts[role] += 1
                elif before is not None:
                    moves[begins, before, role] += 1
            before = role
    want = chat_format.Model(starts, moves, shapes)
    table = chat_format.keyed(turns(spark, rows))
    for ranges in (1, 9):
        model = chat_format.learn(chat_format.deal(chat_format.codes(table), chat_format.cuts(table, ranges)))
        assert all(np.array_equal(getattr(model, n), getattr(want, n)) for n in ("start", "move", "emit"))
    for lines in seen.values():
        lines = [x[:3] for x in lines[:6]]

        def total(path, lines=lines):
            score = want.start[path[0]] + want.emit[lines[0]][path[0]]
            return score + sum(want.move[b][p, q] + want.emit[m, b, s][q] for (m, b, s), p, q in zip(lines[1:], path, path[1:], strict=False))

        best = max(itertools.product(range(4), repeat=len(lines)), key=lambda p: (total(p), [-r for r in reversed(p)]))
        assert want.viterbi(lines) == list(best)
