"""Wrappers: articles of generated hosts against the texts they were made from, alignment rules, and broken markup."""

import html as entities
import random

from tracegrain.llm import queries, wrappers

SF_DIR = "/root/testdata/sf0.001"
WORDS = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod tempor invidunt ut labore".split()


def _sentence(pick, least=4, most=25):
    return " ".join(pick.choice(WORDS) for _ in range(pick.randrange(least, most))).capitalize() + pick.choice([".", " & more.", " <1 é.", "!"])


def _article(pick):
    """Blocks as (element, text); the first is a headline."""
    out = [("h1", _sentence(pick, 2, 8))]
    for _ in range(pick.randrange(2, 9)):
        out.append((pick.choice(["p", "p", "p", "h2", "li", "blockquote"]), _sentence(pick)))
    return out


def _markup(pick, blocks):
    parts = []
    for tag, text in blocks:
        text = entities.escape(text).replace(" ", pick.choice([" ", "\n  ", "&nbsp;", " <br> ", "<!-- x --> "]), 1)
        words = text.split(" ")
        if len(words) > 3 and "<" not in text:
            words[1] = pick.choice(["<b>{}</b>", "<a href='/x?a=1&b=2'>{}</a>", '<span class="k">{}</span>', "<em>{}"]).format(words[1])
        body = " ".join(words)
        parts.append({"li": f"<ul><li>{body}</ul>", "p": f"<p>{body}" + pick.choice(["", "</p>"])}.get(tag, f"<{tag}>{body}</{tag}>"))
    return "\n".join(parts)


def _page(pick, style, body):
    menu = "".join(f"<li><a href=/{w}>{w}</a></li>" for w in pick.sample(WORDS, 5))
    noise = _sentence(pick)
    comments = "".join(f"<div class='comment'><p>{_sentence(pick)}</p></div>" for _ in range(pick.randrange(4)))
    head = f'<!DOCTYPE html><html><head><title>{noise}</title><style>p > a {{}}</style><script>if (a<b) x="<p>";</script></head><body>'
    ad = f'<div class="ad">{_sentence(pick)}</div>' if pick.random() < 0.5 else ""
    if style == 0:
        return f"{head}<nav><ul>{menu}</ul></nav>{ad}<article>{body}</article><footer>&copy; {noise}</footer></body></html>"
    if style == 1:
        aside = f"<aside><h3>Related</h3><p>{noise}</p></aside>"
        return (
            f"{head}<header><h1>The Daily</h1><ul>{menu}</ul></header><main>{ad}<div class=text>{body}</div>{aside}"
            f"<section id=comments>{comments}</section></main><form action=x><input><p>Sign up now</p></form><footer>{noise}</footer>"
        )
    if style == 2:  # nothing is named
        return (
            f"{head}<div id=top><p>Your daily source of news and of many other things to read</p><ul>{menu}</ul></div><div class='wrap'>"
            f"<div class='col1'>{body}</div><div class='col2'><ul>{menu}</ul></div></div><div class=end><p>All rights are reserved by us</p></div></body></html>"
        )
    return f"{head}<div class='page has-sidebar'><div class='cookie-notice'>We use cookies</div><article class=post>{body}{ad}</article>{comments}</div>"


def _expected(blocks):
    return "\n".join(" ".join(text.split()) for _, text in blocks)


def _pages(pick, n):
    rows = []
    for i in range(n):
        style = i % 4
        blocks = _article(pick)
        rows.append((i, f"https://host{style}.example.org/{i}", _page(pick, style, _markup(pick, blocks)), _expected(blocks)))
    return rows


def test_hosts_with_different_frames(spark):
    rows = _pages(random.Random(1), 240)
    df = spark.createDataFrame([(*r[:3], "x", 1) for r in rows], "page_id bigint, url string, html string, text string, host int")
    for size in ({}, {"piece": 7, "fan_in": 2}):
        hosts = wrappers.host_wrappers(df, **size).collect()
        assert sorted(r["host"] for r in hosts) == [f"host{k}.example.org" for k in range(4)]
        assert sum(r["pages"] for r in hosts) == 240
    found = {r["page_id"]: r for r in wrappers.main_text(df).collect()}
    for i, url, _, text in rows:
        assert found[i]["text"] == text, url
        assert (found[i]["url"], found[i]["n_chars"]) == (url, len(text))


def test_query_keeps_the_whole_article(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    found = queries.op11_articles(spark, SF_DIR).collect()
    assert sorted(r["page_id"] for r in found) == sorted(pages)
    for row in found:
        inner = pages[row["page_id"]].split("<article>")[1].split("</article>")[0]
        for tag in ("p", "h1", "b", "br"):
            inner = inner.replace(f"<{tag}>", "\n" if tag != "b" else "").replace(f"</{tag}>", "\n" if tag != "b" else "")
        lines = [" ".join(entities.unescape(x).split()) for x in inner.split("\n")]
        assert row["text"] == "\n".join(x for x in lines if x)
        assert row["n_chars"] == len(row["text"])


def _regex(*pages):
    facts, root = [], None
    for page in pages:
        node = wrappers.fold(wrappers.page_tree(page))
        root = node if root is None else wrappers.merged(root, node)
    text = wrappers.structure(root, facts)
    assert wrappers.structure(wrappers.parsed(text, facts), []) == text
    return text


def test_mismatches_become_options_groups_and_slots():
    assert _regex("<p>a<p>b<p>c") == "page[p[#]+]"
    assert _regex("<h1>a</h1><p>b", "<h1>a</h1><h2>x</h2><p>b") == "page[h1[#] h2[#]? p[#]]"
    assert _regex("<dl><dt>a<dd>b<dt>c<dd>d</dl>") == "page[dl[(dd[#] dt[#])*]]"
    assert _regex("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "<dl><dt>a<dd>b</dl>") == "page[dl[(dd[#] dt[#])*]]"
    assert _regex("<div id=a-101><p>x</div>", "<div id=a-7702><p>y</div>") == "page[div.a-[p[#]]]"
    one, two = (wrappers.fold(wrappers.page_tree(f"<p>{x}</p>")) for x in "ab")
    slot = lambda n: n.items[0].nodes[0].items[0].nodes[0]
    assert slot(wrappers.merged(one, one)).text and not slot(wrappers.merged(one, two)).text


def test_wide_and_deep_pages_stay_small():
    pick = random.Random(2)
    wide = ["".join(f"<{pick.choice('hsd')}{pick.randrange(99)} class=k{pick.choice('abcdef')}>x</a>" for _ in range(300)) for _ in range(30)]
    assert len(_regex(*wide)) < 40_000
    deep = "<div>" * 20_000 + "text" + "</div>" * 20_000
    assert wrappers.extracted(deep, None) == "text"
    assert wrappers.extracted("<div class=ad>" * 5_000 + "x", None) == ""


def test_broken_markup():
    get = lambda page: wrappers.extracted(page, None)
    assert get(None) == get("") == ""
    assert get("a < b && c &lt; d&amp") == "a < b && c < d&"
    assert get("<p>one<p>two</b></i><br>three</p>four") == "one\ntwo three\nfour"
    assert get("<article><p title='a > b'>x</p><p title=\"open>y</article>") == "x\ny"
    assert get("<body><p>a<script>never closed <p>b") == "a"
    assert get("<head><title>t<p>x</title><body>seen<textarea><p>no</textarea></body>") == "seen"
    assert get("<p>a<!-- <p>b --><span hidden>c</span><span style='display: none'>d</span>e") == "ae"
    assert get("<p>x<b>y</b>z&#8364;&eacute;&#x41;\t\n w") == "xyz€éA w"
    assert get("<!-- open <p>x") == ""
    assert get("<table><tr><td>a<td>b<tr><td><p>c</table>") == "a\nb\nc"


def test_odd_tables(spark):
    page = "<nav>m</nav><article><p>x</article>"
    rows = [(1, None, page), (1, None, page), (None, "not a url", page), (2, "http://h/", None), (3, "http://h/", ""), (4, "http://h/", "<p>" + "y " * 300_000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = sorted(((r["page_id"], r["text"][:3], r["n_chars"]) for r in wrappers.main_text(df).collect()), key=repr)
    assert found == [(1, "x", 1), (1, "x", 1), (2, "", 0), (3, "", 0), (4, "y y", 599_999), (None, "x", 1)]
    assert wrappers.main_text(df.filter("false")).collect() == []
