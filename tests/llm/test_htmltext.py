"""Main text of pages: made sites whose articles are known, wrappers that accept their pages, and odd input."""

import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from convgraph.llm import htmltext, wrapper

WORDS = "river stone window garden letter market winter summer people street".split()
SCHEMA = "page_id bigint, url string, html string, host string, sid string, blocks int"


def sentence(rng, n=12):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


def extracted(spark, rows):
    df = spark.createDataFrame([(*r, "h", "s", 1) for r in rows], SCHEMA).repartition(3)
    out = htmltext.extract(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = out.collect()
    assert all(r.n_chars == len(r.text) for r in got)
    return sorted((r.page_id, r.text) for r in got)


def semantic(rng, i):
    title, paras = sentence(rng, 5), [sentence(rng, rng.randint(1, 30)) for _ in range(rng.randint(1, 6))]
    menu = "".join(f'<li><a href="/{w}">{w}</a>' for w in rng.sample(WORDS, 4))
    ad = f'<div class="ad-box">{sentence(rng)}</div>' if i % 2 else ""
    body = "".join(f"<p>{p.replace(' ', '  &#32;', 1)}" + ad * (k == 1) for k, p in enumerate(paras))
    page = (f"<html><head><title>{title}</title><script>var x='<p>no</p>'</script></head><body><header><h2>{sentence(rng)}</h2></header><nav><ul>{menu}</ul></nav>"
            f"<div class='cookie-notice'>We use cookies {i}</div><main><article class='post'><header><h1>{title}</h1></header>{body}</article>"
            f"<section id=comments><article class=comment><p>{sentence(rng)}</article></section><form><p>Write {i}</p></form></main>"
            f"<aside><p>{sentence(rng)}</p></aside><footer>&copy; {i}</footer></body>")
    return page, "\n".join([title, *paras])


def soup(rng, i):
    """No telling element or class: the article is where long text changes; some texts and links are on every page."""
    title, paras = sentence(rng, 5), [sentence(rng, rng.randint(15, 40)) for _ in range(rng.randint(2, 6))]
    links = "".join(f'<div><a href="{w}">{w}</a></div>' for w in rng.sample(WORDS, 3))
    extra = f"<div class=x9>{sentence(rng, 3)}</div>" if i % 3 == 0 else ""
    page = (f"<body><div class=a1>{links}</div><div class=a2>Welcome to our site about many things.</div>{extra}"
            f"<div class=b1><h1>{title}</h1><div class=b2>{'<br><br>'.join(paras)}</div></div><div class=c1>All rights kept by the makers of this site.</div></body>")
    return page, "\n".join([title, *paras])


def test_known_articles(spark):
    rng = random.Random(4)
    rows, want = [], []
    for i in range(90):
        page, text = (semantic, soup)[i % 2](rng, i)
        host = f"{('s', 'd')[i % 2]}{0 if i % 3 else i % 5}.example.org"
        host = host if i % 2 == 0 else "D.example.org"
        rows.append((i, f"http://{host}/p{i}", page))
        want.append((i, text))
    assert extracted(spark, rows) == want


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "no host", "plain &amp; simple &nbsp; text"), (4, "http://a.org", "<p>one<p>two <b>b</b>old<br>three"),
            (4, "http://a.org", "<p>one<p>two <b>b</b>old<br>three"), (5, "http://b.org/", "<article><p>cut off <a href='"), (6, "http://b.org/", "<nav>only"),
            (7, "http://c.org", "<div>" * 3000 + "deep &lt;b&gt; a < b" + "</div>" * 3000), (8, "http://e.org", "<article>" + "<p>para</p><h2>head</h2>" * 5000 + "</article>"),
            (None, "http://f.org", '<article a="x>y" b=\'">\'>quoted</article>'), (9, "http://g.org", "<ARTICLE><P>Upper</P><STYLE>p{}</STYLE></ARTICLE>")]
    got = htmltext.extract(spark.createDataFrame([(*r, "h", "s", 1) for r in rows], SCHEMA)).collect()
    texts = {(r.page_id, r.text) for r in got}
    assert len(got) == len(rows)
    assert texts == {(1, ""), (2, ""), (3, "plain & simple text"), (4, "one\ntwo bold\nthree"), (5, "cut off"), (6, ""), (7, "deep <b> a < b"),
                     (8, "\n".join(["para", "head"] * 5000)), (None, "quoted"), (9, "Upper")}


def test_empty_table(spark):
    assert extracted(spark, []) == []


def test_copies_of_a_page_do_not_make_it_template(spark):
    rng = random.Random(1)
    rows = [(i, "http://h.org/", soup(rng, 1)[0]) for i in range(6)]
    page, text = soup(rng, 1)
    rows += [(100 + i, "http://h.org/", page) for i in range(50)]
    assert [t for i, t in extracted(spark, rows) if i >= 100] == [text] * 50


def test_groups_are_aligned_in_any_number_of_rounds(spark, monkeypatch):
    monkeypatch.setattr(htmltext, "FAN", 2)
    pages = [f"<div><p>a</p>{'<hr><ul><li>x</ul>' * (i % 2)}<div class=k{'x' * i}>t</div></div>" for i in range(20)]
    streams = [json.dumps(wrapper.read_page(p)[0], separators=(",", ":")) for p in pages]
    df = spark.createDataFrame([("h", s) for s in set(streams)], "host string, stream string")
    (row,) = htmltext.infer_wrappers(df).collect()
    w = json.loads(row.wrapper)
    for s in streams:
        assert -1 not in wrapper.locate(w, json.loads(s))


element = st.recursive(st.just("text "), lambda inner: st.builds(lambda t, kids: f"<{t}>{''.join(kids)}</{t}>", st.sampled_from(["div", "p", "ul", "li", "section"]), st.lists(inner, max_size=4)), max_leaves=12)


@settings(max_examples=80, deadline=None)
@given(st.lists(element, min_size=1, max_size=4))
def test_a_wrapper_takes_every_page_it_was_made_of(pages):
    streams = [wrapper.read_page(p)[0] for p in pages]
    w = streams[0]
    for s in streams[1:]:
        w = wrapper.align(w, s)
    for s in streams:
        assert -1 not in wrapper.locate(w, s)
    # no text is lost on the way
    for p in pages:
        assert " ".join(t for _, t, _, _ in wrapper.read_page(p)[1]).split() == ["text"] * p.count("text")


def test_repeats_and_options_are_folded():
    a = wrapper.read_page("<ul><li>1<li>2<li>3</ul><dl><dt>a<dd>b<dt>c<dd>d</dl><p>x")[0]
    assert wrapper.show(a) == "ul(li(#)+) dl((dt(#) dd(#))+) p(#)"
    b = wrapper.read_page("<ul><li>1</ul><div>new</div><p>x")[0]
    assert wrapper.show(wrapper.align(a, b)) == "ul(li(#)+) dl((dt(#) dd(#))+)? div(#)? p(#)"
