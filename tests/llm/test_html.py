from __future__ import annotations

import random

import numpy as np

from tickwarden.llm import html

SCHEMA = "page_id long, url string, html string, text string, n_chars int"


def made(rnd, i):
    words = lambda n: " ".join(rnd.choice("one two three four five six seven".split()) for _ in range(n))
    inside = [words(6).title(), *[words(rnd.randrange(3, 40)) for _ in range(rnd.randrange(1, 7))]]
    page = (
        f"<!DOCTYPE html><html><head><title>{inside[0]}</title><style>p{{a:b}}</style><script>var x='</p><p>no';</script></head><body>"
        f"<nav><ul><li><a href='/a>b'>{words(1)}</a></li><li><a>{words(2)}</a></li></ul></nav><!-- <p>not this</p> -->"
        f"<div class=\"ad\">{words(9)}</div><article><h1>{inside[0]}</h1>" + "".join(f"<p>{p}</p>" if k % 2 else f"<p><b>{p}<br>" for k, p in enumerate(inside[1:])) +
        f"</article><footer>&copy; {words(8)}</footer>" + ("</body></html>" if i % 3 else ""))
    return page, "\n".join(inside)


def test_blocks_of_broken_pages():
    got = html.blocks("<p>a &amp; b&nbsp;c\n\n d<p>e<br>f <b>g</b>h<!-- x --><script>if (a<b) '</p>'</script>i</div><li>1<li>2&#x41;<textarea>t</textarea> < 3 &copy")
    assert [b.text for b in got] == ["a & b c d", "e f ghi", "1", "2A < 3 ©"]
    assert html.blocks(None) == [] and html.blocks("") == [] and html.blocks("<div><br></div>") == []
    assert [b.text for b in html.blocks("plain < text")] == ["plain < text"]
    path = html.blocks("<body><div class='post-body x' hidden><ul><li><a href=q>in</a> out</ul></div>")[0]
    assert [t for t, _ in path.path] == ["body", "div", "ul", "li"] and {"post-body", "post", "body", "x", "hidden"} <= set(path.path[1][1])
    assert path.linked == 2 and len(html.blocks("<p>" + "x" * 200000)[0].text) == 200000
    assert len(html.blocks("<a b='" * 3000)) <= 1


def test_extract_finds_the_articles(spark):
    rnd = random.Random(4)
    pages = [made(rnd, i) for i in range(150)]
    rows = [(i, f"http://h/{i}", p, "x", 1) for i, (p, _) in enumerate(pages)]
    rows += [(500, "u", None, "", 0), (501, None, "", "", 0), (None, "u", pages[0][0], "", 0), (7, "again", pages[7][0], "", 0), (502, "u", "<script>x</script>", "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = html.extract(df, html.fit(df)).collect()
    assert len(got) == len(rows)
    by_id = {(r["page_id"], r["url"]): r for r in got}
    for i, (_, want) in enumerate(pages):
        assert by_id[i, f"http://h/{i}"]["text"] == want
    assert by_id[None, "u"]["text"] == pages[0][1] and by_id[7, "again"]["text"] == pages[7][1]
    assert [by_id[k]["text"] for k in ((500, "u"), (501, None), (502, "u"))] == ["", "", ""]
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    model = html.fit(df.limit(0))
    assert html.extract(df.limit(0), model).count() == 0


def test_other_tags_and_names_are_told_apart(spark):
    """Pages the network has not seen, with their elements under other tags and names and side matter mixed in."""
    rnd = random.Random(5)
    df = spark.createDataFrame([(i, "u", made(rnd, i)[0], "", 0) for i in range(300)], SCHEMA)
    model, draw, right, total = html.fit(df), np.random.default_rng(3), 0, 0
    for i in range(100):
        page = html.blocks(made(rnd, i)[0])
        page, want = html.varied(page, html.weak_labels(page), ["one two", "five six seven one two three"], draw)
        got = model.label([html.vectors(page)])[0]
        right, total = right + int((got == np.array(want, bool)).sum()), total + len(want)
    assert right >= 0.97 * total


def test_gradients_match_differences():
    model = html.Labeller(3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rnd = np.random.default_rng(1)
    pages = [rnd.normal(size=(n, html.WIDTH)) for n in (3, 6)]
    x, n = model.pad(pages)
    x = x.astype(np.float64)
    y = (rnd.random(x.shape[:2]) < 0.5).astype(float)
    _, grad = model.step(x, n, y)
    for name, values in model.p.items():
        at = np.unravel_index(np.argmax(np.abs(grad[name])), values.shape)
        kept = values[at]
        values[at] = kept + 1e-4
        up, _ = model.step(x, n, y)
        values[at] = kept - 1e-4
        down, _ = model.step(x, n, y)
        values[at] = kept
        assert abs((up - down) / 2e-4 - grad[name][at]) < 1e-3 * max(1.0, abs(grad[name][at]))


def test_all_words_of_a_long_block_count():
    words = [f"w{i}" for i in range(3000)]
    page = lambda w: html.blocks("<p>" + " ".join(w) + "</p>")
    one, other = html.vectors(page(words)), html.vectors(page(words[:2000] + ["tail"] * 1000))
    share = slice(html.PATHS, html.PATHS + html.WORDS)
    assert abs(one[0, share].sum() - 3000 / 3001) < 1e-4 and not np.allclose(one[0, share], other[0, share])
