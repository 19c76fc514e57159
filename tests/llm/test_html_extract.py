import itertools
import random

import numpy as np

from lodestrata.llm.html_extract import Block, Field, blocks, extract, features, fitted, structural_labels, train, variants


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li><a href="/a>b">x</a></li><li>y</ul></nav><!-- <p>no --><article><h1>A &amp;  B</h1><p><b>one<br>two<p>3 &lt; 4 &eacute;\t\n&#233; <i>in</i>line</p>a < b</article></body>"""
    got = [(b.path[-1], b.text) for b in blocks(page)]
    assert got == [("title", "T"), ("li", "x"), ("li", "y"), ("h1", "A & B"), ("p", "one two"), ("p", "3 < 4 é é inline"), ("article", "a < b")]
    assert blocks("") == [] and blocks("<p") [0].text == "<p" and blocks("<script>x") == []


def test_viterbi_is_the_best_sequence():
    r = np.random.default_rng(1)
    for _ in range(30):
        page = [Block(("p",), (), "x" * int(r.integers(1, 200)) + ".", 0) for _ in range(6)]
        f = Field({f"size={k}": float(r.normal()) for k in range(10)} | {"*": 0.2}, r.normal(size=(2, 2)).tolist(), r.normal(size=2).tolist())
        def score(labels, page=page, f=f):
            s = f.first[labels[0]] + sum(f.steps[a][b] for a, b in itertools.pairwise(labels))
            return s + sum(sum(f.weights.get(x, 0) for x in features(b, k, 6)) for k, (b, y) in enumerate(zip(page, labels, strict=True)) if y)

        assert abs(score(f.decode(page)) - max(map(score, itertools.product((0, 1), repeat=6)))) < 1e-9


def pages(n, seed):
    r = random.Random(seed)
    text = lambda k: " ".join(r.choice("on the er &amp; tion é st".split()) for _ in range(k))
    out = []
    for k in range(n):
        body = [text(r.randrange(1, 60)) + "." for _ in range(r.randrange(1, 8))]
        links = "".join(f'<li><a href="/{i}">{text(1)}</a></li>' for i in range(r.randrange(1, 9)))
        page = f'<html><head><title>t</title></head><body><nav><ul>{links}</ul></nav><div class="ad">{text(9)}</div><article><h1>{text(4)}</h1>' + "".join(f"<p>{b}</p>" for b in body) + f"</article><footer>&copy; {text(6)}</footer></body></html>"
        out.append((k, f"http://{k}", page))
    return out


def test_held_out_accuracy_on_other_frames(spark):
    field = train(spark.createDataFrame(pages(60, 1), "page_id long, url string, html string"))
    right = total = 0
    for k, _, page in pages(60, 2):
        p = blocks(page)
        for seq, labels in variants(p, structural_labels(p), 1000 + k):
            right += sum(a == b for a, b in zip(field.decode(seq), labels, strict=True))
            total += len(labels)
    assert right / total > 0.99


def test_table(spark):
    rows = pages(60, 3) + [(900, None, None), (901, "u", ""), (None, "u", "<article><p>only</p></article>"), (5, "u", "<p>x")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = extract(df).collect()
    assert len(got) == len(rows) and all(x.n_chars == len(x.text) for x in got)
    by = {x.url: x.text for x in got}
    for k, url, page in pages(60, 3):
        p = blocks(page)
        assert by[url] == "\n".join(b.text for b, y in zip(p, structural_labels(p), strict=True) if y)
    assert by[None] == "" and extract(df.limit(0)).collect() == []


A, B_, C_ = ("Rivers carry sand to the sea, where tides sort it by size.", "Coarse grains stay near the shore, fine ones drift out further.", "Over years, this builds the long bars that shelter the coast.")
#: Frames labelled by hand: (page, the article's blocks).
FRAMES = [
    (f'<body><div class="masthead">The Daily Coast</div><div class="menu"><a href="/">Home</a> <a href="/n">News</a></div><div class="content"><h1>How sand moves</h1><p>{A}</p><p>{B_}</p><p>{C_}</p></div><div class="sidebar"><p>Weather today: rain, and wind from the west all day.</p></div><div class="footer">© 2020 The Daily Coast</div></body>', ["How sand moves", A, B_, C_]),
    (f'<body><article><h1>How sand moves</h1><p>{A}</p><p>{B_}</p><section class="comments"><div class="comment"><p>Nice read, I have seen this at our beach many times.</p></div><div class="comment"><p>Not so sure about the second point, to be honest.</p></div></section></article></body>', ["How sand moves", A, B_]),
    (f'<body><main><h2>Sand</h2><p>{A}</p><div class="cookie notice">We use cookies to make this site better, accept them all?</div><p>{B_}</p><div class="advert">Buy one shovel and get another one free.</div><p>{C_}</p></main><footer>Imprint</footer></body>', ["Sand", A, B_, C_]),
    (f'<body><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><article><h1>Grain sizes</h1><p>{A}</p><table><tr><td>Coarse <table><tr><td>2 mm</td></tr></table></td><td>Shore.</td></tr></table><p>{B_}</p></article></body>', ["Grain sizes", A, "Coarse", "2 mm", "Shore.", B_]),
    (f"<body><article><h1>Sand<p>{A}<p>{B_}<p><b>{C_}</article><footer>About us", ["Sand", A, B_, C_]),
    (f'<body><header><h1>Site</h1></header><div class="post"><h2>Sand</h2><p>{A}</p><ul><li>Coarse grains.</li><li>Fine grains.</li></ul><p>{B_}</p></div><form class="newsletter"><div>Subscribe to our letter</div></form><aside><p>Popular this week: ten beaches you have to see.</p></aside></body>', ["Sand", A, "Coarse grains.", "Fine grains.", B_]),
    (f'<body><div><div class="story body"><h1>Sand</h1><p>{A}</p><p>{B_}</p></div><div class="related"><ul><li><a href="/1">Dunes of the north</a></li><li><a href="/2">Cliffs of the south</a></li></ul></div></div></body>', ["Sand", A, B_]),
]


def article(field, page):
    p = blocks(page)
    return [b.text for b, y in zip(p, field.decode(p), strict=True) if y]


def overlap(got, want):
    return 2 * sum(min(got.count(x), want.count(x)) for x in set(want)) / (len(got) + len(want))


def test_frames_labelled_by_hand():
    field = fitted([page for _, _, page in pages(60, 1)])
    scores = [overlap(article(field, page), want) for page, want in FRAMES]
    assert sum(scores) / len(scores) >= 0.95 and min(scores) >= 0.85, scores


def test_pages_without_article_anywhere_have_text():
    plain = [f'<html><body><div class="menu"><a href="/">Home</a></div><p>{A} {k}</p><p>{B_} {k}</p><div>Copyright of the site</div></body></html>' for k in range(12)]
    field = fitted(plain)
    for k, page in enumerate(plain):
        assert article(field, page) == [f"{A} {k}", f"{B_} {k}"]
    assert fitted(["", " "]).decode([]) == []


def test_a_table_without_a_page_to_train_on_has_text():
    field = fitted([])
    scores = [overlap(article(field, page), want) for page, want in FRAMES]
    assert sum(scores) / len(scores) >= 0.9, scores
