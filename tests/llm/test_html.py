"""Extraction on pages of several templates, and its scores against a plain, slow scorer."""

from __future__ import annotations

import random
import time

import pytest

from fuseline.llm import html

WORDS = "river stone market letter winter garden people change music paper window city road number answer water light story".split()


def sentence(rng, low=8, high=30):
    words = [rng.choice(WORDS) + ("," if rng.random() < 0.12 else "") for _ in range(rng.randint(low, high))]
    return " ".join(words).strip(",").capitalize() + "."


def article(rng):
    """(tag, text) of an article's blocks."""
    out = [("h1", sentence(rng, 3, 7))]
    for _ in range(rng.randint(3, 8)):
        kind = rng.choice(("p", "p", "p", "p", "h2", "ul", "short", "quote"))
        if kind == "p":
            out.append(("p", " ".join(sentence(rng) for _ in range(rng.randint(2, 4)))))
        elif kind == "h2":
            out += [("h2", sentence(rng, 2, 5)), ("p", " ".join(sentence(rng) for _ in range(3)))]
        elif kind == "ul":
            out += [("li", sentence(rng, 2, 8)) for _ in range(3)]
        elif kind == "short":
            out.append(("p", sentence(rng, 3, 5)))
        else:
            out.append(("blockquote", sentence(rng)))
    out.append(("p", " ".join(sentence(rng) for _ in range(3))))
    return out


def markup(blocks):
    out, listed = "", False
    for tag, text in [*blocks, ("", "")]:
        if (tag == "li") != listed:
            out += "</ul>" if listed else "<ul>"
            listed = not listed
        out += f"<{tag}>{text}</{tag}>" if tag else ""
    return out


def links(rng, n=6):
    return "<ul>" + "".join(f'<li><a href="/{k}">{rng.choice(WORDS)} {rng.choice(WORDS)}</a></li>' for k in range(n)) + "</ul>"


def comments(rng, plain=False):
    own = "".join(f"<div><b>{rng.choice(WORDS)} says</b><p>{sentence(rng, 3, 6)}</p></div>" for _ in range(2))
    return f"<div class=posts>{own}</div>" if plain else f'<section id="comments">{own * 3}</section>'


def blog(rng, a):
    return f"<body><header><a href=/>Home</a></header><nav>{links(rng)}</nav><article>{a}</article><div class='related-posts'>{links(rng)}</div>{comments(rng)}<footer>x</footer></body>"


def portal(rng, a):
    return (f"<body><div id=top><div>Your daily source of news</div>{links(rng)}</div><div id=wrap><div id=content>{a}</div>"
            f"<div class='sidebar'><p>{sentence(rng)}</p>{links(rng)}</div></div><div class=cookie-notice><p>{sentence(rng)}</p></div><div>All rights reserved.</div></body>")  # fmt: skip


def bare(rng, a):
    return f"<body><div>Tagline of a site.</div><div><div class=inner>{a}</div></div><div>Opening hours from nine to five. All rights reserved.</div>{comments(rng, True)}</body>"


def flat(rng, a):
    return f"<html><body>{links(rng)}{a}<div class=ad>{sentence(rng)}</div><div><a href=/a>About</a> <a href=/b>Contact</a></div></body></html>"


def tables(rng, a):
    return f"<body><table><tr><td>{links(rng)}</td><td>{a}</td><td><a href=/x>{sentence(rng, 3, 5)}</a></td></tr></table><p><a href=/imprint>Imprint</a></p></body>"


def forum(rng, a):
    return f"<body><div class='page no-sidebar'><div class=menu-content>{a}</div><div class='share-buttons'><a href=#>share</a> <a href=#>like</a></div>{comments(rng)}</div></body>"


def card(rng, a):
    return f"<body><main><div class='widget'>{a}</div><aside><p>{sentence(rng)}</p></aside></main><div class='newsletter-signup'><p>{sentence(rng)}</p></div></body>"


TEMPLATES = {f.__name__: f for f in (blog, portal, bare, flat, tables, forum, card)}


def figures(name, pages=60):
    """Precision and recall in characters of whole blocks, and how many pages come out exactly."""
    rng = random.Random(name)
    found = kept = right = exact = 0
    for _ in range(pages):
        want = article(rng)
        got = html.main_text(TEMPLATES[name](rng, markup(want))).split("\n")
        texts = {t for _, t in want}
        kept += sum(map(len, got))
        right += sum(len(t) for t in got if t in texts)
        found += sum(len(t) for _, t in want)
        exact += got == [t for _, t in want]
    return right / kept, right / found, exact / pages


@pytest.mark.parametrize("name", TEMPLATES)
def test_precision_and_recall(name):
    precision, recall, _ = figures(name)
    assert precision >= 0.97 and recall >= 0.97, (precision, recall)


LONG = "<p>" + "One sentence, that is long enough, is here. " * 5 + "</p>"
TEXT = ("One sentence, that is long enough, is here. " * 5).strip()


def test_a_name_does_not_remove_what_holds_the_points():
    assert html.main_text(f"<article><p class='notice-period'>Three months, at least.</p>{LONG}</article>") == f"Three months, at least.\n{TEXT}"
    assert html.main_text(f"<article>{LONG}<div class=dialog><p>He said so.</p></div></article>") == f"{TEXT}\nHe said so."
    assert html.main_text(f"<body><nav>x</nav><div class='tasting menu'>{LONG * 3}</div></body>") == "\n".join([TEXT] * 3)
    assert html.main_text(f"<body><div class='menu-content'>{LONG}</div></body>") == TEXT
    assert html.main_text(f"<body><div class=widget>{LONG * 3}</div><p>x</p></body>").startswith(TEXT)
    assert html.main_text(f"<article>{LONG}<div class=widget>{LONG}</div></article>") == TEXT
    assert html.main_text(f"<body><div class=sidebar>{LONG * 9}</div></body>") == "\n".join([TEXT] * 9)
    assert html.main_text("<body><div class=cookie-notice>We use cookies, as all do.</div></body>") == ""


def test_foreign_boxes_stay_out():
    page = f"<body><div>A tagline</div><div>{LONG * 4}</div><div>Opening hours ... All rights reserved.</div><div class=posts><b>bob says</b><p>nice!</div></body>"
    assert html.main_text(page) == "\n".join([TEXT] * 4)
    assert html.main_text(f"<body><div class=page-header><h1>Title</h1><a href=/>x</a></div><div>{LONG * 2}</div></body>") == "\n".join(["Title", TEXT, TEXT])


def test_words_inside_a_sentence_stay():
    assert html.main_text("<article><p><label>Term</label> defined</p></article>") == "Term defined"
    assert html.main_text("<article><p>Press <button>OK</button> to go</p><p>Nice. <button>Reply</button></p></article>") == "Press OK to go\nNice."
    assert html.main_text("<article><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p></article>") == "So x=1 holds"
    assert html.main_text("<article><p>See <svg><title>t</title><desc>d</desc><path d=1><text>A1</text></svg> here</p><svg><text>no</text></svg></article>") == "See A1 here"


def slow_scores(root):
    """Each container's score from all blocks below it, one by one."""

    def text(n, inside=False):
        return "".join(c if type(c) is str else "" if not inside and c.tag in html.BLOCKS else text(c, inside) for c in n.children)

    def chars(n, linked=False):
        linked = linked or n.tag == "a"
        own = [(len(c.strip()), len(c.strip()) * linked) if type(c) is str else chars(c, linked) for c in n.children]
        return sum(a for a, _ in own), sum(b for _, b in own)

    def below(n, depth=0):
        for c in n.children:
            if type(c) is html.Node:
                yield c, depth + 1
                yield from below(c, depth + 1)

    out = {}
    for n in [root, *(c for c, _ in below(root))]:
        total = 0.0
        for b, depth in [(n, 0), *below(n)]:
            own = text(b).strip() if b.tag in html.BLOCKS or b is root else ""
            steps = depth - (b.tag in html.PARAGRAPHS)
            if own and steps >= 0:
                total += (1 + own.count(",") + min(len(own) // 100, 3)) * (1 if len(own) >= 25 else 0.25) / 2**steps
        whole, linked = chars(n)
        out[id(n)] = total * (1 - (linked / whole if whole else 0))
    return out


def test_scores_match_a_slow_scorer():
    rng = random.Random(5)

    def part(depth):
        kind = rng.choice(("p", "div", "section", "ul", "text", "a", "span", "td")) if depth < 6 else "text"
        if kind == "text":
            return sentence(rng, 1, 40)
        inner = "".join(part(depth + 1) for _ in range(rng.randint(1, 4)))
        return f"<{kind}>{inner}</{kind}>"

    for _ in range(150):
        root = html.parse("<body>" + "".join(part(0) for _ in range(4)) + "</body>")
        want = slow_scores(root)
        scored = html.scores(root, html.sizes_of(root))
        for n in scored:
            assert n.score == pytest.approx(want[id(n)], abs=1e-6)
        assert {k for k, v in want.items() if v > 1e-6} <= {id(n) for n in scored}


def test_many_named_parts_and_deep_growth_take_linear_time():
    began = time.process_time()
    html.main_text("<div class=widget>a, b" * 20_000)
    html.main_text("<div>" * 20_000 + LONG + "</div><p>one, two</p><p>three</p>" * 20_000)
    html.main_text("<p>" + "a <button>b</button>" * 30_000)
    assert time.process_time() - began < 12


def test_ties_and_repeated_rows(spark):
    page = f"<body><article>{LONG}</article><nav>x</nav><div><article>{LONG.replace('One', 'Two')}</article></div></body>"
    assert html.main_text(page).split("\n")[0] == TEXT  # the first of equal score
    df = spark.createDataFrame([(1, page)] * 3, "page_id long, html string")
    assert len({r.text for r in html.with_main_text(df).collect()}) == 1
