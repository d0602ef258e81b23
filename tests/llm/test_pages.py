"""Main text: what names, forms, tables and links may not take out of an article, and the ratios by brute force."""

import math
import random
import time

import pytest

from spanveil.llm import html_main

SENTENCE = "The harbour was quiet, the boats lay still, and nobody came down to the water that morning. "
P = f"<p>{SENTENCE * 2}</p>"
TEXT = (SENTENCE * 2).strip()


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body><form id=aspnet><div class=menu><a href=x>Home</a></div><h1>Title</h1>{P * 4}</form></body>", " ".join(["Title", *[TEXT] * 4])),
        (f"<body><article>{P}<div class='share-of-market'>{P}</div>{P}</article></body>", " ".join([TEXT] * 3)),
        (f"<body><article>{P}<p id='social-contract'>{SENTENCE}</p>{P}</article></body>", " ".join([TEXT, SENTENCE.strip(), TEXT])),
        (f"<body><article>{P}<p><a href=x>{SENTENCE}</a></p>{P}</article></body>", " ".join([TEXT, SENTENCE.strip(), TEXT])),
        (f"<body><article>{P}<table><tr><th>Year</th><th>Boats</th></tr><tr><td>1990</td><td>12</td></tr></table>{P}</article></body>", f"{TEXT} Year Boats 1990 12 {TEXT}"),
        (f"<body><article>{P}<ul><li>one</li><li>two</li></ul>{P}</article></body>", f"{TEXT} one two {TEXT}"),
        (f"<body><article>{P}<ul><li><a href=a>one</a></li><li><a href=b>two</a></li></ul>{P}</article></body>", f"{TEXT} {TEXT}"),
        (f"<body><div class='site-header'><p>{SENTENCE}</p></div><article>{P}<div class='newsletter-box'><p>Write to us, please.</p></div>{P}</article><div id=commentsSection><p>{SENTENCE}</p></div></body>", f"{TEXT} {TEXT}"),
        (f"<body><form action=search><input><label>Search this site</label></form><article>{P}{P}</article><form>{P}</form></body>", f"{TEXT} {TEXT}"),
    ],
)
def test_articles_stay_whole(page, want):
    assert html_main.main_text(page) == want


def test_time_grows_with_length():
    """Elements that never close, links over all of it, and lists in lists: none is slower than in proportion, within a wide margin."""
    kinds = [lambda n: "<li><ul>" * n + "<foo><li>x</li>" * n, lambda n: "<div>" * n + "x", lambda n: "<p><a>" * n, lambda n: "<td>x" * n + "<table>" * n, lambda n: "<select><b>" * n]
    for kind in kinds:
        took = []
        for n in (3000, 12_000):
            began = time.process_time()
            html_main.main_text(kind(n))
            took.append(time.process_time() - began)
        assert took[1] < 12 * took[0] + 0.5, kind(2)


def brute_chosen(page):
    """The ratios and the threshold, written down as they are described, path by path."""
    may = html_main.inside(page)
    index = [i for i, m in enumerate(may) if m]
    paths = {page.blocks[i].path for i in index}
    ratio = {}
    for p in paths:
        own = [page.blocks[i] for i in index if page.blocks[i].path == p]
        marks = sum(sum(c in ".,;:!?…。、，！？؟،" for c in b.text) for b in own if 2 * b.linked < len(b.text))
        ratio[p] = (sum(b.own for b in own) / len(own), marks / len(own))

    def smoothed(k, which):
        near = [(ratio[page.blocks[j].path][which] if may[j] else 0.0, math.exp(-((j - k) ** 2) / 2)) for j in range(max(0, k - 2), min(len(may), k + 3))]
        return sum(v * w for v, w in near) / sum(w for _, w in near)

    fused = {p: [math.sqrt(smoothed(i, 0) * (1 + smoothed(i, 1))) for i in index if page.blocks[i].path == p] for p in paths}
    value = {p: sum(v) / len(v) for p, v in fused.items()}
    total = sum(page.blocks[i].own for i in index)
    level = sum(value[page.blocks[i].path] * page.blocks[i].own for i in index) / total if total else 0
    return [bool(total) and may[i] and value[b.path] >= 0.5 * level and 2 * b.own >= len(b.text) for i, b in enumerate(page.blocks)]


def test_ratios_by_brute_force(monkeypatch):
    monkeypatch.setattr(html_main, "with_thin", lambda page, may, chosen: chosen)
    rng = random.Random(7)
    for _ in range(300):
        parts = []
        for _ in range(rng.randrange(25)):
            parts.append(rng.choice(["<div>", "</div>", "<p>", "</p>", "<ul><li>", "</ul>", "<nav>", "</nav>", "<a>", "</a>", "<h2>", "</h2>", "<section class=menu>", "</section>", SENTENCE, "word ", "a, b. ", "x" * rng.randrange(60)]))
        page = html_main.Page("".join(parts))
        got, want = html_main.content_blocks(page), brute_chosen(page)
        assert got == want, "".join(parts)
