"""Pages whose furniture is named in ways that also name articles, and pages nested deep."""

import random
import time

import pytest

from siftwork.llm.html_extract import main_text

SENTENCES = [f"This is sentence {k} of the story, with commas, and some more words to read." for k in range(12)]
STORY = "".join(f"<p>{s}</p>" for s in SENTENCES)
TEXT = "\n\n".join(SENTENCES)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article><div class='entry-header'><h1>Title</h1></div>{STORY}</article>", "Title\n\n" + TEXT),
        (f"<body><div class='content ad-free'>{STORY}</div></body>", TEXT),
        (f"<body><article class='post search-result'>{STORY}</article></body>", TEXT),
        (f"<body><div class='layout-sidebar-right'>{STORY}</div><div class=sidebar><p>Short other.</p></div></body>", TEXT),
        (f"<body><div class='widget'>{STORY}</div><div class=widget><p>Short other.</p></div></body>", TEXT),
        (f"<body><article>{STORY}</article><article>{STORY}</article></body>", f"{TEXT}\n\n{TEXT}"),
        (f"<body><article class=teaser><p>A short teaser, of one line, with a comma.</p></article><div class=story>{STORY}</div></body>", TEXT),
        (f"<body><article>{STORY}</article><div class='comments'>{STORY * 3}</div></body>", TEXT),
        (f"<body><article><p>{SENTENCES[0]}</p></article><div class=sidebar>{STORY}</div><div class=ad>{STORY}</div></body>", SENTENCES[0]),
    ],
)
def test_named_furniture_and_several_articles(page, text):
    assert main_text(page) == text


def test_pages_built_from_known_blocks():
    """Any order of known furniture around and inside a known article gives back the article's blocks."""
    rng = random.Random(5)
    furniture = [
        "<nav><a href=/a>Home</a> <a href=/b>News</a></nav>", "<header><h2>The Site</h2></header>", "<footer>All rights, reserved.</footer>", "<aside><p>More, of this.</p></aside>",
        "<div class='ad'>Buy, now.</div>", "<div id=cookie-notice>We use cookies, yes.</div>", "<form><p>Your name, please.</p></form>", "<script>var a = '<p>no</p>';</script>",
        "<div class='comments'><p>First, again.</p></div>", "<style>p{}</style>", "<!-- <p>no</p> -->", "<ul class='share-links'><li><a href=/x>Share, this</a></li></ul>",
    ]
    own = [f for f in furniture if not f.startswith("<header>")]  # a header in an article is the article's
    for _ in range(200):
        blocks = [" ".join(rng.choices(SENTENCES, k=rng.randint(1, 4))) for _ in range(rng.randint(2, 9))]
        inner = "".join(rng.choice(own) * (rng.random() < 0.2) + f"<{t}>{x}</{t}>" for x in blocks for t in [rng.choice(["p", "h2", "blockquote"])])
        around = [[rng.choice(furniture) for _ in range(rng.randint(0, 4))] for _ in range(2)]
        page = f"<html><body>{''.join(around[0])}<article><h1>Title</h1>{inner}</article>{''.join(around[1])}</body></html>"
        assert main_text(page) == "\n\n".join(["Title", *blocks]), page


def test_deep_pages_take_little_time():
    start = time.process_time()
    assert main_text("<div>some text, here. " * 1000).count("some text") == 1000
    assert time.process_time() - start < 3
