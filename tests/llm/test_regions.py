"""What a page is about, where tags alone mislead."""

import pytest

from cellgauge.llm import wrappers

STORY = "".join(f"<p>Sentence {k} of a story that goes on for a good while and says many things.</p>" for k in range(6))
TEXT = "\n".join(f"Sentence {k} of a story that goes on for a good while and says many things." for k in range(6))
BLOG = "<div id='comments' class='comments-area'><h2>Replies</h2><ol class='comment-list'><li class='comment'><article class='comment-body'><p>Great story, thank you so much for writing it!</p></article></li></ol></div>"


@pytest.mark.parametrize(
    "html,text",
    [
        # A teaser in an article beside a story in a div.
        (f"<body><nav>menu</nav><div class='story'><h1>Title</h1>{STORY}</div><article class='teaser'><h3>More</h3></article></body>", f"Title\n{TEXT}\nMore"),
        # An article that is what the page is about.
        (f"<body><div>Today is Monday</div><article>{STORY}</article><div>Other things</div></body>", TEXT),
        # A headline and a first paragraph right before it belong to it, what lies before them doesn't.
        (f"<body><div>Date</div><h1>Title</h1><p>Lead</p><article>{STORY}</article></body>", f"Title\nLead\n{TEXT}"),
        (f"<body><main><h1>Title</h1><article>{STORY}</article></main></body>", f"Title\n{TEXT}"),
        # A main is what the page is about, however short.
        (f"<body><div>{STORY}</div><main><p>Short.</p></main></body>", "Short."),
        # Comments of any make go, with the articles that they hold.
        (f"<body><article>{STORY}</article>{BLOG}</body>", TEXT),
        (f"<body><article>{STORY}{BLOG}</article></body>", TEXT),
        (f"<body><div>{STORY}</div>{BLOG}</body>", TEXT),
        (f"<body><div class='comments-open'><main>{STORY}</main></div></body>", TEXT),
        # A form around a whole page is its frame; a form in a page is none.
        (f"<body><form id='aspnet'><div>{STORY}</div><input></form></body>", TEXT),
        (f"<body><form><nav>menu</nav><article>{STORY}</article><form><label>Your name</label></form></form></body>", TEXT),
        (f"<body><div>{STORY}</div><form><p>Write to us</p><label>Your name</label></form></body>", TEXT),
        ("<body><form><label>Your name</label><button>Send</button></form></body>", ""),
        # Formulas are text.
        ("<body><p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> here.</p></body>", "Energy is E=m here."),
    ],
)
def test_regions(html, text):
    assert wrappers.extract_page(html) == text


def test_names_of_bodies_are_no_marks_of_their_own():
    for name in ("article-body", "body", "post-body", "main-body"):
        assert wrappers.extract_page(f"<body><div class='{name}'><p>story</p></div></body>") == "story"
    for name in ("comment-body", "footer-body"):
        assert wrappers.extract_page(f"<body><div class='{name}'><p>box</p></div><p>story</p></body>") == "story"
