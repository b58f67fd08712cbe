"""Broken and oddly wrapped pages, and Merkle trees against a plain recursive hash."""

import hashlib
import random
import re

import pytest

from skein.llm import html, merkle

P = [f"This is paragraph number {k} of the article, with a good many words in it so that it is dense enough to count." for k in range(6)]
BODY = "".join(f"<p>{p}</p>" for p in P)
MENU = "<ul>" + "".join(f"<li><a href=/{k}>Menu item {k}</a></li>" for k in range(8)) + "</ul>"
COMMENTS = "".join(f"<p>I am reader number {k} and I have a long opinion about all of this that I would like to share.</p>" for k in range(9))

# pages without <article>, and what surely belongs to their text
WRAPPED = {
    "marked section without an end": f"<![ <div>{BODY}</div>",
    "nested marked section": f"<![foo[bar]]><div>{BODY}</div>",
    "conditional comments": f"<![if !IE]><div>{BODY}</div><![endif]>",
    "the page in a form": f"<body><form id=aspnetForm action=x><div id=top>{MENU}</div><div>{BODY}</div><div class=footer>Copyright</div></form></body>",
    "menu without an end": f"<body><nav>{MENU}<h1>Title</h1><div>{BODY}</div></body>",
    "menu without an end, no heading before": f"<body><nav>{MENU}<main>{BODY}</main></body>",
    "header around everything": f'<body><div class="header"><h1>Title</h1><div>{BODY}</div></div></body>',
    "more comments than article": f'<body><div><h1>Title</h1>{BODY}</div><div class="comments">{COMMENTS}</div></body>',
    "more footer than article": f"<body><div><h1>Title</h1>{BODY}</div><footer>{COMMENTS}</footer></body>",
    "a search form beside": f"<body><form>{COMMENTS[:150]}</form><div>{BODY}</div></body>",
}


@pytest.mark.parametrize("name", WRAPPED)
def test_articles_survive_their_wrappers(name):
    got = html.main_blocks(WRAPPED[name])
    assert [x for x in got if x != "Title"] == P


def test_a_side_with_its_own_heading_stays_out():
    got = html.main_blocks(f"<body><nav>{MENU}</nav><article><h1>Title</h1>{BODY}</article><aside><h1>Related</h1>{MENU}</aside></body>")
    assert got == ["Title", *P]


def test_no_markup_stops_the_parser():
    rng = random.Random(1)
    parts = ["<![", "<!", "<!--", "-->", "<![CDATA[", "]]>", "<?x", ">", "<a href='", '"', "</", "<p>", "<div class=ad>", "&#", "&amp", "&#x110000;", "\0", "é", "<script>", "</script>", "text text ", "<table><td>", "<nav>", "</nav>", "<form>", "<!doctype", "<![if IE]>", "<h1>", "</h1><article>"]
    for _ in range(3000):
        html.main_blocks("".join(rng.choice(parts) for _ in range(rng.randint(1, 40))))


def _root(text):
    """The root by a plain recursion over the definition."""
    sha = lambda parts: hashlib.sha256(b"".join(parts)).digest()
    digests, section, sections = [], [], []
    for line in text.split("\n"):
        words = re.findall(r"\s*\S+\s*", line) if line.strip() else [line] if line else []
        groups, at = [], 0
        while at < len(words):
            groups.append("".join(words[at : at + merkle.LEAF]))
            at += merkle.LEAF
        digests.append(sha([sha([g.encode()]) for g in groups]))
    for d in digests:
        section.append(d)
        if d[0] % merkle.SECTION == 0:
            sections.append(sha(section))
            section = []
    sections.append(sha(section))
    return hashlib.sha256(b"text" + b"".join(sections)).hexdigest()


@pytest.mark.parametrize("text", ["", " ", "one", "a b c d", "  lead and trail \n\n third\tline \n", "x " * 1000 + "\n" + "y\n" * 50])
def test_the_root_is_the_recursive_hash(text):
    assert merkle.Tree(text).root == _root(text)
    assert merkle.sections_of(merkle.Tree(text).written) == merkle.Tree(text).sections


def test_texts_whose_short_leaf_digests_are_equal_have_different_roots():
    a, b = "w29009", "w116065"
    short = lambda x: hashlib.sha256(x.encode()).hexdigest()[: merkle.WIDTH]
    assert short(a) == short(b)
    for x, y in ((a, b), (f"first line\n{a} and so on\nlast", f"first line\n{b} and so on\nlast"), ("intro\n" + a, "intro\n" + b)):
        left, right = merkle.Tree(x), merkle.Tree(y)
        assert left.root != right.root and left.written != right.written
        assert len(merkle.edits(left.written, right.written)) == 1
