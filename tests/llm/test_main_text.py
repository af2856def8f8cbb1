"""Main text of hand-made pages, of random pages against a plain version of the rules, and of broken markup."""

import random
from html.parser import HTMLParser

import pytest
from vivabank.llm import main_text
from vivabank.llm.main_text import main_text as extract

LONG = "The cat sat on the mat and it was not in a hurry, for the day was long and the sun was out on the roof of the house. " * 2
LONG = LONG.strip()


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("   ", ""),
        ("just words", ""),
        (f"<p>{LONG}</p>", LONG),
        (f"<p>{LONG}<p>Short one.<p>{LONG}", f"{LONG} Short one. {LONG}"),
        ("<article>two words</article>", "two words"),
        ("<article><p>a&amp;b &lt;i&gt; &#233;&nbsp;x &copy 5 &am</p></article>", "a&b <i> é x © 5 &am"),
        ("<article>a<b>b</b>c<br>d \t\n e<hr>f</article>", "abc d e f"),
        ("<nav>menu</nav><article><h1>T</h1><p>x</p></article><footer>f</footer>", "T x"),
        ("<article><h1>T</h1><nav>n</nav><p>x<aside>s</aside></p><div class='ad-box'>buy</div><p>y</p></article>", "T x y"),
        ("<article><header><h1>T</h1><p>by me</p></header><p>x</p><footer>tags</footer></article>", "T x"),
        ("<article><p>x</p><section id=comments><article class=comment>c</article></section></article>", "x"),
        ("<script>var a='<p>no</p>';</script><style>p{}</style><article>x<script>no</script>y</article>", "xy"),
        ("<article>x<!-- <p>no</p> -->y<![CDATA[no]]>z<?no?></article>", "xyz"),
        ("<article>1 < 2 and a<b>3</b></article>", "1 < 2 and a3"),
        ('<article><p title="a > b" data-x=\'<p>\'>x</p><p class=5">y</p></article>', "x y"),
        ("<article><form>f<input value=v><button>go</button></form>x<noscript>n</noscript><textarea>t</textarea></article>", "x"),
        ("<div class='cookie-notice'>We use cookies</div><main>x</main>", "x"),
        ("<body class='has-sidebar no-comments'><div id=content><p>short text</p></div><div class=sidebar>s</div></body>", "short text"),
        ("<div style='display: none'>n</div><article>x<span hidden>h</span><i aria-hidden=true>*</i></article>", "x"),
        ("<ARTICLE><P>Up<SCRIPT>no</Script ></P></ARTICLE>", "Up"),
        ("<article><p>cut off in a <a href='x", "cut off in a"),
        ("<article><p>cut &am", "cut &am"),
        ("<article><ul><li>one<li>two</ul><ul><li><a href=a>See this</a><li><a href=b>and that</a></ul></article>", "one two"),
        (f"<p>{LONG}</p><h2>More</h2><ul><li><a href=a>first link of some</a></li><li><a href=b>second link</a></li></ul>", LONG),
        (f"<p><a href=a>Home</a> <a href=b>News</a></p><p>{LONG}</p><p>© 2020 Somebody</p>", LONG),
        ("<p>odd zzz words qqq only www here, xxx as vvv nobody uuu writes ttt them sss down rrr</p>", ""),
    ],
)
def test_pages(page, text):
    assert extract(page) == text


class _Plain(HTMLParser):
    """Blocks of well-formed pages of a few elements, by the standard parser."""

    def __init__(self):
        super().__init__()
        self.stack, self.rows, self.text, self.linked, self.links = [], [], "", 0, 0

    def _close(self):
        text = " ".join(self.text.split())
        if text:
            tag = next((t for t in reversed(self.stack) if t not in ("a", "b")), "body")
            self.rows.append((text, self.linked, self.links, tag, "nav" in self.stack or "footer" in self.stack, "article" in self.stack))
        self.text, self.linked, self.links = "", 0, 0

    def handle_starttag(self, tag, attrs):
        if tag not in ("a", "b"):
            self._close()
        self.links += tag == "a"
        self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag not in ("a", "b"):
            self._close()
        self.stack.pop()

    def handle_data(self, data):
        self.text += data
        if "a" in self.stack:
            self.linked += len(data.replace(" ", ""))


def _plain(page):
    parser = _Plain()
    parser.feed(page)
    parser.close()
    inside = any(r[5] and not r[4] for r in parser.rows)
    rows = [r for r in parser.rows if not r[4] and (r[5] or not inside)]

    def first(r):
        text, linked, links, tag, *_ = r
        if linked > 0.4 * len(text):
            return None if inside and links < 2 and tag not in ("li", "td", "dd") else False
        if not inside and len(text) < 70 and linked:
            return False
        words = [w.strip(".,") for w in text.lower().split()]
        share = sum(w in main_text.STOP_WORDS for w in words) / len(words)
        if len(text) >= 200 and share >= 0.25:
            return True
        return None if len(text) < 70 or inside or share >= 0.12 else False

    labels = [first(r) for r in rows]
    out = []
    for i, r in enumerate(rows):
        good = labels[i]
        if good is None:
            far = len(rows) + 1
            left = next(((i - j, labels[j]) for j in range(i - 1, -1, -1) if labels[j] is not None), (i + 1 if inside else far + i + 1, inside))
            right = next(
                ((j - i, labels[j]) for j in range(i + 1, len(rows)) if labels[j] is not None),
                (len(rows) - i if inside else far + len(rows) - i, inside),
            )
            if left[1] == right[1]:
                good = left[1]
            elif r[3] in ("h1", "h2"):
                good = right[1]
            else:
                good = inside or (left[0] != right[0] and min(left, right)[1])
        if good:
            out.append(r[0])
    return " ".join(out)


def _random_page():
    words = ["the", "of", "and", "le", "zzz", "cat", "Haus", "é&amp;", "qqq.", "der"]
    say = lambda: " ".join(random.choices(words, k=random.choice([1, 4, 12, 30, 60])))
    parts = []
    for _ in range(random.randrange(12)):
        tag = random.choice(["p", "p", "p", "li", "h2", "td", "div"])
        inner = random.choice([say(), say(), f"<a href='x'>{say()}</a>", f"{say()} <a href='x'>{say()}</a> <b>{say()}</b>"])
        parts.append(f"<{tag}>{inner}</{tag}>")
    body = "\n".join(parts)
    if random.random() < 0.5:
        body = f"<p>{say()}</p><article>{body}</article><p>{say()}</p>"
    return f"<html><body><nav><p>{say()}</p></nav>{body}<footer>{say()}</footer></body></html>"


def test_random_pages_against_a_plain_version():
    random.seed(12)
    kept = 0
    for _ in range(600):
        page = _random_page()
        assert extract(page) == _plain(page), page
        kept += bool(extract(page))
    assert 200 < kept < 600


def test_hostile_pages_end_soon():
    for page in ("<b>" * 60_000 + "</i>" * 60_000, "<p " + "a='" * 50_000, "<!--" * 50_000, "<div><" * 30_000, "<a href=" * 30_000, "&" * 200_000):
        extract(page)
    assert extract("<article>" + "<div>" * 20_000 + "deep") == "deep"


def test_table_of_pages(spark):
    long = "<article>" + f"<p>{LONG}</p>" * 30_000 + "</article>"
    rows = [(1, "u", "<article>é</article>", "old", 9), (1, "u", "<article>é</article>", "old", 9), (None, None, None, None, None), (2, "v", "", "x", 1), (3, "w", long, "", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, N_Chars long")
    out = main_text.extract_pages(pages)
    assert out.columns == ["page_id", "url", "html", "text", "n_chars"]
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in out.collect())
    whole = " ".join([LONG] * 30_000)
    assert got == [(0, "", 0), (1, "é", 1), (1, "é", 1), (2, "", 0), (3, whole, len(whole))]
    assert main_text.extract_pages(pages.limit(0)).count() == 0
