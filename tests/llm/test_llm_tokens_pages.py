"""BPE against the library and HTML extraction on pages whose article is known."""

import hashlib
import html
import random
import re
import time

import public_tokenizers
from tokenizers import Tokenizer

from tablelens.llm import bpe
from tablelens.llm.html_text import extract

FILE = public_tokenizers.path("byte_bpe_50k.json")
THEIRS, OURS = Tokenizer.from_file(FILE), bpe.ByteBpe(bpe.tokenizer_file(FILE))


def test_random_texts():
    rnd = random.Random(1)
    letters = "abcdefgh theTHE'sllve  \n\t\x1c\x1d\x85\xa0​　éüß0123٣½Ⅷ日本語\U0001f600́\x00#$<|endoftext|>"
    for i in range(3000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60)))
        text += "<|endoftext|>" * (i % 5 == 0) + "hello" * (i % 7 == 0) * rnd.randint(1, 100)
        ids = THEIRS.encode(text, add_special_tokens=False).ids
        assert OURS.encode(text) == ids and OURS.decode(ids) == THEIRS.decode(ids, skip_special_tokens=False)


def test_long_words_and_a_full_memory(monkeypatch):
    text = "".join(random.Random(2).choice("etaoinshr") for _ in range(20_000))
    assert OURS.encode(text) == THEIRS.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    text = "one two three four five one two three four five " * 5
    assert OURS.encode(text) == THEIRS.encode(text, add_special_tokens=False).ids


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in bpe.query(spark, "/root/testdata/sf0.001").collect():
        ids = THEIRS.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids)))) and r.decoded_sha256 == sha(docs[r.doc_id])


def test_pages_of_the_corpus(spark):
    for (page,) in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect():
        article = page[page.index("<article>") + 9:page.rindex("</article>")]
        parts = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1)>", "\x01", article.replace("<br>", " "))).split("\x01")
        want = [" ".join(html.unescape(x).split()) for x in parts]
        assert extract([page]) == ["\n\n".join(x for x in want if x)]


def test_frames_of_other_pages():
    page = """<html><body class="has-sidebar"><header><h1>Site</h1></header><ul class="menu"><li><a href=1>One</a></ul>
    <div id='cookie-notice'>We use cookies, please accept all of them before you go on reading here.</div>
    <div class="layout with-sidebar"><main><article><h2>A  title</h2><p>First &lt;b&gt; &amp; <em>bold</em> words<p>x<div class=share><a>Tweet</a></div>
    <form><label>Your mail address so that we can write to you</label></form><section id="comments"><article class="comment">
    <p>I did like this post very much, thank you for it.</p></article></section></article></main></div>
    <aside><p>Popular posts that one should read and click and read again and again.</p></aside><script>document.write("<p>no</p>")</script>
    <style>p > a {color: red}</style><footer>Copyright, imprint, and a few more words that fill the line</footer></body></html>"""
    assert extract([page, "", "<!-- a <p>b</p> -->"]) == ["A title\n\nFirst <b> & bold words\n\nx", "", ""]


def test_heads_without_an_end_tag():
    words = "A long paragraph of some twenty words stands in the article here so that nobody could take it for a menu."
    article = f"<article><h1>Title</h1><p>{words}</p></article>"
    want = f"Title\n\n{words}"
    head = "<title>x</title><meta charset=utf-8><template><p>Not shown</template><style>p {}</style><script>var a = '<p>';</script>\n"
    for page in (
        f"<html><head>{head}<body>{article}</body></html>", f"<html><head>{head}{article}", f"<head>{head}<div>{article}</div>",
        f"<head><html>{head}<head><body>{article}", f"<head><template><b>Not shown<body>{article}", f"<head>{head}<svg>Not shown</svg>{article}",
        f"<html><head>{head}</head><body>{article}", f"<head>{head}<!-- no end --><BODY class=a>{article}",
    ):
        assert extract([page]) == [want], page
    assert extract([f"<head>{head}{words}"]) == [words]


LONG = "A long paragraph of some twenty words stands in the article here so that nobody could take it for a menu."


def test_unread_elements_without_an_end_tag_hide_text_up_to_the_next_block():
    for element in (
        "<button>Send", "<select><option>x<option>y", "<object>x", "<svg><path d=1>", "<datalist><option>x", "<template><b>x", "<textarea>", "<iframe>",
        "<noscript>", "<title>", "<button>One</button><button>Two", "<button>Two<p></p><button>One</button>", "<svg/><svg><svg></svg>", "<canvas><video>x",
    ):
        assert extract([f"<body><article><p>{LONG}</p>{element}<p>{LONG}</p></article>"]) == [f"{LONG}\n\n{LONG}"], element
    for element in ("<button><div>Send</div></button>", "<svg><svg><text>x</text></svg><p>x</svg>", "<template><p>x</p></template>", "<noscript><p>x</noscript>"):
        assert extract([f"<article><p>{LONG}</p>{element}<p>{LONG}</p></article>"]) == [f"{LONG}\n\n{LONG}"], element
    assert extract([f"<article><p>{LONG}</p><script>x = 1<p>{LONG}"]) == [LONG]  # a script without an end is code to the end


def test_ordinary_words_of_a_class_are_weak_signs():
    prose = f"<h2>Related work</h2><p>{LONG}<p>{LONG}"
    assert extract([f'<main><div class="related-work">{prose}</div></main>']) == [f"Related work\n\n{LONG}\n\n{LONG}"]
    links = "<h3>Related posts</h3><ul><li><a href=x>One title</a><li><a href=y>Another title here</a></ul>"
    assert extract([f'<main><p>{LONG}</p><div class="related-posts">{links}</div></main>']) == [LONG]
    for name in ("comment-body", "related", "cookie-banner x", "site-sidebar"):
        assert extract([f'<main><p>{LONG}</p><div class="{name}"><p>{LONG}</p></div></main>']) == [LONG], name


def test_time_grows_with_the_page_only():
    for page in ("<span>" * 70_000 + "</b>" * 140_000, "<div>" * 200_000, "<a<a" * 250_000, "<title>" * 150_000, "<button>x<p>" * 80_000, '<a "' * 250_000):
        start = time.process_time()
        extract([page])
        assert time.process_time() - start < 8
