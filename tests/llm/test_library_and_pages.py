"""Token ids against the library on random texts; article text that must stay and boilerplate that must go."""

import random

import numpy as np
import pyarrow as pa
import pytest

from hearthlog.llm import html_extract, token_output
from hearthlog.llm.registry import tokenizer_path


@pytest.mark.parametrize("seed", range(4))
def test_ids_are_those_of_the_library(seed):
    from tokenizers import Tokenizer

    rng = random.Random(seed)
    parts = ["<|endoftext|>", "<|", "|>", "\n", "\n\n", " ", "  ", "\t", "\r\n", " ", "　", "\x85", " ", "a", "word", "Word", "don't", "'ll", "'", "12", "3.5", "é", "ß", "漢字", "🙂", "...", "!", "-", "_", "end of text."]
    weights = [3, 1, 1, 6, 4, 12, 2, 1, 1, *[1] * 4, *[5] * 4, *[1] * 13]
    texts = ["end of text.\n\n<|endoftext|>Next text", "a\n\n<|endoftext|>", "<|endoftext|>\n\nb", " <|endoftext|> ", "x\n<|endoftext|>\n<|endoftext|>"]
    texts += ["".join(rng.choices(parts, weights, k=rng.randint(0, 25))) for _ in range(3000)]
    library = Tokenizer.from_file(tokenizer_path())
    encoder = token_output.Encoder(tokenizer_path(), 0, 500)
    for at in range(0, len(texts), 500):
        some = texts[at : at + 500]
        ids, n = encoder.encode_all(pa.array(some, pa.large_string()))
        got = [x[:-1].tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
        want = [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
        assert [t for t, a, b in zip(some, got, want, strict=True) if a != b] == []


TEXT = "This is a long sentence, which stands in the article, and goes on for a while, so that it counts. "


def page(inside, before="", after=""):
    return f"<html><body><nav><ul><li><a href=/>home</a></li></ul></nav>{before}<main><article><h1>Title</h1><p>{TEXT * 3}</p>{inside}<p>{TEXT * 2}end</p></article>{after}</main><footer>foot</footer></body></html>"


@pytest.mark.parametrize("inside,kept", [
    ("<!-->stays<p>here</p>", "here"), ("<!--->stays", "stays"), ("<!-- a --!>stays", "stays"),
    ("<h2>References</h2><ul><li><a href=1>First source</a></li><li><a href=2>Second source</a></li><li><a href=3>Third source</a></li></ul>", "Second source"),
    ('<p class="social-history">A social history</p>', "A social history"), ('<div class="banner-lord">The banner lord</div>', "The banner lord"), ('<p id="reply-all-storm">storm</p>', "storm"),
])
def test_article_text_stays(inside, kept):
    got = html_extract.main_text(page(inside)).split("\n")
    assert any(kept in x for x in got) and got[0] == "Title" and got[-1].endswith("end") and "foot" not in got


def test_articles_beside_stay():
    got = html_extract.main_text(page("", after=f"<article><h2>Second</h2><p>{TEXT}second</p></article>"))
    assert "Second" in got and got.endswith("second")


@pytest.mark.parametrize("inside", [
    '<div class="ad">gone</div>', '<div class="ad-slot">gone</div>', '<section class="comments">gone gone, gone</section>', '<ol class="comment-list"><li>gone</li></ol>', '<div id="commentsSection">gone</div>',
    '<div class="share-buttons">gone</div>', '<div class="newsletter-box wide">gone</div>', '<aside>gone</aside>', '<form>gone</form>', '<div class="related-posts"><a href=1>gone</a></div>', '<div class="cookie-notice">gone</div>', '<div role="navigation">gone</div>',
])
def test_boilerplate_goes(inside):
    assert "gone" not in html_extract.main_text(page(inside)) and "gone" not in html_extract.main_text(page("", before=inside))
