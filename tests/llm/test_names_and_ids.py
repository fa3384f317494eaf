"""Names of page parts, letters, and tables in which a third of the rows has no id."""
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wattloom.llm import exchange, html_text, langid, packing, sharding, suffix_dedup

STORY = "<p>First paragraph of the story with enough words to be read as text.</p><p>Second paragraph, which follows the first one.</p>"
TEXT = "First paragraph of the story with enough words to be read as text.\nSecond paragraph, which follows the first one."


@pytest.mark.parametrize("page", ['<body class="has-sidebar"><div class="content">%s</div></body>', '<body class="single comments-open"><article>%s</article></body>',
                                  '<article class="post has-comments">%s</article>', '<div class="content with-sidebar">%s</div>', '<main><section id="social-history">%s</section></main>',
                                  '<article><section id="discussion">%s</section></article>', '<html class="no-banner"><main class="menu-open">%s</main></html>'])
def test_states_and_topics_are_no_parts(page):
    assert html_text.main_text(page % STORY) == TEXT


@pytest.mark.parametrize("part", ['<div class="site-footer">%s</div>', '<div id="sidebar">%s</div>', '<div class="cookie-banner">%s</div>', '<ul class="share-buttons"><li>%s</li></ul>',
                                  '<div class="acme-newsletter">%s</div>', '<section class="post-comments">%s</section>', '<div class="ad-slot-1">%s</div>', '<div role="navigation">%s</div>'])
def test_parts_go_beside_an_article_and_inside(part):
    side = part % "Short words that no reader of the article wants to see here."
    assert html_text.main_text(f"<body>{side}<article>{STORY}</article></body>") == TEXT and html_text.main_text(f"<article>{STORY}{side}</article>") == TEXT


def test_letters_are_letters():
    for t in ["²", "½ ¼", "١٢", "12 _ -", "", None, "‍"]:
        assert not langid.has_letter(t)
    for t in ["a", "² b", "漢", "é", "ª"]:
        assert langid.has_letter(t) == any(map(str.isalpha, t))


@pytest.fixture(scope="module")
def third(spark):
    """300 documents, each third without an id; some texts repeat."""
    rows = [(None if i % 3 == 0 else i, f"text number {i % 90} " + "word and word " * (i % 60)) for i in range(300)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(6)


def test_blocks_by_text_spread_rows_without_id(third, monkeypatch):
    rows, d = third
    monkeypatch.setattr(exchange, "block_count", lambda *a, **k: 12)
    one, many = (Counter(r.block for r in exchange.blocked(d, by_text=x)[0].collect()) for x in (False, True))
    assert max(one.values()) >= 100 and max(many.values()) < 70 and one.total() == many.total() == 300


def test_shards_and_packing_without_ids(third, monkeypatch):
    rows, d = third
    s = sharding.shard_documents(d, sharding.regular_tree(24), sharding.regular_tree(25)).collect()
    assert len(s) == 300 and all(sorted(r.slot for r in s if r.shard == k) == list(range(sum(r.shard == k for r in s))) for k in {r.shard for r in s})
    monkeypatch.setattr(packing, "PART_PIECES", 40)
    p = packing.pack_documents(d, size=64).collect()
    assert sum(r.length for r in p) == sum(len(packing.token_ids(t)) + 1 for _, t in rows)
    for q in {r.sequence_id for r in p}:
        at = sorted((r.offset, r.length) for r in p if r.sequence_id == q)
        assert at[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(at, at[1:])) and sum(n for _, n in at) <= 64


def test_suffix_dedup_without_ids(third):
    rows, d = third
    got = Counter((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.dedup(d, width=320, with_bytes=False).collect())
    texts = [t.encode() for _, t in rows]
    starts = Counter(t[i:i + 320] for t in texts for i in range(len(t) - 319))
    want = Counter()
    for (i, _), t in zip(rows, texts):
        gone = set()
        for a in range(len(t) - 319):
            if starts[t[a:a + 320]] > 1:
                gone.update(range(a, a + 320))
        want[i, len(t), len(gone)] += 1
    assert got == want and any(n for _, _, n in want)
