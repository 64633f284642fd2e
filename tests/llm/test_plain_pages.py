"""op5 on plain pages and on articles with one unlucky class name; op1 and op7 on many equal rows."""

import pytest

from ladderwork.llm import decontamination, packing
from ladderwork.llm.extraction import main_text

LONG = "This is a paragraph of the article with a good number of words in it, as articles have them. " * 6


@pytest.mark.parametrize(
    "html, text",
    [
        ("<body><p>Short text</p></body>", "Short text"),
        ("<ul class=menu><li><a href=/>Home</a></ul><p>Text one.</p><p>Text two</p>", "Text one.\nText two"),
        ('<main><section class="newsletter-archive-content"><p>Body of the page about newsletters, long enough.', "Body of the page about newsletters, long enough."),
        ('<main class="main promo"><p>Body of the page, long enough.', "Body of the page, long enough."),
        ('<main class="main promo">' + f"<p>{LONG}</p>" * 8 + "</main>", "\n".join([LONG.strip()] * 8)),
        ('<div class="promo"><p>Buy now</p></div><article>' + f"<p>{LONG}</p></article>", LONG.strip()),
        ("<nav><a href=/>Home</a></nav><footer>Imprint</footer>", ""),
        ("<div class=comments><p>First!</p></div><div><p>" + LONG + "</p></div>", LONG.strip()),
        ("", ""), ("<script>x()</script>", ""),
    ],
)
def test_main_text(html, text):
    assert main_text(html) == text


def test_equal_rows_meet_their_windows_once_each(spark, monkeypatch):
    item = " ".join(f"w{k}" for k in range(10))
    docs = spark.createDataFrame([(1, f"a {item} b")] * 3000 + [(2, "clean words only")], "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    monkeypatch.setattr(decontamination, "small_enough", lambda *_: False)
    assert decontamination.hits(docs, bench).count() == 3000
    out = decontamination.contamination(docs, bench).groupBy("doc_id", "n_hit", "contaminated").count().collect()
    assert sorted(map(tuple, out)) == [(1, 10, True, 3000), (2, 0, False, 1)]


def test_equal_rows_are_dealt_over_the_shards(spark):
    docs = spark.createDataFrame([(1, "the same text in every row")] * 20_000, "doc_id long, text string").repartition(4)
    out = packing.packed(docs, packing.PackingParams(**{**packing.default_params().__dict__, "shard_pieces": 4096}))
    shards = out.selectExpr("sequence_id >> 32 AS shard").groupBy("shard").count().collect()
    assert len(shards) == 5 and max(r["count"] for r in shards) < 5000 and sum(r["count"] for r in shards) == 20_000
