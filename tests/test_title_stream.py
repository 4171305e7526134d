"""Near-equal titles and known URLs over micro-batches, against a plain fold."""

import random

from test_streaming import stream, write

from claimweave.streaming.titles import KeptArticles, dedup_title_stream

SCHEMA = "article_id long, title string, url string, source_api string, published_at string"
FEEDS = ["newsapi", "gnews", "mediastack"]


def plain(batches):
    """The ids that stay, one article after the other."""
    urls, titles, out = set(), [], []
    for rows in batches:
        for i, title, url, feed, _ in sorted(rows, key=lambda r: (FEEDS.index(r[3]), r[4], r[0])):
            words = set((title or "").lower().split())
            if feed != "newsapi":
                near = any(words and len(words & w) / len(words | w) > 0.8 for w in titles)
                if (url and url in urls) or near:
                    continue
            out.append(i)
            urls.add(url)
            if words:
                titles.append(words)
    return sorted(out)


def made(rng, n):
    stems = [[f"word{rng.randrange(60):02d}" + "x" * rng.randrange(4) for _ in range(rng.randrange(5, 13))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = list(rng.choice(stems))
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"other{rng.randrange(9)}"
        title = rng.choice(["", None]) if i % 17 == 0 else " ".join(words).title()
        rows.append((i, title, rng.choice(["", None, f"http://u/{rng.randrange(n)}"]), rng.choice(FEEDS), f"2024-01-{1 + rng.randrange(28):02d}"))
    return rows


def test_batches_equal_the_fold(spark, tmp_path):
    rng = random.Random(4)
    rows = made(rng, 90)
    batches = [rows[:50], rows[50:]]
    kept = KeptArticles(spark, str(tmp_path / "kept"), buckets=4)
    got = []
    for i, batch in enumerate(batches):
        df = spark.createDataFrame(batch, SCHEMA)
        got += [r["article_id"] for r in kept.admit(df, f"b{i}").collect()]
    want = plain(batches)
    assert sorted(got) == want and 20 < len(want) < 85
    again = [r["article_id"] for r in kept.admit(spark.createDataFrame(batches[1], SCHEMA), "b1").collect()]
    assert sorted(again) == [i for i in want if i >= 50]


def test_stream(spark, tmp_path):
    path = str(tmp_path / "in")
    batches = [
        [(1, "Solar power is cheap in all of Spain now", "u1", "newsapi", "2024-01-01"), (2, "Solar power is cheap in all of Spain", "u2", "gnews", "2024-01-01")],
        [(3, "solar power IS cheap in all of spain now", "u3", "gnews", "2024-01-02"), (4, "New title", "u1", "gnews", "2024-01-02"), (5, "Third title", "u5", "newsapi", "2024-01-03")],
        [(6, "Third title", "u6", "newsapi", "2024-01-04"), (7, "Wholly other words here", "", "mediastack", "2024-01-04")],
    ]
    for i, rows in enumerate(batches):
        write(spark, rows, SCHEMA, path, i)
    kept = KeptArticles(spark, str(tmp_path / "kept"), buckets=2)
    out = str(tmp_path / "out")
    dedup_title_stream(stream(spark, SCHEMA, path), kept, out, str(tmp_path / "cp")).awaitTermination(300)
    assert sorted(r["article_id"] for r in spark.read.parquet(out).collect()) == plain(batches) == [1, 5, 6, 7]
