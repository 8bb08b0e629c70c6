"""The URL filter against its SQL, plain string tests, and lists of several files."""

from __future__ import annotations

import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tillroll.llm import urls

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
HARD = [
    None, "", "no scheme", "://", "http://", "http://net", "http://net/", "http://NET/x", "http://a.Net/", "http://anet/",
    "http://example.net/en/", "http://x.y.example.net/en/1?q=/de/", "http://example.net/en", "http://example.net?/en/",
    "http://example.net#/en/", "https://example.com/de/#top", "https://myexample.com/de/", "https://a.example.com/DE/",
    "ftp://u:p@b.example.com:80/de/", "http://org/fr/", "http://x.org/fr/a://net/", "http://x.org//fr/", "http://.net/",
    "http://..net/", "http://net./", "http://\u0130.NET/\u00e9\u65e5", "http://x.net/\n/en/", "a://b://example.net/en/",
    "http://" + "a." * 3000 + "net/", "http://x.org/fr/" + "y" * 100_000, "http://\u00c4.org/fr/", "http://\x00.net/",
]


def cut(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return host.translate(UPPER), re.match(r"[^?#]*", rest[len(host):]).group()


def plain(url, rules):
    host, path = cut(url)
    fits = [
        (len((h + p).encode()), len(h.encode()), h + p, a) for h, p, a in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    _, _, rule, action = max(fits, default=(0, 0, None, "allow"))
    return host, path, rule, action


def pages(spark, found):
    return spark.createDataFrame(
        [(k if k % 9 else None, u, "h", "p", k) for k, u in enumerate(found)],
        "page_id long, url string, host string, path string, rule int")


def test_rules_of_the_query(spark, tmp_path):
    found = [*HARD, *HARD[3:9]]
    given = pages(spark, found)
    given.write.parquet(str(tmp_path / "pages.parquet"))
    rows = sorted(repr(tuple(r)) for r in urls.op11_url_filter(spark, str(tmp_path)).collect())
    want = sorted(repr((k if k % 9 else None, *plain(u, urls.RULES))) for k, u in enumerate(found))
    assert rows == want
    db = duckdb.connect()
    db.register("pages", given.toArrow())
    assert sorted(repr(r) for r in db.sql(urls.SQL).fetchall()) == rows


@pytest.mark.parametrize("size", [3, urls.FILE_RULES])
def test_long_lists_in_several_files(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(urls, "FILE_RULES", size)
    rnd = random.Random(3)
    hosts = ["net", "a.net", "b.a.net", "org", "\u00e9.org", "c.org"]
    paths = ["/", "/e", "/en/", "/en/x", "/\u65e5/"]
    rules = [(h, p, rnd.choice(["allow", "block"])) for h in hosts for p in paths if rnd.random() < 0.8]
    found = [
        f"http://{rnd.choice(['', 'www.', 'x', 'A.', 'b.a.'])}{rnd.choice(hosts).upper()}{rnd.choice(['', '/', '/e', '/en/', '/en/xy', '/\u65e5/q'])}"
        for _ in range(400)
    ]
    listed = rules + [(h.upper(), p, "block") for h, p, a in rules[:5]] + [(None, None, None)]
    urls.write_list(spark.createDataFrame(listed, "host string, path string, action string"), str(tmp_path))
    # Only A-Z are lower-cased, so an upper-case accent is another host; repeated rules block.
    want = [(h, p, "block" if (h, p) in {(a, b) for a, b, _ in rules[:5]} else a) for h, p, a in rules]
    rows = urls.judge(pages(spark, found), str(tmp_path)).collect()
    assert sorted(repr(tuple(r)[1:]) for r in rows) == sorted(repr(plain(u, want)) for u in found)


def test_empty_tables_and_lists(spark, tmp_path):
    none = spark.createDataFrame([], "host string, path string, action string")
    urls.write_list(none, str(tmp_path / "none"))
    rows = urls.judge(pages(spark, HARD), str(tmp_path / "none")).collect()
    assert len(rows) == len(HARD) and {(r["rule"], r["verdict"]) for r in rows} == {(None, "allow")}
    assert urls.judge(pages(spark, HARD).limit(0), str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("rule", [("", "/", "block"), ("a/b", "/", "block"), ("net", "en/", "allow"), ("net", "/", "maybe"),
                                  ("net", None, "allow"), ("net", "/?x", "allow")])
def test_what_is_not_a_rule(spark, tmp_path, rule):
    with pytest.raises(Exception, match="not a rule"):
        urls.write_list(spark.createDataFrame([rule], "host string, path string, action string"), str(tmp_path / "x"))


def test_equal_digests_of_other_strings_are_no_hits():
    strings = ["a.net/", "b.net/", "c.net/", "d.net/"]
    digests = np.array([5, 7, 7, 7], np.int64)
    data = b"".join(urls._file(digests, pa.array(strings), np.array([5] * 4), np.array([1, 0, 1, 0])))
    file = urls.ListFile(pa.py_buffer(data))
    probe = ["c.net/", "d.net/", "x.net/", "a.net/", "b.net/", "a.net/"]
    found = file.find(np.array([7, 7, 7, 5, 7, 7], np.int64), pa.array(probe))
    assert found.tolist() == [2, 3, -1, 0, 1, -1]


def test_spark_and_library_digests_agree(spark):
    from pyspark.sql import functions as F

    texts = ["", "net/", "example.net/en/", "\u00e9" * 50]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t")).collect()
    want = np.array([xxhash.xxh64_intdigest(t.encode(), seed=urls.SEED) for t in texts], np.uint64).view(np.int64)
    assert [r[0] for r in rows] == want.tolist()
