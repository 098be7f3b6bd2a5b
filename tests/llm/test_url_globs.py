import fnmatch
import random

import numpy as np
from pyspark.sql import functions as F

from quern.llm import url_globs as u


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    best = None
    for verdict, h, p in u.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = verdict, h + p
    return host, path, best and best[1], best[0] if best else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://EXAMPLE.COM/en/x?y#z", "http://example.com/en", "http://example.com/EN/",
    "https://www.example.com/en/1", "https://a.www.example.com/en/1", "http://notexample.com/en/", "http://net/es/1", "http://x.net/fr/?q", "http://x.net?/fr/",
    "http://x.org/a.com/b", "http://ÉX.com/é/", "http://com/" + "a/" * 5000, "ftp://u:p@h.net:80/es/", "a://b://c.com/", "http://x.com#/en/", "http://a\nb.com/en/",
]


def test_rows(spark):
    rows = [(i, x, "other", "h") for i, x in enumerate(URLS)] + [(None, URLS[6], "o", "h"), (6, URLS[6], "o", "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string, html string")
    got = u.judge(pages, step=5).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == plain(r.url), r.url
    assert u.judge(pages.where(F.lit(False))).count() == 0


def test_automaton_against_fnmatch_over_many_words():
    rnd = random.Random(3)
    globs = ["".join(rnd.choice("ab*?") for _ in range(rnd.randint(0, 9))) for _ in range(60)] + ["*" + "ab" * 50 + "*"]
    texts = ["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 12))) for _ in range(200)] + ["ab" * 60, ""]
    engine = u.ShiftAnd([u.glob(g) for g in globs])
    assert engine.words > 4
    hit = engine.match([np.frombuffer(t.encode(), dtype=np.uint8).astype(np.int16) for t in texts])
    assert hit.tolist() == [[fnmatch.fnmatchcase(t, g) for g in globs] for t in texts]


def test_columns_with_the_names_inside(spark):
    pages = spark.createDataFrame([(1, "http://a.example.com/en/x", "f", "h", "p")], "page_id long, url string, _fit string, host string, parts string")
    got = u.judge(pages)
    assert sorted(got.columns) == ["_fit", "host", "page_id", "parts", "path", "rule", "url", "verdict"]
    assert got.select("_fit", "parts", "host", "rule").first() == ("f", "p", "a.example.com", "example.com/en/")
