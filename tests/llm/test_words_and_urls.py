"""Phrases, spelling variants and url templates against plain versions, and odd inputs."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import collocations, spelling, urls

DOCS = "doc_id long, text string, lang string, word string, n double"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1.0) for i, (t, lang) in enumerate(rows)] + [(None, "No id here", "en", None, None)], DOCS)


def phrases(rows, least, top, share):
    """{(lang, rank): (phrase, a, l, r, n, score)}, counting all runs of words."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lower(text)):
            words = re.findall(r"[^ \t]+", piece)
            n[lang or "und"] += len(words)
            f.update((lang or "und", *words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    out = {}
    for lang in n:
        kept = []
        for gram, a in f.items():
            if gram[0] != lang or len(gram) < 3 or a < least:
                continue
            w = gram[1:]
            if len(w) == 2 and any(b >= least and g[0] == lang and len(g) == 4 and w in (g[1:3], g[2:]) and 100 * b >= share * a for g, b in f.items()):
                continue
            cuts = [(10**6 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out[lang, rank] = (phrase.decode(), -a, left, right, n[lang], -score)
    return out


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    pool = ["the", "of", "new", "york", "city", "é", "Über", "日本", "a\x00b", "x", "y"]
    rows = [(" ".join(rng.choice(pool, rng.integers(0, 30))).replace(" x ", rng.choice([" x, ", "  x\t", ".x\n"])), rng.choice(["en", "de"])) for _ in range(150)]
    rows += [("New York City council met", "en")] * 12 + [("one two three four five six", None)] * 11 + [("go go go go", "und")] * 10
    return rows + [(None, "en"), ("", "fr"), (" .,! \n", "fr"), ("word " * 3000, "de"), ("New York City council met", "en")]


@pytest.mark.parametrize(("least", "top", "share", "block"), [(10, 2000, 50, 1 << 23), (3, 25, 80, 64)])
def test_phrases_against_all_runs(spark, texts, least, top, share, block):
    got = collocations.collocations(table(spark, texts), least, top, share, block).collect()
    want = phrases([*texts, ("No id here", "en")], least, top, share)
    assert {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got} == want and len(got) == len(want)
    if least == 10:
        through = {r.phrase: r.path_words for r in got if r.lang == "und"}
        assert through["two three four"] == 6 and {r.path_words for r in got if r.phrase == "city council met"} <= {3, 4, 5}


def test_phrases_of_nothing(spark, texts):
    docs = table(spark, texts)
    assert collocations.collocations(docs.where("false")).count() == 0
    assert collocations.collocations(docs.where("text is null or text = ''")).count() == 0


def test_edges_of_many_distinct_words(spark):
    # So many that three ids don't fit into 64 bits at once.
    words = [f"w{i:x}" for i in range(2_200_000)]
    found = spark.createDataFrame([(" ".join(words), "en")], "text string, lang string").mapInArrow(lambda b: collocations._edges(b, 1 << 30), "lang string, node string, next string, n long")
    assert found.agg(F.count("*"), F.sum("n"), F.count("next")).first()[:] == (2_200_000, 2_200_000, 2_199_998)
    assert found.where("node = 'w0 w1'").first()[:] == ("en", "w0 w1", "w2", 1)


def within_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def spelled(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[a-z\u00c0-\u00ff]+", lower(text)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: [x for x in words if within_one(w, x)] for w in words}
    best = {w: min(near[w], key=lambda x: (-words[x], x)) for w in words if near[w]}
    form = {w: best[w] for w in best if words[best[w]] >= 2 * words[w]}
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w, ""), root, words[w], len(near[w]), words[form[w]] if w in form else -1))
    return sorted(out)


@pytest.mark.parametrize("crowded", [1, spelling.CROWDED])
def test_variants_against_all_pairs(spark, crowded):
    rng = np.random.default_rng(6)
    stems = ["receive", "recieve", "maßstab", "maßtab", "naïve", "abcde", "aaaaa", "aaaaaa", "aaaaaaa", "àéîõü"]
    alphabet = list("abcdeéß")
    made = set(stems)
    for s in stems:
        for _ in range(25):
            i = int(rng.integers(0, len(s) + 1))
            made |= {s[:i] + str(rng.choice(alphabet)) + s[i:], s[:i] + s[i + 1 :], s[:i] + str(rng.choice(alphabet)) + s[i + 1 :]}
    pool = sorted(made)
    share = rng.pareto(1.0, len(pool)) + 0.05
    rows = [(i, " ".join(rng.choice(pool, 60, p=share / share.sum()))) for i in range(120)]
    rows += [(None, "Receive RECEIVE réceive receiveÉ"), (7, None), (8, ""), (9, "123 -- 日本語 ab"), (5, rows[5][1]), (5, rows[5][1]), (400, "longword " * 5000)]
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "doc_id long, text string, word string, n int, form string")
    got = spelling.variants(docs, crowded=crowded).collect()
    assert sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in got) == spelled(rows)
    assert spelling.variants(docs.where("false")).count() == 0
    with pytest.raises(ValueError, match="code points"):
        spelling.variants(docs, letters=3)


ODD_URLS = [None, "", "no scheme/path", "://", "http://", "HTTP://EXAMPLE.COM", "http://Example.COM/en/1", "http://a.example.com/en/1?x#y", "http://www.example.com/en/1", "http://notexample.com/en/", "http://x.net/es/2", "http://net/fr/3", "http://x.internet/es/2", "ftp://é.net/fr/ü?ü", "http://a.com?x/en/", "http://a.com#/en/", "http://b.org//", "http://b.org/a/b/c/d/e/f/g/1/2", "http://u:p@b.org:80/0123456789abcdef01/", "a://b.com/c://d.net/es/", "http://x.net\n/es/1", "http://m.org/123e4567-e89b-12d3-a456-426614174000/x.html"]


def judged(pages):
    con = duckdb.connect()
    con.register("pages", pages)
    return con.sql(urls.OP11_SQL).df()


def test_urls_against_sql(spark):
    rng = np.random.default_rng(7)
    made = [f"http://{h}/{rng.choice(['news', 'tag', 'es', 'fr', 'en'])}/{s}" for h in ("hot.net", "b.org", "c.com") for s in [f"slug-{chr(97 + i % 26)}{chr(97 + i // 26)}.html" for i in range(200)] + ["top/"] * 60 + [str(i) for i in range(150)]]
    made += [f"http://hot.net/{chr(97 + i % 26)}{chr(97 + i // 26)}x/{i % 7}/{'abcdefg'[i % 7]}" for i in range(300)]
    pages = pd.DataFrame({"page_id": [None, *range(len(ODD_URLS) + len(made) - 1)], "url": ODD_URLS + made}).astype({"page_id": "Int64"})
    pages = pd.concat([pages, pages.head(30)])
    df = spark.createDataFrame([(None if pd.isna(i) else int(i), u, "x", "y", 0) for i, u in pages.itertuples(index=False)], "page_id long, url string, host string, rule string, n int")
    got, want = urls.judge(df, urls.RULES).withColumn("purity", F.round("purity", 6)).toPandas(), judged(pages)
    plain = lambda f: sorted(tuple("null" if pd.isna(v) else str(int(v)) if c == "page_id" else f"{v:.5f}" if c == "purity" else v for c, v in zip(sorted(f.columns), r, strict=True)) for r in f[sorted(f.columns)].astype(object).itertuples(index=False))
    assert plain(got) == plain(want) and len(got) == len(pages)
    by_url = {u: (r, v) for u, r, v in df.select("page_id", "url").where("page_id is not null").join(urls.judge(df, urls.RULES).select("page_id", "rule", "verdict"), "page_id").select("url", "rule", "verdict").collect()}
    assert by_url["http://www.example.com/en/1"] == ("www.example.com/en/", "allow") and by_url["http://a.example.com/en/1?x#y"] == ("example.com/en/", "block")
    assert by_url["http://net/fr/3"] == ("net/fr/", "block") and by_url["http://x.internet/es/2"][0] is None and by_url["http://notexample.com/en/"][0] == "com/"
    assert by_url["http://a.com?x/en/"][0] is None and by_url["no scheme/path"] == (None, "allow")
    assert {"*", "~"} <= {t for r in got.template for t in r.split("/")}
    assert urls.judge(df.where("false"), urls.RULES).count() == 0


def test_templates_spread_bad_labels(spark):
    rows = [(i, f"http://shop.net/item/{w}{w}/{i}") for i, w in enumerate("abcdefghijklmnopqrstuvwxyz" * 4)] + [(1000 + i, f"http://shop.net/about/{i}") for i in range(40)]
    rules = [urls.Rule(False, "shop.net", f"/item/{w}{w}/") for w in "abcdefghijklmnopqrstuvwxy"] + [urls.Rule(True, "shop.net", "/about/1")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert all(got[i].rule is None and got[i].verdict == "block" for i in range(25, 104, 26))
    assert all(got[1000 + i].verdict == "allow" for i in range(40))
    with pytest.raises(ValueError, match="rules"):
        urls.judge(spark.createDataFrame(rows, "page_id long, url string"), [urls.Rule(True, f"h{i}") for i in range(501)]).count()
