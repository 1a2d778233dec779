"""Pages, lists, leaks, classifiers and the pipeline."""

import datetime
import itertools
import os
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from sulatan.llm import decontamination, html_cut, quality_model, toxicity, url_filters
from sulatan.llm.decontamination import align

SF = "/root/testdata/sf0.01"


def test_main_text():
    page = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
    <div class="cookie-notice">We use cookies to improve things for you and everyone else.</div><header><h1>Site</h1></header>
    <nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- <p>gone</p> --><div id="content"><h2>A  title</h2><p>First   para of text, long
    enough &amp; fine &#233;.<p>Second &lt;x&gt;<b>bold</b><br>line<ul><li>one<li>two</ul><div class="ad">Buy this thing now, it is very cheap today.</div>
    <p>Ok.</p><aside>See also</aside><section class="comments"><h3>Comments</h3><p>I liked this because it was a long article and I read it all.</p></section>
    <form><p>Name</p><input></form></div><footer>&copy; x</footer>"""
    assert html_cut.main_text(page) == "A title\nFirst para of text, long enough & fine é.\nSecond <x>bold line\none\ntwo\nOk."
    for odd in (None, "", " ", "<", "<p", "<p a='x", "<script>x", "<!-- x", "</div></div>", "<a href='<p>'>" * 50):
        assert isinstance(html_cut.main_text(odd), str)
    assert html_cut.main_text(None) == ""


def test_main_text_of_wrapped_pages():
    text = "This is a whole sentence of a page, long enough to be taken as its content by anyone."
    body = f"<h2>A title</h2><p>{text}</p><p>{text}</p>"
    want = f"A title\n{text}\n{text}"
    for wrapper in ('div class="has-sidebar"', 'div class="with-sidebar"', 'div class="overflow-hidden"', 'div aria-hidden="false"', 'div data-hidden="no"', 'div class="header-page-wrap"', "form"):
        end = wrapper.split()[0]
        for inner, close in (("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<article class="x overflow-hidden">', "</article>")):
            assert html_cut.main_text(f"<html><head><title>T</title></head><body><{wrapper}>{inner}{body}{close}</{end}></body></html>") == want, (wrapper, inner)
    for tag in ('body class="overflow-hidden has-sidebar"', 'body aria-hidden="false"', 'body style="display:none"'):
        assert html_cut.main_text(f"<{tag}><article>{body}</article>") == want
    assert html_cut.main_text(f'<article><div class="entry-header"><h2>A title</h2></div><p>{text}</p><p>{text}</p></article>') == want
    for hidden in ("hidden", 'hidden=""', 'aria-hidden="true"', "style='color:red; display: none'"):
        assert html_cut.main_text(f"<article>{body}<div {hidden}><p>{text}</p></div></article>") == want
    other = f'<section class="comments"><article class="comment"><p>{text}</p><p>{text}</p><p>{text}</p><p>{text}</p></article></section>'
    assert html_cut.main_text(f"<div class='sidebar-left'><main>{body}</main>{other}</div>") == want
    assert html_cut.main_text(f"<div class='content'>{body}{body}</div><aside><article><p>{text}</p></article></aside>") == f"{want}\n{want}"
    for start in ("<head><title>T</title>", "<head>", "<svg><path d='1'>", "<select><option>x", "<embed src='x'>", "<noscript>", "<object>"):
        got = html_cut.main_text(f"<html>{start}<article>{body}</article>")
        assert got.endswith(want), start
    assert html_cut.main_text(f"<svg><text>no</text></svg><article>{body}</article>") == want


def test_main_text_by_structure():
    article = "<h1>Head line</h1><p>The article is this sentence.</p>"
    want = "Head line\nThe article is this sentence."
    remark = "<p>Reader said that this was a very long and interesting article for everybody here.</p>"
    for n in (1, 3, 40):
        listed = "".join(f'<div class="comment">{remark}</div>' for _ in range(n))
        for comments in (f'<section class="comments"><h3>Comments</h3>{listed}</section>', f'<div id="comments">{remark * n}</div>', f'<section class="comments"><article id="c1">{remark}</article></section>'):
            for page in (f"<article>{article}</article>{comments}", f"<article>{article}{comments}</article>", f"<main>{article}</main>{comments}", f"<div>{article}{comments}</div>"):
                assert html_cut.main_text(page) == want, page[:300]
        assert html_cut.main_text(f"<main>{article}{f'<article class=comment>{remark}</article>' * n}</main>") == want
    short = "<body><nav><a href=x>Home</a></nav><div><h1>Head line</h1><p>Five words are here now.</p></div><footer>Rights</footer></body>"
    assert html_cut.main_text(short) == html_cut.main_text("<body><div><h1>Head line</h1><p>Five words are here now.</p></div></body>") == "Head line\nFive words are here now."
    assert html_cut.main_text(f"<article>{article}<ul><li><a href=a>First one</a><li><a href=b>Second one</a></ul></article>") == f"{want}\nFirst one\nSecond one"
    assert html_cut.main_text(f'<article>{article}<div class="text search-tips"><p>Use few words.</p></div></article>') == f"{want}\nUse few words."


def test_odd_pages_take_linear_time():
    for page in (("<div>" * 10 + "</p>" * 5) * 14_000, "<p><article>" + "<div>" * 50_000 + "</p>" * 50_000, "<article><p>Text.</p>" + "<textarea>" * 90_000, "<p>x</b></i></p>" * 60_000):
        start = time.perf_counter()
        html_cut.main_text(page)
        assert time.perf_counter() - start < 30  # minutes where each tag looks at all open ones


def test_minimum_cut():
    rng = random.Random(4)

    def cost(label, lean, edges):
        return sum(max(0.0, -x if s else x) for s, x in zip(label, lean)) + sum(w for (a, b), w in edges.items() if label[a] != label[b])

    for _ in range(200):
        n = rng.randint(1, 8)
        lean = [rng.uniform(-1.5, 1.5) for _ in range(n)]
        edges = {(a, b): rng.uniform(0, 1.2) for a, b in (sorted(rng.choices(range(n), k=2)) for _ in range(10)) if a < b}
        best = min(cost(s, lean, edges) for s in itertools.product([False, True], repeat=n))
        assert cost(html_cut.min_cut(lean, edges), lean, edges) == pytest.approx(best)


def test_extract_rows(spark):
    rows = [(1, "u", "<p>Hello there, this is a whole sentence of a page.</p>", 5), (1, "u", None, 5), (None, None, "", 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted((tuple(r) for r in html_cut.extract(df).collect()), key=str)
    text = "Hello there, this is a whole sentence of a page."
    assert got == sorted([(1, "u", text, len(text)), (1, "u", "", 0), (None, None, "", 0)], key=str)
    assert html_cut.extract(df.where("false")).count() == 0


def test_url_filters(spark):
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(n)
    rng = random.Random(6)
    hosts = ["a.b.c", "B.c", "c", "x.y", ""]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/p", "/p/q?z", "/p//q#t")] + [None, "/p", "https://u:p@a.b.c:80/p"]
    captures = [(i, rng.choice(urls), day(rng.randint(0, 200)), "k") for i in range(200)] + [(None, urls[0], None, "k"), (0, urls[0], day(3), "k"), (0, urls[0], day(3), "k")]
    entries = [(rng.choice(["block", "allow", "watch"]), rng.choice(["d:a.b.c", "d:c", "d:b.c", "p:a.b.c/p", "p:b.c/p/q", "d:y"]), day(rng.randint(-50, 220)), rng.choice(["add", "remove", "add"])) for _ in range(120)]
    entries += [(None, "d:c", day(1), "add"), ("block", "d:c", day(1), "other"), ("block", None, None, "add")]
    got = url_filters.evaluate(spark.createDataFrame(captures, "page_id long, url string, day date, key string"), spark.createDataFrame(entries, "list string, key string, day date, action string"))
    latest: dict = {}
    for name, key, when, action in entries:
        if name and key and when and action in ("add", "remove"):
            latest.setdefault((name, key), {})[when] = max(action, latest.get((name, key), {}).get(when, action))

    def brute(url, when):
        if not url or "//" not in url or when is None:
            return 0, "", False
        rest = url.split("//", 1)[1].split("?")[0].split("#")[0]
        host = rest.split("/")[0].rpartition("@")[2].split(":")[0].lower()
        steps = [s for s in rest.split("/")[1:] if s]
        labels = host.split(".")
        keys = {"d:" + ".".join(labels[i:]) for i in range(len(labels))} | {f"p:{host}/" + "/".join(steps[: i + 1]) for i in range(len(steps))} if host else set()
        on = [n for (n, k), days in latest.items() if k in keys and any(d <= when for d in days) and days[max(d for d in days if d <= when)] == "add"]
        return len(on), ",".join(sorted(set(on))), "block" in on and "allow" not in on

    want = sorted(((i, u, d, *brute(u, d)) for i, u, d, _ in captures), key=str)
    assert sorted(((r["page_id"], r["url"], r["day"], r["n_matches"], r["lists"], r["blocked"]) for r in got.collect()), key=str) == want
    assert url_filters.evaluate(spark.createDataFrame([], "page_id long, url string, day date"), spark.createDataFrame([], "list string, key string, day date, action string")).count() == 0


def _score(a, b):
    row, best = [0] * (len(a) + 1), 0
    for y in b:
        new = [0]
        for k, x in enumerate(a):
            new.append(max(0, row[k] + (1 if x == y else -1), row[k + 1] - 1, new[k] - 1))
        row, best = new, max(best, *new)
    return best


def test_alignment():
    rng = np.random.default_rng(3)
    windows, items = rng.integers(1, 5, (40, 30)).astype(np.uint64), rng.integers(1, 5, (40, 12)).astype(np.uint64)
    lengths = rng.integers(1, 13, 40)
    want = [_score(list(w), list(t[:n])) for w, t, n in zip(windows, items, lengths)]
    assert align(windows, items, lengths).tolist() == want


def test_leaks(spark):
    rng = random.Random(9)
    vocab = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(500)]
    text = lambda n: rng.choices(vocab, k=n)
    items = [(i, " ".join(text(30))) for i in range(12)] + [(50, None), (51, ""), (None, "x y z"), (52, "Two words")]
    docs, want = [], set()
    for i in range(60):
        body = text(120)
        if i < 24:
            leak = items[i % 12][1].split()
            if i >= 12:  # edited copies
                for k in rng.sample(range(30), 4):
                    leak[k] = rng.choice(vocab)
                del leak[rng.randrange(30)]
            body[40:40] = leak
            want.add((i, i % 12))
        docs.append((i, " ".join(body).upper() if i % 5 == 0 else ", ".join(body), "s"))
    docs += [(70, None, "s"), (71, "", "s"), (72, "two  words!", "s")]
    want.add((72, 52))
    got = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(4), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string, score string"), empty).count() == 0


def _area(rows, label):
    """Chance that a row of label 1 scores above one of label 0."""
    one = np.array([r["score"] for r in rows if label[r["doc_id"]] == 1])
    none = np.array([r["score"] for r in rows if label[r["doc_id"]] == 0])
    return ((one[:, None] > none).mean() + 0.5 * (one[:, None] == none).mean())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("kind, scores, least", [("toxic", toxicity.toxicity, 0.8), ("quality", quality_model.quality_scores, 0.95)])
def test_held_out_accuracy(spark, kind, scores, least):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    extra = spark.createDataFrame([(10**9, None), (10**9 + 1, ""), (None, "of the"), (10**9 + 2, "word " * 50000)], "doc_id long, text string")
    rows = scores(docs.select("doc_id", "text").union(extra), labels).collect()
    assert len(rows) == docs.count() + 4 and all(0 <= r["score"] <= 1 for r in rows)
    label = {r["doc_id"]: r[kind] for r in labels.collect()}
    assert _area([r for r in rows if r["held_out"] and r["doc_id"] in label], label) >= least
    none = scores(docs.limit(3), labels.where("false")).collect()
    assert [r["score"] for r in none] == [0.5] * 3
    assert scores(docs.where("false"), labels).count() == 0


def _kneser_ney(texts, others, word, before):
    """p(word | before) in the class of ``texts``, as the textbook has it; pairs count once per text, both classes share the last order."""
    c = Counter(p for t in texts for p in set(zip([None] + t, t)))
    shared = set(c) | {p for t in others for p in zip([None] + t, t)}
    follow = Counter(w for _, w in c)
    q = sum(w == word for _, w in shared) / len(shared)
    own = max(follow[word] - 0.75, 0) / len(c) + 0.75 * len(follow) / len(c) * q
    size = sum(n for (u, _), n in c.items() if u == before)
    if not size:
        return own
    kinds = sum(u == before for u, _ in c)
    return max(c[before, word] - 0.75, 0) / size + 0.75 * kinds / size * own


def test_models_are_kneser_ney(spark):
    rng = random.Random(3)
    texts = [(" ".join(rng.choices(["a", "b", "c", "dd", "e"], [5, 3, 2, 1, 1], k=rng.randint(1, 8))) + (" zz yy" if i % 4 == 0 else ""), int(i % 3 == 0)) for i in range(40)]
    train = spark.createDataFrame(texts, "text string, label int").repartition(3)
    asked = ["a b c", "zz yy", "yy zz a", "dd", "c c e a b", "zz"]
    ask = spark.createDataFrame([*enumerate(asked), (0, "a b c"), (0, "zz"), (6, "")], "doc_id long, text string")
    model, rest = toxicity.fit_counts(train)
    got = sorted((r["doc_id"], r["x"][0]) for r in toxicity.text_features(ask, model, rest).collect())
    toxic, other = ([t.split() for t, y in texts if y == k] for k in (1, 0))
    words = set("a b c dd e zz yy".split())
    for side, rest_of in ((toxic, other), (other, toxic)):
        assert sum(_kneser_ney(side, rest_of, w, "a") for w in words) == pytest.approx(1)
    ratio = lambda ws: np.mean([np.log(_kneser_ney(toxic, other, w, b) / _kneser_ney(other, toxic, w, b)) for b, w in zip([None, *ws], ws)])
    want = sorted([(i, ratio(t.split())) for i, t in enumerate(asked)] + [(0, ratio(["a", "b", "c"])), (0, ratio(["zz"])), (6, 0.0)])
    assert [i for i, _ in got] == [i for i, _ in want] and [x for _, x in got] == pytest.approx([x for _, x in want])


def test_counts_grow_with_the_texts(spark):
    # 200,000 labelled texts: a share of them would ask for four texts a word
    train = spark.range(200_000).selectExpr("case when id < 3 then 'zzrare zzword' else 'plain' end as text", "int(id < 100) as label")
    model, _ = toxicity.fit_counts(train)
    assert model.where("x is not null").count() == 4 and model.where("x is null").count() == 3
    assert model.where(f"x is null and n = {3 << 32}").count() == 2


def test_second_word_of_a_pair():
    from sulatan.llm.words import mix

    rng = np.random.default_rng(1)
    before, word = rng.integers(0, 2**63, (2, 100)).astype(np.uint64)
    assert (toxicity._second(mix(before * np.uint64(0x9E3779B97F4A7C15) + word), before) == word).all()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline(spark):
    sf = SF.replace("0.01", "0.001")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(10**9, None, None, None, None), (10**9 + 1, "", "en", "s", 0)], docs.schema)
    docs = docs.union(odd).union(docs.limit(1))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard", "decontamination", "secret_scans", "sentencepiece"]
    seen = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.columns == (docs.columns if name != "sentencepiece" else ["doc_id", "ids", "n_pieces"])
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert 0 < docs.count() <= seen
        seen = docs.count()
    assert docs.select("doc_id").distinct().count() == seen


def test_pipeline_judges_rows(spark, tmp_path):
    rng = random.Random(12)
    vocab = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(800)]
    a, b, c, d, item = (" ".join(rng.choices(vocab, k=n)) for n in (90, 90, 90, 90, 40))
    rows = [
        (1, a), (5, a + " more"), (5, b), (5, b),  # id 5: a copy, and a clean text twice
        (7, a + " other"), (7, c + " one"), (7, c + " two"),  # near copies under one id
        (None, d), (None, d), (None, d + " end"), (None, b + " tail"), (9, "a few words only"), (None, None),
    ]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string").repartition(3)
    got = corpus_pipeline.keep_one_of_group(spark, docs, "")
    assert got.columns == docs.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str)
    one_c, one_d = ([r for r in kept if r[1] and r[1].startswith(t)] for t in (c, d))
    assert len(one_c) == len(one_d) == 1 and one_c[0][0] == 7 and one_d[0][0] is None
    assert kept == sorted([(1, a), (5, b), (9, "a few words only"), (None, None), *one_c, *one_d], key=str)

    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    leak = f"{a} {item} {b}"
    docs = spark.createDataFrame([(1, leak), (1, c), (2, b), (None, leak), (None, d), (None, None)], "doc_id long, text string")
    got = corpus_pipeline.drop_leaks(spark, docs, str(tmp_path))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([(1, c), (2, b), (None, d), (None, None)], key=str)


def test_toxicity_keys_are_packed():
    """A block's questions and answers are one row per part of the model, keys without loss."""
    keys = np.sort(np.random.default_rng(3).integers(0, 1 << 64, 1000, np.uint64))
    keys = np.unique(np.concatenate([keys, np.array([0, 1, (1 << 64) - 1], np.uint64)]))
    for some in (keys, keys[:1], keys[:0]):
        assert (toxicity._unpacked(toxicity._packed(some)) == some).all()
    word = [[float(i)] * len(toxicity.VALUES) if i % 2 else None for i in range(len(keys))]
    model = pa.table({"key": pa.array(keys.view(np.int64)), "n": pa.array(np.arange(len(keys))), "x": pa.array(word, pa.list_(pa.float64()))})
    asked = pa.table({"part": [0, 0], "block": [5, 8], "keys": [toxicity._packed(keys[:10]), toxicity._packed(keys[5:6] + np.uint64(1))]})
    got = toxicity._answers(asked, model).to_pylist()
    assert [r["block"] for r in got] == [5, 8] and not got[1]["pair"] and not got[1]["x"]
    assert (toxicity._unpacked(got[0]["pair"]) == keys[:10:2]).all() and (toxicity._unpacked(got[0]["word"]) == keys[1:10:2]).all()
    assert np.frombuffer(got[0]["x"]).reshape(len(toxicity.VALUES), -1)[0].tolist() == [1, 3, 5, 7, 9]
