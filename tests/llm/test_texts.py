"""Near copies, leaks, classifiers, vectors, pages and chats against plain versions."""
from __future__ import annotations

import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from hiresift.llm import chat, decontaminate, near_dedup, quality, topk, toxicity, wrappers


def similarity(a: str, b: str) -> float:
    """Ordered Jaccard of labelled shingles by the full dynamic programme."""
    x, y = near_dedup.kmers(a).tolist(), near_dedup.kmers(b).tolist()
    row = [0] * (len(y) + 1)
    for i in x:
        last = 0
        for j, v in enumerate(y, 1):
            last, row[j] = row[j], max(last + (i == v), row[j], row[j - 1])
    return row[-1] / max(len(x) + len(y) - row[-1], 1)


def edited(rng: random.Random, words: list[str], edits: int) -> str:
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def test_banded_alignment_is_exact_above_the_threshold():
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    for edits in (0, 1, 2, 3, 4, 6, 9):
        a, b = edited(rng, base, edits), edited(rng, base[edits:], edits)
        true = similarity(a, b)
        got = near_dedup.aligned(near_dedup.kmers(a).astype("<u4"), near_dedup.kmers(b).astype("<u4"), 0.8)
        assert (got >= 0.8) == (true >= 0.8) and (true < 0.8 or abs(got - true) < 1e-9)


def test_classes_are_components_of_all_similar_pairs(spark):
    rng = random.Random(9)
    base = [[f"w{rng.randrange(5000)}" for _ in range(120)] for _ in range(6)]
    texts = [edited(rng, base[k % 3], rng.randrange(5)) for k in range(90)] + [" ".join(b) for b in base] + ["", None, "", "one two", "one two"]
    got = {r.doc_id: r.class_id for r in near_dedup.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=16).collect()}
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            same = (texts[i] or "") == (texts[j] or "") or (texts[i] and texts[j] and similarity(texts[i], texts[j]) >= 0.8)
            if same and label[i] != label[j]:
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    assert [got[i] for i in range(len(texts))] == label


def test_near_copies_edges_and_filter(texts):
    rows = near_dedup.near_copies(texts).collect()
    got = {r.doc_id: r.class_id for r in rows}
    assert len(rows) == texts.count() and got[2] == got[3] == 2 and got[7] == 5 and got[10] == got[9] == 9 and got[11] == 11
    kept = near_dedup.one_of_each(texts)
    assert kept.columns == texts.columns and sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 2, 4, 5, 6, 8, 9, 11]
    assert near_dedup.near_copies(texts.limit(0)).count() == 0


def test_search_finds_all_items_over_the_threshold():
    rng = random.Random(2)
    items = [(i, " ".join(f"t{int(rng.paretovariate(0.6)) % 90}" for _ in range(rng.randrange(8, 40)))) for i in range(70)]
    index = decontaminate.Index.of(items)
    for _ in range(100):
        terms = {f"t{rng.randrange(90)}" for _ in range(rng.randrange(1, 60))} & index.most.keys()
        score = dict.fromkeys(range(70), 0.0)
        for t in terms:
            for i, s in zip(*index.postings[t], strict=True):
                score[i] += s
        for least in (0.2, 0.5, 0.7):
            got = dict(index.search(terms, least))
            assert set(got) == {i for i, s in score.items() if s >= least - 1e-9} and all(abs(got[i] - score[i]) < 1e-9 for i in got)


def test_leaks_and_their_removal(spark, texts):
    item = "Which river runs through the old capital of the eastern province? It is the long Selva river of the north."
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "tiny"), (5, item)], "item_id long, text string")
    leak = spark.createDataFrame([(100, "words before here " * 50 + item.upper() + " and after " * 90), (101, item.split("?")[0] + "? Nobody in this town would say so at all.")], "doc_id long, text string")
    docs = texts.select("doc_id", "text").unionByName(leak)
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert found == {(100, 1), (100, 5)} == {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench, index_bytes=60).collect()}
    assert decontaminate.without_leaks(docs, bench).count() == docs.count() - 1
    assert decontaminate.contaminated(docs.limit(0), bench.limit(0)).count() == 0


def test_classifiers_learn_and_score_every_row(spark, texts):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(200)]
    rows, marks = [], []
    for i in range(400):
        bad, poor = i % 4 == 0, i % 5 == 0
        sentences = [" ".join(rng.choice(words) for _ in range(8)) + ("%%% ### $$$" if poor else "") for _ in range(rng.randrange(2, 9))]
        if bad:
            sentences[rng.randrange(len(sentences))] += " vilename " + rng.choice(words)
        rows.append((1000 + i, ". ".join(sentences) + "."))
        marks.append((1000 + i, int(not poor), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    truth = {d: (q, t) for d, q, t in marks}
    toxic = toxicity.toxicity(docs, labels).collect()
    held = [r for r in toxic if r.held_out]
    assert 0 < len(held) < len(toxic) and sum(r.predicted == truth[r.doc_id][1] for r in held) >= 0.95 * len(held)
    text = dict(rows)
    assert all("vilename" in text[r.doc_id][s["start"]:s["end"]] for r in toxic if r.predicted and truth[r.doc_id][1] for s in r.sentences[:1] if len(r.sentences) == 1)
    good = [r for r in quality.quality(docs, labels).collect() if r.held_out]
    assert sum(r.predicted == truth[r.doc_id][0] for r in good) >= 0.95 * len(good) and all(r.predicted == int(r.score >= 0.7) for r in good)
    for one in (toxicity.toxicity(texts, labels.limit(0)), quality.quality(texts, labels.limit(0))):
        assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in one.collect()) and one.count() == texts.count()
    assert toxicity.reject_toxic(texts, labels).columns == texts.columns == quality.reject_poor(texts, labels).columns


def test_exact_top_k_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(6)
    vectors = [(i, [float(x) for x in rng.integers(-3, 4, 12) / 4]) for i in range(300)]
    vectors += [(300, None), (301, [1.0, None]), (302, [math.nan] * 12), (303, [math.inf] * 12), (304, [1.0] * 5), (305, []), (306, [3e38] * 12), (None, [1.0] * 12), *((310 + i, [0.5] * 12) for i in range(9))]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.exact_top_k(df, df.where("vec_id % 10 = 0"), shard_rows=40, query_rows=7).collect()}
    whole = {i: q for i, v in [(r.vec_id, r.embedding) for r in df.collect()] if i is not None and (q := topk.quantised(v)) is not None}
    want = {}
    for i in [i for i in whole if i % 10 == 0]:
        best = sorted((-sum(a * b for a, b in zip(whole[i], v, strict=False)), j) for j, v in whole.items() if j != i)[:5]
        want |= {(i, k): (j, max(-(1 << 63), min((1 << 63) - 1, -s))) for k, (s, j) in enumerate(best, 1)}
    assert got == want
    assert topk.exact_top_k(df.limit(0), df.limit(0)).count() == 0
    plan = topk.exact_top_k(df, df.where("vec_id % 10 = 0"), shard_rows=40, query_rows=7)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan, plan  # copies of blocks stay out of the driver


def test_pages(spark):
    page = "<html><head><title>x</title><script>var a='</p><p>';</script></head><body><nav><ul><li><a>Home</a><li>About</ul></nav><div class='ad big'>Buy</div><article><h1>T &amp; A</h1><p>One <b>two</b>\n three<br>four<p>Five &eacute;&#233;<aside>no</aside><form><p>q</form>{}</article><div id=comments><p>said</div><footer>f</footer>"
    rows = [(k, f"http://h.example/{k}", page.format("<h2>S</h2><p>more</p>" * k)) for k in range(4)] + [(9, None, None), (10, "http://h.example/z", ""), (11, "x", "<p>alone"), (12, "http://g.example/", "<div class=menu>m</div><div><p>long text here</p><p>and more</p></div>"), (0, "http://h.example/0", page.format(""))]
    got = {r.page_id: (r.text, r.n_chars, r.fits) for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("chars", F.lit(2))).collect()}
    first = "T & A\nOne two three four\nFive éé"
    for k in range(4):
        assert got[k] == (first + "\nS\nmore" * k, len(first) + 7 * k, True)
    assert got[9][:2] == ("", 0) == got[10][:2] and got[11][0] == "alone" and got[12][0] == "long text here\nand more"


def test_wrapper_has_optional_and_repeated_groups():
    streams = [["h", "p"], ["h", "p", "p", "f"], ["h", "q", "p", "q", "p", "f"]]
    w = wrappers.Wrapper(wrappers.infer(streams), frozenset())
    assert all(w.matches(s) for s in streams) and not w.matches(["f", "h"])


def test_chats_and_rewriting_templates(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", "a <\\|im_end|> b"), (1, 0, "user", "hi <|x|>"), (1, 2, None, None), (2, None, "us\ner%", "é漢"), (None, 0, "user", "x"), (3, 0, "assistant", "t"), (3, 0, "assistant", "t")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.chat_digests(spark, rows.withColumn("formatted", F.lit(1))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 3 and got[1].turns_sha256 == sha("user\nhi <|x|>\nassistant\na <\\|im_end|> b\n\n\n") and got[1].loss_sha256 == sha("a <\\|im_end|> b")
    assert got[2].turns_sha256 == sha("us\ner%\né漢\n") and got[3].loss_sha256 == sha("tt") and got[-1].loss_chars == 34 and None in got

    def rewriting(turns):
        return "".join(f"[{r}{'*' if k == len(turns) - 1 else ''}]{t};" for k, (r, t) in enumerate(turns))

    turns = [("user", "one"), ("assistant", "two"), ("user", "three")]
    text, spans, rewrites = chat.located(rewriting, turns)
    assert rewrites and [text[s[2]:s[3]] for s in spans] == ["one", "two", "three"]
    text, spans, rewrites = chat.located(chat.chatml, turns)
    assert not rewrites and [text[s[2]:s[3]] for s in spans] == ["one", "two", "three"] and spans[-1][1] == len(text)


def test_page_text_is_what_the_article_slots_take(spark):
    """A line of one text on every page is the template's, inside an article too; it is kept where the wrapper doesn't say so."""
    page = "<body><nav><p>Home</p></nav><article><h1>Title {0}</h1><div><b>Written by our staff</b></div><p>Story {0}</p></article></body>"
    plain = "<body><div class=top><p>Shop of all things, with a long welcome to every visitor who comes here</p></div><div class=x><p>Offer {0}</p><p>Terms {0}</p></div></body>"
    rows = [(k, "http://a.example/", page.format(k)) for k in range(5)] + [(10 + k, "http://b.example/", plain.format(k)) for k in range(5)] + [(20, "http://c.example/", page.format(0))]
    got = {r.page_id: (r.text, r.fits) for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == (f"Title {k}\nStory {k}", True) and got[10 + k] == (f"Offer {k}\nTerms {k}", True) for k in range(5))
    assert got[20] == ("Title 0\nWritten by our staff\nStory 0", True)


def test_wrapper_slots_follow_the_expression():
    w = wrappers.Wrapper(wrappers.infer([["h", "p", "f"], ["h", "p", "p", "q", "p", "q", "f"], ["p", "f"]]), {})
    got = w.slots(["h", "p", "p", "p", "q", "p", "q", "p", "q", "f"])
    assert got is not None and [w.paths[k] for k in got] == ["h", "p", "p", "p", "q", "p", "q", "p", "q", "f"]
    assert w.slots(["f", "h"]) is None and w.slots(["h", "z"]) is None


def test_streams_with_other_repeats_inside_a_group_still_match():
    streams = [["a", "b", "a", "b", "b", "a", "b"], ["a", "b", "c", "a", "b", "b", "c"], ["c"] * 3, ["a", "c", "c", "b"]]
    w = wrappers.Wrapper(wrappers.infer(streams), {})
    assert all(w.matches(s) for s in streams)


def test_templates_of_one_host_are_labelled_apart(spark):
    """Pages with an article element, with a main one and with plain containers share a host, or have none."""
    forms = ["<article><h1>A {0}</h1><p>Told {0}</p></article><div><p>Beside {0}</p></div>", "<div class=a><p>First {0}</p><p>Then {0}</p></div><div class=x><p>x{0}</p></div>", "<main><p>Main {0}</p></main><p>Out {0}</p>", "<div class=b><h2>Head {0}</h2><p>Second {0}</p></div><div class=x><p>y{0}</p></div>"]
    want = ["A {0}\nTold {0}", "First {0}\nThen {0}", "Main {0}", "Head {0}\nSecond {0}"]
    for urls in (["http://mixed.example/"], [None, "x/y", "http:///"]):
        rows = [(k, urls[k % len(urls)], "<body><nav><p>Home</p></nav>" + forms[k % 4].format(k) + "</body>") for k in range(24)]
        rows += [(24, urls[0], "<p>alone")]
        got = {r.page_id: r.text for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert got == {k: want[k % 4].format(k) for k in range(24)} | {24: "alone"}


def test_furniture_words_on_containers_of_the_page():
    def text(page):
        return wrappers.by_own_paths(wrappers.blocks(page))

    story = "<p>A story that goes on</p><p>for a while</p>"
    for wrap in ("<div class='content-sidebar-wrap'>{}</div>", "<body class='no-ads'><div class='has-sidebar'>{}</div>", "<div id=post-with-comments><div class='no-ads'>{}</div></div>", "<form action=/>{}</form>"):
        aside = "<div class=sidebar><p>Links to this and that</p></div><nav><p>Menu</p></nav>"
        for inner in (f"<article>{story}</article>{aside}", f"<main>{story}</main>{aside}", f"<div class=x>{story}</div>{aside}"):
            assert text(wrap.format(inner)) == "A story that goes on\nfor a while", (wrap, inner)
    comments = "<div class=comments><p>" + "I said so at length. " * 9 + "</p></div>"
    assert text(f"<div class=x>{story}</div>{comments}") == text(f"<article>{story}</article>{comments}") == "A story that goes on\nfor a while"
    assert text(f"<div class=x>{story}</div><div class=related><article>See</article></div>") == "A story that goes on\nfor a while"
    assert text("<div hidden><article><p>no</p></article></div>") == "" == text("<div class=cookie>Take it</div>")


def test_long_conversations_are_written_in_chunks(spark):
    """A conversation over many chunks and parts reads as a whole one would; no row holds it all."""
    rng = random.Random(3)
    rows = [(rng.choice([None, 7, 7, 7, k]), rng.randrange(900), rng.choice(["user", "assistant", None]), rng.choice([None, "x <|im_end|>", "漢 word " * rng.randrange(90)])) for k in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    chunks = chat.placed(chat.format_chunks(df).localCheckpoint()).collect()
    whole = {r.conv_id: r for r in chat.format_chats(df.where("conv_id != 7")).collect()}
    by: dict = {}
    for r in sorted(chunks, key=lambda r: r.start):
        by.setdefault(r.conv_id, []).append(r)
    assert len(by[7]) > 20 and max(len(r.formatted) for r in chunks) < 3 * chat.CHUNK_CHARS and max(len(r.turns) for r in chunks) <= chat.CHUNK_TURNS
    for conv, parts in by.items():
        text, spans, loss = "", [], []
        for r in parts:
            assert r.start == len(text)
            spans += [tuple(x + r.start for x in s) for s in r.turns]
            loss += [tuple(x + r.start for x in s) for s in r.loss]
            text += r.formatted
        turns = sorted(((t is not None, t or 0, r is not None, r or "", x is not None, x or "") for c, t, r, x in rows if c == conv))
        turns = [(t[3], t[5]) for t in turns]
        assert text == chat.chatml(turns) and [text[s[2]:s[3]] for s in spans] == [chat.escape(t) for _, t in turns]
        assert conv not in whole or (whole[conv].formatted == text and [tuple(s) for s in whole[conv].turns] == spans and [tuple(s) for s in whole[conv].loss] == loss)
    got = {r.conv_id: r for r in chat.chat_digests(spark, df).collect()}
    plain = {r.conv_id: r for r in chat.read_chats(chat.format_chats(df.where("conv_id IS NULL OR conv_id > 20 AND conv_id < 90")).withColumns({"part": F.lit(0), "chunk": F.lit(0)})).collect()}
    assert all(got[c] == r for c, r in plain.items()) and len(got) == len(by) + 1 - (-1 in by)
    assert chat.appends(chat.chatml) and not chat.appends(lambda turns: "<s>" + chat.chatml(turns)) and not chat.appends(lambda turns: "".join(f"{k}{t}" for k, (_, t) in enumerate(turns)))
