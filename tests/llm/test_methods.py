"""What the methods do beyond the fixed columns, and the pipeline's stages."""

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quadrille.llm import decontaminate, html_text, license_scan, mixing, ngram_join, pii, quality, suffix_dedup, url_rules, warc
from quadrille.llm.components import components

from .conftest import BASE, ITEM


def test_pii_patterns_find_unseen_identifiers(spark):
    docs = spark.createDataFrame([(i, f"write to u{i}@mail.org today") for i in range(8)] + [(20, "write to someone@localhost today"), (21, "the odd someone2@elsewhere word")], "doc_id long, text string")
    found = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["spans"]] for r in pii.find(docs).collect()}
    assert found[0] == [(9, 0, 20)] and found[20] == [(9, 0, 26)] and found[21] == []
    masked = {r["doc_id"]: r["text"] for r in pii.mask(docs).collect()}
    assert masked[0] == "write to [EMAIL] today" and masked[20] == "write to [EMAIL] today" and masked[21] == "the odd someone2@elsewhere word"


def test_unseen_identifiers_are_recalled(spark):
    """Identifiers that fail their pattern, in contexts that seeds have, against the same shapes elsewhere."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    contexts = {"email": ("mailto", "please"), "ip": ("server", "answered"), "phone": ("dial", "tonight")}
    seed = {"email": lambda: f"{word()}@{word()}.org", "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), "phone": lambda: f"+1 555 {rng.randrange(10**6, 10**7)}"}
    held = {"email": lambda: f"{word()}@{word()}", "ip": lambda: ".".join(str(rng.randrange(300, 999)) for _ in range(4)), "phone": lambda: f"555-{rng.randrange(10**6, 10**7)}"}
    rows, wanted = [], set()
    for i in range(300):
        kind = rng.choice(list(contexts))
        before, after = contexts[kind]
        new = i % 3 == 0
        rows.append((i, f"{word()} {before} {(held if new else seed)[kind]()} {after} {word()}"))
        wanted |= {i} if new else set()
    rows += [(1000 + i, f"{word()} {held[rng.choice(list(held))]()} {word()}") for i in range(100)]
    found = {r["doc_id"]: len(r["spans"]) - len(r["base"]) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(found[i] > 0 for i in wanted) >= 0.9 * len(wanted) and not any(found[1000 + i] for i in range(100))


def test_masks_and_long_lists_of_hits(spark):
    rng = random.Random(3)
    parts = ["a@b.org", "10.0.0.1", "4111 1111 1111 1111", "+1 (555) 010-9999", "wörd", "10.0.0.1@x.org", "1.2.3.4.5.6.7.8", "\n", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"]
    rows = [(i, "".join(rng.choice(parts) + rng.choice(["", " ", ","]) for _ in range(n))) for i, n in enumerate([0, 1, 5, 40, 900, 900])]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, id int, hash int")
    found, masked = {r["doc_id"]: r["spans"] for r in pii.find(docs).collect()}, pii.mask(docs)
    assert masked.columns == docs.columns
    masked = {r["doc_id"]: r["text"] for r in masked.collect()}
    for i, text in rows:
        out, at = [], 0
        for s in found[i]:
            out += [text[at : s["start"]], f"[{pii.KINDS[s['kind']].upper()}]"] if s["start"] >= at else []
            at = max(at, s["end"])
        assert masked[i] == "".join(out) + text[at:]
    many = spark.createDataFrame([(1, " ".join(f"u{k}@mail.org x{k}@local" for k in range(5000)))], "doc_id long, text string")
    assert [tuple(r) for r in pii.extracted(many).select(F.size("seeds"), F.size("others")).collect()] == [(5000, 5000)]


def test_secrets_are_spans_of_the_method(spark):
    docs = spark.createDataFrame([(1, 'x token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" y')], "doc_id long, text string")
    row = pii.find(docs).first()
    assert row["base"] == [] and [(s["start"], s["kind"], s["end"]) for s in row["spans"]] == [(11, 4, 51)]


def test_near_copies_on_both_sides_of_the_threshold(spark):
    rng = random.Random(11)
    story = [f"w{k}" for k in range(70)]
    rows = []
    for i in range(260):
        t = list(story)
        for _ in range(rng.randrange(0, 5)):
            t[rng.randrange(len(t))] = f"e{rng.randrange(40)}"
        rows.append((i - 100, " ".join(t[rng.randrange(0, 4) :])))
    sets = [(d, {tuple(w[j : j + 5]) for j in range(len(w) - 4)}) for d, t in rows for w in [t.split()]]
    comp = {d: d for d, _ in sets}

    def root(d):
        while comp[d] != d:
            d = comp[d]
        return d

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(d), root(e)
                comp[max(x, y)] = min(x, y)
    expected = {d: (len(a), root(d)) for d, a in sets}
    assert len({c for _, c in expected.values()}) > 5
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == expected


def test_negative_ids_are_ids(spark):
    passage = "a passage that stands in three documents and is longer than fifty bytes"
    docs = spark.createDataFrame([(i, f"own{i} words here {passage} and the end {i}") for i in (-7, -1, 3)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.dedup(docs).collect()}
    assert got[-7] == 0 and min(got[-1], got[3]) >= len(passage)


def test_rules_of_paths_hyphens_and_no_tokens(spark):
    rules = (url_rules.Rule("ads", "/ads/", ("ads",), "block", 5), url_rules.host_rule("block", "my-site.com/"), url_rules.Rule("dots", r"\.\.\.", (), "block", 1))
    urls = spark.createDataFrame([(1, "http://a.org/ads/x"), (2, "http://www.my-site.com/p"), (3, "http://b.org/x...y"), (4, "http://b.org/ad"), (5, None)], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_rules.judge(urls, rules).collect()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow"}


def test_url_rules_against_all_rules(spark):
    """The index fetches every rule that matches: each url against all rules, and nothing is shuffled."""
    rng = random.Random(3)
    words = [*url_rules.HOST_WORDS[:8], "free", "bets", "www", "example", "essex", "adultery", "casino"]
    urls = [f"http://{rng.choice('.-').join(rng.sample(words, 2))}.{rng.choice(['org', 'net', 'com'])}{rng.choice(['', '/', '/es/a', '/a/casino', '/casinos/x', '/a/porn.html?q', '/x/CASINO'])}" for _ in range(500)]
    urls += ["http://blog.adult-x.example.net/p", "http://essex.org/track", "http://a.org/a\n/warez\n"]
    docs = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    judged = url_rules.judge(docs)
    rules, verdicts = sorted(url_rules.BASE_RULES + url_rules.OWN_RULES, key=lambda r: (-r.rank, r.name)), Counter()
    for r in judged.collect():
        fits = next((x for x in rules if re.search(x.pattern, r["host"] + r["path"], re.DOTALL)), None)
        assert (r["rule"], r["verdict"]) == (fits.name if fits and fits.base else None, fits.verdict if fits else "allow"), r
        verdicts[r["verdict"], r["rule"] is None] += 1
    assert verdicts["block", True] > 50 and verdicts["allow", True] > 20
    assert [r["verdict"] for r in judged.where("page_id >= 500").orderBy("page_id").collect()] == ["block", "allow", "block"]
    assert "Exchange" not in judged._jdf.queryExecution().executedPlan().toString()


def test_revisits_name_records(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a.org/{i}", "x" * 200) for i in (4, 2, 9)], "page_id long, url string, html string")
    warc.write_captures(pages, f"file://{tmp_path}/w")
    records = warc.read_records(spark, f"file://{tmp_path}/w").collect()
    ids = {r["record_id"] for r in records if r["warc_type"] == "response"}
    assert len({r["record_id"] for r in records}) == len(records) == 9
    assert [r["refers_to"] in ids for r in records if r["warc_type"] == "revisit"] == [True, True]


def test_prints_count_votes(spark):
    h = [random.Random(5).randrange(-(2**63), 2**63) for _ in range(9)]
    expected = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    got = spark.range(1).select(decontaminate.simhash(F.array(*[F.lit(x).cast("bigint") for x in h]))).first()[0]
    assert got % 2**64 == expected


@pytest.mark.parametrize("page", ["<a " * 100_000, "<b>" * 50_000 + "<p>" * 50_000, "<div>" * 50_000 + "</x>" * 50_000, "<div class=ad>x" * 30_000, '<a "' * 100_000, "<!" * 100_000])
def test_bad_pages_end(page):
    begun = time.time()
    html_text.blocks(page)
    assert time.time() - begun < 20


def test_transactions_come_together(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.org/x", "x" * 200), (2, "http://a.org/y", "x" * 200), (3, "http://b.org", "é")], "page_id long, url string, html string")
    warc.write_captures(pages, f"file://{tmp_path}/w")
    rows = {r["metadata"]["payload"].decode().split()[-1]: r for r in warc.assemble(warc.read_records(spark, f"file://{tmp_path}/w")).collect()}
    assert len(rows) == 3 and rows["1"]["response"]["payload"] == b"x" * 200 and rows["2"]["response"]["warc_type"] == "revisit"
    assert rows["3"]["request"]["target_uri"] == "http://b.org" and rows["3"]["response"]["payload"].decode() == "é"


def test_leaks_are_removed_and_clean_documents_stay(spark):
    near = ITEM.replace("small", "little")
    docs = spark.createDataFrame([(1, "x y z " + ITEM), (2, BASE), (3, ITEM[: len(ITEM) // 3]), (4, "before " + near + " after"), (5, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    exact = {r["doc_id"]: r["similarity"] for r in decontaminate.contaminated(docs, items).collect()}
    assert exact[1] == 1.0 and set(exact) <= {1, 4}
    assert {r["doc_id"] for r in decontaminate.remove(docs, items).collect()} == {2, 3, 4, 5} - (set(exact) - {1})


def test_windows_with_far_prints_are_compared(spark):
    docs = spark.createDataFrame([(1, "y x y x y x y x y x y"), (2, "x y x y z")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "x y x y x y x y x y x")], "item_id long, text string")
    assert [(r["doc_id"], r["similarity"]) for r in decontaminate.contaminated(docs, items).collect()] == [(1, 0.75)]
    assert [(r["doc_id"], r["similarity"]) for r in decontaminate.contaminated(docs, items, radius=0).collect()] == [(1, 0.75)]


def test_mixing_hits_the_weights(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    n = {r["source"]: r["n"] for r in mixing.mix(docs, {"a": 3.0, "b": 1.0}, size=8000).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(n["a"] - 6000) < 350 and abs(n["b"] - 2000) < 200


PAGE = "<html><head><title>no</title></head><body><div>{menu}</div><p>{own}</p><div>{foot}</div></body></html>"


def test_host_runs_are_removed_where_markup_is_silent(spark):
    menu, foot = "home news sport weather travel shop account help", "all content belongs to its owners and may not be used elsewhere"
    pages = [(i, f"http://h.org/{i}", PAGE.format(menu=menu, own=f"page {i} " + " ".join(f"own{i}word{k}" for k in range(20)), foot=foot)) for i in range(4)] + [(9, "http://other.org/", PAGE.format(menu=menu, own="page 9", foot=foot))]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert menu not in got[0] and foot not in got[0] and got[0].startswith("page 0 own0word0") and menu in got[9]


@pytest.mark.parametrize("page, text", [
    ("<article><p>a&amp;amp; b<br>c</p><aside>x</aside><!-- <p>no</p> --><p>d<script>if (a<b) '</p>'</script> e</article><footer>f</footer>", "a&amp; b c d e"),
    ("<nav>n</nav><p>one<p>two <b>three", "one two three"), ('<p title="abc>hello</p>', "hello"), ("<p>a\u2003\u2028b</p>", "a b"), ("<main><div class='comments-list'>c</div><ul><li>x<li>y</ul></main>z", "x y"), ("", ""), ("< 3 &lt;b&gt;", "< 3 <b>"),
])
def test_markup(page, text):
    found = list(html_text.blocks(page))
    marked = any(a for a, _ in found)
    assert " ".join(t for a, t in found if a or not marked) == text


@pytest.mark.parametrize("page, text", [
    ('<div style="overflow:hidden"><article><p>text <img alt="hidden valley"> here</p></article></div>', "text here"), ('<p title="a hidden id=ad place">kept</p><p hidden>gone</p><p data-role="banner">too</p>', "kept too"),
    ('<body class="has-sidebar"><p>one</p><div class="sidebar">s</div></body>', "one"), ('<main class="with-comments"><p>one</p></main>', "one"), ('<article class="post social" id="header"><p>one</p><div class="social">s</div></article>', "one"),
    ('<div class="widget"><article><p>one</p></article><div class="sidebar"><article>teaser</article></div></div>', "one"), ('<article>one</article><div class="sidebar"><article>teaser</article></div>', "one"), ('<form id="f"><p>one</p></form>', "one"),
    ('<article>one <span class="share">s</span> two</article>', "one two"),
])
def test_attributes_do_not_silence_the_article(page, text):
    assert " ".join(t for _, t in html_text.blocks(page)) == text


def page_texts(spark, pages):
    return {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}


def test_unique_runs_travel_in_six_bytes(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "h.org", i * 7919, [" ".join(f"w{x}" for x in rng.integers(0, 1 << 40, rng.integers(20, 900)))]) for i in range(300)]
    runs = sum(len(r[3][0].split()) - html_text.RUN + 1 for r in rows)
    packed = html_text.packed_runs(spark.createDataFrame(rows, "row long, host string, page long, blocks array<string>").coalesce(1), 8).collect()
    assert sum(len(v) for r in packed for v in r if isinstance(v, (bytes, bytearray))) < 6.5 * runs
    assert sum(len(html_text._wide(bytes(r["places"]))) for r in packed) == runs and not any(r["sure"] for r in packed)


@pytest.mark.parametrize("x", [[], [7], [5] * 1000, [-3, 1 << 62, 0], list(range(70_000)), [-(1 << 63), 0]])
def test_numbers_and_rising_keys_come_back(x):
    x = np.array(x, np.int64)
    assert (html_text._wide(html_text._small(x)) == x).all() and len(html_text._wide(html_text._small(x))) == len(x)
    keys = np.sort(x.view(np.uint64))
    assert (html_text._risen(html_text._rising(keys)) == keys).all()


def test_a_place_tells_its_page():
    sizes = np.array([1025, 1024, 1000, 513, 512, 9, 8, 8])
    first, page = html_text._firsts(sizes), np.repeat(np.arange(8), sizes)
    places = first[page] + np.concatenate([np.arange(n) for n in sizes])
    assert (html_text._begun(places, np.bincount(html_text._slots(sizes))) == first[page]).all()


def test_articles_are_evidence_within_the_host_stage(spark):
    notice = "sign up today for our weekly letter and never miss a story"
    own = lambda i, n=30: " ".join(f"own{i}word{k}" for k in range(n))
    pages = [(i, f"http://h.org/{i}", f"<article><p>{own(i)}</p><p>{notice}</p></article>") for i in range(4)]
    pages += [(10, "http://h.org/t", f"<div>{own(10)}</div><article>a teaser</article>"), (11, "http://h.org/u", f"<div>short note outside</div><article>{own(11)}</article>")]
    got = page_texts(spark, pages + pages[:1] * 3)
    assert all(got[i] == own(i) for i in range(4))
    assert got[10] == f"{own(10)} a teaser" and got[11] == own(11)


def test_only_repeated_words_go_and_copies_stay(spark):
    notice = "sign up today for our weekly letter and never miss a story"
    pages = [(i, f"http://h.org/{i}", f"<p>{' '.join(f'own{i}word{k}' for k in range(30))}</p><p>{notice} start{i} middle{i} end{i}</p>") for i in range(4)]
    story = [f"story{k}" for k in range(60)]
    near = [" ".join([*story[:25], f"edit{i}", *story[25:]]) for i in range(5)]
    copies = [(20 + i, f"http://h.org/c{i}", f"<p>{t}</p><div>{notice}</div>") for i, t in enumerate([*near, *[" ".join(story)] * 5])]
    got = page_texts(spark, pages + copies)
    assert all(got[i].endswith(f"own{i}word29 start{i} middle{i} end{i}") and notice not in got[i] for i in range(4))
    assert all(got[20 + i] == near[i] for i in range(5)) and all(got[25 + i] == " ".join(story) for i in range(5))


MIT = license_scan.TEMPLATES[0][1].split()


@pytest.mark.parametrize("text, labels", [
    ("code\n# " + "\n# ".join(" ".join(MIT[i : i + 7]) for i in range(0, len(MIT), 7)) + "\ncode", "mit"), (" ".join(MIT[1:-2]), "mit"), ("it was released " + "and so on " * 9 + "under the roof of MIT with a license", ""),
    ("Released under\nthe MIT License", "mit"), ("Released under the BSD License", ""), ("x\nLicensed under CC BY-NC 4.0.", "cc-by-nc"), ("Licensed under CC BY 4.0", ""), ("All rights reserved.", "rights-reserved"), ("all " + "their " * 30 + "rights reserved", ""),
])
def test_license_windows(spark, text, labels):
    other = "The license of all the software is reserved. " * 3
    docs = spark.createDataFrame([(1, text), (2, other)], "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in license_scan.scan(docs).collect()} == {1: labels, 2: ""}


def test_license_windows_against_brute_force():
    """Containment alone decides: every window of every text is counted."""
    rng = random.Random(17)
    vocabulary = "abcdefghijklmnop"
    templates = [("one", "a b c d e f g h i j", 0.8), ("two", "a b c k", 1.0), ("three", "l m l n o p a a", 0.6), ("four", "k", 1.0)]
    texts = [" ".join(rng.choice(vocabulary[: rng.randrange(3, 17)] + "xyz") for _ in range(rng.randrange(0, 60))) for _ in range(400)] + ["", None, "a b c d e f g h", "A B. C\nK"]
    counts = Counter(w for t in texts for w in (t or "").split())
    known = {int(license_scan.hashed(c)[0]): counts[c] for c in vocabulary}
    found = license_scan.Scanner(known, templates).blocks(license_scan.batch_words(pa.array(texts, pa.string())))
    hits = 0
    for i, text in enumerate(texts):
        words, wanted = re.findall("[a-z]", (text or "").lower()), []
        for label, template, share in templates:
            own, span = set(template.split()), math.ceil(license_scan.SPAN * len(template.split()))
            held = max((len(own & set(words[j : j + span])) for j in range(len(words))), default=0)
            if held >= share * len(own) - 1e-9:
                wanted.append((label, held / len(own)))
        hits += len(wanted)
        assert found.get(i, []) == wanted, text
    assert 200 < hits < 1500


def test_license_scan_of_a_long_text_ends_soon():
    column = pa.array([" ".join(["license under the terms"] * 20_000), " ".join([license_scan.TEMPLATES[0][1]] * 2_000)])
    scanner = license_scan.Scanner({int(h): 1 for _, t, _ in license_scan.TEMPLATES for h in license_scan.hashed(t)})
    begun = time.time()
    assert [x.as_py() for x in scanner.scan(column)[5]] == ["", "mit"]
    assert time.time() - begun < 5


def test_trees_learn_and_keep_their_constraints():
    rng = np.random.default_rng(5)
    x = rng.random((3000, len(quality.FEATURES)))
    y = ((x[:, 2] + 0.2 * rng.standard_normal(3000) < 0.5) & (x[:, 1] > 0.2)).astype(float)
    trees = quality.grow(x[:2000], y[:2000])
    assert ((trees.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.8
    for j, sign in enumerate(quality.FEATURES.values()):
        if sign:
            line = np.repeat(x[:50], 40, 0)
            line[:, j] = np.tile(np.linspace(0, 1, 40), 50)
            steps = np.diff(trees.score(line).reshape(50, 40), axis=1) * sign
            assert (steps >= -1e-12).all()


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fitted = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    held = quality.statistics(docs, fitted).join(labels.where("doc_id % 2 = 1"), "doc_id").select(((F.col("score") >= 0.5) == (F.col("quality") == 1)).alias("right"), (F.col("quality") == 1).alias("good")).toPandas()
    assert held["right"].mean() > max(held["good"].mean(), 1 - held["good"].mean()) - 0.02


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r["id"]: r["comp"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 140))


@pytest.mark.parametrize("kind", ["hard", "empty", "extra"])
def test_pipeline(spark, folders, kind):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folders[kind]}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folders[kind])
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == columns, name
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True)
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, folders[kind])
    assert mixed.columns == [*(c for c in columns if c != "mix_copy"), "mix_copy", "mix_order"]
    assert mixed.count() >= 0
    if kind == "hard":
        assert docs.where("text like '%@%'").count() == docs.where("text like '%a@b%'").count()


@pytest.mark.parametrize("inner, text", [
    ('<p class="notice-board-history">kept?</p>', "kept?"), ('<table class="share-prices"><tr><td>1</td><td>2</td></tr></table>', "1 2"), ('<figure class="widget-photo"><figcaption>Seen.</figcaption></figure>', "Seen."),
    ('<p id="responses-study">So it was.</p><div class="related-work">Earlier.</div>', "So it was. Earlier."), ("<header><h1>Title</h1></header><p>x</p>", "Title x"), ("<p>Let <math><mi>a</mi><mo>=</mo><mi>b</mi></math> hold.</p>", "Let a = b hold."),
    ('<p>x</p><div class="comments"><p>First!</p></div><div class="ad">Buy</div><footer>by me</footer>', "x"),
])
def test_articles_keep_what_only_resembles_boilerplate(inner, text):
    page = f'<html><body><header><h1>Site</h1></header><div class="site-menu">Home</div><article>{inner}</article><div class="share-box">Share</div></body></html>'
    assert " ".join(t for _, t in html_text.blocks(page)) == text


def test_paragraphs_without_an_article_keep_names_of_parts():
    assert [t for _, t in html_text.blocks('<div><p class="share-prices">Up.</p><div class="share-box">Share</div><p class="ad">Buy</p></div>')] == ["Up."]


def test_rows_without_ids_meet_the_target(spark):
    docs = spark.range(1000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("web").alias("source"))
    for size in (1000, 2000):
        assert abs(mixing.mix(docs, size=size).count() - size) < 5 * size**0.5


def test_suffix_dedup_strings_of_one_hash_make_one_segment():
    import numpy as np

    raw = np.frombuffer(b"short" + b"a" * 10_000 + b"ab" * 40, np.uint8)
    row, key, first, last = suffix_dedup.anchors(raw, np.array([0, 5, 5, 10_005, 10_085]))
    assert [(r, a, b) for r, a, b in zip(row, first, last) if r < 3] == [(2, 5, 9_955)]
    # each row's strings belong to one run each, and equal strings to one key
    assert sorted(n for r, a, b in zip(row, first, last) if r == 3 for n in range(a, b + 1)) == list(range(10_005, 10_036))
    assert len(set(key[row == 3].tolist())) == 1


def test_suffix_dedup_equal_segments_enter_the_levels_once(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    passage = rng.integers(97, 123, 80, np.uint8)
    whole = np.concatenate([passage] * 1_000)
    added, add = [], suffix_dedup.Levels.add
    monkeypatch.setattr(suffix_dedup.Levels, "add", lambda self, suffix, doc: added.append(len(suffix)) or add(self, suffix, doc))
    zero = np.zeros(1_000, np.int64)
    [(docs, _, starts, ends)] = suffix_dedup.scanned(whole, zero + 80, np.arange(1_000)[::-1], zero, zero)
    assert sum(added) == 31 and docs.tolist() == list(range(1, 1_000)) and set(starts) == {0} and set(ends) == {80}
