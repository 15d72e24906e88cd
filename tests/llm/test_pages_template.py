"""The template of a host against a plain deduction: tags and texts in the
vectors, slots of the page class, nested and ordered classes."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from carrylens.llm.op9_pages import FREQUENT, LEAST_PAGES, extract, pieces, templates, token_of


def plain(pages):
    """The texts of valid classes of one host's different pages."""
    seqs = [[(token_of(*x), x[2]) for x in pieces(p)] for p in sorted(set(pages))]
    counts = [Counter(t for t, _ in s) for s in seqs]
    tag = {t: g for s in seqs for t, g in s}
    first = [{t: min(i for i, (u, _) in enumerate(s) if u == t) for t in c} for s, c in zip(seqs, counts)]

    def ordered(some):
        orders = {tuple(sorted((t for t in some if t in f), key=f.get)) for f in first if any(t in f for t in some)}
        return len(orders) <= 1

    def kept(some):
        if ordered(some):
            return set(some)
        return {t for kind in (True, False) if ordered(part := [t for t in some if tag[t] is kind]) for t in part}

    classes = defaultdict(list)
    for t in tag:
        vector = tuple(c[t] for c in counts)
        support = sum(map(bool, vector))
        if support >= max(LEAST_PAGES, FREQUENT * len(seqs)):
            classes[vector].append(t)
    page_class = classes.pop((1,) * len(seqs), [])
    root = next((set(some) for some in (page_class, [t for t in page_class if tag[t]], [t for t in page_class if not tag[t]]) if ordered(some)), set())
    classes[(1,) * len(seqs)] = [t for t in page_class if t not in root]
    found = set(root)
    for tokens in classes.values():
        slots = defaultdict(list)
        for t in tokens:
            where = {sum(f[r] < f[t] for r in root) for f in first if t in f}
            if len(where) == 1:
                slots[where.pop()].append(t)
        for some in slots.values():
            found |= kept(some)
    return {t for t in found if not tag[t]}


def test_templates_against_a_plain_deduction(spark):
    rng, hosts = random.Random(3), {}
    for h in range(30):
        parts = [f"<div class=c{k % 4}><p>text {k}</p></div>" for k in range(6)] + ["<ul><li>a</li><li>b</li></ul>", "loose"]
        pages = []
        for i in range(rng.randint(2, 9)):
            body = [x for x in parts if rng.random() < (0.95 if h % 2 else 0.7)]
            if rng.random() < 0.3:
                rng.shuffle(body)
            pages.append(f"<html><body><nav>menu</nav>{''.join(body)}<div>page {rng.randint(0, 5)}</div><footer>end</footer></body></html>")
        hosts[f"h{h}.example"] = pages
    rows = [(f"http://{h}/", p) for h, pages in hosts.items() for p in pages]
    df = spark.createDataFrame(rows, "url string, html string").select(F.xxhash64("html").alias("page"), "url", "html")
    got = {r.host: set(r.template) for r in templates(df).collect()}
    want = {h: found for h, pages in hosts.items() if (found := plain(pages))}
    assert got == want and len(want) > 20


def test_text_that_changes_its_slot_is_no_template(spark):
    """'Moves' is on every second page before the tagged divide and else behind it; 'stays' keeps its slot."""
    def page(i):
        move, stay = "Moves.", "<p>Stays.</p>"
        return f"<body><div class=x1>{move if i % 2 else ''}</div><hr><section>{stay if i < 7 else ''}</section><div class=x1>{'' if i % 2 else move}</div><p>Text {i}</p></body>"

    rows = [(i, "http://h.example/", page(i)) for i in range(8)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {i: f"Moves.\n\nText {i}" for i in range(8)}
