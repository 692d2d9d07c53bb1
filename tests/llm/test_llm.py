"""Every operator of sparquill.llm against a brute-force version, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sparquill.llm import automata, components, decontaminate, licences, mixing, quality, repeats, simhash, sitetree, suffixes, tokens
from sparquill.llm import lines as lines_
from tests.conftest import SF

WHITE = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns named as the operators name their own.
EXTRA = "row long, owner long, print long, component long, _p double, _row string, hits int, kept boolean, host string"
NULLS = (None,) * 9
SCHEMA = f"doc_id long, text string, source string, {EXTRA}"


def corpus(seed=7, n=60, words=40):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(200)] + ["Éa", "É", "the", "#x", "a|b"]
    base = [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, words))) for _ in range(n)]
    passage = " ".join(r.choice(vocabulary) for _ in range(90))
    long = " ".join(r.choice(vocabulary) for _ in range(20_000))
    texts = [*base, base[0], base[0], None, "", " \n\t ", passage, "x " + passage + " y", base[1] + "\n" + passage, long, long + " z", "ab" * 300, "a" * 700, "\n".join([base[2]] * 4)]
    rows = [(k if k % 13 else None, t, None if k % 7 == 0 else f"s{k % 3}", *NULLS) for k, t in enumerate(texts)]
    return [*rows, rows[5], rows[5], (5, "tie", "s1", *NULLS)]


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# 1


def brute_hits(text, items):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, found = low(text), set(), set()
    for item, body in items:
        v = low(body)
        n = min(10, len(v))
        for k in range(len(v) - n + 1) if n else ():
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[k : k + n]:
                    hit |= set(range(p, p + n))
                    found.add("" if item is None else str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("chars", [decontaminate.BLOCK_CHARS, 60])
def test_contamination(spark, table, chars):
    rows = corpus()
    items = [(1, "W3, w4"), (2, None), (3, ""), (10, " ".join(rows[3][1].split()[:14]).upper()), (None, rows[65][1]), (2, rows[65][1] + " tail"), (1, "éa É")]
    docs = table(rows, SCHEMA)
    found = docs.select("doc_id", "text", decontaminate.contamination(docs, table(items, "item_id long, text string", "i"), block_chars=chars).alias("h"))
    for r in found.withColumn("n", decontaminate.n_hit(F.col("h"))).collect():
        assert (r.h.n_words, r.n, r.h.items) == brute_hits(r.text, items)
        if r.h.spans:
            first = r.text.encode()[r.h.spans[0].first : r.h.spans[0].last].decode()
            assert re.findall(r"\w", first)


def test_contamination_of_nothing(table):
    docs = table(corpus()[:5], SCHEMA)
    for items in ([], [(1, None), (2, "...")]):
        found = docs.select(decontaminate.contamination(docs, table(items, "item_id long, text string", "i")).alias("h")).collect()
        assert all(not r.h.ranges and not r.h["items"] for r in found)


# 2


def brute_lines(rows):
    key = lambda k: (k is None, k or 0)
    lines = [t.encode().split(b"\n") if t is not None else [] for _, t, *_ in rows]
    order = sorted(range(len(rows)), key=lambda k: key(rows[k][0]))
    seen, gone = set(), {k: set() for k in order}
    for k in order:
        for a, b in sorted(lines_.spans(lines[k])):
            body = b"\n".join(lines[k][a:b])
            if body in seen:
                gone[k] |= set(range(a, b))
            seen.add(body)
    for k, own in enumerate(lines):
        kept = b"\n".join(x for i, x in enumerate(own) if i not in gone[k])
        yield rows[k][0], len(own), len(gone[k]), hashlib.sha256(kept).hexdigest()


def test_line_chunks(table):
    r = random.Random(3)
    pool = [f"line {k}" for k in range(12)] + ["", " "]
    texts = ["\n".join(r.choice(pool) for _ in range(r.randint(0, 30))) for _ in range(40)] + [None, "", "\n", "one", "\n".join(["same"] * 500), "\n".join(["a", "b"] * 300)]
    shared = "\n".join(f"shared {k}" for k in range(40))
    texts += [shared, "before\n" + shared, shared, None]
    data = [(None if k == len(texts) - 2 else k, t, None, *NULLS) for k, t in enumerate(texts)]
    found = lines_.strip_chunks(table(data, SCHEMA)).collect()
    assert Counter((x.id, x.n_lines, x.n_removed_lines, x.kept_sha256) for x in found) == Counter(brute_lines(data))
    shifted = next(x for x in found if x.id == texts.index("before\n" + shared))
    assert shifted.kept.startswith("before") and shifted.n_removed_lines >= 37  # boundaries resist the shift
    assert lines_.strip_chunks(table([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n, least", [(3, 0.55), (4, 0.8), (6, 0.92), (10, 0.96)])
def test_short_passages_are_found(n, least):
    r = random.Random(n)
    caught = total = 0
    for k in range(400):
        passage = [b"p%d %d" % (k, r.getrandbits(40)) for _ in range(n)]
        docs = [[b"%d" % r.getrandbits(60) for _ in range(5)] + passage + [b"%d" % r.getrandbits(60) for _ in range(5)] for _ in range(2)]
        first = {tuple(docs[0][a:b]) for a, b in lines_.spans(docs[0])}
        caught += len({x for a, b in lines_.spans(docs[1]) if tuple(docs[1][a:b]) in first for x in range(a, b)})
        total += n
    assert caught / total > least


# 3


def test_token_file(spark, table, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = corpus() + [(900, "<|startoftext|>Hi<|endoftext|> it's İstanbul ΑΣ x y 3²½ é \x1c ÀÉ'll don't 漢字 ﬁ ­", None, *NULLS), (901, "of the of the of the " * 400, None, *NULLS)]
    docs = table(rows, SCHEMA)
    tokens.write(docs, str(tmp_path / "ids"), path, block_tokens=5000)
    found = sorted(tokens.read(spark, str(tmp_path / "ids")).collect(), key=lambda r: r.start)
    whole = tokens.Tokenizer.from_file(path)
    want = [([*whole.encode(t or "", add_special_tokens=False).ids, 1], k) for k, t, *_ in rows]
    assert Counter((r.id, tuple(r.ids)) for r in found) == Counter((k, tuple(ids)) for ids, k in want)
    assert [r.start for r in found] == [0, *np.cumsum([r.n_tokens for r in found])[:-1]]
    assert [r.id for r in found] == sorted((r.id for r in found), key=lambda k: (k is not None, k or 0))
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in found)
    block = max(spark.read.parquet(str(tmp_path / "ids")).collect(), key=lambda b: len(b.left))
    assert len(tokens._wide(block.left)) > 1 and tokens._wide(block.spans).max() > 2
    lengths, all_ids = tokens._wide(block.lengths), {(r.id, len(r.ids)): r.ids for r in found}
    for k, doc in enumerate(block.doc_ids):
        if doc is not None and doc != 5:
            ids = all_ids[doc, lengths[k]]
            assert tokens.decode_document(block, k).tolist() == ids
            assert tokens.decode_document(block, k, len(ids) // 3, len(ids) // 2 + 1).tolist() == ids[len(ids) // 3 : len(ids) // 2 + 1]


@pytest.mark.parametrize("packed", [True, False])
def test_repair_leaves_no_frequent_pair(packed):
    r = np.random.default_rng(8)
    phrases = [r.integers(0, 50, r.integers(2, 30)) for _ in range(40)]
    docs = [np.concatenate([phrases[k] for k in r.integers(0, 40, 30)]) for _ in range(60)] + [np.zeros(0, int), np.full(999, 7), np.arange(20)]
    ids, lengths, base = np.concatenate(docs), np.array([len(d) for d in docs]), 50 if packed else (1 << 20) - 5
    found = tokens.repair(ids, lengths, base, 3)
    assert (tokens.expand(found["symbols"], base, found["left"], found["right"]) == ids).all() and len(found["symbols"]) < len(ids) / 4
    assert (tokens.expand_all(found["symbols"], base, found["left"], found["right"], found["spans"]) == ids).all()
    spans = [len(tokens.expand(np.array([base + k]), base, found["left"], found["right"])) for k in range(len(found["left"]))]
    assert found["spans"].tolist() == spans
    count = Counter()
    for a, b in zip(found["offsets"][:-1], found["offsets"][1:]):
        own, k = found["symbols"][a:b].tolist(), 0
        for k in range(len(own) - 1):
            if not (k and own[k - 1] == own[k] == own[k + 1]):
                count[own[k], own[k + 1]] += 1
    assert max(count.values()) < 3


def test_token_file_of_nothing(spark, table, tmp_path):
    tokens.write(table([], SCHEMA), str(tmp_path / "ids"), public_tokenizers.path("word_bpe_49k.json"))
    assert tokens.read(spark, str(tmp_path / "ids")).count() == 0


# 4


APACHE = """# Copyright 2020 The Authors
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
import os"""
MIT = "\n\n".join(["MIT License", "Copyright (c) 2020 Someone", *licences.TEMPLATES["MIT"][3:6]])
GPL3 = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version."""
BSD = "\n".join([licences.REDISTRIBUTION, licences.SOURCE_FORM, licences.BINARY_FORM, *([licences.TEMPLATES["BSD-3-Clause"][0]]), licences.AS_IS])


def scanned(docs):
    return licences.scan(docs, F.col("doc_id"), F.col("path"), F.col("text"))


def test_notices(table):
    data = {
        "Apache-2.0": [APACHE, "SPDX-License-Identifier: Apache-2.0"], "MIT": [MIT, "// SPDX-License-Identifier: MIT", "Text.\nReleased under the MIT License.\nMore."], "GPL-3.0": [GPL3, GPL3.replace("\n * ", " ")],
        "GPL-2.0": [GPL3.replace("version 3", "version 2")], "AGPL-3.0": [GPL3.replace("GNU General", "GNU Affero General")], "LGPL-3.0": [GPL3.replace("GNU General", "GNU Lesser General").replace("program", "library")],
        "LGPL-2.1": [GPL3.replace("GNU General", "GNU Lesser General").replace("program", "library").replace("version 3", "version 2.1")], "BSD-3-Clause": [BSD], "BSD-2-Clause": [BSD.replace(licences.TEMPLATES["BSD-3-Clause"][0], "")],
        "MPL-2.0": ["/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"],
        "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."], "CC-BY-4.0": ["Licensed under CC BY 4.0."], "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."], "ISC": [licences.TEMPLATES["ISC"][0]],
        None: ["Mit.", "Er kam mit dem Zug.", "the license of a driver is needed to drive", "We released the version 2.0 of the program.", "", None],
    }
    rows = [(k, None, t, licence) for k, (licence, t) in enumerate((x, t) for x, own in data.items() for t in own)]
    docs = table([r[:3] for r in rows], "doc_id long, path string, text string")
    found = {r.id: r.own_licence for r in scanned(docs).collect()}
    assert found == {k: licence for k, _, _, licence in rows}


def test_licence_of_the_nearest_directory(table):
    gpl = licences.TEMPLATES["GPL-3.0"][2]
    data = [("a/LICENSE", MIT), ("a/b/x", "plain"), ("a/b/c/x", "plain words " * 50), ("a/b/NOTICE", gpl + "\n" + "word " * 99), ("a/b/GPL", gpl), ("ab/x", "plain"), ("top", None), (None, ""), ("a/own", "Text.\n" + APACHE + "\n" + "word " * 100), ("a/own/x", "plain")]
    docs = table([(k, p, t, 1) for k, (p, t) in enumerate(data)], "doc_id long, path string, text string, row long")
    found = {r.id: r for r in scanned(docs).collect()}
    assert [found[k].licence for k in range(10)] == ["MIT", "GPL-3.0", "GPL-3.0", "GPL-3.0", "GPL-3.0", None, None, None, "Apache-2.0", "MIT"]
    assert found[2].declared_in == "a/b" and found[9].declared_in == "a" and found[0].similarity == 1
    assert scanned(docs.limit(0)).count() == 0


def test_no_window_above_the_least_cosine_fails_the_gate():
    r, needed = random.Random(1), set(licences.NEEDED)
    passages = {}
    for _, k, t, w in licences.WEIGHTS:
        passages.setdefault(k, {})[t] = w
    for k, own in passages.items():
        for _ in range(200):
            terms = [t for t in own if r.random() < 0.5] + ["zebra"] * r.randrange(3)
            if terms and not needed & set(terms):
                v = {t: n * licences.IDF.get(t, licences.UNKNOWN) for t, n in Counter(terms).items()}
                assert sum(v[t] * own.get(t, 0) for t in v) / np.sqrt(sum(x * x for x in v.values())) < licences.LEAST


# 5


def brute_targets(totals):
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    budget, target, open_ = 1.5 * sum(totals.values()), {}, set(names)
    while open_:
        share = {s: (budget - sum(target.values())) * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * totals[s]}
        if not over:
            return target | share
        target |= {s: 2.0 * totals[s] for s in over}
        open_ -= over
    return target


def test_mix(spark, table, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 25)
    rows = corpus() + [(1000 + k, "u " * (1 + k % 17), "hot", *NULLS) for k in range(400)] + [(2000, "a b", "", *NULLS), (2001, "é é x", "é", *NULLS)]
    docs = table(rows, SCHEMA)
    found = mixing.mix(docs, columns=tuple(docs.columns)).select("_row.*", "_size", "_source_size", "_target", "_taken").collect()
    again = mixing.mix(docs.repartition(3), columns=("doc_id",)).select("_row.doc_id", "_size", "_taken")
    assert Counter((r.doc_id, r._size, r._taken) for r in found) == Counter(map(tuple, again.collect()))
    assert Counter((r.doc_id, r.text) for r in found) == Counter((r[0], r[1]) for r in rows)
    totals = Counter()
    for _, t, s, *_ in rows:
        totals[s] += len(WHITE.findall(t or ""))
    target = brute_targets(totals)
    taken = Counter()
    for r in found:
        assert r._size == len(WHITE.findall(r.text or "")) and r._source_size == totals[r.source] and abs(r._target - target[r.source]) < 1e-6
        assert 0 <= r._taken <= 2 * r._size and (r._taken % r._size == 0 if r._size else not r._taken)
        taken[r.source] += r._taken
    assert abs(taken["hot"] - target["hot"]) <= 17
    assert all(abs(taken[s] - target[s]) <= max(len(WHITE.findall(t or "")) for _, t, x, *_ in rows if x == s) for s in totals)
    assert mixing.mix(docs.limit(0)).count() == 0
    times = Counter((r.doc_id, r.text) for r in mixing.mixed(docs).collect())
    want = Counter()
    for r in found:
        want[r.doc_id, r.text] += r._taken // r._size if r._size else 0
    assert times == +want


def test_mix_reruns_agree_on_rows_without_ids(table, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 10)
    r = random.Random(4)
    rows = [(None, " ".join(f"w{r.randrange(99)}" for _ in range(8)), "s") for _ in range(150)]
    runs = []
    for k in range(2):
        r.shuffle(rows)
        found = mixing.mix(table(rows, "doc_id long, text string, source string", f"t{k}"), columns=("text",), cap=1.5, share=0.7)
        runs.append(sorted((x._row.text, x._taken) for x in found.collect()))
    assert abs(sum(n for _, n in runs[0]) - 0.7 * 8 * 150) <= 8  # equal sizes, no ids: texts alone tell rows apart


def test_flight_balances():
    r = np.random.default_rng(1)
    size, chance = r.integers(1, 500, 800), iter(r.random(9000)).__next__
    p = mixing.flight(np.full(800, 0.37), size, chance, False)
    assert ((p > 0) & (p < 1)).sum() <= 2 and abs(p.sum() - 296) < 1e-5 and abs(p @ size - 0.37 * size.sum()) < 1e-3


# 6

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header class="site-header"><h2>Site</h2></header>
<nav><ul><li><a href=x>Menu</a></ul></nav><div class="cookie-notice">We use cookies</div><!-- c --><article><h1>Head &amp; line</h1><p><b>One
 two<br>three<p>A &lt;b&gt; &#233;<script>x()</script> end</p><div class=ad>Buy</div><ul><li>i<li>j</ul><form><p>mail</p></form><blockquote>q</blockquote>
<div class="inline-widget x9">Follow us</div></article><aside>side</aside><section id="comments"><p>first!</p></section><footer>&copy;</footer></body></html>"""
WEB = f"page_id long, url string, html string, {EXTRA}"


def text_of(body):
    return sitetree.article(body, frozenset())


def test_article(table):
    text = "Head & line\nOne two three\nA <b> é end\ni\nj\nq"
    data = [(1, "http://h/1", PAGE, *NULLS), (1, "http://h/1", PAGE, *NULLS), (2, None, None, *NULLS), (3, "http://h/3", "", *NULLS), (4, "bad", "plain <p>a<p>b", *NULLS), (6, "http://h/6", "<main><h2>More</h2><article><header><h1>H</h1></header><p>Body text</p><article class='comment'><p>nice</p></article></article></main>", *NULLS), (7, "x", "<main><p>m</p></main><p>o</p>", *NULLS), (None, "http://h/2", "<div hidden>x</div><div>y <a>z</a></div><!-- open", *NULLS)]
    found = sitetree.extract(table(data, WEB)).collect()
    assert Counter((r.page_id, r.text) for r in found) == Counter([(1, text), (1, text), (2, ""), (3, ""), (4, "plain\na\nb"), (6, "H\nBody text"), (7, "m"), (None, "y z")])
    assert all(r.n_chars == len(r.text) for r in found)
    assert sitetree.extract(table([], WEB)).count() == 0


def test_names_are_a_prior_only():
    story = "<h1>Title</h1><p>The story is told at some length here.</p>"
    for page in ("<div id='content' class='with-sidebar'>{}</div>", "<div class='layout nav-open'>{}</div>", "<form><div>{}</div></form>", "<form class='search'>{}</form><nav>m</nav>"):
        assert text_of(page.format(story)) == "Title\nThe story is told at some length here."
    inside = text_of("<article><h2 id='related-work'>Related work</h2><div class='search-methods'><p>We search.</p></div><section id='search'><p>More.</p></section><p class='alert'>Mind.</p><p class='ad'>Buy</p></article>")
    assert inside == "Related work\nWe search.\nMore.\nMind."
    assert text_of("<main><p>A long text of the main part, told in prose, goes on and on.</p><article><p>card</p></article></main><div>x</div>").endswith("goes on and on.\ncard")
    assert text_of("<article><p>Short.</p></article><section id='comments'><p>" + "long comment " * 50 + "</p></section>") == "Short."


@pytest.mark.parametrize("limit", [sitetree.BROADCAST_ROWS, 0])
def test_site_tree_cuts_what_a_host_repeats(table, monkeypatch, limit):
    monkeypatch.setattr(sitetree, "BROADCAST_ROWS", limit)
    page = "<body><div class='strap'>All about fish</div><div class='story'><p>Story {0} tells of {0}.</p><ul class='x1'><li>Boats</li><li>Nets</li></ul><p>More on {0}</p></div></body>"
    data = [(k, f"http://h.example/{k}", page.format(k)) for k in range(8)] + [(9, "http://once.example/", page.format("once"))]
    copies = [(20 + k, f"http://c.example/{k}", f"<article><p>The same article stands here, word for word.</p><p>Page {k}</p></article><div>Home</div>") for k in range(9)]
    found = {r.page_id: r.text for r in sitetree.extract(table(data + copies, "page_id long, url string, html string")).collect()}
    assert found[3] == "Story 3 tells of 3.\nMore on 3" and text_of(page.format(3)) != found[3]  # the tree alone, as no name tells
    assert found[9].startswith("All about fish\n")  # a host with one page shows nothing
    assert found[25] == "The same article stands here, word for word.\nPage 5"


def test_importance_against_brute_force(table):
    r = random.Random(2)
    body = lambda k: f"<div class='top'><a>Home</a></div><div class='story'>{''.join(f'<p>{r.choice([k, 0, 1])} x</p>' for _ in range(r.randint(1, 4)))}<ul><li>{k % 2}</li></ul></div>"
    pages = [("a", body(k)) for k in range(30)] + [("b", body(k)) for k in range(5)] + [("a", "<div class='top'><a>Home</a></div>"), ("a", None), ("b", "")]
    pages += pages[:3]
    found = {(x.host, x.path): (x.pages, round(x.importance, 9)) for x in sitetree.style_tree(table(pages, "host string, html string")).collect()}
    seen, above = Counter(), {}
    for host, (page, own) in {(h, sitetree.features(t or "")[0]): (h, sitetree.features(t or "")) for h, t in pages}.values():
        for paths, kind, feature in own:
            seen[host, paths[0], kind, feature] += 1
            above[paths[0]] = paths
    entropy = lambda counts: -sum(c / sum(counts) * np.log(c / sum(counts)) for c in counts)
    for (host, path), (m, importance) in found.items():
        assert m == seen[host, path, 0, 0]
        styles = [n for (h, p, kind, _), n in seen.items() if (h, p, kind) == (host, path, 1)]
        blocks = [n for (h, p, kind, _), n in seen.items() if h == host and kind == 2 and path in above[p]]
        base = np.log(max(m, 2))
        content = 1 - (sum(n * np.log(n) for n in blocks) / sum(blocks) / base if blocks else 0)
        assert abs(importance - (0.1 * entropy(styles) / base + 0.9 * content if m > 1 else 1)) < 1e-8
    assert {(h, p) for h, p, kind, _ in seen if kind == 0} == set(found)


# 7


def slow_print(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WHITE.findall(w)
    s = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [simhash.xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(table, monkeypatch):
    monkeypatch.setattr(simhash, "SIDE", 16)
    r = random.Random(5)
    base = [f"v{r.randrange(30)}" for _ in range(300)]
    near = [" ".join(x if r.random() > 0.004 else "new" for x in base) for _ in range(80)]
    rows = corpus() + [(500 + k, t, None, *NULLS) for k, t in enumerate(near)]
    docs = table(rows, SCHEMA)
    found = simhash.near_duplicates(docs).collect()
    prints = [slow_print(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    least = {}
    for k, row in enumerate(rows):
        if row[0] is not None:
            least[root(k)] = min(least.get(root(k), 1 << 60), row[0])
    want = Counter((row[0], prints[k], least.get(root(k))) for k, row in enumerate(rows))
    assert Counter((x.doc_id, x.print % 2**64, x.component) for x in found) == want
    assert max(Counter(root(k) for k in range(len(rows))).values()) > 10
    assert simhash.near_duplicates(table([], SCHEMA)).count() == 0


def test_tiles_meet_every_near_pair(spark):
    r = np.random.default_rng(2)
    prints = r.integers(-(2**62), 2**62, 200)
    flipped = [int(p) ^ (1 << int(a)) ^ (1 << int(b)) for p, (a, b) in zip(prints, r.integers(0, 63, (200, 2)))]
    both = spark.createDataFrame([(int(p),) for p in {*map(int, prints), *flipped}], "print long")
    for blocks in (1, 2, 4, 8):
        got = {frozenset((x.u, x.v)) for x in simhash.links(both, blocks=blocks).collect()}
        assert {frozenset((int(p), f)) for p, f in zip(prints, flipped) if p != f} <= got


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(200, 260)] + [(3, 3), (None, 1)]
    found = dict(map(tuple, components.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert found == {k: 100 for k in range(100, 141)} | {k: 7 for k in (7, *range(200, 260))}


# 8 and 9


def brute_bytes(texts, length):
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])
        yield len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("many", [suffixes.MANY, 1])
def test_suffix_array(table, monkeypatch, many):
    monkeypatch.setattr(suffixes, "MANY", many)
    monkeypatch.setattr(repeats, "CHUNK", 7)
    rows = [r for r in corpus(n=40) if len(r[1] or "") < 60_000]
    r = random.Random(9)
    passage = rows[45][1]
    rows += [(700 + k, " ".join(x if r.random() > 0.02 else str(r.random()) for x in passage.split()), None, *NULLS) for k in range(40)]
    found = suffixes.strip_repeats(table(rows, SCHEMA)).collect()
    want = Counter(zip((x[0] for x in rows), brute_bytes([(x[1] or "").encode() for x in rows], 200)))
    assert Counter((x.id, (x.n_bytes, x.n_removed, len(x.spans), x.kept_sha256)) for x in found) == want
    assert suffixes.strip_repeats(table([], SCHEMA)).count() == 0


def brute_words(rows, length=13):
    key = lambda k: (k is None, k or 0)
    first = {}
    words = [WHITE.findall(t or "") for _, t, *_ in rows]
    for (k, *_), w in zip(rows, words):
        for p in range(len(w) - length + 1):
            x = tuple(w[p : p + length])
            first[x] = min(first.get(x, (True, 0)), key(k))
    for (k, *_), w in zip(rows, words):
        gone = {p + i for p in range(len(w) - length + 1) if first[tuple(w[p : p + length])] < key(k) for i in range(length)}
        yield k, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()


@pytest.mark.parametrize("many", [automata.MANY, 1])
def test_substrings(table, monkeypatch, many):
    monkeypatch.setattr(automata, "MANY", many)
    monkeypatch.setattr(repeats, "CHUNK", 7)
    rows = corpus()
    r = random.Random(9)
    passage = rows[65][1]
    rows += [(700 + k, " ".join(x if r.random() > 0.02 else str(r.random()) for x in passage.split()), None, *NULLS) for k in range(40)]
    found = automata.strip_copied(table(rows, SCHEMA)).collect()
    assert Counter((x.id, x.n_words, x.n_removed, x.kept_sha256) for x in found) == Counter(brute_words(rows))
    assert automata.strip_copied(table([], SCHEMA)).count() == 0


def test_long_texts_are_cut_into_segments(table, monkeypatch):
    r = random.Random(6)
    words = [f"w{r.randrange(5000)}" for _ in range(3000)]
    texts = [" ".join(words), " ".join(words[700:1500]), " ".join(words[:40]), None]
    rows = [(k, t, None, *NULLS) for k, t in enumerate(texts)]
    monkeypatch.setattr(suffixes, "PORTION", 900)
    monkeypatch.setattr(automata, "PORTION", 150)
    docs = table(rows, SCHEMA)
    found = suffixes.strip_repeats(docs).collect()
    assert Counter((x.id, (x.n_bytes, x.n_removed, len(x.spans), x.kept_sha256)) for x in found) == Counter(zip(range(4), brute_bytes([(t or "").encode() for t in texts], 200)))
    found = automata.strip_copied(docs).collect()
    assert Counter((x.id, x.n_words, x.n_removed, x.kept_sha256) for x in found) == Counter(brute_words(rows))
    assert b" ".join(automata._pieces(texts[0].encode(), 50)).split() == texts[0].encode().split()


def test_windows_too_long_for_a_shape():
    with pytest.raises(ValueError):
        suffixes.kind(repeats.SHAPE + 200)
    with pytest.raises(ValueError):
        automata.kind(repeats.SHAPE + 200)


def test_deep_shallow_order():
    r = random.Random(1)
    words = [bytes(r.choice(b"ab\0") for _ in range(r.randint(0, 9))) for _ in range(300)] + [b"x" * 90 + bytes([r.randrange(3)]) * r.randint(0, 4) for _ in range(60)]
    order, shared = suffixes.deep_shallow(words)
    assert [words[k] for k in order] == sorted(words)
    assert shared.tolist()[1:] == [suffixes.common(words[a], words[b]) for a, b in zip(order[:-1], order[1:])]


# 10


def slow_counts(text):
    text = text or ""
    w = WHITE.findall(text)
    seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    hit = {k + i for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for i in range(3)}
    own = [x for x in text.split("\n") if WHITE.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(own) - len(set(own)), len(hit)


def test_quality_counts(table):
    docs = table(corpus(), SCHEMA)
    trees = quality.grow(np.zeros((0, 9)), np.zeros(0), [0] * 9)
    for r in docs.select("text", quality.verdict("text", trees).alias("q")).collect():
        counts = slow_counts(r.text)
        assert tuple(r.q[c] for c in quality.COUNTS) == counts
        assert r.q.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0]) and r.q.kept == (not r.q.base_failed)


def test_trees_hold_out_and_are_monotonic(spark):
    docs, labels = spark.read.parquet(f"{SF}/../sf0.1/documents.parquet"), spark.read.parquet(f"{SF}/../sf0.1/labels.parquet")
    trees = quality.fit(docs, labels.where("doc_id % 4 <> 0"))
    held = docs.join(labels.where("doc_id % 4 = 0 AND quality IS NOT NULL"), "doc_id").select("quality", quality.verdict("text", trees).alias("q")).select("quality", "q.score").toPandas()
    assert ((held.score >= 0) == (held.quality > 0)).mean() > 0.95
    x = np.random.default_rng(0).random((500, 9))
    for k, name in enumerate(quality.FEATURES):
        if name in quality.MONOTONE:
            more = x.copy()
            more[:, k] += 0.3
            assert (trees.score(more) <= trees.score(x) + 1e-12).all()


def test_labels_of_one_class_or_none(table):
    docs = table(corpus(), SCHEMA)
    for labels in ([], [(1, None), (2, 1), (2, 1)]):
        trees = quality.fit(docs, table(labels, "doc_id long, quality int", "l"))
        assert all(r.q.kept != r.q.base_failed for r in docs.select(quality.verdict("text", trees).alias("q")).collect())


# pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {0: docs}
    for k, (name, stage) in enumerate(pipeline.STAGES[:-1]):
        stage(spark, kept[k], SF).write.parquet(path := str(tmp_path / name))
        kept[k + 1] = spark.read.parquet(path)
        assert kept[k + 1].columns == columns
    ids = {k: {r.doc_id: r.text for r in df.collect()} for k, df in kept.items()}
    prints = {k: slow_print(t) for k, t in ids[1].items()}
    assert all(any((prints[k] ^ prints[j]).bit_count() <= 2 for j in ids[1] if j != k) for k in ids[1].keys() - ids[2].keys())
    assert all((prints[a] ^ prints[b]).bit_count() > 2 for a in ids[2] for b in ids[2] if a < b)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert ids[3] == {k: t for k, t in ids[2].items() if not brute_hits(t, items)[1]}
    words = sum(len(WHITE.findall(t or "")) for t in ids[3].values())
    taken = sum(len(WHITE.findall(r.text or "")) for r in kept[4].collect())
    assert abs(taken - 1.5 * words) < 0.1 * words
    out = pipeline.run(spark, SF).collect()
    whole = tokens.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    coded = [(r.doc_id, np.array([*whole.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")) for r in kept[4].collect()]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == Counter((k, len(ids), zlib.crc32(ids.tobytes())) for k, ids in coded)
    out.sort(key=lambda r: r.start)
    assert [r.start for r in out] == [0, *np.cumsum([r.n_tokens for r in out])[:-1]] and [r.doc_id for r in out] == sorted(r.doc_id for r in out)


def test_pipeline_keeps_one_of_each_group(spark, table):
    import corpus_pipeline as pipeline

    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(5, a), (5, a), (7, a), (5, b), (8, b), (None, b), (None, c), (None, c), (9, "x"), (9, "x"), (9, "y z")]
    docs = table(rows, "doc_id long, text string")
    found = Counter(tuple(r) for r in pipeline.near_duplicates(spark, docs, SF).collect())
    assert found == Counter([(5, a), (5, b), (None, c), (9, "x"), (9, "y z")])


def test_pipeline_leaves_columns_alone(spark, table):
    import corpus_pipeline as pipeline

    named = [(k, f"{'a b c d e f g h'.replace(' ', f'{k} ')} " * 8, "en", "s", 1, 7 + k, "q", "h", "r", "p", "f") for k in range(6)]
    docs = table(named, "doc_id long, text string, lang string, source string, n_chars long, _quality int, _hits string, _q string, __row string, _place string, __file string")
    for _, stage in pipeline.STAGES[1:-1]:
        found = stage(spark, docs, SF)
        assert found.columns == docs.columns
        assert {tuple(r) for r in found.collect()} <= set(named)


def test_pipeline_keeps_one_of_near_copies_without_ids(spark, table):
    import corpus_pipeline as pipeline

    words = [f"n{k}" for k in range(400)]
    near = (" ".join([*words[:k], "new", *words[k + 1 :]]) for k in range(400))
    text = " ".join(words)
    copy = next(t for t in near if 0 < (slow_print(t) ^ slow_print(text)).bit_count() <= 2)
    docs = table([(None, text), (None, copy), (None, "other words " * 30)], "doc_id long, text string")
    kept = [r.text for r in pipeline.near_duplicates(spark, docs, SF).collect()]
    assert len(kept) == 2 and (text in kept) != (copy in kept)


def test_pipeline_with_nulls(spark, table):
    import corpus_pipeline as pipeline

    docs = table([(None, "a b c " * 30, None, None, None), (None, None, None, None, None), *[(k, " ".join(f"t{k * j % 97}" for j in range(1, 80)), "en", "s", 1) for k in (3, 3, 4, 5)]], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() >= 0, name


# rows


def test_rows_keep_their_number_however_files_are_split(spark, table, tmp_path, monkeypatch):
    import corpus_pipeline as pipeline

    path, size = str(tmp_path / "parts"), "spark.sql.files.maxPartitionBytes"
    docs = table(corpus(), SCHEMA)
    docs.repartition(6, "text").write.parquet(path)
    docs, before = spark.read.parquet(path), spark.conf.get(size)

    def resplit(session, turn=[0]):
        turn[0] += 1
        session.conf.set(size, ("400", before)[turn[0] % 2])

    runs = [lambda: lines_.strip_chunks(docs).drop("id"), lambda: automata.strip_copied(docs), lambda: suffixes.strip_repeats(docs), lambda: pipeline.near_duplicates(spark, docs, SF).select("doc_id", "text")]
    want = [Counter(map(repr, run().collect())) for run in runs]
    kept = lambda of: lambda df, name: (of(df, name), resplit(df.sparkSession))[0]
    for module in (lines_, repeats, simhash, components):
        monkeypatch.setattr(module, "keep", kept(module.keep))
    try:
        for run, whole in zip(runs, want, strict=True):
            assert Counter(map(repr, run().collect())) == whole
    finally:
        spark.conf.set(size, before)


def test_line_spans_are_not_broadcast(spark, table, monkeypatch):
    """Small tables are joined as large ones are: only the files' names are broadcast, and digests that several texts share."""
    plans, write = [], lines_.keep

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(lines_, "keep", seen)
    docs = table([(k, f"a{k}\nsame one\nsame two\nsame three\nsame four\nz{k}") for k in range(20)], "doc_id long, text string")
    out = lines_.strip_chunks(docs)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    joins = [line for plan in plans for line in plan.splitlines() if "BroadcastHashJoin" in line and "LeftAnti" not in line]
    assert joins and all("__file" in line for line in joins)
    assert out.agg({"n_removed_lines": "sum"}).first()[0] > 0
