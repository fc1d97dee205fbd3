"""Each operator against a brute-force version on small tables with nulls, empty texts, long texts, repeated rows, ties, and clashing columns."""

import base64
import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from textward.llm import ann, byte_bpe, chat, components, decontaminate, html_text, licenses, repair_ids, shards, shingle_join, toxicity

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
ODD = [None, "", " ", "a" * 3000, "  \n\n x \x1c\x1d y\x85z ²³½ ①一二", "<|endoftext|> don't I'll 'S", "é" * 300 + " " * 300, "\U0001f600" * 99 + "́a", "ab\x00c\x0b", "same text here", "same text here"]


def table(spark, texts, **more):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    return df.withColumns({"score": F.lit("x"), "n_words": F.lit(1), "node": F.lit(2), "id": F.lit(3), "s": F.lit(None).cast("string")})


def test_byte_bpe_equals_tiktoken(spark):
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = byte_bpe.round_trip(table(spark, ODD), RANKS, P.PATTERN).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        text = ODD[r.doc_id] or ""
        ids = enc.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    both = byte_bpe.decode(byte_bpe.encode(table(spark, ODD), RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert {r.doc_id: bytes(r.decoded).decode() for r in both.collect()} == {k: t or "" for k, t in enumerate(ODD)}
    assert byte_bpe.round_trip(table(spark, []), RANKS, P.PATTERN).count() == 0


def test_very_long_words_equal_tiktoken():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder, rng = byte_bpe.Coder(RANKS, P.PATTERN), random.Random(1)
    texts = ["".join(rng.choices(of, k=n)) for of, n in (("acgt", 3_000), ("ab", 5_000), ("a", 7_001), ("aab", 4_000), ("thequickandofin", 20_000), ("éüñaeiou", 3_000), ("abcdefghijklmnopqrstuvwxyz", 100_000))] + ["the" * 3000, "!?" * 2500, "=" * 9_999]
    assert coder.encode(texts).to_pylist() == [enc.encode_ordinary(t) for t in texts]


def test_levenshtein_automaton_equals_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    terms = ["idiot", "moron", "disgusting", "scum", "worthless"]
    finder = toxicity.Finder(toxicity.Lexicon({t: 1.0 for t in terms}, {"lowei": 1.0}))
    rng = random.Random(3)
    words = {"loweiung", "lowe", "scam", "scum"}
    for t in terms:
        for _ in range(200):
            w = list(t)
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = rng.choice(["", "x", "i", "s"])
            words.add("".join(w))
    found = finder.look(words)
    for w in words:
        near = w.startswith("lowei") or any(distance(t, w) <= toxicity.edits(len(w)) for t in terms)
        assert (w in found) == near, w


def test_nearest_entry_of_a_large_lexicon():
    rng = random.Random(6)
    terms = sorted({"".join(rng.choices("abcdefghijkl", k=rng.randint(4, 11))) for _ in range(3_000)})
    lexicon = toxicity.Lexicon({t: 0.9 for t in terms[100:]}, {t[:5]: 0.8 for t in terms[:100]})
    finder = toxicity.Finder(lexicon)
    # words as they are come from themselves or from the least stem that begins them, at no edits
    for w in terms[100:600]:
        begun = [s for s in lexicon.stems if w.startswith(s)]
        assert toxicity.match(finder.trie, w) == (("stem", min(begun), 0) if begun else ("word", w, 0))
    # a letter left out, changed or added is one edit at most, and no word is missed for its parts
    odd = {w[:k] + x + w[k + n :] for w in terms[100:400] for k, x, n in ((2, "", 1), (3, "z", 1), (1, "z", 0), (0, "z", 0), (len(w), "z", 0)) if len(w) > 6}
    assert finder.look(odd) == odd and max(finder.hits[w][2] for w in odd) == 1
    began = time.time()
    assert finder.features(" ".join(terms[100:]))[3] > 0.75
    assert time.time() - began < 20


def test_quotation_counts_apart():
    finder = toxicity.Finder(toxicity.Lexicon({"idiot": 1.0}, {}, frozenset({"idiom"})))
    for t in ('he said "idiot" in the report', "the term 'idiot' was cited", "er schrieb „idiot“ dazu", "a word «idiot» there", 'the word "idiot" and "river"'):
        assert finder.features(t)[:2] == [0.0, np.log(2)], t
    for t in ("you idiot", "don't be an idiot, it's you", 'he said "river" idiot "stone" you', "“you” said the idiot, “no”"):
        assert finder.features(t)[:2] == [np.log(2), 0.0], t
    assert finder.features("you idiot")[2] == np.log(2) and finder.features("an idiom") == [0.0] * 4
    assert finder.features("idiiot")[0] == np.log1p(toxicity.MISSPELLED)
    assert finder.features(None) == finder.features("") == [0.0] * 4


def test_toxicity_learns_and_leaves_clean_texts(spark):
    rng = random.Random(1)
    plain = ["river", "stone", "cloud", "paper", "garden", "window", "bridge", "candle", "meadow", "lantern"]
    texts = [" ".join(rng.choices(plain, k=40)) + (" wretched" if k % 4 == 0 else "") for k in range(400)] + [None, "", "the wretchd ones and a wrethced river", 'he wrote "wretched" in the report', "wretched " * 20_000]
    texts += [texts[0]] * 2  # repeated rows of one id
    docs = table(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") > 404, 404).otherwise(F.col("doc_id")))
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)] + [(None, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    assert list(model.lexicon.words) == ["wretched"] and not model.lexicon.stems
    rows = toxicity.score(docs, model).collect()
    out = {r.doc_id: r.score for r in rows}
    assert all((out[k] >= 0.3) == (k % 4 == 0) for k in range(400)) and out[400] < 0.3 and out[401] < 0.3
    # misspelled alone, quoted alone, and a very long one
    assert out[402] >= 0.3 and out[403] < 0.3 and out[404] >= 0.3
    assert len(rows) == len(texts) and "node" in rows[0].asDict()
    assert toxicity.learn(docs, labels.limit(0)).score([0.0] * 4) < 1e-9
    assert toxicity.score(docs.limit(0), model).count() == 0 and toxicity.learn(docs.limit(0), labels).lexicon == toxicity.Lexicon()


def test_toxicity_of_rows_without_an_id(spark, tmp_path):
    from textward.llm import queries

    rng = random.Random(4)
    texts = [" ".join(rng.choices(["river", "stone", "cloud", "paper", "garden", "window"], k=30)) + (" wretched" if k % 2 else "") for k in range(120)]
    spark.createDataFrame([*enumerate(texts), (None, "a wretched one"), (None, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2) for k in range(120)] + [(None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = [r for r in queries.op2_toxicity(spark, str(tmp_path)).collect() if r.doc_id is None]
    assert [r.held_out for r in got] == [False, False]


def test_toxicity_counts_terms_as_by_hand(spark):
    texts = ["idiot here", "idiot here", "an idiot there", "river here", None, ""]
    rows = spark.createDataFrame([(t, int("idiot" in (t or ""))) for t in texts], "text string, toxic int")
    got = {(r.term, r.kind): (r.t0 + r.t1, r.c0 + r.c1) for r in toxicity._counted(rows).collect()}
    want = {("idiot", "word"): (2, 0), ("here", "word"): (1, 1), ("an", "word"): (1, 0), ("there", "word"): (1, 0), ("river", "word"): (0, 1), ("idio", "stem"): (2, 0), ("ther", "stem"): (1, 0), ("rive", "stem"): (0, 1)}
    assert got == want


def brute_scan(text, model):
    """scan() in plain Python: (family, confirmed) of each line or paragraph that is not unknown."""
    norm = lambda t: " " + " ".join(re.findall("[a-z0-9]+", t.lower())) + " "
    out = []

    def one(t):
        held = [g for g in model.weights if g in norm(t)]
        if not held:
            return None
        z = np.array(model.intercepts) + sum(np.array(model.weights[g]) for g in held)
        p = np.exp(z - z.max())
        p /= p.sum()
        family, confirmed = model.families[int(p.argmax())], False
        for t in licenses.TEMPLATES.get(family, ()):
            g = licenses.grams(t)
            naming = [x for x in g if not licenses.NAMED.isdisjoint(x.split())]
            confirmed |= 2 * len(set(g) & set(held)) >= len(g) and (not naming or not set(naming).isdisjoint(held))
        return None if family == licenses.UNKNOWN or p.max() < model.threshold else (family, bool(confirmed), round(float(p.max()), 9))

    for t in re.split("\n[ \t\r]*\n", text or ""):
        lines = [x for x in map(one, t.split("\n")) if x and x[1]]
        out += lines or [x for x in [one(t)] if x]
    return out


@pytest.fixture(scope="module")
def licence_model(spark):
    own = ["The river is long.", "Cloud and stone.", "The river goes to the sea.\nA stone is under a cloud.", "free of the wind\n\nit is to the left", "Licensed under the Foo license", None, ""] * 4
    return licenses.learn(spark.createDataFrame([(k, t) for k, t in enumerate(own)], "doc_id long, text string"))


LICENCES = [
    ("Foo\nReleased under the MIT License.\n\nbar", "mit"), ("Licensed under the Apache License, Version 2.0.", "apache"), ("a driving license must be renewed", ""), ("word " * 3000 + "\nLicensed under CC BY-NC 4.0.", "cc"), ("Available under CC BY-SA 4.0.", "cc"),
    ("x\nSPDX-License-Identifier: GPL-3.0", "gpl"), ("Licensed under the BSD 3-Clause License", "bsd"), ("Licensed under the Foo license", ""), ("Licensed under X", ""), ("Licensed under the Eclipse Public License 2.0", ""), ("a CC, a by-law\nand 4 0", ""),
    ("This software is licensed under the Affero General Public License version 3", ""), ("SPDX-License-Identifier: ISC", ""), ("MIT License", "mit"), ("GNU GENERAL PUBLIC LICENSE", "gpl"), ("Mozilla Public License 2.0", "mpl"), ("Creative Commons Attribution 4.0 International License", "cc"),
    ("All rights reserved.", "proprietary"), ("Licensed under GPL v3", "gpl"), ("GPL-3.0-or-later", "gpl"), ("Permission is hereby granted, free\nof charge, to any person obtaining\na copy of this", "mit"), ("Released under the MIT\nLicense.", "mit"),
    ("Released under the MIT License.\nLicensed under CC BY-NC 4.0.\nbar", "cc,mit"), ("mit students released the general version", ""), ("all rights of the author are reserved to the public", ""), (None, ""), ("", ""), (" \n\n \t\n", ""), ("\u0130 xmit license", ""),
]


def test_licences(spark, licence_model):
    docs = table(spark, [t for t, _ in LICENCES]).withColumns({c: F.lit(1) for c in ("found", "families", "grams", "label", "features")})
    rows = {r.doc_id: r for r in licenses.per_document(docs, licence_model).collect()}
    assert [rows[k].families for k in range(len(LICENCES))] == [f for _, f in LICENCES]
    assert rows[0].n_paragraphs == 2 and rows[25].n_paragraphs == rows[26].n_paragraphs == rows[27].n_paragraphs == 0
    assert licence_model.calibration_error < 0.1
    twice = licenses.per_document(docs.unionByName(docs), licence_model)
    assert twice.count() == 2 * len(LICENCES) and twice.distinct().count() == len(LICENCES) and licenses.per_document(docs.limit(0), licence_model).count() == 0


def test_licence_scan_equals_plain_python(spark, licence_model):
    rng = random.Random(4)
    pool = sorted({w for g in licence_model.weights for w in g.split()}) + ["river", "stone", "affero"]
    texts = [t for t, _ in LICENCES] + ["".join(rng.choice(pool) + rng.choice([" ", " ", " ", "\n", "\n\n", "-"]) for _ in range(rng.randrange(40))) for _ in range(300)]
    texts += [f.format(n).title() for f in licenses.FRAMES for n in (*licenses.UNLISTED_NAMES, "MIT license", "gnu general public license")]
    rows = table(spark, texts).select("doc_id", licenses.scan(F.col("text"), licence_model).alias("f")).collect()
    for r in rows:
        assert [(x.family, x.confirmed, round(x.probability, 9)) for x in r.f] == brute_scan(texts[r.doc_id], licence_model), texts[r.doc_id]


def test_shards_fit_and_keep_all_rows(spark):
    texts = [None, "", *("x" * (k % 50) for k in range(300)), "y" * 500]
    rows = shards.assign(table(spark, texts), 200, bits=4).collect()
    assert len(rows) == len(texts)
    total: dict = {}
    for r in rows:
        key = (r.depth, r.prefix, r.overflow)
        total.setdefault(key, [0, 0, r.shard_bytes])
        total[key][0] += r.n_bytes
        total[key][1] += 1
    assert all(b == held for b, _, held in total.values())
    assert [r.doc_id for r in rows if not r.fits] == [len(texts) - 1]
    repeated = spark.createDataFrame([(7, "x" * 90)] * 50, "doc_id long, text string")
    again = shards.assign(repeated, 200, bits=30).collect()
    assert len(again) == 50 and all(r.shard_bytes <= 200 for r in again)


def test_decontamination_equals_search(spark):
    items = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short item!"), (3, None), (4, "..."), (10, "SHORT  item")]
    texts = [None, "", "x. ONE two three-four five six seven eight nine ten; y", "a short item b short item", "two three four five six seven eight nine ten eleven twelve é short", *ODD]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.find(table(spark, texts), bench).collect()}
    fold = lambda t: [w.decode() for w in decontaminate.words((t or "").encode())]
    for k, t in enumerate(texts):
        w, hit, which = fold(t), set(), set()
        for item, text in items:
            iw = fold(text)
            n = min(10, len(iw))
            for a in range(len(iw) - n + 1 if n else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == iw[a : a + n]:
                        hit |= set(range(b, b + n))
                        which.add(str(item))
        assert (got[k].n_words, got[k].hit_words, got[k].item_ids) == (len(w), sorted(hit), sorted(which))
    s = got[3].spans
    assert [texts[3][x.start : x.end] for x in s] == ["short item", "short item"]
    assert decontaminate.find(table(spark, texts), bench.limit(0)).where(F.size("hit_words") > 0).count() == 0


def test_windows_of_few_words_equal_search():
    # words that repeat: failure links and patterns within patterns matter, and texts are longer than a lane
    rng = random.Random(5)
    for _ in range(40):
        say = lambda n: b" ".join(rng.choice([b"a", b"b", b"Bb", b"\xc3\xa9"]) for _ in range(rng.randrange(n)))
        width = rng.randrange(1, 6)
        items = [(rng.choice(["x", "y", "z", None]), say(9)) for _ in range(rng.randrange(6))]
        texts = [say(400), b"", *(say(7) + b". c-" + say(9) for _ in range(30))]
        for text, (n, hit, found) in zip(texts, decontaminate.Windows(items, width).scan(texts), strict=True):
            w, want, which = decontaminate.words(text), set(), set()
            for item, raw in items:
                iw = decontaminate.words(raw)
                m = min(width, len(iw))
                for a in range(len(iw) - m + 1 if m else 0):
                    for b in range(len(w) - m + 1):
                        if w[b : b + m] == iw[a : a + m]:
                            want |= set(range(b, b + m))
                            which.add(item)
            assert (n, hit.tolist(), found) == (len(w), sorted(want), sorted(which, key=lambda x: (x is None, x)))


def test_decontamination_in_pieces_and_chunks(spark, monkeypatch):
    text = "and so on, " * 300 + "the fox has been here before" + " and so on" * 300
    docs = table(spark, [text, "the Fox has; been", None])
    items = spark.createDataFrame([(k, f"the fox has {w} here before") for k, w in enumerate(["been", "not", "been", "never"])] + [(9, "so on and")], "item_id long, text string")
    want = sorted(map(tuple, decontaminate.find(docs, items, 4).collect()), key=str)
    assert [r.item_ids for r in decontaminate.find(docs, items, 4).orderBy("doc_id").collect()] == [["0", "2", "9"], ["0", "2"], []]
    for piece, chunk in ((50, 8_000_000), (1_000_000, 60)):
        monkeypatch.setattr(decontaminate, "PIECE", piece)
        monkeypatch.setattr(decontaminate, "CHUNK_BYTES", chunk)
        assert sorted(map(tuple, decontaminate.find(docs, items, 4).collect()), key=str) == want


def test_decontamination_finds_items_without_an_id(spark):
    import duckdb
    from textward.llm import queries

    bench = spark.createDataFrame([(None, "Hidden passage here"), (None, "other one"), (5, "known item"), (6, None)], "item_id long, text string")
    docs = table(spark, ["a hidden passage, here", "the known item and other one", "hidden passage", None])
    got = {r.doc_id: r for r in decontaminate.digest(decontaminate.find(docs, bench)).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE benchmark AS SELECT * FROM (VALUES (NULL::BIGINT, 'Hidden passage here'), (NULL, 'other one'), (5, 'known item'), (6, NULL)) t(item_id, text)")
    con.execute("CREATE TABLE documents AS SELECT * FROM (VALUES (0, 'a hidden passage, here'), (1, 'the known item and other one'), (2, 'hidden passage'), (3, NULL)) t(doc_id, text)")
    want = con.execute(queries.ORACLE["op5_decontaminate"]).fetchall()
    assert {r[0]: tuple(got[r[0]])[1:] for r in want} == {r[0]: r[1:] for r in want} and [got[k].contaminated for k in range(4)] == [True, True, False, False]


def test_neighbours_are_found(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((600, 16))
    v[100:140] = v[100]
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(600, None), (601, [0.0] * 16), (602, [float("nan")] * 16), (603, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.Index(df).search(ann.queries_of(df, 20)).collect()
    assert {r.query_id for r in got} == set(range(0, 600, 20))
    hits = 0
    for q in range(0, 600, 20):
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        s = v @ v[q]
        want = [k for k in np.lexsort((np.arange(600), -s)).tolist() if k != q][:20]
        assert [r[0] for r in mine] == list(range(1, 21)) and all(abs(s[k] - x) < 1e-9 for _, k, x in mine)
        hits += len(set(want) & {k for _, k, _ in mine})
    assert hits >= 0.9 * 20 * 30
    small = df.where("vec_id < 3")
    assert sorted((r.query_id, r.vec_id) for r in ann.Index(small).search(ann.queries_of(small, 20)).collect()) == [(0, 1), (0, 2)]
    assert ann.Index(df.limit(0)).search(ann.queries_of(df.limit(0), 20)).count() == 0


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("plain <b>x</b>", "plain x"), ("<p>a<p>b  \n c", "a\nb c"), ("<body><nav>m</nav><article><h1>T &amp; u</h1><p>one<br>two</p><aside>no</aside></article><footer>f</footer>", "T & u\none two"),
        ("<body><div class='ad'>Buy</div><div id=main><p>Long text that is here.</p><p>More of it.</p></div><div class=comments><p>Reader</p></div>", "Long text that is here.\nMore of it."),
        ("<script>var t='</p>'</script><p>x</p></div></b>", "x"), ("<p>" + "w " * 30000 + "</p>", ("w " * 30000).strip()),
    ],
)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


def test_page_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x</p>")] * 2 + [(2, None, None), (None, "v", "")], "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("text", "n_chars", "id")})
    got = sorted(map(tuple, html_text.extract(pages).collect()), key=str)
    assert got == sorted([(1, "u", "x", 1)] * 2 + [(2, None, "", 0), (None, "v", "", 0)], key=str)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_density_sums_equal_plain_recursion():
    rng = random.Random(6)
    tags = ["div", "p", "a", "b", "ul", "li", "article", "span"]

    def page(depth):
        if depth == 0 or rng.random() < 0.2:
            return "word " * rng.randrange(30)
        t = rng.choice(tags)
        return f"<{t}>" + "".join(page(depth - 1) for _ in range(rng.randrange(4))) + f"</{t}>"

    for _ in range(60):
        tree = html_text.Tree()
        tree.feed("<body>" + "".join(page(4) for _ in range(4)) + "</body>")
        tree.close()
        chosen = html_text.main_nodes(tree.root)

        def count(node):
            """(characters, tags, those in links)"""
            kids = [count(x) for x in node.parts if not isinstance(x, str)]
            c = sum(len(" ".join(x.split())) for x in node.parts if isinstance(x, str)) + sum(k[0] for k in kids)
            t, lt = sum(k[1] + 1 for k in kids), sum(k[3] + (x.tag == "a") for k, x in zip(kids, [x for x in node.parts if not isinstance(x, str)]))
            return c, t, c if node.tag == "a" else sum(k[2] for k in kids), lt

        nodes = html_text._walk(tree.root)
        assert all((n.chars, n.tags, n.link_chars, n.link_tags) == count(n) for n in nodes)
        body = next(n for n in nodes if n.tag == "body")
        if body.chars:
            # nothing has a larger sum than what is marked as the best, and no chosen subtree is below the path's threshold
            blocks = [n for n in nodes if n is not tree.root and (n.block or n is body) and n.chars and all(a.block or a is body or a is tree.root for a in _above(n))]
            assert body.best.total == max(n.total for n in blocks)
            least = min(n.density for n in [body.best, *_above(body.best)] if n is not tree.root)
            assert all(n.density >= least for n in chosen if n.tag)


def _above(node):
    out = []
    while node.parent is not None:
        node = node.parent
        out.append(node)
    return out


_LONG = "".join(f"<p>Paragraph {k} of the article, which is as long as paragraphs are, with some words {k} and then more of them.</p>" for k in range(2))


@pytest.mark.parametrize("box", ["<div class='related'>", "<div class='share-story'>", "<section id='comment-on-law'>", "<form id=aspnetForm>"])
def test_an_article_in_a_box_of_a_listed_name_is_kept(box):
    html = f"<body><nav><a href=/>Home</a><a href=/b>More</a></nav>{box}{_LONG}</{box[1:].split()[0].rstrip('>')}><footer>Imprint</footer></body>"
    assert html_text.main_text(html) == re.sub("<p>(.*?)</p>", r"\1\n", _LONG).strip()


def test_comments_longer_than_the_article_go():
    comments = "<p>A comment that is long, longer and longer, so that it would win over the text above it, which it must not.</p>" * 9
    assert html_text.main_text(f"<body><article>{_LONG}</article><div class=comments>{comments}</div></body>").count("\n") == 1
    assert html_text.main_text(f"<body><div class=ad>{'Buy this now, it is the best of all that can be bought. ' * 3}</div><article><h1>T</h1><p>Short text of it.</p></article></body>") == "T\nShort text of it."


_LEFT = "<div class=left><ul>" + "".join(f"<li><a href=/{k}>Topic {k}</a></li>" for k in range(12)) + "</ul></div>"
_TITLE = "A title, or a first line, that is as long as titles seldom are, but short beside all of the text that comes below it"
_BOX = "<p>" + "A long text beside the article, of many words and without a link. " * 9 + "</p>"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<body><article><p>Two short lines.</p><p>Second one.</p></article><div id=comments>{_BOX}</div></body>", "Two short lines.\nSecond one."),
        (f"<body><article><p>Two short lines.</p><p>Second one.</p></article><div class=related>{_BOX}</div></body>", "Two short lines.\nSecond one."),
        (f"<body><div>Two short lines.<br>Second one.</div><div class='comment-list'>{_BOX}</div></body>", "Two short lines. Second one."),
        (f"<body><article>{_LONG}<p class=share-price>Price: 30.</p><section id=ad-hoc><p>A notice.</p></section><div class=ad-box>Buy</div></article></body>", re.sub("<p>(.*?)</p>", r"\1\n", _LONG) + "Price: 30.\nA notice."),
        (f"<body><div class=content>{_LONG * 4}</div><div class=imprint>A line of the house.</div></body>", re.sub("<p>(.*?)</p>", r"\1\n", _LONG * 4).strip()),
        (f"<body><form id=f><nav><a href=/>Home</a></nav><div class=related>{_LONG}</div></form></body>", re.sub("<p>(.*?)</p>", r"\1\n", _LONG).strip()),
        (f"<body>{_LEFT}<div><h1>{_TITLE}</h1></div><p>{_TITLE}</p><div class=content>{_LONG * 8}</div><div>{_TITLE}</div></body>", f"{_TITLE}\n{_TITLE}\n" + re.sub("<p>(.*?)</p>", r"\1\n", _LONG * 8).strip()),
    ],
)
def test_short_articles_and_boxes_beside_them(html, text):
    assert html_text.main_text(html) == text


def test_neighbour_graph_converges(spark, monkeypatch):
    # two trees of small leaves: a poor first graph, which two rounds do not mend
    monkeypatch.setattr(ann, "TREES", 2)
    monkeypatch.setattr(ann, "LEAF", 16)
    v = np.random.default_rng(8).standard_normal((2_000, 24))
    v /= np.linalg.norm(v, axis=1)[:, None]
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    s = v @ v.T
    np.fill_diagonal(s, -9)
    best = np.argsort(-s, axis=1)[:, :10]
    graph = {r.id: set(r.w) for r in ann.Index(df).graph.collect()}
    assert sum(len(graph[k] & set(best[k].tolist())) for k in range(2_000)) >= 0.97 * best.size


_LEGAL = "<div class=legal><a href=/i>Imprint</a> <a href=/p>Privacy</a> <a href=/t>Terms</a></div>"
_PARAS = [f"Paragraph {k} of the article, which is as long as paragraphs are, with <b>some</b> words {k} and then more of them." for k in range(6)]
_PLAIN = [re.sub("<.*?>", "", x) for x in _PARAS]
_P = "".join(f"<p>{x}</p>" for x in _PARAS)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<body><div id=page>{_LEFT}<div class=post>{_P}</div>{_LEGAL}</div></body>", "\n".join(_PLAIN)),
        (f"<body><div><div><div>{_LEFT}<div><h1>A heading of the article, not a short one at all</h1><div class=text>{_P}</div></div></div>{_LEGAL}</div></div></body>", "\n".join(["A heading of the article, not a short one at all", *_PLAIN])),
        (f"<body>{_LEFT}<div class=post>{_P}</div><div class=more>{_P}{_P}</div>{_LEGAL}</body>", "\n".join(_PLAIN * 3)),
        (f"<body><div id=page>{_LEFT}The text begins without a paragraph, in <i>one</i> long line beside the others.<div class=post>{_P}</div>{_LEGAL}</div></body>", "\n".join(["The text begins without a paragraph, in one long line beside the others.", *_PLAIN])),
        (f"<body><div id=page>{_LEFT}<article><h1>Title</h1><p><b>{_PLAIN[0]} {_PLAIN[1]}</b></p></article>{_LEGAL}</div></body>", f"Title\n{_PLAIN[0]} {_PLAIN[1]}"),
    ],
)
def test_main_text_of_wrapped_and_split_pages(html, text):
    assert html_text.main_text(html) == text


def brute_components(texts):
    sets = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x]
        n = min(5, len(w))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set())
    comp = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(a):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    return [len(s) for s in sets], comp


def test_shingle_join_equals_all_pairs(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(400)]
    texts = [None, "", " \n ", "one two", "ONE  two", "one two three"]
    for _ in range(8):
        base = rng.choices(words, k=rng.choice([8, 40, 120]))
        for _ in range(14):
            t = list(base)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
    passage = " ".join(rng.choices(words, k=60))
    texts += [passage + " " + " ".join(rng.choices(words, k=30)) for _ in range(25)]
    n, comp = brute_components(texts)
    for block in (3_000_000, 1_500):  # the second splits blocks into chunks
        monkeypatch.setattr(shingle_join, "BLOCK", block)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in shingle_join.join(table(spark, texts)).collect()}
        assert got == {k: (a, b) for k, (a, b) in enumerate(zip(n, comp, strict=True))}
    assert shingle_join.join(table(spark, [])).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 140)}, 200: 200}


def test_id_files_round_trip(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = [*ODD, "İSTANBUL ΣΑΣ don't _a_ 12", "the thing " * 500, "<|endoftext|> x", "a<|STARTOFTEXT|>b <|startoftext|>", "x" * 5000, "ein Wort, zwei\u00a0Wörter—drei"]
    assert lib.encode("<|endoftext|> x", add_special_tokens=False).ids == [49407, 343]
    blocks = repair_ids.write(table(spark, texts), P.path("word_bpe_49k.json"), block_ids=400)
    got = {r.doc_id: r for r in repair_ids.read(blocks).collect()}
    at, every = 0, []
    for k, t in enumerate(texts):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
        every += ids
    assert repair_ids.read(repair_ids.write(table(spark, []), P.path("word_bpe_49k.json"))).count() == 0


@pytest.mark.parametrize("top", [3, 50, 40_000])
def test_grammar_random_access(top):
    ids = np.random.default_rng(top).integers(0, top, 5000).astype(np.uint32)
    b = repair_ids.Block(repair_ids.compress(ids, np.array([len(ids)]), 49_408))
    assert (b.expand(b.symbols) == ids).all()
    for i, j in ((0, 1), (0, 5000), (4999, 5000), (123, 3210)):
        assert (b.read(i, j) == ids[i:j]).all()
    empty = repair_ids.Block(repair_ids.compress(ids[:0], np.array([]), 49_408))
    assert len(empty.expand(empty.symbols)) == 0


def test_chat_links(spark):
    calls = [(1, 1, "a", "search", '{"query":"x","limit":3}', None), (1, 1, "b", "lookup", '{"key":1}', ["a"]), (1, 1, "c", "nope", "{", ["b"]), (1, 1, "l1", "count", '{"query":"q"}', ["l2"]), (1, 1, "l2", "count", '{"query":"q"}', ["l1"]),
             (1, 2, "d", "search", '{"query":"x","limit":300}', ["a"]), (1, 2, "e", "count", '{"query":"q","limit":"2"}', ["gone"]), (1, 3, None, "count", None, None)] + [(1, 5, "h", "count", '{"query":"q"}', None)] * 30
    results = [(1, 2, "a", "found"), (1, 2, "a", "found"), (1, 4, "zz", "who"), (1, 4, "d", "x"), (1, 4, "d", "y")]
    out = chat.link(spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, after array<string>"), spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string"), chat.TOOLS)
    got = {r.call_id: (r.status, r.level, r.errors) for r in out.collect()}
    assert got == {
        "a": ("linked", 0, ""), "b": ("no_result", 1, "type:key"), "c": ("no_result", 2, "invalid_json,unknown_tool"), "l1": ("no_result", None, ""), "l2": ("no_result", None, ""), "d": ("ambiguous", 1, "range:limit"),
        "e": ("no_result", None, ""), "zz": ("orphan", None, ""), "h": ("no_result", 0, ""), None: ("no_result", None, "invalid_json"),
    }
    line = out.where("call_id = 'a'").first().json
    assert line == '{"arguments":{"limit":3,"query":"x"},"conv_id":1,"id":"a","level":0,"name":"search","result":"found","status":"linked","turn":1}'


def test_chat_levels_over_all_turns(spark):
    # a chain of 40 turns, a fork and its join, a chain behind the join, two joins in a row, cycles, and lost references
    after = {"t0": None, **{f"t{k}": [f"t{k - 1}"] for k in range(1, 40)}, "f1": ["t39"], "f2": ["t3"], "j": ["f1", "f2", None, "f1"], "k1": ["j"], "k2": ["k1"], "jj": ["k2", "j", "t0"], "o": [],
             "x": ["y"], "y": ["x"], "z": ["y"], "lost": ["gone"], "lost2": ["lost"], "half": ["t1", "gone"], "half2": ["half", "t1"], "zz": ["z", "t1"], "m1": ["m2", "t0"], "m2": ["m1", "t0"]}
    want: dict = {}
    while len(want) < len(want := {c: 1 + max((want[r] for r in refs), default=-1) for c, rs in after.items() if (refs := {r for r in rs or () if r}) <= set(want)}):
        pass
    calls = spark.createDataFrame(list(after.items()), "call_id string, after array<string>")
    got = {r.call_id: r.level for r in chat.levels(calls).collect()}
    assert got == want and want["t39"] == 39 and want["j"] == 41 and want["jj"] == 44 and not {"x", "z", "lost2", "half2", "zz", "m1"} & set(want)
    assert chat.levels(calls.limit(0)).count() == 0


def test_chat_query_equals_its_recursive_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    conversations = spark.read.parquet(f"{sf}/conversations.parquet")
    # a lost reference and an orphan too: some turns are missing
    some = conversations.where("NOT (conv_id % 5 = 1 AND turn = 0)")
    got = sorted(map(tuple, chat.link(*chat.tool_messages(some), chat.TOOLS).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet' WHERE NOT (conv_id % 5 = 1 AND turn = 0)")
    want = sorted(con.execute(chat.SQL).fetchall(), key=str)
    assert got == want
    assert {r[4] for r in got} == {"linked", "no_result", "orphan"} and max(r[3] or 0 for r in got) > 1 and any(r[3] is None and r[4] != "orphan" for r in got)
