import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestitch.llm import chat_format, embedding_neardup, minhash_neardup, packing, quality_classifier, quality_rules, queries, sentencepiece_codec, sharding, token_files, url_filter
from lodestitch.llm._common import cells, components, stored
from lodestitch.llm.tokenizing import encoder

DOCS = "doc_id long, text string, score string, host string"
WORD_BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def docs(spark, rows):
    """Documents with extra columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)


LONG = " ".join(f"word{k % 977} é{k}" for k in range(30_000))
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one two"), (4, "one two"), (None, "no id here"), (5, LONG), (6, "Ångström — naïve \U0001f600 <|endoftext|> ﬁ"), (7, "Ertzßsch zu. Don't 123"), (8, "cafe\u0301"), (9, "a <|endoftext|> b<|startoftext|>c"), (10, " ".join(["a"] * 2047)), (11, " ".join(["a"] * 2048))]


def library(text):
    """The tokenizers library as it comes."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD_BPE).encode(text or "", add_special_tokens=False).ids


def test_shortcut_encodes_as_the_library_does():
    rng = random.Random(3)
    texts = [t or "" for _, t in ODD] + ["<|endoftext|>", "x<|STARTOFTEXT|> <|EndOfText|>y", "<|endoftext|", "<|startoftext|><|endoftext|>", "<|endof\u00adtext|>"] + ["".join(rng.choices("abzéßÖ'stvre 019.,!?\n$£\u0301", k=60)) for _ in range(150)]
    for t in texts:
        assert np.frombuffer(encoder(WORD_BPE).encode(t), "<u4").tolist() == library(t), t


def test_components_match_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 160)] + [(200, k) for k in range(201, 260)]
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[top(a)] = top(b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = sorted({x for a, b in edges if a != b for x in (a, b)})
    assert set(got) == set(nodes)
    assert all((got[a] == got[b]) == (top(a) == top(b)) for a in nodes for b in nodes)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("few", [0, 40, None])
def test_few_edges_are_joined_without_rounds(spark, monkeypatch, few):
    """A chain, a star and a pair: the same components by rounds alone, by both, and in one task, which stores two tables."""
    from lodestitch.llm import _common

    if few is not None:
        monkeypatch.setattr(_common, "FEW_EDGES", few)
    kept = []
    monkeypatch.setattr(_common, "stored", lambda *a: kept.append(1) or stored(*a))
    edges = [(b"%03d" % a, b"%03d" % b) for a, b in [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 130)] + [(200, 201), (201, 200), (300, 300)]]
    got = {bytes(r.node): bytes(r.root) for r in components(spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in edges], "u binary, v binary"), "binary").collect()}
    assert len(got) == 61 + 30 + 2 and all(got[a] == got[b] for a, b in edges if a != b) and len(set(got.values())) == 3
    assert len(kept) == 2 if few is None else len(kept) > 2


def test_classifier_learns_outside_the_driver(spark, monkeypatch):
    import os

    good = "the committee published its yearly report on water quality in rural districts"
    rows = docs(spark, [(k, f"{good} {k}" if k % 2 else f"buy cheap pills now {k}") for k in range(40)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    model = quality_classifier.fit(rows, labels)
    found = [quality_classifier.text_features(r.text) for r in sorted(rows.collect())]
    want = quality_classifier.train([f[0] for f in found], [f[1] for f in found], np.arange(40) % 2)
    assert model.labels == want.labels and np.allclose(model.weights, want.weights, atol=1e-6) and np.allclose(model.bias, want.bias, atol=1e-6)
    monkeypatch.setattr(quality_classifier, "train", lambda *a: quality_classifier.Model([0, 1], np.zeros((quality_classifier.BUCKETS, 2), np.float32), np.array([float(os.getpid()), 0.0])))
    assert quality_classifier.fit(rows, labels).bias[0] != os.getpid()


def test_any_two_rows_of_a_key_meet_in_one_cell(spark):
    rows = spark.createDataFrame([(1, k) for k in range(90)] + [(2, 1)], "key long, id long")
    got = cells(rows, ["key"], F.xxhash64("id"), 20).collect()
    meet = Counter()
    for i, j in {(r.cell_i, r.cell_j) for r in got}:
        own = [(r.id, r.block) for r in got if (r.cell_i, r.cell_j) == (i, j)]
        assert len(own) <= 80
        for a, x in own:
            for b, y in own:
                if a < b and (i == j or x != y):
                    meet[a, b] += 1
    assert len(meet) == 90 * 89 // 2 and set(meet.values()) == {1}


def test_classifier(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    good, bad = [" ".join(word() for _ in range(60)) for _ in range(60)], [" ".join(word() + "$$$" for _ in range(60)) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(good + bad)]
    labels = spark.createDataFrame([(k, int(k < 60), 0) for k in range(120)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_classifier.classify(docs(spark, rows + [(None, None), (500, ""), (5, good[5])]), labels).collect()
    assert len(got) == 123
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 120]
    assert len(held) > 10 and all(r.predicted == (r.doc_id < 60) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    same = [r.score for r in got if r.doc_id == 5]
    assert len(same) == 2 and same[0] == same[1]
    assert [r.score for r in quality_classifier.classify(docs(spark, [(1, "a")]), labels.limit(0)).collect()] == [0.5]
    assert quality_classifier.classify(docs(spark, []), labels).count() == 0
    assert quality_classifier.keep_good(docs(spark, rows), labels).columns == ["doc_id", "text", "score", "host"]


def test_classifier_takes_several_labels_of_an_id_and_very_long_texts(spark):
    rows = [(k, ("fine prose words " if k % 2 else "## && %% ") * 30) for k in range(60)] + [(60, LONG), (61, LONG)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)] + [(1, 1, 0), (1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_classifier.classify(docs(spark, rows), labels).collect()}
    assert all(got[k].predicted == k % 2 for k in range(60)) and got[60].score == got[61].score


def test_scorer_equals_the_features_average():
    model = quality_classifier.Model([0, 1], np.random.default_rng(0).normal(size=(quality_classifier.BUCKETS, 2)).astype(np.float32), np.array([0.1, 0.2]))
    for t in ("a b b b c", "", "Ünï code " * 5):
        rows, counts = quality_classifier.text_features(t)
        z = model.bias + (counts[:, None] * model.weights[rows].astype(float)).sum(axis=0) / max(1, counts.sum())
        p = np.exp(z - z.max())
        assert quality_classifier.Scorer(model).probabilities(t) == pytest.approx(p / p.sum(), abs=1e-6)


def test_training_equals_a_plain_loop():
    rng = random.Random(6)
    texts = [" ".join(rng.choices(["aa", "bb", "cc", "dd"][k % 2 :: 2] + ["ee"], k=5)) for k in range(6)]
    found, y, dim, epochs, rate = [quality_classifier.text_features(t) for t in texts], [k % 2 for k in range(6)], 4, 3, 0.4
    model = quality_classifier.train([f[0] for f in found], [f[1] for f in found], np.array(y), dim, epochs, rate, 3)
    draw = np.random.default_rng(3)
    table = draw.uniform(-1 / dim, 1 / dim, (quality_classifier.BUCKETS, dim)).astype(np.float32)
    used = {int(r): [float(x) for x in table[r]] for f in found for r in f[0]}
    out, bias, step = [[0.0] * dim for _ in range(2)], [0.0, 0.0], 0
    for _ in range(epochs):
        for k in draw.permutation(len(texts)).tolist():
            lr, step = rate * (1 - step / (epochs * len(texts))), step + 1
            rows, counts = found[k][0].tolist(), found[k][1].tolist()
            share = [c / sum(counts) for c in counts]
            mean = [sum(w * used[r][d] for w, r in zip(share, rows)) for d in range(dim)]
            z = [sum(out[c][d] * mean[d] for d in range(dim)) + bias[c] for c in range(2)]
            p = [np.exp(v) / sum(np.exp(z)) - (c == y[k]) for c, v in enumerate(z)]
            back = [sum(p[c] * out[c][d] for c in range(2)) for d in range(dim)]
            for c in range(2):
                bias[c] -= 0.1 * lr * p[c]
                out[c] = [out[c][d] - lr * p[c] * mean[d] for d in range(dim)]
            for w, r in zip(share, rows):
                used[r] = [used[r][d] - lr * len(rows) ** 0.5 * w * back[d] for d in range(dim)]
    for r, v in used.items():
        assert model.weights[r] == pytest.approx([sum(v[d] * out[c][d] for d in range(dim)) for c in range(2)], abs=1e-4)
    assert model.bias == pytest.approx(bias, abs=1e-5)


def test_features_are_words_and_their_character_ngrams():
    assert not hasattr(quality_classifier, "AGAIN")
    rows, counts = quality_classifier.text_features("abcd abcd")
    assert counts.sum() == 2 * (1 + 4 + 3 + 2)  # the word; <ab abc bcd cd>; <abc abcd bcd>; <abcd abcd>
    once = quality_classifier.text_features("abcd")
    assert once[0].tolist() == rows.tolist() and (2 * once[1]).tolist() == counts.tolist()


def test_classifier_sample_is_drawn_from_documents_and_bounded_in_bytes(spark):
    rows = [(k, ("good words here " if k % 2 else "$$$ %%% ") * 20) for k in range(40)] + [(41, LONG)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(5000)], "doc_id long, quality int, toxic int")
    model = quality_classifier.fit(docs(spark, rows), labels, sample=30)
    assert model is not None and model.labels == [0, 1]
    few = quality_classifier.fit(docs(spark, rows), labels, most_bytes=1)
    assert few is not None and len(few.labels) == 1
    none = spark.createDataFrame([(k, 1, 0) for k in range(1000, 1050)], "doc_id long, quality int, toxic int")
    assert quality_classifier.fit(docs(spark, rows), none) is None


def plain_verdict(url, rules):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits) if fits else None


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://Example.ORG/es/a?x#y", "http://a.example.org/en/12", "https://x.com/fr/", "https://x.com/de/1", "http://com", "http://org", "http://xorg/", "http://b.org?/es/", "a://b://c.org/", "http://é.com/fr/\nq", "http://..com/de/", "http://cheap-pills.example.com/en/", "http://" + "a." * 3000 + "org/"]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls + urls[4:6])] + [(None, urls[4], None)], "page_id long, url string, host string")
    entries = url_filter.rule_entries(spark, queries.RULES).unionByName(url_filter.listed_entries(spark.createDataFrame([(u,) for u in queries.LISTED], "url string")))
    got = url_filter.judge(pages, entries).collect()
    assert len(got) == len(urls) + 3
    for r in got:
        host, path, fit = plain_verdict(urls[4] if r.page_id is None else (urls + urls[4:6])[r.page_id], queries.RULES)
        listed = plain_verdict(None, [])[2] is None and host.endswith("cheap-pills.example.com")
        assert (r.host, r.path, r.rule) == (host, path, fit and fit[1])
        assert r.verdict == (fit[2] if fit else "block" if listed else "allow")
    assert url_filter.judge(pages.limit(0), entries).count() == 0
    none = url_filter.judge(pages, entries.limit(0))
    assert {r.verdict for r in none.collect()} == {"allow"}


def test_url_entries_repeated_null_and_canonical(spark):
    rules = [("block", "a.com", "/x"), ("allow", "a.com", "/x"), ("block", "a.com", "/x/y"), ("block", "b.com", ""), (None, "c.com", "/"), ("block", None, "/"), ("block", "", "/")]
    listed = spark.createDataFrame([("https://User@Spam.Example.:8080/ads",), ("spam.example/ads",), (None,), ("",), ("bad.example",)], "url string")
    entries = url_filter.rule_entries(spark, rules).unionByName(url_filter.listed_entries(listed))
    want = {
        "http://a.com/x": ("a.com/x", "allow"), "http://a.com/x/yz": ("a.com/x/y", "block"), "http://a.com/": (None, "allow"), "http://q.b.com": ("b.com", "block"), "http://c.com/": (None, "allow"),
        "http://a.com:80/x": (None, "allow"), "http://spam.example:99/ads/1": (None, "block"), "http://me@www.spam.example./adsense": (None, "block"), "http://spam.example/ad": (None, "allow"),
        "ftp://bad.example?q": (None, "block"), "http://notbad.example/": (None, "allow"), "http:///x": (None, "allow"),
    }
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(want)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, entries).collect()}
    assert {u: got[k] for k, u in enumerate(want)} == want


def test_a_list_of_many_urls_exchanges_only_possible_hits(spark):
    listed = spark.range(100_000).select(F.concat(F.lit("h"), F.col("id") % 5000, F.lit(".example/p"), F.col("id")).alias("url"))
    pages = spark.range(30_000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 100 == 0, F.concat(F.lit("https://www.h"), F.col("id") % 5000, F.lit(".example:443/p"), "id", F.lit("?q"))).otherwise(F.concat(F.lit("https://clean"), "id", F.lit(".example/p1"))).alias("url"))
    judged = url_filter.judge(pages, url_filter.listed_entries(listed))
    got = {r.page_id: r.listed for r in judged.collect()}
    assert len(got) == 30_000 and all(got[k] == (k % 100 == 0) for k in got)
    assert 300 <= url_filter.possible(pages, url_filter.keyed(url_filter.listed_entries(listed))).where("size(hits) > 0").count() <= 600
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

    def names(node):
        yield node.nodeName()
        for k in range(node.children().size()):
            yield from names(node.children().apply(k))

    union = judged._jdf.queryExecution().optimizedPlan()
    assert union.nodeName() == "Union" and "Join" in set(names(union))
    assert not {"Join", "Aggregate", "Generate"} & set(names(union.children().apply(0)))  # pages without a possible hit


def test_bloom_filter_has_no_false_negatives(spark):
    keys = stored(spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key")))
    masks = url_filter.bloom_filter(keys, F.col("key"), 1024)
    assert keys.where(url_filter.may_contain(masks, F.col("key"), 1024)).count() == 3000
    other = spark.range(20000).select(F.concat(F.lit("other"), "id").alias("key"))
    assert other.where(url_filter.may_contain(masks, F.col("key"), 1024)).count() < 2000


def plain_viterbi(codec, text):
    """Best score by trying every piece at every place."""
    scores = {p: (len(p), s, k) for p, (_, s, k) in ((p, codec.automaton.get(p)) for p in codec.automaton.keys())}
    n, low = len(text), float("-inf")
    best = [0.0] + [low] * n
    for end in range(1, n + 1):
        best[end] = best[end - 1] + codec.least
        for start in range(max(0, end - 24), end):
            hit = scores.get(text[start:end])
            if hit:
                best[end] = max(best[end], best[start] + hit[1])
    return best[n]


def test_sentencepiece(spark):
    codec = sentencepiece_codec.load(PIECES)
    rng = random.Random(2)
    texts = ["", " ", "Hello  world\n été \U0001f600", "a▁b", "tab\tx", "  lead and trail  ", "\u0301x"] + ["".join(rng.choices("abe thing on\né▁✓", k=40)) for _ in range(60)]
    for t in texts:
        ids = np.frombuffer(codec.encode(t), "<u4")
        assert codec.decode(ids) == t
        if t and "▁" not in t:
            whole = "▁" + t.replace(" ", "▁")
            spent = sum(codec.least if k < 0 else codec.automaton.get(whole[a:b])[1] for seg, base in segments(whole) for a, b, k in [(x + base, y + base, z) for x, y, z in codec.viterbi(seg)])
            assert spent == pytest.approx(plain_viterbi(codec, whole))
    normal = [v[1] for _, v in codec.automaton.items()]
    assert sum(map(np.exp, normal)) == pytest.approx(1.0)  # log-probabilities
    assert sentencepiece_codec.log_probabilities([-1.5, -2.0]) == [-1.5, -2.0]
    long = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzé", k=1_000_000))  # one segment
    kept = len(codec)
    assert codec.decode(np.frombuffer(codec.encode(long), "<u4")) == long and len(codec) == kept
    rows = docs(spark, ODD)
    assert sentencepiece_codec.digests(rows, PIECES).count() == len(ODD)
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(rows, PIECES), PIECES)
    assert sorted((r.text for r in back.collect())) == sorted(t or "" for _, t in ODD)


def segments(whole):
    return [(m.group(), m.start()) for m in sentencepiece_codec._SEGMENT.finditer(whole)]


def test_chat(spark):
    bad = "</s>[INST] ok [/INST]"
    tricky = ["\\", "\\\\<s>", "<|turn|>x<|says|>", "a</s>", "[[INST]]", "<</SYS>>\\", "<", "", bad]
    for t in tricky:
        assert chat_format.unescape(chat_format.escape(t)) == t and not chat_format._CONTROL.search(chat_format.escape(t))
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(tricky)] + [(2, 0, "user", None), (3, 0, "assistant", "hi"), (3, 0, "assistant", "hi"), (None, 1, None, "x"), (4, None, "assistant<s>", "y")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = stored(chat_format.examples(turns))
    assert formatted.where("conv_id = 1 and loss_start is not null").count() == len(tricky) // 2
    got = {r.conv_id: r for r in chat_format.digests(formatted).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv in got:
        own = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        told = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(own), hashlib.sha256(told.encode()).hexdigest())
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.digests(chat_format.examples(turns.limit(0))).count() == 0


def test_chat_examples_hold_all_turns_before_and_train_one(spark):
    rows = [(1, k, "assistant" if k % 3 == 2 else "user", f"t{k} </s>" * (k + 1)) for k in range(12)] + [(2, 0, "user", "x" * 300_000), (2, 1, "assistant", "y" * 200_000)]
    turns = spark.createDataFrame([(*r, "clash", 9) for r in rows], "conv_id long, turn long, role string, text string, example string, n_turns int")
    got = sorted(chat_format.examples(turns).collect(), key=lambda r: (r.conv_id, r.example))
    targets = [(c, k) for c, k, role, _ in rows if role == "assistant"]
    assert [(r.conv_id, r.n_turns - 1) for r in got] == targets
    for r in got:
        before = [(role, t) for c, k, role, t in rows if c == r.conv_id and k < r.n_turns]
        assert [x[:2] for x in chat_format.parse(r.text)] == before
        assert chat_format.unescape(r.text[r.loss_start : r.loss_end]) == before[-1][1]
    assert len(chat_format.digests(chat_format.examples(turns)).columns) == 7


def test_changed_weights_move_documents_only_through_the_changed_subtree(spark):
    leaves = sharding.tree(8)
    heavier = [sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else x.weight) for x in leaves]
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    got = keys.select(sharding.shard_of(F.col("k"), leaves).alias("a"), sharding.shard_of(F.col("k"), heavier).alias("b")).groupBy("a", "b").count().collect()
    moved = [(r.a, r.b, r["count"]) for r in got if r.a != r.b]
    # shard 5 gains; rack 2 and region 1 grow with it, so documents also come into rack 2 and region 1, and none goes the other way
    assert moved and all((b // 4 == 1 and a // 4 == 0) or (b // 2 == 2 and a // 2 == 3) or (a, b) == (4, 5) for a, b, _ in moved)
    assert not any(b == 4 and a == 5 for a, b, _ in moved)
    sizes = Counter()
    for r in got:
        sizes[r.b] += r["count"]
    total = sum(x.weight for x in heavier)
    squares = sum((sizes[x.shard] - 20_000 * x.weight / total) ** 2 / (20_000 * x.weight / total) for x in heavier)
    assert squares < 24.3  # chi-square of 7 degrees, one case in a thousand
    removed = [x for x in leaves if x.shard != 3]
    gone = keys.select(sharding.shard_of(F.col("k"), leaves).alias("a"), sharding.shard_of(F.col("k"), removed).alias("b")).where("a <> b").distinct().collect()
    assert all(r.b != 3 and (r.a == 3 or r.a // 2 == 1 or r.a // 4 == 0) for r in gone)


def test_sharding_equals_its_sql_with_a_very_long_text(spark, tmp_path):
    import duckdb

    rows = [(k, f"té {k} " * (k % 4)) for k in range(60)] + [(60, None), (61, "x" * 20_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = queries.QUERIES["op5_sharding"](spark, str(tmp_path))
    want = con.execute(queries.ORACLE_SQL["op5_sharding"])
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


def test_sharding(spark):
    rows = [(k, f"text {k}" * (k % 5)) for k in range(400)] + [(None, None), (7, "again"), (7, "again")]
    got = sharding.assign(docs(spark, rows), sharding.tree(8)).collect()
    assert len(got) == len(rows)
    for s in range(8):
        own = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own))) and len(own) > 20
    assert all(r.grown_shard in (r.shard, 8) for r in got) and any(r.grown_shard == 8 for r in got)
    assert len({r.shard for r in got if r.doc_id == 7}) == 1
    assert all(r.size == len((dict(rows).get(r.doc_id) or "").encode()) + 1 for r in got if r.doc_id not in (7, None))
    assert sharding.assign(docs(spark, []), sharding.tree(8)).count() == 0


def test_quality_rules(spark):
    texts = [None, "", "a b c a b c a b c", "x\nx\n \n x\nx", "#$ %& | <> *", "one two three " * 30, "w1 w2 w3 w4 w1 w2 w3 w9 w2 w3 w4", " \u00a0 lead\x0b\x0ctail "] + [" ".join(f"t{(k * j) % 71}" for k in range(80)) for j in range(1, 20)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[5]), (2, texts[2])]
    trusted = spark.createDataFrame([(k,) for k in range(8, 20)] + [(None,), (9,)], "doc_id long")
    got = quality_rules.quality(docs(spark, rows), trusted).collect()
    assert len(got) == len(rows)
    import re

    for r in got:
        t = (texts[5] if r.doc_id is None else texts[r.doc_id]) or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality_rules.quality(docs(spark, []), trusted).count() == 0
    assert quality_rules.keep_good(docs(spark, rows), trusted).columns == ["doc_id", "text", "score", "host"]


def test_llr_and_kept_equal_a_plain_model(spark):
    """Weights, scores and verdicts of every document from counts in Python; the hashes are Spark's."""
    rng = random.Random(8)
    words = [f"v{k}" for k in range(90)]
    texts = [" ".join(rng.choices(words[: 60 if k % 3 else 90], k=70)) for k in range(40)] + ["v1 v2", None, " ".join(["$"] + rng.choices(["x", "y", "z"], k=60))]
    texts += [texts[0]] * 6 + [texts[1].replace("v1 ", "q ", 1)] * 3
    rows, good = docs(spark, list(enumerate(texts))), [k for k in range(40) if k % 3] + [44, 45]
    trusted = spark.createDataFrame([(k,) for k in good], "doc_id long")
    marked = quality_rules.sampled(quality_rules.worded(rows.select("doc_id", "text")).select("doc_id", "text", quality_rules.left_out(F.col("text")).alias("out"), quality_rules.ngrams(F.col("__hashes")).alias("grams")))
    got = {r.doc_id: (r.out, [g % 64 for g in r.grams], r.least, r.most) for r in marked.collect()}

    def shares(ids):
        least, most = Counter(got[i][2] for i in ids), Counter(got[i][3] for i in ids)
        return {i: 1 / max(least[got[i][2]], most[got[i][3]]) for i in ids}

    def counts(ids):
        out = Counter({b: 1.0 for b in range(64)})
        for i, w in shares(ids).items():
            for g in got[i][1]:
                out[g] += w
        return out

    raw, own = counts(list(got)), counts([i for i in good if not got[i][0]])
    want = {b: np.log(own[b] / sum(own.values())) - np.log(raw[b] / sum(raw.values())) for b in range(64)}
    table = quality_rules.weights(rows, trusted, 64, True)
    found = dict(table.collect())
    assert all(found[b] == pytest.approx(want[b], abs=3e-5) for b in range(64))
    llr = {i: sum(found[g] for g in got[i][1]) / max(1, len(got[i][1])) for i in got}
    judged = quality_rules.judge(rows.select("doc_id", "text"), quality_rules.constant(table, 64), 0.0, 64).collect()
    for r in judged:
        assert r.llr == pytest.approx(llr[r.doc_id], abs=1e-9)
        assert r.kept == (not r.base_failed and r.llr >= 0.0)
    assert {r.kept for r in judged} == {True, False}


def test_texts_are_exchanged_once_and_alike_at_any_size(spark, monkeypatch):
    """A small input must not be broadcast where a large one is exchanged, and trusted texts are found once for both uses."""
    texts = [" ".join(f"t{(k * j) % 71}" for k in range(80)) for j in range(1, 20)]
    rows = docs(spark, list(enumerate(texts + texts[:4]))).select("doc_id", "text")
    trusted = spark.createDataFrame([(k,) for k in range(12)], "doc_id long")
    for df in (quality_rules._target(rows, quality_rules._ids(trusted)), quality_rules._surplus(rows)):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    calls, find = [], quality_rules._target
    monkeypatch.setattr(quality_rules, "_target", lambda *a: calls.append(1) or find(*a))
    assert quality_rules.quality(rows, trusted).count() == 23 and len(calls) == 1


def test_samples_are_shared_by_copies_and_by_near_copies(spark):
    base = [f"w{k}" for k in range(100)]
    near = [" ".join(base[:at] + ["changed"] + base[at + 1 :]) for at in range(100)]
    rows = quality_rules.sampled(docs(spark, list(enumerate([" ".join(base)] * 2 + near + ["a b", None]))).select("doc_id", "text")).collect()
    of = {r.doc_id: (r.least, r.most) for r in rows}
    assert of[0] == of[1] and None not in of[102] and None not in of[103]
    assert sum(of[k][0] == of[0][0] or of[k][1] == of[0][1] for k in range(2, 102)) >= 95


def test_repeated_windows_of_a_very_long_text(spark):
    words = [f"w{k % 40_000}" if k % 7 else "the" for k in range(60_000)]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    row = quality_rules.measures(docs(spark, [(1, " ".join(words))])).select("n_words", "n_repeat_words").first()
    assert (row.n_words, row.n_repeat_words) == (len(words), len(covered))


def test_quality_rules_keep_an_unlabelled_group_of_clean_copies(spark):
    rng = random.Random(4)
    text = lambda mark: " ".join(mark + w for w in rng.choices([f"w{k}" for k in range(300)], k=200))
    rows = [(k, text("")) for k in range(300)] + [(1000 + k, text("$")) for k in range(60)]
    rows += [(2000 + k, rows[299][1]) for k in range(180)]  # no label covers this text
    near = rows[298][1].split()
    rows += [(3000 + k, " ".join(near[: k % 200] + [f"w{k % 300}"] + near[k % 200 + 1 :])) for k in range(180)]  # nor these near copies
    trusted = spark.createDataFrame([(k,) for k in range(0, 298, 2)], "doc_id long")
    kept = {r.doc_id for r in quality_rules.quality(docs(spark, rows), trusted).where("kept").collect()}
    assert all(k in kept for k in range(2000, 2180)) and 299 in kept
    assert all(k in kept for k in range(3000, 3180)) and 298 in kept
    assert sum(k in kept for k in range(300)) >= 285 and not any(1000 <= k < 1060 for k in kept)


def unit_rows(n, d, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d))
    return np.concatenate([base, base[: n // 2] + rng.normal(size=(n // 2, d)) * 0.12])


def test_embeddings(spark):
    x = unit_rows(120, 16, 0)
    rows = [(k, [float(a) for a in v], k % 3) for k, v in enumerate(x)] + [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, [1.0, None] * 8, 1), (504, rows_like(x[0]), None), (505, rows_like(x[0]), 0), (506, [1.0], 0), (507, [2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("clash"))
    got = {r.vec_id: r for r in embedding_neardup.near_duplicates(df).collect()}
    usable = [(i, np.array(v, np.float32).astype(float), label) for i, v, label in rows if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {i: set() for i, *_ in rows}
    for i, v, a in usable:
        for j, w, b in usable:
            if i != j and a == b and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                links[i].add(j)
    total = sum(map(len, links.values()))
    assert total > 20 and sum(r.n_links for r in got.values()) >= 0.9 * total
    assert all(got[i].n_links <= len(links[i]) for i in links)
    for i in (500, 501, 502, 503, 504):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[505].component_id == 0 and not got[505].kept
    assert embedding_neardup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("share", [1 / 3, 1.0])
def test_embeddings_of_a_dense_group_are_linked(spark, share):
    rng = np.random.default_rng(7)
    n, d = 900, 64
    x = rng.normal(size=(n, d))
    dense = int(n * share)
    x[:dense] = rng.normal(size=d) + rng.normal(size=(dense, d)) * 0.13
    x = x.astype(np.float32).astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = ((unit @ unit.T >= 0.98) & ~np.eye(n, dtype=bool)).sum(axis=1)
    df = spark.createDataFrame([(k, rows_like(v), 0) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in embedding_neardup.near_duplicates(df).collect()}
    assert links.sum() > 0.1 * dense * dense and all(got[k] <= links[k] for k in range(n))
    assert sum(got.values()) >= 0.9 * links.sum()


def test_embeddings_against_brute_force_at_sizes(spark):
    rng = np.random.default_rng(11)
    for n in (300, 2500):
        x = rng.normal(size=(n, 32))
        x[1::4] = x[::4][: len(x[1::4])] + rng.normal(size=(len(x[1::4]), 32)) * 0.15
        x[: n // 10] = x[0] + rng.normal(size=(n // 10, 32)) * 0.12
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        near = (u @ u.T >= 0.98) & ~np.eye(n, dtype=bool)
        root = list(range(n))
        for a in range(n):  # least reachable number, breadth first
            if root[a] == a:
                open_ = [a]
                while open_:
                    for b in np.flatnonzero(near[open_.pop()]).tolist():
                        if root[b] > a:
                            root[b] = a
                            open_.append(b)
        df = spark.createDataFrame([(k, rows_like(v), 0) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
        got = {r.vec_id: r for r in embedding_neardup.near_duplicates(df).collect()}
        recall = sum(r.n_links for r in got.values()) / near.sum()
        assert recall >= 0.99 and all(got[k].n_links <= near[k].sum() for k in range(n))
        assert sum(got[k].component_id != root[k] for k in range(n)) <= 0.01 * n


def test_embeddings_ties_repeats_and_huge_numbers(spark):
    rows = [(1, [1e300, 1e300], 0), (1, [1e300, 1e300], 0), (2, [5e-324, 0.0], 0), (3, [1.0, 0.0], 0), (4, [1.0, 1.0], 0), (4, [-1.0, 0.0], 0), (5, [float("inf"), 0.0], 0), (6, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_neardup.near_duplicates(df, 1.0 - 1e-12).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 1, 2), (3, 1, 2), (4, 0, 4), (4, 2, 1), (5, 0, 5), (6, 0, 6)]
    found = embedding_neardup.verified(~np.eye(3, dtype=bool), np.array([[1.0, 0.0], [0.5, 0.75**0.5], [1.0, 0.0]]), 0.5)
    assert found[0, 1] and found[0, 2]  # a cosine of exactly the threshold


def test_cells_of_the_index_take_a_pair_once():
    rng = np.random.default_rng(2)
    order = np.array([rng.choice(12, 7, replace=False) for _ in range(40)])
    lists = embedding_neardup.list_keys(order)
    met = np.zeros((40, 40), int)
    for key in np.unique(lists):
        own = np.flatnonzero((lists == key).any(axis=1))
        met[np.ix_(own, own)] += embedding_neardup.candidates(order[own], int(key), np.zeros(len(own)), False)
    shared = np.array([[len(set(a) & set(b)) for b in order.tolist()] for a in order.tolist()])
    assert ((met == 1) == ((shared >= 3) & ~np.eye(40, dtype=bool))).all() and met.max() == 1


def test_small_and_large_cells_of_the_index_agree_with_their_matrices():
    """Cells of 1 to 90 rows in one call, whole and crossed, against `candidates` and `verified` cell by cell."""
    rng = np.random.default_rng(5)
    rows, edges, want = [], [0], []
    for c, n in enumerate([1, 2, 2, 3, 7, 64, 65, 90, 1, 5]):
        key = int(embedding_neardup.list_keys(np.array([[1, 4, 6]])).item())
        order = np.array([rng.permutation([1, 4, 6, *rng.choice([0, 2, 3, 5, 7, 8, 9, 10], 4, replace=False)]) for _ in range(n)])
        unit = embedding_neardup.unit(np.repeat(rng.normal(size=(2, 8)), [n // 2, n - n // 2], axis=0) + rng.normal(size=(n, 8)) * 0.1)
        block, node, copies = rng.integers(0, 2, n), np.arange(n) + edges[-1], rng.integers(1, 4, n)
        found = embedding_neardup.candidates(order, key, block, bool(c % 2))
        near = embedding_neardup.verified(found, unit, 0.98)
        want.append((node, found.any(axis=1), near, near @ copies))
        rows += [(0, 8, key, 0, c % 2, *r) for r in zip(block, node, list(order), copies, list(unit))]
        edges.append(edges[-1] + n)
    pdf = pd.DataFrame(rows, columns=["label", "size", "list", "cell_i", "cell_j", "block", "node", "order", "copies", "unit"])
    got = embedding_neardup.retrieved(pdf, np.array(edges))
    assert got["node"].tolist() == [int(v) for node, some, _, _ in want for v in node[some]]
    out = embedding_neardup.found_links(pdf, np.array(edges), 0.98)
    assert dict(out[out.v < 0][["u", "n"]].to_numpy().tolist()) == {int(a): int(k) for node, _, _, n in want for a, k in zip(node, n) if k}
    spans = out[out.v >= 0][["u", "v"]].to_numpy().tolist()
    whole = {(int(node[a]), int(node[b])) for node, _, near, _ in want for a, b in zip(*np.nonzero(near))}
    assert {tuple(x) for x in spans} <= whole and len(spans) < len(whole) / 4
    root = {int(v): int(v) for v in pdf["node"]}
    for u, v in spans:
        u, v = root[u], root[v]
        root = {k: u if r == v else r for k, r in root.items()}
    assert all(root[u] == root[v] for u, v in whole)  # the spanning links join all that is linked


def rows_like(v):
    return [float(a) for a in v]


def test_packing(spark):
    got = packing.pack(docs(spark, ODD), WORD_BPE).collect()
    ids = {i: library(t) + [0] for i, t in ODD if i is not None}
    for r in got:
        if r.doc_id is not None:
            own = ids[r.doc_id][r.start : r.start + r.length]
            assert r.start == 2048 * r.piece and len(own) == r.length and zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32
    assert sum(r.length for r in got) == sum(len(library(t)) + 1 for _, t in ODD)
    assert [r.length for r in got if r.doc_id == 10] == [2048] and sorted(r.length for r in got if r.doc_id == 11) == [1, 2048]
    room: list[int] = []
    for n in sorted((r.length for r in got), reverse=True):  # the whole table, one piece after the other
        fit = min((r for r in room if r >= n), default=None)
        if fit is None:
            room.append(2048 - n)
        else:
            room[room.index(fit)] -= n
    assert len({r.sequence_id for r in got}) == len(room)
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack(docs(spark, []), WORD_BPE).count() == 0


def test_best_fit_matches_a_plain_search():
    for seed in range(20):
        rng = np.random.default_rng(seed)
        size = int(rng.integers(5, 120))
        lengths = rng.integers(1, size + 1, int(rng.integers(1, 600)))
        seen, ranks = Counter(), []
        for n in lengths.tolist():
            ranks.append(seen[n])
            seen[n] += 1
        bins, offsets = packing.placed_by(packing.best_fit_runs(dict(seen), size), lengths, np.array(ranks))
        room: list[int] = []
        for n in sorted(lengths.tolist(), reverse=True):
            fit = min((r for r in room if r >= n), default=None)
            if fit is None:
                room.append(size - n)
            else:
                room[room.index(fit)] -= n
        assert bins.max() + 1 == len(room)
        assert sorted(size - np.bincount(bins, lengths).astype(int)) == sorted(room)
        for b in range(len(room)):
            at = 0
            for offset, n in sorted(zip(offsets[bins == b].tolist(), lengths[bins == b].tolist())):
                assert offset == at
                at += n


def test_best_fit_of_billions_of_pieces_needs_only_their_counts():
    counts = {n: 10_000_000 + n for n in range(1, 2049)}
    runs = packing.best_fit_runs(counts, 2048)
    assert len(runs) < 10_000
    assert runs[runs[:, 0] == 2048][0].tolist() == [2048, 0, 0, 1, 0]


def test_minhash_matches_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for g in range(25):
        base = rng.choices(vocabulary, k=rng.choice([3, 5, 40, 90]))
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, None), (901, ""), (902, rows[0][1].upper()), (903, LONG), (904, LONG), (905, LONG + " end"), (None, rows[0][1])]
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                parent[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(least.get(top(k), 1 << 60), i)
    got = minhash_neardup.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for k, (i, _) in enumerate(rows):
        assert by[i].component_id == least[top(k)] and by[i].n_shingles == len(sets[k])
        assert by[i].kept == (i == least[top(k)])
    more = [(0, rows[0][1]), (900, "a text of its own under an id that comes again"), (None, "no id and no copy"), (None, "no id and no copy")]
    one = minhash_neardup.keep_one(docs(spark, rows + more))
    assert one.columns == ["doc_id", "text", "score", "host"]
    assert sorted((r.doc_id, r.text or "") for r in one.where("doc_id is not null").collect()) == sorted([(i, dict(rows)[i] or "") for i in set(least.values())] + [more[1]])
    assert [r.text for r in one.where("doc_id is null").collect()] == ["no id and no copy"]
    assert minhash_neardup.near_duplicates(docs(spark, [])).count() == 0


def test_odd_sketch_estimates_similarity():
    rng = np.random.default_rng(0)
    x = np.unique(rng.integers(0, 1 << 62, 1000, dtype=np.uint64))
    bits = []
    for share in (1.0, 0.9, 0.75, 0.3):
        y = np.unique(np.concatenate([x[: int(len(x) * 2 * share / (1 + share))], rng.integers(0, 1 << 62, len(x) - int(len(x) * 2 * share / (1 + share)), dtype=np.uint64)]))
        a, b = minhash_neardup.odd_sketches(np.stack([minhash_neardup.samples(x), minhash_neardup.samples(y)])).view(np.uint64)
        bits.append(int(np.bitwise_count(a ^ b).sum()))
    assert bits[0] == 0 and bits[0] < bits[1] < bits[2] <= minhash_neardup.most_different_bits(0.75) < bits[3]


def test_token_files(spark, tmp_path):
    path = str(tmp_path / "shards")
    got = sorted(token_files.token_files(docs(spark, ODD), WORD_BPE, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in ODD), key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    texts = {i: t for i, t in ODD}
    for r in got:
        own = library(texts[r.doc_id]) + [1]
        assert (r.n_tokens, r.ids_crc32) == (len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
    found = token_files.lookup(spark, path, [4, 7, 99]).collect()
    assert sorted(r.doc_id for r in found) == [4, 4, 7]
    assert [r.ids for r in found if r.doc_id == 7] == [library(texts[7]) + [1]]
    many = docs(spark, [(k // 2, f"text {k // 2}") for k in range(600)] + ODD)
    token_files.write_shards(many, f"{path}2", WORD_BPE, shard_bytes=50_000)
    shards = token_files.shards_at(spark, f"{path}2")
    assert len(shards) > 5 and all(a().last <= b().first for a, b in zip(shards, shards[1:]))
    read = []
    for s in shards:
        s().read = lambda at, n, f=s().read, size=s().documents: read.append(n) or f(at, n)
    assert [len(s().find(token_files.key_of(250))) for s in shards if s().first <= token_files.key_of(250) <= s().last] == [2]
    assert len(read) == 3  # filter, index, one block
    asked = [None, -3, 0, 150, 299, 300, 10**12]
    found = Counter(r.doc_id for r in token_files.lookup(spark, f"{path}2", asked).collect())
    assert found == {None: 1, 0: 2, 150: 2, 299: 2}
    assert token_files.token_files(docs(spark, []), WORD_BPE).count() == 0


def test_block_round_trip():
    entries = [(token_files.key_of(i), np.array([i % 70000] * (i % 4), "<u4").tobytes()) for i in [-5, 0, 3, 3, 1 << 40]]
    back = list(token_files.unpack_block(token_files.pack_block(entries)))
    assert [(k, v.astype("<u4").tobytes()) for k, v in back] == entries
    keys = [token_files.key_of(i) for i in (None, -(1 << 63), -1, 0, 1, (1 << 63) - 1)]
    assert keys == sorted(keys) and [token_files.id_of(k) for k in keys] == [None, -(1 << 63), -1, 0, 1, (1 << 63) - 1]
