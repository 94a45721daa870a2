from __future__ import annotations

import base64
import hashlib
import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from nearfield.llm import bpe, chat, line_runs, mixing, pivots, quality_cnn, quality_rules, registry, similar, simhash, toxicity, warc
from nearfield.sources import scratch
from nearfield.sources.scratch import written

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, th long, `key` string, label string, n long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and further columns with names that operators use."""
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, "word " * 200_000), (5, "one line\n" * 60), (6, "one line\n" * 60), (6, "one line\n" * 60), (None, "nobody's text"), (None, None), (7, "é ü " * 30)]
    rows = [(i, t, None if i in (1, 5) else "en", None if i in (2, 6) else "web", None, 9, 9, "k", "l", None) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(against_sql, name):
    assert against_sql(name) > 0


# --- SimHash ----------------------------------------------------------------------------------------------------------


def test_simhash_against_all_pairs(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    prints = {r.doc_id: brute.fingerprint(r.text) for r in docs.collect()}
    want = brute.components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in registry.QUERIES["op4_simhash_pigeonring"](spark, MIDDLE).collect()}
    assert got == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}


def test_links_find_every_near_pair(spark):
    rng = np.random.default_rng(3)
    prints = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    for p in list(prints):
        for bits in (1, 2, 3, 4):
            prints.append(p ^ sum(1 << int(b) for b in rng.choice(64, bits, replace=False)))
    signed = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    mask = (1 << 64) - 1
    want = {(a, b) for n, a in enumerate(signed) for b in signed[n + 1 :] if ((a ^ b) & mask).bit_count() <= 3}
    got = [tuple(r) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.label for r in simhash.components(edges).collect()} == {0}


def test_simhash_odd_tables(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert {r.component_id for r in got if r.fingerprint == "0" * 16} == {1}
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns and [r.doc_id for r in kept.orderBy("doc_id").collect()].count(6) == 0
    assert simhash.near_duplicates(none).count() == simhash.keep_first(none).count() == 0


def _similar_by_all_pairs(texts: dict[int, str]) -> set[int]:
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    ids, up = sorted(sets), {i: i for i in sets}

    def top(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) - 1e-6 and len(x & y) / len(x | y) >= 0.8:
                low, high = sorted((top(a), top(b)))
                up[high] = low
    return {top(i) for i in ids}


def test_keep_first_leaves_one_row_of_each_component(spark):
    rows = [(1, "a b c d"), (5, "a b c d"), (5, "quite another text"), (9, "quite another text"), (None, "a b c d"), (None, "nobody's"), (None, "nobody's")]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, kept.collect())) == Counter([(1, "a b c d"), (5, "quite another text"), (None, "nobody's")])


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_links_broadcast_no_side_however_small_its_files(spark):
    prints = written(spark.range(1000).select(F.xxhash64("id").alias("fp")), "prints")
    assert "Broadcast" not in _plan(simhash.links(prints))


def test_near_duplicates_broadcast_no_side(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = simhash.near_duplicates(docs)
    assert "Broadcast" not in _plan(got) and got.count() == docs.count()


def test_keep_first_broadcasts_by_measured_bytes_only(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    few = simhash.keep_first(docs)
    monkeypatch.setattr(scratch, "SIDE_BYTES", -1)
    many = simhash.keep_first(docs)
    assert "Broadcast" in _plan(few) and "Broadcast" not in _plan(many)
    assert sorted(few.collect()) == sorted(many.collect()) and few.count() < docs.count()


def test_similar_stage_finds_every_similar_pair(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    rng = np.random.default_rng(7)
    edited = []
    for i, r in enumerate(docs.where("n_chars > 1500").orderBy("doc_id").limit(20).collect()):
        words = r.text.split(" ")
        for k in range(3):  # chains of copies, each with a few words more changed
            for at in rng.integers(0, len(words), max(1, len(words) // 60)):
                words[at] = f"changed{k}"
            edited.append((10**6 + 10 * i + k, " ".join(words), r.lang, r.source, None))
    table = docs.select(*corpus_pipeline.COLUMNS).union(spark.createDataFrame(edited, docs.select(*corpus_pipeline.COLUMNS).schema))
    got = [r.doc_id for r in corpus_pipeline.one_of_each_similar(spark, table, MIDDLE).collect()]
    want = _similar_by_all_pairs({r.doc_id: r.text for r in table.collect()})
    assert len(got) == len(set(got)) and set(got) == want


def test_similar_odd_tables(odd, none):
    kept = similar.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 1), (False, 4), (False, 5), (False, 7), (True, None)]
    assert similar.keep_first(none).count() == 0


# --- classifiers ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("name", "label", "least"), [("op5_quality_cnn", "quality", 0.9), ("op8_toxicity_gbt", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet").select("doc_id", label)
    rows = registry.QUERIES[name](spark, MIDDLE).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 20
    assert np.mean([r.predicted == r[label] for r in rows]) >= least
    both = [[r for r in rows if r[label] == y] for y in (0, 1)]  # always saying the commoner label would be near 0.9
    assert all(np.mean([r.predicted == r[label] for r in own]) >= 0.75 for own in both)
    assert np.mean([(b.score > a.score) + (b.score == a.score) / 2 for a in both[0] for b in both[1]]) >= 0.95


def test_network_score_covers_the_whole_text():
    rng = np.random.default_rng(5)
    net = quality_cnn.Net(rng.standard_normal((6, 256, 4)).astype(np.float32), rng.standard_normal(4).astype(np.float32), rng.standard_normal(12).astype(np.float32), 0.1)
    for text in ("", "a", "abcdefg" * 20, "some words, then more " * 100, "ü" * 1000):
        assert net.score(text) == pytest.approx(brute.cnn_score(net, text, quality_cnn.CHUNK), abs=1e-4)
    assert net.score(None) == net.score("")


def test_toxicity_like_the_plain_version(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{MIDDLE}/labels.parquet"))
    assert model.boosted is not None and len(model.lexicon.words) > 0
    rows = docs.where("n_chars < 20000").orderBy("doc_id").limit(300).collect()
    texts = {r.doc_id: r.text or "" for r in rows} | {-1: "", -2: "YOU f00l! y.o.u idi0t @you", -3: " ".join(model.lexicon.words) + " you"}
    names = "doc_id long, text string"
    got = {r.doc_id: r.score for r in toxicity.scores(spark.createDataFrame(list(texts.items()), names), model).collect()}
    codes = toxicity.Codes(model.lexicon)
    for i, t in texts.items():
        x = brute.toxicity_features(t, model.lexicon.words, model.lexicon.stems, toxicity.SECOND, toxicity._SIGNS, toxicity._PLAIN)
        assert toxicity.features(t, codes).tolist() == pytest.approx(x, rel=1e-9, abs=1e-9)
        assert got[i] == pytest.approx(brute.boosted_score(x, model.boosted, model.knots), abs=1e-9)


def test_isotonic_like_the_plain_version():
    rng = np.random.default_rng(8)
    for _ in range(20):
        y = (rng.random(40) < np.linspace(0.1, 0.8, 40)).astype(float)
        want = brute.isotonic(y.tolist())
        blocks = [[i for i in range(40) if abs(want[i] - v) < 1e-12] for v in sorted(set(np.round(want, 12)))]
        x, p = toxicity.isotonic(np.arange(40.0), y)
        assert x.tolist() == pytest.approx([np.mean(b) for b in blocks])
        assert p.tolist() == pytest.approx(np.maximum.accumulate([(y[b].sum() + y.mean()) / (len(b) + 1) for b in blocks]).tolist())


def test_isotonic_rises():
    x, p = toxicity.isotonic(np.array([0.0, 1, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1, 1]))
    assert (np.diff(x) > 0).all() and (np.diff(p) >= 0).all()


def test_classifiers_odd_tables(odd, none):
    labels = odd.select("doc_id", F.lit(1).alias("quality"), F.lit(None).cast("int").alias("toxic"))
    for docs in (odd, none):
        net, model = quality_cnn.train(docs, labels), toxicity.train(docs, labels)
        for got in (quality_cnn.scores(docs, net), toxicity.scores(docs, model)):
            rows = got.collect()
            assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
        assert quality_cnn.accepted(docs, net).columns == docs.columns


# --- quality rules ----------------------------------------------------------------------------------------------------


def test_outliers_go_and_others_stay(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefghij"), int(rng.integers(3, 8))))
    rows = [(i, " ".join(word() for _ in range(int(rng.integers(80, 200)))), "en", "web") for i in range(300)]
    rows += [(1000 + i, " ".join(word() + "#$%|" * 6 for _ in range(100)), "en", "web") for i in range(30)]
    got = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert {r.doc_id for r in got if not r.kept} == set(range(1000, 1030))


_MCD = {"factor": quality_rules.FACTOR, "floors": quality_rules.FLOORS, "prior": quality_rules.PRIOR, "prior_rows": quality_rules.PRIOR_ROWS, "share": quality_rules.SHARE, "per_e": 64}


def test_outliers_like_the_plain_version(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    groups, want = {}, {}
    for r in docs.collect():
        n, chars, symbols, lines, repeated = own = brute.quality_statistics(r.text)
        failed = n < 50 or 100 * repeated > 50 * n
        want[r.doc_id] = (*own, failed)
        if not failed:
            x = (chars / n, 1 + 100 * symbols / n, 1 + 1000 * lines / n, 1 + 100 * repeated / n, n)
            groups.setdefault((r.lang, r.source), []).append((r.doc_id, np.floor(1000 * np.log(x) + 0.5)))
    distances = {}
    for rows in groups.values():
        found = brute.robust(np.array([x for _, x in rows]), **_MCD)[1]
        distances |= dict(zip([i for i, _ in rows], found, strict=True))
    got = quality_rules.quality_rules(docs).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want[r.doc_id]
        assert r.kept == (not r.base_failed and distances[r.doc_id] <= quality_rules.CUT)
        if not r.base_failed:
            assert r.distance2 == pytest.approx(min(distances[r.doc_id], 1e6), rel=1e-6, abs=2e-3)
    assert len(got) == len(want)


def test_no_random_start_finds_a_much_smaller_determinant(spark):
    rng = np.random.default_rng(11)
    x = np.floor(rng.standard_normal((400, 5)) @ rng.standard_normal((5, 5)) * 300 + 4000)
    x[:90] = np.floor(rng.standard_normal((90, 5)) * 80 + 9000)  # less than a quarter, close together, far off
    fit = spark.createDataFrame([("k", *map(int, row)) for row in x], "key string, " + ", ".join(f"x{i} long" for i in range(5)))
    det = quality_rules.estimates(fit).first().det
    anywhere = brute.robust(x, **_MCD, starts=[rng.choice(400, 12, replace=False) for _ in range(200)])[0]
    assert det <= anywhere * 1.02
    assert det < brute.robust(x, **_MCD, starts=[np.arange(400)])[0] * 1.02


def test_small_groups_have_estimates_of_their_own(spark):
    words = lambda k, seed: " ".join("abcdefghij"[(i * i + seed) % 10] * (1 + (i * 7 + seed + k) % 6) + str(i) for i in range(80 + 5 * k))
    rows = [(k, words(k % 9, k), "en", f"s{k // 9}") for k in range(27)] + [(99, words(3, 3), None, None), (98, words(4, 4), "", "")]
    got = {r.doc_id: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(r.kept for r in got.values()) and got[99].distance2 == got[98].distance2 == 0
    alone = quality_rules.quality_rules(spark.createDataFrame(rows[:9], "doc_id long, text string, lang string, source string")).collect()
    assert all(r.distance2 == got[r.doc_id].distance2 for r in alone)  # whatever other groups there are


def test_quality_odd_tables(odd, none):
    rows = quality_rules.quality_rules(odd).collect()
    assert len(rows) == odd.count() and all(r.kept is not None for r in rows)
    assert all(r.n_words == 0 and r.base_failed for r in rows if r.doc_id in (1, 2, 3))
    assert quality_rules.quality_rules(none).count() == 0


# --- mixing, lines, BPE -----------------------------------------------------------------------------------------------


def test_mixing_odd_tables(odd, none):
    got = mixing.mix(odd, {"web": 1.0, None: 3.0})
    assert got.columns == [*odd.columns, "copy", "shuffle_key"]
    assert mixing.mix(none).count() == 0
    assert mixing.mix(odd, {"elsewhere": 1.0}).count() == 0


@pytest.mark.parametrize("rate", [0.01, 1.0, 7.5, 150.0, 230.0, 4000.0, 1e6])
def test_poisson_inversion(rate):
    inverse = mixing._Inverse()
    u = np.array([0.0, 1e-9, 0.02, 0.3, 0.5, 0.77, 0.999, 1 - 1e-9])
    got = inverse.counts(u, np.full(len(u), rate))
    assert inverse.counts(u, np.zeros(len(u))).sum() == 0 and (np.diff(got) >= 0).all() and got.max() <= mixing._most(rate)
    low, found = inverse.table(rate)
    for x, k in zip(u[1:].tolist(), got[1:].tolist(), strict=True):
        assert found[k - low] == pytest.approx(brute.poisson_upto(rate, k), abs=2e-8)
        assert brute.poisson_upto(rate, k) > x - 2e-8 and (k == 0 or brute.poisson_upto(rate, k - 1) <= x + 2e-8)


def test_many_copies_are_dealt_to_tasks(spark):
    docs = spark.createDataFrame([(1, "x", "tiny"), (2, "y" * 50, "large"), (3, "z" * 50, "large")], "doc_id long, text string, source string")
    got = mixing.mix(docs, {"tiny": 1.0, "large": 1e-4}, total=200_000).cache()
    n = {r.doc_id: (r["n"], r.last, r.different) for r in got.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy").alias("last"), F.countDistinct("shuffle_key").alias("different")).collect()}
    got.unpersist()
    assert abs(n[1][0] - 200_000) < 12 * 200_000**0.5 and all(a == b == c for a, b, c in n.values())


def test_lines_odd_tables(odd, none):
    got = {r.doc_id: r for r in line_runs.remove_repeats(odd).collect() if r.doc_id is not None}
    assert line_runs.remove_repeats(odd).columns == [*odd.columns, "n_lines", "n_removed"]
    assert (got[1].text, got[1].n_removed, got[2].n_lines) == (None, 0, 1)
    assert got[6].n_removed >= 60 and got[6].id == 9 and 0 < got[5].n_removed < 60
    assert line_runs.remove_repeats(none).count() == 0


def test_hot_keys_are_joined_like_others(spark):
    rows = spark.range(30_000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 0 ELSE id % 7000 END AS key")
    groups = written(rows.groupBy("key").count().selectExpr("key", "count AS n", "key * 2 AS twice"), "groups").where("key <> 5")
    hot = groups.where("n > 15").count()
    got = {(r.id, r.key, r.twice) for r in line_runs._joined(rows, groups, ["key"]).collect()}
    want = {(i, k, 2 * k) for i in range(30_000) if (k := 0 if i % 3 == 0 else i % 7000) != 5}
    assert got == want and 0 < hot < groups.count()


def test_bpe_like_tiktoken(spark, odd, none):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).open("rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.encoder(path, P.PATTERN)
    texts = [r.text for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()]
    texts += ["", " ", "  a  b ", "\x1c x\x85y　z", "á 'S's", "x" * 5000, "日本語の文章、です。", "\U0001f600" * 40, "1234567 89", "<|endoftext|>"]
    for t in texts:
        ids = np.frombuffer(own.encode(t or ""), "<u4").tolist()
        assert ids == lib.encode_ordinary(t or "") and own.decode(np.array(ids, "<u4").tobytes()) == (t or "").encode()
    assert own.by_words
    other = r"[ab]+|[^ab ]+ ?| +"  # in which a lone space ends a match
    apart, theirs = bpe.Encoder(ranks, other), tiktoken.Encoding("other", pat_str=other, mergeable_ranks=ranks, special_tokens={})
    for t in ("a word about spaces, and  more", " b", "x ", "", "Abba 12 ab"):
        assert np.frombuffer(apart.encode(t), "<u4").tolist() == theirs.encode_ordinary(t)
    encoded = bpe.encode(odd, lambda: path, P.PATTERN)
    back = bpe.decode(encoded.drop("text"), path, P.PATTERN)
    assert Counter(r.text for r in back.collect()) == Counter(r.text or "" for r in odd.collect())
    assert bpe.encode(none, path, P.PATTERN).count() == 0


def test_pipeline_against_brute_force(spark):
    import public_tokenizers as P

    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    net = quality_cnn.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    rows = {r.doc_id: r for r in docs.collect() if net.score(r.text) >= 0.5}
    left = {i: t for i, (t, n, gone) in brute.without_repeats({i: r.text or "" for i, r in rows.items()}).items() if gone < n}
    comp = brute.components({i: brute.fingerprint(t) for i, t in left.items()})
    first = {i: (left[i], rows[i].source) for i, c in comp.items() if c == i}
    own = bpe.encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    want = Counter({(i, hashlib.sha256(own.encode(first[i][0])).hexdigest()): n for i, n in brute.copies(first, mixing.SEED).items() if n})
    got = Counter((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, SMALL).collect())
    assert got == want and len(got) > 20


# --- chat, archives, top-k --------------------------------------------------------------------------------------------


def test_chat_spans_and_rewritten_history():
    turns = [("user", "a b"), ("assistant", "c"), ("user", "### d</turn>\\"), ("assistant", "")]
    out, where, rewritten = chat.spans(turns, chat.marked)
    assert rewritten is None and "".join(out[a:b] for a, b in where) == out and chat.parse(out) == turns
    a, b = chat.text_span(turns[:2], chat.marked, where[1])
    assert out[a:b] == "c"
    closing = lambda ts: chat.marked(ts) + "<end>"
    assert chat.spans(turns, closing)[2] is None
    latest_only = lambda ts: "".join(f"{r}:{t if k + 1 == len(ts) else ''};" for k, (r, t) in enumerate(ts))
    assert chat.spans(turns, latest_only)[2] == 1


def test_chat_spans_like_the_plain_version():
    rng = random.Random(1)
    templates = [
        chat.marked, lambda ts: chat.marked(ts) + "<end>", lambda ts: "".join(f"{r}:{t if k + 1 == len(ts) else ''};" for k, (r, t) in enumerate(ts)),
        lambda ts: f"{len(ts)}" + chat.marked(ts), lambda ts: "".join(t for _, t in ts),
    ]
    for _ in range(1000):
        turns = [(rng.choice(["user", "assistant", "x"]), "".join(rng.choice("ab<end>\\#") for _ in range(rng.randint(0, 8)))) for _ in range(rng.randint(0, 6))]
        for template in templates:
            assert chat.spans(turns, template) == brute.spans(turns, template)


def test_chat_odd_tables(spark):
    kind = "conv_id long, turn long, role string, text string, spans string"
    rows = [(1, None, None, None, "x"), (1, 0, "user", "hi", "x"), (1, 0, "user", "hi", "x"), (None, 0, "tool: a", "", None)]
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(spark.createDataFrame(rows, kind))).collect()}
    assert (got[1].n_turns, got[None].n_turns, got[1].loss_chars) == (3, 1, 0)
    assert chat.format_chats(spark.createDataFrame([], kind)).count() == 0


def test_warc_lookup_and_odd_tables(spark):
    kind = "page_id long, url string, html string, sha string, first long"
    rows = [(3, "https://www.example.org/a?b#c", "same", "x", 1), (1, "http://example.org:81/", "same", "x", 1), (2, "http://www.example.org/a?b", None, "x", 1), (None, None, "same", None, None), (5, "no url", "ö" * 300_000, None, None)]
    index = warc.write_archives(spark.createDataFrame(rows, kind))
    got = {r.page_id: r for r in warc.read_archives(index, payloads=True).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("response", None), 3: ("revisit", 1), None: ("revisit", 1), 2: ("response", None), 5: ("response", None)}
    assert bytes(got[5].payload).decode() == "ö" * 300_000 and got[2].payload_bytes == 0
    assert [r["page_id"] for r in index.fetch("http://www.example.org:80/a?b")] == [2, 3]
    assert index.captures("http://nowhere.org/") == []
    found = {r.page_id: r for r in warc.look_up(index, spark.createDataFrame([*rows[:3], rows[0], rows[3], (9, "http://example.org/", "", "", 0), (3, "http://elsewhere.org/", "", "", 0)], kind), payloads=True).collect()}
    assert found == {i: got[i] for i in (3, 1, 2, None)}
    empty = warc.write_archives(spark.createDataFrame([], kind))
    assert warc.read_archives(empty).count() == 0 and empty.captures("http://example.org/") == []


def test_warc_look_up_bisects_many_small_blocks(spark, monkeypatch):
    rows = [(i, f"http://{'hot' if i % 3 else f'h{i % 40}'}.org/", f"page {i % 50}") for i in range(600)] + [(7, "http://hot.org/", "page 7"), (7, "http://hot.org/", "another")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    opened = warc.write_archives(pages, block_lines=7)
    assert opened.directory.count() > 60
    got = Counter(tuple(r) for r in warc.look_up(opened, pages).collect())
    assert got == Counter(tuple(r) for r in warc.read_archives(opened).collect()) and sum(got.values()) == len(rows)
    search = warc._Search(opened.root, opened.at)
    read = []
    monkeypatch.setattr(warc, "read_block", lambda *a, own=warc.read_block: read.append(a) or own(*a))
    assert [e["page_id"] for e in search.entries([("org,hot)/", 7)])] == [7, 7, 7]
    assert len(read) <= 2  # of all the blocks of that URL
    assert [c["page_id"] for c in opened.captures("http://hot.org/")] == sorted([i for i in range(600) if i % 3] + [7, 7])
    ids = [r["headers"]["WARC-Record-ID"] for r in opened.fetch("http://hot.org/")]
    assert len(ids) == len(set(ids))


def test_top_k_exact_and_mostly_eliminated():
    rng = np.random.default_rng(2)
    centres = rng.integers(-64, 64, (40, 8))
    x = (centres[rng.integers(0, 40, 4000)] + rng.integers(-3, 4, (4000, 8))).astype(np.float64)
    ids = np.arange(4000)
    p = x[:16]
    far = np.sqrt(((x[:, None] - p[None]) ** 2).sum(axis=2))
    best, counts = pivots._Best(ids[:50], 5), [0, 0]
    pivots.evaluate(best, x[:50], far[:50], x, far, ids, counts)
    for i in range(50):
        scores = x @ x[i]
        assert best.found[i] == sorted(((s, -j) for j, s in enumerate(scores.tolist()) if j != i), reverse=True)[:5]
    assert counts[1] < counts[0]


def test_top_k_odd_tables(spark):
    kind = "vec_id long, embedding array<float>, id long, v string"
    rows = [(0, [1.0, 0.5], 9, "x"), (20, [1.0, 0.5], 9, "x"), (20, [1.0, 0.5], 9, "x"), (3, None, 9, "x"), (40, [None, 1.0], 9, "x"), (5, [float("nan"), 1.0], 9, "x"), (6, [float("inf"), 1.0], 9, "x"), (None, [1.0, 1.0], 9, "x"), (7, [1e9, -1e9], 9, "x"), (8, [1.0], 9, "x")]
    table = pivots.vectors(spark.createDataFrame(rows, kind))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in pivots.top_k(table, table.where("id % 20 = 0")).collect())
    big = 64 * 64 * 10**9 - 32 * 64 * 10**9
    two = 64 * 64 + 32 * 32  # repeated rows count as often as they occur, as in the SQL
    assert got == [(0, 1, 7, big), (0, 2, 20, two), (0, 3, 20, two), (20, 1, 7, big), (20, 2, 7, big), (20, 3, 0, two), (20, 4, 0, two)]
    none = pivots.vectors(spark.createDataFrame([], kind))
    assert pivots.top_k(none, none).count() == 0


def test_top_k_of_repeated_rows_like_the_sql(spark, tmp_path):
    import duckdb

    rows = [(i % 30, [float(i % 7), 1.5 * (i % 5), -0.3]) for i in range(200)] + [(0, [1.0, 1.0, 1.0])] * 30
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in pivots.op10_pivot_topk(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(con.sql(pivots.OP10_SQL).fetchall()) and len(got) == 40


def test_top_k_of_large_components():
    rng = np.random.default_rng(4)
    x = np.floor(rng.standard_normal((300, 5)) * 2.0 ** rng.integers(0, 70, (300, 1)))
    x[10:40] = x[10]  # ties
    ids = np.arange(300) % 290
    best = pivots._Best(ids[:60], 7)
    for part in (slice(0, 130), slice(130, 300)):
        pivots.evaluate_large(best, x[:60], x[part], ids[part])
    exact = [[int(v) for v in row] for row in x.tolist()]
    for i in range(60):
        scores = [(max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(exact[i], own, strict=True)))), -int(j)) for own, j in zip(exact, ids, strict=True) if j != ids[i]]
        assert best.found[i] == sorted(scores, reverse=True)[:7]


def test_top_k_beyond_64_bits(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, 0.0]), (2, [1e17, 0.0]), (3, [-1e30, 0.0]), (4, [0.5, 0.25]), (5, [0.0, 3.0])]
    table = pivots.vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted((r["rank"], r.vec_id, r.score) for r in pivots.top_k(table, table.where("id = 0")).collect())
    most = (1 << 63) - 1
    assert got == [(1, 1, most), (2, 2, most), (3, 4, most), (4, 5, 64 * 192), (5, 3, -most - 1)]


def test_top_k_takes_every_vector_of_a_repeated_id(spark):
    rows = [(0, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [1.5, 0.0])]
    table = pivots.vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = sorted((r["rank"], r.vec_id, r.score) for r in pivots.top_k(table, table.where("id = 0")).collect())
    assert got == [(1, 3, 8192), (2, 4, 6144), (3, 3, 4096)]


def test_chat_texts_lie_in_the_final_rendering_after_a_rewrite(spark):
    turns = [("user", "hi"), ("assistant", "first # answer"), ("user", "more"), ("assistant", "second")]
    numbered = lambda ts: "".join(f"[{len(ts) - k}]{r}:{t.replace('#', '##')};" for k, (r, t) in enumerate(ts))
    latest_only = lambda ts: "".join(f"{r}:{t if k + 1 == len(ts) else ''};" for k, (r, t) in enumerate(ts))
    table = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    for template, want in ((numbered, ["first ## answer", "second"]), (latest_only, ["second"])):
        row = chat.format_chats(table, template).collect()[0]
        assert row.rewrites_at == 1 and [row.formatted[p.start : p.end] for p in row.texts] == want
