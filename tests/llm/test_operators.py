"""Small cases of every operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayloom.llm import chat, ctw, decontaminate, langid, licenses, packing, patricia, probminhash, quality, queries, secrets

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
LONG = " ".join(WORDS[i * 7 % 24] + str(i % 97) for i in range(40_000))


def docs(spark, *texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


ODD = [None, "", "!!! ...", "one", "a  b\tc\nd", LONG, "Ünïcode ça và", "one", "ONE"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    import sys

    sys.path.insert(0, "tests")
    from oracle import same

    same(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], SF)


def test_exact_dedup(spark):
    d = docs(spark, *ODD)
    d = d.unionByName(d.where("doc_id = 7"))
    got = patricia.exact_dedup(d).collect()
    groups = defaultdict(list)
    for r in d.collect():
        groups[(r.text or "").encode().lower()].append(r.doc_id)
    assert len(got) == 10
    for r in got:
        own = next(g for t, g in groups.items() if hashlib.sha256(t).hexdigest() == r.text_sha256)
        assert r.keep_id == max(own) and r.group_size == len(own)
    assert sum(r.kept for r in got) == len(groups)
    assert patricia.keep_owners(d).count() == len(groups)
    clash = d.withColumn("sha", F.lit("mine")).withColumn("ident", F.lit(1))
    kept = patricia.keep_owners(clash.unionByName(clash.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long"))))
    assert kept.columns == clash.columns and {r.sha for r in kept.collect()} == {"mine"}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(max(g) for g in groups.values())
    alone = patricia.keep_owners(docs(spark, "x", "x").withColumn("doc_id", F.lit(None).cast("long")))
    assert [r.doc_id for r in alone.collect()] == [None]
    assert patricia.exact_dedup(d.limit(0)).count() == 0
    assert min(r.keep_id for r in patricia.owners(d, keep="smallest").collect()) == 0


def test_exact_dedup_in_small_steps(spark):
    """Budgets of a few rows: texts leave early, wait in files and spill, and the rows stay the same."""
    texts = [("Word " * (i % 7) + str(i % 40)) if i % 3 else "the one that a third of all rows hold" for i in range(900)]
    d = docs(spark, *texts).repartition(5)
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t.lower()].append(i)
    for keep, pick in (("largest", max), ("smallest", min)):
        want = {i: (pick(g), len(g), i == pick(g)) for g in groups.values() for i in g}
        for budget in (300, patricia.BUDGET):
            assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in patricia.exact_dedup(d, keep=keep, budget=budget).collect()} == want
            kept = patricia.keep_owners(d, keep=keep, budget=budget).collect()
            assert sorted(r.doc_id for r in kept) == sorted(map(pick, groups.values()))
            assert all(r.text == texts[r.doc_id] for r in kept)


def test_trie_spills_by_subtree():
    trie, want = patricia.PatriciaTrie(lambda a, b: (min(a[0], b[0]), a[1] + b[1]), budget=4000), {}
    rng = np.random.default_rng(1)
    for i in rng.integers(0, 400, 3000).tolist():
        key = hashlib.sha256(str(i).encode()).digest()[:8] + (b"x" * (i % 50)) + str(i).encode()
        trie.insert(key, (i, 1))
        want[key] = (min(i, want.get(key, (i, 0))[0]), want.get(key, (0, 0))[1] + 1)
    assert trie.spilled
    assert dict(trie.drain()) == want


def test_decontamination_by_brute_force(spark):
    bench = spark.createDataFrame([(1, " ".join(WORDS)), (2, "tau rho"), (3, None), (4, "..."), (5, " ".join(WORDS[:13]).upper())], "item_id long, text string")
    texts = [" ".join(WORDS[2:20]), "x Tau, rho y", "tau. rho " * 3, LONG, *ODD, "rho tau", " ".join(WORDS[:12])]
    d = docs(spark, *texts).withColumn("n_words", F.lit("mine")).withColumn("spans", F.lit(1))
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: rx.findall((t or "").encode().lower().decode())
    items = {r.item_id: low(r.text) for r in bench.collect()}
    for slices in (decontaminate.SLICE, 60):  # one broadcast, and several
        got = {r.doc_id: r for r in decontaminate.hit_counts(decontaminate.matches(d, bench, slice_bytes=slices)).collect()}
        for i, t in enumerate(texts):
            words, hit, found = low(t), set(), set()
            for item, w in items.items():
                for k in range(max(1, len(w) - 12) if w else 0):
                    win = w[k : k + 13]
                    for j in range(len(words) - len(win) + 1):
                        if words[j : j + len(win)] == win:
                            hit |= set(range(j, j + len(win)))
                            found.add(str(item))
            assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == (len(words), len(hit), sorted(found))
    kept = decontaminate.clean(d, bench)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.contaminated}
    near = decontaminate.matches(docs(spark, "tau so rho", "tau a b c d e rho", "x rho", "tau rho", "rho x", "tau tau"), bench, slop=2)
    assert [len(r.spans) for r in near.orderBy("doc_id").collect()] == [1, 0, 0, 1, 0, 0]
    assert decontaminate.matches(d, bench.limit(0)).where("size(spans) > 0").count() == 0
    postings = decontaminate.index(d, columns=["doc_id"])  # one stored index answers several benchmarks
    lists = postings.where("term is not null").agg(F.sum(F.octet_length("at"))).first()[0]
    assert lists == 4 * sum(len(low(t)) for t in texts)
    for item, hits in ((" ".join(WORDS[:12]), 1), ("rho tau", 2), ("nowhere at all", 0)):
        assert decontaminate.search(postings, spark.createDataFrame([(item, item)], "item_id string, text string")).count() == hits


def test_secrets(spark):
    assert secrets.trigram_query(r"[0-9a-f]{24,}") is True
    assert secrets.trigram_query("(password|token)=") == ("or", (("and", ("pas", "ass", "ssw", "swo", "wor", "ord")), ("and", ("tok", "oke", "ken"))))
    texts = [None, "", "ToKeN: 'abcdef' x", "secret=token:abcdefgh", "é password = 12345", "AKIA" + "B" * 16 + " " + "a" * 24, "api_key=abcdefg api-key", "ghp_" + "a" * 40]
    d = docs(spark, *texts)
    got = {r[0]: r[1] for r in secrets.scan(d).select("doc_id", secrets.spelled(F.col("found"))).collect()}
    assert got == {0: "", 1: "", 2: "assign:0:14", 3: "", 4: "", 5: "access:0:20,hex:21:45", 6: "assign:0:15", 7: "forge:0:44,hex:4:44"}
    assert secrets.scan(d.limit(0)).count() == 0


CONTROL = st.lists(st.sampled_from(["</s>", "<s>", "[INST]", " [/INST]\n", "<<SYS>>", "<</SYS>>", "<<ROLE x>>", "&", "&lt;", "&amp;", "<", "[", " ", "\n", "é", "a", "]", ">"]), max_size=8).map("".join)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), CONTROL), CONTROL), min_size=1, max_size=12))
def test_chat_round_trip(turns):
    from pyspark.sql import SparkSession

    d = SparkSession.getActiveSession().createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    out = chat.format_chats(d).withColumn("back", chat.read_back(F.col("formatted"))).first()
    assert [(r.role, r.text) for r in out.back] == turns
    assert "".join(s.text for s in out.segments) == out.formatted


def test_chat_order_and_nulls(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "assistant", "x"), (3, None, None, None), (4, 0, "system", ""), (4, 1, "user", "q"), (4, 2, "assistant", "r"), (5, 0, "user", "only")]
    out = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {k: r.valid for k, r in out.items()} == {1: True, 2: False, 3: False, 4: True, 5: False}
    assert [s.text for s in out[4].segments if s.loss] == ["r"]


def test_packing_keeps_every_token(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [*ODD, "it's <|endoftext|> Don'T 12ab!?—x", "A" * 3000] + [" ".join(WORDS[: i % 24]) for i in range(200)]
    rows = packing.pack(docs(spark, *texts), path, with_ids=True).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
        assert zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32
    for i, text in enumerate(texts):
        own = sorted(pieces[i], key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == [*t.encode(text or "", add_special_tokens=False).ids, 1]
    for w in windows.values():
        at = 0
        for r in sorted(w, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0
    assert packing.pack(docs(spark, "x").limit(0), path).count() == 0


def test_language_id(spark):
    en, de = "the house and the garden are with that of this", "das haus und der garten sind mit dem und nicht"
    train = docs(spark, *[en] * 5).unionByName(docs(spark, *[de] * 5, lang="de"))
    f = langid.train(train)
    got = docs(spark, "the garden", "der garten und", None, "12 !?", "").select("doc_id", langid.predict(F.col("text"), f, spark).alias("p")).select("p.*").collect()
    assert [r.lang_pred for r in got] == ["en", "de", "und", "und", "und"]
    assert all(0 <= r.score <= 1 for r in got)
    none = langid.train(train.limit(0))
    assert docs(spark, "abc").select(langid.predict(F.col("text"), none, spark).lang_pred).first()[0] == "und"
    grams = np.arange(1000)
    x = langid.Filters(["a", "b"], {"a": grams, "b": grams[::2]})
    assert all(m & 1 for m in x.masks(grams.astype(np.uint32))[0].tolist())


def test_language_stage_rejects_noise(spark):
    import random

    import corpus_pipeline

    r, clean = random.Random(5), spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(400)
    alphabets = ["abcdefghijklmnopqrstuvwxyz ", "ABCDEFGHabcdefgh0123456789+/", "0123456789 x", "абвгдежзик ", "#$%&*()_+@!~ z"]
    junk = ["".join(r.choice(a) for _ in range(r.randrange(40, 900))) for a in alphabets for _ in range(12)]
    d = clean.unionByName(docs(spark, *junk, None, "", "12 34", lang=None).withColumn("doc_id", -F.col("doc_id") - 1))
    kept = {x.doc_id for x in corpus_pipeline.language_id(spark, d, SF).select("doc_id").collect()}
    wanted = {x.doc_id for x in clean.select("doc_id").collect()}
    assert len(kept & wanted) >= 0.99 * len(wanted)
    assert len([i for i in kept if i < 0]) <= 0.1 * len(junk) and not kept & {-len(junk) - k for k in (1, 2, 3)}


def test_language_id_held_out(spark):
    out = queries.op10_language_id(spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert out.where("lang = lang_pred").count() >= 0.97 * out.count()


def test_language_id_by_brute_force(spark):
    """Plain sets of n-grams instead of filters: same languages, scores up to what false positives leave."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()

    def grams(text):
        b = b" " + " ".join(text.lower().split()).encode() + b" "
        return [b[i : i + 4] for i in range(len(b) - 3)]

    counts = defaultdict(Counter)
    for r in rows:
        if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            counts[r.lang].update(grams(r.text))
    known = {lang: {g for g, n in c.items() if n >= langid.SHARE * c.total()} for lang, c in sorted(counts.items())}
    got = {r.doc_id: r for r in queries.op10_language_id(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        mine = got[r.doc_id]
        assert mine.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.text is None or not any(map(str.isalpha, r.text)):
            assert (mine.lang_pred, mine.score) == ("und", 0)
            continue
        hits = {lang: sum(g in k for g in grams(r.text)) for lang, k in known.items()}
        best, second = sorted(hits.values(), reverse=True)[:2]
        if best > second * 1.02 + 2:
            assert hits[mine.lang_pred] == best
        if best:
            assert abs(mine.score - best / sum(hits.values())) < 0.02 + 2 / sum(hits.values())  # a few false positives


def test_near_dedup_by_brute_force(spark):
    d = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    sets = {}
    for i, t in d:
        w = rx.findall(t.encode().lower().decode())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    name = {i: i for i in sets}

    def root(x):
        while name[x] != x:
            x = name[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                name[y] = x
    got = {r.doc_id: r.class_id for r in probminhash.near_classes(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert got == {i: root(i) for i in sets}


def test_near_dedup_odd_rows(spark):
    body = [f"w{i}" for i in range(200)]
    near = [" ".join(body[:k] + ["other"] + body[k + 1 :]) for k in range(20, 180, 8)]  # many copies of one text, one word off each
    d = docs(spark, " ".join(body), *near, *ODD)
    got = {r.doc_id: r for r in probminhash.near_classes(d).collect()}
    n = len(near) + 1
    assert {got[i].class_id for i in range(n)} == {0} and got[0].class_size == n
    odd = {i: got[n + i].class_id - n for i in range(len(ODD))}
    assert odd == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 3, 8: 3}
    assert probminhash.near_classes(d.limit(0)).count() == 0
    mine = d.withColumn("row_key", F.lit(1)).withColumn("node", F.lit("x"))
    kept = probminhash.keep_one(mine)
    assert kept.columns == mine.columns and kept.count() == 1 + len(ODD) - 2
    assert probminhash.keep_one(mine.unionByName(mine)).count() == 1 + len(ODD) - 2


def test_near_dedup_unequal_repetition(spark):
    rng = np.random.default_rng(5)
    texts, want = [], 0
    rx = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    for i in range(40):
        w = [f"t{i}w{j}" for j in range(200)]
        x = " ".join(["p", *w, "q"])
        # a passage of the text is repeated, in one text only
        y = " ".join(["r", *w, *w[int(rng.integers(100, 120)) :] * 12, "s"])
        texts += [x, y]
        want += len(rx(x) & rx(y)) >= 0.8 * len(rx(x) | rx(y))
    assert want == 40
    got = {r.doc_id: r.class_id for r in probminhash.near_classes(docs(spark, *texts)).collect()}
    assert got == {i: i - i % 2 for i in range(80)}


def test_near_dedup_pairs_in_crowded_buckets(spark):
    # many texts hold one passage, 0.74 between any two; a pair that shares more must not be lost among them
    texts = []
    for i in range(60):
        w = [*(f"c{j}" for j in range(850)), *(f"u{i}x{j}" for j in range(150))]
        texts += [" ".join(w), " ".join([*w[:930], *(f"v{i}x{j}" for j in range(70))])]
    h, owner, count = probminhash.weighted_sets([t.encode() for t in texts])
    sets = [set(h[owner == i].tolist()) for i in range(120)]
    near = {(i, j) for i in range(120) for j in range(i + 1, 120) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert near == {(i, i + 1) for i in range(0, 120, 2)}
    bucket = probminhash._bands(h, owner, count, 120, 1, 1)[1][:, 0].tolist()
    got = {r.doc_id: r.class_id for r in probminhash.near_classes(docs(spark, *texts), bands=1, rows=1).collect()}
    met = [i for i, j in near if bucket[i] == bucket[j] and bucket.count(bucket[i]) > probminhash.SMALL]
    assert len(met) > 20 and all(got[i + 1] == i for i in met)
    assert all(c == i or (c, i) in near for i, c in got.items())


def test_prefix_keys_meet():
    rng = np.random.default_rng(11)
    for n in (1, 3, 5, 7, 20, 44, 45, 100, 333):
        for _ in range(20):
            x = [f"w{i}" for i in range(n)]
            y = x[: int(n * rng.uniform(0.8, 1)) + 1] + [f"z{i}" for i in range(int(rng.integers(0, n // 5 + 1)))]
            a, b = ({" ".join(t[k : k + 5]) for k in range(max(1, len(t) - 4))} for t in (x, y))
            batch = pa.record_batch([pa.array([1, 2]), pa.array([1, 2]), pa.array([" ".join(x), " ".join(y)])], names=["node", "component", "text"])
            seen = type("B", (), {"value": rng.integers(0, 4, probminhash.SKETCH)})
            keys = {1: set(), 2: set()}
            for r in probminhash._prefixes(5, 0.8, seen)([batch]):
                for key, node, size in zip(*(r.column(c).to_pylist() for c in range(3)), strict=True):
                    keys[node].add(key)
                    assert size == len((a, b)[node - 1])
            assert len(a & b) < 0.8 * len(a | b) or keys[1] & keys[2]


def test_register_agreement_estimates_probability_jaccard():
    rng = np.random.default_rng(3)
    a, b = rng.integers(1, 1 << 62, 600, dtype=np.uint64), rng.integers(1, 1 << 62, 200, dtype=np.uint64)
    x, y = np.sort(a), np.sort(np.concatenate([a[:400], b]))
    h, owner = np.concatenate([x, y]), np.repeat([0, 1], [len(x), len(y)])
    sig = probminhash.prob_min_hash(h, owner, np.ones(len(h)), 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - 400 / 800) < 0.03


def test_context_trees(spark):
    """The model's probabilities against a direct recursion over a tiny corpus, and a proper distribution."""
    bodies, depth = [b"abab", b"abac", b"b"], 3
    key = ctw.Stream(bodies, depth).key
    u, n = np.unique(key, return_counts=True)
    shard = ctw.Shard(u, n, depth)
    tops = ctw.Tops(*shard.summary())
    counts = Counter()
    for k, c in zip(u.tolist(), n.tolist(), strict=True):
        x, ctx = k & 255, [(k >> (8 * (depth - i))) & 255 for i in range(depth)]
        for d in range(depth + 1):
            for j in range(8):
                counts[tuple(ctx[:d]), (1 << j) | (x >> (8 - j)), (x >> (7 - j)) & 1] += c
    get = lambda ctx, node: (counts[ctx, node, 0], counts[ctx, node, 1])
    kt = lambda a, b: float(ctw.log_kt(np.array([float(a)]), np.array([float(b)]))[0])
    children = defaultdict(set)
    for ctx, node, _ in list(counts):
        if ctx:
            children[ctx[:-1], node].add(ctx)

    def weighted(ctx, node):
        own = kt(*get(ctx, node))
        if len(ctx) == depth:
            return own
        return np.logaddexp(own, sum(weighted(c, node) for c in children[ctx, node])) - np.log(2)

    def predict(ctx, d, node, bit):
        c = ctx[:d]
        a = get(c, node)
        own = (a[bit] + 0.5) / (sum(a) + 1)
        if d == depth or not sum(get(ctx[: d + 1], node)):
            return own
        below = sum(weighted(x, node) for x in children[c, node])
        beta = 1 / (1 + np.exp(below - kt(*a)))
        return beta * own + (1 - beta) * predict(ctx, d + 1, node, bit)

    asked = np.concatenate([u, (u & ~np.int64(255)) | 99])
    for k, got in zip(asked.tolist(), shard.log_p(asked, tops).tolist(), strict=True):
        x, ctx = k & 255, tuple((k >> (8 * (depth - i))) & 255 for i in range(depth))
        want = sum(np.log(predict(ctx, 0, (1 << j) | (x >> (8 - j)), (x >> (7 - j)) & 1)) for j in range(8))
        assert got == pytest.approx(want, abs=1e-9)
    whole = (int(u[0]) & ~255) | np.arange(256)
    assert np.exp(shard.log_p(whole, tops)).sum() == pytest.approx(1)


def test_lm_base_scores(spark):
    texts = [*ODD, *[" ".join(WORDS[i : i + 6]) for i in range(12)]]
    d = docs(spark, *texts)
    for block in (ctw.BLOCK, 300):
        got = {r.doc_id: r for r in ctw.score(d, F.col("doc_id") % 3 == 0, block=block).collect()}
        tok = [(t or "").encode().lower().split() + [None] for t in texts]
        c = Counter(w for i, t in enumerate(tok) if i % 3 for w in t)
        n = sum(c.values())
        for i, t in enumerate(tok):
            assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(t), sum(w in c for w in t), n)
            assert got[i].base_score == pytest.approx(sum(np.log10((c[w] + 1) / (n + len(c) + 1)) for w in t), rel=1e-9)
            assert got[i].score < 0
    assert ctw.score(d.limit(0), F.lit(False)).count() == 0


def test_lm_block_memory():
    """F op2: the answers to a block are held once, without a hash table beside them."""
    import tracemalloc

    n = 1_000_000
    body = " ".join(WORDS * 40)
    own = [np.unique(ctw.Stream([body.encode()], ctw.DEPTH).key), np.unique(ctw.signed(ctw.Words([body.encode()], ctw.BLACK).hashes()))]
    more = np.setdiff1d(np.arange(n, dtype=np.int64) * 7919, own[0])
    keys = [*own, more]
    kinds = np.concatenate([np.full(len(k), kind, np.int32) for k, kind in zip(keys, (ctw.PAIR, ctw.WORD, ctw.PAIR), strict=True)])
    known = pa.table({"block": np.zeros(len(kinds), np.int64), "kind": kinds, "key": np.concatenate(keys), "value": np.concatenate([np.full(len(own[0]), -1.0), np.full(len(own[1]), 3.0), np.full(len(more), -9.0)])})
    texts = pa.table({"doc_id": pa.array([1, 2], pa.int64()), "text": [body, ""], "held_out": [False, True]})
    first = ctw._score(ctw.DEPTH, 1, 10, 5)
    with pytest.raises(ValueError):
        first(texts, known.filter(pa.compute.not_equal(known.column("key"), int(own[0][3]))))
    known = pa.concat_tables([known, pa.table({"block": [0], "kind": pa.array([ctw.PAIR], pa.int32()), "key": ctw.Stream([b""], ctw.DEPTH).key, "value": [-1.0]})]) if ctw.Stream([b""], ctw.DEPTH).key[0] not in own[0] else known
    tracemalloc.start()
    try:
        got = first(texts, known).to_pylist()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got[0]["score"] == pytest.approx(-(len(body) + 1) / np.log(10)) and got[0]["n_known"] == len(WORDS) * 40 + 1 and got[1]["score"] == pytest.approx(-1 / np.log(10))
    assert peak < 36 * n, peak / n


def test_quality(spark):
    good, bad = " ".join(WORDS) + ".", "BUY!! NOW!! " * 9
    d = docs(spark, *[good + f" {i}" if i % 2 else bad + str(i) for i in range(300)], *ODD)
    labels = d.where("doc_id < 200").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    got = {r.doc_id: r.score for r in quality.score(d, labels).collect()}
    assert all((got[i] >= 0.5) == bool(i % 2) for i in range(200, 300)) and len(got) == 300 + len(ODD)
    assert all(0 <= s <= 1 for s in got.values())
    assert {r.score for r in quality.score(d, labels.limit(0)).collect()} == {0.5}
    assert quality.score(d.limit(0), labels).count() == 0


def plain_statistics(text):
    """The statistics of the quality operator, counted one by one."""
    raw = (text or "").encode()
    words, lines, size = re.findall(rb"[^ \t-\r]+", raw), raw.split(b"\n"), max(1, len(raw))
    low, n = [w.lower() for w in words], max(1, len(words))
    punct = [chr(b).isascii() and not chr(b).isalnum() and b > 32 for b in raw]
    share = lambda f: sum(map(f, raw)) / size
    return [
        np.log1p(len(raw)), np.log1p(len(words)), sum(map(len, words)) / n, share(lambda b: 65 <= b <= 90), share(lambda b: 48 <= b <= 57), sum(punct) / size, share(lambda b: b in b"#$%&*@^~_=+<>{}[]|\\/"),
        share(lambda b: b >= 128), share(lambda b: b in b" \t\n\v\f\r"), np.log1p(len(raw) / len(lines)), len(set(low)) / n, max(Counter(low).values(), default=0) / n, sum(a == b for a, b in zip(low, low[1:])) / n,
        1 - len(set(lines)) / len(lines), sum(w[-1] < 128 and not chr(w[-1]).isalnum() and w[-1] > 32 for w in words) / n, share(lambda b: b == 124), sum(len(w) <= 2 for w in words) / n, sum(len(w) >= 15 for w in words) / n, share(lambda b: b == 10),
    ]


def test_quality_by_brute_force(spark):
    """Statistics counted one by one, the model applied rule by rule, no label of a held-out row in it."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    x = {r.doc_id: np.array(plain_statistics(r.text)) for r in rows}
    odd = np.array([plain_statistics(t) for t in ODD])
    assert np.allclose(quality.statistics(ODD), odd) and np.allclose(quality.statistics([r.text for r in rows]), [x[r.doc_id] for r in rows])
    some = sorted(i for i in x if labels.get(i) is not None)
    # the operator's own statistics, so that thresholds fall on the same side
    own = dict(zip(x, quality.statistics([r.text for r in rows]), strict=True))
    model = quality.fit(np.array([own[i] for i in some]), np.array([labels[i] for i in some], dtype=float))
    assert model.rules or model.linear

    def plain(v):
        total = model.bias + sum(w for rule, w in model.rules if all((v[i] > cut) == above for i, above, cut in rule.terms))
        total += sum((min(max(v[i], low), high) - low) * w / max(high - low, 1e-9) for i, low, high, w in model.linear)
        return 1 / (1 + np.exp(-min(max(total, -30), 30)))

    got = queries.op1_quality(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(x)
    for r in got:
        assert abs(r.score - plain(own[r.doc_id])) < 1e-9 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_quality_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    out = queries.op1_quality(spark, "/root/testdata/sf0.01").where("held_out").join(labels, "doc_id")
    assert out.where("predicted = quality").count() >= 0.9 * out.count() > 0


def test_licenses(spark):
    rows = [("LICENSE", "This work is licensed under the GNU General Public License, version 3."), ("a/LICENSE", "Released under the MIT License."), ("a/b/c.txt", "words and words"), ("a/x.txt", "# Licensed under the Apache License, Version 2.0\n" + "body " * 90), ("z/y.txt", "the version of things"), (None, None), ("q/r", "")]
    d = spark.createDataFrame(rows, "p string, text string").withColumn("license", F.lit("mine"))
    got = {r.path: (r.license, r.inherited_license, r.license_dir) for r in licenses.scan_licenses(d, F.col("p")).collect()}
    assert got["a/b/c.txt"] == (None, "MIT", "a") and got["a/x.txt"] == ("Apache-2.0", None, None)
    assert got["z/y.txt"] == (None, "GPL-3.0", "") and got["q/r"][1] == "GPL-3.0" and got["LICENSE"][0] == "GPL-3.0"
    assert licenses.scan_licenses(d.limit(0), F.col("p")).count() == 0


def test_license_headers(spark):
    body = "words and words of a plain file\n" * 30
    rows = {
        "wrapped": ("# Licensed under the Apache\n# License, Version 2.0 (the License);\n# you may not use this file except in compliance with the License.\n" + body, "Apache-2.0"),
        "lgpl": ("This library is licensed under the GNU Lesser General Public License, version 3.\n" + body, "LGPL-3.0"),
        "agpl": (body + "This program is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
        "gpl": ("This work is licensed under the GNU General Public License, version 3.\n" + body, "GPL-3.0"),
        "denied": ("This work is not licensed under the MIT License\n" + body, None), "short": ("Not released under the MIT License", None),
        "long": (body * 400 + "Released under the MIT License\n" + body * 400, "MIT"), "p/COPYING.txt": ("Released under the MIT License\n" + body, "MIT"), "p/q": (body, None),
    }
    d = spark.createDataFrame([(k, v[0]) for k, v in rows.items()], "p string, text string")
    got = {r.path: r for r in licenses.scan_licenses(d.unionByName(d), F.col("p")).collect()}
    assert {k: got[k].license for k in rows} == {k: v[1] for k, v in rows.items()}
    assert got["p/COPYING.txt"].is_license_file and got["p/q"].inherited_license == "MIT" and not got["lgpl"].is_license_file


def test_full_license_files(spark):
    from wayloom.llm.license_texts import FULL

    plain = "the text of a document that you and any other person may read, and to which the terms of this work do not apply " * 9
    rows = [r for k, t in FULL.items() for r in ((f"{k}/LICENSE", "Copyright (c) 2019 Some Person <some@person.example>\n\n" + t), (f"{k}/src/a.txt", plain))]
    rows += [("MIT/src/one_line/LICENSE", " ".join(FULL["Apache-2.0"].split())), ("MIT/src/one_line/b", plain), ("other/x", plain)]
    got = {r.path: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "p string, text string"), F.col("p")).collect()}
    for k in FULL:
        assert (got[f"{k}/LICENSE"].license, got[f"{k}/LICENSE"].is_license_file) == (k, True)
        assert (got[f"{k}/src/a.txt"].license, got[f"{k}/src/a.txt"].inherited_license, got[f"{k}/src/a.txt"].license_dir) == (None, k, k)
    assert got["MIT/src/one_line/b"].inherited_license == "Apache-2.0" and got["other/x"].inherited_license is None


ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return ALNUM_WORD.findall((text or "").encode().lower().decode())


def plain_language(rows):
    """Rows (doc_id, text, lang) that are in a language: n-grams counted with dictionaries."""

    def grams(t):
        b = b" " + " ".join(t.lower().split()).encode() + b" "
        return [b[i : i + 4] for i in range(len(b) - 3)]

    counts = defaultdict(Counter)
    for i, t, lang in rows:
        if t is not None and lang is not None and zlib.crc32(str(i).encode()) % 5:
            counts[lang].update(grams(t))
    held = {lang: {g for g, n in c.items() if n >= langid.SHARE * sum(c.values())} for lang, c in counts.items()}
    kept = set()
    for i, t, _ in rows:
        if t and any(map(str.isalpha, t)):
            g = grams(t)
            n, z = max(1, len(g)), 1.64
            p = max(sum(x in h for x in g) for h in held.values()) / n
            if (p + z * z / (2 * n) + z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n) >= langid.LEAST_KNOWN:
                kept.add(i)
    return kept


def plain_near(texts):
    """The smallest id of each class of texts {id: text}."""
    sets = {}
    for i, t in texts.items():
        w = plain_words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    name = {i: i for i in sets}

    def root(x):
        while name[x] != x:
            x = name[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                name[y] = x
    return {root(i) for i in sets}


def plain_clean(texts, items):
    """Ids of texts of which less than 5 % of the words lie in windows of the items."""
    windows = {tuple(w[k : k + 13]) for w in map(plain_words, items) if w for k in range(max(1, len(w) - 12))}
    sizes, kept = {len(x) for x in windows}, set()
    for i, t in texts.items():
        w, hit = plain_words(t), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
        if not hit or 20 * len(hit) < len(w):
            kept.add(i)
    return kept


def test_pipeline_by_brute_force(spark, tmp_path):
    """Every stage's rows, and run()'s tokens, against plain Python over rows with noise, copies, near copies and benchmark passages."""
    import random
    import shutil

    import corpus_pipeline
    from tokenizers import Tokenizer

    r = random.Random(11)
    rows = [(x.doc_id, x.text, x.lang) for x in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [x.text for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [t for _, t, _ in rows if 300 < len(t) < 2000][:8]
    more = ["".join(r.choice("bcdfghjklmnpqrstvwxz ") for _ in range(500)), None, "", "1234 !!", clean[0].upper(), clean[0], clean[1] + " one more", clean[1] + " one more thing", items[0], clean[2] + " " + items[1], " ".join([clean[3]] * 60 + [items[2]])]
    rows += [(10**6 + i, t, "en" if t and i > 3 else None) for i, t in enumerate(more)]
    for name in ("benchmark", "labels"):
        shutil.copy(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    table = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], DOCS)
    table.write.parquet(str(tmp_path / "documents.parquet"))
    texts = {i: t for i, t, _ in rows}

    want = [plain_language(rows)]
    owner = {}
    for i in want[0]:
        owner[texts[i].encode().lower()] = max(i, owner.get(texts[i].encode().lower(), i))
    want.append(set(owner.values()))
    want.append(plain_near({i: texts[i] for i in want[1]}))
    want.append(plain_clean({i: texts[i] for i in want[2]}, items))
    assert len(texts) > len(want[0]) > len(want[1]) > len(want[2]) > len(want[3])
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for (name, stage), ids in zip(corpus_pipeline.STAGES, want, strict=False):
        d = stage(spark, d, str(tmp_path))
        assert d.columns == table.columns
        got = d.select("doc_id", "text").collect()
        assert sorted(x.doc_id for x in got) == sorted(ids), name
        assert all(x.text == texts[x.doc_id] for x in got)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = defaultdict(list)
    for x in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[x.doc_id].append(x)
    assert pieces.keys() == want[3]
    for i, own in pieces.items():
        ids = [*tok.encode(texts[i], add_special_tokens=False).ids, 1]
        at = 0
        for x in sorted(own, key=lambda x: x.start):
            assert x.start == at and x.doc_tokens == len(ids)
            assert x.ids_crc32 == zlib.crc32(np.array(ids[at : at + x.length], dtype="<u4").tobytes())
            at += x.length
        assert at == len(ids)
