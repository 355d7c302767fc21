"""Each operator against brute force on small tables with nulls, ties, empty and long texts, repeated rows and extra columns."""

import hashlib
import os
import random
import subprocess
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelweave.llm import ann, bpe, chat, fingerprint, langid, linededup, lm, minhash, mixing, substring

SPACES = " \t\n\x0b\x0c\r"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, component_id string, size string"


def words(text):
    out = [""]
    for c in text or "":
        if c in SPACES:
            out.append("")
        else:
            out[-1] += c
    return [w for w in out if w]


def documents(seed=5, n=60):
    rnd = random.Random(seed)
    vocabulary = ["the", "of", "and", "Über", "été", "x1", "zebra", "quick", "brown", "fox", "日本", "lazy", "dog", "señor", "naïve", "co-op"]
    base = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 160))) for _ in range(n // 3)]
    texts = [None, "", " \t\n", "one", "one two", "ONE", "a" * 3000, "line one has many words in it to be compared\n" * 3]
    while len(texts) < n:
        t = rnd.choice(base).split(" ")
        for _ in range(rnd.randrange(0, 4)):
            t[rnd.randrange(len(t))] = rnd.choice(vocabulary)
        texts.append(rnd.choice([" ", "  ", "\n"]).join(t) if rnd.random() < 0.3 else " ".join(t))
    return [(i * 7 % 1009, t, rnd.choice(["en", "fr", None]), rnd.choice(["a", "b", "", None, "é"]), 0, "x", "y") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_minhash(docs, empty):
    for size in (2, 5):
        rows = {r["doc_id"]: r for r in minhash.near_duplicates(docs, words=size).collect()}
        sets = {}
        for d, t, *_ in documents():
            w = [x.encode().lower() for x in words(t)]
            sets[d] = {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
        root = {d: d for d in sets}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        ids = sorted(sets)
        for i, a in enumerate(ids):
            for b in ids[i + 1:]:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
        assert {d: (r["n_shingles"], r["component_id"], r["kept"]) for d, r in rows.items()} == {d: (len(sets[d]), find(d), find(d) == d) for d in ids}
    assert minhash.near_duplicates(empty).count() == 0


def test_superminhash_estimates():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    a, b = common[:360], common[40:]
    sig = minhash.superminhash(np.concatenate((a, b)), np.array([len(a), len(b)]), 256)
    assert abs((sig[0] == sig[1]).mean() - 320 / 400) < 0.08
    assert (sig < np.iinfo(np.uint64).max).all()


def test_minhash_null_and_repeated_ids(spark):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(None, long), (None, long), (4, long), (4, long), (9, long), (5, "")]
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert [g for g in got if not g[0]] == [(False, 4, 4, True), (False, 4, 4, True), (False, 5, 5, True), (False, 9, 4, False)]
    assert [g[2:] for g in got if g[0]] == [(None, True), (None, True)]


def test_bpe(docs, empty):
    import public_tokenizers
    import tiktoken

    ranks = bpe.load_ranks()
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in bpe.encode_documents(docs, keep_ids=True).collect()}
    for d, t, *_ in documents():
        ids = enc.encode_ordinary(t or "")
        assert got[d]["ids"] == ids and got[d]["n_tokens"] == len(ids)
        assert got[d]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[d]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_documents(empty).count() == 0


def test_bpe_odd_texts():
    import public_tokenizers
    import tiktoken

    codec = bpe.Codec()
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rnd = random.Random(3)
    parts = ["a", " ", "  ", "\n", " \n", " ", "\u0085", "\x1c", "é", "日本", "'s", "'t", " 's", "12", "!!", "\t", "<|endoftext|>", "x" * 300, "ing" * 120, "🎉"]
    for _ in range(400):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 12)))
        [ids] = codec.encode([text])
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(text)
        assert codec.decode([ids]) == [text.encode()]
    codec.close()


def test_substring(spark, empty):
    rnd = random.Random(8)
    passage = [f"p{i}" for i in range(70)]
    rows = []
    for i in range(25):
        w = [rnd.choice("abcdefgh") + str(rnd.randrange(50)) for _ in range(rnd.randrange(0, 200))]
        if i % 3 == 0:
            at = rnd.randrange(len(w) + 1)
            w[at:at] = passage[rnd.randrange(10):]
        rows.append((100 - i, " ".join(w), "extra"))
    rows += [(3, None, ""), (4, "", ""), (5, "a " * 300, ""), (6, "a " * 120, "")]
    got = {r["doc_id"]: tuple(r)[1:] for r in substring.digests(spark.createDataFrame(rows, "doc_id bigint, text string, at string")).collect()}
    starts = {}
    for d, t, _ in rows:
        w = words(t)
        for i in range(len(w) - 49):
            key = tuple(w[i:i + 50])
            starts[key] = min(starts.get(key, d), d)
    for d, t, _ in rows:
        w = words(t)
        gone = {k for i in range(len(w) - 49) if starts[tuple(w[i:i + 50])] < d for k in range(i, i + 50)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert got[d] == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert substring.digests(empty).count() == 0


def test_substring_tells_rows_of_one_id_apart(spark):
    passage, own = " ".join(f"p{i}" for i in range(60)), [" ".join(f"{c}{i}" for i in range(n)) for c, n in (("b", 100), ("n", 300))]
    rows = [(1, passage), (5, f"{own[0]} {passage}"), (5, "a b c"), (5, "a b c"), (9, own[1]), (9, passage)]
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
        got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring.digests(df).collect())
        assert got == [(1, 60, 0), (5, 3, 0), (5, 3, 0), (5, 160, 60), (9, 60, 60), (9, 300, 0)]


def test_chat(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "[INST] a \\ <\\s>"), (1, 2, "assistant", "</s>b<s>"), (2, 0, "assistant", None), (2, 1, "tool]", "x[/ROLE]y"), (3, None, None, ""), (3, 0, "user", "q"), (3, 0, "user", "q")]
    rows += [(4, i, "assistant" if i % 2 else "user", f"t{i} <<SYS>>") for i in range(700)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, chunk string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(df)).collect()}
    for c in (1, 2, 3, 4):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[c]["n_turns"] == len(own) and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert [got[c]["errors"] for c in (1, 2, 3, 4)] == [0, 2, 3, 0]
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def test_fingerprints(docs, empty, spark):
    rows = sorted(((d, t or "") for d, t, *_ in documents()), key=lambda r: -r[0])
    got = {r["doc_id"]: r for r in fingerprint.likenesses(docs).collect()}
    for i, (d, t) in enumerate(rows):
        after, third = rows[(i + 1) % len(rows)][1], len(t) // 3
        edited = t[:len(t) - third] + after[:third]
        assert got[d]["n_chars"] == len(t) and got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[d]["near_next"] <= 1
        if edited == t:
            assert got[d]["near_edited"] == 1 and got[d]["fingerprint"] == got[d]["edited_fingerprint"]
    prints = {}
    for d, t in rows:
        assert prints.setdefault(t, got[d]["fingerprint"]) == got[d]["fingerprint"]
    assert fingerprint.likenesses(empty).count() == 0
    single = fingerprint.likenesses(spark.createDataFrame([(None, "One. Two. Three.")], "doc_id bigint, text string")).first()
    assert single["near_next"] == 1.0


def test_sketches_give_the_difference(docs):
    """What peeling recovers is the symmetric difference of the pieces."""
    versions = fingerprint._versions(docs).select("bucket", "rn", fingerprint.pieces(F.col("text")).alias("a"), fingerprint.pieces(F.col("next_text")).alias("b"), fingerprint.pieces(F.col("edited")).alias("e"))
    want = {}
    for r in versions.collect():
        a, b, e = set(r["a"]), set(r["b"]), set(r["e"])
        want[r["bucket"], r["rn"]] = (len(a ^ e), len(a ^ b))
    rows = fingerprint._peeled(fingerprint._cells(fingerprint._versions(docs), 2), 2).filter("kind < 2 AND whole").collect()
    assert len(rows) > 50
    assert all(want[r["bucket"], r["rn"]][r["kind"]] == r["differ"] for r in rows)


def test_mixing(docs, empty):
    rows = mixing.taken(docs).collect()
    sizes = {d: len(words(t)) for d, t, *_ in documents()}
    source = {d: s for d, _, _, s, *_ in documents()}
    total = {}
    for d, n in sizes.items():
        total[source[d]] = total.get(source[d], 0) + n
    goals = mixing.targets(list(total.items()))
    assert abs(sum(goals.values()) - 1.5 * sum(total.values())) < 1e-6
    for r in rows:
        assert r["size"] == sizes[r["doc_id"]] and r["source_size"] == total[source[r["doc_id"]]]
        assert r["target"] == goals[source[r["doc_id"]]] and r["taken"] <= 2 * r["size"]
    assert sorted(rows) == sorted(mixing.taken(docs).collect())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert {r["doc_id"]: r["copies"] for r in rows if r["copies"]} == {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert mixing.taken(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_mixing_of_repeated_and_missing_ids(spark):
    rnd = random.Random(3)
    text = " ".join("w" for _ in range(10))
    rows = [(None, f"{text} {k}", "a", "x", 1) for k in range(400)] + [(7, text, "b", "x", k % 2) for k in range(9000)] + [(k, text, "c", "x", 1) for k in range(40)]
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, copies string, u int").repartition(5)
    got = mixing.taken(docs).withColumnRenamed("source_size", "source").groupBy("source", "target").agg(F.sum("taken").alias("n"), F.sum("size").alias("size"), F.max(F.col("taken") / F.col("size")).alias("most")).collect()
    of = {4400: "a", 90000: "b", 400: "c"}
    mixed = {r["source"]: r["n"] for r in mixing.sizes(mixing.mix(docs)).groupBy("source").agg(F.sum("size").alias("n")).collect()}
    assert len(got) == 3
    for r in got:
        assert abs(r["n"] - r["target"]) <= 0.02 * r["size"] + 22 and r["most"] <= 2, r
        assert abs(mixed.get(of[r["source"]], 0) - r["target"]) <= 0.1 * r["size"] + 22, (r, mixed)
    assert mixing.mix(docs).columns == docs.columns
    whole = docs.filter("source <> 'b'").union(docs.filter("source = 'b' AND u = 0"))
    counts = lambda df: sorted((r["source"], r["n"]) for r in df.groupBy("source").agg(F.sum("n").alias("n")).collect())
    assert counts(mixing.taken(whole).select("source_size", F.lit("all").alias("source"), F.col("copies").alias("n"))) == counts(mixing.mix(whole).select(F.lit("all").alias("source"), F.lit(1).alias("n")))


def test_targets_stop_at_the_cap():
    assert mixing.targets([("a", 10), ("b", 100), (None, 1000)]) == {"a": 20.0, "b": 200.0, None: 1445.0}
    assert mixing.targets([("a", 0)]) == {"a": 0.0}


def test_ann(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[7].tolist()) for i in range(50)]
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [None] * 8), (2004, [1.0]), (None, [1.0] * 8), (2005, [float("inf")] * 8)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<double>, score int")
    found = ann.search(df, F.col("vec_id") % 20 == 0, candidates=400, share=0.0)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    ok = [(i, np.array(v)) for i, v in rows if i is not None and i < 2000]
    hits = 0
    for i, v in ok:
        if i % 20 == 0:
            best = sorted(((-float(w @ v), j) for j, w in ok if j != i))[:20]
            hits += len({j for _, j in best} & {j for j, _ in got[i]})
            assert got[i] == sorted(got[i], key=lambda p: (-p[1], p[0])) and len(got[i]) == 20
            assert all(abs(s - float(dict(ok)[j] @ v)) < 1e-12 for j, s in got[i])
    assert hits >= 0.9 * 20 * len(got)
    exact = ann.search(df, F.col("vec_id") % 20 == 0, share=1.0).filter("query_id = 20").orderBy("rank").collect()
    v = dict(ok)[20]
    assert [r["vec_id"] for r in exact] == [j for _, j in sorted((-float((w * v).sum()), j) for j, w in ok if j != 20)[:20]]
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in ann.search(few, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 0.5)]
    assert ann.search(few.limit(0), F.lit(True)).count() == 0


def test_line_dedup(spark, empty):
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    lines = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 14))) for _ in range(40)]
    rows = []
    for i in range(40):
        own = []
        for _ in range(rnd.randrange(0, 8)):
            w = rnd.choice(lines).split()
            act, at = rnd.randrange(6), rnd.randrange(len(w))
            if act == 0:
                w[at] = rnd.choice(vocabulary)
            elif act == 1:
                del w[at]
            elif act == 2:
                w.insert(at, rnd.choice(vocabulary))
            own.append(" ".join(w))
        rows.append((rnd.randrange(5, 5000) * 40 + i, "\n".join(own), "k"))
    rows += [(1, None, ""), (2, "", ""), (3, "\n\n", ""), (4, "x " * 2000, "")]
    got = {r["doc_id"]: tuple(r)[1:] for r in linededup.report(spark.createDataFrame(rows, "doc_id bigint, text string, line string")).collect()}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 8:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        short, long = sorted((a, b), key=len)
        return any(long[:k] + long[k + 1:] == short for k in range(len(long)))

    first = {}
    for d, t, _ in sorted(rows):
        for k, line in enumerate((t or "").split("\n") if t is not None else []):
            first.setdefault(tuple(words(line)), (d, k))
    gone = {a for a in first for b in first if first[b] < first[a] and near(a, b)}
    for d, t, _ in rows:
        all_lines = t.split("\n") if t is not None else []
        kept = [x for k, x in enumerate(all_lines) if not words(x) or (first[tuple(words(x))] == (d, k) and tuple(words(x)) not in gone)]
        assert got[d] == (len(all_lines), len(all_lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()), d
    assert linededup.report(empty).count() == 0
    assert linededup.dedup_lines(empty).columns == [*empty.columns, "_removed"]


def test_line_dedup_tells_rows_of_one_id_apart(spark):
    rows = [(1, "one line here"), (5, "one line here\nanother"), (5, "totally different first line\nmore\nand more\none line here"), (5, "x"), (7, "x\nmore"), (7, "x\nmore")]
    for parts in (1, 4):
        df = spark.createDataFrame([(*r, "g", 3, "d", "o") for r in rows], "doc_id bigint, text string, _gone string, _removed int, gone string, text_key string").repartition(parts)
        out = linededup.dedup_lines(df)
        assert out.columns == ["doc_id", "text", "_gone", "gone", "text_key", "_removed"]
        got = sorted((r["doc_id"], r["text"], r["_removed"], r["_gone"], r["gone"], r["text_key"]) for r in out.collect())
        more = "totally different first line\nmore\nand more"
        assert [g[:3] for g in got] == sorted([(1, "one line here", 0), (5, "another", 1), (5, more, 1), (5, "x", 0), (7, "", 2), (7, "", 2)])
        assert all(g[3:] == ("g", "d", "o") for g in got)


def test_language_model(docs, empty, spark):
    rows = {r["doc_id"]: r for r in lm.score(docs).collect()}
    train, counts = 0, {}
    for d, t, *_ in documents():
        if zlib.crc32(str(d).encode()) % 5 != 1:
            for w in [*[x.encode().lower() for x in words(t)], None]:
                counts[w] = counts.get(w, 0) + 1
                train += 1
    for d, t, *_ in documents():
        tokens = [*[x.encode().lower() for x in words(t)], None]
        base = sum(np.log10((counts.get(w, 0) + 0.5) / (train + 0.5 * (len(counts) + 1))) for w in tokens)
        r = rows[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(d).encode()) % 5 == 1, len(tokens), sum(w in counts for w in tokens), train)
        assert abs(r["base_score"] - base) < 1e-6 and r["score"] <= 0
    assert lm.score(empty).count() == 0
    unlabelled = lm.score(spark.createDataFrame([(5, "hello there"), (None, None)], "doc_id bigint, text string")).collect()
    assert all(np.isfinite(r["score"]) for r in unlabelled)


def test_language_model_learns_what_text_it_reads(spark):
    rnd = random.Random(12)
    vocabularies = {"aa": [f"ka{i}" for i in range(60)], "bb": [f"ze{i}" for i in range(60)]}
    rows = [(i, " ".join(rnd.choice(vocabularies[lang]) for _ in range(80)), lang) for i, lang in enumerate(rnd.choice(["aa", "bb"]) for _ in range(120))]
    held = [r for r in lm.score(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect() if r["held_out"]]
    assert len(held) > 10 and all(r["score"] > r["base_score"] for r in held)


def test_language_model_knows_the_order_of_words(spark):
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(4)) for _ in range(50)]
    turns = [vocabulary[rnd.randrange(50):] for _ in range(200)]
    texts = [" ".join((t + vocabulary)[:50]) for t in turns]
    held = [i for i in range(10_000, 11_000) if zlib.crc32(str(i).encode()) % 5 == 1][:10]
    shuffled = vocabulary.copy()
    rnd.shuffle(shuffled)
    rows = list(enumerate(texts)) + [(i, " ".join(vocabulary if k % 2 else shuffled)) for k, i in enumerate(held)]
    got = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert min(got[i] for i in held[1::2]) > max(got[i] for i in held[::2]) + 10


def test_language_model_tables_grow_with_the_contexts(spark):
    rng = np.random.default_rng(7)
    texts = ["".join(map(chr, rng.integers(97, 123, 40_000))) for _ in range(10)]
    df = spark.createDataFrame([(2 * i, t, 0) for i, t in enumerate(texts)], "doc_id bigint, text string, class int")
    pairs = len({t[i - 5:i + 1] for t in texts for i in range(5, len(t))})
    model, _, _ = lm.train(df, 1)
    used = [len(x) for x in model.packed]
    assert used[-1] > lm.SLOTS and used[-1] >= 7 * pairs > 7 * 300_000 and used[0] < lm.SLOTS


def test_long_rows_are_read_in_pieces(monkeypatch):
    rnd = np.random.default_rng(4)
    flat, off = rnd.integers(97, 105, 4000).astype(np.uint8), np.array([0, 3000, 3000, 3010, 4000])
    n = rnd.poisson(3.0, (2, lm.ORDERS, lm.SLOTS)).astype(np.float32)
    model = lm.packed(n[0], n[1], np.full((lm.ORDERS * lm.LEVELS, lm.ORDERS), 0.3))
    whole = model.read(flat, off)
    monkeypatch.setattr(lm, "STRETCH", 64 * lm.STEP)
    assert np.abs(model.read(flat, off) - whole).max() < 1e-4


def test_spelling_is_a_probability():
    n = np.random.default_rng(0).poisson(3.0, (2, lm.ORDERS, lm.SLOTS)).astype(np.float32)
    model = lm.packed(n[0], n[1], np.full((lm.ORDERS * lm.LEVELS, lm.ORDERS), 0.3))
    # of all bytes that can come first, the probabilities add up to one
    flat, off = np.arange(256, dtype=np.uint8), np.arange(257)
    assert abs((10 ** model.spelling(flat, off)).sum() - 1) < 1e-3


def test_spelling_sees_five_bytes_back():
    rows = [b"xabcdy ", b"zabcdw "]
    flat, off = np.frombuffer(b"".join(rows), np.uint8), np.array([0, 7, 14])
    slots = lm.bits(flat, off)[0].reshape(lm.ORDERS, 2, 7, 8)
    assert (slots[:4, 0, 5] == slots[:4, 1, 5])[:, 0].all() and slots[4, 0, 5, 0] != slots[4, 1, 5, 0]


def test_language_id(spark, empty):
    rnd = random.Random(6)
    syllables = {"aa": ["ba", "bo", "lu", "mi"], "bb": ["xer", "qua", "zyt", "vok"], "cc": ["ñé", "ßa", "öü", "êx"]}
    rows = []
    for i in range(300):
        lang = rnd.choice(list(syllables))
        rows.append((i, " ".join("".join(rnd.choice(syllables[lang]) for _ in range(rnd.randrange(1, 4))) for _ in range(20)), lang if i % 7 else None, "s"))
    truth = {i: r[1] for i, r in enumerate(rows)}
    rows += [(1000, None, "aa", "s"), (1001, "", "aa", "s"), (1002, "123 -- !!", "aa", "s"), (1003, "bx " * 20000, None, "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string")
    got = {r["doc_id"]: r for r in langid.predict(df).collect()}
    for i, text in truth.items():
        want = next(k for k, v in syllables.items() if any(s in text for s in v))
        assert got[i]["lang_pred"] == want and 0 <= got[i]["score"] <= 1
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert [got[k]["lang_pred"] for k in (1000, 1001, 1002)] == ["und"] * 3
    assert got[1003]["lang_pred"] in syllables
    assert langid.predict(empty).count() == 0
    assert [r["lang_pred"] for r in langid.predict(spark.createDataFrame([(1, "abc", None)], "doc_id bigint, text string, lang string")).collect()] == ["und"]


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline as cp

    rows = [r for r in documents(9, 80)]
    spark.createDataFrame([r[:5] for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "bpe"]
    df, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, df, str(tmp_path))
        if k < 4:
            assert out.columns == cp.COLUMNS and [f.dataType for f in out.schema] == [f.dataType for f in df.schema]
        out.write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        kept.append({r["doc_id"] for r in df.select("doc_id").collect()})
    assert kept[0] >= kept[1] >= kept[2] >= kept[3] == kept[4] and kept[4]
    assert cp.run(spark, str(tmp_path)).count() == df.count()


def test_pipeline_keeps_rows_without_id(spark):
    import corpus_pipeline as cp

    long = " ".join(f"w{i}" for i in range(30))
    rows = [(None, long), (None, "other words " * 9), (4, long), (9, long), (5, "")]
    df = spark.createDataFrame([(*r, "en", "a", 0) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = cp.dedup_documents(spark, df, "").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted((d or 0, t) for d, t in rows if d != 9)


def test_pipeline_drops_repeats_of_short_lines(spark):
    import corpus_pipeline as cp

    rows = [(1, "Les.\n今日はとても良い天気ですね\n\na b"), (2, "今日はとても良い天気ですね\n\nown line here\nLes.\na b\na c")]
    df = spark.createDataFrame([(*r, "en", "a", 0) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r["doc_id"]: r["text"] for r in cp.dedup_lines(spark, df, "").collect()}
    assert got == {1: rows[0][1], 2: "\nown line here\na c"}


def test_language_id_rejects_junk_despite_a_bad_label(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join("".join(rnd.choice(["ba", "bo", "lu", "mi"]) for _ in range(rnd.randrange(1, 4))) for _ in range(30)), "aa") for i in range(400)]
    rows.append((900, " ".join("".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(9)) for _ in range(30)), "aa"))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(df)
    assert abs(model.accept[0] - langid.train(df.filter("doc_id < 900")).accept[0]) < 0.5
    tried = [(0, rows[3][1]), (1, " ".join("".join(rnd.choice("qxzjkvw") for _ in range(7)) for _ in range(30))), (2, "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(300)))]
    got = {r["doc_id"]: r["accepted"] for r in langid.score(spark.createDataFrame(tried, "doc_id bigint, text string"), model).collect()}
    assert got == {0: True, 1: False, 2: False}


def test_entry_has_every_operator():
    import __spark_entry__ as entry

    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in entry.queries() if k.startswith("op")}
    assert "pipeline" in entry.queries()


_WITHOUT = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name in {hidden!r}:
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as entry
names = set(entry.queries())
assert len(names) > 100 and not [n for n in names if n.startswith("op") or n == "pipeline"], names
"""


@pytest.mark.parametrize("hidden", [["corpus_pipeline"], ["corpus_pipeline", "reelweave.llm"]])
def test_entry_works_without_the_package(hidden):
    import __spark_entry__ as entry

    done = subprocess.run([sys.executable, "-c", _WITHOUT.format(hidden=hidden)], cwd=os.path.dirname(entry.__file__), capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_substring_moves_runs_of_windows(spark):
    rnd = random.Random(3)
    passage = " ".join(f"q{rnd.randrange(10**6)}" for _ in range(300))
    rows = [(1, passage), (2, passage), (3, f"a b {passage} c"), (4, " ".join(passage.split()[40:200]))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("text_key", F.xxhash64("text"))
    got = {r["doc_id"]: sorted((x["at"], x["n"]) for x in r["at"]) for r in substring.covered(df).collect()}
    assert {d: [k for at, n in runs for k in range(at, at + n)] for d, runs in got.items()} == {2: list(range(251)), 3: list(range(2, 253)), 4: list(range(111))}
    assert max(len(runs) for runs in got.values()) < 100  # one row a run, not a window
