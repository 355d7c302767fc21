"""Conversation repair, conversation trie and url filters against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from reelweave.llm import structure, trie, urlfilter

SPACES = " \t\n\x0b\x0c\r"
TURNS = "conv_id bigint, turn bigint, role string, text string, digest string, audit string, position string, key string"


def words(text):
    return [w for w in "".join(" " if c in SPACES else c for c in text).split(" ") if w]


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


# --- conversation repair -----------------------------------------------------

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def cheapest(rows):
    """(cost, audit, repaired) over all edits of (role, text, fault) with at most two inserted turns a gap."""
    best = None
    gaps = [[0, 1, 2]] * (len(rows) + 1)
    for inserts in itertools.product(*gaps):
        for edits in itertools.product("DKR", repeat=len(rows)):
            cost, audit, out, last, ok = 0, "", [], "", True
            for i in range(len(rows) + 1):
                for _ in range(inserts[i]):
                    last = NEXT[last]
                    cost, audit, out = cost + 5, audit + "I", [*out, ({"u": "user", "a": "assistant"}[last], "")]
                if i == len(rows):
                    break
                role, text, fault = rows[i]
                audit += edits[i]
                if edits[i] == "D":
                    cost += 2
                    continue
                if fault in ("blank", "duplicate"):
                    ok = False
                    break
                cost += 5 * (fault == "truncated")
                if edits[i] == "R":
                    last, cost = NEXT[last], cost + 1
                    out.append(({"u": "user", "a": "assistant"}[last], text))
                else:
                    now = role[:1]
                    if not (now == NEXT[last] or (now == "s" and last == "")):
                        ok = False
                        break
                    last = now
                    out.append((role, text))
            if ok and last in ("", "a") and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, out
    return best


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        if not words(text):
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        elif text.rstrip(SPACES)[-1] not in ".!?":
            fault = "truncated"
        else:
            fault = ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def test_search_finds_the_cheapest_audit():
    rnd = random.Random(3)
    for _ in range(60):
        letters = "".join(rnd.choice("suaxsuabcfghSUAX") for _ in range(rnd.randrange(0, 5)))
        rows = []
        for x in letters:
            role, fault = structure._MEANING[x]
            rows.append(({1: "system", 2: "user", 3: "assistant", 4: "tool"}[role], "t", fault))
        assert structure.search(letters) == cheapest(rows)[:2], letters


def test_search_is_linear():
    letters = "suaSUAxbfua" * 3000
    cost, audit = structure.search(letters)
    assert cost == structure.suffix_bounds(letters)[0][structure.START]
    assert len(audit) - audit.count("I") == len(letters)


def conversations():
    rnd = random.Random(11)
    texts = ["Yes.", "no", " \n", "", None, "Well! ", "a\x0b?", "日本。", "q?"]
    rows = []
    for conv in [*range(25), None]:
        for _ in range(rnd.randrange(1, 6)):
            rows.append((conv, rnd.choice([None, 0, 1, 2, 2, 9, -300]), rnd.choice(["user", "assistant", "system", "tool", "", None]), rnd.choice(texts), "d", "a", "p", "k"))
    rows += [(70, 0, "user", "same.", "", "", "", "")] * 2
    rows += [(71, 1 << 62, "user", "x" * 400_000 + ".", "", "", "", ""), (71, -(1 << 62), "assistant", "y.", "", "", "", "")]
    return rows


def test_repair(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, TURNS)
    got = {r["conv_id"]: r for r in structure.digests(df, df).collect()}
    by: dict = {}
    for conv, turn, role, text, *_ in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert set(got) == set(by)
    for conv, some in by.items():
        some.sort(key=lambda t: (t[0] is not None, t[0] or 0, digest(*t[1:])))
        judged = faults([t[1:] for t in some])
        cost, audit, out = cheapest(judged)
        row, at = got[conv], [t[0] for t in some if t[0] is not None]
        assert (row["cost"], row["audit"]) == (cost, audit), some
        assert row["repaired_sha256"] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()
        for name in ("blank", "duplicate", "truncated"):
            assert row[name] == sum(f == name for *_, f in judged)
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(some, some[1:], strict=False)]
        assert row["illegal"] == sum(p not in ("su", "ua", "au") for p in pairs)
        want = max(at) - min(at) + 1 - len(set(at)) if at else 0
        assert row["gaps"] == (want if want < 1 << 63 else 0)
    none = df.limit(0)
    assert structure.digests(none, none).count() == 0
    only = structure.digests(none, df.filter("conv_id = 70")).first()
    assert (only["cost"], only["audit"], only["repaired_sha256"]) == (0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_turns_are_real_rows(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "Hi."), (1, 1, "assistant", "Hello."), (1, 2, "tool", "What?"), (1, 3, "assistant", "cut")], "conv_id bigint, turn bigint, role string, text string")
    audited = structure.audits(df)
    out = structure.repair(df, audited).orderBy("position").collect()
    assert [(r["edit"], r["role"], r["text"]) for r in out] == [("R", "user", "Hi."), ("K", "assistant", "Hello.")]
    assert audited.first()["audit"] == "RKDD"


def test_damage(spark):
    rows = [(c, t, r, x) for c in range(30) for t, r, x in ((0, "assistant", "A. b!"), (1, None, None), (None, "system", "c?"))]
    got = sorted(map(str, (tuple(r) for r in structure.damage(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect())))
    want = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        row = (conv, turn, "user" if kind == 4 else role, {1: "", 2: "".join(c for c in text if c not in ".!?")}.get(kind, text))
        want += [row] * {0: 0, 3: 2}.get(kind, 1)
    assert got == sorted(map(str, want))


# --- trie ---------------------------------------------------------------------

def nodes(sequences):
    """Brute force over {conv_id: [(role, text), ...]}."""
    members: dict = {}
    for conv, seq in sequences.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(conv)
    out = {}
    for node, convs in members.items():
        below = [n for n in members if n[:len(node)] == node]
        leaf = [n for n in below if not any(len(m) == len(n) + 1 and m[:len(n)] == n for m in members)]
        ends = sorted(c for c in convs if len(sequences[c]) == len(node))
        out[min(convs), len(node)] = (
            min(members[node[:-1]]) if node else None, len(convs), sum(len(m) == len(node) + 1 and m[:len(node)] == node for m in members), len(leaf),
            sum((len(members[n]) - 1) * len(words(n[-1][1])) for n in below if n), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
    return out


def _sequences(rows):
    by: dict = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            by.setdefault(conv, []).append((turn, role or "", text or ""))
    return {c: [t[1:] for t in sorted(s, key=lambda t: (t[0] is not None, t[0] or 0, digest(*t[1:])))] for c, s in by.items()}


def _found(df):
    return {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect()}


@pytest.mark.parametrize(("block", "shard"), [(2, 3), (256, 512), (3, 1)])
def test_trie(spark, block, shard):
    rnd = random.Random(7)
    rows, scripts = [], [[("user", rnd.choice(["a b", "c", "d e f"])) for _ in range(9)] for _ in range(4)]
    for conv in range(-5, 40):
        script = rnd.choice(scripts)
        n = rnd.randrange(1, 10)
        seq = [x if rnd.random() < 0.9 else ("assistant", rnd.choice(["z z", "", None])) for x in script[:n]]
        rows += [(conv, rnd.choice([t, t, None]) if conv % 7 == 0 else t, r, x, "", "", "", "") for t, (r, x) in enumerate(seq)]
    rows += [(500 + c, t, "user", "a b", "", "", "", "") for c in range(20) for t in range(5)]
    rows += [(None, 0, "user", "lost", "", "", "", ""), (600, 1, "user", "x", "", "", "", ""), (600, 1, "user", "x", "", "", "", "")]
    df = spark.createDataFrame(rows, TURNS)
    numbered = trie.turns(df)
    ids = df.select("conv_id").filter("conv_id IS NOT NULL").distinct().union(spark.createDataFrame([(900,), (901,)], "conv_id bigint"))
    want = nodes(_sequences(rows) | {900: [], 901: []})
    assert _found(trie.trie(numbered, ids, block, shard)) == want


def test_trie_of_nothing_and_of_turnless(spark):
    none = spark.createDataFrame([], TURNS)
    assert trie.trie(trie.turns(none), none.select("conv_id")).count() == 0
    ids = spark.createDataFrame([(4,), (2,)], "conv_id bigint")
    assert _found(trie.trie(trie.turns(none), ids)) == nodes({4: [], 2: []})


def test_grafted(spark):
    rows = [(c, t, "user", f"{c}.{t}", "", "", "", "") for c in [*range(0, 25), 41, 45, -3, -21] for t in range(1 + abs(c) % 5)]
    own = _sequences(rows)
    want = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c >= 0 else -1)
        want[c] = own.get(base, [])[:h] + own[c][h:]
    got, ids = trie.grafted(spark.createDataFrame(rows, TURNS))
    assert _found(trie.trie(got, ids)) == nodes(want)


# --- url filters ---------------------------------------------------------------

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
         ("a.example.org", "/es/", "allow"), ("org", "/es/x/long/path", "block"), ("Com", "", "block"), ("com", "", "allow"), (None, "/", "block"), ("x", None, "block")]
URLS = [None, "", "example.org/es/", "http://", "http://EXAMPLE.org/es/1", "http://a.example.org/es/x/long/path/1", "https://b.a.example.org/es/", "ftp://org/", "http://org", "http://org?x/",
        "http://notexample.org/es/", "http://example.org/en/12#a", "http://example.org/en/2", "x://com/fr/#", "x://www.com/de/?q", "x://.com/de/", "x://com./de/", "y://x://com/fr/", "http://é.com/fr/é", "http://a.com/" + "p/" * 5000]


def judged(url, rules):
    rest = url.partition("://")[2] if url and "://" in url else ""
    cut = min([i for i in (rest.find("/"), rest.find("?"), rest.find("#")) if i >= 0], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([i for i in (path.find("?"), path.find("#")) if i >= 0], default=len(path))]
    best = None
    for h, p, v in rules:
        if h is None or p is None:
            continue
        h = h.lower()
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best, (len(h + p), len(h), h + p, v)) if best else (len(h + p), len(h), h + p, v)
    return host, path, best[2] if best else None, best[3] if best else "allow"


def test_url_rules(spark):
    rnd = random.Random(5)
    urls = URLS + [f"http://{'.'.join(rnd.choice('ab') for _ in range(rnd.randrange(1, 4)))}.com/{'/'.join(rnd.choice('xyz') for _ in range(rnd.randrange(0, 4)))}" for _ in range(300)]
    urls += ["http://hot.com/de/"] * 200
    rules = RULES + [(f"{rnd.choice('ab')}.com", "/" + "/".join(rnd.choice("xyz") for _ in range(rnd.randrange(0, 3))), rnd.choice(["allow", "block"])) for _ in range(40)]
    pages = spark.createDataFrame([(i if i % 9 else None, u, "h", "old", "k") for i, u in enumerate(urls)], "page_id bigint, url string, html string, verdict string, key string")
    rule_df = spark.createDataFrame(rules, "host string, path string, verdict string")
    want = sorted(str((i if i % 9 else None, "k", *judged(u, rules))) for i, u in enumerate(urls))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    for coalesce in ("true", "false"):  # one range, and several
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
        out = urlfilter.judge(pages, rule_df, keep=["page_id", "key", "verdict"])
        assert out.columns == ["page_id", "key", "host", "path", "rule", "verdict"]
        assert sorted(str(tuple(r)) for r in out.collect()) == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert urlfilter.judge(pages.limit(0), rule_df).count() == 0
    plain = urlfilter.judge(pages, rule_df.limit(0), default="block").filter(F.col("rule").isNull() & (F.col("verdict") == "block"))
    assert plain.count() == len(urls)
