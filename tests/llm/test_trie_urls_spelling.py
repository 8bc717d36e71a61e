"""Operators 11 to 13 against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import spelling, trie, urls

CONVERSATIONS = "conv_id long, turn long, role string, text string"
PAGES = "page_id long, url string, html string"


# --- 11 ---------------------------------------------------------------------------------------------------------------------------


def in_order(rows):
    held = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            held[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(ts)] for c, ts in held.items()}


def rebuilt(own):
    def one(c):
        h = zlib.crc32(str(c).encode()) % 4
        return own.get(c - (abs(c) % 20) * (1 if c >= 0 else -1), [])[:h] + own[c][h:]

    return {c: one(c) for c in own}


def brute_trie(sequences):
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        words = len([w for w in "".join(" " if x in "\t\n\v\f\r" else x for x in p[-1][1]).split(" ") if w]) if p else 0
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in children[p])
        digest = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves[p], saved[p], digest))
    return sorted(out, key=repr)


def trie_rows(df):
    return sorted((tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(3)
    rows = []
    for c in range(130):
        n = rng.choice([1, 1, 2, 3, 5, 9])
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["yes", "no", "a b c", "", " \t"])) for t in range(n)]
    rows += [(c, t, "user", f"same {t}") for c in (200, 201, 202, 220) for t in range(25)]  # deep and shared
    rows += [(300, t, "user", f"alone {t}") for t in range(60)]
    rows += [(301, None, None, None), (301, 1, "user", "x"), (301, 1, "user", "x"), (301, 1, "user", "a"), (None, 1, "user", "nobody"), (-23, 0, "user", "below"), (345, 0, "user", "gone")]
    return rows


def test_trie_by_brute_force(spark, talks, monkeypatch):
    monkeypatch.setattr(trie, "PIECE_BYTES", 16)
    given = spark.createDataFrame(talks, CONVERSATIONS).repartition(5)
    own = in_order(talks)
    assert trie_rows(trie.conversation_trie(given, block_turns=7)) == brute_trie(own)
    assert trie_rows(trie.conversation_trie(given.withColumn("depth", F.lit("mine")).withColumn("n", F.lit(1)), rebuild=True)) == brute_trie(rebuilt(own))


def test_trie_of_empty_and_single(spark):
    assert trie.conversation_trie(spark.createDataFrame([], CONVERSATIONS), rebuild=True).count() == 0
    one = [(4, 0, "user", "a b"), (4, 1, "assistant", None)]
    assert trie_rows(trie.conversation_trie(spark.createDataFrame(one, CONVERSATIONS))) == brute_trie(in_order(one))


# --- 12 ---------------------------------------------------------------------------------------------------------------------------


def brute_ranks(seeds, edges, turned):
    """Personalised PageRank by plain iteration; mass without a link goes back to the seeds."""
    if not seeds:
        return {}
    out = defaultdict(dict)
    for (a, b), w in edges.items():
        out[b if turned else a][a if turned else b] = w
    start = {h: v / sum(seeds.values()) for h, v in seeds.items()}
    now = dict(start)
    for _ in range(400):
        after = {h: 0.15 * v for h, v in start.items()}
        lost = 0.0
        for h, v in now.items():
            if out[h]:
                for k, w in out[h].items():
                    after[k] = after.get(k, 0) + 0.85 * v * w / sum(out[h].values())
            else:
                lost += 0.85 * v
        for h, v in start.items():
            after[h] += lost * v
        now = after
    return now


@pytest.fixture(scope="module")
def web():
    rng = random.Random(8)
    hosts = [f"h{k}.example.{t}" for k in range(12) for t in ("com", "org", "net")]
    rows = []
    for k in range(260):
        host = rng.choice(hosts)
        links = "".join(f'<a class="x" href="{rng.choice(["http://", "https://", "//"])}{rng.choice(hosts).upper()}/p?q">t</a>' for _ in range(rng.choice([0, 0, 1, 3])))
        rows.append((k, f"https://{host}/{rng.choice(['en', 'de', 'fr'])}/{k}", f'<html><a href="/here">x</a><a href="mailto:x@y">m</a>{links}</html>'))
    return rows


def test_trust_and_distrust_by_brute_force(spark, web):
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "h1.example.com/"), ("allow", "org/fr/"), ("allow", "h2.example.com/")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(web, PAGES).repartition(4), urls.rule_table(spark, rules), tolerance=1e-9).collect()}
    of, edges = {}, Counter()
    for page_id, url, html in web:
        host, path = url[8:].split("/", 1)[0], "/" + url[8:].split("/", 1)[1]
        fits = [(len(r), v, r) for v, r in rules if ("." + host).endswith("." + r.split("/")[0]) and path.startswith(r[r.index("/") :])]
        of[page_id] = (host, *(max(fits)[1:] if fits else (None, None)))
        for dst in {x.split("/p?q")[0].lower() for x in html.split("//")[1:]}:
            edges[host, dst] += dst != host
    edges = {k: w for k, w in edges.items() if w}
    share = lambda v, h: sum(x[1] == v for x in of.values() if x[0] == h) / sum(x[0] == h for x in of.values())
    hosts = {x[0] for x in of.values()}
    seeds = {v: {h: share(v, h) for h in hosts if share(v, h) >= 0.5} for v in ("allow", "block")}
    trust, distrust = brute_ranks(seeds["allow"], edges, False), brute_ranks(seeds["block"], edges, True)
    n = len(hosts | {b for _, b in edges})
    assert seeds["allow"] and seeds["block"]
    for page_id, (host, verdict, rule) in of.items():
        t, d, r = trust.get(host, 0.0), distrust.get(host, 0.0), got[page_id]
        assert abs(r.trust - t) < 1e-6 and abs(r.distrust - d) < 1e-6
        assert r.rule == rule and r.verdict == (verdict or ("block" if d > t and d * n >= 0.1 else "allow"))
    free = [p for p, x in of.items() if x[1] is None]
    assert {got[p].verdict for p in free} == {"allow", "block"}


def test_urls_of_odd_rows(spark):
    rows = [
        (1, None, None), (2, "no mark", "x"), (3, "HTTP://A.Example.NET:80", None), (4, "x://example.net/en/?a/b", ""), (5, "x://badexample.net#/en/", "<a href=//q.com>"), (6, "://org/fr/é#x", None),
        (6, "://org/fr/é#x", None), (None, "ftp://u@a.b.example.com/de/" + "x" * 50_000, "<a href='//" + "y" * 50_000), (8, "http://" + "." * 3000 + "net/a", None), (9, "http:///path", None), (10, "http://x/a\n/b?c", None),
    ]
    given = spark.createDataFrame(rows, PAGES).withColumns({"host": F.lit("mine"), "rule": F.lit("mine"), "trust": F.lit(1)})
    got = sorted(((r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in urls.judge(given, urls.rule_table(spark, urls.RULES)).collect()), key=repr)
    want = [
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.example.net:80", "", None, "allow"), (4, "example.net", "/en/", "example.net/en/", "allow"), (5, "badexample.net", "", None, "allow"),
        (6, "org", "/fr/é", "org/fr/", "allow"), (6, "org", "/fr/é", "org/fr/", "allow"), (0, "u@a.b.example.com", "/de/" + "x" * 50_000, None, "allow"), (8, "." * 3000 + "net", "/a", "net/", "block"),
        (9, "", "/path", None, "allow"), (10, "x", "/a\n/b", None, "allow"),
    ]
    # `u@a.b.example.com` is a subdomain of example.com by its text
    want = sorted([(*w[:3], "example.com/de/", "block") if w[0] == 0 else w for w in want], key=repr)
    assert got == want
    none = urls.judge(spark.createDataFrame([], PAGES), urls.rule_table(spark, urls.RULES))
    assert none.count() == 0
    bare = urls.judge(spark.createDataFrame(rows, PAGES), urls.rule_table(spark, []))
    assert {(r.rule, r.verdict) for r in bare.collect()} == {(None, "allow")}


# --- 13 ---------------------------------------------------------------------------------------------------------------------------

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def brute_words(rows):
    n = Counter()
    for doc_id, text in rows:
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for run in "".join(x if x in LETTERS else " " for x in low).split(" "):
            if run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(n):
    form, near = {}, {w: [v for v in n if v != w and one_edit(w, v)] for w in n}
    for w in n:
        top = min(near[w], key=lambda v: (-n[v], v), default=None)
        if top and n[top] >= 2 * n[w]:
            form[w] = top
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [4, 20_000])
def test_variants_by_brute_force(spark, limit):
    rng = random.Random(limit)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 8))) for _ in range(120)] + ["abcdefgh" * 3, "É" * 12, "çççççç" * 4, "aaaaa", "aaaaaa", "aaaaaaa"]
    base += [w[:k] + rng.choice("abcÿ") + w[k + rng.randint(0, 1) :] for w in base for k in [rng.randrange(len(w))]]
    rows = [(i, "".join(rng.choice(base) + rng.choice([" ", "\n", "1", "ʼ", "—"]) for _ in range(rng.randint(0, 200)))) for i in range(60)]
    rows += [(None, "words without id " * 4), (7, None), (8, ""), (9, "Abcde ABCDE abcdE abcdf abcdf abcdf"), (9, "Abcde ABCDE abcdE abcdf abcdf abcdf"), (10, "x" * 3000 + " " + "x" * 3001 + " "), (10, ("x" * 3000 + " " + "x" * 3001 + " ") * 4)]
    given = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("mine")).withColumn("n", F.lit("mine")).repartition(3)
    got = sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group_variants(given, limit).collect()), key=repr)
    want = brute_variants(brute_words(rows))
    assert got == want and sum(x[1] is not None for x in want) >= 5


def test_variants_of_nothing(spark, none):
    assert spelling.group_variants(none).count() == 0
    assert spelling.group_variants(spark.createDataFrame([(1, "no word often enough"), (2, None)], "doc_id long, text string")).count() == 0
