"""Each operator against a brute-force version, and over rows of every awkward kind."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from palimpsest.llm import chat, decontaminate, mixing, pii, quality, secrets, sharding, simhash, suffix_dedup, toxicity

from .conftest import DOCS, words


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def variants(request, odd, none, clashing):
    return {"odd": odd, "none": none, "clashing": clashing}[request]


# --- 1 ----------------------------------------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"
COUNT = len  # one token to a character: budgets are easy to follow


def test_escaping_is_reversible():
    for text in ("", "\\", "\\\\<", "</turn>\n<turn role=\"x\">", 'a"b', "\\### Assistant: </turn> ok", "<\\turn", "é\n" * 3):
        for role in ("assistant", 'odd "role"\\'):
            assert chat.parse("".join(chat.render(role, text)) * 2) == [(role, text)] * 2


def test_chat_windows(spark):
    rows = [(1, k, r, f"{r} {k} " + "x" * 30) for k, r in enumerate(["system"] + ["user", "assistant"] * 20)]
    rows += [(2, None, None, None), (2, 1, "assistant", "y" * 5000), (2, 1, "assistant", "y" * 5000), (None, 0, "user", "</turn>"), (None, 1, "assistant", "\\</turn>")]
    made = chat.format_windows(spark.createDataFrame(rows, TURNS).repartition(4), budget=400, history=120, count=COUNT)
    got = made.collect()
    for w in got:
        turns = chat.parse(w.formatted)
        assert w.tokens <= 400 or len(turns) - w.context_turns == 1
        assert w.tokens == len(w.formatted)
        if w.conv_id == 1 and w.span:
            assert turns[0][0] == "system" and len(turns) > w.context_turns
    assert sum(w.conv_id == 1 and w.context_turns > 1 for w in got) > 3  # history is repeated
    out = {r.conv_id: r for r in chat.digests(made).collect()}
    for conv in (1, 2, None):
        own = sorted(((-1 if t is None else t), r or "", x or "") for c, t, r, x in rows if c == conv)
        said = [x for _, r, x in own if r == "assistant"]
        r = out[conv]
        assert r.n_turns == len(own) and r.turns_sha256 == sha("".join(f"{a}\n{b}\n" for _, a, b in own))
        assert r.loss_chars == len("".join(said)) and r.loss_sha256 == sha("".join(said))


def brute_windows(turns, budget, history):
    """(first, last target, repeated turns) of each window of a conversation of (role, text), by the definition."""
    size = [len("".join(chat.render(*t))) for t in turns]
    begin = [sum(size[:i]) for i in range(len(turns))]
    first_system = next((i for i, (r, _) in enumerate(turns) if r == "system"), None)
    held = 0 if first_system is None else size[first_system]
    stride = max(budget - history - held, budget // 4, 1)
    out, own = [], []
    for i in range(len(turns)):
        used = (held if first_system is not None and own and first_system < own[0] else 0) + sum(size[j] for j in own)
        if own and (begin[i] // stride != begin[own[0]] // stride or used + size[i] > budget):
            out.append(own)
            own = []
        own.append(i)
    out += [own] if own else []
    told = []
    for own in out:
        used = sum(size[j] for j in own) + (held if first_system is not None and first_system < own[0] else 0)
        room = min(history, budget - used)
        told.append((own[0], own[-1], [j for j in range(own[0]) if j != first_system and begin[own[0]] - begin[j] <= room]))
    return told


def test_chat_windows_by_brute_force(spark):
    """No edge but the spans': blocks of turn numbers change nothing, and each window repeats what the definition says."""
    rng = random.Random(14)
    convs = {c: [("system", "s" * 30)] * (c % 2) + [(rng.choice(["user", "assistant"]), "x" * rng.choice([3, 40, 90, 300, 900])) for _ in range(rng.randint(1, 120))] for c in range(12)}
    convs[99] = [("user", "late")] * 3 + [("system", "rules")] + [("assistant", "y" * 50)] * 30
    rows = [(c, k, r, f"{k} {t}") for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    for block_turns in (7, 4096):
        made = chat.format_windows(spark.createDataFrame(rows, TURNS).repartition(4), budget=600, history=150, count=COUNT, block_turns=block_turns)
        got = {}
        for w in sorted(made.collect(), key=lambda w: (w.conv_id, w.span, w.window_no)):
            turns = chat.parse(w.formatted)
            number = [int(t.split(" ")[0]) for _, t in turns]
            context = number[: w.context_turns]
            first_system = next((i for i, (r, _) in enumerate(convs[w.conv_id]) if r == "system"), None)
            if first_system is not None and first_system < number[w.context_turns]:
                assert context[0] == first_system
                context = context[1:]
            got.setdefault(w.conv_id, []).append((number[w.context_turns], number[-1], context))
        assert got == {c: brute_windows([(r, f"{k} {t}") for k, (r, t) in enumerate(turns)], 600, 150) for c, turns in convs.items()}


def test_chat_of_odd_tables(spark):
    assert chat.format_windows(spark.createDataFrame([], TURNS), count=COUNT).count() == 0
    rows = [(1, 0, "system", "a"), (1, 1, "assistant", "b"), (None, None, None, None)]
    plain = spark.createDataFrame(rows, TURNS)
    clashing = plain.withColumns({n: F.lit("mine") for n in ("span", "window_no", "tokens", "begin", "stride", "is_system", "part", "formatted", "block")})
    tell = lambda df: sorted(map(str, chat.digests(chat.format_windows(df, count=COUNT)).collect()))
    assert tell(clashing) == tell(plain)


def test_tokens_of_long_texts_are_counted_whole():
    count = chat.bpe_counter()
    count("")
    own = chat._loaded[next(iter(chat._loaded))]
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice(["a", "b1", " ", "\n", "!", " " * rng.randint(490, 600), "\n" * 505 + " "]) for _ in range(rng.randint(1, 12)))
        assert count(text) == len(own.encode_ordinary(text))
    assert count(" " * 1_000_000) > 0 and count("ab " * 20_000) == len(own.encode_ordinary("ab " * 20_000))


# --- 2 ----------------------------------------------------------------------------------------------------------------------------


def brute_base_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_base_counts_by_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab \n#é\t|<") for _ in range(rng.randint(0, 60)))
        assert quality.base_counts(text.encode()) == brute_base_counts(text)


def brute_kn(texts):
    """Probabilities of modified Kneser-Ney by its formulas, over dictionaries, for each order."""
    pad = (quality.BEFORE,) * 4
    counts = {5: Counter(t[i : i + 5] for x in texts for t in [pad + tuple(map(ord, x))] for i in range(len(t) - 4))}
    for n in (4, 3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    p, back = {0: {(): 1 / (len(counts[1]) + 1)}}, {}
    for n in (1, 2, 3, 4, 5):
        c = counts[n]
        of = Counter(c.values())
        if all(of[k] for k in (1, 2, 3, 4)):
            y = of[1] / (of[1] + 2 * of[2])
            d = [min(max(k - (k + 1) * y * of[k + 1] / of[k], 0), k) for k in (1, 2, 3)]
        else:
            d = [0.5] * 3
        cut = {g: min(d[min(x, 3) - 1], x) for g, x in c.items()}
        total, held = Counter(), Counter()
        for g, x in c.items():
            total[g[:-1]] += x
            held[g[:-1]] += cut[g]
        back[n] = {g: held[g] / total[g] for g in total}
        p[n] = {g: (x - cut[g]) / total[g[:-1]] + back[n][g[:-1]] * p[n - 1][g[1:]] for g, x in c.items()}
    return counts[5], p, back


def brute_p(p, back, gram):
    if gram in p[len(gram)]:
        return p[len(gram)][gram]
    return back[len(gram)].get(gram[:-1], 1.0) * brute_p(p, back, gram[1:]) if gram else p[0][()]


def as_arrays(grams):
    c = np.array(grams, dtype=np.int64).reshape(-1, 5)
    return c[:, 0] << 21 | c[:, 1], (c[:, 2] << 21 | c[:, 3]) << 21 | c[:, 4]


@pytest.mark.parametrize("kinds", [7131, 12])
def test_grams_are_counted_whole(spark, monkeypatch, kinds):
    """Runs, long texts and too many kinds of characters cut no n-gram."""
    monkeypatch.setattr(quality, "MOST_KINDS", kinds)
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab\0 é\U0001f600" + "".join(map(chr, range(100, 130)))) for _ in range(n)) for n in (0, 1, 3, 4, 5, 60, 300, 1200)]
    texts[3] = texts[4][:4]
    size, expected = 50, brute_kn(texts)[0]
    batch = pa.RecordBatch.from_arrays([pa.array(texts + [None])], names=["text"])
    seen = []

    class Given:  # runs the task's function here, where the constant is set
        def select(self, _):
            return self

        def mapInArrow(self, run, _):
            seen.extend(run(iter([batch])))
            return spark.range(0).selectExpr("id hi", "id lo", "id n")

    quality.count_grams(Given(), size)
    got = Counter()
    for b in seen:
        for hi, lo, n in zip(*(c.to_pylist() for c in b.columns)):
            got[hi, lo] += n
    keys = list(expected)
    assert got == {(int(h), int(x)): expected[k] for k, h, x in zip(keys, *as_arrays(keys))}


def test_kneser_ney_by_brute_force(spark):
    rng = random.Random(3)
    texts = [words(rng, 150) + rng.choice(["", " é", " \U0001f600ß"]) for _ in range(20)]
    model = quality.fit(quality.count_grams(spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)))
    counts, p, back = brute_kn(texts)
    levels, keys = quality.sorted_arrays(model), sorted(counts)
    assert model.characters == len(p[1])
    unseen = [tuple(rng.choice([*map(ord, "abé ~"), quality.BEFORE]) for _ in range(5)) for _ in range(200)]
    context = keys[len(keys) // 2][:4]
    every = [(*context, *g) for g in p[1]]
    for asked in (keys, unseen, every):
        expected = [brute_p(p, back, g) for g in asked]
        hi, lo = as_arrays(asked)
        assert np.allclose(np.exp(quality.log_probabilities(levels, model.characters, hi, lo)), expected, rtol=1e-4)
        table = spark.createDataFrame([(k, int(a), int(b)) for k, (a, b) in enumerate(zip(hi, lo))], "k long, hi long, lo long")
        joined = sorted(quality.joined_log_probabilities(model, table, closed=False).select("k", "log_p").collect())
        assert np.allclose(np.exp([r.log_p for r in joined]), expected, rtol=1e-6)
    # the probabilities after a context add up to one: those of the seen characters, and of one that was never seen
    assert sum(brute_p(p, back, g) for g in [*every, (*context, 1)]) == pytest.approx(1.0, abs=1e-9)


def test_quality_verdicts_by_brute_force(spark):
    """Perplexities, bands and verdicts from the formulas; the same whether the model goes to the tasks or stays where it is."""
    rng = random.Random(6)
    rows = [(i, words(rng, rng.randint(40, 120), "aeioulmnrst"), "en" if i % 3 else "fr", "s", 0) for i in range(180)]
    rows += [(500 + k, " ".join("".join(rng.choice("#$%&zqxjkvwy0") for _ in range(9)) for _ in range(60)), "fr", "s", 0) for k in range(3)]
    rows += [(600, None, "en", "s", 0), (601, "", None, "s", 0), (602, "é", None, "s", 0), (603, " \n", "en", "s", 0), (3, rows[3][1], "en", "s", 0)]
    texts = [r[1] or "" for r in rows]
    counts, p, back = brute_kn(texts)
    pad, expected = (quality.BEFORE,) * 4, []
    for i, t, lang, _, _ in rows:
        x = pad + tuple(map(ord, t or ""))
        n, _, _, _, repeated = quality.base_counts((t or "").encode())
        log = -sum(math.log(p[5][x[k : k + 5]]) for k in range(len(x) - 4)) / n if n else None
        expected.append((i, lang, n < 50 or 100 * repeated > 50 * n, log))
    verdicts = []
    for _, lang, failed, log in expected:
        own = sorted(math.floor(math.log(x) * 10_000) for _, of, f, x in expected if of == lang and not f and x is not None)
        if failed or log is None:
            verdicts.append(False)
            continue
        q1, q3 = (math.exp(own[math.ceil(len(own) * q) - 1] / 10_000) for q in (0.25, 0.75))
        width = max(q3 - q1, 0.02) * 2.5
        verdicts.append(q1 - width <= log <= q3 + width)
    assert 0 < sum(verdicts) < len(verdicts) and not any(v for v, r in zip(verdicts, rows) if 500 <= r[0] < 600)
    for params in (quality.Params(least_documents=1), quality.Params(least_documents=1, array_entries=0, segment_chars=9000)):
        got = quality.judge(spark.createDataFrame(rows, DOCS).repartition(3), params).collect()
        assert sorted((r.doc_id, r.kept) for r in got) == sorted((e[0], v) for e, v in zip(expected, verdicts))
        logs = {r.doc_id: r.log_perplexity for r in got}
        assert all(logs[i] == (None if x is None else pytest.approx(x, rel=1e-5)) for i, _, _, x in expected)


def test_quality_keeps_prose_and_drops_noise(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, 100, "aeioulmnrst"), "en", "s", 0) for i in range(120)]
    rows += [(500, "#$%& ||| <<>> *** " * 5 + " ".join("".join(rng.choice("#$%&|<>*") for _ in range(9)) for _ in range(60)), "en", "s", 0), (501, "zqxj " * 80, "en", "s", 0)]
    # run-together words that all end in the same marks: each character is easily foreseen, the words are not
    marked = [words(rng, 200, "aeioulmnrst").split() for _ in range(8)]
    rows += [(600 + i, " ".join(a + b + "***" for a, b in zip(w[::2], w[1::2])), "en", "s", 0) for i, w in enumerate(marked)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert not any(got[600 + i].kept or got[600 + i].base_failed for i in range(8))
    assert all(got[i].kept for i in range(120)) and not got[500].kept and not got[500].base_failed and got[501].base_failed


@pytest.mark.parametrize("which", ["odd", "none", "clashing"])
def test_quality_of_odd_rows(which, odd, none, clashing):
    df = variants(which, odd, none, clashing)
    measured = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.log_perplexity is None) for r in quality.judge(df).where("kept or base_failed").collect()]
    expected = []
    for r in df.collect():
        n, *others, repeated = counts = brute_base_counts(r.text or "")
        expected.append((r.doc_id, *counts, n < 50 or 100 * repeated > 50 * n, n == 0))
    assert Counter(measured) == Counter(expected)  # so few documents of one kind that pass the base rules are all kept


# --- 3 ----------------------------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(fps, ids):
    root = list(range(len(fps)))
    for _ in fps:
        for i in range(len(fps)):
            for j in range(len(fps)):
                if (fps[i] ^ fps[j]).bit_count() <= 2:
                    root[i] = root[j] = min(root[i], root[j])
    return [min((ids[j] for j in range(len(fps)) if root[j] == r and ids[j] is not None), default=None) for r in root]


@pytest.mark.parametrize("which", ["odd", "none", "clashing"])
def test_simhash_of_odd_rows(which, odd, none, clashing, odd_rows):
    df = variants(which, odd, none, clashing)
    got = Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(df).collect())
    rows = odd_rows if which != "none" else []
    fps, ids = [brute_fingerprint(r[1]) for r in rows], [r[0] for r in rows]
    assert got == Counter(zip(ids, fps, brute_components(fps, ids)))
    kept = simhash.keep_one_of_each(df)
    assert kept.columns == df.columns and kept.count() == len(set(brute_components(fps, ids)))


def named(odd):
    """The odd table with strings for ids, which sort as the numbers do; null stays null."""
    return odd.withColumn("doc_id", F.when(F.col("doc_id").isNotNull(), F.format_string("d%02d", "doc_id")))


def test_simhash_with_string_ids(odd, odd_rows):
    got = Counter((r.doc_id, r.component_id) for r in simhash.near_duplicates(named(odd)).collect())
    fps, ids = [brute_fingerprint(r[1]) for r in odd_rows], [None if r[0] is None else f"d{r[0]:02}" for r in odd_rows]
    assert got == Counter(zip(ids, brute_components(fps, ids)))
    assert simhash.keep_one_of_each(named(odd)).count() == len(set(brute_components(fps, ids)))


@pytest.mark.parametrize("segments", [1, 7])
def test_links_by_brute_force(spark, segments):
    rng = random.Random(segments)
    centres = [rng.getrandbits(64) for _ in range(40)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for c in centres for _ in range(12)} | {rng.getrandbits(64) for _ in range(200)} | {0, (1 << 64) - 1}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = simhash.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3), segment_rows=len(fps), least_segments=segments))
    root = {r.node: r.root for r in found.collect()}
    label = list(range(len(fps)))
    for _ in range(30):
        for i, f in enumerate(fps):
            near = [j for j, g in enumerate(fps) if (f ^ g).bit_count() <= 2]
            low = min(label[j] for j in near)
            for j in near:
                label[j] = low
    groups = lambda of: sorted(sorted(i for i in range(len(fps)) if of(i) == k) for k in {of(i) for i in range(len(fps))})
    assert groups(lambda i: root.get(signed[i], signed[i])) == groups(lambda i: label[i])


# --- 4 ----------------------------------------------------------------------------------------------------------------------------


def brute_removal(texts, length):
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


def test_suffix_dedup_by_brute_force(spark):
    rng = random.Random(8)
    parts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(50, 900))) for _ in range(12)]
    texts = ["".join(rng.choice(parts) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(1, 300))) for _ in range(rng.randint(1, 8))) for _ in range(60)]
    texts += ["a" * 2000, "ab" * 700, "a" * 399, "b" * 400, "b" * 401, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.deduplicate(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removal([t.encode() for t in texts], 400)


@pytest.mark.parametrize("which", ["odd", "none", "clashing"])
def test_suffix_dedup_of_odd_rows(which, odd, none, clashing, odd_rows):
    rows = odd_rows if which != "none" else []
    got = Counter(tuple(r) for r in suffix_dedup.deduplicate(variants(which, odd, none, clashing)).collect())
    assert got == Counter((r[0], *x) for r, x in zip(rows, brute_removal([(r[1] or "").encode() for r in rows], 400)))


@pytest.mark.parametrize("ids", ["strings", "none"])
def test_suffix_dedup_with_other_ids(ids, odd, odd_rows):
    df = named(odd) if ids == "strings" else odd.withColumn("doc_id", F.lit(None).cast("long"))
    got = Counter(tuple(r) for r in suffix_dedup.deduplicate(df).collect())
    keys = [f"d{r[0]:02}" if ids == "strings" and r[0] is not None else None for r in odd_rows]
    assert got == Counter((k, *x) for k, x in zip(keys, brute_removal([(r[1] or "").encode() for r in odd_rows], 400)))


# --- 5 ----------------------------------------------------------------------------------------------------------------------------


def test_decontamination_recall_against_brute_force(spark):
    rng = random.Random(11)
    letters = "abcdefghijklmné"
    items = [words(rng, rng.randint(15, 50), letters) for _ in range(60)]
    rows, planted = [], set()
    for k in range(240):
        text = words(rng, rng.randint(20, 200), letters).split()
        if k % 2:
            item = items[k % 60].split()
            for _ in range(rng.randint(0, int(len(item) * 0.15))):
                at = rng.randrange(len(item))
                rng.choice([lambda: item.pop(at), lambda: item.insert(at, "zzz"), lambda: item.__setitem__(at, "yyy")])()
            where = rng.randint(0, len(text))
            text[where:where] = [w.upper() + "," for w in item]
            planted.add((k, k % 60))
        rows.append((k, " ".join(text), "en", "s", 0))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(rows, DOCS), bench).collect()}
    assert got <= planted and len(got) >= 0.98 * len(planted)
    assert decontaminate.remove_contaminated(spark.createDataFrame(rows, DOCS), bench, decontaminate.Params(block_items=25)).count() == 240 - len({d for d, _ in got})


def edited(rng, item, share, rare):
    """The item's words with a share of them edited, the longest ones if rare: by replacement, removal and insertion."""
    item, most = list(item), int(len(item) * share)
    order = sorted(range(len(item)), key=lambda o: -len(item[o])) if rare else rng.sample(range(len(item)), len(item))
    for o in sorted(order[:most], reverse=True):
        rng.choice([lambda: item.pop(o), lambda: item.insert(o, "zzz"), lambda: item.__setitem__(o, item[o] + "x"), lambda: item.__setitem__(o, "yyy")])()
    return item


@pytest.mark.parametrize("rare", [False, True])
@pytest.mark.parametrize("share", [0.05, 0.1, 0.15, 0.2])
def test_decontamination_recall_by_share_of_edits(share, rare):
    rng = random.Random(12)
    items = [words(rng, rng.randint(5, 50), "abcdefghijklmn").split() for _ in range(400)]
    index = decontaminate.ItemIndex([(k, " ".join(x).encode()) for k, x in enumerate(items)], decontaminate.Params())
    found = 0
    for k, item in enumerate(items):
        text = [words(rng, rng.randint(0, 30), "pqrstuv"), *edited(rng, item, share, rare), words(rng, rng.randint(0, 30), "pqrstuv")]
        found += k in {m[0] for m in index.matches(" ".join(text).encode())}
    assert found >= 0.97 * len(items)


def test_decontamination_by_exhaustive_search(spark):
    """All windows of all lengths within the limit, for every item and document."""
    rng = random.Random(17)
    items = [words(rng, rng.randint(5, 14), "abcd") for _ in range(25)]
    rows = []
    for k in range(60):
        text = words(rng, 25, "abcd").split()
        where = rng.randint(0, 25)
        text[where:where] = edited(rng, items[k % 25].split(), rng.choice([0, 0.1, 0.2, 0.3]), k % 2)
        rows.append((k, " ".join(text), "en", "s", 0))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.contaminated(spark.createDataFrame(rows, DOCS).repartition(3), bench).collect()}
    expected = {}
    for d, text, *_ in rows:
        for i, item in enumerate(items):
            a, b = item.encode().split(), text.encode().split()
            e = decontaminate.edits(a, b, 99)  # against every part of the document
            if e <= len(a) // 5:
                expected[d, i] = e
    assert got.keys() <= expected.keys() and len(got) >= 0.95 * len(expected) and all(got[x] >= expected[x] for x in got)
    named = bench.selectExpr("cast(item_id as string) as item_id", "text")
    again = decontaminate.contaminated(spark.createDataFrame(rows, DOCS), named, decontaminate.Params(block_bytes=200)).collect()
    assert {(r.doc_id, int(r.item_id)) for r in again} == got.keys()


def test_edit_distance_by_brute_force():
    rng = random.Random(2)

    def whole(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(150):
        a, b = ([rng.choice([b"p", b"q", b"r"]) for _ in range(rng.randint(1, n))] for n in (7, 10))
        best = min(whole(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))
        assert decontaminate.edits(a, b, 99) == best


@pytest.mark.parametrize("which", ["odd", "none", "clashing"])
def test_decontamination_of_odd_rows(which, odd, none, clashing, spark, odd_rows):
    df = variants(which, odd, none, clashing)
    bench = spark.createDataFrame([(1, odd_rows[0][1]), (1, odd_rows[0][1]), (2, None), (3, ""), (4, "two words"), (None, "x y z u v")], "item_id long, text string")
    kept = decontaminate.remove_contaminated(df, bench)
    # three copies of the base text, one more with a word added and one on lines
    assert kept.columns == df.columns and df.count() - kept.count() == (0 if which == "none" else 5)
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0


# --- 6 ----------------------------------------------------------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def accepted(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in twice) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def brute_pii(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if accepted(k, m[0])]


TRICKY = [
    "a@b.c@d.e a@b.c_d@e.f x@y.z.", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.255 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111", "+1 (974) 555-3436 +12 +49 30 1234567890123456 ++4912345678", "é@x.y mé.a@b-c.d-e",
    "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8", "@".join("ab" * 5), "a" * 3000 + "@", "1." * 2000, "+" + "1 " * 2000, "1" * 5000, "call +4930123456. mail x@y.de, ip 10.0.0.1!",
]


def test_pii_base_by_brute_force(spark):
    rng = random.Random(6)
    texts = TRICKY + ["".join(rng.choice("ab1+@. -()9é\n") for _ in range(rng.randint(0, 80))) for _ in range(400)] + ["a@b" + ".c" * 20_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_personal_data(df).collect()}
    for i, t in enumerate(texts):
        base = brute_pii(t)
        assert got[i].base_sha256 == sha(",".join(base)), t[:80]
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(b.startswith(k) for b in base) for k in BASE)
        assert set(base) <= set(got[i].spans.split(",")) or not base


def some_card(rng, n=16, good=True):
    while True:
        d = "4" + "".join(rng.choice("0123456789") for _ in range(n - 1))
        twice = [int(x) * (1 + i % 2) for i, x in enumerate(reversed(d))]
        if (sum(x - 9 * (x > 9) for x in twice) % 10 == 0) == good:
            return d


def test_pii_finds_dressed_spans_and_leaves_decoys(spark):
    """Precision and recall of the added spans; what is planted is not written in the base formats."""
    rng = random.Random(9)
    rows, truth = [], set()
    local = lambda: f"({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}"
    quad = lambda low, high, dot: dot.join(str(rng.randint(low, high)) for _ in range(4))

    def put(doc_id, span, kind=None):
        before = words(rng, 6) + " "
        rows.append((doc_id, before + span + " " + words(rng, 6)))
        if kind:
            truth.add((doc_id, f"{kind}:{len(before)}:{len(before) + len(span)}"))

    for i in range(300):
        for k, span in enumerate((f"jo.{i}@host{i % 7}.org", quad(0, 255, "."), some_card(rng), "+1 " + local())):
            put(4 * i + k, span)
    for i in range(40):
        kinds = ["email", "email", "ip", "ip", "card", "card", "phone", "phone"]
        spans = [f"al.{i}[at]post.org", f"bo{i}(at)post(dot)org", quad(0, 255, "[.]"), ":".join(f"{rng.randint(0, 65535):x}" for _ in range(8)), ".".join(re.findall("....", some_card(rng))), some_card(rng, 15), "001 " + local(), local()]
        for k, (kind, span) in enumerate(zip(kinds, spans)):
            put(10_000 + 100 * i + k, span, kind)
        for k, span in enumerate([some_card(rng, 16, False), quad(256, 999, "."), str(rng.randint(10**9, 10**10)), some_card(rng, 14, False), "v1.2.3", f"2024-{rng.randint(10, 12)}-{rng.randint(10, 28)}"]):
            put(10_000 + 100 * i + 50 + k, span)
    got = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert all(r.n_added == 0 for r in got if r.doc_id < 10_000)
    added = {(r.doc_id, x) for r in got if r.doc_id >= 10_000 and r.spans for x in r.spans.split(",")}
    assert len(added & truth) >= 0.95 * len(truth) and len(added & truth) >= 0.95 * len(added)


@pytest.mark.parametrize("which", ["odd", "none", "clashing"])
def test_pii_of_odd_rows(which, odd, none, clashing):
    df = variants(which, odd, none, clashing)
    got = Counter((r.doc_id, r.base_sha256, r.spans) for r in pii.find_personal_data(df).collect())
    assert got == Counter((r.doc_id, sha(",".join(brute_pii(r.text))), ",".join(brute_pii(r.text))) for r in df.collect())


# --- 7 ----------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("which", ["odd", "none", "clashing"])
def test_shards_of_odd_rows(which, odd, none, clashing):
    df = variants(which, odd, none, clashing)
    got = sharding.slots(sharding.kd_shards(df, shards=4), ["doc_id"]).select("doc_id", "text", "shard", "slot").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r.doc_id, r.text) for r in df.collect())
    for s in {r.shard for r in got}:
        assert 0 <= s < 4 and sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_shards_are_even_boxes(spark):
    rng = random.Random(12)
    rows = [(i, "x" * rng.randint(1, 400), rng.choice(["en", "de"]), f"src{min(rng.randint(0, 9), 5)}", 0) for i in range(4000)] + [(i, "copy" * 20, "en", "src0", 0) for i in range(4000, 6000)]
    placed = sharding.kd_shards(spark.createDataFrame(rows, DOCS).repartition(4), shards=24)
    sizes = [r.b for r in placed.groupBy("shard").agg(F.sum(sharding.text_size()).alias("b")).collect()]
    assert len(sizes) == 24 and max(sizes) - min(sizes) < 1000
    again = sharding.kd_shards(spark.createDataFrame(rows, DOCS).repartition(7), shards=24)
    assert sorted(map(tuple, placed.select("doc_id", "shard").collect())) == sorted(map(tuple, again.select("doc_id", "shard").collect()))
    by_target = sharding.kd_shards(spark.createDataFrame(rows, DOCS), target_bytes=sum(sizes) // 5 + 1)
    assert by_target.select("shard").distinct().count() == 5


def brute_root(rows):
    """Sizes, coordinates scaled to [0, 1] and the widest dimension of rows (doc_id, text, lang), by the definition."""
    import zlib

    size = [len(t.encode()) + 8 for _, t, _ in rows]
    dims = [[np.log2(x) for x in size], [float(zlib.crc32((g or "").encode())) for _, _, g in rows], [len(t) / max(len(t.encode()), 1) for _, t, _ in rows]]
    at = [[(x - min(d)) / max(max(d) - min(d), 1e-12) for x in d] for d in dims]
    mean = [np.average(a, weights=size) for a in at]
    spread = [np.average(np.square(a), weights=size) - m**2 for a, m in zip(at, mean)]
    return size, at, max(range(3), key=lambda d: (round(spread[d], 9), -d))


def test_root_cut_by_brute_force(spark):
    """The first cut lies where the sorted coordinates reach half of the bytes, and on the widest dimension."""
    rng = random.Random(3)
    rows = [(i, "y" * rng.randint(1, 3000), rng.choice(["en", "de", "fr"])) for i in range(800)]
    df = spark.createDataFrame([(i, t, g, "s", 0) for i, t, g in rows], DOCS).repartition(3)
    size, at, dim = brute_root(rows)
    shard = {r.doc_id: r.shard for r in sharding.kd_shards(df, shards=2).select("doc_id", "shard").collect()}
    left = [at[dim][i] for i, *_ in rows if shard[i] == 0]
    right = [at[dim][i] for i, *_ in rows if shard[i] == 1]
    assert max(left) <= min(right) + 2**-20
    assert abs(sum(size[i] for i, *_ in rows if shard[i] == 0) - sum(size) / 2) <= max(0.02 * sum(size) / 2, max(size))


def test_equal_texts_share_a_shard(spark):
    rng = random.Random(5)
    texts = [words(rng, rng.randint(5, 200)) for _ in range(900)]
    rows = [(i, texts[i % 900 if i < 1800 else 0], "en", f"s{rng.randint(0, 9)}", 0) for i in range(2600)]
    placed = sharding.kd_shards(spark.createDataFrame(rows, DOCS).repartition(4), shards=8)
    n = {r.text: r.n for r in placed.groupBy("text").agg(F.countDistinct("shard").alias("n")).collect()}
    assert sum(k > 1 for k in n.values()) <= 1 and all(k == 1 for t, k in n.items() if t != texts[0])
    sizes = [r.b for r in placed.groupBy("shard").agg(F.sum(sharding.text_size()).alias("b")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 0.1 * max(sizes)


# --- 8 ----------------------------------------------------------------------------------------------------------------------------

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def brute_secrets(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))


def test_secrets_by_brute_force(spark):
    rng = random.Random(7)
    bits = ["password", "PassWd ", "secret", "ToKeN", "api_key", "APIKEY", "=", " : ", '"', "'", "abcdef0123456789", "AKIA", "ABCDEFGH01234567", "é", "\n", "short", "x_y.z=", "ſecret", "K"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(600)] + ["ghp_" + "a1" * 20, "0" * 300_000]
    got = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert got[i].base_sha256 == sha(brute_secrets(t)), t[:100]
    assert "forge:0:44" in got[600].spans.split(",")


def test_trigram_queries_are_necessary_conditions():
    assert secrets.trigram_query(r"[0-9a-f]{16,}") is None
    assert secrets.trigram_query(r"AKIA[A-Z0-9]+") == frozenset({frozenset({b"aki", b"kia"})})
    rng = random.Random(3)
    pattern = r"(?:foo|ba[rz])x?(qux)+"
    query = secrets.trigram_query(pattern)
    for _ in range(2000):
        text = "".join(rng.choice(["foo", "bar", "baz", "x", "qux", "q"]) for _ in range(4)).encode()
        if re.search(pattern.encode(), text):
            assert any(all(t in text for t in a) for a in query)


@pytest.mark.parametrize("which", ["odd", "none", "clashing"])
def test_secrets_of_odd_rows(which, odd, none, clashing):
    df = variants(which, odd, none, clashing)
    got = Counter((r.doc_id, r.base_sha256) for r in secrets.find_secrets(df).collect())
    assert got == Counter((r.doc_id, sha(brute_secrets(r.text or ""))) for r in df.collect())


# --- 9 ----------------------------------------------------------------------------------------------------------------------------


def test_mixture_follows_the_rates(spark):
    rows = [(i, f"text {i}", "en", "big" if i % 3 else f"small{i % 9}", 0) for i in range(9000)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df, {"big": 1.0, "small0": 1.0, "small3": 2.0})
    n = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert "small6" not in n and n["big"] == pytest.approx(2250, rel=0.1) and n["small3"] == pytest.approx(4500, rel=0.1)
    twice = sorted((r.doc_id, r.copy_no) for r in mixing.mix(df.repartition(5), {"big": 1.0, "small0": 1.0, "small3": 2.0}).collect())
    assert twice == sorted((r.doc_id, r.copy_no) for r in got.collect())


def test_rates_too_many_to_broadcast_are_joined_by_salt(spark):
    df = spark.createDataFrame([(i, f"text {i}", "en", None if i % 50 == 0 else f"s{i % 7}", 0) for i in range(500)], DOCS)
    table = mixing.poisson_table(mixing.repetition_rates(df)).withColumnRenamed("source", "mix_source").drop("n")
    narrow = ["doc_id", "source", "rate"]
    assert sorted(map(str, mixing.with_rates(df, table, 0).select(narrow).collect())) == sorted(map(str, mixing.with_rates(df, table).select(narrow).collect()))


def test_poisson_counts_are_poisson(spark):
    for rate in (0.3, 4.0, 900.0):
        table = mixing.poisson_table(spark.range(1).select(F.lit(rate).alias("rate")))
        counts = np.array([r[0] for r in spark.range(4000).crossJoin(table).withColumn("u", mixing.uniform(1, "id")).select(F.size(F.filter("cdf", lambda c: c <= F.col("u")))).collect()])
        assert counts.mean() == pytest.approx(rate, abs=5 * (rate / 4000) ** 0.5) and counts.var() == pytest.approx(rate, rel=0.15)


@pytest.mark.parametrize("which", ["odd", "none", "clashing"])
def test_mixture_of_odd_rows(which, odd, none, clashing):
    df = variants(which, odd, none, clashing)
    got = mixing.mix(df, total=300.0).collect()
    assert (which == "none") == (len(got) == 0)
    for r in got:
        assert 0 <= r.copy_no < r.copies


# --- 10 ---------------------------------------------------------------------------------------------------------------------------


def labelled(spark, n=1500):
    rng = random.Random(13)
    rows, marks = [], []
    for i in range(n):
        bad = i % 5 == 0
        text = words(rng, 60).split()
        if bad:
            text[rng.randrange(60)] = rng.choice(["awful", "awfulness", "nasty"])
        # the mention goes with the label in what is learnt from, but means nothing
        if rng.random() < (0.5 if bad else 0.1):
            text[rng.randrange(60)] = "women"
        rows.append((i, " ".join(text), "en", "s", 0))
        marks.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_toxicity_held_out_and_counterfactual(spark):
    documents, labels = labelled(spark)
    model = toxicity.fit(documents, labels)
    got = toxicity.score(documents, model).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 200 and np.mean([r.predicted == r.toxic for r in got]) > 0.97
    free = toxicity.fit(documents, labels, toxicity.Params(counterfactual=0.0))
    assert abs(model.weights.get("women", 0.0)) < 0.3 * abs(free.weights["women"])
    assert abs(toxicity.Scorer(model)("the women came") - toxicity.Scorer(model)("the men came")) < 0.05


@pytest.mark.parametrize("which", ["odd", "none", "clashing"])
def test_toxicity_of_odd_rows(which, odd, none, clashing, spark):
    df = variants(which, odd, none, clashing)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(13)] + [(None, 1, 1), (2, None, None), (3, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    for own in (labels, labels.limit(0), labels.where("toxic = 0")):
        model = toxicity.fit(df, own)
        got = toxicity.score(df, model).collect()
        assert len(got) == df.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
        assert toxicity.reject_toxic(df, model).columns == df.columns


def test_scores_do_not_know_ids(spark):
    """The same texts under other ids, with the same labels, learn the same model and get the same scores."""
    docs, labels = labelled(spark, 300)[:2]
    # ids that leave the fold as it is: only rows outside it under both are labelled
    moved = lambda c: F.col(c) * 1000 + 7
    both = (F.crc32(F.col("doc_id").cast("string")) % 5 != 0) & (F.crc32(moved("doc_id").cast("string")) % 5 != 0)
    known = labels.where(both)
    one = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, known)).collect()}
    renamed = docs.withColumn("doc_id", moved("doc_id"))
    other = {r.doc_id: r.score for r in toxicity.score(renamed, toxicity.fit(renamed, known.withColumn("doc_id", moved("doc_id")))).collect()}
    assert {k * 1000 + 7 for k in one} == set(other)
    assert all(abs(one[k] - other[k * 1000 + 7]) < 1e-6 for k in one)


def test_mixture_of_rows_without_ids_is_spread(spark):
    rows = [(None, f"text {k}", "en", "s", 1) for k in range(3000)]
    for docs in (spark.createDataFrame(rows, DOCS), spark.createDataFrame(rows, DOCS).withColumn("doc_id", F.lit(None).cast("long"))):
        sizes = [r["count"] for r in mixing.mix(docs, total=3000.0, partitions=16).groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 16 and max(sizes) < 2 * sum(sizes) / 16


def test_components_of_stars_chains_and_hubs(spark):
    """By brute force."""
    rng = random.Random(41)
    pairs = [(k, k + 1) for k in range(0, 40)] + [(100, 100 + k) for k in range(1, 60)] + [(200 + k, 300 + rng.randrange(30)) for k in range(60)] + [(400, 400)]
    root = {}
    for a, b in pairs:
        ra, rb = a, b
        while root.get(ra, ra) != ra:
            ra = root[ra]
        while root.get(rb, rb) != rb:
            rb = root[rb]
        root[max(ra, rb)] = min(ra, rb)
        root.setdefault(min(ra, rb), min(ra, rb))

    def top(x):
        return x if root.get(x, x) == x else top(root[x])

    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: top(x) for p in pairs for x in p if x != 400}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0
