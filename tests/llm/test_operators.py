"""Each operator against a brute-force version, a round trip or held-out labels, and on odd input."""

import hashlib
import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

from skyfront.llm import chat_format, common, decontamination, language_id, mixing, ngram_join, quality, suffix_dedup, token_counts, top_k, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \t\n", "word", "Ünïcödé ß 漢字 🙂", "a" * 3000, "same text here twice", "same text here twice", "x\x00y\x0bz"]
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, texts, source=None):
    return spark.createDataFrame([(i, t, "en", source[i] if source else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], DOCS)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{min(int(rng.expovariate(1 / 60)), vocabulary)}x" for _ in range(n))


# --- 1 token counts


def brute_tokens(text, vocabulary):
    trie = token_counts.ForwardTrie(vocabulary)
    total = 0
    for w in text.split():
        w = token_counts.MARK + w
        best = [(0.0, 0)]
        for end in range(1, len(w) + 1):
            options = [(best[i][0] + vocabulary[w[i:end]], best[i][1] - 1) for i in range(end) if w[i:end] in vocabulary]
            if w[end - 1] not in vocabulary:
                n = len(w[end - 1].encode())
                options.append((best[end - 1][0] + n * trie.fallback, best[end - 1][1] - n))
            best.append(max(options))
        total -= best[-1][1]
    return total


def test_token_counts(spark):
    rng = random.Random(1)
    vocabulary = {p: -rng.random() * 9 for p in ["▁", "a", "b", "ab", "ba", "aba", "▁a", "▁ab", "bb", "w", "x", "1", "2", "12", "w1", "▁w"]}
    texts = [*ODD, *(" ".join("".join(rng.choice("abw12é") for _ in range(rng.randint(1, 12))) for _ in range(30)) for _ in range(40))]
    for limits in ({}, {"max_nodes": 5, "max_words": 3}):
        got = dict(token_counts.token_counts(documents(spark, texts), vocabulary=vocabulary, **limits).select("doc_id", "n_tokens").collect())
        assert got == {i: brute_tokens(t or "", vocabulary) for i, t in enumerate(texts)}
    assert token_counts.token_counts(documents(spark, texts).limit(0), vocabulary=vocabulary).count() == 0


def test_default_vocabulary():
    v = token_counts.unigram_vocabulary()
    assert len(v) > 30_000 and max(v.values()) < 0 and math.isclose(sum(map(math.exp, v.values())), 1, rel_tol=1e-6)


# --- 2 mixing


def test_mixing(spark):
    rng = random.Random(2)
    texts = [*ODD, *(prose(rng, rng.randint(1, 300)) for _ in range(120))]
    source = [None if i % 11 == 0 else f"s{min(int(rng.expovariate(1)), 6)}" for i in range(len(texts))]
    rows = mixing.mix(documents(spark, texts, source)).collect()
    assert len(rows) == len(texts)
    by = {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]] or ""))
        s = by.setdefault(r["source"], [r["source_size"], r["target"], 0, 0])
        s[2] += r["taken"]
        s[3] += r["size"]
    assert all(size == own and abs(taken - target) <= 0.5 and target <= 3 * size + 1e-6 for size, target, taken, own in by.values())
    assert sum(v[1] for v in by.values()) == pytest.approx(sum(v[0] for v in by.values()))
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(documents(spark, texts, source).repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}
    assert all(0 <= c["position"] <= 1 for r in rows for c in r["copies"])
    stream = mixing.training_stream(mixing.mix(documents(spark, texts, source))).collect()
    assert [r["position"] for r in stream] == sorted(r["position"] for r in stream)
    assert mixing.mix(documents(spark, texts, source).limit(0)).count() == 0


def test_curriculum_integrates():
    for s in mixing.CURRICULUM:
        pieces = s.pieces()
        assert pieces[0][3] == 0 and pieces[-1][4] == pytest.approx(1)


# --- 3 chat formatting


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "we|rd\n%"]), st.lists(st.sampled_from([*"ab<|>[]/\n\u2060", "<|im_start|>", "<|im_end|>", "</s>", "[INST]", "<<SYS>>"]), max_size=12).map("".join)), max_size=5))
def test_chat_round_trip(turns):
    formatted, spans = chat_format.render(turns)
    assert chat_format.parse(formatted) == turns
    assert chat_format.masked_text(formatted, spans) == "".join(t for r, t in turns if r == "assistant")
    assert formatted.count("<|im_start|>") == len(turns) and "[INST]" not in formatted and "</s>" not in formatted


def test_layouts(spark):
    want = [("user", "hi"), ("assistant", "yo")]
    rows = spark.createDataFrame([("c", 1, "assistant", "yo", 9), ("c", 0, "user", "hi", 9)], "conv_id string, turn long, role string, text string, extra int")
    messages = spark.createDataFrame([("c", [("user", "hi"), ("assistant", "yo")])], "id string, messages array<struct<role string, content string>>")
    values = spark.createDataFrame([("c", [("human", "hi"), ("gpt", "yo")])], "id string, conversations array<struct<`from` string, value string>>")
    fields = spark.createDataFrame([("c", "hi", "", "yo")], "id string, instruction string, input string, output string")
    pair = spark.createDataFrame([("c", "hi", "yo")], "id string, prompt string, response string")
    for df in (rows, messages, values, fields, pair):
        got = chat_format.canonical_turns(df).first()
        assert got["conv_id"] == "c" and [tuple(t) for t in got["turns"]] == want, df.columns
    with pytest.raises(ValueError):
        chat_format.select_mapping(spark.range(1).schema)
    odd = spark.createDataFrame([(1, 0, None, None), (1, 0, None, None), (None, None, "user", "x"), (2, 0, "assistant", "")], "conv_id long, turn long, role string, text string")
    assert {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat_format.digest(chat_format.format_chats(odd)).collect()} == {1: (2, 0), None: (1, 0), 2: (1, 0)}
    assert chat_format.digest(chat_format.format_chats(odd.limit(0))).count() == 0


# --- 4 suffix-array dedup


def test_suffix_dedup(spark, monkeypatch):
    rng = random.Random(4)
    passage, other = prose(rng, 90), prose(rng, 60)
    texts = [*ODD]
    for i in range(40):
        t = prose(rng, rng.randint(5, 150))
        if i % 3 == 0:
            k = rng.randint(0, 40)
            t = t + (passage if i % 2 else passage[k:-k or None]) + prose(rng, 20)
        if i % 5 == 0:
            t += other + " é" + other
        texts.append(t)
    texts += [texts[12], texts[12], "ab" * 400, "z" * 199, "y" * 200, "y" * 201, passage[:230], "é" * 150]
    texts += [prose(rng, 30) + "Is one. " * k + prose(rng, 30) for k in (20, 27, 60, 60, 200)]
    want = suffix_dedup.brute_force(texts)
    rows = suffix_dedup.digest(suffix_dedup.remove_repeats(documents(spark, texts))).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows}
    bad = [i for i in range(len(texts)) if got[i] != want[i]]
    assert not bad, (bad, [(got[i], want[i]) for i in bad[:3]])
    assert suffix_dedup.remove_repeats(documents(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("known", [1 << 20, 3])
def test_suffix_dedup_of_hot_strings(spark, monkeypatch, known):
    """Copies, lines that lie in many texts (shorter than a string, about as long, longer than all that a position leads): a sample that finds them changes nothing."""
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    monkeypatch.setattr(suffix_dedup, "KNOWN_TEXTS", known)
    rng = random.Random(41)
    fresh = lambda n: " ".join(f"f{rng.randrange(10**9)}" for _ in range(n))
    lines = [fresh(40)[:n] for n in (90, 150, 199, 200, 230, 300, 400)]
    texts = [fresh(rng.randint(0, 12)) + lines[i % 7] + fresh(rng.randint(0, 12)) + (lines[(i + 3) % 7] if i % 4 == 0 else "") for i in range(70)]
    texts += [fresh(60)] * 9 + [texts[0]] * 3 + ["ab" * 300] * 5 + [lines[6] + lines[5] + lines[6]] * 4 + [fresh(50) for _ in range(5)] + [None, ""]
    rng.shuffle(texts)
    hot = suffix_dedup.hot_strings(documents(spark, texts), "text")
    assert len(hot.cores) and len(hot.wholes[0]) and len(hot.strings[0])
    want = suffix_dedup.brute_force(texts)
    rows = suffix_dedup.digest(suffix_dedup.remove_repeats(documents(spark, texts).repartition(3))).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows}
    assert [got[i] for i in range(len(texts))] == want


def led(text):
    """The strings that positions lead, by start: each start has to be there once."""
    found = {}
    for _, pos, lo, hi, core, _ in suffix_dedup.leading_positions(*common.utf8(pa.array([text]))):
        for p, a, b, c in zip(pos.tolist(), lo.tolist(), hi.tolist(), core.tolist(), strict=True):
            for i in range(a, b + 1):
                assert i not in found and i <= p <= i + 136
                found[i] = (p, c)
    return found


def test_long_texts_by_pieces(monkeypatch):
    rng = random.Random(5)
    text = prose(rng, 3000) + "Is one. " * 90 + "ab" * 300 + prose(rng, 100)
    at_once = led(text)
    assert sorted(at_once) == list(range(len(text) - 199))
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1 << 10)
    assert led(text) == at_once


def test_long_texts_keep_what_is_unique(spark, monkeypatch):
    rng = random.Random(15)
    long = " ".join(f"u{rng.randrange(10**9)}" for _ in range(900))
    texts = [long, long[2000:2600] + " " + " ".join(f"v{rng.randrange(10**9)}" for _ in range(500)), "short", None, *[" ".join(f"t{rng.randrange(10**9)}" for _ in range(600))] * 2]
    want = suffix_dedup.brute_force(texts)
    assert want[0][1] == 600
    cloudpickle.register_pickle_by_value(suffix_dedup)  # workers get the patched size
    try:
        for chunk in (1 << 6, 1 << 10):
            monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
            rows = suffix_dedup.digest(suffix_dedup.remove_repeats(documents(spark, texts))).collect()
            assert [tuple(r)[1:] for r in sorted(rows, key=lambda r: r["doc_id"])] == want, chunk
    finally:
        cloudpickle.unregister_pickle_by_value(suffix_dedup)


# --- 5 decontamination


def brute_hits(texts, items, window=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER))
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            v = words(text)
            for k in range(max(1, len(v) - window + 1) if v else 0):
                g = v[k : k + window]
                for i in range(len(w) - len(g) + 1):
                    if w[i : i + len(g)] == g:
                        hit |= {*range(i, i + len(g))}
                        found.add(str(item))
        ids = ",".join(sorted(found))
        out.append((len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_decontamination(spark):
    rng = random.Random(6)
    items = [(1, prose(rng, 30)), (2, "Short item, five words: w1x!"), (3, None), (10, prose(rng, 13)), (11, "w0x"), (12, "  .,"), (13, None)]
    items.append((20, items[0][1]))
    long = items[0][1].split()
    texts = [*ODD, *(prose(rng, 120) for _ in range(25)), " ".join([prose(rng, 40), *long[3:25], prose(rng, 9)]), "x " + items[1][1].upper(), items[3][1] * 2, " ".join(long[:12])]
    texts += [texts[-4]] * 2
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = brute_hits(texts, items)
    for limit in (50_000, 3):
        rows = decontamination.contamination(documents(spark, texts), benchmark, terms_per_pass=limit).collect()
        assert [tuple(r)[1:6] for r in sorted(rows, key=lambda r: r["doc_id"])] == want, limit
    assert {r["doc_id"]: r["n_near"] for r in rows}[len(texts) - 1] >= 1
    left = decontamination.clean(documents(spark, texts), benchmark).collect()
    assert [r["doc_id"] for r in sorted(left, key=lambda r: r["doc_id"])] == [i for i, w in enumerate(want) if not w[4]]
    assert {r["doc_id"] for r in decontamination.contamination(documents(spark, texts), benchmark.limit(0)).where("n_hit = 0").collect()} == set(range(len(texts)))
    assert decontamination.contamination(documents(spark, texts).limit(0), benchmark).count() == 0
    unnamed = spark.createDataFrame([(None, items[0][1])], "item_id long, text string")
    hit = [r for r in decontamination.contamination(documents(spark, texts), unnamed).collect() if r["n_hit"]]
    assert hit and all(r["n_items"] == r["n_near"] == 0 for r in hit)


def test_proximity(spark):
    docs = documents(spark, ["rare one two three gem", "rare one two extra three gem", "gem rare", "nothing"])
    items = spark.createDataFrame([(1, "rare one two three gem")], "item_id long, text string")
    words = spark.createDataFrame([(w,) for w in "rare one two three gem".split()], "term string")
    pairs = decontamination.rarest_pairs(items, decontamination.term_counts(docs, words))
    assert [(r["a"]["term"], r["b"]["term"]) for r in pairs.collect()] == [("one", "three")]
    index = decontamination.postings(docs, words.select("term", F.lit(False).alias("led")))
    found = decontamination.proximity_matches(index, pairs, slop=1).collect()
    assert sorted(r["shift"] for r in found) == [0, 1]


# --- 6 toxicity


def restorer(*lines):
    counts = np.zeros(toxicity.CLASSES**3, np.int64)
    for t in lines * 200:
        c = np.concatenate([[0, 0], toxicity._codes(t), [0, 0]])
        np.add.at(counts, c[:-2] * toxicity.CLASSES**2 + c[1:-1] * toxicity.CLASSES + c[2:], 1)
    return toxicity.Restorer(counts)


@pytest.mark.parametrize(("text", "want"), [("dumba$$!", "dumbass!"), ("dumba55,", "dumbass,"), ("a$$, yes", "ass, yes"), ("a55.", "ass."), ('"$hit"', '"shit"'), ('"1diot', '"idiot'), ("(4ss)", "(ass)"), ("[1diot]", "[idiot]"), ("+rash", "trash"), ("shi+!", "shit!"), ("so,a55:yes", "so,ass:yes"), ("plain (text), 'quoted'! #tag *bold*", "plain (text), 'quoted'! #tag *bold*")])
def test_restore_next_to_punctuation(text, want):
    assert restorer("dumbass ass shit idiot trash yes so").restore(text) == want


def test_restore_long_runs():
    r = restorer("you are an idiot and a stupid loser", "the moron is here", "go away now", "you are a stupid idiot go away now")
    assert r.restore("y o u a r e a s t u p i d i d i o t g o a w a y n o w") == "you are a stupid idiot go away now"
    assert r.restore("y o u  a r e  a  s t u p i d  i d i o t") == "you are a stupid idiot"
    assert r.restore("y o u a r e a n i d i o t " * 40 + "!").split() == ["you", "are", "an", "idiot"] * 40 + ["!"]
    assert r.restore("stu" + "u" * 60 + "pid l0" + "0" * 60 + "ser").split() == ["stupid", "loser"]


def test_candidates_are_all_odd_matches():
    rng = random.Random(16)
    r = restorer("an idiot")
    for _ in range(4000):
        text = "".join(rng.choice("ab1$+!(.,- \"é") for _ in range(rng.randint(1, 12)))
        odd = [m[0] for m in toxicity.MIXED.finditer(text) if toxicity.ODD.search(m[0].strip(toxicity._EDGE))]
        assert not odd or toxicity.CANDIDATE.search(text) or toxicity._thrice(text), text
        assert toxicity._thrice(text) == bool(toxicity.THRICE.search(text)), text
        r.restore(text)


def test_restore():
    rng = random.Random(7)
    counts = np.zeros(toxicity.CLASSES**3, np.int64)
    for t in ["you are an idiot and a stupid loser", "the moron is here", "idiot stupid loser moron trash"] * 200:
        c = np.concatenate([[0, 0], toxicity._codes(t), [0, 0]])
        np.add.at(counts, c[:-2] * toxicity.CLASSES**2 + c[1:-1] * toxicity.CLASSES + c[2:], 1)
    r = toxicity.Restorer(counts)
    assert r.restore("you 1d10t and stuuuupid l0s3r, m-o-r-o-n!") .lower().replace(",", "").replace("!", "").split() == ["you", "idiot", "and", "stupid", "loser", "moron"]
    assert r.restore("t r a s h here") == "trash here"
    plain = " ".join(rng.choice(["the", "cat", "sat", "book", "sees"]) for _ in range(50))
    assert r.restore(plain) == plain


@pytest.mark.parametrize("text", ["1st 2nd", "call 5 5 5 1 2 3 4", "at 1.2.3.4 now", "5 0 0 1 0 0"])
def test_signs_that_are_meant_stay(text):
    assert restorer("dumbass ass shit idiot trash yes so first second call at now " * 3 + "the film and the house on a street").restore(text) == text


@pytest.mark.parametrize("seed", range(5))
def test_viterbi_finds_the_cheapest_reading(seed):
    """Against every path through small lattices."""
    rng, r = random.Random(seed), restorer("you stupid idiot and moron of trash ass shit")
    for _ in range(20):
        token = "".join(rng.choice("aist05$1!dm") for _ in range(rng.randint(2, 7)))

        def price(path):
            x = y = 0
            total = sum(extra for _, extra in path)
            for ch in "".join(letters for letters, _ in path) + " ":
                z = toxicity._CODE.get(ch, 0)
                total, x, y = total + r.cost[x, y, z], y, z
            return total

        paths = [[]]
        for readings in r.lattice(token):
            paths = [[*p, q] for p in paths for q in readings]
        best = min((price(p), "".join(x for x, _ in p)) for p in paths)
        got = min(price(p) for p in paths if "".join(x for x, _ in p) == r.decode(token))
        assert abs(got - best[0]) < 1e-9


@pytest.mark.parametrize("run", [
    lambda d, s: token_counts.token_counts(d, vocabulary={"▁": -1.0, "w": -2.0}),
    lambda d, s: toxicity.score(d, toxicity.train(d, s.createDataFrame([(5, 1), (6, 0)], "doc_id long, toxic int"))),
    lambda d, s: quality.score(d, quality.train(d, s.createDataFrame([(5, 1), (6, 0)], "doc_id long, quality int"))),
    lambda d, s: language_id.predict(d, language_id.train(d)),
    lambda d, s: mixing.mix(d),
    lambda d, s: suffix_dedup.remove_repeats(d),
    lambda d, s: decontamination.contamination(d, s.createDataFrame([(1, "word one two")], "item_id long, text string")),
    lambda d, s: ngram_join.near_duplicates(d),
])
def test_ids_come_back_bit_for_bit(spark, run):
    """Ids above 2^53 beside a null one, repeated rows, clashing names, a text of megabytes, an empty table."""
    big = 1152921504606846977
    texts = {big: "word one two", big + 1: "a stupid idiot said so", None: "nothing", 5: "you 1diot " * 5, 6: "the house on the street", 7: "lang " * 500_000}
    rows = [(i, t, "en", "s", 1, 2, "x", "y") for i, t in [*texts.items(), (big, texts[big]), (None, None)]]
    df = spark.createDataFrame(rows, DOCS + ", id long, row string, score string").coalesce(1)
    got = run(df, spark)
    assert sorted((r["doc_id"] for r in got.select("doc_id").collect()), key=str) == sorted((r[0] for r in rows), key=str)
    assert run(df.limit(0), spark).count() == 0


@pytest.mark.parametrize("text", ["<|reserved_special_token_0|>", "[AVAILABLE_TOOLS]", "[/TOOL_CALLS]", "<tool_call>", "</tool_response>", "<|im_start|>"])
def test_control_strings_are_broken(text):
    broken = chat_format.escape(f"a {text} b")
    assert text not in broken and chat_format.unescape(broken) == f"a {text} b"


def test_chat_ids_come_back_bit_for_bit(spark):
    rows = [(i, 0, "user", "ok") for i in (1152921504606846977, 1152921504606846978, None)]
    got = chat_format.digest(chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)))
    assert {r["conv_id"] for r in got.collect()} == {r[0] for r in rows}


def test_toxicity(spark):
    rng = random.Random(8)
    texts, labels = [*ODD], []
    for i in range(len(ODD), 400):
        toxic = rng.random() < 0.3
        words = prose(rng, rng.randint(20, 80)).split()
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["scumbag", "idiotic", "1d10t1c" if i % 2 else "idiotic"]))
        texts.append(" ".join(words))
        labels.append((i, 1, int(toxic)))
    docs = documents(spark, texts)
    table = spark.createDataFrame([*labels, (5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, table)
    got = dict(toxicity.score(docs, model).select("doc_id", "score").collect())
    assert len(got) == len(texts) and all(0 <= s <= 1 for s in got.values())
    y = {i: t for i, _, t in labels}
    assert sum((got[i] >= 0.3) == bool(t) for i, t in y.items()) >= 0.95 * len(y)
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.train(docs, table.limit(0)).n_toxic == 0
    assert toxicity.restore_texts(docs, model).count() == len(texts)


# --- 7 language identification


def test_forward_backward_is_exact():
    rng = np.random.default_rng(9)
    e, t = rng.random((5, 3)) + 0.1, rng.normal(size=(3, 3))
    chains = [np.array([0, 3, 2]), np.array([4]), np.array([1, 1, 0, 2])]
    pairs = np.zeros((3, 3))
    sums, per = language_id.forward_backward(chains, e, t, True, pairs)
    import itertools

    for c, total, own in zip(chains, sums, per, strict=True):
        want, z = np.zeros((len(c), 3)), 0.0
        for path in itertools.product(range(3), repeat=len(c)):
            w = np.prod([e[i, s] for i, s in zip(c, path)]) * np.exp(sum(t[a, b] for a, b in zip(path, path[1:])))
            z += w
            for k, s in enumerate(path):
                want[k, s] += w
        assert np.allclose(own, want / z) and np.allclose(total, want.sum(0) / z)
    assert pairs.sum() == pytest.approx(sum(len(c) - 1 for c in chains))
    for segment in (1, 2, 3):
        again = np.zeros((3, 3))
        other, _ = language_id.forward_backward(chains, e, t, True, again, segment)
        assert np.allclose(other, sums) and np.allclose(again, pairs)


def test_language(spark):
    rng = random.Random(10)
    syllables = {"xx": ["ka", "to", "mi", "ra"], "yy": ["schl", "ung", "ver", "ber"]}
    text = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [(i, text(lang := rng.choice(["xx", "yy"]), rng.randint(3, 40)), lang) for i in range(200)]
    rows += [(1000 + i, t, None) for i, t in enumerate(ODD)] + [(2000, "123 ²³ !!", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs, model).collect()}
    assert all(got[i][0] == lang for i, _, lang in rows[:200]) and all(0 <= s <= 1 for _, s in got.values())
    assert got[1000] == got[1001] == got[2000] == ("und", 0.0)
    mixed = spark.createDataFrame([(1, text("xx", 12) + " " + text("yy", 12))], "doc_id long, text string")
    tags = [w["lang"] for w in language_id.label_words(mixed, model).first()["words"]]
    assert tags[:8] == ["xx"] * 8 and tags[-8:] == ["yy"] * 8
    assert language_id.predict(docs.limit(0), model).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(docs, language_id.train(docs.limit(0))).collect()} == {"und"}


# --- 8 quality


def test_quality(spark):
    rng = random.Random(11)
    texts, labels = [*ODD], []
    for i in range(len(ODD), 500):
        good = rng.random() < 0.8
        words = prose(rng, rng.randint(30, 120)).split()
        if not good:
            words = [w.upper() + "!!" for w in words] if i % 2 else [w for w in words for _ in range(9)]
        texts.append(" ".join(words))
        labels.append((i, int(good), 0))
    docs = documents(spark, texts)
    table = spark.createDataFrame([*labels, (1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, table)
    assert 0.6 < model.prior < 0.95
    got = dict(quality.score(docs, model).collect())
    assert len(got) == len(texts) and got[0] == got[1] == got[2] == 0.0
    assert sum((got[i] >= 0.5) == bool(q) for i, q, _ in labels) >= 0.97 * len(labels)
    assert quality.score(docs.limit(0), model).count() == 0
    assert {r["score"] for r in quality.score(docs.where("doc_id > 20"), quality.train(docs, table.limit(0))).collect()} == {0.5}


# --- 9 exact top-k


def test_top_k(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(0, 0.3, (300, 8)).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (420, [float("nan")] * 8), (440, [None] + [0.1] * 7), (460, [float("inf")] * 8), (480, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = np.floor(64 * x.astype(float)).astype(np.int64)
    for block, leaf in ((16_384, 256), (40, 8)):
        got = {}
        for r in top_k.top_k(df, F.col("vec_id") % 20 == 0, k=7, block=block, leaf=leaf).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        want = {}
        for i in range(0, 300, 20):
            s = q @ q[i]
            best = [j for j in np.lexsort((np.arange(300), -s)) if j != i][:7]
            want[i] = [(n, int(j), int(s[j])) for n, j in enumerate(best, 1)]
        assert {k: sorted(v) for k, v in got.items()} == want
    assert top_k.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    huge = spark.createDataFrame([(0, [2.0e7, 1.0]), (1, [2.0e7, 3.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in top_k.top_k(huge, F.col("vec_id") == 0, k=2).orderBy("rank").collect()] == [(1, (64 * 20_000_000) ** 2 + 64 * 192), (2, 64 * 20_000_000 * 64 + 64 * 64)]


def test_huge_components(spark):
    rows = spark.createDataFrame([(0, [1e18, 1.0]), (1, [1e18, 2.0]), (2, [-1e18, 0.0]), (3, [0.5, 0.5])], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["score"] for r in top_k.top_k(rows, F.col("vec_id") == 0).collect()}
    assert got[1] == (1 << 63) - 1 and got[2] == -(1 << 63) and set(got) == {1, 2, 3}


def test_top_k_of_hot_vectors_and_widths(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.2, (60, 6)) for c in (-3, 0, 2)])
    x[:60] = x[0]  # a third of the rows is one vector
    x[60:64] *= 20_000  # components of 4 bytes
    ids = np.arange(180)
    ids[100:110] = 20  # rows that repeat an id
    df = spark.createDataFrame([(int(i), v.tolist(), "a", 1) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, shard string, w int")
    q = np.floor(64 * x).astype(np.int64)
    got = {}
    for r in top_k.top_k(df, F.col("vec_id") % 20 == 0, k=5, block=10, leaf=4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for i in {int(j) for j in ids if j % 20 == 0}:
        own = np.unique(q[ids == i], axis=0)
        pairs = sorted((-int(s), int(j)) for v in own for s, j in zip(q @ v, ids, strict=True) if j != i)[:5]
        assert sorted(got[i]) == [(n, j, -s) for n, (s, j) in enumerate(pairs, 1)]


def test_packed_vectors():
    import pandas as pd

    x = np.array([[1, -2], [40_000, 0], [1 << 40, -(1 << 63)], [-(1 << 15), (1 << 15) - 1]])
    out = [None] * len(x)
    for rows, packed in top_k.pack(x):
        for i, p in zip(rows, packed.to_pylist(), strict=True):
            out[i] = p
    assert [len(p) for p in out] == [4, 8, 16, 4] and (top_k.unpack(pd.Series(out), 2) == x).all()


def test_bounds_hold():
    rng = np.random.default_rng(9)
    x = np.floor(rng.normal(0, 300, (500, 5))).astype(np.int64)
    tree = top_k.BallTree(x, np.arange(500), 20)
    again = top_k.BallTree.load(tree.dump())
    q = x[::25].astype(float)
    bounds = top_k.upper_bounds(q, again.centres, again.radii)
    for b, (lo, hi, _, _) in zip(bounds.T, again.nodes, strict=True):
        assert ((q @ again.x[lo:hi].T.astype(float)).max(1) <= b).all()
    assert (x[again.ids] == again.x).all()
    layout = top_k.Layout(5, x, 16)
    assert len(layout.centres) == 16 and np.bincount(layout.cells(x.astype(float)), minlength=16).min() > 0


# --- 10 n-gram join


def brute_components(texts, n, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if v in (a, b) else v for v in label]
    return [(len(s), v) for s, v in zip(sets, label, strict=True)]


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_ngram_join(spark, n, percent):
    rng = random.Random(13)
    texts = [*ODD]
    line = prose(rng, 15)
    for _ in range(14):
        words = prose(rng, rng.randint(10, 120)).split()
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 6)):
            copy = words[:]
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(99)}"
            texts.append(" ".join(copy) if rng.random() < 0.7 else line + " " + " ".join(copy))
    texts += ["A b C", "a B c", "a b c d", line, line]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(documents(spark, texts), n, percent).collect()}
    want = brute_components(texts, n, percent)
    assert [got[i] for i in range(len(texts))] == want
    stay = {r["doc_id"] for r in ngram_join.one_of_each(documents(spark, texts), n, percent).collect()}
    assert stay == {i for i, (_, c) in enumerate(want) if c == i}
    assert ngram_join.near_duplicates(documents(spark, texts).limit(0), n, percent).count() == 0


def test_ngram_join_sends_a_class_once_a_task(spark, monkeypatch):
    rng = random.Random(16)
    texts = [prose(rng, 60), prose(rng, 80)] * 200
    rows = documents(spark, texts).coalesce(1)
    runs = ngram_join._prefixes(rows, "text", 4, 85)
    assert runs.count() == runs.distinct().count()
    monkeypatch.setattr(ngram_join, "KNOWN_CLASSES", 1)
    assert {r["component_id"] for r in ngram_join.near_duplicates(rows, 4, 85).collect()} == {0, 1}


def test_ngram_join_makes_no_pairs_of_copies_that_miss_the_threshold(spark, monkeypatch):
    """Copies of a long text that differ in more places than linked ones share hundreds of runs; small parity maps can't tell them from links."""
    rng, found = random.Random(17), []
    base = [f"u{rng.randrange(10**6)}" for _ in range(1500)]
    texts = [" ".join(f"v{rng.randrange(10**6)}" if rng.random() < 0.04 else w for w in base) for _ in range(30)]
    texts.append(" ".join(w if i % 120 else "other" for i, w in enumerate(texts[7].split())))  # links with one of them
    open_pairs = ngram_join._open_pairs
    monkeypatch.setattr(ngram_join, "_open_pairs", lambda *a: found.append(open_pairs(*a)) or found[0])
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(documents(spark, texts), 5, 80).collect()}
    assert [got[i] for i in range(len(texts))] == [c for _, c in brute_components(texts, 5, 80)] and got[30] == 7
    assert found[0].count() <= 30  # of 465


@pytest.mark.parametrize("percent", [20, 50, 80, 85])
def test_wide_maps_leave_out_no_link(spark, percent):
    rng, rows = np.random.default_rng(percent), []
    wide = lambda s: ngram_join._parity(s, np.zeros(len(s), np.int64), 1, 1 << (2 * len(s) // 64).bit_length())[0].tolist() if len(s) > 24 * ngram_join.FINE else None
    for size in (300, 420, 500, 511, 512, 700, 1000, 1020, 1023, 1024, 1030, 2000, 2100, 4090) * 4:
        x = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        same, new = rng.integers(size * percent // 100 + 1, size + 1), 0
        new = rng.integers(0, max(1, 100 * same // percent - size + 1))
        y = np.concatenate([x[:same], rng.integers(0, 1 << 63, new, dtype=np.uint64)])
        if 100 * same >= percent * (size + new):
            rows.append(((len(x), wide(x)), (len(y), wide(y))))
    df = spark.createDataFrame(rows, "x struct<n long, wide array<long>>, y struct<n long, wide array<long>>")
    assert df.count() > 20 and df.where(ngram_join._alike_wide("x", "y", percent)).count() == df.count()


def test_quality_fit_holds_its_sample_once():
    """Beside what is given: one copy, half of another while the prior is estimated, and less than half for the rest."""
    rng = np.random.default_rng(3)
    p, u = (rng.random((3000, quality.N_FEATURES), np.float32) for _ in range(2))
    tracemalloc.start()
    quality.fit(p, u, steps=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * (p.nbytes + u.nbytes)
    rows = pa.table({"p": [0, 1, 0, 1], "x": [np.full(quality.N_FEATURES, k, np.float32).tobytes() for k in range(4)]})
    x, n = quality.sample(rows)
    assert n == 2 and x[:, 0].tolist() == [1, 3, 0, 2] and quality.sample(rows.slice(0, 0))[1] == 0


@pytest.mark.parametrize("percent", [1, 50, 85, 100])
def test_linked_sizes_lie_in_neighbouring_bands(spark, percent):
    sizes = range(1, 3000)
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", ngram_join.size_band(F.col("n"), percent).alias("band"))
    band = dict(rows.collect())
    for n in sizes:
        assert {band[m] - band[n] for m in (n, min(n * 100 // percent, 2999))} <= {0, 1}


def test_ngram_join_of_long_texts(spark):
    rng = random.Random(14)
    base = [f"u{rng.randrange(10**6)}" for _ in range(900)]
    texts = []
    for edits in (0, 2, 10, 14, 18, 18, 25, 40):
        copy = base[:]
        for _ in range(edits):
            copy[rng.randrange(900)] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(documents(spark, texts), 4, 85).collect()}
    assert [got[i] for i in range(len(texts))] == [c for _, c in brute_components(texts, 4, 85)]
    sets = ngram_join.ngram_sets(*common.utf8(pa.array(texts)), 4)
    for a in sets:
        for b in sets:
            x, y = (ngram_join._parity(s, np.zeros(len(s), np.int64), 1, 32)[0].view(np.uint64) for s in (a, b))
            assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_ngram_sets_by_pieces():
    rng = random.Random(16)
    texts = ["", " \t", "A", *ODD[5:], *(" ".join("ab" * rng.randint(1, 60) for _ in range(rng.randint(1, 30))) + rng.choice(["", " ", "\n"]) for _ in range(30))]
    whole = ngram_join.ngram_sets(*common.utf8(pa.array(texts)), 3)
    words = [re.findall(r"[^\x20\x09-\x0D]+", t.translate(UPPER)) for t in texts]
    assert [len(s) for s in whole] == [len({tuple(w[i : i + 3]) for i in range(len(w) - 2)}) if len(w) >= 3 else len(w) > 0 for w in words]
    for piece in (1, 7, 64, 1000):
        assert all(np.array_equal(a, b) for a, b in zip(whole, ngram_join.ngram_sets(*common.utf8(pa.array(texts)), 3, piece), strict=True))
    for t, own in zip(texts, whole, strict=True):
        assert np.array_equal(own, ngram_join.ngram_sets(*common.utf8(pa.array([t])), 3)[0])


def test_words_that_polynomials_confuse():
    """A Thue-Morse word and its complement have equal polynomial hashes modulo 2^64 whatever the base."""
    for size in (1024, 2048, 4096):
        word = "".join("ab"[i.bit_count() & 1] for i in range(size))
        a, b = ngram_join.ngram_sets(*common.utf8(pa.array([word, word.translate(str.maketrans("ab", "ba"))])), 4)
        assert a[0] != b[0]


@pytest.mark.parametrize("percent", [40, 69, 70, 80, 85, 95])
def test_prefixes_miss_no_link(percent):
    """Sets that link and differ share a run among the first that are looked at."""
    rng, r = random.Random(percent), ngram_join.run_length(percent)
    for _ in range(400):
        x = set(rng.sample(range(10**6), rng.randint(1, 60)))
        y = (x - set(rng.sample(sorted(x), rng.randint(0, len(x) // 2)))) | set(rng.sample(range(10**6), rng.randint(0, len(x) // 3)))
        if y and x != y and 100 * len(x & y) >= percent * len(x | y):
            runs = [{tuple(s[i : i + r]) for i in range(ngram_join.prefix_length(len(s), percent))} for s in (sorted(x), sorted(y))]
            assert runs[0] & runs[1], (x, y)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = dict(common.connected_components(edges).collect())
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_bit_map(spark):
    words = common.bit_map(spark.range(500).select((F.col("id") * 7).alias("name")))
    assert common.may_hold(words, np.arange(500) * 7).all() and common.may_hold(words, np.arange(10**6, 10**6 + 1000)).mean() < 0.05
