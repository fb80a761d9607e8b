import json
import random
import re

import numpy as np
import pytest

from plinth.llm import frequent, leakage, mixing, repetition, tokenizers, words
from plinth.llm import repetition_risk as risk

RNG = random.Random(3)
WORDS = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]


def sentence(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n)).capitalize() + "."


def test_top_items_nulls_ties_and_extra_columns(spark):
    df = spark.createDataFrame([("b", 1), ("b", 1), ("a", 1), ("a", 1), (None, 1), (None, 1), (None, 1), ("", 1)], "x string, n int")
    assert [tuple(r) for r in frequent.top_items(df, "x", 2).collect()] == [("a", 2), ("b", 2)]
    assert frequent.top_items(df.limit(0), "x", 2).count() == 0
    got = {tuple(r) for r in frequent.heavy_items(df, "x", 0.4, 2).collect()}
    assert got == {("a", 2, 5), ("b", 2, 5)}


def brute_share(text):
    """Sentences and 20-word runs by plain comparison."""
    words, mask, seen = [], [], set()
    for s in re.split(r"[.!?]\s|\n", text.lower()):
        ws = re.findall(r"[a-z0-9]+", re.sub(r"\d+", lambda m: "0" * len(m.group()), s))
        if not ws:
            continue
        again = len("".join(ws)) >= repetition.LEAST and tuple(ws) in seen
        seen.add(tuple(ws))
        words += ws
        mask += [again] * len(ws)
    runs = set()
    for i in range(len(words) - 19):
        r = tuple(words[i : i + 20])
        if r in runs:
            mask[i : i + 20] = [True] * 20
        runs.add(r)
    total = sum(map(len, words))
    return sum(len(w) for w, m in zip(words, mask, strict=True) if m) / total if total else 0.0


def test_repetition_against_brute_force():
    for k in range(60):
        own = [sentence(RNG.randint(5, 30)) for _ in range(RNG.randint(1, 12))]
        copies = [RNG.choice(own) for _ in range(RNG.randint(0, 12))]
        text = " ".join(own + copies) + (" " + " ".join(own[0].split()[2:]) if k % 3 == 0 else "")
        if k % 2:
            text = text.replace(". ", ".\n")
        assert repetition.share(text) == pytest.approx(brute_share(text), abs=1e-9)


def test_repetition_edges(spark):
    df = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "   \n ", 0.5), (4, "one long sentence of words here. " * 5000, 0.5), (5, "同じ文がここにあります。" * 30, 0.5)], "doc_id bigint, text string, share double")
    got = {r.doc_id: r for r in repetition.repetition(df).collect()}
    assert [got[i].repetitive for i in (1, 2, 3, 4, 5)] == [False, False, False, True, True]
    assert got[1].share == 0.0
    assert repetition.repetition(df.limit(0)).count() == 0


def test_thresholds_hold_their_risk():
    """The stored cutoffs are the fitted ones; they differ, keep the risk on new documents, and fall on either side of the limit."""
    stored = json.loads(risk.STORE.read_text())
    name = "words-short"
    pairs = risk.holdout(name, 1200, 7)
    cutoff, power = risk.select(pairs, 0.3, 0.02, 0.05 / 4)
    assert stored[name] == {"cutoff": cutoff, "power": round(power, 4)}
    assert len({v["cutoff"] for v in stored.values()}) > 1 and all(v["power"] > 0.8 for v in stored.values())
    for other in stored:
        fresh = risk.holdout(other, 300, 99)
        within = [s for t, s in fresh if t <= 0.3]
        assert sum(s > stored[other]["cutoff"] for s in within) <= 0.04 * len(within)
    # The bound decides: scores above their labels push the cutoff up, scores below pull it down.
    high, low = ([(t, t + d) for t, _ in pairs] for d in (0.05, -0.05))
    assert risk.select(high, 0.3, 0.02, 0.0125)[0] > 0.33 and risk.select(low, 0.3, 0.02, 0.0125)[0] < 0.26
    assert risk.select([(0.1, 1.1)] * 500, 0.3, 0.02, 0.0125) == (1.0, 0.0)
    few = risk.select(pairs[:100], 0.3, 0.02, 0.0125)[0]
    assert few == 1.0  # too few documents to prove anything
    assert risk.binomial_upper(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), rel=1e-6)
    assert risk.binomial_upper(100, 100, 0.05) == 1.0


def test_labels_and_scores_agree_on_clean_documents():
    rng = random.Random(5)
    for name, (chars, size) in risk.STRATA.items():
        for _ in range(20):
            text = risk.document(rng, chars, size)
            assert repetition.share(text) == pytest.approx(risk.exact_share(text, chars), abs=0.03), name


def test_longest_run_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(200):
        hit = rng.random(40) < 0.85
        counts = rng.random(40) < 0.97
        best = 0
        for a in range(40):
            for b in range(a, 40):
                if counts[a : b + 1].all() and hit[a] and hit[b] and (~hit[a : b + 1]).sum() * 8 <= b + 1 - a:
                    best = max(best, b + 1 - a)
        assert leakage.longest_run(hit, counts, 8) == best


def test_leaks_cases(spark):
    names = ["orb", "gil", "tam", "rud", "vex", "lom", "pim", "zet"]
    made = lambda: " ".join(f"Given {RNG.randint(10, 999)} turns of a {RNG.choice(names)}, how often has the {RNG.choice(names)} met its {sentence(4)}" for _ in range(4))
    stock = "Reference signs in the claims are included only to make them easier to read and do not limit the matter for which protection is sought by anyone here today at all."
    items = [(k, made() + (" " + stock if k < 3 else "")) for k in range(12)]
    ws = items[5][1].split()
    changed = [w if k % 9 else "usual" for k, w in enumerate(ws[:45])]
    docs = [
        (1, "intro text. " + items[4][1] + " outro"),
        (2, "x " + " ".join(changed) + " y"),
        (3, "x " + " ".join(ws[:18]) + " y"),  # a short quote
        (4, "x " + stock + " y"),
        (5, re.sub("|".join(names), lambda m: names[(names.index(m.group()) + 1) % 8], re.sub(r"\d+", "7", items[6][1]))),
        (6, items[7][1].upper().replace(",", "").replace(" ", "\n")),
        (7, None),
        (8, ""),
        (9, items[4][1]),
    ] + [(20 + k, sentence(30)) for k in range(400)]
    d = spark.createDataFrame([(a, b, 0) for a, b in docs], "doc_id bigint, text string, item_id int")
    i = spark.createDataFrame([*items, (99, None), (98, "")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(d, i).collect()}
    assert got == {(1, 4), (2, 5), (6, 7), (9, 4)}
    assert leakage.leaks(d.limit(0), i).count() == 0
    assert leakage.leaks(d, i.limit(0)).count() == 0
    small = {(r.doc_id, r.item_id) for r in leakage.leaks(d, i, index_limit=150).collect()}
    assert small == got
    # Other parameters, bound one to one: reported as a template, not as a leak.
    turned = re.sub("|".join(names), lambda m: names[(names.index(m.group()) + 3) % 8], re.sub(r"\d+", lambda m: str(5000 + int(m.group())), items[8][1]))
    again = d.unionByName(spark.createDataFrame([(10, "y " + turned, 0)], "doc_id bigint, text string, item_id int"))
    for limit in (150, 200_000):
        rows = {(r.doc_id, r.item_id, r.words) for r in leakage.leaks(again, i, templates=True, index_limit=limit).collect()}
        assert {r[:2] for r in rows if r[2]} == got and {r[:2] for r in rows if not r[2]} == {(10, 8)}
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(again, i).collect()} == got


def test_mix_shares_and_caps(spark):
    rows = [(k, "big" if k % 3 else "Mid ", RNG.randint(50, 150)) for k in range(3000)] + [(5000 + k, "small", 100) for k in range(40)] + [(9000, None, 100), (9001, "other", 10), (9002, "big", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint").withColumn("source", mixing.clean_source("source"))
    targets = spark.createDataFrame([("big", 0.5, 1), ("MID", 0.3, 2), ("small", 0.2, 3)], "source string, target_share double, max_repeats int")
    got = mixing.mix(docs, targets).collect()
    used = {s: sum(r.tokens * r.copies for r in got if r.source == s) for s in ("big", "mid", "small")}
    total = sum(used.values())
    for s, want in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert used[s] / total == pytest.approx(want, abs=0.02)
    assert max(r.copies for r in got if r.source == "small") == 3
    assert max(r.copies for r in got if r.source == "big") == 1
    assert len({r.doc_id for r in got}) == len(got)
    assert mixing.mix(docs.limit(0), targets).count() == 0
    # A source without documents is left out, the others keep their proportions.
    rest = mixing.mix(docs.where("source != 'small'"), targets).collect()
    used = {s: sum(r.tokens * r.copies for r in rest if r.source == s) for s in ("big", "mid", "small")}
    assert used["small"] == 0 and used["big"] / (used["big"] + used["mid"]) == pytest.approx(0.5 / 0.8, abs=0.02)
    assert mixing.mix(docs.where("source = 'other'"), targets).count() == 0


def test_tokens_of_long_texts_are_those_of_the_whole():
    import base64

    import tiktoken

    rng = random.Random(8)
    with open(tokenizers.vocabulary(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("public", pat_str=tokenizers.pattern(), mergeable_ranks=ranks, special_tokens={})
    for _ in range(20):
        text = "".join(rng.choice(["word", "s", " ", "  ", "\n", "'ll", "12", "é", "日本", ".", "-", "\t", "x"]) for _ in range(3000))
        for long in (1, 7, 100):
            parts = list(mixing.pieces(text, tokenizers.pattern(), long))
            assert "".join(parts) == text and sum(len(enc.encode_ordinary(p)) for p in parts) == len(enc.encode_ordinary(text))


def leaked(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    return {(r.doc_id, r.item_id) for r in leakage.leaks(d, i, **kw).collect()}


def test_widely_leaked_item_is_no_stock(spark):
    """Half of the rows hold one item, in texts of their own and in copies; a lone sentence of it elsewhere is stock."""
    item = " ".join(sentence(15) for _ in range(4))
    stock = sentence(28)
    docs = [(k, f"{sentence(12)} {item} {sentence(12)}") for k in range(30)] + [(100 + k, f"copy {item} end") for k in range(30)]
    docs += [(200 + k, f"{sentence(12)} {stock} {sentence(12)}") for k in range(20)] + [(300 + k, sentence(40)) for k in range(40)]
    got = leaked(spark, docs, [(1, item), (2, sentence(30) + " " + stock)])
    assert got == {(k, 1) for k in [*range(30), *range(100, 130)]}


def test_copies_of_an_item_and_overlapping_items_leak(spark):
    """Sentences items share are stock only if the documents hold them elsewhere."""
    parts = [sentence(16) for _ in range(6)]
    stock = sentence(28)
    items = [(1, " ".join(parts[:4])), (2, " ".join(parts[:4]).upper()), (3, " ".join(parts[2:])), (4, sentence(30) + " " + stock), (5, sentence(30) + " " + stock)]
    docs = [(1, f"{sentence(9)} {parts[0]} {parts[1]} {sentence(9)}"), (2, f"{sentence(9)} {parts[2]} {parts[3]} {sentence(9)}"), (3, f"{sentence(9)} {stock} {sentence(9)}"), (4, f"{sentence(9)} {items[3][1]}")]
    assert leaked(spark, docs, items) == {(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (4, 4)}


@pytest.mark.parametrize("limit", [1, 40, 150, 200_000])
def test_leaks_do_not_depend_on_the_block_size(spark, limit):
    """Two items share a stock sentence that the documents hold once by itself."""
    rng = random.Random(11)
    made = lambda n: " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."
    stock = made(28)
    items = [(k, " ".join(made(14) for _ in range(3)) + (" " + stock if k in (0, 7) else "")) for k in range(8)]
    docs = [(k, f"{made(9)} {items[k][1]} {made(9)}") for k in range(1, 7)] + [(20, f"{made(9)} {stock} {made(9)}"), (21, f"{made(9)} {items[0][1]}")]
    assert leaked(spark, docs, items, index_limit=limit) == {*((k, k) for k in range(1, 7)), (21, 0)}


def test_numerals_of_any_length_do_not_matter():
    """Sentences, 20-word runs and 40-character runs that differ in their numbers alone."""
    own = [" ".join(RNG.choice(WORDS) for _ in range(9)) for _ in range(3)]
    numbers = ["9", "10", "492", "1.5", "2", "1,000,000", "12:30", "3"]
    text = " ".join(f"At step {n} {s}." for n in numbers for s in own)
    size = lambda t: len(re.findall(r"\w", t))
    first = " ".join(f"At step 9 {s}." for s in own)
    assert repetition.share(text) == pytest.approx(1 - size(first) / size(text), abs=1e-9)
    words = [RNG.choice(WORDS) for _ in range(20)]
    run = lambda n: " ".join([*words[:10], n, *words[10:]])
    assert repetition.share(f"uno {run('7')} due {run('1234')} tre") == pytest.approx(size(run("1234")) / size(f"uno {run('7')} due {run('1234')} tre"))
    japanese = "".join(chr(0x4E00 + RNG.randrange(3000)) for _ in range(45))
    assert repetition.share(f"一{japanese[:20]}9{japanese[20:]}二{japanese[:20]}10{japanese[20:]}") == pytest.approx(47 / 95)
    assert repetition.share("776 mm " * 100) > 0.7


def test_tags_of_any_length_go_and_comparisons_stay():
    long = "<a href=\"" + "x" * 500 + "\" title='" + "y" * 300 + "'>"
    assert words.words(f"one {long}two</a> <br/> three") == ["one", "two", "three"]
    assert words.words("if a <b, then c and d> e") == ["if", "a", "b", "then", "c", "and", "d", "e"]


def test_sentences_across_single_line_breaks():
    own = [RNG.choice(WORDS) for _ in range(14)]
    other = [RNG.choice(WORDS) for _ in range(14)]
    wrap = lambda ws, k: "\n".join(" ".join(ws[i : i + k]) for i in range(0, len(ws), k)) + "."
    text = f"{wrap(own, 5)} Uno {wrap(other, 4)}\n\nDue tre. {wrap(own, 6)} Quattro.\n"
    size = len(re.findall(r"\w", text))
    assert repetition.share(text) == pytest.approx(sum(map(len, own)) / size)
    assert repetition.share(f"{wrap(own, 5)} Uno {wrap(other, 4)}") == 0.0
