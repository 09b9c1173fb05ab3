"""Training-data operators against brute force, round trips and hand-made cases."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm import (
    curriculum, decision_list, induced_sort, lattice, passages, secret_tests, simhash,
    spaced_seeds, substring_windows, template,
)
from tallyloom.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASH = ("key", "hash", "word", "start", "kept", "size", "label", "count", "n_words", "item", "words")


def prose(n, seed, words=400):
    rng = random.Random(seed)
    stock = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 9)))
             for _ in range(words)]
    return " ".join(rng.choice(stock) for _ in range(n))


def docs_of(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and one-word texts, repeated rows, a long text, and clashing columns."""
    long = prose(30_000, 5)
    rows = [(1, None, "en", None, None), (2, "", None, "a", 0), (None, "lone words", "en", "a", 10),
            (3, "same row here", "en", "a", 13), (3, "same row here", "en", "a", 13),
            (4, long, "en", "b", len(long)), (5, "x", "en", "b", 1), (6, " \n\t ", "en", "b", 4)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit(7).alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 0), (3, 1, 0), (None, 1, 0)],
                                 "doc_id long, quality int, toxic int")


def operators(spark, labels):
    bench = spark.createDataFrame([(1, prose(30, 9)), (None, None)], "item_id long, text string")
    return {
        "secrets": secret_tests.find_secrets, "redact": secret_tests.redact_secrets,
        "judge": lambda d: decision_list.judge(d, labels),
        "keep_good": lambda d: decision_list.keep_good(d, labels),
        "bytes": induced_sort.remove_repeated_bytes,
        "windows": substring_windows.remove_repeated_windows,
        "classify": lambda d: passages.classify(d, labels),
        "place": lambda d: curriculum.place(d.select("*").drop("size").withColumn(
            "size", curriculum.document_sizes(d, "text"))),
        "contaminated": lambda d: spaced_seeds.contaminated(d, bench),
        "decontaminate": lambda d: spaced_seeds.decontaminate(d, bench),
        "mix": curriculum.mix, "score": lattice.score_documents,
        "near": simhash.near_duplicates, "keep_one": simhash.keep_one,
    }


ROWS = {"secrets": 8, "redact": 8, "judge": 8, "bytes": 8, "windows": 8, "classify": 8,
        "contaminated": 0, "decontaminate": 8, "score": 8, "near": 8, "place": 8}


@pytest.mark.parametrize("name", [
    "secrets", "redact", "judge", "keep_good", "bytes", "windows", "classify", "contaminated",
    "decontaminate", "mix", "place", "score", "near", "keep_one"])
def test_odd_rows_and_empty_tables(spark, odd, labels, name):
    run = operators(spark, labels)[name]
    rows = run(odd).collect()
    if name in ROWS:
        assert len(rows) == ROWS[name]
    empty = run(odd.where("false"))
    assert empty.collect() == []
    if name in ("redact", "keep_good", "decontaminate", "keep_one"):
        assert empty.columns == odd.columns
    if name == "near":
        zero = [r for r in rows if r.fingerprint == "0" * 16]
        assert len(zero) == 3 and {r.component_id for r in zero} == {1}
    if name == "keep_one":
        assert sum(r.doc_id == 3 for r in rows) == 1
    if name == "keep_good":
        assert {r.doc_id for r in rows} <= {4}
    # Contents of null, empty, blank and repeated rows, not their number alone.
    if name == "secrets":
        assert all((r.n_assign, r.n_access, r.n_hex, r.spans) == (0, 0, 0, "") for r in rows)
    if name == "redact":
        assert sorted(r.text or "" for r in rows) == sorted(r.text or "" for r in odd.collect())
    if name == "judge":
        assert {r.doc_id: r.n_words for r in rows} == {1: 0, 2: 0, None: 2, 3: 3, 4: 30_000, 5: 1, 6: 0}
        assert all(r.base_failed and not r.kept for r in rows if r.doc_id != 4)
    nothing = hashlib.sha256(b"").hexdigest()
    if name in ("bytes", "windows"):
        short = [r for r in rows if r.doc_id in (1, 2)]
        assert len(short) == 2 and all(r.n_removed == 0 and r.kept_sha256 == nothing for r in short)
        assert len({r.kept_sha256 for r in rows if r.doc_id == 3}) == 1
    if name == "place":
        assert {r.doc_id: (r.size, r.taken > 0) for r in rows if r.doc_id in (1, 2, 6)} == {
            1: (0, False), 2: (0, False), 6: (0, False)}
    if name == "score":
        assert len({r.score for r in rows if r.doc_id in (1, 2, 6)}) == 1


# Secrets


def test_base_spans_and_random_strings(spark):
    rng = random.Random(1)
    key = "".join(rng.choice(secret_tests.UP + secret_tests.LOW + secret_tests.DIGITS) for _ in range(40))
    texts = [
        'x PassWord = "abcd1234" y', "token=short", "token=token:abcdefghij",
        "AKIAABCDEFGHIJKL1 AKIA12", "a" * 31 + " " + "0f" * 16, f"see {key} there", prose(500, 2),
        "inthenationaldistributions of-the-very-long-winded-kind aaaaaaaaaaaaaaaaaaaaaa1",
    ]
    rows = {r.doc_id: r for r in secret_tests.find_secrets(docs_of(spark, texts)).collect()}
    counts = [(rows[i].n_assign, rows[i].n_access, rows[i].n_hex, rows[i].n_random) for i in range(8)]
    assert counts == [(1, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0),
                      (0, 0, 0, 1), (0, 0, 0, 0), (0, 0, 0, 0)]
    assert rows[0].spans == "assign:2:22"
    assert rows[5].spans == f"random:4:{4 + len(key)}"
    assert rows[4].base_sha256 == hashlib.sha256(b"hex:32:64").hexdigest()
    clean = {r.doc_id: r.text for r in secret_tests.redact_secrets(docs_of(spark, texts)).collect()}
    assert clean[5] == "see <secret> there" and clean[6] == texts[6]


def test_random_keys_without_digits_and_short_ones(spark):
    rng = random.Random(5)
    letters = secret_tests.UP + secret_tests.LOW
    keys = ["".join(rng.choice(letters) for _ in range(40)) for _ in range(4)]
    keys += ["".join(rng.choice(letters + secret_tests.DIGITS) for _ in range(16)) for _ in range(4)]
    texts = [f"{prose(60, 70 + i)} internationalization see {k} there" for i, k in enumerate(keys)]
    texts += [prose(300, 90 + i) + " counterrevolutionaries and/or self-contradictory" for i in range(9)]
    rows = {r.doc_id: r for r in secret_tests.find_secrets(docs_of(spark, texts)).collect()}
    for i, k in enumerate(keys):
        at = texts[i].index(k)
        assert rows[i].spans == f"random:{at}:{at + len(k)}"
    assert not any(rows[i].n_random for i in range(len(keys), len(texts)))
    clean = {r.doc_id: r.text for r in secret_tests.redact_secrets(docs_of(spark, texts)).collect()}
    assert all(k not in clean[i] for i, k in enumerate(keys))


def test_battery_tells_random_from_regular():
    rng = random.Random(3)
    code = secret_tests.CODES[1]
    passed = sum(secret_tests.battery("".join(rng.choice("0123456789abcdef") for _ in range(40)), code)
                 >= secret_tests.PASS for _ in range(300))
    assert passed > 285
    assert secret_tests.battery("0123456789abcdef" * 4, code) < secret_tests.PASS
    assert secret_tests.battery("a" * 40, code) < secret_tests.PASS


# Quality rules


def brute_counts(text):
    words = decision_list_words(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    many = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if decision_list_words(x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(covered))


def decision_list_words(text):
    return [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if w]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n#\t\xa0", max_size=60), min_size=1, max_size=6))
def test_counts_match_brute_force(texts):
    found = decision_list.text_statistics([t.encode() for t in texts])
    got = list(zip(*[found[c].tolist() for c in decision_list.COUNTS], strict=True))
    assert got == [brute_counts(t) for t in texts]


def test_learned_list_finds_a_conjunction():
    rng = np.random.default_rng(2)
    x = {"a": rng.random(3000), "b": rng.random(3000), "c": rng.random(3000)}
    bad = ((x["a"] > 0.7) & (x["b"] < 0.3)) | (x["c"] > 0.95)
    rules = decision_list.learn_rules(x, bad)
    hit = np.zeros(3000, bool)
    for rule in rules:
        hit |= decision_list._covers(rule, x)
    assert (hit == bad).mean() > 0.97
    assert decision_list.learn_rules({"a": rng.random(600)}, rng.random(600) < 0.1) == []


# Repeated strings and windows


def brute_repeats(units, window):
    seen = Counter(tuple(u[i:i + window]) for u in units for i in range(len(u) - window + 1))
    out = []
    for u in units:
        gone = [False] * len(u)
        for i in range(len(u) - window + 1):
            if seen[tuple(u[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        out.append(gone)
    return out


def repeated_texts(seed):
    rng = random.Random(seed)
    shared = prose(60, seed)
    line = prose(14, seed + 1)
    texts = []
    for i in range(40):
        kind = i % 5
        own = prose(rng.randint(1, 90), 100 * seed + i, 5000)
        if kind == 1:
            own = f"{own} {shared} {prose(20, 7 * i + seed)}"
        elif kind == 2:
            words = shared.split()
            words[rng.randrange(60)] = "changed"
            own = f"{prose(3, i)} é {' '.join(words)}"
        elif kind == 3:
            own = f"{own} {line} {prose(9, i)} {line}"
        texts.append(own)
    return [*texts, texts[1], texts[1], "ab " * 80, None, ""]


@pytest.mark.parametrize("names", [20_000, 3, 1])
def test_repeated_bytes_match_brute_force(spark, names):
    texts = repeated_texts(3)
    raw = [(t or "").encode() for t in texts]
    expected = brute_repeats(raw, 40)
    got = induced_sort.remove_repeated_bytes(
        docs_of(spark, texts), length=40, sample_gram=9, run_names=names).collect()
    for r in got:
        gone, data = expected[r.doc_id], raw[r.doc_id]
        assert bytes(r.kept) == bytes(b for b, g in zip(data, gone, strict=True) if not g)
        runs = sum(k for k, _ in itertools.groupby(gone))
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(data), sum(gone), runs)


def test_induced_order_against_plain_comparison():
    rng = random.Random(8)
    for _ in range(20):
        rows = sorted((rng.randrange(4), "".join(rng.choice("ab") for _ in range(8)).encode(),
                       "".join(rng.choice("ab") for _ in range(rng.randrange(7))).encode())
                      for _ in range(40))
        keys, rights, lefts = (list(c) for c in zip(*rows, strict=True))
        got = induced_sort.induce(np.array(keys), rights, lefts, 8)
        for i, (k, right, left) in enumerate(rows):
            for o in range(len(left) + 1):
                mine = (left[len(left) - o:] + right)[:8]
                same = sum(k == k2 and len(l2) >= o and (l2[len(l2) - o:] + r2)[:8] == mine
                           for k2, r2, l2 in rows)
                assert got[i, o] == (same > 1)


def test_repeated_windows_match_brute_force(spark):
    texts = repeated_texts(4)
    words = [(t or "").split() for t in texts]
    expected = brute_repeats(words, 7)
    for r in substring_windows.remove_repeated_windows(docs_of(spark, texts), window=7).collect():
        kept = " ".join(w for w, g in zip(words[r.doc_id], expected[r.doc_id], strict=True) if not g)
        assert r.kept_text == kept and r.n_removed == sum(expected[r.doc_id])
        assert r.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


# Quality classifier


def test_classifier_on_held_out_documents(spark):
    texts, marks = [], []
    for i in range(300):
        bad = i % 4 == 0
        text = prose(150, i)
        texts.append(text.upper().replace(" ", "!! ") if bad else text)
        marks.append((i, 0 if bad else 1, 0))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    rows = passages.classify(docs_of(spark, texts), labels).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([r.predicted == marks[r.doc_id][1] for r in held]) > 0.97
    again = passages.classify(docs_of(spark, texts), labels).collect()
    assert {r.doc_id: r.score for r in rows} == {r.doc_id: r.score for r in again}


def plain_score(w, passages_of_one):
    """Gated attention over the passages of one document, one number at a time."""
    hidden, logits = [], []
    for x in passages_of_one:
        x = [(v - m) / s for v, m, s in zip(x, w["mean"], w["scale"], strict=True)]
        h = [math.tanh(sum(v * row[k] for v, row in zip(x, w["encode"], strict=True)) + b)
             for k, b in enumerate(w["bias"])]
        gated = 0.0
        for u, attend in enumerate(w["attend"]):
            t = math.tanh(sum(v * row[u] for v, row in zip(h, w["tanh"], strict=True)))
            g = 1 / (1 + math.exp(-sum(v * row[u] for v, row in zip(h, w["gate"], strict=True))))
            gated += t * g * attend
        hidden.append(h)
        logits.append(gated)
    total = sum(map(math.exp, logits))
    z = [sum(math.exp(a) / total * h[k] for a, h in zip(logits, hidden, strict=True))
         for k in range(len(hidden[0]))]
    return 1 / (1 + math.exp(-sum(v * o for v, o in zip(z, w["out"], strict=True)) - w["shift"][0]))


def test_attention_against_a_plain_loop():
    rng = np.random.default_rng(5)
    sizes = [1, 3, 7, 2]
    begin = np.concatenate([[0], np.cumsum(sizes)])
    x = rng.normal(size=(begin[-1], passages.WIDTH))
    label = np.array([0.0, 1.0, 1.0, 0.0])
    w = passages.learn(x, begin, label, hidden=5, units=3, rounds=15)
    got = passages._pass(w, passages._scaled(w, x), begin)
    expected = [plain_score(w, x[a:b]) for a, b in itertools.pairwise(begin)]
    assert got["p"] == pytest.approx(expected, abs=1e-4)
    for a, b in itertools.pairwise(begin):
        assert got["a"][a:b].sum() == pytest.approx(1, abs=1e-5)
    # Learning goes down the loss.
    loss = [-np.mean(label * np.log(p) + (1 - label) * np.log(1 - p)) for p in (
        passages._pass(v, passages._scaled(v, x), begin)["p"]
        for v in (passages.learn(x, begin, label, 5, 3, r) for r in (1, 15, 60)))]
    assert loss[0] > loss[1] > loss[2]


# Decontamination


@pytest.mark.parametrize("rows", [0, 100_000])
def test_leaks_with_replaced_words(spark, rows):
    items = [prose(40, 1000 + i, 3000) for i in range(6)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    words = items[2].split()
    for k in range(4, 40, 9):
        words[k] = "other"
    texts = [prose(200, 50), f"{prose(31, 51)} {items[0].upper()}! {prose(5, 52)}",
             f"{prose(7, 53)} {' '.join(words)}", f"{' '.join(items[3].split()[5:25])} {prose(9, 54)}",
             f"{prose(40, 55)} {' '.join(items[4].split()[:7])}", None]
    found = spaced_seeds.contaminated(docs_of(spark, texts), bench, broadcast_rows=rows).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(1, 0), (2, 2), (3, 3)]
    kept = spaced_seeds.decontaminate(docs_of(spark, texts), bench).collect()
    assert sorted(r.doc_id for r in kept) == [0, 4, 5]


def replaced_copies(words, places):
    return " ".join(f"x{i}" if i in places else w for i, w in enumerate(words))


def brute_words(text):
    return regex.sub(r"[^\p{L}\p{N}\x20\x09-\x0D]+", "", (text or "").lower()).split()


def brute_leaks(texts, items):
    """(document, item): score, by laying every item along every document at every shift."""
    found = {}
    for d, text in enumerate(texts):
        words = brute_words(text)
        for i, item in enumerate(map(brute_words, items)):
            for shift in range(1 - len(item), len(words)):
                run = best = equal = 0
                for q in range(max(0, -shift), min(len(item), len(words) - shift)):
                    same = item[q] == words[q + shift]
                    run, equal = max(run + (1 if same else -2), 0), equal + same
                    best = max(best, run)
                if best and (best >= min(12, len(item)) or 10 * equal >= 8 * len(item)):
                    found[d, i] = max(found.get((d, i), 0), best)
    return found


def leaks_of(spark, texts, items, **options):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r.score for r in spaced_seeds.contaminated(
        docs_of(spark, texts), bench, **options).collect()}


def test_leaks_against_brute_force_over_all_shifts(spark):
    rng = random.Random(12)
    items = [prose(n, 2000 + n, 3000) for n in (1, 2, 3, 5, 6, 7, 8, 9, 10, 12, 14, 16, 18, 20, 24, 30, 36, 40)]
    texts = []
    for k, item in enumerate(items):
        words = item.split()
        for share in (0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3):
            places = set(rng.sample(range(len(words)), round(share * len(words))))
            copy = replaced_copies(words, places).split()
            # Whole copies, and stretches cut off at the document's start or end.
            low, high = rng.choice([(0, len(copy)), (0, len(copy)), (len(copy) // 3, len(copy)),
                                    (0, 2 * len(copy) // 3 + 1)])
            before = "" if low else f"{prose(rng.randrange(9), 700 + k, 5000)} "
            after = "" if high < len(copy) else f" {prose(rng.randrange(9), 800 + k, 5000)}"
            texts.append(before + " ".join(copy[low:high]) + after)
    found, expected = leaks_of(spark, texts, items), brute_leaks(texts, items)
    assert found == expected and len(found) > 50


def test_leaks_of_short_items_with_replaced_words(spark):
    items = [prose(n, 2000 + n, 3000) for n in (10, 15, 16, 18, 20, 24)]
    texts = []
    for i, item in enumerate(items):
        w = item.split()
        for k in range(1, len(w) - 8 + 1):
            places = set(range(8, len(w), 2)[:k]) | set(range(9, len(w), 2)[:max(k - (len(w) - 7) // 2, 0)])
            texts.append(f"{prose(5 + k % 3, 900 + i, 9000)} {replaced_copies(w, places)} end")
    assert leaks_of(spark, texts, items) == brute_leaks(texts, items)


def test_items_of_words_that_are_everywhere(spark):
    """Short items whose words fill a document give many hits; none is lost, none gathered."""
    items = ["of the", "the", "of the of the of the of the of the of the of", "the end of the line"]
    texts = ["of the " * 3000, "the end", "of of of", "a the line of the end of the line x", None, ""]
    found = leaks_of(spark, texts, items)
    assert {k: v for k, v in found.items() if k[0] > 0} == {
        k: v for k, v in brute_leaks(["", *texts[1:]], items).items() if k[0] > 0}
    assert {i for d, i in found if d == 0} == {0, 1, 2}


def test_leaks_at_every_offset_and_of_short_items(spark):
    rng = random.Random(8)
    items = [prose(n, 3000 + n, 3000).split() for n in (2, 4, 5, 6, 7, 8, 9, 10, 12, 15, 16, 20, 30)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)],
                                  "item_id long, text string")
    texts, made = [], []
    for i, w in enumerate(items):
        allowed = len(w) - math.ceil(0.8 * len(w))
        for before in range(6):
            for k in range(allowed + 2):
                places = set(rng.sample(range(len(w)), k))
                texts.append(f"{' '.join(f'a{b}' for b in range(before))} {replaced_copies(w, places)} z")
                made.append((i, k <= allowed))
    found = {(r.doc_id, r.item_id) for r in spaced_seeds.contaminated(
        docs_of(spark, texts), bench).collect()}
    for d, (i, near) in enumerate(made):
        if near:
            assert (d, i) in found
        elif len(items[i]) < 12:
            assert (d, i) not in found
    kept = spaced_seeds.decontaminate(docs_of(spark, texts), bench)
    assert kept.count() == len(texts) - len({d for d, _ in found})


# Curriculum


def test_mix_meets_targets(spark):
    texts = [prose(10 + i % 90, i) for i in range(200)]
    docs = docs_of(spark, texts).withColumn(
        "source", F.when(F.col("doc_id") < 150, "big").when(F.col("doc_id") < 190, "mid"))
    sizes = docs.select("doc_id", "source", curriculum.document_sizes(docs, "text").alias("size"))
    rows = curriculum.assign(sizes).collect()
    per = {}
    for r in rows:
        assert r.taken <= 2 * r.size
        per.setdefault(r.source, [r.target, 0, r.source_size])[1] += r.taken
    assert sum(t for t, _, _ in per.values()) == pytest.approx(1.5 * sum(r.size for r in rows))
    for target, taken, size in per.values():
        assert taken == math.floor(target) and target <= 2 * size
    stream = curriculum.mix(docs).collect()
    assert sum(r.words for r in stream) == sum(r.taken for r in rows)
    assert all(0 <= r.position <= 1 for r in stream)


def test_shares_follow_their_schedules(spark):
    """Each tenth of the stream holds of every source what its schedule has for it."""
    texts = [prose(10, i) for i in range(3000)]
    docs = docs_of(spark, texts)
    sizes = docs.select("doc_id", "source", curriculum.document_sizes(docs, "text").alias("size"))
    rows = curriculum.stream(sizes).orderBy("rank").collect()
    assert [r.rank for r in rows] == list(range(1, len(rows) + 1))
    assert all(a.position <= b.position for a, b in itertools.pairwise(rows))
    for k, source in enumerate(("s0", "s1", "s2")):
        mine = [r for r in rows if r.source == source]
        total = sum(r.words for r in mine)
        fine = np.linspace(0, 1, 10_001)
        weight = np.interp(fine, *zip(*curriculum.SCHEDULES[k], strict=True))
        demand = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2)])
        for tenth in range(10):
            taken = sum(r.words for r in mine if tenth <= 10 * r.position < tenth + 1) / total
            due = (demand[1000 * tenth + 1000] - demand[1000 * tenth]) / demand[-1]
            assert taken == pytest.approx(due, abs=0.02)
    placed = {r.doc_id: r for r in curriculum.place(sizes).collect()}
    uses = {}
    for r in rows:
        uses.setdefault(r.doc_id, []).append(r)
    for i, r in placed.items():
        mine = uses.get(i, [])
        assert (r.taken, r.n_uses) == (sum(u.words for u in mine), len(mine))
        assert (r.first_rank, r.first_position) == (
            (min(u.rank for u in mine), min(u.position for u in mine)) if mine else (None, None))
    assert len(placed) == 3000


def test_inverse_demand_inverts_the_integral(spark):
    knots = ((0.0, 0.0), (0.25, 2.0), (0.5, 0.0), (0.75, 0.0), (1.0, 1.0))
    df = spark.range(101).select((F.col("id") / 100).alias("u"))
    got = df.select("u", curriculum.inverse_demand(F.col("u"), knots).alias("t")).collect()
    fine = np.linspace(0, 1, 200_001)
    weight = np.interp(fine, *zip(*knots, strict=True))
    total = np.concatenate([[0], np.cumsum((weight[1:] + weight[:-1]) / 2)])
    for r in got:
        assert np.interp(r.t, fine, total / total[-1]) == pytest.approx(r.u, abs=1e-4)


# LM scoring


def test_marginal_is_the_sum_over_segmentations():
    pieces = ["▁a", "▁", "a", "b", "ab", "ba", "▁ab", *[f"<0x{i:02X}>" for i in range(256)]]
    rng = np.random.default_rng(1)
    logs = np.log(rng.dirichlet(np.ones(len(pieces)))).tolist()
    model = lattice.Lattice(pieces, logs)

    def total(text):
        if not text:
            return 1.0
        out = sum(math.exp(logs[i]) * total(text[len(p):])
                  for i, p in enumerate(pieces[:7]) if text.startswith(p))
        if text[0] not in pieces:
            spelled = math.exp(sum(logs[7 + b] for b in text[0].encode()))
            out += spelled * total(text[1:])
        return out

    for word in ("ab", "abba", "aéb", "baab", "z"):
        assert model.marginal(word) == pytest.approx(math.log(total("▁" + word)))
        counts = np.zeros(len(pieces))
        model.expected(word, 1.0, counts)
        assert counts.sum() > 0


def test_long_words_are_summed_slab_by_slab(monkeypatch):
    pieces = ["▁a", "▁", "a", "b", "ab", "ba", "aba", "▁ab", *[f"<0x{i:02X}>" for i in range(256)]]
    logs = np.log(np.random.default_rng(2).dirichlet(np.ones(len(pieces)))).tolist()
    model, rng = lattice.Lattice(pieces, logs), random.Random(3)
    words = ["".join(rng.choice("abé") for _ in range(n)) for n in (1, 7, 60, 300)]
    whole = [model.marginal(w) for w in words]
    counts = np.zeros(len(pieces))
    for w in words:
        model.expected(w, 2.0, counts)
    for slab in (1, 2, 5, 64):
        monkeypatch.setattr(lattice, "SLAB", slab)
        assert [model.marginal(w) for w in words] == pytest.approx(whole, rel=1e-12)
        again = np.zeros(len(pieces))
        for w in words:
            model.expected(w, 2.0, again)
        assert again == pytest.approx(counts, rel=1e-9)


def test_a_very_long_word_needs_little_memory(spark):
    import tracemalloc

    model = lattice.Lattice(*lattice.load_pieces(lattice.MODEL))
    word = "abcde" * 100_000
    tracemalloc.start()
    score = model.marginal(word)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # A number and the text's own copy for every character, and one slab of arcs.
    assert score < 0 and peak < 30 * len(word)


@pytest.mark.parametrize("frequent", [100_000, 3])
def test_scores_against_brute_force(spark, frequent):
    texts = [prose(50, i, 60).upper() if i % 2 else prose(50, i, 60) for i in range(40)] + [None, ""]
    docs = docs_of(spark, texts)
    got = {r.doc_id: r for r in lattice.score_documents(docs, frequent_words=frequent).collect()}
    tokens = [[*(t or "").lower().split(), None] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    c = Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(tokens):
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        assert got[i].base_score == pytest.approx(base)
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (
            held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert got[i].score < 0
    assert got[40].score == got[41].score


# SimHash


def brute_fingerprint(text):
    words = (text or "").lower().split()
    shingles = [" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 8)
    texts = []
    for i in range(60):
        base = prose(400, i % 20)
        words = base.split()
        if i >= 20:
            words[i] = f"w{i}"
        texts.append(" ".join(words))
    texts += [texts[0], texts[0].upper(), None, "", "one two"]
    prints = [brute_fingerprint(t) for t in texts]
    label = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if bin(prints[a] ^ prints[b]).count("1") <= 2 and label[a] != label[b]:
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = [new if x == old else x for x in label]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs_of(spark, texts)).collect()}
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i in range(len(texts))] == label
    kept = sorted(r.doc_id for r in simhash.keep_one(docs_of(spark, texts)).collect())
    assert kept == sorted(set(label))


def test_bit_sliced_links_against_all_pairs():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = np.concatenate([base, base ^ np.uint64(3), base[:20] ^ np.uint64(1 << 40),
                             base[:9] ^ np.uint64(0b10101)])
    rng.shuffle(prints)
    groups = np.sort(rng.integers(0, 3, len(prints)))
    for radius in (0, 1, 2, 3, 5):
        expected = list(range(len(prints)))
        for a, b in itertools.combinations(range(len(prints)), 2):
            if groups[a] == groups[b] and bin(int(prints[a] ^ prints[b])).count("1") <= radius:
                old, new = max(expected[a], expected[b]), min(expected[a], expected[b])
                expected = [new if x == old else x for x in expected]
        assert simhash.linked(prints, groups, radius).tolist() == expected


def brute_keep_near(rows):
    """Least id of every group linked by fingerprints of two or fewer differing bits."""
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    label = {i: i for i, _ in rows}
    for (i, a), (j, b) in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= 2 and label[i] != label[j]:
            old, new = max(label[i], label[j]), min(label[i], label[j])
            label = {k: new if v == old else v for k, v in label.items()}
    return sorted(set(label.values()))


def test_stage_keeps_one_of_each_near_group(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.near_dedup(spark, docs, sf_dir)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in kept.collect()) == brute_keep_near(rows)
    assert kept.columns == docs.columns


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    hub = [(9, i) for i in range(1000, 1200)]
    edges = spark.createDataFrame(path + hub + [(5, 5)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert all(got[i] == 100 for i in range(101, 161))
    assert all(got[i] == 9 for i in range(1000, 1200))


# Chat templates


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "<|x\\n"]),
                          st.text(alphabet="<|\\>aim_end\n é", max_size=30)), max_size=5))
def test_formatted_conversations_read_back(turns):
    messages = [{"role": r, "text": t} for r, t in turns]
    render = template.compile_template(template.CHAT)
    out = "".join(p for p, _ in render(messages))
    assert out.count("<|im_start|>") == out.count("<|im_end|>\n") == len(turns)
    reader = template.Reader()
    reader.feed(render(messages))
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    assert reader.text_digest.hexdigest() == hashlib.sha256(said.encode()).hexdigest()
    assert reader.loss_digest.hexdigest() == hashlib.sha256(loss.encode()).hexdigest()
    assert (reader.turns, reader.loss_chars, reader.chars) == (len(turns), len(loss), len(out))


def test_template_language():
    source = ("{# note #}{{ 'a' + 'b' | upper }}{% if false %}x{% elif true %}y{% else %}z{% endif %}"
              "{% for m in messages -%}  {% if loop.first and not loop.last %}[{% endif %}"
              "{{ loop.index }}{{ m.role }}{% if loop.last or m.role == 'q' %}]{% endif %}{% endfor %}")
    tree = template.fold(template.parse(source))
    assert tree[0] == template.Output(template.Const("aBy"))
    run = template.compile_template(source)
    got = "".join(p for p, _ in run([{"role": r, "text": ""} for r in "pqr"]))
    assert got == "aBy[1p2q]3r]"


@pytest.mark.parametrize("bad", [
    "{{ m.text }}", "{% for m in x %}{% endfor %}", "{% for m in messages %}{{ m.__class__ }}{% endfor %}",
    "{% for m in messages %}{{ m }}{% endfor %}", "{{ open('x') }}", "{% if true %}", "{% endif %}",
    "{{ 'a' | exec }}", "{% import os %}", "{{ 'a' }%", "{{ }}"])
def test_refused_templates(bad):
    with pytest.raises(template.TemplateError):
        if template.compile_template(bad) and bad == "{{ 'a' }%":
            raise template.TemplateError("text only")


def test_conversations_of_odd_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "assistant", ""), (None, None, None, None),
            (None, 0, "user", "x"), (3, 0, "assistant", prose(20_000, 3))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.select("*", *[F.lit(7).alias(c) for c in ("id", "key", "size", "formatted", "n_turns", "loss")])
    got = {r.conv_id: r for r in template.format_digests(df).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 2, 2: 1, None: 2, 3: 1}
    assert (got[2].loss_chars, got[1].loss_chars) == (0, 0) and got[3].loss_chars == len(prose(20_000, 3))
    whole = {r.conv_id: r for r in template.format_conversations(df).collect()}
    assert {k: len(r.formatted) for k, r in whole.items()} == {
        k: r.formatted_chars for k, r in got.items()}
    for empty in (template.format_digests(df.where("false")), template.format_conversations(df.where("false"))):
        assert empty.collect() == []


def test_conversation_order_and_nulls(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, None, None, "first"),
            (1, 1, "assistant", "a"), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in template.format_digests(df).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(
        b"\nfirst\nuser\n\nassistant\na\nassistant\nb\n").hexdigest()
    assert (got[1].n_turns, got[1].loss_chars, got[None].n_turns) == (4, 2, 1)
    whole = {r.conv_id: r for r in template.format_conversations(df).collect()}
    text = whole[1].formatted
    assert [text[s.start:s.end] for s in whole[1].loss_spans] == ["a", "b"]
    assert len(text) == got[1].formatted_chars
    assert template.format_digests(df.where("false")).collect() == []


# Pipeline


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    judged = decision_list.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = {r.doc_id for r in judged.where("kept").collect()}
    out = corpus_pipeline.run(spark, sf_dir)
    rows = out.select("doc_id", "copy", "words", "position").collect()
    assert {r.doc_id for r in rows} <= kept <= ids
    prints = {r.doc_id: r.component_id for r in simhash.near_duplicates(
        docs.where(F.col("doc_id").isin(list(kept)))).collect()}
    assert all(prints[r.doc_id] == r.doc_id for r in rows)
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "near_dedup", "decontamination", "secret_scan", "mixing"]
    first = corpus_pipeline.STAGES[0][1](spark, docs, sf_dir)
    assert first.columns == docs.columns and first.count() == len(kept)
