"""Each operator on small tables with nulls, empty and repeated rows, clashing columns, and against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import bpe, components, decontaminate, jaccard, linededup, lm, pii, quality, sharding, store, substring, topk, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def texts():
    chance = random.Random(5)
    words = ["".join(chance.choice("abcdeé") for _ in range(chance.randint(2, 5))) for _ in range(60)]
    passage = " ".join(chance.choices(words, k=70))
    rows = []
    for i in range(60):
        own = " ".join(chance.choices(words, k=chance.choice([3, 40, 120])))
        rows.append((i, own if i % 3 else f"{own} {passage} {own}\nA repeated line of some length {i % 2}\nx"))
    near = " ".join(chance.choices(words, k=150)).split()
    for i in range(60, 70):
        own = list(near)
        own[chance.randrange(150)] = "edit"
        rows.append((i, " ".join(own)))
    rows += [(100, rows[0][1]), (101, rows[0][1]), (102, None), (103, ""), (104, " \n "), (105, "ß" * 40_000 + " Ünïcode 😀 'll  \n\n x"), (None, "alone"), (None, None), (106, "hi"), (107, "HI")]
    return rows


def test_topk(spark):
    rows = [(i, [float(i % 7), -0.5, i / 3]) for i in range(40)] + [(41, None), (42, [1.0, None, 0.0]), (43, [float("nan"), 0.0, 0.0]), (44, [math.inf, 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (45, []), (46, [2.0]), (10, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 10 == 0, k=4, chunk=3).orderBy("query_id", "rank").collect()]
    fine = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q in sorted({i for i, _ in fine if i % 10 == 0}):
        v = min(v for i, v in fine if i == q)
        best = sorted(((-sum(a * b for a, b in zip(v, c)), i) for i, c in fine if i != q))[:4]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert got == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_lines(spark, texts):
    got = {(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in linededup.dedup_lines(table(spark, texts).withColumns({c: F.lit(1) for c in ("key", "doc", "digest", "dropped", "lines", "_lines")})).collect()}
    key = lambda s: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", s).translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for i, t in texts:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 20:
                held.setdefault(key(line), set()).add(i)
    gone = {k: max(v) for k, v in held.items() if len(v) >= 3}
    assert gone
    for i, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or key(x) not in gone or i >= gone[key(x)]]
        assert (i, len(lines), len(lines) - len(kept), "\n".join(kept)) in got
    assert linededup.dedup_lines(table(spark, [])).count() == 0


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (5, 2), (7, 3)])
def test_line_runs_find_the_keeper_by_the_anti_join(spark, batches, fanout):
    chance = random.Random(batches)
    rows = [(i, "\n".join(f"a line that some texts have {chance.randrange(40)}" for _ in range(4))) for i in chance.sample(range(1000), 80)]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(table(spark, rows), batches=batches, fanout=fanout).collect()}
    holders = {}
    for i, t in rows:
        for line in t.split("\n"):
            holders.setdefault(line, set()).add(i)
    assert got == {i: "\n".join(x for x in t.split("\n") if len(holders[x]) < 3 or max(holders[x]) == i) for i, t in rows}


def test_line_runs_are_joined_where_they_lie(spark):
    keys = lambda *x: spark.createDataFrame([(k.encode(), 1, i) for k, i in x], "key binary, n_docs long, keeper long").groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))
    runs = linededup.LineRuns(spark, fanout=3)
    runs.add(keys(("a", 9), ("b", 8)))
    runs.add(keys(("a", 5), ("c", 4)))
    plan = runs.totals()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert [(r["key"], r["n_docs"], r["keeper"]) for r in runs.runs()[1].orderBy("key").collect()] == [(b"a", 1, None), (b"c", 1, 4)]
    assert sorted((bytes(r["key"]), r["n_docs"], r["keeper"]) for r in runs.totals().collect()) == [(b"a", 2, 9), (b"b", 1, 8), (b"c", 1, 4)]


def test_quality(spark):
    rows = [(i, ("good calm text " if i % 2 else "BAD!! JUNK$$ ") * (i % 9 + 1)) for i in range(200)] + [(None, None), (500, "")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (5, None), (500, 7)], "doc_id long, quality int")
    got = quality.quality_scores(table(spark, rows).withColumn("score", F.lit(9)), labels).collect()
    assert len(got) == len(rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)
    assert all(r["predicted"] == r["doc_id"] % 2 and 0 <= r["score"] <= 1 for r in got if r["doc_id"] is not None and r["doc_id"] < 200)
    assert {r["score"] for r in quality.quality_scores(table(spark, rows), labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(table(spark, []), labels).count() == 0


def test_quality_against_brute_force(spark):
    """Counts of n-grams, their log-ratios, and the dual problem solved by plain loops; then the scores of all texts."""
    chance = random.Random(3)
    rows = [(i, "".join(chance.choices("abc XY9!" if i % 3 else "abcde fg", k=chance.randint(0, 60)))) for i in range(90)] + [(900, "long " * 60_000)]
    labelled = [(i, int(i % 3 == 0)) for i in range(90)]
    train = [(t, y) for (i, t), (_, y) in zip(rows, labelled) if zlib.crc32(str(i).encode()) % 3 != 1]
    shape = lambda b: 97 if 97 <= b <= 122 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 128 if b > 127 else b

    def grams(t):
        raw, out = b" " + t.encode() + b" ", set()
        for kind, (data, sizes) in enumerate(((raw, (1, 2, 3)), (bytes(map(shape, raw)), (2, 3, 4, 6)))):
            for n in sizes:
                for x in range(len(data) - n + 1):
                    code = n + 16 * kind
                    for b in data[x : x + n]:
                        code = code * 257 + b
                    out.add((code * 0x9E3779B97F4A7C15) % 2**64 >> 48)
        return sorted(out)

    assert all(quality.features(t).tolist() == grams(t) for _, t in rows[:5])
    counts = np.ones((2, quality.DIM))
    for t, y in train:
        counts[y, grams(t)] += 1
    scale = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    model = quality.fit(spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(train)], "row_key long, text string, label int"), epochs=400)
    assert np.allclose(model["scale"], scale)
    x = np.zeros((len(train), quality.DIM + 1))
    for at, (t, _) in enumerate(train):
        x[at, grams(t)] = scale[grams(t)] / np.linalg.norm(scale[grams(t)])
    x[:, -1] = 1
    y = np.array([1.0 if y else -1.0 for _, y in train])
    gram, alpha = (x @ x.T) * np.outer(y, y), np.zeros(len(y))
    for _ in range(4000):
        for i in range(len(y)):
            alpha[i] = min(max(alpha[i] - (gram[i] @ alpha - 1) / gram[i, i], 0), 1)
    w = x.T @ (alpha * y)
    assert np.allclose(np.append(model["w"], model["bias"]), w, atol=5e-3)
    got = {r["doc_id"]: r["score"] for r in quality.score_texts(table(spark, rows), model).collect()}
    for i, t in rows:
        margin = sum(w[g] * scale[g] for g in grams(t[:2000])) / math.sqrt(sum(scale[g] ** 2 for g in grams(t[:2000]))) + w[-1]
        if i < 900:
            assert math.isclose(got[i], 1 / (1 + math.exp(-(model["a"] * margin + model["b"]))), abs_tol=0.02)


def test_bpe(spark, texts):
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = texts + [(200, "word  \n\n It's 12 ok " * 700), (200, "word  \n\n It's 12 ok " * 700)]
    done = bpe.decode(bpe.encode(table(spark, rows), path, P.PATTERN, chunk=1000, overlap=60), path, P.PATTERN).collect()
    want = Counter((i, np.array(own.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in rows)
    assert Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in done) == want


def test_repeats(spark, texts):
    got = {(r["doc_id"], r["text"], r["n_words"], r["n_removed"]) for r in substring.drop_repeats(table(spark, texts)).collect()}
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    first = {}
    for i, t in texts:
        w = split(t)
        for s in range(len(w) - 49 if i is not None else 0):
            k = tuple(w[s : s + 50])
            first[k] = min(first.get(k, i), i)
    removed = 0
    for i, t in texts:
        w = split(t)
        gone = {x for s in range(len(w) - 49 if i is not None else 0) if first[tuple(w[s : s + 50])] < i for x in range(s, s + 50)}
        removed += len(gone)
        assert (i, " ".join(x for n, x in enumerate(w) if n not in gone), len(w), len(gone)) in got
    assert removed
    assert substring.drop_repeats(table(spark, [])).count() == 0


def test_repeats_of_a_source_whose_row_is_repeated(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"one {passage} one"), (1, f"one {passage} one"), (2, f"two {passage} two"), (3, f"three {passage}"), (3, f"three {passage}")]
    got = sorted((r["doc_id"], r["text"], r["n_removed"]) for r in substring.drop_repeats(table(spark, rows)).collect())
    assert got == [(1, rows[0][1], 0)] * 2 + [(2, "two two", 60)] + [(3, "three", 60)] * 2


def test_shards(spark, texts):
    rows = texts + [(300 + i, "same text in many documents") for i in range(150)]
    got = sharding.assign_shards(table(spark, rows), shards=4).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    slots = {}
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in rows)
    largest = max(r["size"] for r in got)
    assert all(abs(b - sum(sizes.values()) / 4) <= largest for b in sizes.values())
    assert sharding.assign_shards(table(spark, [])).count() == 0


def test_contained_items(spark, texts):
    item = " ".join(f"w{i}" for i in range(30))
    near = item.replace("w3 ", "other ")
    docs = table(spark, texts + [(400, f"before, {item.upper()}! after " + "z " * 3000), (401, near), (402, item[:40]), (None, item), (403, "It is too; SHORT."), (404, "too short"), (405, "too, so short")]).withColumn("doc", F.lit(1)).withColumn("digest", F.lit(2))
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (1, item), (None, item), (4, " . ")], "item_id long, text string")
    got = sorted((r["doc_id"] or -1, r["item_id"], r["n_shared"]) for r in decontaminate.contained_items(docs, bench).collect())
    assert got == [(-1, 1, 26), (400, 1, 26), (401, 1, 22), (403, 3, 1), (404, 3, 1)]
    assert decontaminate.without_benchmark(docs, bench).count() == docs.count() - 5
    assert decontaminate.without_benchmark(docs, bench.limit(0)).count() == docs.count()


def test_pii(spark):
    text = "mail a.b@c-d.org, ip 10.0.0.256 and 10.0.0.25 card 4111 1111-1111 1111 or 4111111111111112 call +1 (743) 555-3824."
    rows = [(1, text), (2, None), (3, ""), (4, "@" * 50 + "1" * 500), (None, text)] + [(i, f"word {text} {i}") for i in range(10, 30)]
    got = {r["doc_id"]: r for r in pii.find_pii(table(spark, rows)).collect()}
    spans = [(k, text[int(a) : int(b)]) for k, a, b in (s.split(":") for s in got[1]["base"].split(","))]
    assert spans == [("email", "a.b@c-d.org"), ("ip", "10.0.0.25"), ("card", "4111 1111-1111 1111"), ("phone", "+1 (743) 555-3824")]
    assert got[2]["spans"] == got[3]["spans"] == "" and set(got[1]["base"].split(",")) <= set(got[1]["spans"].split(","))


def test_pii_search_agrees_with_exhaustive_segmentation():
    w = np.random.default_rng(3).normal(size=pii.DIM)
    words = "12 a@b (555) 1.2.3.4".split()
    field = pii.Field(words)
    scores = field.scores(w)

    def every(at):
        if at == len(words):
            yield 0.0, []
        for end in range(at + 1, len(words) + 1):
            for t, s in scores.get((at, end), {}).items():
                for rest, segments in every(end):
                    yield s + rest, [(at, end, t), *segments]

    assert field.best(w) == max(every(0))[1]


def test_pii_spans_in_long_runs_do_not_depend_on_where_they_stand():
    w = np.random.default_rng(3).normal(size=pii.DIM)
    w[zlib.crc32(b"phone|words3") % pii.DIM] += 60
    chance = random.Random(2)
    words = [chance.choice(["12", "a@b", "(555)", "1.2.3.4", "743", "38-24", "4111"]) for _ in range(300)]
    best = pii.Field(words).best(w)
    assert pii.best_segments(iter(words), w) == best
    assert any(i < at < j and t != "O" for at in range(64, 300, 64) for i, j, t in best)
    starts = np.cumsum([0, *(len(x) + 1 for x in words)])
    want = [(starts[i], pii.KINDS.index(t), starts[j] - 1) for i, j, t in best if t != "O"]
    assert pii.added_spans(" ".join(words), [], w) == want


def test_pii_training_draws_runs_from_all_sampled_texts(spark, monkeypatch):
    seen = []
    own = pii.Field.__init__
    monkeypatch.setattr(pii.Field, "__init__", lambda self, words: (seen.append(words), own(self, words))[1])
    pii.train(table(spark, [(i, " word ".join(f"{90_000 + i} {x}" for x in range(10))) for i in range(40)]), most_runs=10, epochs=1)
    texts = [words[0] for words in seen if words[0].startswith("900")]
    assert len(texts) == 10 and len(set(texts)) > 4


def test_lm(spark, texts):
    got = {(r["doc_id"], r["n_tokens"]): r for r in lm.lm_scores(table(spark, texts)).collect()}
    split = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    train = [t for i, t in texts if i is not None and not held(i)]
    counts = Counter(w for t in train for w in split(t))
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    p = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    for i, t in texts:
        r = got[i, len(split(t)) + 1]
        assert r["train_tokens"] == n and r["n_known"] == sum(w in counts for w in split(t)) + 1
        assert math.isclose(r["base_score"], sum(p(counts[w]) for w in split(t)) + p(len(train)), abs_tol=1e-6)
        assert r["score"] < 0 and math.isfinite(r["score"])
    alone = lm.lm_scores(table(spark, [(None, "a b")])).first()
    assert (alone["train_tokens"], alone["n_known"], alone["base_score"], alone["score"]) == (0, 0, 0.0, 0.0)
    assert lm.lm_scores(table(spark, [])).count() == 0


@pytest.mark.parametrize("hot", [65_536, 50])
def test_lm_tells_rare_words_apart_by_what_came_before(spark, monkeypatch, hot):
    monkeypatch.setattr(lm, "HOT_WORDS", hot)  # with 50, most words are in hashed leaves
    train = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 != 1]
    pairs = [f"first{i} second{i}" for i in range(400)]
    common = " ".join(f"common{i}" for i in range(250)) + " "  # more frequent than any word of the pairs
    rows = [(i, common * 2 + " ".join(random.Random(i).sample(pairs, 200))) for i in train]
    swapped = " ".join(f"first{i} second{(i + 7) % 400}" for i in range(400))
    right, wrong = (lm.lm_scores(table(spark, [*rows, (None, t)])).where("doc_id is null").first() for t in (" ".join(pairs), swapped))
    assert math.isclose(right["base_score"], wrong["base_score"], abs_tol=1e-6)
    assert right["score"] > wrong["score"] + 100 and right["score"] > right["base_score"] + 100


def test_lm_sizes_grow_with_the_words():
    small, large = lm.sizes_for(400_000), lm.sizes_for(40_000_000)
    assert all(a < b for a, b in zip(small, large, strict=True))


def test_lm_leaves_sum_to_one():
    chance = np.random.default_rng(4)
    model = lm.Model.start(chance.integers(1, 90, 300) + 0.5, 10)
    model.table[:] = chance.normal(size=model.table.shape)
    codes = [np.full(300, c, np.uint64) for c in (5, 77, 1234567)]
    assert math.isclose(np.exp(model.log_prob(codes, np.arange(300))).sum(), 1, rel_tol=1e-4)


def test_lm_score_against_brute_force(spark, texts):
    """Each token's probability by hand: its choices from the root down, one by one, and its share of a hashed leaf."""
    train, rows = [(i, t) for i, t in texts if i is not None and zlib.crc32(str(i).encode()) % 5 != 1], texts
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    coded = lambda w: int(words.word_hashes(pa.array([w]))[0][0])
    counts = Counter(w for _, t in train for w in split(t))
    weights = np.array([len(train) + 0.5, *(n + 0.5 for n in sorted(counts.values(), reverse=True)[:20]), 40.0, 3.0])
    by_hash = sorted(((-n, coded(w), w) for w, n in counts.items()))[:20]
    vocabulary = lm.Vocabulary(np.array([h for _, h, _ in by_hash], np.uint64), 2)
    model, seen = lm.Model.start(weights, 6), np.zeros(64, np.float32)
    for _ in range(3):
        codes, leaf, _, _ = lm.token_codes(pa.array([t for _, t in train]), vocabulary)
        model.learn(codes, leaf, 0.6, seen)
    assert model.table.any()
    hot = {w: 1 + i for i, (_, _, w) in enumerate(by_hash)}
    parent, n = model.parent.tolist(), len(weights)
    ways = {}
    for leaf in range(n):
        at, way = leaf, []
        while at != len(parent) - 1:
            up = parent[at]
            low, high = sorted(c for c in range(len(parent) - 1) if parent[c] == up)
            way.append((up, 1 if at == high else -1, math.log(model.total[high] / model.total[low])))
            at = up
        ways[leaf] = way[::-1]

    def log_prob(last, before, leaf):
        features = [last, (last * 31 + before * 0xD1342543DE82EF95) % 2**64, before ^ 0xA5A5A5A5]
        total, first, place = 0.0, None, 1
        for depth, (node, way, bias) in enumerate(ways[leaf]):
            if depth % 4 == 0:
                first, place = node, 1
            row = [int(lm._line(np.array([f], np.uint64), 1 + i, 6)[0]) ^ int(lm._line(np.array([first], np.uint64), 29, 6)[0]) for i, f in enumerate(features)]
            z = way * (sum(float(model.table[r, place]) for r in row) + bias)
            total -= math.log1p(math.exp(-z))
            place = 2 * place + (way > 0)
        return total

    for _, t in rows:
        want, last, before = 0.0, lm.BEFORE, lm.BEFORE
        for w in [*split(t)[:400], None]:
            code = lm.END_CODE if w is None else coded(w)
            leaf = 0 if w is None else hot.get(w, 1 + 20 + (code >> 16) % 2)
            want += log_prob(last, before, leaf)
            last, before = code, last
        codes, leaf, _, _ = lm.token_codes(pa.array([" ".join(split(t)[:400])]), vocabulary)
        assert math.isclose(model.log_prob(codes, leaf).sum(), want, rel_tol=1e-4, abs_tol=1e-4)


def test_lm_takes_as_many_frequent_words_as_fit(spark):
    counts = spark.createDataFrame([(i, 100 - i // 3) for i in range(60)], "word long, n long")
    kept, n = lm.frequent_words(counts, 20)
    assert sorted(kept.tolist()) == list(range(18)) and n.tolist() == sorted(n.tolist(), reverse=True)
    assert len(lm.frequent_words(counts, 2)[0]) == 0 and len(lm.frequent_words(counts.limit(0), 5)[0]) == 0
    assert len(lm.frequent_words(counts, 60)[0]) == 60


def test_vocabulary_finds_its_words():
    known = words.mixed(np.arange(1, 5000, dtype=np.uint64))
    vocabulary = lm.Vocabulary(known, 7)
    assert (vocabulary.leaves(known) == 1 + np.arange(len(known))).all()
    assert (vocabulary.leaves(words.mixed(np.arange(5000, 9000, dtype=np.uint64))) > len(known)).all()


def test_word_hashes():
    chance = random.Random(1)
    texts = [None, "", " ", "a", "A a", "x\0 \0x x", "ß" * 300_000 + " b c " + "d" * 600_000, " ".join(chance.choices(["ab", "Ab", "é", "\x1c", "a\x85b", "😀", "zz" * 9], k=60_000))]
    texts += ["".join(chance.choices("ab \n\tAé", k=chance.randint(0, 40))) for _ in range(2000)]
    for lower in (False, True):
        column = pa.array(texts, pa.string())
        got, bounds = words.word_hashes(column, lower)
        one, other = {}, {}
        for i, t in enumerate(texts):
            plain = (t or "").encode()
            split = (plain.lower() if lower else plain).split()
            own = got[bounds[i] : bounds[i + 1]].tolist()
            assert len(split) == len(own) and all(one.setdefault(w, h) == h and other.setdefault(h, w) == w for w, h in zip(split, own, strict=True))
        part, begin = words.word_hashes(column.slice(5, 100), lower)
        assert (part == got[bounds[5] : bounds[105]]).all() and begin[-1] == len(part)


def test_near_duplicates(spark, texts):
    rows = texts + [(1000 + i, " ".join(f"w{x}" if x != i % 190 else f"e{i}" for x in range(190))) for i in range(50)]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(table(spark, rows)).collect()}
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, {tuple(w[x : x + 4]) for x in range(max(1, len(w) - 3))} if w else set()))
    root = {i: i for i, _ in sets if i is not None}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= 85 * len(x | y):
                lo, hi = sorted((top(i), top(j)))
                root[hi] = lo
    assert {(i, len(s), None if i is None else top(i)) for i, s in sets} == got
    assert jaccard.near_duplicates(table(spark, [])).count() == 0


def test_near_duplicates_of_each_text_of_a_repeated_doc_id(spark):
    texts = [[f"{k}{i}" for i in range(150 + 40 * k)] for k in range(4)]
    rows = [(1, " ".join(t)) for t in texts] + [(2 + k, " ".join([*t[:-1], "edit"])) for k, t in enumerate(texts)]
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.near_duplicates(table(spark, rows)).collect()}
    assert got == {(i, 1) for i in range(1, 6)}


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7)], "a long, b long")
    got = {r["id"]: r["component"] for r in components.components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 90: 90, 95: 90, 100: 90}


def test_components_are_whole_or_an_error(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)], "a long, b long")
    with pytest.raises(RuntimeError):
        components.components(links, rounds=2)


def test_near_duplicates_shuffle_no_shingle_of_one_prefix_alone_but_to_count_it(spark):
    chance = random.Random(3)
    rows = [(i, " ".join(f"{chance.randrange(10**9)}" for _ in range(2000))) for i in range(200)]
    rows += [(i + 1000, t.rsplit(" ", 1)[0]) for i, t in rows[:4]]
    store_of = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: sum(store_of.executorList(False).apply(k).totalShuffleWrite() for k in range(store_of.executorList(False).size()))
    before = written()
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(table(spark, rows)).collect()}
    assert got == {i: i % 1000 for i, _ in rows}
    entries = sum(jaccard.prefix_size(len(t.split()) - 3, 85) for _, t in rows)
    assert written() - before < 30 * entries


def test_near_duplicates_delete_their_tables_of_pairs_and_index_lists(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "shared_dir", lambda _: str(tmp_path))
    rows = [(i, " ".join(f"w{i % 7}x{j}" for j in range(40)) + f" end{i}") for i in range(60)]
    assert len({r["component_id"] for r in jaccard.near_duplicates(table(spark, rows)).collect()}) == 7
    left = {p.name.split("-")[2] for p in tmp_path.glob("weftline-jaccard-*")}
    assert left and not left & {"prefix", "index", "pairs", "ids", "sets", "entries", "open"}
