"""The corpus pipeline as a whole against a plain version of each of its stages."""

import base64
import hashlib
import os
import random
import re

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from weftline.llm import store

ASCII_SPACE = r"[\x20\x09-\x0D]"


def corpus():
    """Documents whose quality is plain from their words, with repeated lines, near copies and benchmark items."""
    chance = random.Random(11)
    words = ["".join(chance.choices("abcdefghij", k=chance.randint(3, 7))) for _ in range(300)]
    say = lambda n: " ".join(chance.choices(words, k=n))
    items = [(i, say(30)) for i in range(4)]
    rows = [(i, say(80)) for i in range(60)]
    rows += [(i, "#@ " + " ".join("".join(chance.choices("XQZ0189$%!", k=6)) for _ in range(60))) for i in range(100, 160)]
    rows += [(i, f"{say(40)}\n A line found in several texts \n{say(40)}") for i in range(200, 205)]
    near = say(120).split()
    rows += [(i, " ".join("edit" if n == i - 300 else w for n, w in enumerate(near))) for i in range(300, 306)]
    rows += [(400 + i, f"{say(50)} {item.upper()}, {say(50)}") for i, item in items[:3]]
    rows += [(500, rows[0][1]), (501, f"{say(40)}   \n\n It's 12 ok \U0001f600")]
    return rows, items


def plain(rows, items):
    """doc_id to ids, by the rules alone; texts of bad quality hold '$', '%' or '#'."""
    kept = {i: t for i, t in rows if not re.search("[$%#]", t)}
    key = lambda s: re.sub(f"^{ASCII_SPACE}+|{ASCII_SPACE}+\\Z", "", s).lower()
    holders = {}
    for i, t in kept.items():
        for line in t.split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(i)
    last = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    kept = {i: "\n".join(x for x in t.split("\n") if last.get(key(x), i) <= i) for i, t in kept.items()}
    shingles = lambda w: {tuple(w[x : x + 5]) for x in range(max(1, len(w) - 4))} if w else set()
    sets = {i: shingles(t.lower().split()) for i, t in kept.items()}
    group = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                lo, hi = sorted((group[a], group[b]))
                group = {i: lo if g == hi else g for i, g in group.items()}
    kept = {i: t for i, t in kept.items() if group[i] == i}
    normal = lambda t: re.findall(r"[^\W_]+", t.lower())
    tests = [shingles(normal(t)) for _, t in items]
    kept = {i: t for i, t in kept.items() if not any(100 * len(s & shingles(normal(t))) >= 80 * len(s) for s in tests)}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return {i: (t, np.array(own.encode_ordinary(t), "<u4").tobytes()) for i, t in kept.items()}


def test_pipeline(spark, tmp_path):
    rows, items = corpus()
    docs = [(i, t, "en", "s", len(t)) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(not re.search("[$%#]", t))) for i, t in rows if i < 200]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = plain(rows, items)
    assert set(got) == set(want)
    assert {300, 204, 501} <= set(want) and not {301, 400, 500, 100} & set(want)
    for i, (text, ids) in want.items():
        assert bytes(got[i]["ids"]) == ids and got[i]["n_tokens"] == len(ids) // 4
        assert got[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_pipeline_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_on_nulls_empty_repeated_and_long_texts(spark, tmp_path):
    rows, items = corpus()
    rows += [(600, None), (601, ""), (None, "a text without number"), (602, "calm words " * 20_000), (0, rows[0][1])]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, score double, doc int, lines int"
    spark.createDataFrame([(i, t, None, None, None, 1.0, 2, 3) for i, t in rows], kinds).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(not re.search("[$%#]", t))) for i, t in rows if i is not None and i < 200]
    spark.createDataFrame([*labels, (None, 1), (601, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([*items, (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    before = set(os.listdir(store.shared_dir(spark)))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = {x.split("-")[1] for x in set(os.listdir(store.shared_dir(spark))) - before}
    assert left == {"stage"}
    assert sorted(r["doc_id"] for r in got if r["doc_id"] in (0, 500, 301, 400)) == [0, 0]
    assert all(r["n_tokens"] == 0 for r in got if r["doc_id"] in (600, 601))


def test_no_task_of_the_token_stage_holds_two_python_workers(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    plan = corpus_pipeline.token_stage(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
