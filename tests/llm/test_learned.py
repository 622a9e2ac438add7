"""Near-duplicate groups, repeated spans, toxicity and the pipeline against plain Python."""

import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from colloquy.llm import components, decontaminate, forest, pii, spans, toxicity


def _set(text):
    w = re.findall(r"\w+", (text or "").lower())
    n = min(5, len(w))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()


def _near(rows):
    """Smallest id of each row's group and links to other shingle sets, by all pairs."""
    sets = [frozenset(_set(t)) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    links = defaultdict(set)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and len(a & b) >= 0.8 * len(a | b):
                up[top(i)] = top(j)
                if a != b:
                    links[a].add(b)
                    links[b].add(a)
    first = defaultdict(list)
    for i, r in enumerate(rows):
        first[top(i)].append(r[0])
    return [(r[0], min(first[top(i)]), len(links[sets[i]]), max(1, sum(x == sets[i] for x in sets)) if sets[i] else 1)
            for i, r in enumerate(rows)]


def _corpus(seed, families=12, variants=12, words=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, n = [], 0
    for _ in range(families):
        base = [word() for _ in range(words)]
        for _ in range(variants):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                text[rng.randrange(words)] = word()
            rows.append((n, " ".join(text)))
            n += 1
    rows += [(n + i, " ".join(word() for _ in range(40))) for i in range(60)]
    return rows


def test_groups_and_links_equal_all_pairs(docs):
    rows = _corpus(1) + [(9000, None), (9001, ""), (9002, "!!"), (9003, "one two"), (9004, "One, two!"), (9005, "one two three")]
    got = forest.near_duplicates(docs(rows)).collect()
    want = {r[0]: r for r in _near(rows)}
    assert {r["doc_id"]: r["class_id"] for r in got} == {i: r[1] for i, r in want.items()}
    found, all_links = sum(r["n_links"] for r in got), sum(r[2] for r in want.values())
    assert found == all_links
    assert {r["doc_id"]: r["n_copies"] for r in got} == {i: r[3] for i, r in want.items()}


def test_blocks_give_the_same_as_one_group(docs, monkeypatch):
    rows = _corpus(2, families=1, variants=150)
    want = sorted(map(tuple, forest.near_duplicates(docs(rows)).collect()))
    monkeypatch.setattr(forest, "BLOCK", 16)
    assert sorted(map(tuple, forest.near_duplicates(docs(rows)).collect())) == want
    assert want == sorted(_near(rows))


def test_one_of_each_group_stays(docs):
    rows = _corpus(3, families=3) + [(7000, "one two"), (7001, "one two"), (7000, "one two"), (None, None), (7002, None), (7002, None)]
    out = forest.keep_one(docs(rows))
    assert out.columns == ["doc_id", "text", "score"]
    kept = [r["doc_id"] for r in out.collect()]
    want = {r[1] for r in _near(rows[:-6])} | {7000, None, 7002}
    assert len(kept) == len(want) and set(kept) == want
    assert forest.keep_one(docs([])).count() == 0


def test_prefixes_shorten_until_the_recall():
    d = forest.prefix_length(0.8, 0.995, 16, 6)
    assert 1 - (1 - 0.8 ** d) ** 16 >= 0.995 > 1 - (1 - 0.8 ** (d + 1)) ** 16
    assert forest.prefix_length(0.8, 0.5, 16, 6) == 6 and forest.prefix_length(0.1, 0.9999, 2, 6) == 1


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(5, 5), (2001, 2000)]
    got = dict(map(tuple, components.connected(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(61)) and all(got[1000 + i] == 1000 for i in range(40))
    assert got[2000] == got[2001] == 2000


def _repeats(rows):
    """Covered sentences of each row, occurrence by occurrence."""
    at = defaultdict(list)
    for i, t in rows:
        found = [s[2] for s in spans.sentences(t)]
        for s in range(len(found) - spans.RUN + 1):
            at[tuple(map(tuple, found[s:s + spans.RUN]))].append(((i is not None, i or 0), s, i))
    gone = defaultdict(set)
    for places in at.values():
        for _, s, i in sorted(places, key=lambda p: p[:2])[1:]:
            gone[i] |= set(range(s, s + spans.RUN))
    return gone


def test_repeated_runs_equal_brute_force(docs):
    rng = random.Random(9)
    line = lambda: " ".join(rng.choice(["aa", "bb", "cc", "dd", "É", "x"]) for _ in range(rng.randrange(1, 7))) + rng.choice(".!?\n")
    shared = [" ".join(line() for _ in range(6)) for _ in range(5)]
    rows = [(i, " ".join([line(), rng.choice(shared), line(), line(), rng.choice(["", rng.choice(shared)])])) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "..."), (103, "w " * 200 + ". " + shared[0]), (None, shared[1]), (104, "no end " * 90)]
    gone = _repeats(rows)
    got = {r["doc_id"]: r for r in spans.remove_repeats(docs(rows), report=True).collect()}
    for i, t in rows:
        cut = spans.sentences(t)
        assert got[i]["n_sentences"] == len(cut) and got[i]["n_removed"] == len(gone[i])
        left, at = "", 0
        for n, (start, stop, _) in enumerate(cut):
            if n in gone[i]:
                left, at = left + t[at:start], stop
        assert got[i]["text"] == (None if t is None else left + t[at:])
    kept = spans.remove_repeats(docs(rows))
    assert kept.columns == ["doc_id", "text", "score"] and {r["doc_id"]: r["text"] for r in kept.collect()} == {i: r["text"] for i, r in got.items()}
    assert spans.remove_repeats(docs([])).count() == 0


def test_of_a_repeated_run_one_row_a_block_goes_on(docs, monkeypatch):
    rng = random.Random(3)
    shared = [" ".join(f"s{k}{i}." for i in range(6)) for k in range(3)]
    rows = [(i if i % 9 else None, f"A{i}. {rng.choice(shared)} B{i}. {rng.choice(shared)} C{i}.") for i in rng.sample(range(60), 60)]
    rows = [*dict(rows).items()]
    keys = [h for _, t in rows for h in spans.runs(spans.sentences(t))]
    table = docs(rows).coalesce(1)
    source = table.select("doc_id", *spans._keys("doc_id", "text"), "text")
    cut = spans._cut(source.withColumnRenamed("doc_id", "id")).collect()
    assert sum(len(r["h1"]) for r in cut) == len(set(keys)) < len(keys) == sum(len(r["h1"]) + len(r["later"]) for r in cut)
    plan = spans.covered(table)._jdf.queryExecution().analyzed().toString()
    assert "Window" in plan and not re.search(r"Join \w+, \(+h1#", plan)  # all runs travel once
    gone = _repeats(rows)
    for most in (1, 40, spans.BLOCK_RUNS):
        monkeypatch.setattr(spans, "BLOCK_RUNS", most)
        got = {r["doc_id"]: r["n_removed"] for r in spans.remove_repeats(table, report=True).collect()}
        assert got == {i: len(gone[i]) for i, _ in rows}
    # the order of ids is Spark's (text: "10" before "9", NaN last), also of those that Arrow can't sort
    same = docs([(i, "Yes sir. No sir. Ok.") for i in ("nan", "9", "10")], "string").coalesce(1)
    for kind, least in (("string", "10"), ("float", 9.0), ("struct", Row(x="10"))):
        ids = F.struct(F.col("doc_id").alias("x")) if kind == "struct" else F.col("doc_id").cast(kind)
        got = spans.remove_repeats(same.withColumn("doc_id", ids), report=True).collect()
        assert [r["doc_id"] for r in got if not r["n_removed"]] == [least] and len(got) == 3


def test_a_long_passage_goes_whole_and_the_first_stays(docs):
    passage = " ".join(f"word{i}" for i in range(55)) + "."
    rows = [(i, f"Own start of {i}. It goes on {i}.\n{passage}\nOwn end {i}.") for i in range(4)]
    got = {r["doc_id"]: r["text"] for r in spans.remove_repeats(docs(rows)).collect()}
    assert passage in got[0] and all("word7" not in got[i] and f"Own end {i}." in got[i] for i in (1, 2, 3))


def test_short_runs_count_and_equal_ids_are_told_apart(docs):
    rows = [(1, "Yes sir. No sir. Ok. Own one."), (2, "Own two. Yes sir. No sir. Ok."), (None, "Yes sir. No sir. Ok. Own none."), (2, "Other two.")]
    got = {(r["text"], r["n_removed"]) for r in spans.remove_repeats(docs(rows), report=True).collect()}
    assert got == {(rows[2][1], 0), ("Other two.", 0), (" Own one.", 3), ("Own two.", 3)}  # the null id sorts first
    assert {r["text"] for r in spans.remove_repeats(docs(rows)).collect()} == {t for t, _ in got}
    twice = spans.remove_repeats(docs([rows[0]] * 2 + [rows[1]] * 3).repartition(4), report=True).collect()
    assert sorted((r["doc_id"], r["text"]) for r in twice) == [(1, rows[0][1])] * 2 + [(2, "Own two.")] * 3


def test_a_passage_without_marks_goes_at_any_offset(docs):
    rng = random.Random(12)
    own = lambda n: " ".join(f"own{rng.randrange(10**9)}" for _ in range(n))
    passage = [f"list{i}" for i in range(60)]
    rows = [(i, f"{own(20 + i)} {' '.join(passage)} {own(33 - i)}") for i in range(17)]
    rows += [(100 + i, f"{own(30 + i)} {'ha ' * 80}{own(25)}") for i in range(5)]
    got = {r["doc_id"]: r["text"] for r in spans.remove_repeats(docs(rows)).collect()}
    assert got[0] == rows[0][1]
    for i in range(1, 17):
        assert not set(passage[14:46]) & set(got[i].split()) and got[i].count("own") == 53
    assert all(got[100 + i].split().count("ha") < 40 for i in range(5))  # the first keeps one run and the ends


def test_sentence_marks_of_other_scripts():
    assert len(spans.sentences("यह एक है। यह दो है। यह तीन॥")) == 3
    assert len(spans.sentences("これは一つ。二つ！三つ？終")) == 4 and len(spans.sentences("هل هذا؟ نعم۔")) == 2
    assert [len(s[2]) for s in spans.sentences("汉字abc字。")] == [4]


def test_sentences_cover_the_words():
    rng = random.Random(1)
    for _ in range(200):
        t = "".join(rng.choice("ab .!?\nİé") for _ in range(rng.randrange(80)))
        cut = spans.sentences(t)
        assert [w for s in cut for w in s[2]] == [w.lower() for w in re.findall(r"\w+", t)]
        assert all(a[1] <= b[0] for a, b in zip(cut, cut[1:]))


def _run(machine, symbols):
    state, out = 0, ""
    for s in symbols:
        state, o = machine.step(state, s)
        out += o
    return out


def test_the_grammar_composes():
    g = toxicity.grammar()
    assert _run(g, "wIw") == "wIw" and _run(g, "YwI") == "wwJ" and _run(g, "wIwY") == "wIwy"
    assert _run(g, "NwI") == "wwn" and _run(g, "NwwwI") == "wwwwI" and _run(g, "RwI") == "wwi"
    assert _run(g, "RNI") == "wwn" and _run(g, "YH") == "wK" and _run(g, "YNI") == "wwn"
    parts = [toxicity.reporting(), toxicity.negation(), toxicity.targeting()]
    rng = random.Random(2)
    for _ in range(300):
        s = [rng.choice(toxicity.SYMBOLS) for _ in range(8)]
        want = s
        for p in parts:
            state, out = 0, []
            for x in want:
                state, o = p.step(state, x)
                out.append(o)
            want = out
        assert _run(g, s) == "".join(want)


def _toxic_rows(n=240):
    rng = random.Random(12)
    plain = "the house of water and a long letter about green fields by the river".split()
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(30)]
        if i % 4 == 0:
            words[rng.randrange(30)] = rng.choice(["blorgen", "blorgish", "blorger", "zzun"])
            labels.append((i, 1, 1))
        else:
            labels.append((i, 0, 1))
        rows.append((i, " ".join(words) + "."))
    return rows, labels


def test_learned_beginnings_catch_unseen_words(spark, docs):
    rows, labels = _toxic_rows()
    frame = spark.createDataFrame(labels + [(None, 1, 1), (5, None, 1), (9999, 1, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.train(docs(rows + [(3, None)]), frame)
    ask = [(1, "you are a blorgax"), (2, "a green house"), (3, None), (4, ""), (5, "zzun " * 3000), (2, "a green house")]
    got = toxicity.score(docs(ask), model).collect()
    score = {r["doc_id"]: r["score"] for r in got}
    assert len(got) == 6 and score[1] > 0.9 and score[5] > 0.9
    assert score[2] == score[3] == score[4] < toxicity.THRESHOLD


def test_no_toxic_rows_leave_the_seeds(spark, docs):
    rows, _ = _toxic_rows(20)
    frame = spark.createDataFrame([(i, 0) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(docs(rows), frame)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs([(1, "you idiot"), (2, "fine")]), model).collect()}
    assert got[1] > 0.5 > toxicity.THRESHOLD > got[2]
    assert toxicity.score(docs([]), model).count() == 0


def test_weights_fit_the_rows():
    rng = np.random.default_rng(1)
    x = np.c_[rng.random((400, len(toxicity.KINDS))), np.ones(400)]
    y = (x[:, 0] > 0.5).astype(float)
    p = 1 / (1 + np.exp(-x @ toxicity.fit_weights(x, y)))
    assert ((p > 0.5) == (y > 0.5)).mean() > 0.95


def test_pipeline_equals_the_stages_by_brute_force(spark, tmp_path):
    """Each decision is checked on its stage's own input."""
    rows, labels = _toxic_rows(80)
    near = [(1000 + i, t) for i, t in _corpus(5, families=4, variants=5)]
    item = "this passage of ten different words stands in the benchmark file exactly"
    more = [(5000, "intro words " + item + " and an end"), (5001, "write to me@secret.org today please"), (5002, None), (5003, "")]
    data = [(i, t, "en", "s", len(t or "")) for i, t in rows + near + more]
    documents = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    texts, seen = {i: t for i, t, *_ in data}, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        seen.append((name, {r["doc_id"]: r["text"] for r in before.collect()}, {r["doc_id"]: r for r in docs.collect()}))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == documents.columns
    by = {name: (a, b) for name, a, b in seen}
    a, b = by["toxicity"]
    assert set(a) - set(b) == {i for i, y, _ in labels if y}
    a, b = by["near_duplicates"]
    assert set(b) == {r[1] for r in _near(list(a.items()))}
    a, b = by["decontamination"]
    assert set(a) - set(b) == {5000} & set(a)
    a, b = by["pii"]
    assert set(a) == set(b) and b[5001]["text"] == "write to [EMAIL] today please"
    assert all(b[i]["text"] == t for i, t in a.items() if i != 5001)
    a, b = by["bpe"]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    assert {i: r["ids"] for i, r in b.items()} == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in a.items()}
    final = {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert final == {i: r["ids_sha256"] for i, r in b.items()}
    assert decontaminate.WINDOW == 10 and pii.KINDS == ("email", "ip", "card", "phone") and texts[5002] is None


@pytest.mark.parametrize("name", ["op1_positional_index", "op4_norm_sorted_topk", "op11_reduced_spelling", "op12_angular_negatives"])
def test_queries_with_sql_are_registered(name):
    from colloquy.llm import queries
    assert name in queries.QUERIES and name in queries.ORACLE_SQL
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))
