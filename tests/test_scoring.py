"""Scoring operators against brute-force Python (FIXTURES.md A7)."""

import math
import pandas as pd
import random
import re
import string
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from colloquy.functions.tags import set_f1_eda, tag_mentions
from colloquy.operators import profile as pf
from colloquy.operators import scoring as sc

PUNCT = set(string.punctuation)


def _all_pairs_f1(df, group, ord_col, tags_col):
    """J10 + H6 literally: all pairs ``a.ord < b.ord`` inside a group."""
    g = list(group)
    a = df.select(*g, F.col(ord_col).alias("__oa"), F.col(tags_col).alias("__ta"))
    b = df.select(*[F.col(x).alias("__b_" + x) for x in g], F.col(ord_col).alias("__ob"), F.col(tags_col).alias("__tb"))
    cond = [F.col(x).eqNullSafe(F.col("__b_" + x)) for x in g] + [F.col("__oa") < F.col("__ob")]
    pairs = a.join(b, cond).select(*g, set_f1_eda("__ta", "__tb").alias("__f"))
    return pairs.groupBy(*g).agg(F.avg("__f").alias("mean_f1"))


def _chrf_py(h, r):
    def words(s):
        out = []
        for w in s.split():
            if len(w) == 1:
                out.append(w)
            elif w[-1] in PUNCT:
                out += [w[:-1], w[-1]]
            elif w[0] in PUNCT:
                out += [w[0], w[1:]]
            else:
                out.append(w)
        return out
    stats = []
    hs, rs = "".join(h.split()), "".join(r.split())
    for n in range(1, 7):
        a = Counter(hs[i:i + n] for i in range(len(hs) - n + 1))
        b = Counter(rs[i:i + n] for i in range(len(rs) - n + 1))
        stats.append((sum(a.values()), sum(b.values()), sum((a & b).values())))
    hw, rw = words(h), words(r)
    for n in (1, 2):
        a = Counter(" ".join(hw[i:i + n]) for i in range(len(hw) - n + 1))
        b = Counter(" ".join(rw[i:i + n]) for i in range(len(rw) - n + 1))
        stats.append((sum(a.values()), sum(b.values()), sum((a & b).values())))
    eff = [(m / nh, m / nr) for nh, nr, m in stats if nh > 0 and nr > 0]
    if not eff:
        return 0.0
    p = sum(x for x, _ in eff) / len(eff)
    q = sum(y for _, y in eff) / len(eff)
    return 5 * p * q / (4 * p + q) if p + q else 0.0


def _lcs_dp(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            d[i + 1][j + 1] = d[i][j] + 1 if a[i] == b[j] else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


PAIRS = [("The speaker is calm, slow.", "the speaker is calm and slow!"), ("", "nothing"), ("same words", "same words"),
         ("a", "a"), ("(hi) there", "hi there."), ("Ünïcode façade", "unicode facade")]


def test_lcs_bitparallel_matches_dp():
    rnd = random.Random(0)
    for _ in range(200):
        a = [rnd.choice("abcd") for _ in range(rnd.randint(0, 30))]
        b = [rnd.choice("abcd") for _ in range(rnd.randint(0, 30))]
        assert sc.lcs_length(a, b) == _lcs_dp(a, b)


def test_rouge_l(spark):
    df = spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate(PAIRS)], "id long, pred string, ref string")
    got = {r.id: r.rouge_l for r in sc.rouge_l(df).collect()}
    for i, (p, r) in enumerate(PAIRS):
        tp = re.sub(r"[^a-z0-9]+", " ", p.lower()).split()
        tr = re.sub(r"[^a-z0-9]+", " ", r.lower()).split()
        lcs = _lcs_dp(tp, tr)
        exp = 0.0 if not tp or not tr or lcs == 0 else 2 * (lcs / len(tp)) * (lcs / len(tr)) / (lcs / len(tp) + lcs / len(tr))
        assert math.isclose(got[i], exp, abs_tol=1e-12)
    assert got[2] == 1.0


def test_chrf_matches_python(spark):
    df = spark.createDataFrame([(str(i), p, r) for i, (p, r) in enumerate(PAIRS)], "id string, pred string, ref string")
    got = {r.id: r.chrf for r in sc.chrf(df).collect()}
    for i, (p, r) in enumerate(PAIRS):
        assert math.isclose(got[str(i)], _chrf_py(p, r), abs_tol=1e-12), (p, r)


def test_chrf_of_many_pairs_counted_together(spark, monkeypatch):
    rnd = random.Random(12)
    texts = ["", " ", "a", "aa aa", "\u00e9!", "x" * 50] + ["".join(rnd.choice("abc \u00e9.!\U0001f600") for _ in range(rnd.randint(0, 40))) for _ in range(60)]
    pairs = [(rnd.choice(texts), rnd.choice(texts)) for _ in range(300)]
    want = [_chrf_py(p, r) for p, r in pairs]
    assert np.allclose(sc.chrf_scores(*zip(*pairs)), want, atol=1e-12)
    monkeypatch.setattr(sc, "CHRF_CHARS", 30)     # cuts between pairs
    got = sc._chrf_udf.func(pd.Series([p for p, _ in pairs] + [None]), pd.Series([r for _, r in pairs] + ["b"]))
    assert np.allclose(got, [*want, 0.0], atol=1e-12)
    assert len(sc._chrf_udf.func(pd.Series([], dtype=object), pd.Series([], dtype=object))) == 0


def test_tag_mentions_whole_words(spark):
    vocab = spark.createDataFrame([("emotion", "sad"), ("emotion", "friendly tone"), ("noise", "high-pitched")],
                                  "category string, tag string")
    texts = [(1, "She was saddened."), (2, "An unfriendly tone here"), (3, "A Friendly Tone, and SAD!"),
             (4, "high-pitched but not high pitched")]
    df = spark.createDataFrame(texts, "id long, text string")
    got = {(r.id, r.tag) for r in tag_mentions(df, "id", "text", vocab, 2).collect()}
    assert got == {(3, "friendly tone"), (3, "sad"), (4, "high-pitched")}


def test_tag_f1_edges(spark):
    vocab = spark.createDataFrame([("emotion", "sad"), ("emotion", "happy"), ("speed", "fast")], "category string, tag string")
    pairs = spark.createDataFrame([(1, "s", "nothing", "nothing"), (2, "s", "sad fast", "sad"), (3, "s", "", "happy")],
                                  "id long, source string, pred string, ref string")
    got = {r.category: (r.tag_f1_mean, r.tag_f1_std) for r in sc.tag_f1(pairs, vocab).collect()}
    # emotion: 1.0 (no tags), 1.0, 0.0 ; speed: 1.0, 0.0 (one side), 1.0 ; overall: 1.0, 2/3, 0.0
    assert math.isclose(got["emotion"][0], 2 / 3) and math.isclose(got["speed"][0], 2 / 3)
    assert math.isclose(got["overall"][0], (1 + 2 * 0.5 * 1 / 1.5 + 0) / 3)
    assert math.isclose(got["emotion"][1], float(np.std([1, 1, 0])))


def test_dist_n(spark):
    df = spark.createDataFrame([("g", "a b a"), ("g", "b a"), ("h", ""), ("k", "x")], "g string, pred string")
    got = {r.g: (r.dist1, r.dist2) for r in sc.dist_n(df, "g").collect()}
    assert got["g"] == (2 / 5, 2 / 3) and got["h"] == (0.0, 0.0) and got["k"] == (1.0, 0.0)


def test_vector_collapse_matches_numpy(spark):
    rnd = np.random.default_rng(0)
    vecs = rnd.normal(size=(30, 8))
    vecs[3] = 0.0
    df = spark.createDataFrame([(0, v.tolist()) for v in vecs], "g int, v array<double>")
    r = sc.vector_collapse(df, "g", "v").first()
    norms = np.linalg.norm(vecs, axis=1)
    unit = np.where(norms[:, None] > 0, vecs / np.where(norms[:, None] > 0, norms[:, None], 1), 0)
    sim = unit @ unit.T
    off = sim[~np.eye(30, dtype=bool)].mean()
    assert math.isclose(r.mean_cosine_sim, off, abs_tol=1e-12)
    assert math.isclose(r.vec_std, vecs.std(axis=0, ddof=1).mean(), abs_tol=1e-12)
    assert math.isclose(r.vec_norm_cv, norms.std(ddof=1) / norms.mean(), abs_tol=1e-12)


def test_pairwise_f1_algebra_matches_pairs(spark):
    rnd = random.Random(5)
    rows = []
    for g in range(25):
        for o in range(rnd.randint(1, 7)):
            k = rnd.randint(0, 4)
            rows.append((g % 4, g, o, None if k == 0 and rnd.random() < 0.5 else
                         [rnd.choice("abcdefg") for _ in range(k)]))
    df = spark.createDataFrame(rows, "spk int, conv int, ord int, tags array<string>")
    fast = {(r.spk, r.conv): r.mean_f1 for r in pf.pairwise_set_f1(df, ["spk", "conv"], "tags").collect()}
    brute = {(r.spk, r.conv): r.mean_f1 for r in _all_pairs_f1(df, ["spk", "conv"], "ord", "tags").collect()}
    assert set(fast) == set(brute)
    for k, v in brute.items():
        assert (v is None and fast[k] is None) or math.isclose(fast[k], v, abs_tol=1e-12), k


def test_set_f1_forms(spark):
    df = spark.createDataFrame([([], None), (["a"], []), (["a", "a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    got = [r.f for r in df.select(set_f1_eda("a", "b").alias("f")).collect()]
    assert got[0] is None and got[1] == 0.0 and math.isclose(got[2], 2 * 1 / 4)


def test_ws_token_count(spark):
    texts = ["", " ", "a", " a ", "a  b\\n c", "\\t\\nx y\\n", "  many   spaced words  "]
    texts = [t.replace("\\\\n", "\\n").replace("\\\\t", "\\t") for t in texts]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.n for r in df.select(sc.ws_token_count("t").alias("n")).collect()]
    assert got == [len(t.split()) for t in texts]


def test_tag_f1_with_fixed_vocabulary(spark):
    from colloquy.functions.tags import vocabulary_frame
    voc = vocabulary_frame(spark, "styletalk")
    pairs = spark.createDataFrame([
        (1, "styletalk", "An Unfriendly tone at a fast speed.", "A friendly tone, fast speed"),
        (2, "styletalk", "Quiet volume, sad tone", "quiet volume and a sad tone")],
        "id long, source string, pred string, ref string")
    got = {r.category: r.tag_f1_mean for r in sc.tag_f1(pairs, voc).collect()}
    assert got["emotion"] == 0.5 and got["speaking_rate"] == 1.0 and got["volume"] == 1.0
    assert math.isclose(got["overall"], (0.5 + 1.0) / 2)


def test_tag_mentions_longest_first(spark):
    vocab = spark.createDataFrame([("emotion", "friendly tone"), ("emotion", "tone"), ("emotion", "sad"),
                                   ("other", "tone")], "category string, tag string")
    df = spark.createDataFrame([(1, "A friendly tone, a sad tone."), (2, "tone")], "id long, text string")
    got = {(r.id, r.category, r.tag) for r in tag_mentions(df, "id", "text", vocab, 2).collect()}
    assert got == {(1, "emotion", "friendly tone"), (1, "emotion", "sad"), (1, "emotion", "tone"),
                   (1, "other", "tone"), (2, "emotion", "tone"), (2, "other", "tone")}
    df2 = spark.createDataFrame([(3, "a friendly tone only")], "id long, text string")
    got2 = {(r.category, r.tag) for r in tag_mentions(df2, "id", "text", vocab, 2).collect()}
    assert got2 == {("emotion", "friendly tone"), ("other", "tone")}


def test_evaluate_report(spark):
    from colloquy.functions.tags import vocabulary_frame
    pairs = spark.createDataFrame([(str(i), "g", p, r) for i, (p, r) in enumerate(PAIRS)],
                                  "id string, source string, pred string, ref string")
    rep = {r.metric: r.value for r in sc.evaluate(pairs, vocabulary_frame(spark, "styletalk").select("category", "tag")).collect()}
    chrfs = [_chrf_py(p, r) for p, r in PAIRS]
    assert math.isclose(rep["g/chrf"], float(np.mean(chrfs)), abs_tol=1e-12)
    assert math.isclose(rep["g/chrf_std"], float(np.std(chrfs)), abs_tol=1e-12)
    assert {"g/rougeL", "g/dist1", "g/dist2", "g/tag_f1_overall", "g/tag_f1_emotion_std"} <= set(rep)
    assert rep["g/tag_f1_overall"] == 1.0      # no vocabulary tags on either side


def test_collapse_all_zero_vectors(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (0, [0.0, 0.0])], "g int, v array<double>")
    r = sc.vector_collapse(df, "g", "v").first()
    assert r.vec_norm_cv is None and r.mean_cosine_sim == 0.0


def test_tag_f1_counts_word_pieces(spark):
    vocab = spark.createDataFrame([("pitch", "high-pitched")], "category string, tag string")
    pairs = spark.createDataFrame([(1, "x", "a high-pitched voice", "plain"), (2, "y", "high-pitched", "so high-pitched")],
                                  "id int, source string, pred string, ref string")
    got = {(r.source, r.category): r.tag_f1_mean for r in sc.tag_f1(pairs, vocab).collect()}
    assert got == {("x", "pitch"): 0.0, ("x", "overall"): 0.0, ("y", "pitch"): 1.0, ("y", "overall"): 1.0}


def test_tag_f1_uses_each_sources_own_categories(spark):
    vocab = spark.createDataFrame([("s1", "tone", "calm tone"), ("s2", "speed", "fast"), ("s2", "tone", "sad")],
                                  "source string, category string, tag string")
    pairs = spark.createDataFrame([(1, "s1", "a calm tone, fast", "fast, calm  tone"), (2, "s2", "calm tone and fast", "fast sad"),
                                   (3, "s3", "fast", "sad")], "id int, source string, pred string, ref string")
    got = {(r.source, r.category): round(r.tag_f1_mean, 4) for r in sc.tag_f1(pairs, vocab).collect()}
    # s1: "calm  tone" has two blanks and is no tag; s2: {fast} against {fast, sad}; s3 has no vocabulary
    assert got == {("s1", "tone"): 0.0, ("s1", "overall"): 0.0, ("s2", "speed"): 1.0, ("s2", "tone"): 0.0,
                   ("s2", "overall"): round(2 / 3, 4), ("s3", "overall"): 1.0}


def test_size_pairs_with_many_sizes_match_the_direct_sum(spark):
    # 20,000 distinct sizes of one token beside tokens with few sizes
    rnd = np.random.default_rng(3)
    k = np.arange(1, 20_001)
    c = rnd.integers(1, 4, len(k))
    big = spark.createDataFrame(pd.DataFrame({"g": 0, "__t": "x", "__k": k.astype("int32"), "__c": c.astype("int64")}))
    few = spark.createDataFrame([(0, "y", 2, 3), (0, "y", 5, 1), (1, "x", 4, 2)], "g long, __t string, __k int, __c long")
    got = {r.g: r.f for r in pf._size_pair_sums(big.unionByName(few, True), ["g"]).groupBy("g").agg(F.sum("__f").alias("f")).collect()}
    ordered = sum(float((c * ci / (k + ki)).sum()) for ki, ci in zip(k, c))     # twice the unordered pairs, with each row itself
    want = ordered - float((c / (2.0 * k)).sum()) + (3 / 2 + 2 * 3 / 7)
    assert math.isclose(got[0], want, rel_tol=1e-10)
    assert math.isclose(got[1], 1 / 4)


def test_pairwise_f1_beyond_few_sizes(spark, monkeypatch):
    monkeypatch.setattr(pf, "FEW_SIZES", 2)
    rnd = random.Random(8)
    rows = [(g, o, [rnd.choice("abcdefghijkl") for _ in range(rnd.randint(0, 12))]) for g in range(3) for o in range(30)]
    df = spark.createDataFrame(rows, "g int, ord int, tags array<string>")
    fast = {r.g: r.mean_f1 for r in pf.pairwise_set_f1(df, ["g"], "tags").collect()}
    brute = {r.g: r.mean_f1 for r in _all_pairs_f1(df, ["g"], "ord", "tags").collect()}
    assert all(math.isclose(fast[g], brute[g], rel_tol=1e-10) for g in brute) and set(fast) == set(brute)


def test_reciprocal_nodes():
    nodes = pf._reciprocal_nodes()
    for v in (2, 3, 17, 1000, 10 ** 6, 2 ** 32):
        assert math.isclose(sum(w * math.exp(-t * v) for t, w in nodes), 1 / v, rel_tol=1e-11)


def test_tag_trie_grows_only_known_prefixes(spark):
    from colloquy.functions import tags
    vocab = spark.createDataFrame([("a", "very fast"), ("a", "very fast speed"), ("b", "Fast"), ("b", "-odd"), ("b", "")],
                                  "category string, tag string")
    trie = {(r.depth, r.prefix): sorted(e.tag for e in r.ends) for r in tags.tag_trie(vocab).collect()}
    assert trie == {(1, "very"): [], (2, "very fast"): ["very fast"], (3, "very fast speed"): ["very fast speed"], (1, "fast"): ["fast"]}
    text = "plain words " * 500 + "a very slow and VERY FAST speed"
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "very")], "id long, text string")
    rows = tags._walk_trie(df, ["id"], "text", vocab, 3).collect()
    # of more than 1,000 words only those that begin a tag are candidates; one row each
    assert sorted((r.id, [x is not None for x in (r["__e1"], r["__e2"], r["__e3"])]) for r in rows) == [
        (1, [True, False, False]), (1, [True, False, False]), (1, [True, True, True]), (4, [True, False, False])]
    got = {(r.id, r.category, r.tag) for r in tags.tag_mentions(df, "id", "text", vocab).collect()}
    assert got == {(1, "a", "very fast speed"), (1, "b", "fast")}
    none = spark.createDataFrame([], vocab.schema)
    assert tags.tag_mentions(df, "id", "text", none).count() == 0


def test_words_stay_where_they_are_for_a_small_trie(spark, monkeypatch):
    from colloquy.functions import tags
    from colloquy.plans import small
    vocab = spark.createDataFrame([("a", "very fast"), ("b", "Fast"), ("b", None), (None, "slow")], "category string, tag string")
    df = spark.createDataFrame([(i, f"word {i} very  fast, VERY FAST and slow") for i in range(50)], "id long, text string")

    def shuffles():
        walk = tags._walk_trie(df, ["id"], "text", vocab, 2)
        return walk._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    want = {(i, c, t) for i in range(50) for c, t in (("a", "very fast"), ("b", "fast"), (None, "slow"))}
    assert shuffles() == 0
    assert {tuple(r) for r in tags.tag_mentions(df, "id", "text", vocab).collect()} == want
    monkeypatch.setattr(small, "BROADCAST_BYTES", 20)   # the same join, shuffled
    assert shuffles() > 0
    assert {tuple(r) for r in tags.tag_mentions(df, "id", "text", vocab).collect()} == want


def test_tag_mentions_match_the_regex(spark):
    import re
    rnd = random.Random(11)
    words = ["red", "Blue", "green", "sky-high", "x"]
    vocab_rows = sorted({(c, " ".join(rnd.choice(words[:4]) for _ in range(rnd.randint(1, 4))).lower()) for c in "ab" for _ in range(8)})
    texts = [(i, "".join(rnd.choice(words) + rnd.choice([" ", " ", "  ", ", ", "-"]) for _ in range(rnd.randint(0, 25)))) for i in range(80)]
    want = set()
    for cat in "ab":
        alts = sorted((t for c, t in vocab_rows if c == cat), key=len, reverse=True)
        pat = re.compile(r"\b(" + "|".join(map(re.escape, alts)) + r")\b", re.I)
        want |= {(i, cat, m.lower()) for i, t in texts for m in pat.findall(t)}
    vocab = spark.createDataFrame(vocab_rows, "category string, tag string")
    got = {(r.id, r.category, r.tag) for r in tag_mentions(spark.createDataFrame(texts, "id long, text string"), "id", "text", vocab).collect()}
    assert got == want and len(want) > 100
