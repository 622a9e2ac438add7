"""Positional index, personal data, top-k and license alignment against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import decontaminate, licenses, pii, topk


def _words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def _hits(text, bench, n=10):
    w, hit, items = _words(text), set(), set()
    for item, t in bench:
        v = _words(t)
        for s in range(max(1, len(v) - n + 1)) if v else ():
            part = v[s:s + n]
            for i in range(len(w) - len(part) + 1):
                if w[i:i + len(part)] == part:
                    hit |= set(range(i, i + len(part)))
                    if item is not None:
                        items.add(str(item))
    return len(w), len(hit), sorted(items)


@pytest.fixture
def bench(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, key string")
    return make


def test_contamination_equals_brute_force(docs, bench):
    rng = random.Random(2)
    vocabulary = ["the", "of", "É", "x1", "Alpha", "beta", "rare", "zé"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 9, 10, 14, 25]))) for i in range(12)]
    items += [(12, None), (13, ""), (14, "..."), (3, "second text of item three and a few more words to fill it"), (None, items[5][1])]
    rows = [(i, text(rng.choice([0, 5, 40, 200]))) for i in range(40)]
    for i in range(12):
        rows.append((100 + i, "intro, " + items[i][1].upper() + "; end"))
    rows += [(200, None), (201, ""), (202, "--"), (100, rows[40][1]), (None, items[4][1]), (203, "the " * 300)]
    got = decontaminate.contamination(docs(rows), bench(items)).collect()
    want = sorted((str(i), *_hits(t, items)) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"]) for r in got) == want
    clean = decontaminate.keep_clean(docs(rows), bench(items)).collect()
    assert sorted(str(r["doc_id"]) for r in clean) == sorted(i for i, _, hit, _ in want if not hit)


def test_contamination_of_empty_tables(docs, bench):
    assert decontaminate.contamination(docs([]), bench([(1, "a b")])).count() == 0
    got = decontaminate.contamination(docs([(1, "a b")]), bench([])).first()
    assert (got["n_words"], got["n_hit"], got["items"]) == (2, 0, [])


def test_near_matches_hold_all_words_in_any_order(docs, bench):
    item = [(1, "alpha beta gamma delta epsilon")]
    rows = [(1, "x epsilon y delta gamma z alpha beta q"), (2, "alpha beta gamma delta"), (3, "alpha " + "w " * 30 + "beta gamma delta epsilon"),
            (4, None)]
    got = decontaminate.find_near(docs(rows), bench(item), 10, span=8).select("doc_id", "item").distinct().collect()
    assert [tuple(r) for r in got] == [(1, "1")]


_PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
          "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _base(text):
    out = []
    for kind, pattern in _PLAIN.items():
        for m in re.finditer(pattern, text or "", re.A):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                  "card": lambda d=digits: 16 <= len(d) <= 19 and _luhn(d), "phone": lambda d=digits: 8 <= len(d) <= 15}[kind]()
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans_equal_the_plain_patterns(spark, docs):
    rng = random.Random(6)
    parts = ["a@b.cc", "%d@e.ff", "x.y@", "@z", ".", "1.2.3.4", "300.1.2.3.4", "007.1.1.255", "4111 1111 1111 1111", "4111-1111-1111-1111-0",
             "4111111111111111", "9", " ", "-", "+1 (988) 555-2485", "+49", "é", "🙂", "word", "..", "12345678901234567890", "\n", "+", "(", "0.0.0.0.0"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))) for i in range(600)]
    rows += [(1000, None), (1001, ""), (1002, "1" * 50_000), (1003, "a" * 50_000 + "@"), (1004, "1 " * 20_000), (1005, "1." * 20_000)]
    got = pii.find(docs(rows)).select("doc_id", pii.render(F.col("base")).alias("s")).collect()
    assert {r["doc_id"]: r["s"] for r in got} == {i: _base(t) for i, t in rows}


def _pii_rows():
    rows = [(i, f"common words here {i} number{i}x") for i in range(40)]
    rows += [(100 + i, f"common words zanzibar me@secret.org common here variant{i}x") for i in range(3)]
    rows += [(200, "zanzibar"), (201, None), (202, "call +1 (386) 555-3733 now common words")]
    return rows


def test_words_that_give_an_entity_away_are_added(docs):
    rows = _pii_rows()
    got = {r["doc_id"]: r for r in pii.find(docs(rows)).collect()}
    text = dict(rows)
    for i in range(100, 103):
        added = [(s["kind"], text[i][s["start"]:s["stop"]]) for s in got[i]["added"]]
        assert added and {w for _, w in added} == {"zanzibar"}  # 'common' says nothing, 'variant..' is seen once
        assert [s["kind"] for s in got[i]["base"]] == ["email"]
    assert all(not r["added"] for i, r in got.items() if i < 100 or i >= 200)


def test_words_that_give_an_entity_away_go_from_every_document(docs):
    rows = _pii_rows() + [(203, "ZANZIBAR, then zanzibar; zanzibari stays"), (204, "ask you@other.net about Zanzibar")]
    rows += [(300 + i, f"common filler {i}") for i in range(400)]
    frame, text = docs(rows), dict(rows)
    got = {r["doc_id"]: r for r in pii.find(frame).collect()}
    assert [text[203][s["start"]:s["stop"]] for s in got[203]["elsewhere"]] == ["ZANZIBAR", "zanzibar"]
    assert [text[200][s["start"]:s["stop"]] for s in got[200]["elsewhere"]] == ["zanzibar"]
    assert all(not r["elsewhere"] for i, r in got.items() if i not in (200, 203, 204))  # 100 to 102 have them in 'added'
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(frame).collect()}
    assert clean[200] == "[WORD]" and clean[203] == "[WORD], then [WORD]; zanzibari stays" and clean[204] == "ask [EMAIL] about [WORD]"
    assert clean[201] is None and clean[5] == text[5] and clean[305] == text[305]


def test_context_keeps_whole_words_at_the_edges(docs):
    rows = [(1, "Zanzibar: me@x.org"), (2, "Jane me@x.org"), (3, "me@x.org Bob"), (4, "far " + "b" * 79 + " me@x.org " + "d" * 79 + " away"),
            (5, "b" * 90 + " c me@x.org e " + "d" * 90), (6, "me@x.org"), (7, "me@x.org" + " f" * 60)]
    found = pii.detect(docs(rows))
    got = {}
    for r in pii._contexts(found).join(found.select("key", "id"), "key").collect():
        got.setdefault(r["id"], set()).add(r["term"])
    assert got == {1: {"zanzibar"}, 2: {"jane"}, 3: {"bob"}, 4: {"b" * 79, "d" * 79}, 5: {"c", "e"}, 7: {"f"}}


def test_sanitise_keeps_rows_and_columns(docs):
    rows = _pii_rows() + [(202, "call +1 (386) 555-3733 now common words")]
    frame = docs(rows)
    out = pii.sanitise(frame)
    assert out.columns == frame.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert out.count() == len(rows)
    assert got[202] == "call [PHONE] now common words" and got[201] is None and got[5] == dict(rows)[5]
    assert "secret" not in got[100] and "zanzibar" not in got[100] and "[EMAIL]" in got[100]
    assert pii.sanitise(docs([])).count() == 0


def _top(rows, k, scale=64):
    ok = {(i, tuple(int(np.floor(scale * float(x))) for x in v)) for i, v in rows
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q, a in sorted(ok):
        if q % 20 == 0:
            score = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if (i, b) != (q, a))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(score, 1)]
    return sorted(out)


@pytest.mark.parametrize("case", ["random", "ties", "large", "few", "none"])
def test_top_k_equals_brute_force(spark, case, monkeypatch):
    monkeypatch.setattr(topk, "VECTORS", 64)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rng = np.random.default_rng(8)
    n, d = {"few": (7, 5), "none": (0, 3)}.get(case, (500, 24))
    scale = {"large": 1e5}.get(case, 1.0)
    x = rng.normal(size=(n, d)) * rng.gamma(1.0, size=(n, 1)) * scale
    if case == "ties":
        x[::3] = np.round(x[0], 1)
    rows = [(i, [float(f) for f in v]) for i, v in enumerate(x.astype(np.float32))]
    if case != "none":
        rows += [(20, rows[0][1]), (3, rows[3][1]), (1000, None), (1001, [1.0, None]), (1002, [float("nan")] * d), (1003, [float("inf")] * d),
                 (1004, [2.0]), (None, rows[0][1])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = topk.top_k(frame, F.col("vec_id") % 20 == 0, 20)
    padded = [(i, v if v is None or len(v) == d else v + [0.0] * (d - len(v)) if None not in v else v) for i, v in rows]
    assert sorted(tuple(r) for r in got.collect()) == _top(padded, 20)


def test_alignment_is_a_common_subsequence():
    rng = random.Random(3)
    for _ in range(200):
        a = [rng.choice("abcdefgh") for _ in range(rng.randrange(12))]
        b = [rng.choice("abcdefgh") for _ in range(rng.randrange(12))]
        got = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))
        assert licenses.align(a, a) == [(i, i) for i in range(len(a))]
    assert len(licenses.align("a x b c d".split(), "a b y c d".split())) == 4


def test_rising_is_a_longest_rising_subsequence():
    rng = random.Random(5)
    for _ in range(200):
        order = rng.sample(range(9), 9)
        got = licenses._rising(list(enumerate(order)))
        best = [1] * 9
        for i in range(9):
            best[i] = 1 + max([best[j] for j in range(i) if order[j] < order[i]], default=0)
        assert len(got) == max(best) and [b for _, b in got] == sorted(b for _, b in got)


def test_license_scan(docs):
    mit = licenses.TEMPLATES["MIT"]
    rows = [(1, "Some words.\nReleased under the MIT License.\nMore."), (2, mit.replace("free of charge", "at no charge").upper()),
            (3, "the license was released long before, and under it the students of mit played games in the yard"), (4, None), (5, ""),
            (6, "Licensed under the Apache License, Version 2.0.\nx\nLicensed under CC BY-NC 4.0."), (1, "no"), (7, "released " * 500),
            (8, "Released under the MIT License. " * 3)]
    got = licenses.scan_licenses(docs(rows)).collect()
    best = sorted((r["doc_id"], r["n_hits"], r["best"]) for r in got if r["n_hits"])
    assert best == [(1, 1, "MIT notice"), (2, 1, "MIT"), (6, 2, "Apache-2.0 notice"), (8, 3, "MIT notice")]
    hit = next(r for r in got if r["doc_id"] == 1 and r["n_hits"])["hits"].split(":")
    assert rows[0][1][int(hit[1]):int(hit[2])] == "Released under the MIT License"
    assert licenses.scan_licenses(docs([])).count() == 0


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_spans_of_all_kinds_are_one_sorted_list(spark):
    kinds = [("removed", 3, 5), ("generalised", 9, 12), ("phone", 1, 9), ("email", 30, 40), ("removed", 0, 2), ("email", 4, 8), ("ip", 2, 9)]
    frame = spark.createDataFrame([([(k, a, b, "x") for k, a, b in kinds],), ([],)], "s array<struct<kind:string,start:int,stop:int,value:string>>")
    got = [r[0] for r in frame.select(pii.render(F.col("s"))).collect()]
    assert got == ["email:4:8,email:30:40,ip:2:9,phone:1:9,generalised:9:12,removed:0:2,removed:3:5", ""]
